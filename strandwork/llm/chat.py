"""Chat formatting: tool calls linked to their results, put in order, checked against schemas, written as canonical JSON.

A message's text is plain, or a JSON object of one of these forms:

- assistant: ``{"content": ..., "tool_calls": [{"id", "name", "arguments", "depends_on": [ids]}]}``; arguments are an
  object or a string that holds one. A call needs the results of the ids in ``depends_on`` and of each ``${id}`` that
  stands in its arguments' strings;
- tool: ``{"tool_call_id": ..., "content": ...}``;
- system: ``{"content": ..., "tools": [{"name", "parameters": schema}]}``.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialize, positions

MESSAGE, CALL, RESULT, TOOL = range(4)
REFERENCE = re.compile(r"\$\{([^{}\s]+)\}")
EVENT = "conv_id long, turn long, kind int, idx int, role string, id string, name string, args string, needs array<string>, json string"


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, characters unescaped, whole numbers without a fraction."""

    def plain(x: object) -> object:
        if isinstance(x, float) and x.is_integer() and abs(x) < 2**53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _object(text: object) -> dict | None:
    if isinstance(text, dict):
        return text
    if not isinstance(text, str) or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _text(x: object) -> str | None:
    return None if x is None else x if isinstance(x, str) else canonical(x)


def parse(role: str | None, text: str | None) -> Iterator[tuple]:
    """The events of one message: (kind, idx, id, name, arguments, needs, canonical JSON)."""
    found = _object(text)
    if found is not None and role == "tool" and "tool_call_id" in found:
        key = _text(found["tool_call_id"])
        out = {"content": found.get("content"), "id": key, "role": "tool"}
        yield RESULT, 0, key, None, None, None, canonical(out)
        return
    listed = found.get({"assistant": "tool_calls", "system": "tools"}.get(role, "")) if found is not None else None
    if not isinstance(listed, list):
        yield MESSAGE, 0, None, None, None, None, canonical({"content": text, "role": role})
        return
    if found.get("content") is not None:
        yield MESSAGE, 0, None, None, None, None, canonical({"content": found["content"], "role": role})
    for i, x in enumerate(x for x in listed if isinstance(x, dict)):
        name = _text(x.get("name"))
        if role == "system":
            yield TOOL, i, None, name, canonical(x.get("parameters")), None, None
            continue
        key, given = _text(x.get("id")), x.get("arguments")
        args = _object(given)
        args = canonical(args if args is not None else given)
        more = x.get("depends_on")
        needs = [_text(y) for y in more if y is not None] if isinstance(more, list) else []
        needs = sorted({*needs, *REFERENCE.findall(args)})
        out = {"arguments": json.loads(args), "id": key, "name": name, "role": role}
        yield CALL, i, key, name, args, needs, canonical(out)


KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, KINDS[kind]) if kind in KINDS else True


def violation(value: object, schema: object, at: str = "$") -> str | None:
    """The first rule of a JSON schema that a value breaks, or None.

    Knows type, enum, const, required, properties, additionalProperties, items, min/maxItems, min/maxLength, minimum,
    maximum and pattern; other keywords allow everything.
    """
    if not isinstance(schema, dict):
        return f"{at}: not allowed" if schema is False else None
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds] if isinstance(kinds, str) else []
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{at}: not of type {' or '.join(map(str, kinds))}"
    if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not one of enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        return f"{at}: not the constant"
    if _is(value, "number"):
        if _is(schema.get("minimum"), "number") and value < schema["minimum"]:
            return f"{at}: below minimum"
        if _is(schema.get("maximum"), "number") and value > schema["maximum"]:
            return f"{at}: above maximum"
    size = len(value) if isinstance(value, (str, list)) else None
    for word in ("Length",) if isinstance(value, str) else ("Items",) if size is not None else ():
        if _is(schema.get("min" + word), "number") and size < schema["min" + word]:
            return f"{at}: shorter than min{word}"
        if _is(schema.get("max" + word), "number") and size > schema["max" + word]:
            return f"{at}: longer than max{word}"
    if isinstance(value, str) and isinstance(schema.get("pattern"), str) and not re.search(schema["pattern"], value):
        return f"{at}: no match of pattern"
    if isinstance(value, list) and "items" in schema:
        return next((bad for i, x in enumerate(value) if (bad := violation(x, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
        required = schema.get("required") if isinstance(schema.get("required"), list) else []
        for key in (k for k in required if k not in value):
            return f"{at}: lacks {key}"
        other = schema.get("additionalProperties", True)
        return next((bad for k in sorted(value) if (bad := violation(value[k], known.get(k, other), f"{at}.{k}"))), None)
    return None


def check(args: str | None, schema: str | None) -> str:
    """``ok``, ``no_schema``, or what is wrong with the arguments."""
    if schema is None:
        return "no_schema"
    try:
        return violation(json.loads(args) if args else None, json.loads(schema)) or "ok"
    except (ValueError, TypeError, re.error, RecursionError) as e:
        return f"error: {type(e).__name__}"


def events(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> a row for each content, call, result and tool definition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (conv, turn, kind, i, role, key, name, args, needs, text)
                for conv, turn, role, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
                for kind, i, key, name, args, needs, text in parse(role, raw)
            ]
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names)

    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.string()]
    names = [x.split()[0] for x in EVENT.split(", ")]
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(run, EVENT)


def _first(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The first row of each key by turn, index and JSON, with partial minima before the shuffle; null keys go."""
    some = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return some.groupBy(*keys).agg(F.min(F.struct("turn", "idx", "json", "args")).alias(what))


def _later(*turns: int | None) -> int | None:
    return max((t for t in turns if t is not None), default=None)


def walk(nodes: dict[int, tuple[int | None, int | None, list[int]]]) -> dict[int, tuple[int | None, int | None]]:
    """eid -> (turn, turn of the result, eids of needs), a whole component, -> eid -> (level, at); see ``order_calls``."""
    open_, needed_by = {}, defaultdict(list)
    for eid, (_, _, needs) in nodes.items():
        open_[eid] = len(needs)
        for x in needs:
            needed_by[x].append(eid)
    out: dict[int, tuple[int | None, int | None]] = {}
    back: dict[int, int | None] = {}
    level, now = 0, [e for e, n in open_.items() if not n]
    while now:
        after = []
        for eid in now:
            turn, result, needs = nodes[eid]
            at = _later(turn, *(back[x] for x in needs))
            out[eid], back[eid] = (level, at), _later(at, result)
            for x in needed_by[eid]:
                open_[x] -= 1
                if not open_[x]:
                    after.append(x)
        level, now = level + 1, after
    return {eid: out.get(eid, (None, turn)) for eid, (turn, _, _) in nodes.items()}


def _walked(nodes: DataFrame) -> DataFrame:
    """``walk`` of the components (root) of nodes; a task reads them one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        root = None

        def done() -> pa.RecordBatch:
            found = walk(held)
            cols = [list(found), [x[0] for x in found.values()], [x[1] for x in found.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["eid", "level", "at"])

        for batch in batches:
            for key, eid, turn, result, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != root and held:
                    yield done()
                    held = {}
                root, held[eid] = key, (turn, result, needs)
        if held:
            yield done()

    kinds = [pa.int64(), pa.int32(), pa.int64()]
    return nodes.repartition("root").sortWithinPartitions("root").mapInArrow(run, PLACED)


PLACED = "eid long, level int, at long"


def _by_rounds(nodes: DataFrame) -> DataFrame:
    """What ``_walked`` gives, for components of any size: a round of joins places the calls whose needs are placed."""
    needs = materialize(nodes.select("eid", F.explode("needs").alias("need")), "needs")
    free = nodes.where(F.size("needs") == 0)
    placed = materialize(free.select("eid", F.lit(0).alias("level"), F.col("turn").alias("at"), F.greatest("turn", "result").alias("back")), "placed")
    waiting, rounds = materialize(nodes.where(F.size("needs") > 0).select("eid", "turn", "result"), "waiting"), 0
    while not waiting.isEmpty():
        rounds += 1
        before = placed.select(F.col("eid").alias("need"), F.col("level").alias("l"), F.col("back").alias("b"))
        ready = (
            needs.join(waiting.select("eid"), "eid", "left_semi")
            .join(before, "need", "left")
            .groupBy("eid")
            .agg(F.count_if(F.col("l").isNull()).alias("open"), F.max("l").alias("l"), F.max("b").alias("b"))
            .where("open = 0")
        )
        at = F.greatest("turn", "b")
        new = waiting.join(ready, "eid").select("eid", (F.col("l") + 1).alias("level"), at.alias("at"), F.greatest(at, "result").alias("back"))
        new = materialize(new, f"level-{rounds}")
        if new.isEmpty():
            break
        placed = placed.unionByName(new)
        waiting = materialize(waiting.join(new, "eid", "left_anti"), f"waiting-{rounds}")
    return placed.drop("back").unionByName(waiting.select("eid", F.lit(None).cast("int").alias("level"), F.col("turn").alias("at")))


def order_calls(calls: DataFrame, edges: DataFrame, most: int = 100_000) -> DataFrame:
    """(eid, turn, result) and (eid, need) -> (eid, level, at) of the calls in edges.

    level is topological, at the turn at which a call can stand at the earliest: its own, or that of the last result that
    it needs. Calls in a cycle, or behind one, get a null level and their own turn. Edges join calls to components in
    logarithmic rounds; a component of ``most`` calls and edges is walked within a task, a larger one by a round of joins
    for each level.
    """
    edges = materialize(edges.distinct(), "edges")
    if edges.isEmpty():
        return calls.sparkSession.createDataFrame([], PLACED)
    named = connected_components(edges.select(F.col("eid").alias("a"), F.col("need").alias("b")))
    wanted = edges.groupBy("eid").agg(F.collect_list("need").alias("needs"))
    both = edges.select("eid").unionByName(edges.select(F.col("need").alias("eid"))).distinct()
    nodes = (
        both.join(wanted, "eid", "left")
        .join(named.withColumnRenamed("node", "eid"), "eid", "left")
        .join(calls, "eid")
        .select(F.coalesce("root", "eid").alias("root"), "eid", "turn", "result", F.coalesce("needs", F.expr("cast(array() as array<bigint>)")).alias("needs"))
    )
    nodes = materialize(nodes, "nodes")
    sizes = nodes.groupBy("root").agg(F.sum(1 + F.size("needs")).alias("n"))
    large = materialize(sizes.where(F.col("n") > most).select("root"), "large")
    if large.isEmpty():
        return _walked(nodes)
    return _walked(nodes.join(large, "root", "left_anti")).unionByName(_by_rounds(nodes.join(large, "root", "left_semi")))


def last_uses(asks: DataFrame, calls: DataFrame) -> DataFrame:
    """(eid, conv, need, turn) and (conv, id, turn, use) -> (eid, conv, need, use): the last use of the id at or before the turn,
    or the first one (0). Running values are taken in ranges of (conv, id, turn) and then over ranges."""
    given = calls.select("conv", F.col("id").alias("need"), "turn", F.lit(0).alias("late"), "use", F.lit(None).cast("long").alias("eid"))
    asked = asks.select("conv", "need", "turn", F.lit(1).alias("late"), F.lit(None).cast("long").alias("use"), "eid")
    rows = given.unionByName(asked).repartitionByRange("conv", "need", "turn", "late").withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "asks")
    group = ["conv", "need"]
    here = Window.partitionBy(*group, "part").orderBy("turn", "late", "use").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "part").agg(F.max("use").alias("last")).withColumn("before", F.max("last").over(earlier))
    found = rows.withColumn("use", F.max("use").over(here)).where("late = 1").join(parts.drop("last"), [*group, "part"])
    return found.select("eid", *group, F.coalesce("use", "before", F.lit(0).cast("long")).alias("use"))


def link(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, position, turn, kind, role, id, linked, valid, json), a row for each event.

    kind is message, call or result. Calls and results are hash-joined by conversation, id and use: the k-th call of an id
    (by turn, index and JSON) meets its k-th result, others are not linked. A call that needs an id needs its last use of
    the same turn or an earlier one, else its first; its own id is the use before it. Events are ordered by turn, but a
    result comes after its call, and a call after the results that it needs; calls in a cycle keep their turn, and their
    ``valid`` says ``cycle``. Else ``valid`` is what ``check`` says of a call's arguments under its conversation's schema
    for the name, or that of ``tools`` (name, schema). ``json`` is canonical.

    A null or broken text is the content null or itself; null conv_ids are one conversation; null turns come first; null
    ids are not linked; repeated rows are each kept; no rows give no rows. No task holds a whole conversation.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv")
    found = materialize(events(messages).select("*", conv, F.monotonically_increasing_id().alias("eid")), "events")
    calls = found.where(F.col("kind") == CALL)
    used = found.where(F.col("kind").isin(CALL, RESULT) & F.col("id").isNotNull()).select("conv", "id", "kind", "turn", "idx", "json", "eid")
    used = positions(used, ["conv", "id", "kind"], ["turn", "idx", "json", "eid"], "uses").withColumnRenamed("position", "use")
    used = materialize(used.select("eid", "conv", "id", "kind", "turn", "use"), "used")
    named = used.where(F.col("kind") == CALL).drop("kind")
    results = used.where(F.col("kind") == RESULT).select("conv", "id", "use", F.col("eid").alias("r_eid"), F.col("turn").alias("result"))
    pairs = materialize(named.hint("shuffle_hash").join(results, ["conv", "id", "use"]).select("eid", "r_eid", "result"), "pairs")

    asks = calls.select("eid", "conv", "id", "turn", F.explode("needs").alias("need"))
    own = asks.where("need = id").join(named.select("eid", "use"), "eid").select("eid", "conv", "need", F.greatest(F.col("use") - 1, F.lit(0)).alias("use"))
    asks = asks.where("id is null or need <> id").join(named.select("conv", F.col("id").alias("need")).distinct(), ["conv", "need"], "left_semi")
    wanted = last_uses(asks, named).unionByName(own)
    edges = wanted.join(named.select("conv", F.col("id").alias("need"), "use", F.col("eid").alias("to")), ["conv", "need", "use"])
    placed = order_calls(calls.select("eid", "turn").join(pairs.drop("r_eid"), "eid", "left"), edges.select("eid", F.col("to").alias("need")))
    known = calls.select("eid", "turn").join(pairs.drop("result"), "eid", "left").join(placed.withColumn("stuck", F.col("level").isNull()), "eid", "left")
    known = materialize(
        known.select("eid", "r_eid", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("at", "turn").alias("at"), F.coalesce("stuck", F.lit(False)).alias("stuck")), "placed"
    )
    of_calls = known.select("eid", F.col("r_eid").isNotNull().alias("linked"), "level", "at", "stuck")
    of_results = known.where("r_eid is not null").select(F.col("r_eid").alias("eid"), F.lit(True).alias("linked"), "level", "at", F.lit(False).alias("stuck"))

    defined = _first(found.where(F.col("kind") == TOOL), ["conv", "name"], "d")
    defined = defined.select("conv", "name", F.col("d.args").alias("schema"))
    checked = calls.join(defined, ["conv", "name"], "left")
    if tools is not None:
        common = tools.where("name is not null").groupBy("name").agg(F.min("schema").alias("common"))
        checked = checked.join(common, "name", "left").withColumn("schema", F.coalesce("schema", "common"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [check(a, s) for a, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(said, pa.string())], names)

    kept = ["eid", "conv_id", "turn", "kind", "idx", "role", "id", "json"]
    names = [*kept, "valid"]
    schema = ", ".join(f"{x} {t}" for x, t in zip(names, ["long", "long", "long", "int", "int", *["string"] * 4], strict=True))
    checked = checked.select("args", "schema", *kept).mapInArrow(run, schema).join(of_calls, "eid", "left")
    results = found.where(F.col("kind") == RESULT).select(*kept, F.lit(None).cast("string").alias("valid")).join(of_results, "eid", "left")
    rest = found.where(F.col("kind") == MESSAGE).select(*kept)
    rows = checked.unionByName(results).unionByName(rest, allowMissingColumns=True)
    rows = rows.select(
        "conv_id",
        "turn",
        F.element_at(F.array(*map(F.lit, ["message", "call", "result"])), F.col("kind") + 1).alias("kind"),
        "role",
        "id",
        F.when(F.col("kind") != MESSAGE, F.coalesce("linked", F.lit(False))).alias("linked"),
        F.when(F.col("stuck"), F.lit("cycle")).otherwise(F.col("valid")).alias("valid"),
        "json",
        F.greatest("turn", "at").alias("_at"),
        F.when(F.col("kind") == MESSAGE, 0).otherwise(2 * F.coalesce("level", F.lit(0)) + F.col("kind")).alias("_phase"),
        "idx",
    )
    placed = positions(rows, ["conv_id"], ["_at", "_phase", "turn", "idx", "json"], "events")
    return placed.select("conv_id", "position", "turn", "kind", "role", "id", "linked", "valid", "json")


def format_chats(messages: DataFrame, tools: DataFrame | None = None, part_events: int = 256) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, part, n_events, n_calls, n_linked, n_invalid, json).

    json is a canonical array of a conversation's events in ``link``'s order; one of over ``part_events`` has several
    parts, whose arrays follow each other, so that no row and no group grows without bound.
    """
    part = F.floor(F.col("position") / part_events).cast("long").alias("part")
    return (
        link(messages, tools)
        .groupBy("conv_id", part)
        .agg(
            F.count("*").alias("n_events"),
            F.count_if(F.col("kind") == "call").alias("n_calls"),
            F.count_if((F.col("kind") == "call") & F.col("linked")).alias("n_linked"),
            F.count_if(~F.col("valid").isin("ok", "no_schema")).alias("n_invalid"),
            F.array_sort(F.collect_list(F.struct("position", "json"))).alias("rows"),
        )
        .withColumn("json", F.concat(F.lit("["), F.array_join(F.col("rows.json"), ","), F.lit("]")))
        .drop("rows")
    )
