"""Text statistics, and a decision list of threshold conjunctions learned from labelled ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordIds, materialize, window_hashes

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct_words", "n_digits", "n_upper", "n_stops"]

#: What rules may test, as SQL over the counts.
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
}


def count(text: str | None, ids: WordIds) -> list[int]:
    """The counts of one text, in the order of COUNTS and MORE; all zero for null."""
    if not text:
        return [0] * (len(COUNTS) + len(MORE))
    raw = text.encode()
    words = raw.split()
    n = len(words)
    n_space = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\x0b\x0c\r"):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    found = ids.of(words)
    if n > WINDOW:
        _, at, times = np.unique(window_hashes(found, WINDOW), return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[at] > 1)
        if len(hit):
            change = np.bincount(hit, minlength=n + 1) - np.bincount(hit + WINDOW, minlength=n + 1)[: n + 1]
            repeated = int((np.cumsum(change)[:n] > 0).sum())
    drop = lambda chars: len(raw) - len(raw.translate(None, chars))
    return [
        n,
        len(text) - n_space,
        drop(SYMBOLS),
        dup,
        repeated,
        lines,
        len(np.unique(found)),
        drop(b"0123456789"),
        drop(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        sum(x.endswith((b".", b"!", b"?")) for x in words),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and the counts of the whole text.

    A word is a run without ASCII white space. A line (between \\n) counts as repeated if it has a word and equals an
    earlier one. n_repeat_words counts words in runs of 8 words that occur twice or more, the first included.
    """
    names = ["doc_id", *COUNTS, *MORE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            rows = np.array([count(x.as_py(), ids) for x in batch.column(1)], np.int64).reshape(-1, len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold), with its hits and bad hits on rows kept from growing."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)
    hits: int = 0
    bad: int = 0

    def on(self, x: dict[str, np.ndarray]) -> np.ndarray:
        parts = [x[f] <= t if op == "<=" else x[f] > t for f, op, t in self.tests]
        return reduce(np.logical_and, parts)

    def column(self) -> Column:
        parts = [F.expr(f"({FEATURES[f]}) {op} {t!r}D") for f, op, t in self.tests]
        return reduce(lambda a, b: a & b, parts)

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.tests)


def _low(hits: float, bad: float) -> float:
    """Lower end of the 90 % interval of a share (Wilson)."""
    if not hits:
        return 0.0
    z, p = 1.2816, bad / hits
    return (p + z * z / (2 * hits) - z * np.sqrt(p * (1 - p) / hits + z * z / (4 * hits * hits))) / (1 + z * z / hits)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.85, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """Sequential covering: rules that find bad rows, in order.

    Two thirds of the rows grow a rule, test by test, by information gain over thresholds at quantiles; the last third
    prunes it from its end to where its precision's lower bound is best. A rule stays if that bound is
    ``min_precision`` at least; what it covers leaves the rows, and the next one is grown until none stays.
    """
    n = len(bad)
    grow = np.arange(n) % 3 > 0
    left = np.ones(n, bool)
    rules: list[Rule] = []
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])) for f, v in x.items()} if n else {}
    while len(rules) < max_rules and (bad & left & grow).sum() >= 5:
        rule, inside = Rule(), left & grow
        while len(rule.tests) < max_tests:
            p, m = (bad & inside).sum(), inside.sum()
            if p == m:
                break
            best = (0.0, None, None)
            for f, v in x.items():
                for t in cuts[f].tolist():
                    for op, hit in (("<=", inside & (v <= t)), (">", inside & (v > t))):
                        q, k = (bad & hit).sum(), hit.sum()
                        if q >= 5 and k < m and (gain := q * (np.log2(q / k) - np.log2(p / m))) > best[0]:
                            best = (gain, (f, op, t), hit)
            if best[1] is None:
                break
            rule.tests.append(best[1])
            inside = best[2]
        if not rule.tests:
            break
        held = left & ~grow
        scores = []
        for k in range(1, len(rule.tests) + 1):
            hit = Rule(rule.tests[:k]).on(x) & held
            scores.append((_low(hit.sum(), (bad & hit).sum()), -k, int(hit.sum()), int((bad & hit).sum())))
        score, k, hits, n_bad = max(scores)
        if score < min_precision:
            break
        rules.append(Rule(rule.tests[:-k], hits, n_bad))
        left &= ~rules[-1].on(x)
    return rules


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional expression: false at the first rule that holds, true if none does."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled rows (those with the least hashes); labels are (doc_id, quality 0/1).

    Rows without a label, a doc_id or a quality are left out; labels that contradict each other all count.
    """
    known = labels.select(F.col("doc_id").cast("long"), "quality").where("doc_id is not null and quality is not null")
    share = min(1.0, 1.2 * (max_rows + 1000) / max(1, known.count()))
    h = F.xxhash64("doc_id")
    known = known.where(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30)))  # little more than max_rows, wherever they lie
    rows = (
        stats.join(known, "doc_id")
        .select(F.pmod(h, F.lit(1 << 30)).alias("h"), "quality", *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
        .orderBy("h", "quality", *FEATURES)
        .limit(max_rows)
        .toPandas()
    )
    x = {f: rows[f].to_numpy(float) for f in FEATURES}
    return learn(x, (rows["quality"] == 0).to_numpy())


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, counts, base_failed, kept and the number of the rule that held (null: none).

    kept is false if base_failed, else what the learned list says. A null or empty text has zero counts and fails.
    Without usable labels the list is empty. Repeated rows are all returned; no rows give no rows.
    """
    stats = materialize(statistics(docs), "statistics")
    rules = fit(stats, labels, max_rows)
    number = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        number = F.when(rule.column(), F.lit(i)).otherwise(number)
    return stats.select(
        "doc_id",
        *COUNTS,
        base_failed().alias("base_failed"),
        F.when(base_failed(), F.lit(False)).otherwise(decision(rules)).alias("kept"),
        number.alias("rule"),
    )
