"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, langid, materialise, packing, pii, quality, secrets, shards, simhash, substring, trie
from . import spans as S
from .common import materialize, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.classify(docs.select("doc_id", "text"), langid.fit(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _digest(spans: Column) -> Column:
    return F.sha2(S.listed(spans), 256)


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(_count("base_spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        _digest(F.col("base_spans")).alias("base_sha256"),
        S.listed(F.col("secret_spans")).alias("spans"),
        F.size("secret_spans").alias("n_spans"),
    )


@query
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(_count("base_spans", k).alias(f"n_{k}") for k in pii.KINDS[:4]),
        _digest(F.col("base_spans")).alias("base_sha256"),
        S.listed(F.col("pii_spans")).alias("spans"),
        F.size("pii_spans").alias("n_spans"),
    )


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}"
    materialise.write(table(spark, sf_dir, "documents"), path)
    return materialise.index(spark, path)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = trie.with_shared_openings(trie.turns_of(table(spark, sf_dir, "conversations")))
    return trie.nodes(materialize(turns, "rebuilt"), convs)


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query
def op13_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Assignments and codebooks of each round as a table of its own."""
    near = """n{k} AS MATERIALIZED (SELECT rid, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
      SELECT x.rid, x.p, b.e, sum((x.x - b.x) * (x.x - b.x)) AS far FROM comps x JOIN b{k} b ON x.p = b.p AND x.i = b.i GROUP BY ALL) GROUP BY rid, p)"""
    step = """b{next} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
      SELECT n.p, n.e, x.i, (sum(x.x) - (sum(x.x) % count(*) + count(*)) % count(*)) // count(*) AS x FROM n{k} n JOIN comps x ON n.rid = x.rid AND n.p = x.p GROUP BY ALL) m
      ON b.p = m.p AND b.e = m.e AND b.i = m.i)"""
    made = ",\n".join(f"{near.format(k=k)},\n{step.format(k=k, next=k + 1)}" for k in range(rounds))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label,
      list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    comps AS MATERIALIZED (SELECT rid, (pos - 1) // (len(v) // {parts}) AS p, (pos - 1) % (len(v) // {parts}) AS i, v[pos]::HUGEINT AS x
      FROM kept, unnest(range(1, len(v) + 1)) AS r(pos)),
    first AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, v FROM (SELECT vec_id, min(v) AS v FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {entries})),
    b0 AS MATERIALIZED (SELECT (pos - 1) // (len(v) // {parts}) AS p, e, (pos - 1) % (len(v) // {parts}) AS i, v[pos]::HUGEINT AS x FROM first, unnest(range(1, len(v) + 1)) AS r(pos)),
    {made},
    {near.format(k=rounds)},
    coded AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM n{rounds} GROUP BY rid),
    whole AS (SELECT k.vec_id, k.label, c.code, c.error FROM kept k JOIN coded c USING (rid)),
    sums AS (SELECT label, sum(error)::BIGINT AS label_error FROM whole GROUP BY label)
    SELECT w.vec_id, w.code, w.error, s.label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
    FROM whole w JOIN sums s ON w.label IS NOT DISTINCT FROM s.label"""


SQL["op12_vector_codes"] = _codes_sql()

#: Nodes by whole lists of turns; the CRC-32 is taken bit by bit over the digits.
SQL["op11_prefix_trie"] = r"""WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS host, xor(4294967295, list_reduce(
        list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, b:
        list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, b)), 4294967295::BIGINT)) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
    rebuilt AS (SELECT c, 0 AS own, i, role, text FROM convs JOIN turns ON turns.conv_id = host AND i <= h
      UNION ALL SELECT c, 1, i, role, text FROM convs JOIN turns ON turns.conv_id = c AND i > h),
    lists AS MATERIALIZED (SELECT c, list({'r': role, 't': text} ORDER BY own, i) FILTER (role IS NOT NULL) AS l FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c),
    members AS MATERIALIZED (SELECT c, d, coalesce(len(l), 0) AS n, coalesce(l[1:d], []) AS k FROM lists, unnest(range(0, coalesce(len(l), 0) + 1)) AS r(d)),
    groups AS MATERIALIZED (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs,
      CASE WHEN d > 0 THEN len(regexp_extract_all(any_value(k)[d].t, '[^ 	-
]+')) ELSE 0 END AS words,
      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM members GROUP BY d, k),
    tree AS MATERIALIZED (SELECT g.*, p.conv_id AS parent_conv_id FROM groups g LEFT JOIN groups p ON p.d = g.d - 1 AND p.k = g.k[1:g.d - 1]),
    kids AS (SELECT parent_conv_id, d - 1 AS d, count(*) AS n_children FROM tree WHERE d > 0 GROUP BY ALL),
    full_tree AS MATERIALIZED (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tree t LEFT JOIN kids ON kids.parent_conv_id = t.conv_id AND kids.d = t.d),
    below AS (SELECT a.d, a.conv_id, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
      FROM full_tree a JOIN members m ON m.d = a.d AND m.k = a.k JOIN full_tree b ON b.conv_id = m.c AND b.d >= a.d GROUP BY ALL)
    SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
    FROM full_tree f JOIN below b USING (d, conv_id)"""
