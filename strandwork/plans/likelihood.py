"""Forward-backward held by SQL: a small model with sequence, both strands and a nucleosome, over stretches of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hmm
from . import tables as T

QUERIES: dict[str, T.Query] = {}
SQL: dict[str, str] = {}
query = T.registered(QUERIES, SQL)

WEIGHTS = {"background": 0.85, "nucleosome": 0.05, "ABF1": 0.06, "REB1": 0.04}
LENGTHS = {"ABF1": 4, "REB1": 3}


def _shares(values: list[int]) -> list[float]:
    return [v / sum(values) for v in values]


def sequence_model() -> hmm.Model:
    """Every table of the model follows a rule that the SQL states as well."""
    motifs = {name: [_shares([1 + (2 * i + 3 * b + k) % 7 for b in range(4)]) for i in range(n)] for k, (name, n) in enumerate(LENGTHS.items())}
    steps = [[_shares([1 + (a + 2 * b + g) % 5 for b in range(4)]) for a in range(4)] for g in range(hmm.MIDDLE - 1)]
    ends = [_shares([1 + (k + b) % 3 for b in range(4)]) for k in range(hmm.HEAD + hmm.TAIL)]
    hump = tuple(0.5 + 0.02 * (73 - abs(i - 73)) for i in range(147))
    counts = {"long": hmm.Counts((0.5, 1.5), (1.0, 1.0), (hump, 2.0))}
    return hmm.Model(motifs, [0.3, 0.2, 0.2, 0.3], WEIGHTS, [0.1, 0.2, 0.3, 0.4], steps, ends, counts)


def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors in a row are a segment: a component's size gives its base, and its distance from 0 a count."""
    x = F.col("x").cast("double")
    code = F.when(F.abs(x) < 0.004, 4).when(x < -0.08, 0).when(x < 0, 1).when(x < 0.08, 2).otherwise(3)
    rows = T.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    each = F.struct((F.col("vec_id") % 3 * 64 + F.col("i")).alias("t"), code.alias("code"), F.least(F.lit(9), F.floor(F.abs(x) * 20)).cast("int").alias("n"))
    rows = rows.groupBy(F.floor(F.col("vec_id") / 3).alias("segment_id")).agg(F.sort_array(F.collect_list(each)).alias("o"))
    return rows.select("segment_id", F.lit("v").alias("chr"), F.lit(1).cast("long").alias("start"), F.col("o.code").alias("codes"), F.col("o.n").alias("long"))


def _states() -> str:
    """s(s, kind, i, b): motifs forward and backward with their places, the nucleosome's positions; b where a state is one base's."""
    rows, at = ["SELECT 0 AS s, 'background' AS kind, '' AS strand, 0 AS i, NULL::INT AS b"], 1
    for name, n in LENGTHS.items():
        for strand in "+-":
            rows.append(f"SELECT {at} + i, '{name}', '{strand}', i, NULL FROM range({n}) r(i)")
            at += n
    rows.append(f"SELECT {at} + i, 'nucleosome', '', i, NULL FROM range(9) r(i)")
    rows.append(f"SELECT {at} + 9 + 4 * g + b, 'nucleosome', '', 9 + g, b FROM range(128) r(g), range(4) q(b)")
    rows.append(f"SELECT {at} + 521 + i, 'nucleosome', '', 137 + i, NULL FROM range(10) r(i)")
    return " UNION ALL ".join(rows)


#: The observations, states, emissions, and edges within elements. Edges between elements carry weights, see ``_edges``.
MODEL = f"""s AS MATERIALIZED ({_states()}),
  obs AS MATERIALIZED (SELECT vec_id // 3 AS seg, vec_id % 3 * 64 + k AS t, CASE WHEN abs(x) < 0.004 THEN 4 WHEN x < -0.08 THEN 0 WHEN x < 0 THEN 1 WHEN x < 0.08 THEN 2 ELSE 3 END AS code,
    least(9, floor(abs(x) * 20))::INT AS n FROM (SELECT vec_id, k, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) r(k))),
  last AS (SELECT seg, max(t) AS n FROM obs GROUP BY seg),
  motif AS (SELECT kind, i, b, (1 + (2 * i + 3 * b + kind_no) % 7) / sum(1 + (2 * i + 3 * b + kind_no) % 7) OVER (PARTITION BY kind, i) AS p
    FROM (SELECT DISTINCT kind, i, CASE kind WHEN 'ABF1' THEN 0 ELSE 1 END AS kind_no FROM s WHERE strand <> ''), range(4) r(b)),
  base AS (SELECT s, code, CASE WHEN code = 4 THEN 1 WHEN kind = 'background' THEN CASE WHEN code IN (0, 3) THEN 0.3 ELSE 0.2 END
      WHEN strand = '+' THEN (SELECT p FROM motif m WHERE m.kind = s.kind AND m.i = s.i AND m.b = code)
      WHEN strand = '-' THEN (SELECT p FROM motif m WHERE m.kind = s.kind AND m.i = (SELECT max(i) FROM motif z WHERE z.kind = s.kind) - s.i AND m.b = 3 - code)
      WHEN s.b IS NOT NULL THEN (s.b = code)::INT
      ELSE (1 + (CASE WHEN i < 9 THEN i ELSE i - 128 END + code) % 3) / (SELECT sum(1 + (CASE WHEN s.i < 9 THEN s.i ELSE s.i - 128 END + z) % 3) FROM range(4) q(z)) END::DOUBLE AS p
    FROM s, range(5) r(code)),
  dispersion AS (SELECT s, CASE WHEN kind = 'background' THEN 0.5 WHEN kind = 'nucleosome' THEN 0.5 + 0.02 * (73 - abs(i - 73)) ELSE 1.0 END::DOUBLE AS mu,
    CASE WHEN kind = 'background' THEN 1.5 WHEN kind = 'nucleosome' THEN 2.0 ELSE 1.0 END::DOUBLE AS phi FROM s),
  em AS MATERIALIZED (SELECT s, code, n, p * exp(lgamma(n + phi) - lgamma(phi) - lgamma(n + 1) + phi * ln(phi / (phi + mu)) + n * ln(mu / (phi + mu))) AS e
    FROM base JOIN dispersion USING (s), range(10) r(n) WHERE p > 0),
  step AS (SELECT g, a, b, (1 + (a + 2 * b + g) % 5) / sum(1 + (a + 2 * b + g) % 5) OVER (PARTITION BY g, a) AS p FROM range(127) r(g), range(4) q(a), range(4) z(b)),
  inner_edges AS MATERIALIZED (SELECT x.s AS f, y.s AS t, CASE WHEN x.b IS NULL AND y.b IS NOT NULL THEN 0.1 * (y.b + 1) WHEN y.b IS NOT NULL THEN step.p ELSE 1 END::DOUBLE AS p
    FROM s x JOIN s y ON x.kind = y.kind AND x.strand = y.strand AND y.i = x.i + 1 LEFT JOIN step ON step.g = x.i - 9 AND step.a = x.b AND step.b = y.b),
  ends AS (SELECT s FROM s WHERE s NOT IN (SELECT f FROM inner_edges))"""


def _forward(name: str, weights: str) -> str:
    """Entries and edges under ``weights`` (kind, w), and forward values, of sum 1 at each base; c is what they were divided by."""
    return f"""{name}_entry AS MATERIALIZED (SELECT s, CASE WHEN strand <> '' THEN w / 2 ELSE w END AS w FROM s JOIN {weights} USING (kind) WHERE i = 0 AND b IS NULL),
  {name}_edges AS MATERIALIZED (SELECT * FROM inner_edges UNION ALL SELECT ends.s, e.s, e.w FROM ends, {name}_entry e),
  {name} AS (SELECT seg, t, s, r / sum(r) OVER (PARTITION BY seg) AS alpha, sum(r) OVER (PARTITION BY seg) AS c FROM
      (SELECT seg, t, s, w * e AS r FROM obs JOIN em USING (code, n) JOIN {name}_entry USING (s) WHERE t = 1)
    UNION ALL SELECT seg, t, s, r / sum(r) OVER (PARTITION BY seg), sum(r) OVER (PARTITION BY seg) FROM
      (SELECT seg, t, s, r * e AS r FROM (SELECT seg, x.t + 1 AS t, g.t AS s, sum(alpha * p) AS r FROM {name} x JOIN {name}_edges g ON g.f = x.s GROUP BY seg, x.t, g.t)
        JOIN obs USING (seg, t) JOIN em USING (s, code, n))),
  {name}_scale AS MATERIALIZED (SELECT DISTINCT ON (seg, t) seg, t, c FROM {name})"""


def _both(name: str, weights: str) -> str:
    """``_forward``, and chances of states at each base, from backward values on the same scale."""
    return f"""{_forward(name, weights)},
  {name}_back AS (SELECT seg, n AS t, s, 1::DOUBLE AS beta FROM last, s
    UNION ALL SELECT seg, q.t, f, sum(v * p) FROM
      (SELECT seg, x.t - 1 AS t, s, beta * e / c AS v FROM {name}_back x JOIN obs USING (seg, t) JOIN em USING (s, code, n) JOIN {name}_scale USING (seg, t) WHERE x.t > 1) q
      JOIN {name}_edges g ON g.t = q.s GROUP BY seg, q.t, f),
  {name}_post AS MATERIALIZED (SELECT seg, t, s, alpha * beta / sum(alpha * beta) OVER (PARTITION BY seg, t) AS p FROM {name} JOIN {name}_back USING (seg, t, s))"""


FIRST = "w0 AS (SELECT unnest({kinds}) AS kind, unnest({values}) AS w)".format(kinds=list(WEIGHTS), values=list(WEIGHTS.values()))


@query(
    f"""WITH RECURSIVE {MODEL}, {FIRST}, {_both("fb", "w0")},
    named AS (SELECT s, kind AS dbf FROM s UNION ALL SELECT s, 'nuc_center' FROM s WHERE kind = 'nucleosome' AND i = 73 UNION ALL SELECT min(s), 'nuc_start' FROM s WHERE kind = 'nucleosome' UNION ALL SELECT max(s), 'nuc_end' FROM s)
    SELECT seg AS segment_id, t AS pos, dbf, round(sum(p), 5) AS prob FROM fb_post JOIN named USING (s) WHERE p >= 1e-4 GROUP BY ALL"""
)
def hmm_sequence_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy of every base of every stretch of vectors."""
    found = hmm.decode_factors(stretches(spark, sf_dir), sequence_model())
    return found.select("segment_id", "pos", "dbf", F.round("prob", 5).alias("prob"))


@query(
    f"""WITH RECURSIVE {MODEL}, {FIRST}, {_both("fb", "w0")},
    starts AS (SELECT kind, sum(p) AS n FROM fb_post JOIN s USING (s) WHERE i = 0 AND b IS NULL GROUP BY kind),
    free AS (SELECT kind, n / sum(n) OVER () AS w, kind NOT IN ('background', 'nucleosome') AND n / sum(n) OVER () > 0.07 AS big FROM starts),
    k AS (SELECT count(*) FILTER (big) AS k, sum(w) FILTER (NOT big) AS rest FROM free),
    w1 AS (SELECT kind, CASE WHEN k = 0 THEN w WHEN big THEN 0.07 ELSE w * (1 - k * 0.07) / rest END AS w FROM free, k),
    {_forward("fw", "w1")}
    SELECT kind AS dbf, round(w, 5) AS weight, round((SELECT sum(ln(c)) FROM fb_scale), 2) AS before, round((SELECT sum(ln(c)) FROM fw_scale), 2) AS after FROM w1"""
)
def hmm_sequence_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of expectation-maximisation over all stretches: new weights, log likelihood before and after."""
    model, (before, after) = hmm.train(stretches(spark, sf_dir), sequence_model(), rounds=1)
    rows = [(k, w, before, after) for k, w in model.weights.items()]
    found = spark.createDataFrame(rows, "dbf string, weight double, before double, after double")
    return found.select("dbf", F.round("weight", 5).alias("weight"), F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))
