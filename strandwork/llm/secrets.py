"""Secrets in texts: fixed patterns, and strings that look random by a battery of tests. Built-in functions only.

The battery. A candidate's encoding is inferred from its characters. Three statistics compare it with two models of that
encoding: random strings (characters independent and uniform), and ordinary identifiers (words, capitals and digits in the
shares below). They are the pairs of equal characters (what a chi-squared test of uniformity counts), the runs of
characters of one class, and the serial dependence of vowels and consonants. A candidate that the random model rejects is
not a secret. For the others, the three statistics give one p-value under the model of ordinary identifiers; the
Benjamini-Hochberg procedure with weights by length decides over the whole corpus which ordinary identifiers are
rejected: these are reported.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Failing matches are dropped, not retried: these two find the same as the open-ended patterns and a check of length.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are inferred: what the body must match, alphabet. The last one takes all.
ENCODINGS = [
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER),
    (r"^(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[0-9]+$", DIGITS),
    (r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    (r"^[a-z0-9_-]+$", DIGITS + LOWER + "-_"),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    (r"^", UPPER + LOWER + DIGITS + "+/-_"),
]

# Percentages of the letters a to z in running text, and what ordinary identifiers are made of.
LETTERS = [8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1]
DIGIT_SHARE, UPPER_SHARE, SIGN_SHARE = 0.12, 0.15, 0.08
CLASS_CHANGES, SIGN_CHANGES, VOWEL_CHANGES = 0.2, 0.3, 0.6
#: How far (in standard deviations) a string may lie from the random model on the side of ordinary ones.
REJECTED = 4.0
LONGEST = 256  # lengths from here on are one class
BINS = 200  # of -10 log10 p


def _kind(c: str) -> str:
    return "l" if c in LOWER else "u" if c in UPPER else "d" if c in DIGITS else "s"


def ordinary(alphabet: str) -> np.ndarray:
    """Shares of an alphabet's characters in ordinary identifiers."""
    kinds = [_kind(c) for c in alphabet]
    mixed, letters = {"l", "u"} <= set(kinds), {"l", "u"} & set(kinds)
    weight = {"d": DIGIT_SHARE if letters else 1.0, "s": SIGN_SHARE, "u": UPPER_SHARE if mixed else 1.0, "l": 1 - UPPER_SHARE if mixed else 1.0}
    weight = {k: w * (1 - DIGIT_SHARE if k in "lu" else 1) for k, w in weight.items()}
    p = np.array([weight[k] * (LETTERS[LOWER.index(c.lower())] if k in "lu" else 100 / kinds.count(k)) for c, k in zip(alphabet, kinds, strict=True)])
    return p / p.sum()


def changes(alphabet: str) -> float:
    """How often the class changes from a character to the next one in random strings; a capital and a small letter after
    it are no change, as they begin a word."""
    kinds = [_kind(c) for c in alphabet]
    share = {k: kinds.count(k) / len(kinds) for k in "luds"}
    return 1 - sum(x * x for x in share.values()) - share["u"] * share["l"]


def model() -> list[tuple]:
    """By encoding: size, sums of squares and cubes of the ordinary shares, class changes when ordinary and when random
    (0: there is one class), vowel changes when random (0: no letters beyond f)."""
    rows = []
    for _, abc in ENCODINGS:
        p, r = ordinary(abc), changes(abc)
        signs = any(_kind(c) == "s" for c in abc)
        vowels = np.array([c.lower() in "aeiou" for c in abc if c.lower() in LOWER])
        v = float(2 * vowels.mean() * (1 - vowels.mean())) if len(vowels) >= 26 else 0.0
        rows.append((float(len(abc)), float((p**2).sum()), float((p**3).sum()), (SIGN_CHANGES if signs else CLASS_CHANGES) if r > 0.05 else 0.0, r, v))
    return rows


def battery(token: Column) -> Column:
    """struct(n, p): the length without padding, and the p-value of a candidate as an ordinary identifier: the chance that
    one of its encoding and length looks as random. 1 for strings that the random model rejects.

    The three statistics are taken as normal under either model; those that an encoding has are summed up.
    """
    fields = ["k", "s2", "s3", "c0", "c1", "v1"]
    table = F.array(*(F.struct(*(F.lit(x).alias(f) for f, x in zip(fields, row, strict=True))) for row in model()))

    def inferred(t: Column) -> Column:
        body = F.regexp_replace(t, "=+$", "")
        number = None
        for i, (pattern, _) in enumerate(ENCODINGS):
            number = F.when(body.rlike(pattern), i + 1) if number is None else number.when(body.rlike(pattern), i + 1)
        return F.struct(body.alias("body"), F.element_at(table, number).alias("e"))

    def counted(x: Column) -> Column:
        body = x["body"]
        classes = F.translate(body, LOWER + UPPER + DIGITS + "+/-_", "l" * 26 + "u" * 26 + "d" * 10 + "ssss")
        sounds = F.translate(F.lower(body), LOWER, "".join("v" if c in "aeiou" else "c" for c in LOWER))
        each = F.transform(F.array_distinct(F.split(body, "")), lambda c: F.when(c != "", F.length(body) - F.length(F.replace(body, c, F.lit("")))).otherwise(0))
        return F.struct(
            x["e"].alias("e"),
            F.length(body).cast("double").alias("n"),
            F.aggregate(each, F.lit(0.0), lambda a, c: a + c.cast("double") * (c - 1)).alias("pairs"),
            F.regexp_count(classes, F.lit("l(?=[uds])|u(?=[ds])|d(?=[lus])|s(?=[lud])")).cast("double").alias("changes"),
            F.regexp_count(sounds, F.lit("v(?=c)|c(?=v)")).cast("double").alias("turns"),
            F.regexp_count(sounds, F.lit("[vc](?=[vc])")).cast("double").alias("m"),
        )

    def compared(x: Column) -> Column:
        e, n = x["e"], x["n"]
        ways = n * (n - 1)
        spread = F.sqrt(4 * ways * (n - 2) * (e["s3"] - e["s2"] * e["s2"]) + 2 * ways * (e["s2"] - e["s2"] * e["s2"]))
        even = F.sqrt(2 * ways / e["k"] * (1 - 1 / e["k"]))

        def of(share: Column, seen: Column, m: Column) -> Column:
            return (seen - m * share) / F.sqrt(m * share * (1 - share))

        none = F.lit(0.0)
        classes, sounds = e["c0"] > 0, (e["v1"] > 0) & (x["m"] >= 8)
        rejected = (
            ((x["pairs"] - ways / e["k"]) / even > REJECTED)
            | F.when(classes, of(e["c1"], x["changes"], n - 1) < -REJECTED).otherwise(False)
            | F.when(sounds, of(e["v1"], x["turns"], x["m"]) > REJECTED).otherwise(False)
        )
        total = (
            (ways * e["s2"] - x["pairs"]) / spread
            + F.when(classes, of(e["c0"], x["changes"], n - 1)).otherwise(none)
            + F.when(sounds, -of(F.lit(VOWEL_CHANGES), x["turns"], x["m"])).otherwise(none)
        )
        tests = 1 + F.when(classes, 1).otherwise(0) + F.when(sounds, 1).otherwise(0)
        p = F.when(rejected, 1.0).otherwise(S.normal_tail(total / F.sqrt(tests)))
        return F.struct(n.cast("int").alias("n"), F.coalesce(p, F.lit(1.0)).alias("p"))

    return S.staged(token, inferred, counted, compared)


def cut(counts: list[tuple[int, int, int]], alpha: float) -> tuple[float, float]:
    """(length, bin, number) of all candidates -> mean length, and the largest p * mean / length that is reported.

    Benjamini-Hochberg with weights that grow with length, as long strings tell more; their mean over candidates is 1. A bin
    counts with its largest p. A cut of -1 reports nothing.
    """
    m = sum(c for _, _, c in counts)
    if not m:
        return 1.0, -1.0
    mean = sum(n * c for n, _, c in counts) / m
    q = np.array([10 ** (-b / 10) * mean / n for n, b, _ in counts])
    order = np.argsort(q)
    rank = np.cumsum(np.array([c for _, _, c in counts])[order])
    good = np.flatnonzero(q[order] <= alpha * rank / m)
    return mean, float(alpha * rank[good[-1]] / m) if len(good) else -1.0


#: Names of columns that a scan makes.
OWN = {"base_spans", "secret_spans", "_m", "_s", "_t", "_c"}


def candidates(docs: DataFrame) -> DataFrame:
    """Adds base_spans, and _c: the candidates (start, end, n, p) that overlap no base span, to docs. One pass, no shuffle."""
    docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() not in OWN))
    stage = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    stage = stage.withColumn(
        "_m", F.struct(*(S.matches(F.col("_t"), p).alias(k) for k, p in zip(KINDS, [ASSIGN, ACCESS, HEX, TOKEN], strict=True)))
    )
    at = lambda kind, pattern: S.located(F.col("_t"), pattern, F.col(f"_m.{kind}"))
    stage = stage.withColumn(
        "_s",
        F.struct(
            F.filter(at("assign", ASSIGN), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 6).alias("assign"),
            at("access", ACCESS).alias("access"),
            at("hex", HEX).alias("hex"),
            at("random", TOKEN).alias("random"),
        ),
    )
    stage = stage.withColumn("base_spans", S.joined(*(S.labelled(F.col(f"_s.{k}"), i, k) for i, k in enumerate(KINDS[:3]))))
    alone = F.filter("_s.random", lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    described = F.transform(alone, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["m"]).alias("b")))
    flat = F.transform(described, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["b"]["n"].alias("n"), s["b"]["p"].alias("p")))
    return stage.withColumn("_c", flat).drop("_t", "_m", "_s")


def scan(docs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds base_spans and secret_spans, arrays of (start, no, end, kind) by start and kind, to docs.

    base_spans are those of the fixed patterns (assign, access, hex); secret_spans also hold random strings that no base
    span covers. Of those, ``alpha`` at most are expected to be ordinary identifiers, over all rows together: a first pass
    counts candidates by length and p-value (a table of bounded size), a second one reports. Offsets are code points, ends
    exclusive. A null or empty text has none. Columns of these names are replaced; repeated rows are each scanned and
    counted; no rows give no rows. Nothing but the counts is shuffled.
    """
    stage = candidates(docs)
    length = F.least(F.col("c.n"), F.lit(LONGEST))
    place = F.least(F.lit(BINS), F.floor(-10 * F.log10(F.greatest(F.col("c.p"), F.lit(1e-300))))).cast("int")
    counts = stage.select(F.explode("_c").alias("c")).groupBy(length.alias("n"), F.greatest(F.lit(0), place).alias("bin")).count()
    mean, most = cut([(r["n"], r["bin"], r["count"]) for r in counts.collect()], alpha)
    told = F.filter("_c", lambda c: c["p"] * mean / F.least(c["n"], F.lit(LONGEST)) <= most)
    return stage.withColumn("secret_spans", S.joined(F.col("base_spans"), S.labelled(told, 3, KINDS[3]))).drop("_c")


def redact(docs: DataFrame, mask: str = "[SECRET]", alpha: float = 0.05) -> DataFrame:
    """docs with each secret span of text replaced by ``mask`` (overlapping ones by one); n_chars follows if it is there."""
    aside = {c: f"_kept{i}_" for i, c in enumerate(docs.columns) if c.lower() in OWN}
    out = scan(docs.withColumnsRenamed(aside), alpha).withColumn("text", S.masked(F.col("text"), F.col("secret_spans"), mask))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.size("secret_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
