"""Fits of distributions and composition statistics; what reaches a task or the driver is a histogram."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import NB_FALLBACK
from .intervals import point_join, running


def nb_size(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """Mean and size of a negative binomial distribution of most likelihood for a histogram.

    The mean is the sample's; the size solves sum_j N(>j) / (r + j) = n ln(1 + mean / r). If the variance is not above
    the mean there is no finite size, and ``NB_FALLBACK`` is returned.
    """
    n = counts.sum()
    if not n:
        return NB_FALLBACK
    mean = float((values * counts).sum() / n)
    var = float((counts * (values - mean) ** 2).sum() / n)
    if var <= mean or mean == 0:
        return NB_FALLBACK
    order = np.argsort(values)
    steps = np.arange(int(values.max()))
    above = n - np.concatenate([[0], np.cumsum(counts[order])])[np.searchsorted(values[order], steps, side="right")]

    def score(r: float) -> float:
        return float((above / (r + steps)).sum() - n * math.log1p(mean / r))

    low, high = 1e-9, 1.0
    while score(high) > 0 and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if score(mid) > 0 else (low, mid)
    return mean, (low + high) / 2


def fit_nb(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, n) -> (by..., mu, size); a group is a histogram, as long as it has different values."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in histogram.dtypes if c in by), "mu double", "size double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        mu, size = nb_size(pdf["value"].to_numpy(float), pdf["n"].to_numpy(float))
        return pd.DataFrame([[*key, mu, size]], columns=[*by, "mu", "size"])

    return histogram.groupBy(*by).applyInPandas(run, schema)


def moments(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, n) -> (by..., total, mean, var), the population variance."""
    n, v = F.sum("n"), F.col("value").cast("double")
    sums = histogram.groupBy(*by).agg(n.alias("total"), (F.sum(v * F.col("n")) / n).alias("mean"), (F.sum(v * v * F.col("n")) / n).alias("square"))
    return sums.select(*by, "total", "mean", (F.col("square") - F.col("mean") * F.col("mean")).alias("var"))


def gamma_moments(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, n) -> (by..., shape, rate) by the method of moments; null where all values are equal."""
    m = moments(histogram, by)
    var = F.when(F.col("var") > 0, F.col("var"))
    return m.select(*by, (F.col("mean") * F.col("mean") / var).alias("shape"), (F.col("mean") / var).alias("rate"))


def _digamma(x: float) -> float:
    """Shifted above 10, then the asymptotic series."""
    back = 0.0
    while x < 10:
        back, x = back + 1 / x, x + 1
    return math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) - back


def gamma_shape(mean: float, log_mean: float) -> float:
    """The shape of most likelihood from the mean and the mean logarithm: ln a - digamma(a) = ln(mean) - log_mean."""
    gap, low, high = math.log(mean) - log_mean, 1e-6, 1.0
    while math.log(high) - _digamma(high) > gap and high < 1e9:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.log(mid) - _digamma(mid) > gap else (low, mid)
    return (low + high) / 2


def fit_gamma(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, n) -> (by..., shape, rate) of most likelihood; values over 0 count, null where all of them are equal.

    What reaches a task of a group are three sums."""
    v, n = F.col("value").cast("double"), F.sum("n")
    sums = histogram.where("value > 0").groupBy(*by).agg((F.sum(v * F.col("n")) / n).alias("mean"), (F.sum(F.log(v) * F.col("n")) / n).alias("log_mean"))
    wider = F.log("mean") - F.col("log_mean") > 1e-12

    @F.pandas_udf("double")
    def shape(mean: pd.Series, log_mean: pd.Series) -> pd.Series:
        return pd.Series([gamma_shape(m, x) if m == m else None for m, x in zip(mean, log_mean, strict=True)], dtype=float)

    fitted = sums.withColumn("shape", shape(F.when(wider, F.col("mean")), "log_mean"))
    return fitted.select(*by, F.nanvl("shape", F.lit(None)).alias("shape"), (F.nanvl("shape", F.lit(None)) / F.col("mean")).alias("rate"))


def base_composition(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """(base, share) of A, C, G, T over all sequences, either case; other letters don't count."""
    s = F.translate(seq, "acgt", "ACGT")
    counts = sequences.agg(*(F.sum(F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))).alias(b) for b in "ACGT"))
    rows = counts.unpivot([], list("ACGT"), "base", "n")
    total = counts.select(sum((F.col(b) for b in "CGT"), F.col("A")).alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("base", (F.col("n") / F.col("total")).alias("share"))  # one row


AT_ONCE = 1 << 20  # characters that are counted together


def _words(sequences: DataFrame, seq: str, size: int) -> DataFrame:
    """(pos, word, n): words of one or two letters A, C, G, T by place (from 1), either case, counted; a task counts some of a
    million letters at once, so what is grouped and shuffled are counts and not letters."""
    codes = np.full(129, 4, np.uint8)
    codes[[ord(b) for b in "ACGT"]] = range(4)
    words = [a + b for a in ("ACGT" if size == 2 else [""]) for b in "ACGT"]

    def counts(texts: list[str], first: int) -> pa.RecordBatch:
        """``first`` is the place of the texts' first letters."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if joined.isascii():
            code = codes[np.frombuffer(joined.encode(), np.uint8)]
        else:
            code = codes[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
        at = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(n) - n).astype(np.int32), n)
        if size == 2:
            whole = (code[:-1] < 4) & (code[1:] < 4) & (at[1:] > 0)
            key = (at[:-1] * 16 + code[:-1] * 4 + code[1:])[whole]
        else:
            key = (at * 4 + code)[code < 4]
        if n.max() * len(words) <= 4 * AT_ONCE:
            found = np.bincount(key)
            key = np.flatnonzero(found)
            found = found[key]
        else:
            key, found = np.unique(key, return_counts=True)
        place, word = np.divmod(key, len(words))
        return pa.RecordBatch.from_arrays([pa.array((place + first).astype(np.int32)), pa.array(word.astype(np.int32)), pa.array(found.astype(np.int64))], ["pos", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if len(text) > AT_ONCE:
                    for i in range(0, len(text) - size + 1, AT_ONCE):
                        yield counts([text[i : i + AT_ONCE + size - 1]], i + 1)
                    continue
                if n + len(text) > AT_ONCE:
                    yield counts(held, 1)
                    held, n = [], 0
                held.append(text)
                n += len(text)
        if held:
            yield counts(held, 1)

    rows = sequences.where(F.length(seq) >= size).select(F.upper(seq)).mapInArrow(run, "pos int, word int, n long")
    named = F.element_at(F.array(*map(F.lit, words)), F.col("word") + 1)
    return rows.groupBy("pos", "word").agg(F.sum("n").alias("n")).select("pos", named.alias("word"), "n")


def _pairs(sequences: DataFrame, seq: str) -> DataFrame:
    return _words(sequences, seq, 2).select("pos", F.substring("word", 1, 1).alias("cur"), F.substring("word", 2, 1).alias("nxt"), "n")


def _share(counts: DataFrame, within: list[str], name: str) -> DataFrame:
    totals = counts.groupBy(*within).agg(F.sum("n").alias("_total"))
    return counts.join(totals, within).select(*counts.columns, (F.col("n") / F.col("_total")).alias(name))


def dinucleotide_frequency(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """(pos, cur, nxt, n, share): pairs of neighbours by place (from 1), as shares of the place."""
    return _share(_pairs(sequences, seq), ["pos"], "share")


def dinucleotide_transition(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """(pos, cur, nxt, n, p): the chance of a base given the one before it, by place."""
    return _share(_pairs(sequences, seq), ["pos", "cur"], "p")


def position_composition(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """(pos, base, n, share) of bases by place (from 1)."""
    return _share(_words(sequences, seq, 1).withColumnRenamed("word", "base"), ["pos"], "share")


def eligible(sequences: DataFrame, seq: str = "seq", length: int = 147) -> DataFrame:
    """Sequences of one length that consist of A, C, G and T."""
    return sequences.where((F.length(seq) == length) & ~F.upper(seq).rlike("[^ACGT]"))


def sampled(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that depends on key and seed only."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


HASH_BITS = 60


def _hashed(key: Column | str, seed: int) -> Column:
    """A whole number below 2^60 by key and seed: the first 15 hex digits of the MD5 of ``key:seed``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(seed).cast("string"))), 1, 15), 16, 10).cast("long")


def drawn(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Adds ``draws``: how often a row is drawn in n draws with replacement, which sum to n; rows never drawn go.

    Draw i takes the row whose place in the order of hashed keys is the hash of i modulo the number of rows, so the counts
    depend on keys and seed only. ``key`` is distinct and not null. Hashes are even, so the order is found in 4096 bins of
    one size. An empty table gives no rows.
    """
    rows = df.withColumns({"_h": _hashed(key, seed), "_whole": F.lit(0)})
    rows = running(rows, F.lit(1).cast("long"), "sum", "_place", ["_h", key], key="_whole", at="_h", width=1 << HASH_BITS - 12)
    total = df.agg(F.count("*").alias("_n"))  # one row
    draws = df.sparkSession.range(n).join(F.broadcast(total)).where("_n > 0")
    places = draws.groupBy((_hashed("id", seed) % F.col("_n") + 1).alias("_place")).agg(F.count("*").alias("draws"))
    return rows.join(places, "_place").select(*df.columns, "draws")


def random_segments(sizes: DataFrame, n: int, length: int, seed: int) -> DataFrame:
    """(draw, chr, start, end): n stretches of ``length`` bases, each place that holds one being equally likely.

    sizes: (chr, size), a row for each chromosome. Draw i falls on its hash modulo the number of places, chromosomes in order
    of name. Chromosomes shorter than ``length`` have no place.
    """
    earlier = Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)  # a row for each chromosome
    room = sizes.where(F.col("size") >= length).select("chr", (F.col("size") - length + 1).cast("long").alias("_room"))
    room = room.withColumn("_from", F.coalesce(F.sum("_room").over(earlier), F.lit(0)))
    lines = room.select("chr", "_from", (F.col("_from") + F.col("_room") - 1).alias("_to"), F.lit(0).alias("_whole"))
    total = room.agg(F.sum("_room").alias("_n"))  # one row
    draws = sizes.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total)).where("_n > 0")
    draws = draws.select("draw", (_hashed("draw", seed) % F.col("_n")).alias("_at"), F.lit(0).alias("_whole"))
    met = point_join(draws, lines, pos="_at", ends=("_from", "_to"), key="_whole", width=1 << 20)
    start = F.col("_at") - F.col("_from") + 1
    return met.select("draw", "chr", start.alias("start"), (start + length - 1).alias("end"))
