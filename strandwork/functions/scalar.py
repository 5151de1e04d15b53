"""Column functions: bases, fragments, strands, shifts, cleaning, attributes, distributions."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def base_codes(seq: Column) -> Column:
    """A sequence's bases as an array of tinyints: A 0, C 1, G 2, T 3 (either case), others 4."""
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "4"), BASES, "0123")
    return F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("tinyint"))


def reverse_complement(pwm: Column) -> Column:
    """An array of (a, c, g, t, n) columns, backwards and with A and T, C and G exchanged; n becomes 0."""
    return F.transform(
        F.reverse(pwm),
        lambda x: F.struct(x["t"].alias("a"), x["g"].alias("c"), x["c"].alias("g"), x["a"].alias("t"), F.lit(0.0).alias("n")),
    )


def fragment_start(ref_start: Column, offset: int = 0) -> Column:
    """First base (1-based) of a fragment from a 0-based aligned start."""
    return ref_start + 1 + offset


def fragment_end(ref_start: Column, tlen: Column, offset: int = 0) -> Column:
    return ref_start + tlen - offset


def fragment_midpoint(ref_start: Column, tlen: Column, offset: int = 0) -> Column:
    """The middle base (1-based), rounded down."""
    return F.floor((fragment_start(ref_start, offset) + fragment_end(ref_start, tlen, offset)) / 2).cast("long")


def valid_fragment(tlen: Column, low: int, high: int, offset: int = 0, strict: bool = False) -> Column:
    """Leftmost mates (tlen over 0) whose width lies in [low, high]; strict also wants bases left after both offsets."""
    left = (tlen > 0) & (tlen - 2 * offset > 0) if strict else (tlen != 0) & (tlen - 2 * offset >= 0)
    width = F.abs(tlen - 2 * offset) if strict else F.abs(tlen)
    return left & width.between(low, high)


def fragment_class(tlen: Column, long: tuple[int, int], short: tuple[int, int]) -> Column:
    return F.when(F.abs(tlen).between(*long), "long").when(F.abs(tlen).between(*short), "short")


def sign(n: Column) -> Column:
    """-1 below zero, else 1."""
    return F.when(n < 0, -1).otherwise(1)


def one_direction(shifts: Column, threshold: int) -> Column:
    """Whether all shifts of an array that exceed the threshold have one sign."""
    return F.size(F.array_distinct(F.transform(F.filter(shifts, lambda s: F.abs(s) > threshold), sign))) <= 1


def motif_family(name: Column) -> Column:
    return F.upper(F.split_part(name, F.lit("_"), F.lit(1)))


def forward_orf(orf: Column) -> Column:
    """Whether a systematic name tells the forward strand: W before a hyphen or the end."""
    return F.right(F.split_part(orf, F.lit("-"), F.lit(1)), F.lit(1)) == "W"


def clean_probability(p: Column) -> Column:
    """NaN, infinities and nulls become 0, values over 1 become 1."""
    p = F.coalesce(p, F.lit(0.0))
    return F.when(F.isnan(p) | (F.abs(p) == float("inf")), 0.0).otherwise(F.least(p, F.lit(1.0)))


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The value of ``key "value";`` in a GTF attribute column, or null."""
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{key}\s+"?([^";]*)"?', 1)
    return F.when(found != "", found)


def members(joined: Column) -> Column:
    """The parts of a comma-joined list, one a row."""
    return F.explode(F.split(joined, ","))


def sample_suffix(index: int) -> str:
    """A to Z, then AA, AB and so on."""
    more, last = divmod(index, 26)
    return (sample_suffix(more - 1) if more else "") + chr(ord("A") + last)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0 by built-in functions (shifted by eight, then Stirling's series; error < 1e-12)."""
    y = x + 8.0
    back = reduce(lambda a, b: a + b, [F.log(x + float(i)) for i in range(8)])
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def nb_pmf(count: Column, mu: Column, phi: Column) -> Column:
    """Probability of a count under a negative binomial distribution with mean mu and size phi."""
    log_p = log_gamma(count + phi) - log_gamma(phi) - log_gamma(count + 1.0)
    return F.exp(log_p + phi * F.log(phi / (phi + mu)) + count * F.log(mu / (phi + mu)))


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-((x - mean) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def gamma_pdf(x: Column, shape: Column, rate: Column) -> Column:
    return F.exp(shape * F.log(rate) + (shape - 1) * F.log(x) - rate * x - log_gamma(shape))


# Coefficients of an exponent that gives the complementary error function with a relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal variable by built-in functions; null for null."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    return t * F.exp(-x * x + reduce(lambda acc, c: acc * t + c, ERFC[::-1][1:], F.lit(ERFC[-1])))


def t_quantile(df: Column, p: float) -> Column:
    """The p-quantile of Student's t by degrees of freedom: closed for 1 and 2, else a series around the normal quantile
    (relative error below 0.2 %); null below 1."""
    z = NormalDist().inv_cdf(p)
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    series = reduce(lambda a, b: a + b, (F.lit(x) / F.pow(df, F.lit(i + 1)) for i, x in enumerate(terms)), F.lit(z))
    two = (2 * p - 1) / math.sqrt(2 * p * (1 - p))
    return F.when(df == 1, math.tan(math.pi * (p - 0.5))).when(df == 2, two).when(df > 2, series)


def unbound_root(conc: dict[str, float], length: dict[str, int]) -> float:
    """The p in (0, 1) with sum(conc * p ** length) = 1; the sum grows with p, so bisection finds it."""
    low, high = 0.0, 1.0
    if sum(conc.values()) < 1:
        raise ValueError("concentrations sum to less than one: no root below 1")
    for _ in range(200):
        mid = (low + high) / 2
        if sum(c * mid ** length[k] for k, c in conc.items()) < 1:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def to_probabilities(conc: dict[str, float], length: dict[str, int]) -> dict[str, float]:
    p = unbound_root(conc, length)
    return {k: c * p ** length[k] for k, c in conc.items()}


def to_concentrations(prob: dict[str, float], length: dict[str, int], background: str = "background") -> dict[str, float]:
    return {k: p / prob[background] ** length[k] for k, p in prob.items()}
