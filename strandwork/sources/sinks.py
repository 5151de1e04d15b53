"""Writers: sparse signals and posteriors, calls, tables as TSV, intervals as BED."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import POSTERIOR_CUT
from ..operators.hmm import HEAD, MIDDLE, Model
from .bam import BamSource


def sparse(df: DataFrame, path: str, value: str = "n") -> None:
    """Rows whose value isn't 0, by chromosome."""
    df.where(F.col(value) != 0).write.mode("overwrite").partitionBy("chr").parquet(path)


def posterior(df: DataFrame, path: str, cut: float = POSTERIOR_CUT) -> None:
    """Replaces the chromosomes that df has, and no others."""
    rows = df.where(F.col("prob") >= cut)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chr").parquet(path)


def site_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("tf", "chr").parquet(path)


def tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; arrays become comma-joined lists."""
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def binding(occupancy: DataFrame, path: str) -> None:
    """Occupancy by factor (segment_id, pos, a column for each factor) as TSV, six significant digits, missing ones 0.

    A range of segments, in order of place, is a file: a reader of one segment meets its rows together.
    """
    keys = ["segment_id", "pos"]
    digits = lambda c: F.format_string("%.5e", F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))).cast("double").alias(c)
    rows = occupancy.select(*keys, *(digits(c) for c in occupancy.columns if c not in keys))
    tsv(rows.repartitionByRange("segment_id", "pos").sortWithinPartitions(*keys), path)


def calls(root: str, tables: dict[str, DataFrame]) -> None:
    """Tables of calls and scores by name, each a folder under ``root``, in order of place; one that is there is replaced,
    others stay."""
    for name, df in tables.items():
        keys = ["chr", "pos" if "pos" in df.columns else "dyad" if "dyad" in df.columns else "start"]
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{root}/{name}")


def bed(df: DataFrame, path: str) -> None:
    rest = [c for c in df.columns if c not in ("chr", "start", "end")]
    df.select("chr", "start", "end", *rest).write.mode("overwrite").option("sep", "\t").csv(path)


def bam(df: DataFrame, path: str, sizes: dict[str, int]) -> None:
    """Fragments (chr, ref_start, tlen) as a folder of BAM files in order of place, each with its index; a file for each
    range of places, so the number of files follows the size. ``sizes`` are the chromosomes' lengths."""
    df.sparkSession.dataSource.register(BamSource)
    rows = df.select("chr", F.col("ref_start").cast("int").alias("ref_start"), F.col("tlen").cast("int").alias("tlen"))
    rows = rows.repartitionByRange("chr", "ref_start").sortWithinPartitions("chr", "ref_start")
    rows.write.format(BamSource.name()).mode("append").options(path=path, sizes=json.dumps(sorted(sizes.items()))).save()


def dinucleotides(spark: SparkSession, model: Model, path: str) -> None:
    """The steps of the model's nucleosome as text: states from 1, a line of ``from to prob`` for each step; a few thousand lines."""
    # The format's comments, and the state that each stands before.
    comments = [(1, "# nucleosome dinucleotide model"), (1, "# from to transition_prob"), (HEAD, "# 1 branched background state"), (HEAD + 4 * MIDDLE + 1, "# 10 normal background states")]
    lines = []
    for a, b, p in model.edges():
        while comments and a >= comments[0][0]:
            lines.append(comments.pop(0)[1])
        lines.append(f"{a} {b} {p!r}")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
