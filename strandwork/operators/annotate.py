"""Nucleosomes and binding sites set against genes.

Genes have the columns of ``constants.GENES``: plus1 and minus1 are the dyads of their first nucleosomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DOWNSTREAM_REACH, HALF_NUCLEOSOME, PLUS_MINUS_REACH, PROMOTER_REACH, SITE_MIN_SCORE
from ..functions.scalar import forward_orf, gtf_attribute, sample_suffix
from ..storage import materialize
from .intervals import coverage, first_match, names_at, nearest_below, other_than, overlap_join

ENDS = ("tss", "tts", "orf_start", "orf_end")


def _clip(genes: DataFrame, start: Column, end: Column, raise_start: Column, names: tuple[str, str]) -> DataFrame:
    """Adds names: [start, end] cut back to what other genes leave free.

    Where ``raise_start`` holds, the start is raised to the greatest base of any other gene that lies whole below the
    end; else the end is lowered to the smallest base of any other gene that lies whole above the start. That is the
    nearest one, so genes are looked up in order of place, however many lie within the stretch.
    """
    up, at = F.col("_up"), F.when(F.col("_up"), F.col("_e")).otherwise(-F.col("_s"))  # ends below which genes are looked for, starts mirrored
    rows = genes.withColumns({"_s": start.cast("long"), "_e": end.cast("long"), "_up": raise_start}).withColumns({"at": at, "_side": F.struct("_up", "chr")})
    some = genes.where("chr is not null")
    tops = some.select(F.struct(F.lit(True).alias("_up"), "chr").alias("_side"), "orf", F.greatest(*ENDS).cast("long").alias("pos"))
    feet = some.select(F.struct(F.lit(False).alias("_up"), "chr").alias("_side"), "orf", (-F.least(*ENDS)).cast("long").alias("pos"))
    sides = nearest_below(rows.where("chr is not null").select("_side", "at"), tops.unionByName(feet), "orf", "_near", key="_side")
    near = other_than(F.col("orf"), F.col("_near"))
    cut = {names[0]: F.when(up, F.greatest("_s", near)).otherwise(F.col("_s")), names[1]: F.when(up, F.col("_e")).otherwise(F.least("_e", -near))}
    return rows.join(sides, ["_side", "at"], "left").select(*genes.columns, *(c.alias(k) for k, c in cut.items()))


def promoters(genes: DataFrame, reach: int = PROMOTER_REACH) -> DataFrame:
    """Adds promoter_start and promoter_end: up to ``reach`` bases before the start of transcription, up to the next gene."""
    plus = F.col("strand") == 1
    start = F.when(plus, F.greatest(F.lit(1), F.col("tss") - reach)).otherwise(F.col("tss") + 1)
    end = F.when(plus, F.col("tss") - 1).otherwise(F.col("tss") + reach)
    return _clip(genes, start, end, plus, ("promoter_start", "promoter_end"))


def downstreams(genes: DataFrame, reach: int = DOWNSTREAM_REACH, strict_compat: bool = False) -> DataFrame:
    """Adds downstream_start and downstream_end: up to ``reach`` bases behind the end of transcription.

    Cut at the next gene behind it; ``strict_compat`` cuts as for promoters instead, from the gene's own side.
    """
    plus = F.col("strand") == 1
    start = F.when(plus, F.col("tts") + 1).otherwise(F.greatest(F.lit(1), F.col("tts") - reach))
    end = F.when(plus, F.col("tts") + reach).otherwise(F.col("tts") - 1)
    return _clip(genes, start, end, plus if strict_compat else ~plus, ("downstream_start", "downstream_end"))


def annotate(nucs: DataFrame, genes: DataFrame, dyads: list[str], row_id: str = "name", reach: int = PLUS_MINUS_REACH, order: str = "row") -> DataFrame:
    """Adds plus1, minus1, promoter, orf and downstream: the genes that a linked nucleosome belongs to, or null.

    plus1 and minus1: the first gene (by ``order``) whose first nucleosome lies within ``reach`` of a dyad. The others:
    all genes whose stretch holds a dyad, and only for rows that no earlier of plus1/minus1, promoter, orf took.
    """
    nucs, found = materialize(nucs, "nucleosomes"), []
    for kind in ("plus1", "minus1"):
        marks = genes.where(F.col(kind).isNotNull()).select("chr", F.col(kind).alias("_pos"), order, F.col("orf").alias("_orf"))
        found.append(first_match(nucs, dyads, marks, "_pos", order, row_id, reach, "_orf", kind))
    body = genes.withColumn("body_start", F.least(*ENDS)).withColumn("body_end", F.greatest(*ENDS))
    stretches = (
        ("promoter", promoters(genes), ("promoter_start", "promoter_end")),
        ("orf", body, ("body_start", "body_end")),
        ("downstream", downstreams(genes), ("downstream_start", "downstream_end")),
    )
    for one in found:
        nucs = nucs.join(one, row_id, "left")
    taken = F.col("plus1").isNotNull() | F.col("minus1").isNotNull()
    nucs = materialize(nucs, "nucleosomes")
    rest = nucs.where(~taken)
    for name, spans, ends in stretches:
        nucs = nucs.join(names_at(rest, dyads, spans, ends, "orf", row_id, name), row_id, "left")
    kept = {}
    for name, _, _ in stretches:
        kept[name] = F.when(~taken, F.col(name))
        taken = taken | F.col(name).isNotNull()
    return nucs.withColumns(kept)


def location() -> Column:
    """The class of an annotated nucleosome; of several that hold, the last one counts."""
    return (
        F.when(F.col("downstream").isNotNull(), "Downstream_nuc")
        .when(F.col("orf").isNotNull(), "ORF_transcript_nuc")
        .when(F.col("promoter").isNotNull(), "Promoter_nuc")
        .when(F.col("plus1").isNotNull() & F.col("minus1").isNotNull(), "+1_-1_nuc_both")
        .when(F.col("plus1").isNotNull(), "+1_nuc_only")
        .when(F.col("minus1").isNotNull(), "-1_nuc_only")
        .otherwise("Intergenic_nuc")
    )


def cross_tab(df: DataFrame, rows: str, columns: list[str]) -> DataFrame:
    """(columns..., rows, n, percent): counts and shares of ``rows`` within each combination of ``columns``."""
    n = df.groupBy(*columns, rows).agg(F.count("*").alias("n"))
    total = n.groupBy(*columns).agg(F.sum("n").alias("_t"))
    return n.join(total, columns).select(*columns, rows, "n", (100 * F.col("n") / F.col("_t")).alias("percent"))


def promoter_sites(sites: DataFrame, genes: DataFrame, scores: list[str], row_id: str, order: str = "row", minimum: float = SITE_MIN_SCORE) -> DataFrame:
    """Adds ``gene``: the comma-joined genes, in ``order``, whose promoter (from the nucleosome -1 to +1) a site overlaps.

    Sites whose scores all exceed ``minimum`` in every sample are left out.
    """
    half, plus = HALF_NUCLEOSOME, F.col("strand") == 1
    start = F.when(plus, F.col("minus1")).otherwise(F.col("plus1")) - half
    end = F.when(plus, F.col("plus1")).otherwise(F.col("minus1")) + half
    changing = sites.where(~F.forall(F.array(*scores), lambda s: F.coalesce(s, F.lit(0.0)) > minimum))
    spans = genes.select("chr", F.col(order).alias("_o"), F.col("orf").alias("_orf"), start.alias("r_start"), end.alias("r_end"))
    met = overlap_join(changing.select(row_id, "chr", "start", "end"), spans)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_orf"))), lambda x: x["_orf"]), ",")
    return changing.join(met.groupBy(row_id).agg(joined.alias("gene")), row_id, "left")


def genome_composition(sizes: DataFrame, spans: dict[str, DataFrame]) -> DataFrame:
    """(cls, bases): how many bases fall into each class; the first class of ``spans`` that holds a base has it.

    spans: class -> (chr, start, end). What none holds is ``other``.
    """
    whole = sizes.select("chr", F.lit(1).cast("long").alias("start"), F.col("size").alias("end"))
    total = sizes.agg(F.sum("size").alias("bases"))
    done, rows = None, None
    for name, df in spans.items():
        mine = df.select("chr", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
        done = mine if done is None else done.unionByName(mine)
        inside = overlap_join(coverage(done), whole.withColumnsRenamed({"start": "r_start", "end": "r_end"}))
        size = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
        one = inside.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bases")).select(F.lit(name).alias("cls"), "bases")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.unionByName(total.select(F.lit("other").alias("cls"), "bases"))
    # Each row counts what it and all classes before it hold, so a class has its difference to the one before.
    order = F.element_at(F.create_map(*[x for i, n in enumerate([*spans, "other"]) for x in (F.lit(n), F.lit(i))]), F.col("cls"))
    ranked = rows.withColumn("_i", order)
    before = ranked.select((F.col("_i") + 1).alias("_i"), F.col("bases").alias("_b"))
    return ranked.join(F.broadcast(before), "_i", "left").select("cls", (F.col("bases") - F.coalesce("_b", F.lit(0))).alias("bases"))


def gene_features(nucs: DataFrame, n: int, order: str) -> DataFrame:
    """(gene, p1_shift_XY, m1_shift_XY, p1_pdyadX, m1_pdyadX, orf_pdyadX) from annotated linked nucleosomes.

    +1 and -1 values are those of the first nucleosome (by ``order``) of the gene, shifts along its strand; ORF values are
    means with 0 for missing ones. Genes without any nucleosome have no row.
    """
    shift = [f"shift_{sample_suffix(i)}{sample_suffix(i + 1)}" for i in range(n - 1)]
    pdyad = [f"pdyad{sample_suffix(i)}" for i in range(n)]
    along = F.when(forward_orf(F.col("gene")), 1).otherwise(-1)

    def first(kind: str, short: str) -> DataFrame:
        rows = nucs.where(F.col(kind).isNotNull()).select(F.explode(F.split(kind, ",")).alias("gene"), F.struct(order, *shift, *pdyad).alias("x"))
        best = rows.groupBy("gene").agg(F.min_by("x", F.col(f"x.{order}")).alias("x"))
        return best.select("gene", *((F.col(f"x.{s}") * along).alias(f"{short}_{s}") for s in shift), *(F.col(f"x.{p}").alias(f"{short}_{p}") for p in pdyad))

    orf = nucs.where(F.col("orf").isNotNull()).select(F.explode(F.split("orf", ",")).alias("gene"), *pdyad)
    orf = orf.groupBy("gene").agg(*(F.avg(F.coalesce(p, F.lit(0.0))).alias(f"orf_{p}") for p in pdyad))
    return first("plus1", "p1").join(first("minus1", "m1"), "gene", "full").join(orf, "gene", "full")


def gene_extents(gtf: DataFrame) -> DataFrame:
    """GTF rows -> (chr, gene, strand, start, end): names by gene_name, else gene_id, and the least and greatest base."""
    gene = F.coalesce(gtf_attribute(F.col("attributes"), "gene_name"), gtf_attribute(F.col("attributes"), "gene_id"))
    chrom = F.when(F.col("seqname").startswith("chr"), F.col("seqname")).otherwise(F.concat(F.lit("chr"), F.col("seqname")))
    rows = gtf.select(chrom.alias("chr"), gene.alias("gene"), "strand", "start", "end").where("gene is not null")
    return rows.groupBy("chr", "gene", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))

