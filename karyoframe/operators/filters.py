"""Predicates and checks over alignments, regions and variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import best_partner, covered_length

#: Labels of variants with a sequence of their own.
SEQUENCED = ("SNP", "INS", "DEL", "HDR")


def with_forward_partner(aln: DataFrame) -> DataFrame:
    """Alignments of chromosomes, on either side, that have a forward alignment to their own partner of the same name."""
    good = aln.where("a_chr = b_chr and b_dir = 1").select("a_chr").distinct()
    bad = aln.select("a_chr").distinct().join(good, "a_chr", "left_anti")
    return aln.join(bad, "a_chr", "left_anti").join(bad.select(F.col("a_chr").alias("b_chr")), "b_chr", "left_anti").select(*aln.columns)


def in_both_genomes(aln: DataFrame) -> DataFrame:
    """Alignments whose chromosomes are named in both genomes."""
    both = aln.select("a_chr").distinct().join(aln.select(F.col("b_chr").alias("a_chr")).distinct(), "a_chr")
    return aln.join(both, "a_chr", "left_semi").join(both.select(F.col("a_chr").alias("b_chr")), "b_chr", "left_semi").select(*aln.columns)


def mostly_inverted(aln: DataFrame) -> DataFrame:
    """(a_chr, forward, reverse) of chromosomes whose merged reverse alignments to their partner are longer than the forward ones."""
    cover = covered_length(aln.where("a_chr = b_chr"), ["a_chr", "b_dir"], "a_start", "a_end")
    of = lambda d: F.coalesce(F.sum(F.when(F.col("b_dir") == d, F.col("covered"))), F.lit(0))
    return cover.groupBy("a_chr").agg(of(1).alias("forward"), of(-1).alias("reverse")).where("reverse > forward")


def top_coordinates(aln: DataFrame) -> DataFrame:
    """(genome, chr, top): the greatest coordinate that alignments have on each chromosome."""
    side = lambda g, s: aln.groupBy(F.lit(g).alias("genome"), F.col(f"{s}_chr").alias("chr")).agg(F.max(F.greatest(f"{s}_start", f"{s}_end")).alias("top"))
    return side("A", "a").unionByName(side("B", "b"))


def genome_errors(aln: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame) -> DataFrame:
    """(genome, chr, top, size) of chromosomes that a genome lacks (size is null) or that end before an alignment does; sizes have (chr, size)."""
    sizes = a_sizes.select(F.lit("A").alias("genome"), "chr", "size").unionByName(b_sizes.select(F.lit("B").alias("genome"), "chr", "size"))
    return top_coordinates(aln).join(sizes, ["genome", "chr"], "left").where("size is null or top > size")


def check_genomes(aln: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame) -> None:
    """Raises for the first ten errors of genome_errors()."""
    wrong = genome_errors(aln, a_sizes, b_sizes).orderBy("genome", "chr").limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"chromosome {r.chr} of genome {r.genome} " + ("is not in its sequences" if r["size"] is None else f"has {r['size']} bases, but an alignment ends at {r.top}") for r in wrong))


def check_arguments(inv_gap: float = 1e9, td_gap: float = 500_000, td_overlap: float = 0.8, unique_bases: int = 1000, unique_share: float = 0.5) -> None:
    """Raises unless gaps and bases are positive and shares lie between 0 and 1."""
    if inv_gap <= 0 or td_gap <= 0 or unique_bases < 0:
        raise ValueError("gap lengths must be positive and unique bases not negative")
    if not 0 <= td_overlap <= 1 or not 0 <= unique_share <= 1:
        raise ValueError("shares of overlap and of unique bases must lie between 0 and 1")


def chromosome_map(aln: DataFrame) -> DataFrame | None:
    """(a_chr, b_chr) where the genomes name their chromosomes differently, else None.

    Each reference chromosome gets the query chromosome that covers most of it. Different numbers of chromosomes, or one
    query chromosome that is best for two, raise ValueError.
    """
    a, b = ({r[0] for r in aln.select(c).distinct().collect()} for c in ("a_chr", "b_chr"))  # names of chromosomes only
    if a == b:
        return None
    if len(a) != len(b):
        raise ValueError("the genomes have different numbers of chromosomes")
    best = best_partner(aln).select("a_chr", "b_chr")
    twice = best.groupBy("b_chr").count().where("count > 1").orderBy("b_chr").first()
    if twice:
        raise ValueError(f"{twice.b_chr} is the best match of more than one reference chromosome")
    return best


def renamed(rows: DataFrame, names: DataFrame, column: str = "b_chr", back: bool = False) -> DataFrame:
    """``rows`` with query chromosomes named as their reference partners, all at once; with ``back`` the other way round. Other names stay."""
    old, new = ("a_chr", "b_chr") if back else ("b_chr", "a_chr")
    told = F.broadcast(names.select(F.col(old).alias("_old"), F.col(new).alias("_new")))  # a row for each chromosome
    return rows.join(told, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def region(rows: DataFrame, chr_: str, start: int, end: int, side: str = "a") -> DataFrame:
    """Rows that touch a region on one of the genomes."""
    return rows.where((F.col(f"{side}_chr") == chr_) & (F.least(f"{side}_start", f"{side}_end") <= end) & (F.greatest(f"{side}_start", f"{side}_end") >= start))


def bed(rows: DataFrame, margin: int = 0, side: str = "a", keep: list[str] | None = None) -> DataFrame:
    """(chr, start, end) from one less than the first coordinate and the last, with a margin; never below 0."""
    start = F.greatest(F.lit(0).cast("long"), F.col(f"{side}_start") - 1 - margin)
    return rows.select(F.col(f"{side}_chr").alias("chr"), start.alias("start"), (F.col(f"{side}_end") - 1 + margin).alias("end"), *(keep or []))


def short_variants(vcf: DataFrame, symbolic: tuple[str, ...]) -> DataFrame:
    """Variants whose first allele is none of the header's ``symbolic`` ones but SNP, INS and DEL."""
    out = [f"<{s}>" for s in symbolic if s not in ("SNP", "INS", "DEL")]
    return vcf.where(~F.col("alts")[0].isin(*out)) if out else vcf


def capped_sequences(rows: DataFrame, most: int = -1, diverged: bool = True) -> DataFrame:
    """a_seq and b_seq are blanked where a variant is longer than ``most`` (-1: never), and of diverged regions where ``diverged`` is false."""
    kind = F.col("kind")
    blank: Column = F.lit(False) if diverged else kind == "HDR"
    if most != -1:
        blank = blank | (kind.isin("HDR", "DEL") & (F.col("a_end") - F.col("a_start") > most)) | (kind.isin("HDR", "INS") & (F.col("b_end") - F.col("b_start") > most))
    return rows.withColumn("a_seq", F.when(~blank, F.col("a_seq"))).withColumn("b_seq", F.when(~blank, F.col("b_seq")))
