"""Scaffolding: which scaffolds of two genomes belong together, and in which order and strand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import scaffold as kernel
from .graph import connected
from .intervals import majority_per_bin, normalise_reverse, sliding_majority, strand_majority

PARTNERS = "genome string, scaffold string, partner string, first_bin long, last_bin long, bins long, strand int"


def _side(rows: DataFrame, genome: str, size: int) -> DataFrame:
    """Partners of the scaffolds ``a_chr`` by bins: windows pick candidates, the longest runs among their bins stay."""
    bins = majority_per_bin(rows, "a_chr", "b_chr", size, "a_start", "a_end")
    kept = bins.join(sliding_majority(bins, "a_chr", "b_chr"), ["a_chr", "b_chr"], "left_semi")
    kept = kept.join(strand_majority(rows, ["a_chr", "b_chr"]), ["a_chr", "b_chr"])

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        pdf = pdf.loc[kernel.longest_runs(pdf["b_chr"].tolist())]
        out = pdf.groupby(["a_chr", "b_chr"], as_index=False).agg(first_bin=("bin", "min"), last_bin=("bin", "max"), bins=("bin", "size"), strand=("strand", "first"))
        return out.rename(columns={"a_chr": "scaffold", "b_chr": "partner"}).assign(genome=genome)[["genome", "scaffold", "partner", "first_bin", "last_bin", "bins", "strand"]]

    return kept.groupBy("a_chr").applyInPandas(order, PARTNERS)


def partners(aln: DataFrame, size: int = 10_000) -> DataFrame:
    """(genome A or B, scaffold, partner, first_bin, last_bin, bins, strand) of pairs that both genomes choose."""
    low = normalise_reverse(aln)
    b = low.select(F.col("b_chr").alias("a_chr"), F.col("a_chr").alias("b_chr"), F.col("b_low").alias("a_start"), F.col("b_high").alias("a_end"), "b_dir")
    one, two = _side(aln.select("a_chr", "b_chr", "a_start", "a_end", "b_dir"), "A", size), _side(b, "B", size)
    back = lambda d: d.select(F.col("partner").alias("scaffold"), F.col("scaffold").alias("partner"))
    return one.join(back(two), ["scaffold", "partner"], "left_semi").unionByName(two.join(back(one), ["scaffold", "partner"], "left_semi"))


def assembled(pairs: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame, open_ends: bool = False) -> DataFrame:
    """(chr, genome, place, scaffold, strand): scaffolds along each put-together chromosome, named by its least scaffold.

    Scaffolds that partners link are a component, and a component is ordered as a whole; sizes have (chr, size).
    """
    named = F.concat("genome", F.lit(":"), "scaffold")
    other = F.concat(F.when(F.col("genome") == "A", "B:").otherwise("A:"), "partner")
    link = F.when(F.col("genome") == "A", F.concat(named, F.lit("|"), other)).otherwise(F.concat(other, F.lit("|"), named))
    components = connected(pairs.select(named.alias("id"), link.alias("grp")))
    sizes = a_sizes.select(F.lit("A").alias("genome"), F.col("chr").alias("scaffold"), "size").unionByName(b_sizes.select(F.lit("B").alias("genome"), F.col("chr").alias("scaffold"), "size"))
    rows = pairs.withColumn("id", named).join(components, "id").join(sizes, ["genome", "scaffold"], "left")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        sides: tuple[dict, dict] = ({}, {})
        held: tuple[dict, dict] = ({}, {})
        for r in pdf.itertuples(index=False):
            g = 0 if r.genome == "A" else 1
            sides[g].setdefault(r.scaffold, {})[r.partner] = (r.first_bin, r.last_bin, r.bins, r.strand)
            held[g][r.scaffold] = 0 if pd.isna(r.size) else int(r.size)
        kernel.pruned(*sides, open_ends)
        found = kernel.ways(*sides, *held)
        out = [(pdf["component"].iloc[0], "AB"[g], k, name, strand) for g in (0, 1) for k, (name, strand) in enumerate(found[g])]
        return pd.DataFrame(out, columns=["chr", "genome", "place", "scaffold", "strand"])

    return rows.groupBy("component").applyInPandas(order, "chr string, genome string, place int, scaffold string, strand int")
