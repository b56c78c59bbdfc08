"""From alignments of two genomes to rearrangements, variants and the main table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar_ops
from ..operators import rearrangements as re_
from ..operators.chain import syntenic_chain
from ..operators.filters import capped_sequences, check_genomes, chromosome_map, in_both_genomes, renamed, with_forward_partner
from ..operators.graph import checkpointed
from ..operators.intervals import extents, not_aligned, quality_filter
from ..operators.joins import variants_in_blocks
from ..operators.rearrangements import COORDS, Settings
from ..operators.variants import anchored, cigar_variants, classify_gaps, named_blocks, numbered, summary, with_sequences
from ..sinks import main_table, write_names, write_summary, write_table, write_vcf


def prepared(table: DataFrame, filtered: bool = True, match: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Alignments as the operators take them, and the map of chromosome names if the query's were renamed.

    ``table`` has the columns of a reader. Alignments are numbered in the order of their coordinates.
    """
    aln = table.select("a_chr", "b_chr", *COORDS, F.col("b_dir").cast("int").alias("b_dir"), F.bround(F.col("iden") * 100, 0).cast("long").alias("iden100"), F.col("a_len").alias("ln"), "b_len", "cigar")
    if filtered:
        aln = quality_filter(aln)
    names = None
    if match:
        names = chromosome_map(aln)
        if names is not None:
            names = checkpointed(names)
            aln = renamed(aln, names)
    else:
        aln = in_both_genomes(aln)
    aln = with_forward_partner(aln)
    return checkpointed(numbered(aln, ["a_chr", "a_start", "a_end", "b_chr", "b_start", "b_end"], "aln_id")), names


@dataclass
class Rearranged:
    """Blocks (block, class, copies, coordinates; B descends where b_dir is -1) and their alignments (block, aln_id, ...)."""

    blocks: DataFrame
    alignments: DataFrame


def rearranged(aln: DataFrame, s: Settings = Settings()) -> Rearranged:
    """Synteny, inversions, translocations and duplications within and between chromosomes."""
    chain = checkpointed(syntenic_chain(aln))
    inv = checkpointed(re_.inversions(aln, chain, s))
    held = checkpointed(re_.in_place(aln, chain, inv))
    used = held.where("aln_id >= 0").select("aln_id").unionByName(inv.select("aln_id"))
    out = aln.where("a_chr = b_chr").join(used, "aln_id", "left_anti")
    blocks, members = re_.candidate_blocks(out, held, s)
    chosen = checkpointed(re_.solved(blocks, held, s).join(blocks, "block"))

    between = aln.where("a_chr <> b_chr")
    blockers = held.select("aln_id", "a_chr", "b_chr", *COORDS, "b_dir").unionByName(chosen.select(F.col("block").alias("aln_id"), "a_chr", "b_chr", *COORDS, "b_dir"))
    ctx, ctx_members = re_.candidate_blocks(between, blockers, s)
    ctx_chosen = checkpointed(re_.solved(ctx, blockers, s).join(ctx, "block"))

    own = lambda c, m: c.select("block", "class", "copies").join(m, "block")
    moved = own(chosen, members).unionByName(own(ctx_chosen, ctx_members)).select(F.concat(F.lit("t"), "block").alias("block"), "class", "copies", "aln_id")
    turned = inv.select(F.concat(F.lit("i"), "inv").alias("block"), F.lit("inv").alias("class"), F.lit(None).cast("string").alias("copies"), "aln_id")
    syn = held.where("aln_id >= 0")
    events = chosen.unionByName(ctx_chosen).select("a_chr", "b_chr", *COORDS, "class").unionByName(re_.inversion_blocks(aln, inv).select("a_chr", "b_chr", *COORDS, F.lit("inv").alias("class")))
    runs = re_.synteny_blocks(syn, events, s)
    synteny = runs.select(F.concat_ws(":", F.lit("s"), "a_chr", "a_run", "b_run").alias("block"), F.lit("syn").alias("class"), F.lit(None).cast("string").alias("copies"), "aln_id")
    rows = checkpointed(synteny.unionByName(turned).unionByName(moved).join(aln, "aln_id"))
    found = extents(rows, ["block", "class", "copies", "a_chr", "b_chr"])
    return Rearranged(checkpointed(found), rows)


def compared(
    found: Rearranged, a_genome: DataFrame, b_genome: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame,
    offset: int = 5, hdrseq: bool = False, most: int = -1, names: DataFrame | None = None,
    sv: bool = True, short: bool = True, snps: DataFrame | None = None, copies: bool = True, copied: Column | None = None,
) -> DataFrame:
    """The rows of the main table: rearrangements, structural and short variants, and what is not aligned.

    Genomes are chunks (see read_fasta_chunks()) under the names of ``found``, sizes have (chr, size). Short variants come
    from CIGARs, or from ``snps`` (see read_snps()) where they are given; without ``copies`` those of alignments that are
    ``copied`` are left out.
    """
    rows = named_blocks(found.blocks, found.alignments)
    events = checkpointed(rows.where("parent IS NULL"))
    strand = found.alignments.select("block", "b_dir").distinct()
    of = events.select("block", F.col("id").alias("parent"), "a_chr", "b_chr").join(strand, "block")
    last, kinds = 0, []
    if sv:
        gaps = classify_gaps(found.alignments, "block", ["a_start", "a_end", "b_start", "b_end", "aln_id"], offset)
        held = gaps.select("block", "kind", *[F.col(f"sv_{c}").alias(c) for c in COORDS]).join(of, "block")
        held = checkpointed(numbered(held, ["a_chr", *COORDS, "kind", "parent"], "n"))
        big = held.where("kind IN ('INS', 'DEL', 'HDR', 'SNP')")
        big = anchored(with_sequences(big, a_genome, b_genome, "n"), a_genome)
        held = big.unionByName(held.join(big.select("n"), "n", "left_anti"), allowMissingColumns=True)
        last = held.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        kinds.append(capped_sequences(held, most, hdrseq))
    if short:
        chosen = found.alignments if copies or copied is None else found.alignments.where(~copied)
        if snps is None:
            base = chosen.where("cigar IS NOT NULL").select("block", "aln_id", "a_chr", "b_chr", "a_start", "b_start", "b_dir", cigar_ops(F.col("cigar")).alias("ops"))
            bases = cigar_variants(base, a_genome, b_genome).join(base.select("aln_id", "block").distinct(), "aln_id")
        else:
            bases = variants_in_blocks(snps, chosen, "block")
        one = bases.where("a_base <> '.' AND b_base <> '.'").select("block", F.lit("SNP").alias("kind"), F.col("a_pos").alias("a_start"), F.col("a_pos").alias("a_end"), F.col("b_pos").alias("b_start"), F.col("b_pos").alias("b_end"), F.col("a_base").alias("a_seq"), F.col("b_base").alias("b_seq"))
        small = one.unionByName(short_indels(bases)).distinct().join(of, "block")
        small = checkpointed(numbered(small, ["a_chr", *COORDS, "kind", "parent"], "n", last + 1))
        kinds.append(capped_sequences(anchored(small, a_genome), most))
    none = events.withColumns({"a_seq": F.lit(None).cast("string"), "b_seq": F.lit(None).cast("string"), "n": F.lit(0).cast("long")}).limit(0)
    variants = none
    for k in kinds:
        variants = variants.unionByName(k, allowMissingColumns=True)
    variants = variants.withColumn("id", F.concat("kind", "n"))
    lost = not_aligned(found.blocks, a_sizes, b_sizes)
    return main_table(events, rows.where("parent IS NOT NULL"), variants, lost, names)


def short_indels(bases: DataFrame) -> DataFrame:
    """(block, kind, coordinates, a_seq, b_seq): single inserted and deleted bases of cigar_variants() joined to runs."""
    ins, gone = F.col("a_base") == ".", F.col("b_base") == "."
    rows = bases.where(ins | gone).withColumn("op", F.when(ins, "INS").otherwise("DEL"))
    fixed, along = F.when(ins, F.col("a_pos")).otherwise(F.col("b_pos")), F.when(ins, F.col("b_pos") * F.col("b_dir")).otherwise(F.col("a_pos"))
    from pyspark.sql.window import Window

    rows = rows.withColumns({"_d": fixed, "_g": along}).select("block", "b_dir", "op", "_d", "_g", "a_pos", "b_pos", F.when(ins, F.col("b_base")).otherwise(F.col("a_base")).alias("base")).distinct()
    rows = rows.withColumn("_run", F.col("_g") - F.row_number().over(Window.partitionBy("block", "op", "_d").orderBy("_g")))
    held = rows.groupBy("block", "op", "_d", "_run").agg(F.min("a_pos").alias("a_start"), F.max("a_pos").alias("a_end"), F.min(F.struct("_g", "b_pos"))["b_pos"].alias("b_start"), F.max(F.struct("_g", "b_pos"))["b_pos"].alias("b_end"), F.array_join(F.array_sort(F.collect_list(F.struct("_g", "base")))["base"], "").alias("seq"))
    none = F.lit(None).cast("string")
    return held.select("block", F.col("op").alias("kind"), "a_start", "a_end", "b_start", "b_end", F.when(F.col("op") == "DEL", F.col("seq")).otherwise(none).alias("a_seq"), F.when(F.col("op") == "INS", F.col("seq")).otherwise(none).alias("b_seq"))


def write_all(rows: DataFrame, a_sizes: DataFrame, folder: str, sample: str = "sample", vcf: bool = True, names: DataFrame | None = None) -> None:
    """The main table, the VCF, the summary and the map of names in ``folder``."""
    rows = checkpointed(rows)
    write_table(rows, f"{folder}/table")
    if vcf:
        write_vcf(rows, a_sizes, f"{folder}/vcf", sample)
    write_summary(summary(rows), f"{folder}/summary")
    if names is not None:
        write_names(names, f"{folder}/mapids")


def checked_genomes(aln: DataFrame, a: DataFrame, b: DataFrame, names: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(A's chunks, B's chunks, A's sizes, B's sizes) of two FASTA frames, B under A's names; raises if alignments don't fit them."""
    from ..sources import chunked

    if names is not None:
        b = renamed(b, names, "chr")
    sizes = [d.select("chr", F.col("len").cast("long").alias("size")) for d in (a, b)]
    check_genomes(aln, *sizes)
    return checkpointed(chunked(a)), checkpointed(chunked(b)), *sizes
