"""Command line: ``compare`` finds rearrangements and variants, ``scaffold`` puts fragmented assemblies in order."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .operators.filters import check_arguments
from .operators.rearrangements import Settings
from .operators.scaffold import assembled, partners
from .plans import compare
from .sinks import pseudo_chromosomes, scaffold_report, write_block_text, write_fasta, write_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="karyoframe")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare", help="rearrangements, variants, table, VCF and summary of two genomes")
    c.add_argument("-c", dest="infile", required=True, help="alignments")
    c.add_argument("-r", dest="ref", required=True, help="FASTA of the reference")
    c.add_argument("-q", dest="qry", required=True, help="FASTA of the query")
    c.add_argument("-d", dest="delta", help="show-snps rows (-HrTS), where alignments have no CIGAR")
    c.add_argument("-F", dest="ftype", choices="TSBP", default="T", help="T: table, S: SAM, B: BAM, P: PAF")
    c.add_argument("-f", dest="f", action="store_false", default=True, help="keep short and unlike alignments")
    c.add_argument("-k", dest="keep", action="store_true", help="write block files")
    c.add_argument("--dir", default=".")
    c.add_argument("--prefix", default="")
    c.add_argument("--nc", type=int, default=1, help="cores of a local session")
    c.add_argument("--novcf", action="store_true")
    c.add_argument("--samplename", default="sample")
    c.add_argument("--nosr", action="store_true", help="read block files of an earlier run")
    c.add_argument("--invgaplen", type=float, default=1e9)
    c.add_argument("--tdgaplen", type=int, default=500_000)
    c.add_argument("--tdmaxolp", type=float, default=0.8)
    c.add_argument("-b", dest="bruteRunTime", type=int, default=60, help="accepted; the work of all sets is bounded by their number instead")
    c.add_argument("--unic", type=int, default=1000)
    c.add_argument("--unip", type=float, default=0.5)
    c.add_argument("--no-chrmatch", dest="chrmatch", action="store_false", default=True)
    c.add_argument("--nosv", action="store_true")
    c.add_argument("--nosnp", action="store_true")
    c.add_argument("--all", action="store_true", help="short variants of duplications too")
    c.add_argument("--allow-offset", type=int, default=5)
    c.add_argument("--cigar", action="store_true", help="the table's twelfth column is a CIGAR")
    c.add_argument("--hdrseq", action="store_true")
    c.add_argument("--maxsize", type=int, default=-1)
    s = sub.add_parser("scaffold", help="pseudo-chromosomes from fragmented assemblies")
    s.add_argument("coords")
    s.add_argument("ref")
    s.add_argument("qry")
    s.add_argument("-n", type=int, default=500, help="N between two scaffolds")
    s.add_argument("-o", dest="out", default="out")
    s.add_argument("--noref", action="store_true", help="the reference is fragmented too")
    s.add_argument("-F", dest="ftype", choices="TSBP", default="T")
    return p


def alignments(spark: SparkSession, path: str, kind: str) -> DataFrame:
    read = {"T": sources.read_alignment_table, "S": sources.read_sam, "P": sources.read_paf, "B": lambda s, f: sources.read_bam(s, [f])}[kind]
    return sources.check_alignments(read(spark, path))


def run_compare(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes all files to --dir and returns the rows of the main table."""
    check_arguments(args.invgaplen, args.tdgaplen, args.tdmaxolp, args.unic, args.unip)
    folder = f"{args.dir}/{args.prefix}"
    aln, names = compare.prepared(alignments(spark, args.infile, args.ftype), args.f, args.chrmatch)
    a, b, a_sizes, b_sizes = compare.checked_genomes(aln, sources.read_fasta(spark, args.ref), sources.read_fasta(spark, args.qry), names)
    if args.nosr:
        blocks, rows = sources.blocks_and_alignments(sources.read_blocks(spark, f"{folder}blocks/*Out*"))
        keys = ["a_chr", "b_chr", "a_start", "a_end", "b_start", "b_end"]
        rows = rows.join(blocks.select("block", "class", "copies"), "block").join(aln.select(*keys, "aln_id", "b_dir", "iden100", "ln", "b_len", "cigar"), keys)
        found = compare.Rearranged(blocks, rows)
    else:
        found = compare.rearranged(aln, Settings(invgaplen=args.invgaplen, tdgaplen=args.tdgaplen, tdmaxolp=round(100 * args.tdmaxolp), unic=args.unic, unip=round(100 * args.unip)))
    if args.keep:
        for kind in ("syn", "inv", "TL", "invTL", "dup", "invDup", "ctx"):
            write_block_text(found.blocks, found.alignments, f"{kind}Out", f"{folder}blocks/{kind}Out.txt")
    use_cigar = args.ftype != "T" or args.cigar
    copied = found.alignments["class"].isin("dup", "invDup")
    snps = sources.read_snps(spark, args.delta) if args.delta and not use_cigar else None
    table = compare.compared(found, a, b, a_sizes, b_sizes, args.allow_offset, args.hdrseq, args.maxsize, names, sv=not args.nosv, short=not args.nosnp and (use_cigar or snps is not None), snps=snps, copies=args.all, copied=copied)
    compare.write_all(table, a_sizes, folder + "out", args.samplename, not args.novcf, names)
    return table


def run_scaffold(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Writes both genomes' pseudo-chromosomes and the report, and returns the order of the scaffolds."""
    aln = alignments(spark, args.coords, args.ftype)
    ref, qry = sources.read_fasta(spark, args.ref), sources.read_fasta(spark, args.qry)
    sizes = [d.select("chr", F.col("len").cast("long").alias("size")) for d in (ref, qry)]
    order = assembled(partners(aln), *sizes, args.noref).cache()
    a, b = (order.where(F.col("genome") == g).drop("genome") for g in "AB")
    write_fasta(pseudo_chromosomes(a, ref, args.n), f"{args.out}.ref.fasta", width=0)
    write_fasta(pseudo_chromosomes(b, qry, args.n), f"{args.out}.qry.fasta", width=0)
    write_lines(scaffold_report(a, b), ["chr"], f"{args.out}.anno")
    return order


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("karyoframe").getOrCreate()
    (run_compare if args.command == "compare" else run_scaffold)(spark, args)


if __name__ == "__main__":
    main()
