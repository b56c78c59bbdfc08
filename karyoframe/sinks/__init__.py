"""Writers: block files, the main table, VCF, summary, FASTA, scaffold report and name map.

Rows are sorted over ranges. With ``single`` a sink is one file, written by one task that streams the sorted rows; without
it, it is a folder of parts whose names are in order.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import plain_bases, reverse_complement, spaced, wrapped
from ..operators.variants import NAMES, SUMMARY

#: Columns of the main table, of which a missing one is '-'.
TABLE = ("a_chr", "a_start", "a_end", "a_seq", "b_seq", "b_chr", "b_start", "b_end", "id", "parent", "kind", "dupclass")
#: Symbolic alleles of the VCF and what they are.
ALLELES = {
    "SYN": "Syntenic region",
    "INV": "Inversion",
    "TRANS": "Translocation",
    "INVTR": "Inverted Translocation",
    "DUP": "Duplication",
    "INVDP": "Inverted Duplication",
    "SYNAL": "Syntenic alignment",
    "INVAL": "Inversion alignment",
    "TRANSAL": "Translocation alignment",
    "INVTRAL": "Inverted Translocation alignment",
    "DUPAL": "Duplication alignment",
    "INVDPAL": "Inverted Duplication alignment",
    "HDR": "Highly diverged regions",
    "INS": "Insertion in non-reference genome",
    "DEL": "Deletion in non-reference genome",
    "CPG": "Copy gain in non-reference genome",
    "CPL": "Copy loss in non-reference genome",
    "SNP": "Single nucleotide polymorphism",
    "TDM": "Tandem repeat",
    "NOTAL": "Not Aligned region",
}
#: Fields of the VCF: id, type, what it is.
FIELDS = (
    ("END", "Integer", "End position on reference genome"),
    ("ChrB", "String", "Chromosome ID on the non-reference genome"),
    ("StartB", "Integer", "Start position on non-reference genome"),
    ("EndB", "Integer", "End position on non-reference genome"),
    ("Parent", "String", "ID of the parent SR"),
    ("VarType", "String", "SR for structural arrangements, ShV for short variants, missing otherwise"),
    ("DupType", "String", "Copy gain or loss in the non-reference genome"),
)


def write_lines(lines: DataFrame, order: list[Column | str], path: str, single: bool = True, header: list[str] | None = None) -> None:
    """Writes the column ``line`` in the given order behind the lines of ``header``."""
    rows = lines.withColumn("_top", F.lit(1))
    if header:
        top = lines.sparkSession.createDataFrame([(0, k, x) for k, x in enumerate(header)], "_top int, _at int, line string")
        rows = top.unionByName(rows.withColumn("_at", F.lit(0)), allowMissingColumns=True)
        order = ["_at", *order]
    rows = rows.orderBy("_top", *order).select("line")
    (rows.coalesce(1) if single else rows).write.mode("overwrite").text(path)


def main_table(events: DataFrame, alignments: DataFrame, variants: DataFrame, gaps: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The rows of the main table with their place (chromosome, event and row in it), from what with ids and parents.

    Events come by coordinates, each with its alignments and variants behind it, ordered by A. A region of A that is not
    aligned stands before the event that it abuts, the last of a chromosome at its end, and regions of B come last.
    ``gaps`` is what not_aligned() gives; ``names`` (a_chr, b_chr) brings back the names of query chromosomes.
    """
    from ..operators.filters import renamed
    from ..operators.variants import numbered

    cols = [*TABLE]
    full = lambda d: d.select(*[F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in cols])
    kids = full(alignments).unionByName(full(variants)).withColumn("_rank", F.lit(2))
    ids = full(events).withColumn("_rank", F.lit(1))
    keys = events.select(F.col("id").alias("parent"), F.col("a_start").alias("_es"), F.col("a_end").alias("_ee"))
    kids = kids.join(keys, "parent").withColumn("_event", F.col("parent"))
    ids = ids.withColumn("_es", F.col("a_start")).withColumn("_ee", F.col("a_end")).withColumn("_event", F.col("id"))
    gone = numbered(gaps, ["genome", "chr", "start"], "number").withColumn("id", F.concat(F.lit("NOTAL"), "number")).withColumn("kind", F.lit("NOTAL"))
    a = gone.where("genome = 'R'").select(F.col("chr").alias("a_chr"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), "id", "kind")
    b = gone.where("genome = 'Q'").select(F.col("chr").alias("b_chr"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "id", "kind")
    # events begin after the gap before them, so that its own coordinates place it
    a = full(a).withColumns({"_rank": F.lit(0), "_es": F.col("a_end"), "_ee": F.col("a_end"), "_event": F.lit("")})
    b = full(b).withColumns({"_rank": F.lit(0), "_es": F.lit(None).cast("long"), "_ee": F.lit(None).cast("long"), "_event": F.lit("")})
    out = kids.select(*cols, "_rank", "_es", "_ee", "_event").unionByName(ids).unionByName(a).unionByName(b)
    return renamed(out, names, back=True) if names is not None else out


def table_order() -> list[Column]:
    """The order of main_table(): regions of B last, events by A, then the event's own rows by A."""
    return [F.col("a_chr").asc_nulls_last(), F.col("_es"), F.col("_ee"), F.col("_event"), F.col("_rank"), F.col("a_start"), F.col("a_end"), F.col("b_chr"), F.col("b_start"), F.col("id")]


def table_lines(rows: DataFrame) -> DataFrame:
    return rows.withColumn("line", F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in TABLE]))


def write_table(rows: DataFrame, path: str, single: bool = True) -> None:
    write_lines(table_lines(rows), table_order(), path, single)


def vcf_header(sizes: list[tuple[str, int]], sample: str, date: datetime.date | None = None) -> list[str]:
    date = date or datetime.date.today()
    out = ["##fileformat=VCFv4.3", f"##fileDate={date:%Y%m%d}", "##source=karyoframe", *[f"##contig=<ID={c},length={n}>" for c, n in sizes]]
    out += [f'##ALT=<ID={k},Description="{v}">' for k, v in ALLELES.items()]
    out += [f'##INFO=<ID={k},Number=1,Type={t},Description="{v}">' for k, t, v in FIELDS]
    return [*out, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample))]


def vcf_lines(rows: DataFrame) -> DataFrame:
    """``rows`` of the main table as VCF lines in column ``line``; regions of B are left out, and variants whose plain bases are the same.

    A variant that has one sequence of two is an error.
    """
    sequenced = F.col("kind").isin("SNP", "INS", "DEL", "HDR")
    ref, alt = plain_bases(F.col("a_seq")), plain_bases(F.col("b_seq"))
    one = F.col("a_seq").isNull() != F.col("b_seq").isNull()
    rows = rows.where("a_chr IS NOT NULL").where(F.when(sequenced & one, F.raise_error(F.concat(F.lit("one sequence of two: "), "id")).cast("boolean")).otherwise(F.lit(True)))
    shown = sequenced & F.col("a_seq").isNotNull()
    rows = rows.where(~shown | (F.upper(ref) != F.upper(alt)))
    rearranged, short = F.col("kind").isin(*NAMES.values()), F.col("kind").isin("SNP", "INS", "DEL", "HDR", "CPG", "CPL", "TDM")
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    dup = F.when(rearranged, F.coalesce("dupclass", F.lit("-"))).otherwise(".")
    info = F.concat(F.lit("END="), value("a_end"), F.lit(";ChrB="), value("b_chr"), F.lit(";StartB="), value("b_start"), F.lit(";EndB="), value("b_end"), F.lit(";Parent="), value("parent"), F.lit(";VarType="), F.when(rearranged, "SR").when(short, "ShV").otherwise("."), F.lit(";DupType="), dup)
    alleles = [F.when(shown, ref).otherwise("N"), F.when(shown, alt).otherwise(F.concat(F.lit("<"), "kind", F.lit(">")))]
    return rows.withColumn("line", F.concat_ws("\t", "a_chr", F.col("a_start").cast("string"), "id", *alleles, F.lit("."), F.lit("PASS"), info, F.lit("GT"), F.lit("1")))


def write_vcf(rows: DataFrame, sizes: DataFrame, path: str, sample: str = "sample", single: bool = True) -> None:
    """``sizes`` has (chr, size) of the reference's chromosomes; rows are ordered by chromosome and number."""
    held = [(r.chr, r["size"]) for r in sizes.orderBy("chr").collect()]  # a row for each chromosome
    write_lines(vcf_lines(rows), ["a_chr", "a_start", "a_end", "id"], path, single, vcf_header(held, sample))


def summary_lines(sums: DataFrame) -> list[str]:
    """The lines of the summary, from summary()'s 14 rows."""
    held = {r.label: r for r in sums.collect()}
    show = lambda x: "-" if x is None else str(x)
    line = lambda label, text, *_: "\t".join((text, str(held[label].n), show(held[label].length_ref), show(held[label].length_qry)))
    head = "#Variation_type\tCount\tLength_ref\tLength_qry"
    return ["#Structural annotations", head, *[line(*r) for r in SUMMARY[:7]], "", "", "#Sequence annotations", head, *[line(*r) for r in SUMMARY[7:]]]


def write_summary(sums: DataFrame, path: str) -> None:
    lines = sums.sparkSession.createDataFrame([(k, x) for k, x in enumerate(summary_lines(sums))], "at int, line string")
    write_lines(lines, ["at"], path)


def block_lines(blocks: DataFrame, alignments: DataFrame) -> DataFrame:
    """(a_chr, file, ..., line): a header line for each block and a line for each of its alignments; see read_blocks().

    Blocks between chromosomes go to ctxOut with their class and copies, others to a file of their class.
    """
    ctx = F.col("a_chr") != F.col("b_chr")
    long = {"TL": "translocation", "invTL": "invTranslocation", "dup": "duplication", "invDup": "invDuplication"}
    named = F.create_map(*[F.lit(x) for pair in long.items() for x in pair])
    base = F.concat_ws("\t", F.lit("#"), "a_chr", F.col("a_start").cast("string"), F.col("a_end").cast("string"), F.lit("-"), "b_chr", F.col("b_start").cast("string"), F.col("b_end").cast("string"))
    copies = F.when(F.col("class").isin("dup", "invDup"), F.col("copies"))
    head = F.when(ctx, F.concat_ws("\t", base, named[F.col("class")], copies)).otherwise(F.when(copies.isNotNull(), F.concat_ws("\t", base, "class", copies)).otherwise(base))
    file = F.when(ctx, "ctxOut").otherwise(F.concat("class", F.lit("Out")))
    top = blocks.select("block", file.alias("file"), F.col("a_chr").alias("on"), F.col("a_start").alias("s"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("t"), head.alias("line"))
    keys = top.select("block", "file", "on", "s")
    own = alignments.select("block", F.col("a_start").alias("t"), F.concat_ws("\t", *[F.col(c).cast("string") for c in ("a_start", "a_end", "b_start", "b_end")]).alias("line")).join(keys, "block").withColumn("rank", F.lit(1))
    return top.unionByName(own)


def write_blocks(blocks: DataFrame, alignments: DataFrame, path: str) -> None:
    """A folder of Parquet by file name, with the lines' places; text files of one class are written by write_lines()."""
    block_lines(blocks, alignments).write.mode("overwrite").partitionBy("file").parquet(path)


def write_block_text(blocks: DataFrame, alignments: DataFrame, file: str, path: str) -> None:
    write_lines(block_lines(blocks, alignments).where(F.col("file") == file), ["on", "s", "block", "rank", "t", "line"], path)


def fasta_lines(fasta: DataFrame, turned: list[str] | None = None, width: int = 64) -> DataFrame:
    """(chr, line) of records (chr, seq), wrapped; those in ``turned`` as their reverse complements."""
    seq = F.when(F.col("chr").isin(*turned), reverse_complement(F.col("seq"))).otherwise(F.col("seq")) if turned else F.col("seq")
    body = wrapped(seq, width) if width else seq
    return fasta.select("chr", F.concat(F.lit(">"), "chr", F.lit("\n"), body).alias("line"))


def write_fasta(fasta: DataFrame, path: str, turned: list[str] | None = None, width: int = 64) -> None:
    write_lines(fasta_lines(fasta, turned, width), ["chr"], path)


def pseudo_chromosomes(order: DataFrame, fasta: DataFrame, spacer: int = 500) -> DataFrame:
    """(chr, seq) of scaffolds put together, from (chr, place, scaffold, strand) and their sequences, ``spacer`` N between two."""
    seq = F.when(F.col("strand") == -1, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    held = order.join(fasta.select(F.col("chr").alias("scaffold"), "seq"), "scaffold").select("chr", F.struct("place", seq.alias("seq")).alias("x"))
    return held.groupBy("chr").agg(F.array_sort(F.collect_list("x")).alias("x")).select("chr", spaced(F.col("x")["seq"], spacer).alias("seq"))


def scaffold_report(ref: DataFrame, qry: DataFrame) -> DataFrame:
    """(chr, line): five lines for each put-together chromosome: its id, the reference's scaffolds and strands, the query's."""

    def side(d: DataFrame, name: str) -> DataFrame:
        x = d.groupBy("chr").agg(F.array_sort(F.collect_list(F.struct("place", "scaffold", "strand"))).alias("x"))
        return x.select("chr", F.concat_ws("\n", F.array_join(F.col("x")["scaffold"], "\t"), F.array_join(F.transform(F.col("x")["strand"], lambda s: s.cast("string")), "\t")).alias(name))

    both = side(ref, "r").join(side(qry, "q"), "chr", "full_outer")
    return both.select("chr", F.concat_ws("\n", "chr", F.coalesce("r", F.lit("\n")), F.coalesce("q", F.lit("\n"))).alias("line"))


def write_names(names: DataFrame, path: str) -> None:
    """The map of chromosome names: reference, tab, query."""
    write_lines(names.select("a_chr", F.concat_ws("\t", "a_chr", "b_chr").alias("line")), ["a_chr"], path)
