"""Readers of alignment tables, sequences and variants.

Records that a format does not allow are not dropped: readers raise an error that shows the record, or, with
``rejects``, give a frame of (line, reason) in its place.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar_ops, clip, identity_100, is_reverse, query_span, reference_span, whole_cigar

ALIGNMENT = "a_start long, a_end long, b_start long, b_end long, a_len long, b_len long, iden double, a_dir int, b_dir int, a_chr string, b_chr string, cigar string"


def _checked(rows: DataFrame, reason: Column, rejects: bool) -> DataFrame:
    """``rows`` (line, ...) whose ``reason`` is null; others are an error, or with ``rejects`` they alone are given."""
    rows = rows.withColumn("_reason", reason)
    if rejects:
        return rows.where("_reason IS NOT NULL").select("line", F.col("_reason").alias("reason"))
    stop = F.raise_error(F.concat("_reason", F.lit(": "), F.substring("line", 1, 200)))
    return rows.where(F.when(F.col("_reason").isNull(), F.lit(True)).otherwise(stop.cast("boolean"))).drop("_reason", "line")


def read_alignment_table(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated alignments: 11 columns, a CIGAR as the twelfth if there is one; more are ignored."""
    return spark.read.csv(path, sep="\t", schema=ALIGNMENT, mode="PERMISSIVE", enforceSchema=True)


def check_alignments(aln: DataFrame) -> DataFrame:
    """Alignments as the other operators take them: A forward, reverse rows with b_start above b_end.

    Where all reverse rows have ascending B coordinates they are turned round; some of each kind, an a_dir other than 1, a
    b_dir other than 1 and -1 or a chromosome named by a number are errors.
    """
    n = lambda test: F.coalesce(F.sum(F.when(F.expr(test), 1)), F.lit(0))
    found = aln.agg(n("a_dir <> 1").alias("a"), n("b_dir NOT IN (1, -1)").alias("b"), n("b_dir = -1 AND b_start < b_end").alias("up"), n("b_dir = -1 AND b_start > b_end").alias("down"), n("a_chr RLIKE '^[0-9]+$' OR b_chr RLIKE '^[0-9]+$'").alias("c")).first()
    for count, what in ((found.a, "an a_dir other than 1"), (found.b, "a b_dir other than 1 and -1"), (found.c, "a chromosome named by a number")):
        if count:
            raise ValueError(f"{count} alignments have {what}")
    if found.up and found.down:
        raise ValueError("some reverse alignments have ascending and some descending query coordinates")
    if not found.up:
        return aln
    turn = F.col("b_dir") == -1
    return aln.withColumns({"b_start": F.when(turn, F.col("b_end")).otherwise(F.col("b_start")), "b_end": F.when(turn, F.col("b_start")).otherwise(F.col("b_end"))})


def read_paf(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    """PAF with a ``cg`` tag. Coordinates become 1-based and closed; reverse rows have b_start > b_end."""
    f = F.split(F.trim("line"), r"\s+")
    rows = spark.read.text(path).where("length(trim(value)) > 0").select(F.col("value").alias("line")).withColumn("f", f)
    cg = F.get(F.filter("f", lambda x: x.startswith("cg:Z:")), F.lit(0))
    rows = rows.withColumn("cigar", F.substring(cg, 6, 1 << 30))
    reason = F.when(F.size("f") < 12, "too few columns").when(F.col("cigar").isNull(), "no cg tag").when(~whole_cigar(F.col("cigar")), "a CIGAR with other operations than = X I D, or clips inside")
    rows = _checked(rows, reason, rejects)
    if rejects:
        return rows
    rows = rows.withColumn("ops", cigar_ops(F.col("cigar")))
    n = lambda i: F.col("f")[i].cast("long")
    forward = F.col("f")[4] == "+"
    return rows.select(
        (n(7) + 1).alias("a_start"), n(8).alias("a_end"),
        F.when(forward, n(2) + 1).otherwise(n(3)).alias("b_start"), F.when(forward, n(3)).otherwise(n(2) + 1).alias("b_end"),
        (n(8) - n(7)).alias("a_len"), (n(3) - n(2)).alias("b_len"), (identity_100(F.col("ops")) / 100).alias("iden"),
        F.lit(1).alias("a_dir"), F.when(forward, 1).otherwise(-1).alias("b_dir"), F.col("f")[5].alias("a_chr"), F.col("f")[0].alias("b_chr"), "cigar",
    )


def read_paf_as_table(spark: SparkSession, path: str, least_length: int, least_identity: float) -> DataFrame:
    """PAF rows longer than ``least_length`` on both genomes and more alike than ``least_identity`` percent by their match counts."""
    f = F.split(F.trim("value"), r"\s+")
    n = lambda i: F.col("f")[i].cast("long")
    rows = spark.read.text(path).where("length(trim(value)) > 0").select(f.alias("f"))
    rows = rows.select((n(7) + 1).alias("a_start"), n(8).alias("a_end"), (n(2) + 1).alias("b_start"), n(3).alias("b_end"), (n(8) - n(7)).alias("a_len"), (n(3) - n(2)).alias("b_len"), F.bround(n(9) / n(10) * 100, 2).alias("iden"), F.lit(1).alias("a_dir"), F.when(F.col("f")[4] == "+", 1).otherwise(-1).alias("b_dir"), F.col("f")[5].alias("a_chr"), F.col("f")[0].alias("b_chr"), F.element_at(F.split(F.element_at("f", -1), ":"), -1).alias("cigar"))
    return rows.where((F.col("a_len") > least_length) & (F.col("b_len") > least_length) & (F.col("iden") > least_identity))


def _sam_alignments(rows: DataFrame) -> DataFrame:
    """Alignments from (name, flag, ref, pos, cigar, ops)."""
    back = is_reverse(F.col("flag"))
    rows = rows.withColumns({"fw": ~back, "clip": F.when(back, clip(F.col("ops"), last=True)).otherwise(clip(F.col("ops"))), "rs": reference_span(F.col("ops")), "qs": query_span(F.col("ops"))})
    first, last = F.col("clip") + 1, F.col("clip") + F.col("qs")
    return rows.select(
        F.col("pos").alias("a_start"), (F.col("pos") - 1 + F.col("rs")).alias("a_end"), F.when(F.col("fw"), first).otherwise(last).alias("b_start"), F.when(F.col("fw"), last).otherwise(first).alias("b_end"),
        F.col("rs").alias("a_len"), F.col("qs").alias("b_len"), (identity_100(F.col("ops")) / 100).alias("iden"), F.lit(1).alias("a_dir"), F.when(F.col("fw"), 1).otherwise(-1).alias("b_dir"),
        F.col("ref").alias("a_chr"), F.col("name").alias("b_chr"), "cigar",
    )


_BAD_CIGAR = "a CIGAR with other operations than = X I D, or clips inside"


def sam_records(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, flag, ref, pos, cigar) of the aligned records of a SAM text."""
    f = F.split("line", "\t")
    rows = spark.read.text(path).where("value not like '@%' and length(value) > 0").select(F.col("value").alias("line")).withColumn("f", f).where("f[2] <> '*'")
    return rows.select("line", F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("ref"), F.col("f")[3].cast("long").alias("pos"), F.col("f")[5].alias("cigar"))


def read_sam(spark: SparkSession, path: str, rejects: bool = False) -> DataFrame:
    """Aligned records of a SAM text. The query's start is its leading clip, the trailing one on the reverse strand."""
    rows = _checked(sam_records(spark, path), F.when(~whole_cigar(F.col("cigar")), _BAD_CIGAR), rejects)
    return rows if rejects else _sam_alignments(rows.withColumn("ops", cigar_ops(F.col("cigar"))))


#: A BAM's operations by number.
_BAM_OPS = "MIDNSHP=X"


def _bam_records(stream) -> Iterator[tuple[str, int, str | None, int, str]]:
    """(name, flag, ref, pos, cigar) of each record of a decompressed BAM."""
    if stream.read(4) != b"BAM\x01":
        raise ValueError("no BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        n = struct.unpack("<i", stream.read(4))[0]
        names.append(stream.read(n)[:-1].decode())
        stream.read(4)
    while head := stream.read(4):
        body = stream.read(struct.unpack("<i", head)[0])
        ref, pos, name_length, _, _, n_ops, flag = struct.unpack("<iiBBHHH", body[:16])
        name = body[32 : 32 + name_length - 1].decode()
        at = 32 + name_length
        ops = struct.unpack(f"<{n_ops}I", body[at : at + 4 * n_ops])
        yield name, flag, names[ref] if ref >= 0 else None, pos + 1, "".join(f"{x >> 4}{_BAM_OPS[x & 15]}" for x in ops)


def bam_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(line, name, flag, ref, pos, cigar) of the aligned records of BAM files, each streamed by a task of its own.

    ``paths`` are URIs of Arrow's file systems that all executors reach; a file is never held as a whole.
    """
    schema = pa.schema([("line", pa.string()), ("name", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int64()), ("cigar", pa.string())])

    def run(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows = []
                    for name, flag, ref, pos, cigar in _bam_records(stream):
                        if ref is not None:
                            rows.append((name, name, flag, ref, pos, cigar))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    return files.mapInArrow(run, "line string, name string, flag int, ref string, pos long, cigar string")


def read_bam(spark: SparkSession, paths: list[str], rejects: bool = False) -> DataFrame:
    """As read_sam(), from BAM files."""
    rows = _checked(bam_records(spark, paths), F.when(~whole_cigar(F.col("cigar")), _BAD_CIGAR), rejects)
    return rows if rejects else _sam_alignments(rows.withColumn("ops", cigar_ops(F.col("cigar"))))


def without_primary(records: DataFrame) -> DataFrame:
    """(name) of sequences none of whose records is primary: a flag below 256."""
    return records.groupBy("name").agg(F.bool_or(F.col("flag") < 256).alias("p")).where("NOT p").select("name")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq, len) of FASTA records; the id is the first word behind the mark, the rest of its line is left out.

    Compressed files are read as such. Records begin at a '>' that begins a line. An id on two records is an error.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("value")).where("length(trim(value)) > 0")
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = rows.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("chr"), body.alias("seq")).withColumn("len", F.length("seq"))
    once = F.count(F.lit(1)).over(Window.partitionBy("chr")) == 1
    return rows.withColumn("_ok", F.when(once, True).otherwise(F.raise_error(F.concat(F.lit("more than one sequence is named "), "chr")).cast("boolean"))).where("_ok").drop("_ok")


def chunked(fasta: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chr, begin, seq): sequences in chunks of ``size`` bases, so that a chromosome is many rows."""
    data = fasta.select("chr", "len", F.encode("seq", "UTF-8").alias("_seq")).where("len > 0")
    each = data.withColumn("begin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("len").cast("long"), F.lit(size).cast("long"))))
    return each.select("chr", "begin", F.decode(F.substring("_seq", F.col("begin").cast("int"), F.lit(size)), "UTF-8").alias("seq"))


def read_fasta_chunks(spark: SparkSession, path: str, size: int = 1 << 16) -> DataFrame:
    return chunked(read_fasta(spark, path), size)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alts, qual, filter, info, format, samples) of a VCF; alleles in upper case, '.' as null."""
    f = F.split("value", "\t")
    at = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("."))
    info = F.transform(F.split(at(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.regexp_replace(x, r"^[^=]*=", "")).alias("v")))
    samples = F.when(F.size(f) > 9, F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(1))))
    return spark.read.text(path).where("value not like '#%' and length(value) > 0").select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), at(2).alias("id"), F.upper(f[3]).alias("ref"), F.split(F.upper(f[4]), ",").alias("alts"), at(5).cast("double").alias("qual"), at(6).alias("filter"), F.map_from_entries(info).alias("info"), at(8).alias("format"), samples.alias("samples"))


def vcf_symbols(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Names of the symbolic alleles that a VCF's header declares."""
    rows = spark.read.text(path).where("value like '##ALT=<ID=%'").select(F.regexp_extract("value", r"^##ALT=<ID=([^,>]+)", 1).alias("id"))
    return tuple(sorted({r.id for r in rows.collect()}))  # header lines only


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    """(a_pos, a_base, b_base, b_pos, a_dir, b_dir, a_chr, b_chr) of the 12 columns that show-snps -HrTS writes."""
    rows = spark.read.csv(path, sep="\t", schema="a_pos long, a_base string, b_base string, b_pos long, c4 long, c5 long, c6 long, c7 long, a_dir int, b_dir int, a_chr string, b_chr string")
    return rows.drop("c4", "c5", "c6", "c7")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, grp, header, fields) of block files: lines that begin with '#' open a group, and those below are its members.

    A file is read as a whole, as its lines' order matters; groups are counted by a running sum over its lines.
    """
    named = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*Out[^/]*)", 1)  # of a file, or of a folder that holds it in parts
    lines = spark.read.text(path, wholetext=True).select(named.alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line")).where("length(trim(line)) > 0")
    header = F.col("line").startswith("#")
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("file", F.sum(header.cast("int")).over(w).alias("grp"), header.alias("header"), F.split(F.trim("line"), r"\s+").alias("fields"))


#: Classes of the block files of rearrangements between chromosomes.
CTX = {"translocation": "TL", "invTranslocation": "invTL", "duplication": "dup", "invDuplication": "invDup"}


def blocks_and_alignments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(block, class, copies, coordinates) and (block, coordinates) of what read_blocks() gives; files are named by their class."""
    rows = rows.withColumn("block", F.concat_ws(":", "file", "grp"))
    f = lambda i: F.get("fields", F.lit(i))
    ctx = F.create_map(*[F.lit(x) for pair in CTX.items() for x in pair])[f(8)]
    own = F.when(F.col("file").contains("ctxOut"), ctx).otherwise(F.regexp_extract("file", r"(invDup|invTL|syn|inv|TL|dup)Out", 1))
    blocks = rows.where("header").select("block", own.alias("class"), f(9).alias("copies"), f(1).alias("a_chr"), f(2).cast("long").alias("a_start"), f(3).cast("long").alias("a_end"), f(5).alias("b_chr"), f(6).cast("long").alias("b_start"), f(7).cast("long").alias("b_end"))
    alns = rows.where("NOT header").select("block", f(0).cast("long").alias("a_start"), f(1).cast("long").alias("a_end"), f(2).cast("long").alias("b_start"), f(3).cast("long").alias("b_end"))
    return blocks, alns.join(blocks.select("block", "a_chr", "b_chr"), "block")


def read_bed(spark: SparkSession, path: str, grouped: bool = False) -> DataFrame:
    """(chr, start, end) of a BED; with ``grouped`` a chromosome whose lines don't all follow each other is an error."""
    rows = spark.read.csv(path, sep="\t", schema="chr string, start long, end long")
    if grouped:
        lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line")).where("length(trim(line)) > 0")
        lines = lines.select("file", "at", F.split("line", r"\s+")[0].alias("chr"))
        opened = lines.withColumn("last", F.lag("chr").over(Window.partitionBy("file").orderBy("at"))).where("last IS NULL OR last <> chr")
        twice = opened.groupBy("chr").count().where("count > 1").orderBy("chr").first()
        if twice:
            raise ValueError(f"the BED is not sorted: chromosome {twice.chr} begins more than once")
    return rows


def read_faidx(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chr string, len long").select("chr", F.lit(1).cast("long").alias("start"), F.col("len").alias("end"))
