"""Structural and short variants, and operations on variant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import reverse_complement
from .graph import checkpointed


def classify_gaps(aln: DataFrame, block: str, order: list[str], offset: int = 5) -> DataFrame:
    """The variant between each alignment and the next of its block, by the gaps m on A and n on B.

    Small overlaps up to ``offset`` bases count as none. Blocks are forward where b_dir is 1, reverse where it is -1.
    """
    w = Window.partitionBy(block).orderBy(*order)
    rows = aln.withColumn("na", F.lead("a_start").over(w)).withColumn("nae", F.lead("a_end").over(w)).withColumn("nb", F.lead("b_start").over(w)).withColumn("nbe", F.lead("b_end").over(w)).where("na is not null")
    o = -abs(offset)
    rows = rows.withColumn("m", F.expr("na - a_end - 1")).withColumn("n", F.expr("if(b_dir = 1, nb - b_end - 1, b_end - nb - 1)"))
    kind = F.expr(f"""
        CASE WHEN m BETWEEN {o} AND 0 THEN CASE WHEN n > 0 THEN 'INS' WHEN n < {o} THEN 'CPL' END
             WHEN m = 1 THEN CASE WHEN n = 1 THEN 'SNP' WHEN n > 1 THEN 'HDR' WHEN n < {o} THEN 'CPL' ELSE 'DEL' END
             WHEN m > 1 THEN CASE WHEN n > 0 THEN 'HDR' WHEN n < {o} THEN 'CPL' ELSE 'DEL' END
             WHEN n >= {o} THEN 'CPG'
             WHEN 10 * abs(m - n) >= greatest(abs(m), abs(n)) THEN 'TDM' END""")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    gain = "kind = 'CPG' OR (kind = 'TDM' AND abs(m) > abs(n))"
    loss = "kind = 'CPL' OR (kind = 'TDM' AND abs(m) <= abs(n))"
    s = "if(b_dir = 1, 1, -1)"
    project = lambda base, share, length: f"CAST(bround({base} {share} * ({length}), 0) AS BIGINT)"
    p, q = "CAST(abs(n) AS DOUBLE) / nullif(abs(b_end - b_start), 0)", "CAST(abs(n) AS DOUBLE) / nullif(abs(nbe - nb), 0)"
    u, v = "CAST(abs(m) AS DOUBLE) / nullif(a_end - a_start, 0)", "CAST(abs(m) AS DOUBLE) / nullif(nae - na, 0)"
    return rows.select(
        block, "kind", "m", "n",
        F.expr(f"CASE WHEN {loss} THEN {project('a_end -', p, 'a_end - a_start')} WHEN {gain} THEN na WHEN kind = 'INS' THEN a_end ELSE a_end + 1 END").alias("sv_a_start"),
        F.expr(f"CASE WHEN {loss} THEN {project('na +', q, 'nae - na')} WHEN {gain} THEN a_end WHEN kind = 'INS' THEN a_end ELSE na - 1 END").alias("sv_a_end"),
        F.expr(f"CASE WHEN {loss} THEN nb WHEN {gain} THEN {project('b_end -', u, 'b_end - b_start')} WHEN kind = 'DEL' THEN b_end ELSE b_end + {s} END").alias("sv_b_start"),
        F.expr(f"CASE WHEN {loss} THEN b_end WHEN {gain} THEN {project('nb +', v, 'nbe - nb')} WHEN kind = 'DEL' THEN b_end ELSE nb - {s} END").alias("sv_b_end"),
    )


def cigar_offsets(rows: DataFrame) -> DataFrame:
    """A row per operation of a CIGAR: (aln_id, ..., k, op, len, pa, pb) with the bases before it on both genomes.

    ``rows`` has a unique aln_id and ops. Offsets are summed by a window over an alignment's operations.
    """
    rows = rows.select(*[c for c in rows.columns if c != "ops"], F.posexplode("ops").alias("k", "x")).select("*", "x.op", "x.len").drop("x")
    before = Window.partitionBy("aln_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("len")).otherwise(0)).over(before), F.lit(0))
    return rows.withColumn("pa", total(("=", "X", "D"))).withColumn("pb", total(("=", "X", "I")))


def explode_cigar(rows: DataFrame) -> DataFrame:
    """A row per base of X, I and D, with positions on both axes; ``rows`` has (aln_id, a_start, b_start, b_dir, ops)."""
    ops = cigar_offsets(rows.select("aln_id", "a_start", "b_start", "b_dir", "ops")).where("op IN ('X', 'I', 'D')")
    each = ops.select("*", F.explode(F.expr("sequence(0L, len - 1)")).alias("j"))
    return each.select(
        "aln_id", "op",
        F.expr("a_start + pa + CASE WHEN op = 'I' THEN -1 ELSE j END").alias("a_pos"),
        F.expr("b_start + b_dir * (pb + CASE WHEN op = 'D' THEN -1 ELSE j END)").alias("b_pos"),
    )


def cigar_variants(rows: DataFrame, a_genome: DataFrame, b_genome: DataFrame) -> DataFrame:
    """(aln_id, a_pos, a_base, b_base, b_pos, b_dir, a_chr, b_chr) of each differing base, '.' where a genome has none.

    ``rows`` has (aln_id, a_chr, b_chr, a_start, b_start, b_dir, ops), genomes are chunks of read_fasta_chunks(). Bases of
    a reverse alignment's query are complements.
    """
    spans = explode_cigar(rows).join(rows.select("aln_id", "a_chr", "b_chr", "b_dir"), "aln_id")
    a = bases_at(spans, a_genome, "a_chr", "a_pos", "_a")
    both = bases_at(a, b_genome, "b_chr", "b_pos", "_b")
    b_base = F.when(F.col("b_dir") == 1, F.col("_b")).otherwise(reverse_complement(F.col("_b")))
    return both.select("aln_id", "a_pos", F.when(F.col("op") == "I", ".").otherwise(F.col("_a")).alias("a_base"), F.when(F.col("op") == "D", ".").otherwise(b_base).alias("b_base"), "b_pos", "b_dir", "a_chr", "b_chr")


def bases_at(rows: DataFrame, genome: DataFrame, chr_: str, pos: str, name: str) -> DataFrame:
    """``rows`` with the base at a position, null where the genome has none; ``genome`` has (chr, begin, seq) chunks of one size.

    Chunks are joined by chromosome and place, so that no chromosome is in one row.
    """
    size = chunk_size(genome)
    chunks = genome.select(F.col("chr").alias("_chr"), F.floor((F.col("begin") - 1) / size).alias("_chunk"), F.col("begin").alias("_begin"), F.encode("seq", "UTF-8").alias("_seq"))
    rows = rows.withColumn("_at", F.floor((F.col(pos) - 1) / size))
    found = rows.join(chunks, (F.col(chr_) == F.col("_chr")) & (F.col("_at") == F.col("_chunk")), "left")
    base = F.decode(F.substring("_seq", (F.col(pos) - F.col("_begin") + 1).cast("int"), F.lit(1)), "UTF-8")
    return found.withColumn(name, F.when(F.length(base) == 1, base)).drop("_chr", "_chunk", "_begin", "_seq", "_at")


def chunk_size(genome: DataFrame) -> int:
    """Bases of a genome's chunks: the place of the second chunk tells it; a genome of single chunks may have any size."""
    second = genome.where("begin > 1").agg(F.min("begin")).first()[0]
    return int(second) - 1 if second else 1 << 62


def sequences_of(rows: DataFrame, genome: DataFrame, id_: str, chr_: str, start: str, end: str, name: str) -> DataFrame:
    """(id, sequence) of closed regions, put together from the chunks that they reach into."""
    size = chunk_size(genome)
    chunks = genome.select(F.col("chr").alias("_chr"), F.floor((F.col("begin") - 1) / size).alias("_chunk"), F.col("begin").alias("_begin"), F.encode("seq", "UTF-8").alias("_seq"))
    parts = rows.select(F.col(id_).alias("_id"), F.col(chr_).alias("_on"), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_s <= _e")
    parts = parts.withColumn("_at", F.explode(F.sequence(F.floor((F.col("_s") - 1) / size), F.floor((F.col("_e") - 1) / size))))
    held = parts.join(chunks, (F.col("_on") == F.col("_chr")) & (F.col("_at") == F.col("_chunk")))
    first = F.greatest(F.col("_s") - F.col("_begin") + 1, F.lit(1))
    piece = F.substring("_seq", first.cast("int"), (F.col("_e") - F.col("_begin") - first + 2).cast("int"))
    held = held.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_at", F.decode(piece, "UTF-8").alias("s")))).alias("p"))
    return held.select(F.col("_id").alias(id_), F.array_join(F.col("p")["s"], "").alias(name))


def with_sequences(sv: DataFrame, a_genome: DataFrame, b_genome: DataFrame, id_: str = "id") -> DataFrame:
    """Structural variants (id, kind, a_chr, a_start, ..., b_dir) with a_seq and b_seq, null as '-': deletions have A's bases,
    insertions B's, diverged regions both; B's are complements on the reverse strand."""
    a = sequences_of(sv.where("kind IN ('DEL', 'HDR', 'SNP')"), a_genome, id_, "a_chr", "a_start", "a_end", "a_seq")
    turned = sv.where("kind IN ('INS', 'HDR', 'SNP')").withColumn("_low", F.least("b_start", "b_end")).withColumn("_high", F.greatest("b_start", "b_end"))
    b = sequences_of(turned, b_genome, id_, "b_chr", "_low", "_high", "_b")
    out = sv.join(a, id_, "left").join(b, id_, "left")
    return out.withColumn("b_seq", F.when(F.col("b_dir") == 1, F.col("_b")).otherwise(reverse_complement(F.col("_b")))).drop("_b")


def anchored(v: DataFrame, a_genome: DataFrame) -> DataFrame:
    """Variants as a VCF wants them: an insertion, deletion or diverged region begins with the reference base before it.

    ``v`` has (kind, a_chr, a_start, a_end, b_start, b_end, a_seq, b_seq, b_dir). An insertion's base is the one at
    a_start, the others' is the one before; their a_start moves there. B coordinates take in the base on their side; on
    the reverse strand they are turned round, but for deletions.
    """
    v = v.withColumn("_pos", F.when(F.col("kind") == "INS", F.col("a_start")).otherwise(F.col("a_start") - 1))
    v = bases_at(v, a_genome, "a_chr", "_pos", "_base")
    grown, moved = F.col("kind").isin("INS", "DEL", "HDR"), F.col("kind").isin("INS", "HDR")
    forward = F.col("b_dir") == 1
    b_start = F.when(moved & forward, F.col("b_start") - 1).when(moved, F.col("b_end")).otherwise(F.col("b_start"))
    b_end = F.when(moved & ~forward, F.col("b_start") + 1).otherwise(F.col("b_end"))
    new = {
        "a_seq": F.when(F.col("kind") == "INS", F.col("_base")).when(grown, F.concat("_base", "a_seq")).otherwise(F.col("a_seq")),
        "b_seq": F.when(F.col("kind") == "DEL", F.col("_base")).when(grown, F.concat("_base", "b_seq")).otherwise(F.col("b_seq")),
        "a_start": F.when(F.col("kind").isin("DEL", "HDR"), F.col("a_start") - 1).otherwise(F.col("a_start")),
        "b_start": b_start,
        "b_end": b_end,
    }
    return v.withColumns(new).drop("_pos", "_base")


def indel_runs(bases: DataFrame, by: str = "aln_id") -> DataFrame:
    """Insertions and deletions of single bases joined to runs, from (by, op, a_pos, b_pos) as explode_cigar() gives them.

    An insertion goes on at the same place of A with the next base of B, a deletion the other way round. The last run
    counts like others.
    """
    w = Window.partitionBy(by, "op").orderBy("a_pos", "b_pos")
    rows = bases.where("op <> 'X'").withColumn("_d", F.when(F.col("op") == "D", F.col("b_pos")).otherwise(F.col("a_pos"))).withColumn("_g", F.when(F.col("op") == "D", F.col("a_pos")).otherwise(F.col("b_pos")))
    w = Window.partitionBy(by, "op", "_d").orderBy("_g")
    rows = rows.withColumn("_run", F.col("_g") - F.row_number().over(w))  # the same for bases that follow each other
    return rows.groupBy(by, "op", "_d", "_run").agg(F.min("a_pos").alias("a_from"), F.max("a_pos").alias("a_to"), F.min("b_pos").alias("b_from"), F.max("b_pos").alias("b_to"), F.count("*").alias("n")).drop("_d", "_run")


def several(v: DataFrame) -> DataFrame:
    """(chrom, pos) at which a table has more than one distinct variant; alleles are compared in upper case."""
    return v.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct().groupBy("chrom", "pos").count().where("count > 1").select("chrom", "pos")


def single_positions(v: DataFrame) -> DataFrame:
    """Variants at positions that have one distinct variant only."""
    v = v.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct()
    return v.join(several(v), ["chrom", "pos"], "left_anti")


def merge_haplotypes(one: DataFrame, two: DataFrame) -> DataFrame:
    """Variants of two haplotypes by position, with genotypes; the shorter of two REFs is extended, or the row dropped.

    Positions where either table has several variants are left out of both; chromosomes are those of the first table.
    """
    bad = several(one).unionByName(several(two)).distinct()
    clean = lambda d: d.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).distinct().join(bad, ["chrom", "pos"], "left_anti")
    l, r = (clean(d).select("chrom", "pos", F.col("ref").alias(f"ref{k}"), F.col("alt").alias(f"alt{k}")) for k, d in ((1, one), (2, two)))
    both = l.join(r.join(one.select("chrom").distinct(), "chrom", "left_semi"), ["chrom", "pos"], "full_outer")
    ref = F.expr("CASE WHEN ref2 IS NULL OR length(ref1) >= length(ref2) THEN ref1 ELSE ref2 END")
    grown = lambda k: F.concat(f"alt{k}", F.expr(f"substring(ref, length(ref{k}) + 1)"))
    both = both.withColumn("ref", ref).where("ref1 IS NULL OR ref2 IS NULL OR ref1 = ref2 OR (length(ref1) <> length(ref2) AND (startswith(ref1, ref2) OR startswith(ref2, ref1)))")
    both = both.withColumn("x", grown(1)).withColumn("y", grown(2))
    # the same allele is one only where both had the same REF
    same = "ref1 = ref2 AND alt1 = alt2"
    gt = F.expr(f"CASE WHEN y IS NULL THEN '1|0' WHEN x IS NULL THEN '0|1' WHEN {same} THEN '1|1' ELSE '1|2' END")
    return both.select("chrom", "pos", "ref", F.expr(f"CASE WHEN x IS NULL THEN y WHEN y IS NULL OR {same} THEN x ELSE concat(x, ',', y) END").alias("alts"), gt.alias("gt"))


def indel_size_filter(v: DataFrame, least: int, most: int) -> DataFrame:
    """Keeps substitutions of one base by one other, and variants whose alleles all have a length in the range."""
    return v.where(f"(length(ref) = 1 AND size(alts) = 1 AND length(alts[0]) = 1) OR (length(ref) BETWEEN {least} AND {most} AND forall(alts, a -> length(a) BETWEEN {least} AND {most}))")


#: The summary's rows: label, the text that names it, whether it counts bases of the reference and of the query.
SUMMARY = (
    ("SYN", "Syntenic regions", True, True),
    ("INV", "Inversions", True, True),
    ("TRANS", "Translocations", True, True),
    ("DUPA", "Duplications (reference)", True, False),
    ("DUPB", "Duplications (query)", False, True),
    ("NOTALR", "Not aligned (reference)", True, False),
    ("NOTALQ", "Not aligned (query)", False, True),
    ("SNP", "SNPs", True, True),
    ("INS", "Insertions", False, True),
    ("DEL", "Deletions", True, False),
    ("CPG", "Copygains", False, True),
    ("CPL", "Copylosses", True, False),
    ("HDR", "Highly diverged", True, True),
    ("TDM", "Tandem repeats", True, True),
)


def summary(events: DataFrame) -> DataFrame:
    """(place, label, n, length_ref, length_qry): a row for each of the 14 labels, in order, counted from (kind, dupclass, coordinates).

    Lengths that a label does not count are null. Insertions and deletions include their anchor base, so that their
    lengths have no + 1. A region that is not aligned has null coordinates on one side.
    """
    spark = events.sparkSession
    a, b = (F.abs(F.col(f"{s}_end") - F.col(f"{s}_start")) + F.when(F.col("kind").isin("INS", "DEL"), 0).otherwise(1) for s in ("a", "b"))
    label = F.expr("""CASE WHEN kind IN ('TRANS', 'INVTR') THEN 'TRANS' WHEN kind IN ('DUP', 'INVDP') THEN CASE dupclass WHEN 'copyloss' THEN 'DUPA' WHEN 'copygain' THEN 'DUPB' END
                           WHEN kind = 'NOTAL' THEN if(a_start IS NULL, 'NOTALQ', 'NOTALR') ELSE kind END""")
    sums = events.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum(a).alias("ref"), F.sum(b).alias("qry"))
    every = spark.createDataFrame([(k, *r[:1], r[2], r[3]) for k, r in enumerate(SUMMARY)], "place int, label string, in_ref boolean, in_qry boolean")
    out = every.join(sums, "label", "left")
    return out.select("place", "label", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("in_ref"), F.coalesce("ref", F.lit(0))).alias("length_ref"), F.when(F.col("in_qry"), F.coalesce("qry", F.lit(0))).alias("length_qry"))


#: Names of rearrangements by class and orientation.
NAMES = {"syn": "SYN", "inv": "INV", "TL": "TRANS", "invTL": "INVTR", "dup": "DUP", "invDup": "INVDP"}


def named_blocks(blocks: DataFrame, alignments: DataFrame) -> DataFrame:
    """Blocks and their alignments as output rows with ids and parents, from (block, class, copies) and (block, coordinates).

    Blocks are numbered over all classes in the order of class and coordinates (SYN1, SYN2, INV3, ...), alignments as
    SYNAL1 and so on in the order of their blocks. ``copies`` 'B' is a copygain, other duplications are copylosses. Numbers
    are counted by ranges of the sorted rows, not in one task.
    """
    order = F.array_position(F.array(*map(F.lit, NAMES)), F.col("class"))
    kind = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("class")]
    blocks = numbered(blocks.withColumn("_o", order).withColumn("kind", kind), ["_o", "a_chr", "a_start", "a_end", "b_chr", "b_start", "b_end", "block"], "number")
    copies = F.when(F.col("class").isin("dup", "invDup"), F.when(F.col("copies") == "B", "copygain").otherwise("copyloss"))
    events = blocks.select("block", "number", "a_chr", "a_start", "a_end", "b_chr", "b_start", "b_end", F.concat("kind", "number").alias("id"), F.lit(None).cast("string").alias("parent"), "kind", copies.alias("dupclass"))
    own = alignments.join(events.select("block", "number", F.col("id").alias("parent"), "kind"), "block")
    own = numbered(own, ["number", "a_start", "a_end", "b_start", "b_end"], "place")
    own = own.select("block", "number", "a_chr", "a_start", "a_end", "b_chr", "b_start", "b_end", F.concat("kind", F.lit("AL"), "place").alias("id"), "parent", F.concat("kind", F.lit("AL")).alias("kind"), F.lit(None).cast("string").alias("dupclass"))
    return events.unionByName(own).drop("number")


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Adds places from ``first`` in the order of columns: rows are sorted over ranges, and each range begins where those before it end."""
    rows = rows.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    rows = checkpointed(rows)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_in").alias("_first"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_in") - F.col("_first") + F.col("_before") + first).drop("_part", "_in", "_n", "_first", "_before")
