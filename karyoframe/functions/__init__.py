"""Scalar expressions on CIGARs, sequences and coordinates; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[=XIDSHMNP])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("long").alias("len"), F.substring(p, -1, 1).alias("op")))


def _span(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda a, x: a + x["len"])


def reference_span(ops: Column) -> Column:
    return _span(ops, ("=", "X", "D"))


def query_span(ops: Column) -> Column:
    return _span(ops, ("=", "X", "I"))


def identity_100(ops: Column) -> Column:
    """Hundredths of a percent of equal bases among all aligned and gapped ones, rounded half even."""
    return F.bround(10000 * _span(ops, ("=",)) / F.nullif(_span(ops, ("=", "X", "I", "D")), F.lit(0)), 0)


def valid_cigar(ops: Column) -> Column:
    """Only = X I D inside, clips at the ends only; a text that is no CIGAR as a whole gives no valid one, see whole_cigar()."""
    inner = F.when(F.size(ops) > 2, F.slice(ops, 2, F.greatest(F.size(ops) - 2, F.lit(1)))).otherwise(F.slice(ops, 1, 0))
    return (F.size(ops) > 0) & F.forall(ops, lambda x: x["op"].isin("=", "X", "I", "D", "H", "S")) & F.forall(inner, lambda x: x["op"].isin("=", "X", "I", "D"))


def whole_cigar(cigar: Column) -> Column:
    """Whether a text is a valid CIGAR without anything else in it."""
    return F.coalesce(cigar.rlike(r"^(?:\d+[=XIDHS])+$") & valid_cigar(cigar_ops(cigar)), F.lit(False))


def clip(ops: Column, last: bool = False) -> Column:
    """Bases clipped at the begin or at the end."""
    op = F.element_at(ops, -1 if last else 1)
    return F.when(op["op"].isin("H", "S"), op["len"]).otherwise(F.lit(0).cast("long"))


def is_reverse(flag: Column) -> Column:
    """Whether a SAM flag says that a record lies on the reverse strand."""
    return flag.bitwiseAND(16) != 0


#: IUPAC letters and the bases that stand for them in a VCF.
AMBIGUOUS, PLAIN = "RYSWKMBDHVryswkmbdhv", "ACCAGACAAAaccagacaaa"


def plain_bases(seq: Column) -> Column:
    return F.translate(seq, AMBIGUOUS, PLAIN)


def spaced(parts: Column, n: int) -> Column:
    """Sequences on end with ``n`` N between them."""
    return F.array_join(parts, "N" * n)


def wrapped(seq: Column, width: int = 64) -> Column:
    """A sequence in lines of ``width`` bases."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


#: IUPAC letters and their complements.
LETTERS, COMPLEMENTS = "ACGTRYKMBDHVacgtrykmbdhv", "TGCAYRMKVHDBtgcayrmkvhdb"


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def slice_1based(seq: Column, start: Column, end: Column) -> Column:
    return F.substring(seq, start.cast("int"), (end - start + 1).cast("int"))
