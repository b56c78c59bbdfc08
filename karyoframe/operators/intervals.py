"""Interval algebra on closed 1-based integer intervals.

Running totals along a chromosome are counted in cells of ``CELL`` bases: within each cell by a window, and between cells
by a window over one row per cell, so that no chromosome is one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bases of a chromosome that one window task takes.
CELL = 1 << 22
#: Ends that may differ by less count as equal.
THRESHOLD = 50


def quality_filter(aln: DataFrame) -> DataFrame:
    return aln.where("iden100 > 9000 and ln > 100 and b_len > 100")


def normalise_reverse(aln: DataFrame) -> DataFrame:
    """b_low and b_high in ascending order whatever the strand."""
    return aln.withColumn("b_low", F.least("b_start", "b_end")).withColumn("b_high", F.greatest("b_start", "b_end"))


def mirror_b(aln: DataFrame, by: list[str]) -> DataFrame:
    """The B axis turned around within each group."""
    top = aln.groupBy(*by).agg((F.max(F.greatest("b_start", "b_end")) + 1).alias("_top"))
    return aln.join(top, by).withColumn("m_start", F.col("_top") - F.col("b_start")).withColumn("m_end", F.col("_top") - F.col("b_end")).drop("_top")


def furthest_before(rows: DataFrame, by: list[str], start: str, order: list[str], value: Column, name: str, itself: bool = False) -> DataFrame:
    """Adds the greatest ``value`` of the rows before (and of the row, with ``itself``) in the order of ``start`` and ``order``."""
    rows = rows.withColumn("_value", value).withColumn("_cell", F.floor(F.col(start) / CELL))
    cells = rows.groupBy(*by, "_cell").agg(F.max("_value").alias("_top"))
    cells = cells.withColumn("_carried", F.max("_top").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy(*by, "_cell").orderBy(start, *order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    rows = rows.join(cells.drop("_top"), [*by, "_cell"]).withColumn("_inside", F.max("_value").over(within))
    return rows.withColumn(name, F.greatest("_carried", "_inside")).drop("_value", "_cell", "_carried", "_inside")


def islands(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", name: str = "island") -> DataFrame:
    """Adds the first coordinate of the union that each interval belongs to; those that touch at a coordinate are one."""
    rows = furthest_before(rows, by, start, [end], F.col(end), "_before")
    fresh = F.when(F.col("_before").isNull() | (F.col(start) > F.col("_before")), F.col(start))
    return furthest_before(rows, by, start, [end], fresh, name, itself=True).drop("_before")


def merge_ranges(rows: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of intervals that overlap or touch at a coordinate."""
    rows = islands(rows.select(*by, start, end), by, start, end, "_island")
    return rows.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def covered_length(rows: DataFrame, by: list[str], start: str = "start", end: str = "end", plus: int = 1) -> DataFrame:
    """Lengths of the unions; with ``plus`` 0 as differences of their ends, as the scaffolder counts."""
    return merge_ranges(rows, by, start, end).groupBy(*by).agg(F.sum(F.col(end) - F.col(start) + plus).alias("covered"))


def uncovered(rows: DataFrame, sizes: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """Gaps before, between and behind the intervals of each chromosome that has any; ``sizes`` has (by, size)."""
    top = furthest_before(rows.select(by, start, end), [by], start, [end], F.col(end), "_top")
    gaps = top.select(by, (F.coalesce("_top", F.lit(0)) + 1).alias("gap_start"), (F.col(start) - 1).alias("gap_end"))
    ends = rows.groupBy(by).agg(F.max(end).alias("_top")).join(sizes, by).select(by, (F.col("_top") + 1).alias("gap_start"), F.col("size").alias("gap_end"))
    return gaps.unionByName(ends).where("gap_start <= gap_end")


def not_aligned(blocks: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame) -> DataFrame:
    """(genome R or Q, chr, start, end): what no block covers on either genome; sizes have (chr, size)."""
    b = normalise_reverse(blocks)
    sides = (("R", "a_chr", "a_start", "a_end", a_sizes), ("Q", "b_chr", "b_low", "b_high", b_sizes))
    found = [uncovered(b.select(F.col(c).alias("chr"), F.col(s).alias("start"), F.col(e).alias("end")), sizes, "chr").select(F.lit(g).alias("genome"), "chr", F.col("gap_start").alias("start"), F.col("gap_end").alias("end")) for g, c, s, e, sizes in sides]
    return found[0].unionByName(found[1])


def overlap_join(left: DataFrame, right: DataFrame, chr_: str, size: int, closed: bool = True) -> DataFrame:
    """Pairs of (l_id, l_start, l_end) and (r_id, r_start, r_end) that overlap, by bins of ``size``.

    Without ``closed`` intervals that only touch at a coordinate don't. A pair is kept in one bin only, the later of the
    first bins of both, so that nothing need be made distinct.
    """
    bins = lambda d, p: d.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / size), F.floor(F.col(f"{p}_end") / size))))
    pairs = bins(left, "l").join(bins(right, "r"), [chr_, "_bin"])
    test = "l_start <= r_end and r_start <= l_end" if closed else "l_start < r_end and r_start < l_end"
    return pairs.where(f"{test} and _bin = floor(greatest(l_start, r_start) / {size})").drop("_bin")


def majority_per_bin(rows: DataFrame, by: str, partner: str, size: int, start: str = "start", end: str = "end") -> DataFrame:
    """For each bin from a multiple of ``size`` to the next the partner whose merged intervals hold most of it, ends excluded; ties go to the first name."""
    merged = merge_ranges(rows, [by, partner], start, end).where(F.floor(F.col(start) / size) <= F.floor((F.col(end) - 1) / size))
    merged = merged.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))))
    part = F.least(F.col(end), (F.col("bin") + 1) * size) - F.greatest(F.col(start), F.col("bin") * size)
    sums = merged.groupBy(by, "bin", partner).agg(F.sum(part).alias("held"))
    best = sums.groupBy(by, "bin").agg(F.min(F.struct((-F.col("held")).alias("h"), F.col(partner).alias("p"))).alias("x"))
    return best.select(by, "bin", F.col("x.p").alias(partner), (-F.col("x.h")).alias("held"))


def sliding_majority(bins: DataFrame, by: str, partner: str, width: int = 5, least: int = 3, most_bins: int = 50) -> DataFrame:
    """Partners that hold ``least`` of some ``width`` successive bins; all partners of what has ``most_bins`` bins or fewer.

    Windows begin at bin 0 and end within as many bins as have a partner at all.
    """
    sizes = bins.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    bins = bins.join(sizes, by)
    begin = F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - (width - 1)), F.least(F.col("bin"), F.col("_n") - width)))
    long = bins.where(F.col("_n") > most_bins).where(F.greatest(F.lit(0), F.col("bin") - (width - 1)) <= F.col("_n") - width)
    seen = long.select(by, partner, begin.alias("_at")).groupBy(by, partner, "_at").count().where(f"count >= {least}").select(by, partner)
    return seen.unionByName(bins.where(F.col("_n") <= most_bins).select(by, partner)).distinct()


def strand_majority(aln: DataFrame, by: list[str], start: str = "a_start", end: str = "a_end") -> DataFrame:
    """1 where the merged forward length is at least the merged reverse length, else -1."""
    both = covered_length(aln, [*by, "b_dir"], start, end, plus=0)
    total = lambda d: F.sum(F.when(F.col("b_dir") == d, F.col("covered")).otherwise(0))
    return both.groupBy(*by).agg(F.when(total(1) >= total(-1), 1).otherwise(-1).alias("strand"))


def best_partner(aln: DataFrame) -> DataFrame:
    """For each reference chromosome the query chromosome that covers most of it; ties go to the first name."""
    cover = covered_length(aln, ["a_chr", "b_chr"], "a_start", "a_end")
    best = cover.groupBy("a_chr").agg(F.min(F.struct((-F.col("covered")).alias("c"), "b_chr")).alias("x"))
    return best.select("a_chr", F.col("x.b_chr").alias("b_chr"), (-F.col("x.c")).alias("covered"))


def _overlapped(rows: DataFrame, in_place: DataFrame, chr_: str, start: str, end: str, id_: str, size: int, closed: bool) -> DataFrame:
    """Each interval with the merged in-place intervals that it overlaps, ascending, as ``_in``."""
    merged = merge_ranges(in_place.select(F.col(chr_).alias("_chr"), F.col(start).alias("r_start"), F.col(end).alias("r_end")), ["_chr"], "r_start", "r_end")
    left = rows.select(F.col(id_).alias("l_id"), F.col(chr_).alias("_chr"), F.col(start).alias("l_start"), F.col(end).alias("l_end"))
    pairs = overlap_join(left, merged, "_chr", size, closed)
    held = pairs.groupBy("l_id").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start").alias("s"), F.col("r_end").alias("e")))).alias("_in"))
    return left.join(held, "l_id", "left").withColumn("_in", F.coalesce("_in", F.expr("CAST(array() AS array<struct<s:bigint,e:bigint>>)")))


def unique_test(rows: DataFrame, in_place: DataFrame, chr_: str, start: str, end: str, id_: str, name: str, most: int = 1000, percent: int = 50, least: int = THRESHOLD, size: int = 1 << 16) -> DataFrame:
    """(id, bases that no in-place interval covers, whether they are more than ``most`` or than ``percent`` % of the length).

    In-place intervals are merged first and taken in order. One that reaches to within ``least`` of both ends of what is
    left ends the count, and nothing more is added.
    """
    held = _overlapped(rows, in_place, chr_, start, end, id_, size, closed=False)
    fold = F.expr(f"""
        aggregate(_in, named_struct('s', l_start, 'n', 0L, 'done', false), (a, x) -> CASE
          WHEN a.done THEN a
          WHEN x.s - a.s < {least} AND l_end - x.e < {least} THEN named_struct('s', l_end, 'n', a.n, 'done', true)
          WHEN x.s < a.s AND x.e < l_end THEN named_struct('s', x.e, 'n', a.n, 'done', false)
          ELSE named_struct('s', least(x.e, l_end), 'n', a.n + x.s - a.s, 'done', x.e >= l_end) END, a -> a.n + l_end - a.s)""")
    held = held.withColumn(f"{name}_bp", fold)
    uni = (F.col(f"{name}_bp") > most) | (100 * F.col(f"{name}_bp") > percent * (F.col("l_end") - F.col("l_start")))
    return held.select(F.col("l_id").alias(id_), f"{name}_bp", uni.alias(name))


def free_bases(rows: DataFrame, in_place: DataFrame, chr_: str, start: str, end: str, id_: str, name: str, size: int = 1 << 16) -> DataFrame:
    """(id, bases of the closed interval that no in-place interval covers)."""
    held = _overlapped(rows, in_place, chr_, start, end, id_, size, closed=True)
    taken = F.expr("aggregate(_in, 0L, (a, x) -> a + least(x.e, l_end) - greatest(x.s, l_start) + 1)")
    return held.select(F.col("l_id").alias(id_), (F.col("l_end") - F.col("l_start") + 1 - taken).alias(name))


def union_length(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Lengths of intervals less the overlaps of neighbours in order of start; of a nested one only its own length is taken away."""
    w = Window.partitionBy(*by).orderBy(start, end)
    last = F.lag(end).over(w)
    rows = rows.withColumn("_gap", F.least(F.col(start) - last, F.lit(0))).withColumn("_over", F.greatest(last - F.col(end), F.lit(0)))
    total = F.sum(F.col(end) - F.col(start)) + F.sum(F.coalesce("_gap", F.lit(0))) + F.sum(F.coalesce("_over", F.lit(0)))
    return rows.groupBy(*by).agg(total.alias("bp"))


def overlap_groups(rows: DataFrame, chr_: str, start: str, end: str, id_: str, least: int = THRESHOLD) -> DataFrame:
    """(id, grp): intervals in order, each joined to the last group if it ends within it, or lies mostly in it or beside its begin.

    A group is named by the id of its first interval. Intervals of different unions never share a group, so that each
    union is folded by itself.
    """
    rows = islands(rows.select(F.col(id_).alias("id"), F.col(chr_).alias("chr"), F.col(start).alias("s"), F.col(end).alias("e")), ["chr"], "s", "e")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["chr", "island", "s", "e", "id"], ignore_index=True)
        names, left, right, first, on = [], 0, -1, None, None
        for c, s, e, i in zip(*(pdf[k].tolist() for k in ("chr", "s", "e", "id"))):
            shared = right - s
            if c != on:
                on, first = c, None
            if first is None or s > right or not (e < right + least or 2 * (e - right) < shared or 2 * (s - left) < shared):
                left, right, first = s, e, i
            else:
                right = max(right, e)
            names.append(first)
        return pd.DataFrame({"id": pdf["id"], "grp": names})

    # many unions are small: they are dealt out to a few tasks a core, never more than a union at a time in one fold
    deals = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64("chr", "island"), F.lit(deals)))
    return rows.groupBy("_deal").applyInPandas(fold, "id long, grp long").withColumnRenamed("id", id_)


def density(bed: DataFrame, sizes: DataFrame, width: int = 100_000) -> DataFrame:
    """(chr, middle, covered, density) of each bin of ``width`` bases: bases that the half-open ranges of ``bed`` cover; sizes have (chr, size).

    Only chromosomes that ``bed`` has are counted; the last bin ends with the chromosome. ``density`` is for each base of
    a full bin. ``middle`` is doubled, so that it is whole.
    """
    merged = merge_ranges(bed.select("chr", "start", "end"), ["chr"]).where("end > start")
    parts = merged.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    held = parts.groupBy("chr", "bin").agg(F.sum(F.least("end", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width)).alias("covered"))
    bins = sizes.join(bed.select("chr").distinct(), "chr").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width))))
    every = bins.join(held, ["chr", "bin"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    middle2 = F.col("bin") * width + F.least((F.col("bin") + 1) * width, F.col("size"))
    return every.select("chr", middle2.cast("long").alias("middle2"), F.col("covered").cast("long"), (F.col("covered") / width).alias("density"))


def extents(rows: DataFrame, by: list[str]) -> DataFrame:
    """The least and greatest coordinates of each block's alignments on both genomes."""
    low, high = (lambda s: F.min(F.least(f"{s}_start", f"{s}_end"))), (lambda s: F.max(F.greatest(f"{s}_start", f"{s}_end")))
    return rows.groupBy(*by).agg(low("a").alias("a_start"), high("a").alias("a_end"), low("b").alias("b_start"), high("b").alias("b_end"))
