"""Pairs of alignments with a gap that holds many of them, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from karyoframe.operators import joins as jo

COLUMNS = "aln_id long, a_chr string, a_start long, a_end long, b_start long, b_end long"


def _slow(rows, gap, least=50):
    def follows(x, y):
        return x[1] == y[1] and all(y[k] - x[k] > least for k in (2, 3, 4, 5)) and y[2] - x[3] < gap and y[4] - x[5] < gap

    whole = [r for r in rows if None not in r[1:]]
    return sorted(((x[0], y[0]) for x in whole for y in whole if follows(x, y)), key=str)


@pytest.mark.parametrize("gap", [300, 4000, 10**9])
@pytest.mark.parametrize("pack", [1, 7, 256])
def test_wide_pairs_are_all_pairs(spark, gap, pack):
    rng, rows = random.Random(gap + pack), []
    for k in range(240):
        a, b = rng.randrange(8000), rng.randrange(8000)
        a, b = (500, 500) if k % 9 == 0 else (a, a + rng.randrange(-60, 60)) if k % 3 else (a, b)
        rows.append((k // 2 if k % 11 == 0 else k, f"c{k % 4 and 1}", a, a + rng.choice((1, 40, 900, 7000)), b, b + rng.choice((1, 40, 900, 7000))))
    rows += [rows[5], rows[5], (None, "c1", 10, 20, 10, 20), (900, None, 10, 20, 10, 20), (901, "c1", None, 20, 10, 20), (902, "c1", 10, 20, 10, None), (903, "c9", 10, 20, 10, 20)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = sorted(((r.i, r.j) for r in jo.wide_pairs(df, ["a_chr"], gap, pack=pack).collect()), key=str)
    assert got == _slow(rows, gap) and len(got) > 100
    assert got == sorted(((r.i, r.j) for r in jo.compatible_pairs(df, ["a_chr"], gap).collect()), key=str)


def test_wide_pairs_of_an_empty_table(spark):
    assert jo.wide_pairs(spark.createDataFrame([], COLUMNS), ["a_chr"], 10**9).collect() == []


def test_inversion_pairs_take_little_disk_and_many_tasks(spark, tmp_path):
    """One chromosome is not one task, and a pair takes far less than its 16 bytes when it is written."""
    from karyoframe import catalog_rearranged as cr

    spark.range(0, 75_000, 5).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    pairs = cr.inversion_pairs(spark, str(tmp_path))
    pairs.withColumn("task", F.spark_partition_id()).write.parquet(f"{tmp_path}/tasks")
    assert spark.read.parquet(f"{tmp_path}/tasks").select("task").distinct().count() > 2
    pairs.write.parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").distinct().count()
    assert n == 2250 * 2249 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < n / 2


def test_wide_pairs_are_made_as_they_are_taken(spark):
    """A pack's pairs with all packs of its cell are not held in memory: the first pair takes few others."""
    rows = spark.range(4000).selectExpr("id AS aln_id", "'c1' AS a_chr", "1000 * id AS a_start", "1000 * id + 500 AS a_end", "1000 * id AS b_start", "1000 * id + 500 AS b_end")
    assert len(jo.wide_pairs(rows, ["a_chr"], 10**9).limit(1).collect()) == 1
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsCount() - 1
    made, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    each = [n for n in map(nodes.apply, range(nodes.size())) if n.name().startswith("Generate")]
    found = [made.get(m.accumulatorId()) for n in each for m in map(n.metrics().apply, range(n.metrics().size())) if m.name() == "number of output rows"]
    counts = [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    assert counts and sum(counts) < 256 * 256
