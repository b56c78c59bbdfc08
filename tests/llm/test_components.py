import random

from karyoframe.llm import common
from karyoframe.llm.common import components


def test_chain_of_a_thousand_with_random_ids(spark):
    rnd = random.Random(1)
    ids = [rnd.getrandbits(63) - (1 << 62) for _ in range(1002)]
    edges = list(zip(ids[:1000], ids[1:1000])) + [(ids[1000], ids[1001])]
    got = {r.id: r.root for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(ids[:1000], min(ids[:1000])), **dict.fromkeys(ids[1000:1002], min(ids[1000:1002]))}


def test_driver_and_rounds_agree(spark, monkeypatch):
    rnd = random.Random(2)
    edges = [(rnd.randrange(-400, 400), rnd.randrange(-400, 400)) for _ in range(450)] + [(5, 5), (9001, 9001), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    by_driver = sorted(map(tuple, components(spark, df).collect()))
    assert components(spark, df.where("a = 9001")).columns == ["id", "root"] and not components(spark, df.where("a = 9001")).count()
    monkeypatch.setattr(common, "DRIVER_EDGES", 0)
    assert by_driver == sorted(map(tuple, components(spark, df).collect())) and len(by_driver) > 400


def test_few_edges_take_few_jobs(spark):
    """Rounds over few edges left more in event logs and small files than all rows take."""
    df = common.cut(spark.range(500).selectExpr("id AS a", "id + 1 AS b"))
    spark.sparkContext.setJobGroup("few-edges", "few edges")
    try:
        assert components(spark, df).where("root <> 0").count() == 0
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-edges")) <= 5
