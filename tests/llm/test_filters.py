import numpy as np

from karyoframe.llm import common, jaccard


def plans(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_lets_all_ids_through_and_few_others(spark):
    ids = common.cut(spark.range(0, 60_000, 3).select("id"))
    rows = spark.range(60_000).selectExpr("id AS doc_id", "'x' AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, 'y' AS text"))
    got = common.told(rows, "doc_id", ids, "open").where("open").select("doc_id").toPandas()["doc_id"].to_numpy()
    assert np.isin(np.arange(0, 60_000, 3), got).all() and len(got) < 20_000 + 0.02 * 40_000
    assert common.told(rows, "doc_id", ids.where("id < 0"), "open").where("open").count() == 0


def test_without_is_exact(spark):
    ids = common.cut(spark.range(0, 60_000, 3).select("id"))
    rows = spark.range(60_000).selectExpr("id AS _key", "'x' AS text").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS _key, 'y' AS text"))
    left = common.without(rows, "_key", ids)
    assert left.columns == ["_key", "text"]
    got = sorted(-1 if r[0] is None else r[0] for r in left.select("_key").collect())
    assert got == [-1, *(k for k in range(60_000) if k % 3)]
    assert common.without(rows, "_key", ids.where("id < 0")).count() == 60_001


def test_no_ids_are_broadcast(spark, monkeypatch):
    """Rows that grow with the table don't pass through the driver: only the filter, 2 bytes an id, is broadcast."""
    sent = []
    broadcast = common.F.broadcast
    monkeypatch.setattr(common.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('every text has words of its own ', id div 2, ' and ', id div 2, ' more ', id div 2) AS text")
    assert jaccard.without_near_copies(docs).count() == 1500
    # 1,500 open ids and 1,500 removed rows: tables of a filter have a row for 2,048 ids, the others are hubs and rows in doubt
    assert sent and max(df.count() for df in sent) < 100
