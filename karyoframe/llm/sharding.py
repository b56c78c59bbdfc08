"""Shards that each match the mixture of sources: proportional stratified interleaving.

Rows are put into a seeded order within each source; a row of place r among n gets the fraction (r + 1/2) / n. Sorted by
this fraction all sources advance in step, so that any run of rows holds each source in proportion; shards are equal
cuts of that order. Both orders are counted in ranges of bounded size (see ranked()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hex_unit, ranked, smaller


def shard_rows(docs: DataFrame, shards: int = 40, seed: str = "17", per_task: int = 2_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs`` (doc_id, text, source).

    The law is ``rows``: shards differ by one row at most; slot counts a shard's rows from 0; grown_shard is null, as
    another number of shards cuts anew. size is the text's UTF-8 bytes plus 16; a null text counts as no bytes. Rows
    without a source are a source of their own. Rows are told apart by doc_id, size and checksum; those that agree in
    all of these are interchangeable, and where there are more than ``per_task`` of them each gets one of several keys,
    so that no key is hot. Equal texts of different ids may lie in different shards. An empty table gives no rows; other
    columns are not read.
    """
    text = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = cut(rows)
    same = ["doc_id", "size", "text_crc32"]
    hot = cut(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > per_task))
    hot = smaller(hot.select(*[F.col(c).alias(f"_{c}") for c in same], F.ceil(F.col("_n") / per_task).alias("_parts")))
    rows = rows.join(hot, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same], "left")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_parts"))).otherwise(0)
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32", part]
    rows = cut(rows.withColumn("_key", hex_unit(F.md5(F.concat_ws(":", F.lit(seed), *parts)))).select(*same, "source", "_key"))
    total = rows.count()
    ties = ["doc_id", "size", "text_crc32"]
    within = ranked(rows, ["source"], "_key", ties, "_place", per_task)
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_of")).withColumnRenamed("source", "_source")
    within = within.join(sizes, F.col("source").eqNullSafe(F.col("_source")))
    within = cut(within.select("doc_id", "size", "text_crc32", "source", "_key", ((F.col("_place") + 0.5) / F.col("_of")).alias("_fraction")))
    order = ranked(within, [], "_fraction", ["_key", "source", *ties], "_at", per_task)
    shard = F.expr(f"_at * {shards} div {max(total, 1)}")
    # shard s begins at the least place with place * shards >= s * total
    begin = F.expr(f"(shard * {total} + {shards} - 1) div {shards}")
    return order.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_at") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
