"""What the operators of this subpackage share: tables, lineage cuts, bounded text batches, distributed ranks."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that may be broadcast when they hold no more than an id or a few numbers each: the driver's heap takes about 150 bytes a row meanwhile.
BROADCAST_ROWS = 500_000
#: Most edges whose components the driver finds by itself, in 16 bytes each, as rounds over so few cost more in tasks than in rows.
DRIVER_EDGES = 100_000
#: Words of 64 bits in a row of a filter's table.
WORDS = 512
#: Most bytes of an Arrow batch of texts; a row that has more is a batch of its own.
BATCH_BYTES = 8 << 20

_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as spark.checkpoint.dir names it.

    Where the session names none, a local master gets a folder of its own; on a cluster that is an error, since
    executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="karyoframe-")
        spark.sparkContext.setCheckpointDir(named)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows of a narrow frame, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of ``passing`` or else when the JVM ends."""
    path = f"{shared_dir(spark)}/karyoframe/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    held = _passing.get()
    if held is not None:
        held.append(path)
    return path


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What gets a scratch path meanwhile is deleted at the end: for frames that nothing reads later."""
    held: list[str] = []
    token = _passing.set(held)
    try:
        yield
    finally:
        _passing.reset(token)
        for path in held:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage: only then Spark deletes shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """The rows of a wide frame, written once as Parquet in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smaller(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised frame of ids, marked for broadcast if it is counted to be small enough."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def told(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``rows`` with the column ``flag``: true where ``key`` is among ``ids`` (one column, materialised), and for about one in 200 of the others.

    Four bits of one word stand for each id, 16 bits are held for each: a filter of 2 bytes an id goes through the driver, where
    a broadcast of the ids takes many times that, and wide rows need no shuffle.
    """
    own = free_prefix([*rows.columns, flag])
    chunks = ids.count() // (4 * WORDS) + 1

    def places(x: Column) -> tuple[Column, Column, Column]:
        bits = F.xxhash64(x, F.lit(1))
        mask = F.lit(0).cast("long")
        for k in range(4):
            at = F.shiftrightunsigned(bits, 9 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
        return F.pmod(F.xxhash64(x), F.lit(chunks)), bits.bitwiseAND(F.lit(WORDS - 1)), mask

    names = [f"{own}chunk", f"{own}word", f"{own}mask"]
    chunk, word, mask = names
    every = ids.sparkSession.range(chunks * WORDS).selectExpr(f"id div {WORDS}", f"id % {WORDS}", "0L").toDF(*names)
    held = ids.where(F.col(ids.columns[0]).isNotNull()).select(*places(F.col(ids.columns[0]))).toDF(*names).unionByName(every)
    held = held.groupBy(chunk, word).agg(F.bit_or(mask).alias(mask)).groupBy(chunk).agg(F.array_sort(F.collect_list(F.struct(word, mask)))[mask].alias(mask))
    at, here, bits = places(F.col(key))
    found = rows.join(F.broadcast(cut(held)), at == F.col(chunk))
    test = F.element_at(mask, (here + 1).cast("int")).bitwiseAND(bits) == bits
    return found.select(*rows.columns, (F.col(key).isNotNull() & test).alias(flag))


def without(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Exactly the rows whose ``key`` is not among ``ids`` (one column, materialised); whole rows are not shuffled, keys in doubt are."""
    own = free_prefix(rows.columns)
    marked = told(rows, key, ids, f"{own}in")
    doubt = marked.where(f"{own}in").select(F.col(key).alias(f"{own}key"))
    spared = cut(doubt.join(ids.toDF(f"{own}key"), f"{own}key", "left_anti").distinct())
    marked = marked.join(smaller(spared), F.col(key) == F.col(f"{own}key"), "left")
    return marked.where(f"NOT {own}in OR {own}key IS NOT NULL").select(*rows.columns)


def free_prefix(columns: list[str]) -> str:
    """A beginning of names that none of the columns has."""
    own = "_"
    while any(c.lower().startswith(own) for c in columns):
        own += "_"
    return own


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about ``most`` bytes of text; a longer text is a part of its own."""
    col, start, held = batch.column(text), 0, 0
    sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist() if len(batch) else []
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(batch):
        yield batch.slice(start)


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, with its session's Arrow batches held to BATCH_BYTES, unless the session has a lower bound."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system: Python workers keep it else while they wait."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, giving back what it freed after each result and at the end."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for result in run(batches):
            yield result
            give_back()
        give_back()

    return out


@contextlib.contextmanager
def without_gc() -> Iterator[None]:
    """No cycle collection meanwhile: for loops that fill large memos and make no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def ranked(df: DataFrame, group: list[str], key: str, ties: list[str], name: str, per_task: int = 2_000, ranges: int = 20_000) -> DataFrame:
    """Adds ``name``, each row's place from 0 among the rows of its group, by ``key`` and then ``ties``.

    ``key`` is a double from 0 (with it) to 1 (without it) whose values are spread evenly in each group. Each group is
    cut into ranges of the key of about ``per_task`` rows (larger ones beyond ``ranges`` ranges): places are counted within a range and the sizes of the ranges
    before it are added, so that no task gets a whole group however large it is. ``df`` should be cheap to read again.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]

    def joined(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
        right = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
        on = [left[c].eqNullSafe(right[f"_r_{c}"]) for c in cols] or [F.lit(True)]
        return left.join(right, on).drop(*[f"_r_{c}" for c in cols])

    cuts = joined(df, sizes, group).withColumn("_range", F.floor(F.col(key) * F.least(F.ceil(F.col("_n") / per_task), F.lit(ranges))).cast("long"))
    counts = cuts.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_held"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).drop("_held")
    place = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(key, *ties)) - 1
    return joined(cuts.drop("_n"), counts, [*group, "_range"]).withColumn(name, (place + F.col("_before")).cast("long")).drop("_range", "_before")


def _joined(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(id, root) for every end of the edges: trees of places in the order of ids, where a lower root takes the higher one in."""
    ids, at = np.unique(np.concatenate((a, b)).astype(np.int64), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while (open_ := root[a] != root[b]).any():
        a, b = a[open_], b[open_]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return pa.table({"id": pa.array(ids), "root": pa.array(ids[root])})


def components(spark: SparkSession, edges: DataFrame, slices_: int = 1024) -> DataFrame:
    """(id, root) for every end of the edges (a, b): root is the smallest id that can be reached.

    Each round takes the least root of all neighbours, tells it to one's present root as well, so that whole trees are
    hooked, and goes on to the root of one's root. Roots only get smaller, and where nothing changes both ends of each
    edge have the same one: it ends by itself, for long chains too. Least values are combined before the shuffle. An end
    with more than one of ``slices_`` parts of all edges, of which there can be ``slices_`` at most, is dealt out in as
    many slices as it has such parts, so that a hub is no hot key. Up to DRIVER_EDGES edges are joined by the driver.
    """
    edges = edges.select("a", "b").where("a <> b")
    if edges.count() <= DRIVER_EDGES:
        found = edges.toArrow()
        return spark.createDataFrame(_joined(found.column("a").to_numpy(), found.column("b").to_numpy()), "id long, root long")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degrees = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("root"), F.count(F.lit(1)).alias("degree"))
    degrees = cut(degrees)
    most = max(256, (degrees.agg(F.sum("degree")).first()[0] or 0) // slices_)
    hubs = cut(degrees.where(F.col("degree") > most).select(F.col("id").alias("_hub"), F.ceil(F.col("degree") / most).cast("int").alias("_parts")))
    hubs = F.broadcast(hubs)  # at most slices_ rows, by the choice of ``most``
    both = cut(both.join(hubs, both.b == F.col("_hub"), "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("_parts", F.lit(1))).cast("int").alias("part")))
    roots = degrees.select("id", "root")
    while True:
        each = roots.join(hubs, roots.id == F.col("_hub"), "left").select("id", "root", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"))
        near = both.join(each, (both.b == each.id) & (both.part == each._part)).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots.id == near.a).select("id", "root", F.least("root", "near").alias("next"))
        told = step.where("next < root").groupBy(F.col("root").alias("_of")).agg(F.min("next").alias("_told"))
        step = step.join(told, step.id == told._of, "left").select("id", "root", F.least("next", "_told").alias("next"))
        up = roots.select(F.col("id").alias("_up"), F.col("root").alias("_top"))
        step = cut(step.join(up, step.next == up._up).select("id", "root", F.least("next", "_top").alias("next")))
        roots, changed = step.select("id", F.col("next").alias("root")), step.where("next <> root").limit(1).count()
        if not changed:
            return roots


def hex_unit(value: Column) -> Column:
    """A double in [0, 1) from the first 13 hexadecimal digits of a digest."""
    return F.conv(F.substring(value, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
