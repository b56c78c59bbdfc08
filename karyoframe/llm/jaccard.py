"""Set-similarity join of documents on word n-grams by vertical partitioning.

N-grams have a global order: by how many sets hold them (in powers of four), then by value. The order is cut into
fragments of about equal weight; a set's part in a fragment is its segment. The overlap of every compared pair is counted
in each fragment by itself, and the partial overlaps are summed per pair.

1. One pass over the texts tells which sets can have a partner at all: n-grams' fingerprints, dealt by value and combined
   before the shuffle, say how many of a set's n-grams another set holds too, and a set of n needs at least ``percent`` %
   of n. Equal sets count as one.
2. Two similar sets share an n-gram among their first n - ceil(percent * n / 100) + 1 in the global order. The set under
   each such n-gram with the fewest n-grams of its own is paired with the others under it; what these pairs link are the
   first components.
3. Of the n-grams whose sets stand in several components, sets are compared in blocks of bounded size, ordered by set
   size, by bitmaps that bound the overlap from above. At first one pair is counted for each two components that a block
   finds, which joins nearly all that hang together; then every pair that the bounds allow and whose components still
   differ.

No pair within a component is needed, so that a group of n copies costs about n comparisons. Every pair of sets that the
components don't settle is decided by exact counts; there is no cap on group sizes or candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut, free_prefix, give_back, let_go, passing, slices, small_batches, told, trimmed, without, written
from .shingles import mix64, shingle_sets

#: n-grams for each fragment task of step 1; a fragment's numbers take about 25 bytes each. A set has a row in each
#: fragment where it shares an n-gram: more fragments make more rows, at most one for each shared n-gram.
PER_FRAGMENT = 5_000_000
#: Sets in a block of step 3.
BLOCK = 512
#: Rows of small n-grams that are compared in one task, n-gram by n-gram.
PER_DEAL = 20_000
#: Vertical fragments in which overlaps are counted.
FRAGMENTS = 4
#: Least and most bits (powers of two) of the bitmaps that bound overlaps; a larger set's bound is less sharp, no less true.
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 15
#: Most slots of the table that tells how common an n-gram is; a crowded table only makes the order less sharp.
SLOTS = 1 << 22
#: Slots (a power of two) whose levels are packed into one row.
PART_BITS = 14

_MANY = np.uint64(0)


def signature(values: np.ndarray) -> bytes:
    """16 bytes that stand for a set of n-grams."""
    low = mix64(values)
    high = mix64(values ^ np.uint64(0xD6E8FEB86659FD93))
    return low.sum(dtype=np.uint64).tobytes() + high.sum(dtype=np.uint64).tobytes()


def _owners(signatures: list[bytes]) -> np.ndarray:
    """The first 8 bytes of each signature, never the value that means many owners."""
    if not signatures:
        return np.zeros(0, dtype=np.uint64)
    return np.frombuffer(b"".join(s[:8] for s in signatures), dtype=np.uint64) | np.uint64(1)


def _first_pass(width: int, bits: int):
    """Each batch gives a row per document (frag -1 - n) and, for each fragment, the fingerprints of its sets."""
    schema = pa.schema([("frag", pa.int32()), ("doc", pa.binary()), ("owners", pa.binary()), ("sizes", pa.binary()), ("prints", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919  # documents' rows go to one fragment after another
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                ids, turn = part.column("doc_id"), turn + 1
                values, offsets = shingle_sets(part.column("text"), width)
                n = np.diff(offsets)
                sets = [signature(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                owners = np.repeat(_owners(sets), n)
                order = np.argsort(values)
                values, owners = values[order], owners[order]
                within = np.zeros(len(n), dtype=np.int64)  # a document's n-grams that another set of this batch holds
                if len(values):
                    fresh = np.concatenate(([True], values[1:] != values[:-1]))
                    starts = np.flatnonzero(fresh)
                    least, most = np.minimum.reduceat(owners, starts), np.maximum.reduceat(owners, starts)
                    many = (least != most)[np.cumsum(fresh) - 1]
                    within = np.bincount(np.repeat(np.arange(len(n)), n)[order][many], minlength=len(n))
                    values, owners = values[starts], np.where(least == most, least, _MANY)
                    frag = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), dtype=np.int64)
                    prints = ((values << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                    cuts = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1], [True])))
                else:
                    cuts = np.zeros(1, dtype=np.int64)
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    by = np.argsort(owners[a:b], kind="stable")
                    own, sizes = np.unique(owners[a:b][by], return_counts=True)
                    rows.append((int(frag[a]), None, own.tobytes(), sizes.astype(np.uint32).tobytes(), prints[a:b][by].tobytes()))
                table = pa.table({"doc_id": ids.cast(pa.int64()), "n": pa.array(n, pa.int64()), "set": pa.array(sets, pa.binary()), "within": pa.array(within, pa.int64())})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table)
                rows.append((turn % (1 << bits), sink.getvalue().to_pybytes(), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(schema.types)], schema=schema)
                del rows, values, owners, order, sink, table

    return run, "frag int, doc binary, owners binary, sizes binary, prints binary"


_COUNTS = "doc_id long, n long, set binary, within long, own long, shared long"


def _shared(frame: pa.Table) -> pa.Table:
    """Of one fragment: how many of a set's n-grams other sets hold too (own, shared); and the documents' rows."""
    docs = [pa.ipc.open_stream(d).read_all() for d in frame.column("doc").drop_null().to_pylist()]
    rest = frame.select(["owners", "sizes", "prints"]).drop_null()
    del frame
    long = lambda x: pa.array(x, pa.int64())
    out = [t.append_column("own", pa.nulls(len(t), pa.int64())).append_column("shared", pa.nulls(len(t), pa.int64())) for t in docs]
    if len(rest):
        names, rank = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rest.column("owners").to_pylist()]), return_inverse=True)
        sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in rest.column("sizes").to_pylist()])
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in rest.column("prints").to_pylist()]).astype(np.uint64)
        del rest
        key <<= np.uint64(32)
        key |= np.repeat(rank.astype(np.uint32), sizes)
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]  # an n-gram once for each of its sets
        same = (key[1:] ^ key[:-1]) <= np.uint64(0xFFFFFFFF)
        held = np.concatenate((same, [False])) | np.concatenate(([False], same))
        shared = np.bincount((key[held] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(names))
        some = np.flatnonzero((shared > 0) & (names != _MANY))
        nothing = pa.nulls(len(some), pa.int64())
        out.append(pa.table({"doc_id": nothing, "n": nothing, "set": pa.nulls(len(some), pa.binary()), "within": nothing, "own": long(names[some].view(np.int64)), "shared": long(shared[some])}))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("within", pa.int64()), ("own", pa.int64()), ("shared", pa.int64())])
    return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()


def _shared_trimmed(frame: pa.Table) -> pa.Table:
    try:
        return _shared(frame)
    finally:
        give_back()


def _sets(width: int):
    schema = pa.schema([("set", pa.binary()), ("n", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                values, offsets = shingle_sets(part.column("text"), width)
                held = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([signature(v) for v in held], pa.binary()), pa.array([len(v) for v in held], pa.int64()), pa.array([v.tobytes() for v in held], pa.binary())], schema=schema)

    return run, "set binary, n long, grams binary"


def _common(batches):
    """(gram, held) of the n-grams of each batch of sets, combined in the batch."""
    schema = pa.schema([("gram", pa.int64()), ("held", pa.int64())])
    for batch in batches:
        got = [np.frombuffer(x, np.uint64) for x in batch.column("grams").to_pylist()]
        v, c = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], schema=schema)


def _packed(key: tuple, frame: pa.Table) -> pa.Table:
    """The levels of one part of the slots, a byte each."""
    out = np.zeros(1 << PART_BITS, dtype=np.uint8)
    out[frame.column("slot").to_numpy() & (len(out) - 1)] = np.minimum(frame.column("level").to_numpy(), 255)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "levels": pa.array([out.tobytes()], pa.binary())})


class Order:
    """The global order of n-grams and its fragments: ``levels`` by slot, ``cuts`` where all fragments but the first begin."""

    def __init__(self, levels: np.ndarray, weights: dict[int, int]):
        self.levels = levels
        ranks, total, cuts = sorted(weights), sum(weights.values()), []
        for f in range(1, FRAGMENTS):
            want, before = total * f / FRAGMENTS, 0.0
            for level in ranks:
                if before + weights[level] >= want:
                    # values are spread evenly within a level
                    cuts.append((level << 56) + min((1 << 56) - 1, int((want - before) / weights[level] * (1 << 56))))
                    break
                before += weights[level]
        self.cuts = np.array(cuts, dtype=np.uint64)

    def keys(self, values: np.ndarray) -> np.ndarray:
        """What values are ordered by: the level, then the value but for its lowest byte."""
        level = self.levels[(values & np.uint64(len(self.levels) - 1)).astype(np.int64)].astype(np.uint64)
        return (level << np.uint64(56)) | (values >> np.uint64(8))

    def fragments(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.keys(values), side="right")

    def first(self, values: np.ndarray, percent: int) -> np.ndarray:
        """So many first n-grams of a set, in the global order, that similar sets share one of them."""
        p = len(values) - -(-percent * len(values) // 100) + 1
        return values[np.argsort(self.keys(values), kind="stable")[:p]]  # values ascend, so ties are by value


def _prefixes(order, percent: int):
    """(gram, id): the first n-grams of each set."""
    schema = pa.schema([("gram", pa.int64()), ("id", pa.int64())])

    def run(batches):
        for batch in batches:
            keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, x in zip(batch.column("id").to_pylist(), batch.column("grams").to_pylist()):
                first = order.value.first(np.frombuffer(x, np.uint64), percent)
                keys.append(first)
                ids.append(np.full(len(first), i))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], schema=schema)

    return run


def _segments(order):
    """A row per set and vertical fragment, with its segment: ascending values."""
    schema = pa.schema([("id", pa.int64()), ("fragment", pa.int32()), ("segment", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, g in zip(batch.column("id").to_pylist(), batch.column("grams").to_pylist()):
                v = np.frombuffer(g, np.uint64)
                at = order.value.fragments(v)
                rows += [(i, f, v[at == f].tobytes()) for f in range(FRAGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(schema.types)], schema=schema)

    return run


def _bitmap(values: np.ndarray) -> bytes:
    """For each place whether an odd number of the values have it: two sets differ in at least as many n-grams as bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(values) - 1).bit_length()))
    odd = np.bincount((mix64(values) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], rows: np.ndarray, size: int) -> np.ndarray:
    """The bitmaps of some rows, folded to ``size`` words of 64 bits each."""
    out = np.empty((len(rows), size), dtype=np.uint64)
    for k, i in enumerate(rows):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], np.uint64).reshape(-1, size), axis=0)
    return out


def _bitmaps(batches):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary())])
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), pa.array([_bitmap(np.frombuffer(g, np.uint64)) for g in batch.column("grams").to_pylist()], pa.binary())], schema=schema)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two ascending arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _partial_overlaps(batches):
    """The overlap of a pair in one fragment."""
    schema = pa.schema([(k, pa.int64()) for k in ("a", "b", "na", "nb", "common")])
    for batch in batches:
        common = [_overlap(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("a", "b", "na", "nb")), pa.array(common, pa.int64())], schema=schema)


def _linked(pairs: DataFrame, sizes: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of sets that are similar; overlaps are counted by fragment and summed."""
    of = lambda s: sizes.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    near = near.withColumn("fragment", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    for s in ("a", "b"):
        near = near.join(segments.select(F.col("id").alias(s), "fragment", F.col("segment").alias(f"s{s}")), [s, "fragment"])
    counts = near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(trimmed(_partial_overlaps), "a long, b long, na long, nb long, common long")
    sums = counts.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return sums.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")


def _block_pairs(percent: int, forest: bool):
    """Of one pair of blocks, for each n-gram there: pairs (a, b) whose bitmaps allow that they are similar.

    With ``forest`` only so many that they join all components which such pairs would join.
    """

    def run(key: tuple, frame: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        gram, block, ids, n = (frame.column(k).to_numpy() for k in ("gram", "block", "id", "n"))
        _, label = np.unique(frame.column("root").to_numpy(), return_inverse=True)
        bitmaps = frame.column("bitmap").to_pylist()
        by = np.lexsort((n, gram))
        cuts = np.flatnonzero(np.concatenate(([True], gram[by][1:] != gram[by][:-1], [True])))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q in zip(cuts[:-1], cuts[1:]):
            here = by[p:q]
            if (label[here] == label[here[0]]).all():
                continue
            size = min(len(bitmaps[i]) for i in here) // 8
            at = np.arange(q - p)
            words = _folded(bitmaps, here, size)
            rows, cols = at[block[here] == left], at[block[here] == right]
            for k, x in enumerate(rows):
                i, ys = here[x], cols[k + 1 :] if left == right else cols
                js = here[ys]
                ok = (label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))
                ys, js = ys[ok], js[ok]
                if not len(js):
                    continue
                # twice the overlap is at most what both hold less the bits in which they differ
                twice = n[js] + n[i] - np.bitwise_count(words[ys] ^ words[x]).sum(axis=1, dtype=np.int64)
                js = js[(100 + percent) * twice >= 2 * percent * (n[js] + n[i])]
                if forest and len(js):
                    met, one = np.unique(label[js], return_index=True)
                    label[np.isin(label, met)] = label[i]
                    js = js[one]
                a.append(np.minimum(ids[js], ids[i]))
                b.append(np.maximum(ids[js], ids[i]))
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    return run


def _candidates(under: DataFrame, bitmaps: DataFrame, roots: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) that share one of their first n-grams (``under``) and may be similar, but have different roots.

    ``bitmaps`` has (id, n, bitmap), ``roots`` (id, root) of those that have another root than themselves or may have. The sets under an n-gram are dealt to blocks of about BLOCK by size; each block
    meets those whose sizes allow similar sets.
    """
    here = under.join(bitmaps.select("id", "n"), "id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = here.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("held")).where("x <> y").select("gram", "held")
    here = cut(here.join(mixed, "gram"))
    large = here.where(F.col("held") > BLOCK)
    spread = large.groupBy("gram", "n").agg(F.count(F.lit(1)).alias("same"))
    before = Window.partitionBy("gram").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn("before", F.coalesce(F.sum("same").over(before), F.lit(0)))
    base, inner = F.floor(F.col("before") / BLOCK) * (1 << 20), F.pmod(F.xxhash64("id"), F.ceil(F.col("same") / BLOCK))
    large = large.join(spread, ["gram", "n"]).withColumn("block", F.when(F.col("same") <= BLOCK, base).otherwise(base + 1 + inner))
    blocks = large.groupBy("gram", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select(F.col("gram").alias("g2"), F.col("block").alias("right"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    meets = blocks.join(other, (F.col("gram") == F.col("g2")) & (F.col("block") <= F.col("right")))
    meets = meets.where(f"100 * least(high, high2) >= {percent} * greatest(low, low2)").select("gram", F.col("block").alias("left"), "right")
    sent = meets.select("gram", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    names = ["deal", "left", "right", "gram", "block", "id", "root", "n"]
    large = large.select("gram", "block", "id", "root", "n").join(sent, ["gram", "block"]).withColumn("deal", F.col("gram"))
    small = here.where(F.col("held") <= BLOCK)
    deals = max(2 * int(under.sparkSession.conf.get("spark.sql.shuffle.partitions")), small.count() // PER_DEAL)
    zero = F.lit(0).cast("long")
    small = small.withColumn("deal", F.pmod(F.xxhash64("gram"), F.lit(deals))).withColumn("block", zero).withColumn("left", zero).withColumn("right", zero)
    both = small.select(*names).unionByName(large.select(*names)).join(bitmaps.select("id", "bitmap"), "id")
    return cut(both.groupBy("deal", "left", "right").applyInArrow(_block_pairs(percent, forest), "a long, b long").distinct())


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct word n-grams;
    component_id is the smallest doc_id that links reach. Null, empty and wordless texts have empty sets, link with
    nothing and keep their own doc_id. Rows with a null doc_id take part; their component_id is the smallest id of
    their component, null if that has none. Repeated rows and ids give a row each. An empty table gives no rows.
    Other columns of ``docs`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a word and its space take 5 bytes or more, mostly
    bits = max(4, int(grams // 6 // PER_FRAGMENT).bit_length())

    run, schema = _first_pass(width, bits)
    prints = small_batches(docs).mapInArrow(trimmed(run), schema)
    found = written(prints.groupBy("frag").applyInArrow(_shared_trimmed, _COUNTS), "prints")
    members = found.where("set is not null").select("doc_id", "n", "set")
    # n-grams that are shared in every batch that holds the set are in no fragment under its name: at most the least ``within``
    classes = found.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.min("within").alias("within"))
    classes = cut(classes.withColumn("own", _owner_column()))
    shared = found.where("own is not null").groupBy("own").agg(F.sum("shared").alias("shared"))
    alike = classes.groupBy("own").agg(F.count(F.lit(1)).alias("alike"))
    known = classes.join(alike, "own").join(shared, "own", "left").withColumn("shared", F.least("n", F.col("within") + F.coalesce("shared", F.lit(0))))
    open_ = cut(known.where(f"alike > 1 or 100 * shared >= {percent} * n").select("set", "first", (F.col("n") - F.col("shared")).alias("lone")))

    # a text that the filter lets through by chance is a set that came along, as one of a repeated id is
    ids = open_.where("first is not null").select("first")
    texts = told(docs, "doc_id", ids, "open").where("open or doc_id is null").select("doc_id", "text")
    run, schema = _sets(width)
    sets = texts.mapInArrow(trimmed(run), schema).where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("grams").alias("grams"))
    sets = sets.join(classes.select("set", "first"), "set").join(open_.select("set", "lone"), "set", "left")
    # a set without n-grams of its own is central in its group; sets that came along by a repeated id are least so
    sets = sets.withColumn("apart", F.coalesce(F.col("lone") / F.col("n"), F.lit(1.0))).drop("lone")
    with passing(docs.sparkSession):
        sets = written(sets.withColumn("id", F.xxhash64("set")), "sets")
        if sets.groupBy("id").count().where("count > 1").limit(1).count():
            raise RuntimeError("two sets have the same 64-bit id")
        let_go(docs.sparkSession)
        return _link(members, sets, percent)


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of similar texts, with all its columns: that with the smallest doc_id, nulls last.

    Rows count, not ids: a text that nobody else has stays whoever shares its doc_id, of equal rows one stays, and of a
    component of rows without doc_ids one stays. Null, empty and wordless texts link with nothing and all stay. An empty
    table gives no rows; columns of any name are kept.
    """
    own = f"{free_prefix(docs.columns)}row"
    rows = written(docs.withColumn(own, F.monotonically_increasing_id()), "rows")  # written once, so that a row keeps its number
    with passing(docs.sparkSession):
        found = cut(jaccard_components(rows.select(F.col(own).alias("doc_id"), "text"), width, percent).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id"))
    let_go(docs.sparkSession)
    named = found.join(rows.select(F.col(own).alias("row"), F.col("doc_id").cast("long").alias("doc_id")), "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "row"))["row"].alias("first"))
    gone = cut(found.join(first, "component_id").where("row <> first").select(F.col("row").alias(own)))
    return without(rows, own, gone).select(*docs.columns)


def _owner_column():
    """The same value as _owners has: the first 8 bytes as a little-endian number with its lowest bit set."""
    swapped = F.concat(*[F.hex(F.substring("set", i, 1)) for i in range(8, 0, -1)])
    high, low = F.conv(F.substring(swapped, 1, 8), 16, 10).cast("long"), F.conv(F.substring(swapped, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseOR(F.lit(1).cast("long"))


def _link(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    spark = members.sparkSession
    held = cut(sets.select("grams").mapInArrow(trimmed(_common), "gram long, held long").groupBy("gram").agg(F.sum("held").alias("held")).where("held >= 4"))
    slots = 1 << min(SLOTS.bit_length() - 1, max(10, (8 * held.count()).bit_length()))
    level = F.floor(F.log2("held") / 2).cast("int")
    rows = held.groupBy(F.col("gram").bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.max(level).alias("level")).toArrow()  # at most SLOTS, 12 bytes each
    levels = np.zeros(slots, dtype=np.uint8)
    levels[rows["slot"].to_numpy()] = np.minimum(rows["level"].to_numpy(), 255)
    del rows
    found = held.groupBy(level.alias("level")).agg(F.sum("held").alias("weight")).collect()  # 64 rows at most
    total = sets.agg(F.sum("n")).first()[0] or 0
    weights = {r["level"]: r["weight"] for r in found}
    weights[0] = weights.get(0, 0) + max(1, total - sum(weights.values()))  # n-grams that are in no list
    order = spark.sparkContext.broadcast(Order(levels, weights))

    sizes = sets.select("id", "n")
    segments = written(sets.select("id", "grams").mapInArrow(trimmed(_segments(order)), "id long, fragment int, segment binary"), "segments")
    under = cut(sets.select("id", "grams").mapInArrow(trimmed(_prefixes(order, percent)), "gram long, id long"))
    central = under.join(sets.select("id", "apart"), "id").groupBy("gram").agg(F.min(F.struct("apart", "id"))["id"].alias("a"), F.count(F.lit(1)).alias("held")).where("held > 1").select("gram", "a")
    stars = under.join(central, "gram").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = cut(_linked(stars, sizes, segments, percent))
    roots = components(spark, links)

    # sets under n-grams whose sets don't all stand in one component yet
    under = cut(under.join(central.select("gram"), "gram", "left_semi"))
    bitmaps = cut(sets.select("id", "n", "grams").join(under.select("id").distinct(), "id", "left_semi").mapInArrow(trimmed(_bitmaps), "id long, n long, bitmap binary"))
    for forest in (True, False):
        let_go(spark)
        more = cut(_linked(_candidates(under, bitmaps, roots, percent, forest), sizes, segments, percent))
        if more.limit(1).count():
            up = lambda s: roots.select(F.col("id").alias(s), F.col("root").alias(f"r{s}"))  # noqa: B023, E731
            told = more.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
            tops = components(spark, told)
            final = roots.unionByName(tops.join(roots, "id", "left_anti").select("id", F.col("id").alias("root")))
            roots = cut(final.join(tops.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root")))

    final = roots.select("id", F.col("root").alias("top"))
    # a component's name: the smallest id that any of its documents has
    names = sets.select("id", "set", "first").join(final, "id")
    names = names.join(names.groupBy("top").agg(F.min("first").alias("least")), "top").select("set", "least")
    first = members.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    named = cut(first.join(names, "set", "left").select("set", F.coalesce("least", "first").alias("component_id")))
    every = members.join(named, "set", "left")
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
