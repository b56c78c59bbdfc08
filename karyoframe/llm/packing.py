"""Variable-capacity best-fit packing of pieces of documents into sequences of several permitted lengths.

Best fit depends on lengths alone, so that it is planned on the histogram of lengths (at most as many entries as the
largest permitted length) and holds for all rows at once: no part of the data is packed by itself. Lengths are taken
from the longest; a piece goes into the open bin that it fills best. Where none has room a bin is opened in the size
that costs least for each unit that it would hold of what is still to be packed. At the end each bin is cut down to the
least permitted length that holds its contents. Equal bins are one entry of the plan with a count.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hex_unit, ranked, slices, small_batches, trimmed, without_gc, written
from .token_files import encoder

#: Permitted sequence lengths, and what a sequence costs besides its length.
SIZES, OVERHEAD = (2048, 4096, 8192, 16384, 32768), 64


@dataclass
class Bins:
    """``count`` bins of one size and equal contents; ``held`` are the lengths of their pieces in order."""

    size: int
    room: int
    count: int
    held: list[int] = field(default_factory=list)


def _fill(size: int, length: int, left: dict[int, int], order: list[int]) -> int:
    """What a new bin of ``size`` would hold that begins with a piece of ``length``, filled greedily from what is left."""
    room = size - length
    i = bisect_left(order, length + 1) - 1
    held = {length: 1}
    while room > 0 and i >= 0:
        i = min(i, bisect_left(order, room + 1) - 1)
        if i < 0:
            break
        at = order[i]
        n = min(room // at, left[at] - held.get(at, 0))
        room -= n * at
        i -= 1
    return size - room


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[Bins]:
    """Bins for all pieces of a histogram {length: count}, downsized to their contents. Lengths are from 1 to the largest size."""
    sizes = tuple(sorted(sizes))
    left = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(left)
    if order and (order[0] < 1 or order[-1] > sizes[-1]):
        raise ValueError("a length is not from 1 to the largest permitted length")
    rooms: list[int] = []  # ascending rooms of open bins
    open_: dict[int, list[Bins]] = {}
    done: list[Bins] = []

    def put(bins: Bins) -> None:
        if bins.room < (order[0] if order else 0) or not bins.room:
            done.append(bins)
        else:
            if bins.room not in open_:
                insort(rooms, bins.room)
                open_[bins.room] = []
            open_[bins.room].append(bins)

    def fill(bins: Bins, length: int, n: int) -> int:
        """Puts up to n pieces of a length into equal bins, each bin taking as many as it can before the next does."""
        each = bins.room // length
        full, rest = divmod(min(n, each * bins.count), each)
        if full:
            put(Bins(bins.size, bins.room - each * length, full, [*bins.held, *[length] * each]))
        if rest:
            put(Bins(bins.size, bins.room - rest * length, 1, [*bins.held, *[length] * rest]))
        if bins.count > full + bool(rest):
            put(Bins(bins.size, bins.room, bins.count - full - bool(rest), bins.held))
        return full * each + rest

    while order:
        length = order[-1]
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins = open_[room].pop(0)  # of equal rooms the one that has been so for longest
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                n -= fill(bins, length, n)
            else:
                left[length] = n
                cost = {s: (s + overhead) / _fill(s, length, left, order) for s in sizes if s >= length}
                size = min(cost, key=lambda s: (cost[s], s))
                each = size // length
                n -= fill(Bins(size, size, -(-n // each)), length, n)
        order.pop()
        del left[length]
        while order and rooms and rooms[0] < order[0]:
            done += open_.pop(rooms.pop(0))
    done += [b for bins in open_.values() for b in bins]
    for b in done:
        used = b.size - b.room
        b.size = sizes[bisect_left(sizes, used)]
        b.room = b.size - used
    return sorted(done, key=lambda b: (-b.size, b.held, b.count))


def slots(bins: list[Bins]) -> dict[int, np.ndarray]:
    """For each length the plan's runs of places: (first place, first bin, copies in a bin, offset, bin size)."""
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for b in bins:
        offset = i = 0
        while i < len(b.held):
            length, j = b.held[i], i
            while j < len(b.held) and b.held[j] == length:
                j += 1
            runs.setdefault(length, []).append((taken.get(length, 0), first, j - i, offset, b.size))
            taken[length] = taken.get(length, 0) + (j - i) * b.count
            offset += (j - i) * length
            i = j
        first += b.count
    return {n: np.array(r, dtype=np.int64) for n, r in runs.items()}


def _assigned(pieces: DataFrame, carry: list[str], sizes: tuple[int, ...], overhead: int, per_task: int) -> DataFrame:
    """``carry`` and (length, bin, bin_size, offset) of each of ``pieces`` (length, _key, *carry), which are cheap to read again."""
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most one row for each length
    placed = ranked(pieces, ["length"], "_key", carry, "_place", per_task).select(*carry, "length", "_place")
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan(found, sizes, overhead)))

    def run(batches):
        for batch in batches:
            n, place = batch.column("length").to_numpy(), batch.column("_place").to_numpy()
            out = np.zeros((3, len(n)), dtype=np.int64)
            order = np.argsort(n, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(n[order]) != 0))) if len(n) else []
            for a, b in zip(edges, [*edges[1:], len(n)]):
                at = order[a:b]
                runs = table.value[int(n[at[0]])]
                k = np.searchsorted(runs[:, 0], place[at], side="right") - 1
                first, bin_, copies, offset, size = runs[k].T
                inside = place[at] - first
                out[:, at] = bin_ + inside // copies, size, offset + inside % copies * n[at[0]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*carry, "length")], *map(pa.array, out)], names=[*carry, "length", "bin", "bin_size", "offset"])

    return placed.mapInArrow(run, ", ".join(f"{c} long" for c in (*carry, "length", "bin", "bin_size", "offset")))


def _key(seed: str, *parts: str) -> Column:
    return hex_unit(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in parts])))


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, seed: str = "5", per_task: int = 2_000) -> DataFrame:
    """(doc_id, piece, begin, length, bin, bin_size, offset) for each piece of each row of ``docs`` (doc_id, text).

    The unit is the byte-level token: a text has its UTF-8 bytes and one end id, so that a null or empty text has
    length 1. A document longer than the largest size is cut into pieces of that size and a rest; nothing is dropped.
    ``begin`` is where a piece begins in its document and ``offset`` where it stands in its bin. Pieces of equal length
    go to their places in a seeded order of doc_id; repeated rows are packed like others. An empty table gives no rows;
    other columns are not read.
    """
    most = max(sizes)
    length = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("_all"))
    rows = rows.select("doc_id", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_all - 1) div {most}"))).alias("piece"))
    rows = rows.withColumn("begin", F.col("piece") * most).withColumn("length", F.least(F.lit(most).cast("long"), F.col("_all") - F.col("begin"))).drop("_all")
    rows = cut(rows.withColumn("_key", _key(seed, "doc_id", "piece")))
    return _assigned(rows, ["doc_id", "piece", "begin"], sizes, overhead, per_task)


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """(doc_id, begin, length, ids) of the documents' token ids with ``end_id`` behind, cut into pieces; ids as 16 bits each where all fit."""
    schema = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        enc = encoder(tokenizer)
        unit = np.dtype(_unit(enc.library.get_vocab_size(with_added_tokens=True), end_id))
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                with without_gc():
                    ids, begins = enc.arrays(part.column("text"), end_id)
                sizes = np.diff(begins)
                pieces = -(-sizes // most)  # of each document; none is empty, for its end id
                row = np.repeat(np.arange(len(sizes)), pieces)
                begin = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
                length = np.minimum(most, sizes[row] - begin)
                data, at = ids.astype(unit).tobytes(), (unit.itemsize * np.concatenate(([0], np.cumsum(length)))).tolist()
                held = pa.array([data[a:b] for a, b in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(begin), pa.array(length), held], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(trimmed(run), "doc_id long, begin long, length long, ids binary")


def _unit(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


_DOCUMENTS = pa.list_(pa.struct([(c, pa.int64()) for c in ("offset", "doc_id", "begin", "length")]))


def _joined(batches):
    """A row for each sequence from its pieces, which follow each other in order; at most a sequence is held."""
    schema = pa.schema([("bin", pa.int64()), ("bin_size", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("documents", _DOCUMENTS)])
    now, size, held, parts = None, 0, [], []

    def done():
        data, n = b"".join(parts), sum(d["length"] for d in held)
        ids = np.frombuffer(data, dtype=f"<u{len(data) // n}").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([size], pa.int64()), pa.array([n], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(ids)), pa.array([held], _DOCUMENTS)], schema=schema)

    for batch in batches:
        for b, s, d, x in zip(batch.column("bin").to_pylist(), batch.column("bin_size").to_pylist(), batch.column("document").to_pylist(), batch.column("ids").to_pylist()):
            if b != now:
                if held:
                    yield done()
                now, size, held, parts = b, s, [], []
            held.append(d)
            parts.append(x)
    if held:
        yield done()


def pack_sequences(docs: DataFrame, tokenizer: str, end_id: int = 2, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD, seed: str = "5", per_task: int = 2_000) -> DataFrame:
    """(bin, bin_size, n_tokens, ids, documents): a row for each packed sequence of the token ids of ``docs`` (doc_id, text).

    Each document's ids, as the library for ``tokenizer`` gives them, and ``end_id`` are cut into pieces of the largest
    size at most, and the pieces are packed as by pack(). ``documents`` has (offset, doc_id, begin, length) of the
    sequence's pieces in order: where a piece stands in the sequence, and where in its document it begins. A null or
    empty text has its end id alone; repeated rows are packed each; an empty table gives no rows; other columns are not read.
    """
    pieces = written(_pieces(docs, tokenizer, end_id, max(sizes)).withColumn("row", F.monotonically_increasing_id()).withColumn("_key", _key(seed, "doc_id", "begin")), "pieces", "zstd")
    places = _assigned(pieces.select("row", "length", "_key"), ["row"], sizes, overhead, per_task).select("row", "bin", "bin_size", "offset")
    held = pieces.select("row", "doc_id", "begin", "length", "ids").join(places, "row")
    held = held.select("bin", "bin_size", F.struct("offset", "doc_id", "begin", "length").alias("document"), "ids")
    held = held.repartition("bin").sortWithinPartitions("bin", "document.offset")
    return small_batches(held).mapInArrow(_joined, "bin long, bin_size long, n_tokens long, ids array<int>, documents array<struct<offset:bigint,doc_id:bigint,begin:bigint,length:bigint>>")


def sequence_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(bin, bin_size, n_tokens, n_documents, documents, ids_sha256) of the packed sequences: of their decimal ids joined by commas."""
    found = pack_sequences(docs, tokenizer)
    return found.select("bin", "bin_size", "n_tokens", F.size("documents").cast("long").alias("n_documents"), "documents", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))
