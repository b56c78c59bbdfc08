"""Token ids in files of independent zstandard frames with a seek table at the end.

A file is a sequence of frames, one for each document, of its ids as little-endian unsigned 32-bit integers; then a
skippable frame with the documents' ids; then the public seekable format's skippable frame: compressed size, size and
checksum (the low half of XXH64 of the contents) of each frame, their number, a flag byte and a magic number. A reader
takes the tables from the end of the file and fetches and decompresses only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, scratch_path, slices, small_batches, trimmed, without_gc
from .shingles import run_values, text_bytes

#: Fixed values of the seekable format: magic numbers of its skippable frame and footer; and of the frame of ids here.
SEEK_FRAME, SEEK_FOOTER, ID_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
#: A file is closed when its frames reach this size.
FILE_BYTES = 256 << 20

NO_ID = -(1 << 63)  # stands for a null doc_id in the frame of ids


def frame(ids: bytes) -> bytes:
    return _compressor().compress(ids)


@lru_cache(maxsize=1)
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, write_content_size=True)


def tail(doc_ids: list[int | None], packed: list[int], plain: list[int], sums: list[int]) -> bytes:
    """The two skippable frames that end a file."""
    own = np.array([NO_ID if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    table = np.empty((len(packed), 3), dtype="<u4")
    table[:, 0], table[:, 1], table[:, 2] = packed, plain, sums
    seek = table.tobytes() + struct.pack("<IBI", len(packed), 1 << 7, SEEK_FOOTER)
    return struct.pack("<II", ID_FRAME, len(own)) + own + struct.pack("<II", SEEK_FRAME, len(seek)) + seek


class Reader:
    """Reads documents of one file; only the tables and the frames that are asked for are fetched."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_FOOTER or flags != 1 << 7:
            raise ValueError(f"{uri} has no seek table with checksums")
        begin = size - 9 - 12 * n - 8
        kind, length = struct.unpack("<II", self.file.read_at(8, begin))
        if kind != SEEK_FRAME or length != 12 * n + 9:
            raise ValueError(f"the seek table of {uri} is damaged")
        self.table = np.frombuffer(self.file.read_at(12 * n, begin + 8), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        own = int(self.starts[-1])
        kind, length = struct.unpack("<II", self.file.read_at(8, own))
        if kind != ID_FRAME or length != 8 * n:
            raise ValueError(f"the ids of {uri} are damaged")
        self.doc_ids = np.frombuffer(self.file.read_at(length, own + 8), dtype="<i8")

    def payload(self, k: int) -> bytes:
        """The ids of the k-th document, as stored; raises if the checksum differs."""
        return self._open(self.file.read_at(int(self.table[k, 0]), int(self.starts[k])), k)

    def _open(self, packed: bytes, k: int) -> bytes:
        data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.table[k, 1])) if self.table[k, 1] else b""
        if len(data) != self.table[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of the wanted documents that this file holds."""
        for k in np.flatnonzero(np.isin(self.doc_ids, np.fromiter(wanted, dtype=np.int64))):
            yield int(self.doc_ids[k]), np.frombuffer(self.payload(int(k)), dtype="<u4")

    def every(self, chunk: int = 8 << 20) -> Iterator[bytes]:
        """All documents' payloads in order, fetched a chunk at a time."""
        k, n = 0, len(self.table)
        while k < n:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + chunk, side="right")) - 1)
            data = self.file.read_at(int(self.starts[j] - self.starts[k]), int(self.starts[k]))
            for i in range(k, j):
                a = int(self.starts[i] - self.starts[k])
                yield self._open(data[a : a + int(self.table[i, 0])], i)
            k = j


#: Places of the table of known parts, as a power of two.
TABLE_BITS = 21
#: Classes of bytes: white space, letters, digits, marks that are a pre-token of their own kind, and others.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[b for b in b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"]] = MARK  # not ' and <, which begin contractions and added tokens


class ChunkEncoder:
    """The library's ids of whole texts, from a memo of the parts that it treats independently.

    For vocabularies whose normaliser and splitter drop white space and let no pre-token or added token reach across it.
    A chunk between white space that has only letters (A-Z, and those of Latin-1 as two bytes), digits and plain marks is
    cut into runs of letters, runs of marks and single digits, which are pre-tokens; any other chunk is a part as it is.
    Parts are told apart by a 64-bit value of their bytes, letters in lower case, so that a text's parts are looked up
    with numpy. New runs of letters go to the library joined by spaces, many at a time: an id that ends a word tells
    where the next begins. Other new parts go there one by one. ``most`` parts are kept before the memo starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 128):
        import json
        import os

        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core already
        spec = json.load(open(path, encoding="utf-8"))
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        added = [t["content"] for t in spec["added_tokens"]]
        self.apart = steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
        # runs of letters and of marks are pre-tokens where the splitter has them so; an added token must hold a byte of class OTHER
        suffix, pattern = spec["model"].get("end_of_word_suffix"), (split.get("pattern") or {}).get("Regex", "")
        self.joins = bool(self.apart and suffix and pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and all("<" in t or "'" in t for t in added))
        self.library = tokenizers.Tokenizer.from_file(path)
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), dtype=bool)
        if self.joins:
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.most, self.longest = most, longest
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # a part's number by its value; for most parts also in one of two places of a table
        self.keys, self.numbers = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.int32)
        self.n, self.held = 0, 0
        self.at, self.sizes, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def _keep(self, values: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Numbers new parts, with their ids on end."""
        n, held = self.n + len(sizes), self.held + len(ids)
        for name, need in (("at", n), ("sizes", n), ("ids", held)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)
        self.at[self.n : n] = self.held + np.cumsum(sizes) - sizes
        self.sizes[self.n : n] = sizes
        self.ids[self.held : held] = ids
        self.known.update(zip(values, range(self.n, n)))
        self.n, self.held = n, held

    def _places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - TABLE_BITS)
        return (values >> shift).astype(np.int64), ((values * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def _tabled(self, values: np.ndarray) -> np.ndarray:
        """Numbers of the parts that the table has, -1 for others."""
        one, two = self._places(values)
        out = np.where(self.keys[one] == values, self.numbers[one], -1)
        rest = np.flatnonzero(out < 0)
        two = two[rest]
        out[rest] = np.where(self.keys[two] == values[rest], self.numbers[two], -1)
        return out

    def _put(self, values: np.ndarray) -> None:
        """Puts known parts into the table where a place is free."""
        numbers = np.fromiter(map(self.known.__getitem__, values.tolist()), np.int32, len(values))
        for k in (0, 1):
            place = self._places(values)[k]
            free = np.flatnonzero(self.keys[place] == 0)
            at, which = np.unique(place[free], return_index=True)
            self.keys[at], self.numbers[at] = values[free[which]], numbers[free[which]]
            values, numbers = np.delete(values, free[which]), np.delete(numbers, free[which])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, values: list[int], words: list[bytes], step: int = 512) -> None:
        for k in range(0, len(words), step):
            part = words[k : k + step]
            ids = np.array(self._ids([b" ".join(part).decode("utf-8")])[0], dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                self._keep(values[k : k + step], ids, np.diff(cuts, prepend=0))
            else:
                self._learn(values[k : k + step], part)

    def _learn(self, values: list[int], parts: list[bytes]) -> None:
        ids = self._ids([p.decode("utf-8") for p in parts])
        self._keep(values, np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64))

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, classes, starts, ends) of all parts; letters of parts that are no chunks as they are have lower case."""
        kind = _CLASS[data]
        n = len(data)
        if n > 1 and self.joins:
            # the letters of Latin-1 but for the signs of multiplication and division; their capitals lie 32 below
            pair = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] & 0xC0) == 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
            kind[pair] = kind[pair + 1] = LETTER
        inside = kind != SPACE
        held = np.flatnonzero(np.diff(offsets))
        first = np.ones(n, dtype=bool)
        np.logical_not(inside[:-1], out=first[1:])
        first[offsets[held]] = True
        first &= inside
        chunk = np.cumsum(first) - 1  # of each byte
        starts = np.flatnonzero(first)
        odd = np.zeros(len(starts), dtype=bool)
        if self.joins:
            odd[chunk[kind == OTHER]] = True
            plain = inside & ~odd[chunk] if len(starts) else inside
            low = data.copy()
            low[plain & (data >= 65) & (data <= 90)] += 32
            if n > 1:
                high = pair[(data[pair + 1] < 0x9F) & plain[pair]] + 1
                low[high] += 32
            cut = np.zeros(n, dtype=bool)
            cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
            starts = np.flatnonzero(first | (cut & plain))
            kind = np.where(plain, kind, OTHER)
        else:
            low, kind = data, np.full(n, OTHER, np.uint8)
        # a part ends where the next byte begins another, is white space or belongs to the next text
        stop = np.append(starts[1:], n) if len(starts) else starts
        gap = np.cumsum(~inside)
        ends = stop - (gap[stop - 1] - gap[starts]) if len(starts) else starts
        return low, kind, starts, ends

    def _looked_up(self, values: np.ndarray, kind: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of parts, learned where they are new."""
        distinct, one, number = np.unique(values, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        new = [k for k, v in enumerate(keys) if v not in self.known]
        if new:
            where = one[new]
            letters = kind[where] == LETTER
            got = [low[a:b].tobytes() for a, b in zip(starts[where].tolist(), ends[where].tolist())]
            for some, learn in ((letters, self._learn_words), (~letters, self._learn)):
                which = np.flatnonzero(some).tolist()
                if which:
                    learn([keys[new[k]] for k in which], [got[k] for k in which])
        out = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        if new:
            short = ends[where] - starts[where] <= self.longest
            self._put(distinct[new][short])
            for k in np.flatnonzero(~short).tolist():
                del self.known[keys[new[k]]]
        return out[number]

    def arrays(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids on end, and where each text's begin in them; with ``end_id`` behind each text."""
        n = len(texts)
        if not self.apart:
            each = self._ids([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])
            ids, counts = np.array([i for x in each for i in x], dtype=np.uint32), np.array([len(x) for x in each], dtype=np.int64)
        else:
            data, offsets = text_bytes(texts)
            low, kind, starts, ends = self._parts(data, offsets)
            inside = np.zeros(len(data), dtype=bool)
            inside[np.repeat(starts - np.cumsum(ends - starts) + (ends - starts), ends - starts) + np.arange(int((ends - starts).sum()))] = True
            values = np.maximum(run_values(low, inside, starts, ends), np.uint64(1))  # 0 is a free place
            if len(self.known) > self.most or self.held > 8 * self.most:
                self._forget()
            part = self._tabled(values).astype(np.int64)
            rest = np.flatnonzero(part < 0)
            if len(rest):
                part[rest] = self._looked_up(values[rest], kind[starts[rest]], low, starts[rest], ends[rest])
            sizes = self.sizes[part]
            before = np.cumsum(sizes) - sizes
            ids = self.ids[np.repeat(self.at[part] - before, sizes) + np.arange(int(sizes.sum()))]
            total = np.concatenate((before, [int(sizes.sum())]))
            counts = np.diff(total[np.searchsorted(starts, offsets, side="left")])
        if end_id is None:
            return ids, np.concatenate(([0], np.cumsum(counts)))
        begins = np.concatenate(([0], np.cumsum(counts + 1)))
        out = np.full(int(begins[-1]), end_id, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
        return out, begins

    def batch(self, texts: pa.Array | list[str | None], end_id: int | None = None) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, begins = self.arrays(texts, end_id)
        data, at = ids.astype("<u4").tobytes(), (4 * begins).tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, per_file: int = 20_000, part_bytes: int = 64 << 20) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), each document's with ``end_id`` behind, and returns the files' list.

    (part, number, path, n_docs, n_tokens); files follow each other in ascending doc_id by (part, number), nulls first
    and rows with equal doc_id by a digest of their texts. Texts are dealt to tasks by ranges of about ``part_bytes``,
    whose bounds Spark samples, and are sorted, encoded, compressed and written there, ``per_file`` in a file at most. The digest and the row's place
    belong to the range's key, so that one id on many rows, null included, is no hot task. A file gets a name of its own
    in each attempt and is listed only by the attempt that counts, so that a lost executor's tasks can be run again. A
    null text is empty, repeated rows are written each, an empty table gives no files. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-total // part_bytes))
    listed = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        state: dict = {"out": None}
        files: list[tuple] = []

        def close() -> None:
            if state["out"] is not None:
                state["out"].write(tail(state["ids"], state["packed"], state["plain"], state["sums"]))
                state["out"].close()
                files.append((part, len(files), f"{folder}/{state['name']}", len(state["ids"]), sum(state["plain"]) // 4))
                state["out"] = None

        for batch in batches:
            for piece in slices(batch, most=2 << 20):
                with without_gc():
                    data = enc.batch(piece.column("text"), end_id)
                for d, x in zip(piece.column("doc_id").to_pylist(), data):
                    if state["out"] is None:
                        fs.create_dir(base, recursive=True)
                        name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.tok"
                        state |= {"name": name, "out": fs.open_output_stream(f"{base}/{name}"), "ids": [], "packed": [], "plain": [], "sums": [], "size": 0}
                    packed = frame(x)
                    state["out"].write(packed)
                    for key, v in (("ids", d), ("packed", len(packed)), ("plain", len(x)), ("sums", xxhash.xxh64_intdigest(x) & 0xFFFFFFFF)):
                        state[key].append(v)
                    state["size"] += len(packed)
                    if state["size"] >= FILE_BYTES or len(state["ids"]) >= per_file:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], type=t) for k, t in enumerate(listed.types)], schema=listed)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("doc_id").asc_nulls_first(), "digest", "place"]
    sorted_ = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return cut(small_batches(sorted_).mapInArrow(trimmed(write), "part int, number int, path string, n_docs long, n_tokens long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the listed files, from the files."""
    spread = files.sparkSession.sparkContext.defaultParallelism
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                r = Reader(path)
                n, crc = [], []
                for data in r.every():
                    n.append(len(data) // 4)
                    crc.append(zlib.crc32(data))
                starts = start + np.cumsum([0, *n[:-1]]) if n else []
                yield pa.RecordBatch.from_arrays([pa.array([None if d == NO_ID else d for d in r.doc_ids.tolist()], pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return files.select("path", "start").repartition(spread * 4, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` to token files in the shared folder and reads them back: see the two functions above."""
    return read_token_files(write_token_files(docs, tokenizer, scratch_path(docs.sparkSession, "tokens"), end_id))
