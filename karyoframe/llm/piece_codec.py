"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (a leading mark, marks for spaces) and cut where no piece of the vocabulary can reach across. Each
distinct part is encoded by an agenda of adjacent symbol pairs, ordered by score and then by place: the best pair is
joined and its new neighbours enter the agenda, until no pair is a piece. Symbols that are no piece become byte pieces.
Every part that is new to a worker is compared, an Arrow batch at a time, with the sentencepiece library, both ways.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, without_gc

MARK = "▁"  # stands for a space


class _Ranks(dict):
    """Ranks of the pieces' scores from 0, the best; ``none`` for all else."""

    none = 0

    def __missing__(self, _: str) -> int:
        return self.none


class PieceCodec:
    """Encodes and decodes as the library does with ``path``, without begin and end ids."""

    def __init__(self, path: str, most: int = 1_000_000, longest: int = 128):
        """``most``: parts kept in the memo before it starts anew; ``longest``: characters of a part that is kept."""
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces aren't supported")
        if lib.normalize("  a\n\tb ééﬁ ") != MARK * 3 + f"a\n\tb{MARK}ééﬁ{MARK}":
            raise ValueError("only vocabularies with a dummy prefix and no other normalisation are supported")
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.kinds = [2 if lib.is_byte(i) else 1 if lib.is_control(i) or lib.is_unknown(i) else 0 for i in range(size)]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 0}
        scores = {p: lib.get_score(i) for p, i in self.ids.items()}
        order = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = _Ranks((p, order[x]) for p, x in scores.items())
        self.none = self.ranks.none = len(order)
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.digits = [str(i) for i in range(size)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == 2}
        self.unknown = lib.unk_id()
        self.plain = max(i for i, k in enumerate(self.kinds) if k) + 1  # from here on all ids are ordinary pieces
        if len(self.bytes) != 256:
            raise ValueError("only vocabularies with byte pieces are supported")
        # Where no piece has a mark behind another character, no piece reaches across the start of a run of marks.
        self.apart = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.most, self.longest = most, longest
        self.memo: dict[str, tuple[int, str, str]] = {}

    def agenda(self, text: str) -> list[str]:
        """Symbols of an escaped text after all joins."""
        return self._short(text) if len(text) <= 48 else self._long(text)

    def _short(self, text: str) -> list[str]:
        """The agenda as a list with an entry for each place, the rank of the pair's score: its least is the next."""
        ranks, none, symbols = self.ranks, self.none, list(text)
        rank = ranks.__getitem__  # none for what is no piece
        queue = list(map(rank, map(add, symbols, symbols[1:])))
        while queue:
            best = min(queue)
            if best == none:
                break
            i = queue.index(best)
            pair = symbols[i] + symbols.pop(i + 1)
            symbols[i] = pair
            del queue[i]
            if i:
                queue[i - 1] = ranks[symbols[i - 1] + pair]
            if i < len(queue):
                queue[i] = ranks[pair + symbols[i + 1]]
        return symbols

    def _long(self, text: str) -> list[str]:
        """The agenda as a heap of (rank of the score, place)."""
        rank, symbols, n = self.ranks, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                queue.append((rank[pair], i, i + 1, pair))
        heapq.heapify(queue)
        while queue:
            _, i, j, pair = heapq.heappop(queue)
            if not symbols[i] or not symbols[j] or after[i] != j or symbols[i] + symbols[j] != pair:
                continue  # one of the two was joined to another meanwhile
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if pair in rank:
                    heapq.heappush(queue, (rank[pair], i, k, pair))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in rank:
                    heapq.heappush(queue, (rank[pair], h, i, pair))
        return [s for s in symbols if s]

    def numbers(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; one that is no piece gives the ids of its bytes."""
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            return [i for s in symbols for i in ([self.ids[s]] if s in self.ids else [self.bytes[b] for b in s.encode("utf-8")])]

    def surface(self, ids: list[int]) -> str:
        """Text of ids, with its leading space; control ids give nothing, byte pieces are read as UTF-8."""
        if ids and min(ids) >= self.plain:
            return "".join([self.shown[i] for i in ids])
        out, held = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == 2:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                out.append(bytes(held).decode("utf-8", "replace"))
                held.clear()
            if kind == 0:
                out.append(self.shown[i])
            elif i == self.unknown:
                out.append(" ⁇ ")
        if held:
            out.append(bytes(held).decode("utf-8", "replace"))
        return "".join(out)

    def parts(self, text: str) -> list[str]:
        """A text's parts: words that begin with a mark, which is left out, or parts that show all their marks."""
        if self.apart and not ("  " in text or MARK in text or text[:1] == " " or text[-1:] == " "):
            return text.split(" ") if text else []
        text = MARK + text.replace(" ", MARK)
        if not self.apart:
            return [text] if text != MARK else []
        return [p[1:] if p[1:2] not in ("", MARK) else p for p in self.cut.findall(text)] if text != MARK else []

    @staticmethod
    def marked(part: str) -> str:
        return part if part[:1] == MARK else MARK + part

    def learn(self, new: list[str]) -> None:
        """Encodes and decodes new parts and compares both with the library; raises where they differ."""
        marked = [self.marked(p) for p in new]
        ids = [self.numbers(self.agenda(p)) for p in marked]
        # the library adds a mark of its own; marks alone go behind a line end
        alone = [p.strip(MARK) == "" for p in marked]
        shown = ["\n" + p.replace(MARK, " ") if w else p[1:].replace(MARK, " ") for p, w in zip(marked, alone)]
        if any(alone) and any("\n" in p for p in self.ids):
            raise ValueError("pieces with line ends aren't supported")
        for p, x, y, w in zip(marked, ids, self.library.encode(shown, num_threads=1), alone):
            if x != (y[2:] if w else y):
                raise ValueError(f"this part is encoded otherwise than by the library: {p[:80]!r}")
        texts = list(map(self.surface, ids))
        end = [self.bytes[10]]  # a line end before each part, so that no bytes of two parts meet
        if "\n" + "\n".join(texts) != self.library.decode([i for x in ids for i in end + x] if ids else end):
            raise ValueError("these parts are decoded otherwise than by the library")
        digits = self.digits
        self.memo.update((p, (len(x), ",".join([digits[i] for i in x]), t)) for p, x, t in zip(new, ids, texts))

    def batch(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        cut = [self.parts(t or "") for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        known = self.memo
        new = list(dict.fromkeys([p for parts in cut for p in parts if p not in known]))
        self.learn(new)
        for parts in cut:
            if parts:
                n, ids, shown = zip(*map(known.__getitem__, parts))
                yield sum(n), ",".join(ids), "".join(shown)[1:]
            else:
                yield 0, "", ""
        for p in new:
            if len(p) > self.longest:
                known.pop(p, None)

    def encode(self, text: str | None) -> list[int]:
        return [i for p in self.parts(text or "") for i in self.numbers(self.agenda(self.marked(p)))]

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids)."""
        text = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != 1 or i == self.unknown), None)
        return text[1:] if first is not None and self.kinds[first] == 0 and self.pieces[first].startswith(MARK) else text


@lru_cache(maxsize=4)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): the ids of each whole text and the text that these give.

    A null text counts as empty and gives no ids; repeated rows give a row each; other columns are not read.
    """

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                with without_gc():
                    rows = list(c.batch(part.column("text").to_pylist()))
                ids = [list(map(int, r[1].split(","))) if r[1] else [] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text: encode_texts without its wide columns."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for part in slices(batch):
                n, ids, decoded = [], [], []
                with without_gc():
                    for count, joined, text in c.batch(part.column("text").to_pylist()):
                        n.append(count)
                        ids.append(hashlib.sha256(joined.encode()).hexdigest())
                        decoded.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
