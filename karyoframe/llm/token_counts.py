"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie in one flat array of symbols. In each round every sequence finds its pair of least rank, all
its occurrences are joined at once, and the array is compacted; what is left when no pair has a rank are the tokens.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, without_gc

#: The pre-tokenising pattern of the rank files' public description; its white space is Unicode's White_Space.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies, and these bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    def __init__(self, path: str, most: int = 1_000_000, longest: int = 128):
        """``most``: chunks kept in the memo before it starts anew; ``longest``: characters of a chunk that is kept."""
        import tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only byte-level BPE without a normaliser is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens without spaces are supported")
        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))) if spec["added_tokens"] else None
        added = [t["content"] for t in spec["added_tokens"]]
        self.sign = "<" if all("<" in t for t in added) else ""  # what every added token has
        self.pattern, self.plain = regex.compile(PATTERN), regex.compile(r"[\x00-ɏ‐-‧]*")
        vocab, letters = model["vocab"], byte_symbols()
        self.base = np.zeros(256, dtype=np.int64)
        for c, b in letters.items():
            self.base[b] = vocab[c]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        born = {int(j): r for r, j in reversed(list(enumerate(joined)))}
        # a join only makes pairs of a later rank: so a sequence's least pair may be joined everywhere at once
        self.rising = all(born.get(int(x), -1) < r for r, (a, b) in enumerate(zip(left, right)) for x in (a, b))
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        first = np.concatenate(([True], np.diff(keys[order]) > 0))
        # later entries replace earlier ones of the same pair
        last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(order) - 1]))
        self.keys, self.ranks = keys[order][first], order[last]
        self.made = joined[self.ranks]
        self._hash()
        self.double = re.compile(r" (?:\s|$)").search
        self.simple = re.compile(r" ?\S+").fullmatch
        self.most, self.longest, self.memo = most, longest, {}

    def _hash(self) -> None:
        """A table of places in ``keys``, in which a pair is found by a few probes."""
        self.shift = np.uint64(64 - max(10, (8 * len(self.keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.table, self.probes = np.full(size, -1, dtype=np.int64), 0
        todo = np.arange(len(self.keys))
        while len(todo):
            at = (self._home(self.keys[todo]) + self.probes) % size
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            todo = todo[self.table[at] != todo]
            self.probes += 1
        self.keyed = np.where(self.table < 0, -1, self.keys[np.maximum(self.table, 0)])

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """Places of the pairs in ``keys``, -1 where there is none."""
        at, size = self._home(pairs), len(self.table)
        out = np.where(self.keyed[at] == pairs, self.table[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keyed[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (self._home(pairs[open_]) + step) % size
            hit = self.keyed[at] == pairs[open_]
            out[open_[hit]] = self.table[at[hit]]
            open_ = open_[~hit & (self.keyed[at] >= 0)]
        return out

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token (of one byte or more)."""
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        out = sizes.copy()
        symbols = self.base[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        none = len(self.made)
        while len(symbols) > 1:
            pair = symbols[:-1] * self.width + symbols[1:]
            at = self.find(pair)
            known = (at >= 0) & (seq[:-1] == seq[1:])
            rank = np.where(known, self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.minimum.reduceat(np.append(rank, none), starts)
            live = least < none
            if not live.any():
                break
            length = np.diff(np.append(starts, len(seq)))
            hit = np.append(rank, none) == np.repeat(np.where(live, least, -1), length)
            where = np.flatnonzero(hit)
            # occurrences that overlap (a run of one symbol): every second one from the left
            run = np.concatenate(([True], (np.diff(where) > 1) | (seq[where[1:]] != seq[where[:-1]])))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            take = (np.arange(len(where)) - begin) % 2 == 0
            if not self.rising:
                fresh = np.concatenate(([True], seq[where[1:]] != seq[where[:-1]]))
                take &= fresh
            where = where[take]
            symbols[where] = self.made[at[where]]
            keep = np.repeat(live, length)  # sequences without a pair are done
            out -= np.bincount(seq[where], minlength=len(out))
            keep[where + 1] = False
            symbols, seq = symbols[keep], seq[keep]
        return out

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens; characters whose class may differ between Unicode versions are left to the library's splitter."""
        if self.plain.fullmatch(chunk):
            return self.pattern.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def learn(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk."""
        tokens, owner, extra = [], [], [0] * len(chunks)
        # chunks without inner white space are split together, with a line end between them, which is a token of its own
        easy = [bool(self.simple(c)) and not (self.special and self.sign in c) and self.plain.fullmatch(c) is not None for c in chunks]
        together = [i for i, e in enumerate(easy) if e]
        at = iter(together)
        for part in self.pattern.findall("".join([chunks[i] + "\n" for i in together])):
            if part != "\n":
                tokens.append(part)
                owner.append(-1)
            else:
                k = len(owner) - 1
                i = next(at)
                while k >= 0 and owner[k] == -1:
                    owner[k] = i
                    k -= 1
        for i, chunk in enumerate(chunks):
            if easy[i]:
                continue
            pieces = [chunk]
            if self.special and self.sign in chunk and self.special.search(chunk):
                extra[i], pieces = len(self.special.findall(chunk)), self.special.split(chunk)
            for piece in pieces:
                got = self.split(piece)
                tokens += got
                owner += [i] * len(got)
        n = np.array(extra, dtype=np.int64)
        if tokens:
            distinct = {t: k for k, t in enumerate(dict.fromkeys(tokens))}
            each = self.counts([t.encode("utf-8") for t in distinct])
            np.add.at(n, np.array(owner), each[np.fromiter(map(distinct.__getitem__, tokens), dtype=np.int64, count=len(tokens))])
        return n.tolist()

    def chunks(self, text: str) -> tuple[list[str], list[str]]:
        """Parts between which no pre-token reaches: cut before a space that no white space follows.

        Words whose leading space is left out, and the other parts as they are.
        """
        parts = text.split(" ")
        if not self.double(text):
            return parts[1:], [parts[0]] if parts[0] else []
        words, others, open_ = [], [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace():
                if open_:
                    others.append(open_)
                open_ = " " + p
            else:
                open_ += " " + p
        others.append(open_)
        return words, others

    def batch(self, texts: list[str | None]) -> list[int]:
        cut = [self.chunks(t) if t else ([], []) for t in texts]
        if len(self.memo) > self.most:
            self.memo.clear()
        known = self.memo
        new = list(dict.fromkeys([w for words, _ in cut for w in words if w not in known]))
        known.update(zip(new, self.learn([" " + w for w in new])))
        others = list(dict.fromkeys([o for _, others in cut for o in others]))
        more = dict(zip(others, self.learn(others)))
        out = [sum(map(known.__getitem__, words)) + sum(map(more.__getitem__, rest)) for words, rest in cut]
        for w in new:
            if len(w) > self.longest:
                known.pop(w, None)
        return out


@lru_cache(maxsize=4)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each whole text, as the tokenizers library counts with ``path``.

    A null text counts as empty: 0 bytes, 0 tokens. A special token's string in a text is one token, as by the library's
    default. Repeated rows give a row each; other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        m = merger(path)
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                with without_gc():
                    n = m.batch(texts)
                sizes = pa.compute.fill_null(pa.compute.cast(pa.compute.binary_length(part.column("text")), pa.int64()), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
