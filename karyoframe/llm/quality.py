"""Quality rules learned from labels: a decision list of threshold conjunctions, run as a Spark conditional expression.

Statistics of whole texts are taken an Arrow batch at a time. From labelled rows, sequential covering learns rules for
the texts to reject: a rule grows by the threshold of greatest information gain until it covers no good text, is pruned
on rows that it was not grown on, and is kept only if it is precise there; what it covers is set aside. Rules are tried
in order, and a text that none rejects is kept.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, slices, small_batches, trimmed
from .shingles import BLOCK_BYTES, SEPARATOR, mix64, windows, words_of

_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
WINDOW = 8
#: Counts of a text, in the order of text_stats(); the first five are those of the base rules.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_digits", "n_bars", "n_distinct", "n_lone", "n_rows")
#: Statistics that rules may test: a count for each thousand of another.
RATES = {
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "shouts": ("n_shouts", "n_words"),
    "digits": ("n_digits", "word_chars"),
    "bars": ("n_lone", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_length": ("n_words", "n_lines"),
}
#: Labelled rows that the rules are learned from, at most; chosen by a digest of their doc_id.
MAX_LABELS = 20_000


def byte_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text has each byte: a row of 256 for each."""
    n = len(offsets) - 1
    out = np.zeros((n, 256), dtype=np.int64)
    for p in range(0, len(data), BLOCK_BYTES):
        q = min(len(data), p + BLOCK_BYTES)
        i, j = int(np.searchsorted(offsets, p, side="right")) - 1, int(np.searchsorted(offsets, q, side="left"))
        lengths = np.minimum(offsets[i + 1 : j + 1], q) - np.maximum(offsets[i:j], p)
        key = np.repeat(np.arange(j - i) << 8, lengths)
        key += data[p:q]
        out[i:j] += np.bincount(key, minlength=(j - i) << 8).reshape(-1, 256)
    return out


def _twice(text: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which entries have a value that their text has twice or more."""
    key = mix64(values ^ mix64(text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def text_stats(texts: pa.Array | list[str | None]) -> np.ndarray:
    """Counts of each text, a row each. Words are runs of anything but the bytes 0x20 and 0x09-0x0D.

    Repeated lines and windows are looked for by 64-bit values and then counted by the bytes themselves.
    """
    words = words_of(texts)
    sizes, n = words.counts, len(words.counts)
    bytes_ = byte_counts(words.data, words.offsets)
    of = lambda kind: bytes_[:, list(kind)].sum(axis=1)
    spaces, follow = bytes_[:, SEPARATOR].sum(axis=1), bytes_[:, 0x80:0xC0].sum(axis=1)
    # distinct words, and windows of words that stay within their text
    key = np.sort(mix64(words.values ^ mix64(words.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
    distinct = sizes.copy()
    if len(key) and (key[1:] == key[:-1]).any():
        order = np.lexsort((words.values, words.text))
        v, t = words.values[order], words.text[order]
        distinct = np.bincount(t[np.concatenate(([True], (v[1:] != v[:-1]) | (t[1:] != t[:-1])))], minlength=n)
    begin = words.first()
    whole = np.flatnonzero(np.arange(len(words.values)) + WINDOW <= (begin + sizes)[words.text])
    twice = whole[_twice(words.text[whole], windows(words.values, WINDOW)[whole])]
    repeated = np.zeros(n, dtype=np.int64)
    for i, at in _by_text(words.text[twice], twice):
        repeated[i] = _repeat_words(words.raw(i).split(), (at - begin[i]).tolist())
    # lines that have a word, told apart by their first and last word, their words and their length
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.starts) + words.text  # another text, another line
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, dtype=np.int64)
    last = np.concatenate((first[1:], [len(line)])) - 1 if len(first) else first
    lines = np.bincount(words.text[first], minlength=n)
    mark = mix64(words.values[first]) + words.values[last] * np.uint64(3) + (last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    copies = np.zeros(n, dtype=np.int64)
    for i, _ in _by_text(*(2 * [words.text[first][_twice(words.text[first], mark)]])):
        held = [x for x in words.raw(i).split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        copies[i] = len(held) - len(set(held))
    lone = np.bincount(words.text[(words.sizes == 1) & np.isin(words.data[words.starts], np.frombuffer(b"|-*", np.uint8))], minlength=n)
    return np.stack((sizes, np.diff(words.offsets) - spaces - follow, of(_SYMBOLS), copies, repeated, lines, of(_UPPER), of(b"!"), of(_DIGITS), of(b"|"), distinct, lone, of(b"\n")), axis=1).astype(np.int64)


def _by_text(text: np.ndarray, values: np.ndarray):
    """(text, its values) of each text; ``text`` ascends."""
    cuts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else []
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        yield int(text[a]), values[a:b]


def _repeat_words(words: list[bytes], maybe: list[int]) -> int:
    """Words that stand in a window of 8 words which the text has twice or more; ``maybe`` are where such ones may begin."""
    first: dict[tuple, int] = {}
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    counted = set()
    for i in maybe:
        at = first.setdefault(tuple(words[i : i + WINDOW]), i)
        if at != i:
            counted |= {at, i}
    for k in counted:
        inside[k] += 1
        inside[k + WINDOW] -= 1
    return int((np.cumsum(inside[:-1]) > 0).sum())


def with_stats(docs: DataFrame, carry: list[str], own: str = "_") -> DataFrame:
    """The columns ``carry`` of ``docs`` and the counts of its text, each named with ``own`` in front."""
    at = "text" if "text" in carry and dict(docs.dtypes)["text"] == "string" else f"{own}text"  # a text travels once
    kept = docs.select(*carry) if at == "text" else docs.select(*carry, F.col("text").cast("string").alias(at))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*carry).schema] + [f"`{own}{c}` long" for c in COUNTS])

    def run(batches):
        for batch in batches:
            for part in slices(batch, at, 1 << 20):
                stats = text_stats(part.column(at))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *[pa.array(stats[:, k]) for k in range(len(COUNTS))]], names=[*carry, *[f"{own}{c}" for c in COUNTS]])

    return small_batches(kept).mapInArrow(trimmed(run), schema)


def base_failed(own: str = "_") -> Column:
    return F.expr(f"`{own}n_words` < 20 or 100 * `{own}n_repeat_words` > 30 * `{own}n_words`")


def rates(stats: pd.DataFrame) -> pd.DataFrame:
    """The statistics that rules test, as whole thousandths, like rate()."""
    return pd.DataFrame({k: 1000 * stats[f"_{a}"] // stats[f"_{b}"].clip(lower=1) for k, (a, b) in RATES.items()})


def rate(name: str, own: str = "_") -> Column:
    a, b = RATES[name]
    return F.expr(f"1000 * `{own}{a}` div greatest(`{own}{b}`, 1)")


@dataclass(frozen=True)
class Rule:
    """Rejects a text if all tests hold: (statistic, True for at least or False for at most, thousandths)."""

    tests: tuple[tuple[str, bool, int], ...]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, least, value in self.tests:
            out &= (x[name].to_numpy() >= value) if least else (x[name].to_numpy() <= value)
        return out

    def column(self, own: str = "_") -> Column:
        out = F.lit(True)
        for name, least, value in self.tests:
            out = out & ((rate(name, own) >= value) if least else (rate(name, own) <= value))
        return out


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gain of a test that leaves p of p0 bad and n of n0 good texts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _grow(x: pd.DataFrame, bad: np.ndarray, most_tests: int) -> Rule:
    tests: list[tuple[str, bool, int]] = []
    inside = np.ones(len(x), dtype=bool)
    while len(tests) < most_tests and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        best: tuple[float, tuple[str, bool, int] | None] = (0.0, None)
        for name in x.columns:
            v, b = x[name].to_numpy()[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            edge = np.flatnonzero(v[1:] != v[:-1])
            below_p, below_n = np.cumsum(b)[edge], np.cumsum(~b)[edge]
            for least, p, n, value in ((False, below_p, below_n, v[edge]), (True, p0 - below_p, n0 - below_n, v[edge + 1] if len(edge) else v[:0])):
                if len(edge):
                    gain = _gain(p0, n0, p.astype(float), n.astype(float))
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        middle = (int(v[edge[k]]) + int(v[edge[k] + 1]) + 1) // 2  # half way to the texts left out
                        best = (float(gain[k]), (name, least, middle if least else middle - 1))
        if best[1] is None:
            break
        tests.append(best[1])
        inside = Rule(tuple(tests)).covers(x)
    return Rule(tuple(tests))


def _prune(rule: Rule, x: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, float]:
    """The shortest beginning of a rule that does best on rows it was not grown on, and its precision there."""
    best, score, precise = rule, -2.0, 0.0
    for k in range(1, len(rule.tests) + 1):
        cover = (short := Rule(rule.tests[:k])).covers(x)
        p, n = int((cover & bad).sum()), int((cover & ~bad).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > score:
            best, score, precise = short, value, p / (p + n) if p + n else 0.0
    return best, precise


def learn_rules(x: pd.DataFrame, bad: np.ndarray, least_precision: float = 0.97, most_rules: int = 24, most_tests: int = 4) -> list[Rule]:
    """An ordered list of rules that reject, from statistics and labels; empty without both kinds of labels.

    Every third row in the given order is left for pruning. A rule that covers no bad text there, or is less precise
    than ``least_precision``, ends the search.
    """
    rules: list[Rule] = []
    third = np.arange(len(x)) % 3 == 2
    open_ = np.ones(len(x), dtype=bool)
    while len(rules) < most_rules and (open_ & bad & ~third).sum() >= 3 and (open_ & ~bad & ~third).any():
        grow, prune = open_ & ~third, open_ & third
        rule = _grow(x[grow], bad[grow], most_tests)
        if not rule.tests:
            break
        rule, precise = _prune(rule, x[prune], bad[prune])
        cover = rule.covers(x)
        if precise < least_precision or not (cover & open_ & bad).any():
            break
        rules.append(rule)
        open_ &= ~cover
    return rules


def verdict(rules: list[Rule], own: str = "_") -> Column:
    """True for texts to keep: the decision list as an ordered conditional expression."""
    out = F.when(base_failed(own), F.lit(False))
    for rule in rules:
        out = out.when(rule.column(own), F.lit(False))
    return out.otherwise(F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> pd.DataFrame:
    """Counts and labels (_bad) of at most ``most`` labelled doc_ids, ordered by a digest of doc_id.

    Of rows that share a doc_id those with the least counts stand for it, so that there is a row for each id at most.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)
    rows = with_stats(docs.join(F.broadcast(marks), "doc_id").select("doc_id", "_quality", "text"), ["doc_id", "_quality"])
    rows = rows.groupBy("doc_id", "_quality").agg(F.min(F.struct(*[f"_{c}" for c in COUNTS])).alias("_s"))
    out = rows.select("doc_id", "_quality", "_s.*").toPandas()
    out["_bad"] = out["_quality"] == 0
    digest = out["doc_id"].astype(str).map(lambda d: hashlib.md5(d.encode()).hexdigest())
    return out.assign(_digest=digest).sort_values(["_digest", "doc_id"], ignore_index=True)


def rules_from(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> list[Rule]:
    found = labelled(docs, labels, most)
    found = found[(found["_n_words"] >= 20) & (100 * found["_n_repeat_words"] <= 30 * found["_n_words"])].reset_index(drop=True)
    return learn_rules(rates(found), found["_bad"].to_numpy(dtype=bool))


def judge(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of ``docs``.

    ``labels`` (doc_id, quality 0 or 1): rows with nulls count for nothing, of contradicting ones the lower counts;
    without usable labels only the base rules decide. A null or empty text has no words and fails. Repeated rows give a
    row each; other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = rules_from(docs, labels, most)
    stats = with_stats(docs, ["doc_id"])
    return stats.select("doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep; nulls, repeated rows and labels as in judge()."""
    rules = rules_from(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, most)
    own = free_prefix(docs.columns)
    return with_stats(docs, docs.columns, own).where(verdict(rules, own)).select(*docs.columns)
