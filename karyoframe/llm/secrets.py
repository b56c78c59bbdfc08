"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate's features are its length and characters, how likely its character transitions are in words, how much of it
dictionary words cover, the path it stands in and the words around it. The forest is trained from labelled findings;
the default ones are made here by rule (see findings()); a table of own ones can be given (forest_from()), and a dictionary
that is a table or is counted from the corpus (corpus_dictionary()).
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, trimmed

_HINTS = ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:[a-z_\-]*(?:token|secret|passw(?:or)?d|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth[a-z]*|bearer|credentials?|key))[\"']?(?:\s*(?:=>|:=|[:=])\s*|\s+)[\"']?([^\s\"'<>,;()\[\]{}]{8,})")
_KNOWN = re.compile(r"(?<![A-Za-z0-9])(?:(AKIA[0-9A-Z]{16})|(gh[pousr]_[A-Za-z0-9]{36,})|(xox[abprs]-[A-Za-z0-9\-]{10,})|(sk-[A-Za-z0-9]{20,})|(eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+))(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)")
_DENSE = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}={0,2}")
_PATH = re.compile(r"(?:[\w.\-]+)?/[\w.\-/]+|[\w\-]+\.(?:py|js|ts|java|go|rb|c|h|env|cfg|conf|ini|yml|yaml|json|xml|md|txt|pem)\b")

#: Words by which false positives and secrets are told apart; a stand-in for a dictionary file; other words can be passed as ``dictionary``.
DICTIONARY = tuple(
    "access account action address admin alpha api app array auth base beta block bool branch build byte cache call case change char check class client code commit config const content count create current data date debug default delete demo digest div document domain done dummy edit email end entry error event example expired fail false field file final fixture flag float folder foo function get group guide handler hash head header hello here host html http https id image import index info init input insert int item json key label last length level library license line link list load local lock log login long main manager map mark master max message method min mock mode model module my name net new node none note null number object open option order output package page param parent parse pass password path place placeholder plain please point port print private process profile project public put query random read real ref release remove replace request reset response result return root row run sample save script search secret select send server service session set sha show size some sort source span start state static status step stop string style sub sum swap sync system table tag target task temp template test text the this time title todo token tool top total tree true type update upload url use user util value var version view void web while width window word work world write www your".split()
)
#: Words outside the dictionary, of which findings() makes passphrases.
_OTHER_WORDS = tuple("correct horse battery staple purple monkey dragon summer winter river mountain garden coffee silver golden orange banana rocket planet thunder shadow falcon tiger eagle whisky castle marble velvet copper meadow lantern anchor pepper walnut saddle turtle violin window guitar hammer kitten".split())
_SECRET_NEAR = ("token", "secret", "password", "passwd", "pwd", "key", "api", "auth", "bearer", "credential", "private", "access")
_OTHER_NEAR = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "revision", "etag", "integrity", "example", "sample", "dummy", "test", "build", "trace", "fingerprint", "image", "version")
FEATURES = ("length", "entropy", "digits", "upper", "lower", "marks", "switches", "transitions", "covered", "longest_word", "repeats", "hex", "uuid", "assigned", "known", "near_secret", "near_other", "path_test", "path_config")


class Lexicon:
    """A dictionary's words: log-likelihoods of character transitions within them (add-one counts), and where they stand."""

    def __init__(self, words: tuple[str, ...]):
        low = [w.lower() for w in words]
        seen = np.ones((27, 27))
        for w in low:
            for a, b in zip(w, w[1:]):
                if "a" <= a <= "z" and "a" <= b <= "z":
                    seen[ord(a) - 97, ord(b) - 97] += 1
        self.transitions = np.log2(seen / seen.sum(axis=1, keepdims=True)).tolist()
        self.words = frozenset(w for w in low if len(w) > 2)
        self.sizes = {c: sorted({len(w) for w in self.words if w[0] == c}, reverse=True) for c in {w[0] for w in self.words}}

    def found(self, low: str) -> list[int]:
        """Lengths of the words in a lower-case value, from the left, the longest first, without overlaps."""
        out, at = [], 0
        while at < len(low):
            n = next((n for n in self.sizes.get(low[at], ()) if low[at : at + n] in self.words), 0)
            if n:
                out.append(n)
            at += n or 1
        return out


@lru_cache(maxsize=2)
def lexicon(words: tuple[str, ...] = DICTIONARY) -> Lexicon:
    return Lexicon(words)


def features(value: str, before: str, after: str, path: str, assigned: bool, known: bool, words: Lexicon) -> list[float]:
    """Of one candidate with the text around it; in the order of FEATURES."""
    n, low = len(value), value.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    table = words.transitions
    pairs = [table[ord(a) - 97][ord(b) - 97] for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    found = words.found(low)
    near = (before[-40:] + " " + after[:20]).lower()
    place = (path or " ".join(_PATH.findall(before[-120:]))).lower()
    return [
        n, entropy, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("m") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, sum(pairs) / len(pairs) if pairs else -9.0,
        sum(found) / n, max(found, default=0), max(counts) / n,
        float(re.fullmatch(r"[0-9a-f]+", low) is not None), float(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low) is not None),
        float(assigned), float(known), sum(w in near for w in _SECRET_NEAR), sum(w in near for w in _OTHER_NEAR),
        float(re.search(r"test|example|sample|mock|fixture|doc|spec|readme|\.md", place) is not None), float(re.search(r"env|conf|cfg|prod|deploy|secret|\.ini|\.ya?ml", place) is not None),
    ]


def candidates(text: str | None) -> list[tuple[int, int, str, bool, bool]]:
    """(begin, end, kind, assigned, known) of what may be a secret, in order; code points. Overlapping ones are one: their union."""
    if not text:
        return []
    found: list[tuple[int, int, str, bool, bool]] = []
    low = text.lower()
    if "-----begin " in low:
        found += [(m.start(), m.end(), "private key", False, True) for m in _PEM.finditer(text)]
    if any(p in text for p in ("AKIA", "gh", "xox", "sk-", "eyJ")):
        names = ("access key id", "platform token", "chat token", "service key", "web token")
        found += [(m.start(), m.end(), names[m.lastindex - 1], False, True) for m in _KNOWN.finditer(text)]
    if any(h in low for h in _HINTS):
        found += [(m.start(1), m.end(1), "assigned", True, False) for m in _ASSIGNED.finditer(text)]
    found += [(m.start(), m.end(), "dense", False, False) for m in _DENSE.finditer(text) if m[0].count(m[0][0]) < len(m[0])]  # a run of one character tells nothing
    out: list[tuple[int, int, str, bool, bool]] = []
    for c in sorted(found, key=lambda c: (c[0], -c[1], not c[4], not c[3])):
        if not out or c[0] >= out[-1][1]:
            out.append(c)
        else:
            p = out[-1]
            out[-1] = (p[0], max(p[1], c[1]), p[2] if (p[4], p[3]) >= (c[4], c[3]) else c[2], p[3] or c[3], p[4] or c[4])
    return out


class Forest:
    """A random forest of two classes: bootstrap samples, a random part of the features at each split, mean of leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, seed: int = 11):
        self.rnd, self.depth = np.random.default_rng(seed), depth
        self.some = max(2, round(math.sqrt(x.shape[1])) + 1)
        self.trees = []
        for _ in range(trees):
            at = self.rnd.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[at], y[at].astype(float), 0, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list[list[float]]) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, y.mean() if len(y) else 0.5])  # feature, threshold, left, right, share of secrets
        if depth == self.depth or len(y) < 6 or y.min() == y.max():
            return me
        best = (1e-9, -1, 0.0)
        whole = len(y) * y.mean() * (1 - y.mean())
        for f in self.rnd.choice(x.shape[1], self.some, replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            edge = np.flatnonzero(v[1:] > v[:-1])
            if len(edge):
                n = edge + 1.0
                left, right = c[edge] / n, (c[-1] - c[edge]) / (len(y) - n)
                gain = whole - n * left * (1 - left) - (len(y) - n) * right * (1 - right)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float(v[edge[k]] + v[edge[k] + 1]) / 2)
        if best[1] < 0:
            return me
        go = x[:, best[1]] <= best[2]
        nodes[me][:2] = best[1], best[2]
        nodes[me][2] = self._grow(x[go], y[go], depth + 1, nodes)
        nodes[me][3] = self._grow(x[~go], y[~go], depth + 1, nodes)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        """The share of secrets that the trees expect, for each row."""
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = t[at, 0].astype(np.int64)
                go = f >= 0
                side = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(go, side, at)
            total += t[at, 4]
        return total / len(self.trees)


def findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, str, bool]]:
    """Labelled findings (before, value, after, path, is it a secret), made by rule: half secrets, half false positives."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = lambda: " ".join("".join(rnd.choice(("an", "er", "th", "ion", "st", "re", "le", "da", "en")) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(2, 6)))
    out = []
    for i in range(n):
        name = rnd.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "SECRET_KEY", "client_secret"])
        sign, quote = rnd.choice([" = ", ": ", "=", " => "]), rnd.choice(['"', "'", ""])
        good = rnd.choice(["", "config/prod.env", "deploy/settings.yml", "src/app/main.py"])
        odd = rnd.choice(["", "", "tests/fixtures/data.json", "docs/example.md", "src/app/main.py"])
        if i % 2 == 0:
            kind = rnd.randrange(9)
            many = [rnd.choice(_OTHER_WORDS) for _ in range(rnd.randrange(3, 6))]
            value = (pick(hexa, rnd.choice([32, 40, 40, 64])), pick(alnum, rnd.randrange(20, 60)), pick(alnum + "+/", 40), "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + pick(alnum, 36), f"-----BEGIN {rnd.choice(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n{pick(alnum, rnd.randrange(6, 200))}\n-----END PRIVATE KEY-----",
                     pick(alnum + ".%$~@", rnd.choice([60, 150, 250, 400, 900])), pick(alnum[:52], rnd.randrange(16, 48)), rnd.choice(["".join(w.title() for w in many), "".join(many)]))[kind]
            before = f"{prose()} {name}{sign}{quote}" if kind < 3 or kind > 5 or rnd.random() < 0.5 else f"{prose()} "
            out.append((before, value, f"{quote} {prose()}", good, True))
        else:
            kind = rnd.randrange(12)
            syllables = lambda a, b: "".join(rnd.choice(("an", "er", "th", "ion", "st", "re", "le", "da", "en")) for _ in range(rnd.randrange(a, b)))
            words = [rnd.choice(DICTIONARY) for _ in range(5)]
            value = (
                pick(hexa, rnd.choice([32, 40, 64])),
                "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
                rnd.choice("_-/").join(words) + str(rnd.randrange(100)),
                rnd.choice(["your_" + name.lower() + "_here", "x" * 24, "changeme123", "1234567890" * 3, "<" + name + ">", "example_" + name + "_1", "REPLACE_ME_0", "0" * 32]),
                "".join(w.title() for w in words) + str(rnd.randrange(10)),
                pick("0123456789", rnd.randrange(20, 30)),
                rnd.choice(["=", "-", "_"]) * rnd.randrange(20, 50) + str(rnd.randrange(10)),
                "/".join(words) + f"/{rnd.choice(words)}{rnd.randrange(100)}.html",
                rnd.choice([syllables(4, 7), syllables(4, 7).title(), rnd.choice([w for w in DICTIONARY + _OTHER_WORDS if len(w) > 7])]),
                syllables(9, 14),
                rnd.choice(["/", "-", "_", ""]).join(w.title() if rnd.random() < 0.5 else w for w in words),
                "/".join(rnd.choice(DICTIONARY) for _ in range(rnd.randrange(5, 60))) + ".html",
            )[kind]
            near = {0: ["commit ", "sha1: ", "md5 = ", "checksum: ", "digest ", "revision "], 1: ["uuid: ", "id = ", "trace ", "guid "], 3: [f"{name}{sign}{quote}"], 8: [f"{name} ", "author ", "key ", "secret "], 9: [""], 10: ["", "see ", "class "]}.get(kind, ["", "see ", "class ", "file ", f"{name}{sign}"])
            out.append((f"{prose()} {rnd.choice(near)}", value, f" {prose()}", odd, False))
    return out


def featured(labelled: list[tuple[str, str, str, str, bool]], dictionary: tuple[str, ...] = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings, with what candidates() says of each where it stands."""
    x, y = [], []
    for before, value, after, path, secret in labelled:
        text, at = before + value + after, len(before)
        c = next((c for c in candidates(text) if c[0] < at + len(value) and c[1] > at), (at, at + len(value), "", False, False))
        x.append(features(text[c[0] : c[1]], text[max(0, c[0] - 120) : c[0]], text[c[1] : c[1] + 40], path, c[3], c[4], lexicon(dictionary)))
        y.append(secret)
    return np.array(x), np.array(y)


@lru_cache(maxsize=2)
def default_forest(dictionary: tuple[str, ...] = DICTIONARY) -> Forest:
    return Forest(*featured(findings(), dictionary))


#: Labelled findings that a forest is trained from, and words of a dictionary, at most.
MAX_FINDINGS, MAX_WORDS = 20_000, 200_000


def forest_from(labelled: DataFrame, dictionary: tuple[str, ...] = DICTIONARY, most: int = MAX_FINDINGS) -> Forest:
    """A forest trained from a table of labelled findings (before, value, after, path, secret): ``most`` of them, chosen by a digest.

    Rows without a value or a label count for nothing, other nulls are empty texts; one kind of label alone is an error.
    """
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("before", "value", "after", "path")]
    rows = labelled.where("length(value) > 0 and secret is not null").select(*texts, F.col("secret").cast("boolean").alias("secret"))
    rows = rows.orderBy(F.md5(F.concat_ws("\u0001", "before", "value", "after", "path")), "secret").limit(most).collect()
    if len({r.secret for r in rows}) < 2:
        raise ValueError("labelled findings of both kinds are needed")
    return Forest(*featured([tuple(r) for r in rows], dictionary))


def corpus_dictionary(docs: DataFrame, least: int = 20, most: int = MAX_WORDS) -> DataFrame:
    """(word, n): words of 3 to 20 letters a-z in any case that at least ``least`` rows of ``docs`` have, the ``most`` common ones.

    All rows and whole texts are counted, each row once for a word; counts are combined before the shuffle.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?<![a-z])[a-z]{3,20}(?![a-z])"), F.lit(0)))
    held = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return held.orderBy(F.desc("n"), "word").limit(most)


def dictionary_words(dictionary: tuple[str, ...] | DataFrame) -> tuple[str, ...]:
    """The words of a dictionary that is a tuple or a table with a column ``word``, MAX_WORDS of the latter at most."""
    if isinstance(dictionary, DataFrame):
        return tuple(r.word for r in dictionary.where("length(word) > 0").select("word").distinct().orderBy("word").limit(MAX_WORDS).collect())
    return tuple(dictionary)


def _scan(texts: list[str | None], paths: list[str | None], forest: Forest, least: float, words: Lexicon) -> list[list[tuple[int, int, str, float, bool]]]:
    """(begin, end, kind, score, secret) of each text's candidates."""
    found = [candidates(t) for t in texts]
    x = [features(t[b:e], t[max(0, b - 120) : b], t[e : e + 40], p or "", assigned, known, words) for t, p, cs in zip(texts, paths, found) for b, e, _, assigned, known in cs]
    scores = iter(np.round(forest.score(np.array(x)), 4).tolist() if x else [])
    return [[(b, e, k, s := next(scores), s >= least) for b, e, k, _, _ in cs] for cs in found]


def redact(text: str, found: list[tuple[int, int, str, float, bool]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for b, e, _, _, secret in found:
        if secret:
            out += [text[at:b], mark]
            at = e
    return "".join([*out, text[at:]])


def _paths(part: pa.RecordBatch) -> list[str | None]:
    return part.column("path").to_pylist() if "path" in part.schema.names else [None] * len(part)


def scan_secrets(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, dictionary: tuple[str, ...] | DataFrame = DICTIONARY) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, findings, redacted) for each row of ``docs`` (doc_id, text; path if there is one).

    findings is an array of (begin, end, kind, score, secret) in code points; redacted is the text with "[SECRET]" for
    each secret. An own forest should be trained from findings featured() with the same dictionary. A null text has none and stays null; repeated rows give a row each; an empty table gives no rows.
    """
    dictionary = dictionary_words(dictionary)
    model = docs.sparkSession.sparkContext.broadcast((forest or default_forest(dictionary), lexicon(dictionary)))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                found = _scan(texts, _paths(part), model.value[0], least, model.value[1])
                rows = [[dict(zip(("begin", "end", "kind", "score", "secret"), f)) for f in fs] for fs in found]
                clean = [t if t is None else redact(t, fs) for t, fs in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(x[4] for x in f) for f in found], pa.int64()), pa.array(rows, kind), pa.array(clean, pa.string())], names=["doc_id", "n_candidates", "n_secrets", "findings", "redacted"])

    own = ["path"] if "path" in docs.columns else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *own)
    return small_batches(rows).mapInArrow(trimmed(run), "doc_id long, n_candidates long, n_secrets long, findings array<struct<begin:int,end:int,kind:string,score:double,secret:boolean>>, redacted string")


def secret_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans, redacted_sha256): scan_secrets with spans as begin-end:kind and a digest."""
    found = scan_secrets(docs)
    spans = F.array_join(F.transform(F.filter("findings", lambda f: f["secret"]), lambda f: F.concat(f["begin"].cast("string"), F.lit("-"), f["end"].cast("string"), F.lit(":"), f["kind"])), ";")
    return found.select("doc_id", "n_candidates", "n_secrets", spans.alias("spans"), F.sha2(F.encode(F.coalesce("redacted", F.lit("")), "UTF-8"), 256).alias("redacted_sha256"))


def without_secrets(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, dictionary: tuple[str, ...] | DataFrame = DICTIONARY) -> DataFrame:
    """``docs`` with all its columns and each secret in text replaced; n_chars, where there is one, is counted again."""
    dictionary = dictionary_words(dictionary)
    model = docs.sparkSession.sparkContext.broadcast((forest or default_forest(dictionary), lexicon(dictionary)))
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                clean = [t if t is None else redact(t, fs) for t, fs in zip(texts, _scan(texts, _paths(part), model.value[0], least, model.value[1]))]
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(clean, part.schema.field(at).type))
                if "n_chars" in part.schema.names:
                    at = part.schema.get_field_index("n_chars")
                    old = part.column(at).to_pylist()
                    counts = [n if new == t else None if new is None else len(new) for n, t, new in zip(old, texts, clean)]
                    part = part.set_column(at, part.schema.field(at), pa.array(counts, part.schema.field(at).type))
                yield part

    return small_batches(docs).mapInArrow(trimmed(run), schema)
