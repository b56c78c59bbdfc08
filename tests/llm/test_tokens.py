import hashlib
import random

import public_tokenizers
import pytest

from karyoframe.llm.piece_codec import codec, digest_texts, encode_texts
from karyoframe.llm.token_counts import count_tokens, merger

PIECE, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "\n", " \n ", "\n\n a", "a ", " a", "Hello  world", "a▁b", "▁▁x", "<s>hi</s> <0x0A>", "\x00\x1c\x1f\x85 \xa0x", "naïve café ﬁ é", "日本語 テスト", "😀 👩‍👩‍👧 x", "a" * 3000, " " * 501, "\t\t\tx", "don't we'll", "x <|endoftext|> y<|endoftext|>", "1234 56.7%", "ĠĊ Ġ", "…—“q”", "﻿x", "aaaa aaaaaaa", "x \n y", "\U000e0001 ok", "no  two   three    \n\n  end  "]


def fuzz(seed, n=300):
    rnd = random.Random(seed)
    alphabet = "abcde ABC  \n\t.,'!<|>0123é€ßñ日😀▁　\xa0"
    return ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_pieces_as_library():
    c, texts = codec(PIECE), fuzz(1)
    for t, (n, ids, decoded) in zip(texts, c.batch(texts)):
        own = c.library.encode(t)
        assert ids == ",".join(map(str, own)) and n == len(own)
        assert decoded == c.library.decode(own)
        assert c.encode(t) == own and c.decode(own) == decoded


@pytest.mark.parametrize("ids", [[], [1, 2], [0], [13, 29871], [259, 260], [195], [198, 260], [1, 15043]])
def test_piece_decode_of_any_ids(ids):
    c = codec(PIECE)
    assert c.decode(ids) == c.library.decode(ids)


def test_long_and_short_agendas_agree():
    c = codec(PIECE)
    for t in fuzz(4):
        for p in map(c.marked, c.parts(t)):
            assert c._short(p) == c._long(p)


def test_counts_as_library():
    m, texts = merger(BYTES), fuzz(2)
    assert m.rising
    assert m.batch(texts) == [len(m.library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_frames(spark):
    texts = ODD + [None]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, "x y", 7)], "doc_id long, text string, n_tokens int")
    c, m = codec(PIECE), merger(BYTES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in digest_texts(df, PIECE).collect():
        t = "x y" if r.doc_id is None else texts[r.doc_id] or ""
        ids = c.library.encode(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(c.library.decode(ids)))
    assert {r.doc_id: list(r.ids) for r in encode_texts(df, PIECE).collect()}[8] == c.library.encode(texts[8])
    for r in count_tokens(df, BYTES).collect():
        t = "x y" if r.doc_id is None else texts[r.doc_id] or ""
        n = len(m.library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
    assert count_tokens(df.limit(0), BYTES).count() == 0 and digest_texts(df.limit(0), PIECE).count() == 0


def test_added_tokens_of_any_form(tmp_path):
    import json

    spec = json.load(open(BYTES, encoding="utf-8"))
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": 50257, "content": "[END]"})
    json.dump(spec, open(f"{tmp_path}/own.json", "w", encoding="utf-8"))
    m, texts = merger(f"{tmp_path}/own.json"), ["a[END]b", "[END] [END]x <|endoftext|>", "[END", "", "[END]"]
    assert m.batch(texts) == [len(m.library.encode(t, add_special_tokens=False).ids) for t in texts]
