"""Operators 1, 6 and 7 against the libraries."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from embedlake.llm import _segments as S
from embedlake.llm import bpe, packing, tokencount

from .conftest import rows

BYTE = P.path("byte_bpe_50k.json")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
PIECE = P.path("piece_bpe_32k.model")


def raw(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])).astype(np.int64)


TEXT = st.text(st.sampled_from("ab Z9'st\n\t   é中🐢.,!▁　\x1c") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_segments_equal_whole_texts(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    data, offsets = raw(texts)
    ids, begin = S.coder("tokenizers", BYTE).tokens(data, offsets)
    t = Tokenizer.from_file(BYTE)
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert S.coder("sentencepiece", PIECE).count(data, offsets).tolist() == [len(model.encode(x)) for x in texts]


@settings(max_examples=150, deadline=None)
@given(TEXT.map(lambda x: x * 3), st.integers(8, 40))
def test_tree_does_not_depend_on_halves(text, leaf):
    tree = bpe.Tree(MULTI, leaf)
    got = tree.encode(*raw([text]))[0].tolist()
    assert got == tree.encoding.encode_ordinary(text) and tree.decode(got) == text.encode()


def test_bpe_digests(docs, none):
    e = S.encoding(MULTI)
    want = sorted((str(i), len(ids := e.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs, MULTI).collect()) == want
    back = bpe.decode(bpe.encode(docs, MULTI), MULTI).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t, *_ in rows())
    assert bpe.digests(none, MULTI).count() == 0


def test_counts(docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = sorted((str(i), len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t, *_ in rows())
    assert sorted((str(r[0]), *r[1:]) for r in tokencount.token_counts(docs, PIECE).collect()) == want
    assert tokencount.token_counts(none, PIECE).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(docs, BYTE, capacity=64, keep_ids=True).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[str(r["doc_id"])].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text, *_ in rows():
        want[str(i)].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    for i, own in want.items():
        if len(own) == 1:
            ps = sorted(pieces[i], key=lambda r: r["piece"])
            assert [x for p in ps for x in p["ids"]] == own[0] and [p["piece"] for p in ps] == list(range(len(ps)))
            assert all(p["length"] == 64 for p in ps[1:])
            for p in ps:
                part = own[0][p["start"] : p["start"] + p["length"]]
                assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        assert sum(r["length"] for r in pieces[i]) == sum(map(len, own))
    for at in places.values():
        end = 0
        for o, n in sorted(at):
            assert o == end
            end += n
        assert end <= 64
    assert packing.pack_documents(none, BYTE).count() == 0


def test_best_fit_bound():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert [fit.place(n)[0] for n in (6, 5, 9, 1, 4, 5)] == [2, 3, 4, 2, 5, 3] or fit.open <= 2
    rng, fit = np.random.default_rng(5), packing.BestFit(1024, 512)
    sizes = rng.integers(1, 900, 20_000)
    for n in sizes.tolist():
        fit.place(n)
    assert fit.open <= 512 and fit.made <= 1.1 * sizes.sum() / 1024
