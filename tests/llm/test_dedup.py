"""Operators 2, 4, 5 and 10 against brute force."""

import hashlib
import itertools

import numpy as np
import pytest

from embedlake.llm import embed_join, lines, ngram_join, queries, substring
from embedlake.llm._work import Workspace, connected_components

from .conftest import SCHEMA, WORD, prose, rows

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, n=5):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(items, linked):
    """Smallest id that links reach, by position."""
    up = list(range(len(items)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(items)), 2):
        if linked(items[a], items[b]):
            up[find(b)] = find(a)
    least = {}
    for k, (i, *_) in enumerate(items):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) if i is None or find(k) in least else i for k, (i, *_) in enumerate(items)]


def alike(a, b):
    both = len(a[1] & b[1])
    return bool(a[1] and b[1]) and 100 * both >= 80 * (len(a[1]) + len(b[1]) - both)


def check_join(spark, texts, **dealt):
    items = [(i, shingles(t)) for i, t in texts]
    want = sorted((str(i), len(s), str(c)) for (i, s), c in zip(items, components(items, alike), strict=True))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.jaccard_components(df, **dealt).collect()) == want


def test_join_cases(spark, docs, none):
    check_join(spark, [(i, t) for i, t, *_ in rows() if not (i is None and t == "no id")])
    assert ngram_join.jaccard_components(none).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_ in rows() if i not in (11, 12, 17))


def test_join_near_groups(spark):
    """A group of near copies of one text, of which many pairs are just linked or just not; and chains."""
    rng = np.random.default_rng(11)
    texts, base = [], prose(7, 90).split()
    for k in range(60):
        own = list(base)
        for p in rng.choice(90, rng.integers(0, 5), replace=False):
            own[p] = f"edit{k}x{p}"
        texts.append((1000 - k, " ".join(own)))
    chain = prose(8, 60).split()
    for k in range(12):
        texts.append((k, " ".join(chain)))
        chain = chain[2:] + [f"new{k}a", f"new{k}b"]
    texts += [(2000 + k, " ".join(base[:30]) + " " + prose(50 + k, 40)) for k in range(10)]
    check_join(spark, texts)
    check_join(spark, texts, split=2, fan=3)  # hot points in parts, and partners of a node in parts


def test_components(spark):
    ws = Workspace(spark, "test")
    path = [(k, k + 1) for k in range(100, 140)] + [(7, 7), (3, 50), (50, 2)]
    got = {r["node"]: r["comp"] for r in connected_components(ws, spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {3: 2, 50: 2, 2: 2}
    assert connected_components(ws, spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts, window=20):
    """(n_words, n_removed, kept) by position; ``texts`` in order of documents."""
    seen, out = {}, [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0))
    split = [(t or "").encode().split() for _, t in texts]
    place = lambda k, s: (texts[k][0] is None, texts[k][0] or 0, s)
    for k in order:
        for s in range(len(split[k]) - window + 1):
            key = tuple(split[k][s : s + window])
            seen[key] = min(seen.get(key, place(k, s)), place(k, s))
    for k in order:
        gone = [False] * len(split[k])
        for s in range(len(split[k]) - window + 1):
            if seen[tuple(split[k][s : s + window])] < place(k, s):
                gone[s : s + window] = [True] * window
        out[k] = (len(split[k]), sum(gone), b" ".join(w for w, g in zip(split[k], gone, strict=True) if not g))
    return out


def test_substring(spark, docs, none):
    texts = [(i, t) for i, t, *_ in rows()]
    want = sorted((str(i), n, g, hashlib.sha256(kept).hexdigest()) for (i, _), (n, g, kept) in zip(texts, removed(texts), strict=True))
    assert sorted((str(r[0]), *r[1:]) for r in substring.removal_report(docs).collect()) == want
    assert substring.removal_report(none).count() == 0
    full = substring.remove_repeats(docs).collect()
    assert substring.remove_repeats(docs).columns == [*docs.columns, "_n_words", "_n_removed"]
    by = {r["_row"]: r for r in full}
    assert by[10]["text"].startswith(prose(3, 50)[:20]) and by[10]["key"] == "n10"  # the passage of row 9 is gone


def test_substring_random(spark):
    rng = np.random.default_rng(4)
    texts = [(int(k), " ".join(f"w{x}" for x in rng.integers(0, 3, rng.integers(15, 90)))) for k in rng.permutation(60)]
    long = " ".join(f"u{k}" for k in range(70))
    texts += [(100, long), (101, "a " + long[:150] + " b"), (102, long + " " + long)]
    for window in (20, 11):
        df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
        want = sorted((i, n, g, hashlib.sha256(kept).hexdigest()) for (i, _), (n, g, kept) in zip(texts, removed(texts, window), strict=True))
        assert sorted(tuple(r) for r in substring.removal_report(df, window).collect()) == want
        # word hashes of a few bits, and groups beyond memory
        for bits, most in ((3, 50_000), (1, 50_000), (64, 4), (3, 4)):
            assert sorted(tuple(r) for r in substring.removal_report(df, window, bits=bits, most=most).collect()) == want


def test_substring_of_words_with_equal_hashes(spark):
    """Passages that differ in one word stay, whatever the words' hashes."""
    words = [f"{k:07d}" for k in range(40)]
    texts = []
    for k in range(12):
        own = list(words[:20])
        own[(0, 19, 7)[k % 3]] = f"9{k:06d}"
        texts.append((k, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for bits, most in ((64, 50_000), (1, 50_000), (2, 50_000), (1, 3)):
        assert {r["n_removed"] for r in substring.removal_report(df, bits=bits, most=most).collect()} == {0}


def test_doubled_ranks_are_those_of_suffixes():
    rng = np.random.default_rng(6)
    size = [int(x) for x in rng.integers(1, 60, 30)]
    ids = rng.integers(0, 3, sum(size))
    left = np.concatenate([np.arange(n, 0, -1) for n in size])
    for window in (1, 2, 3, 7, 8, 20):
        keys = [tuple(ids[i : i + min(window, left[i])]) for i in range(len(ids))]
        order = {k: r for r, k in enumerate(sorted(set(keys)))}
        got = substring.doubled(ids, left, window)
        assert len(set(zip(got.tolist(), keys, strict=True))) == len(order) and [order[k] for k in keys] == (np.unique(got, return_inverse=True)[1]).tolist()


def test_lines(spark, docs, none):
    notice = "All rights reserved by {} in 2019."
    texts = [(k, f"{prose(k, 12)}\n{notice.format('owner%d' % k if k % 2 else 'Someone')}\n{prose(k + 500, 9)}") for k in range(20)]
    texts += [(100 + k, f"{prose(700, 10)}\n{prose(701, 10)}\n{prose(702, 10)}") for k in range(12)]  # copies, lines between the same lines
    got = {r["doc_id"]: r for r in lines.drop_report(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert [got[k]["n_dropped"] for k in range(20)] == [0] + [1] * 19 or [got[k]["n_dropped"] for k in range(20)] == [0, 0] + [1] * 18
    assert all(got[100 + k]["n_dropped"] == 0 and got[100 + k]["n_lines"] == 3 for k in range(12))
    assert lines.drop_report(none).count() == 0
    out = lines.drop_recurring(docs)
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"] and out.count() == len(rows())
    assert {r["_row"]: r["text"] for r in out.collect()} == {k: r[1] for k, r in enumerate(rows())}


def test_lines_of_banners(spark):
    """Headers, footers and banners of several lines go wherever they stand; copies and near copies lose nothing."""
    banner = ["Terms of the public archive apply here", "Please keep this notice with every copy", "Contact the archive for other uses"]
    body = lambda k: [prose(k + 40 * j, 15) for j in range(1, 4)]
    docs = {}
    for k in range(12):
        docs[k] = ["All pages of the open library", *body(k)]  # header
        docs[100 + k] = [*body(1000 + k), "Licensed under the open library terms"]  # footer
        docs[200 + k] = [*banner, *body(2000 + k)]  # banner at the top
        docs[300 + k] = body(3000 + k)[:2] + ["First of a middle banner of two", "Second of a middle banner of two"] + body(4000 + k)[:2]
        docs[400 + k] = ["Head line over every short note", prose(5000 + k, 9), "Foot line under every short note"]
        docs[500 + k] = body(6000)  # copies
        near = [prose(7000 + j, 20).split() for j in range(6)]
        near[k % 6][k] = f"changed{k}"
        docs[600 + k] = [" ".join(x) for x in near]  # near copies
    want = {}
    for i, own in docs.items():
        first, kind = i % 100 == 0, i // 100
        want[i] = 0 if first else (1, 1, 3, 2, 2, 0, 0)[kind]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs.items()], "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["n_dropped"] for r in lines.drop_report(df).collect()} == want


def recurring(docs, least=8):
    """Numbers of the lines that go, by document: the rules of the operator on lists, for contents that are equal or have nothing in common."""
    digit = lambda t: "<*>" if any(c.isdigit() for c in t) else t
    lines, leaf_docs = {}, {}
    for i, text in docs:
        own = [(k, x.split()) for k, x in enumerate(text.split("\n")) if x.split()]
        lines[i] = [(k, (len(t), *map(digit, t[:3])), t) for k, t in own]
        for leaf in {x[1] for x in lines[i]}:
            leaf_docs[leaf] = leaf_docs.get(leaf, 0) + 1

    def form(t):
        masked = [digit(x) for x in t]
        return tuple(masked) if 2 * masked.count("<*>") <= len(t) else tuple(t)

    forms, places = {}, {}
    for i, own in lines.items():
        for leaf, f in {(leaf, form(t)) for _, leaf, t in own if leaf_docs[leaf] >= least}:
            forms.setdefault(leaf, {}).setdefault(f, set()).add(i)
    template = {}
    for leaf, by in forms.items():
        if len(by) > 1 and sum(map(len, by.values())) >= least:
            for f in by:
                t = tuple(x if sum(len(d) for g, d in by.items() if g[p] == x) >= least else "<*>" for p, x in enumerate(f))
                template[leaf, f] = (leaf, t) if 2 * sum(x != "<*>" for x in t) >= len(t) else f
    for i, own in lines.items():
        held = [leaf_docs[x[1]] >= least for x in own]
        for j, (k, leaf, t) in enumerate(own):
            if held[j]:
                a, b = j, j
                while a and held[a - 1]:
                    a -= 1
                while b + 1 < len(own) and held[b + 1]:
                    b += 1
                rest = tuple(x for x in [tuple(map(tuple, (y[2] for y in own[:a]))), tuple(map(tuple, (y[2] for y in own[b + 1 :])))] if x) or tuple(tuple(y[2]) for y in own)
                key = template.get((leaf, form(t)), form(t))
                places.setdefault(key, []).append((i, k, own[j - 1][2] if j else None, own[j + 1][2] if j + 1 < len(own) else None, rest))
    gone = {i: set() for i, _ in docs}
    for at in places.values():
        if len({p[0] for p in at}) < least:
            continue
        sides = all(len({str(p[s]) for p in at}) >= least for s in (2, 3))
        if sides or len({p[4] for p in at}) >= least:
            for i, k, *_ in at:
                if (i, k) != min(p[:2] for p in at):
                    gone[i].add(k)
    return gone


def test_lines_against_brute_force(spark):
    rng = np.random.default_rng(17)
    stock = [
        "All rights reserved by the owner of this page", "Page 7 of 120", "Copyright 2019 some press and friends", "Read more about it here",
        "one very long notice " + " ".join(f"clause{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)), "Posted by ada on a monday", "Posted by bob on a friday",
    ]
    docs = []
    for k in range(90):
        body = [" ".join(f"b{chr(97 + int(x) % 26)}{chr(97 + int(x) // 26 % 26)}{k:03d}x".replace("0", "o") for x in rng.integers(0, 676, 7)) for _ in range(4)]
        body = ["".join(c if not c.isdigit() else chr(107 + int(c)) for c in x) for x in body]
        for _ in range(int(rng.integers(0, 3))):
            line = str(rng.choice(stock))
            if line.startswith("Page"):
                line = f"Page {k} of {int(rng.integers(1, 500))}"
            body.insert(int(rng.integers(0, len(body) + 1)), line)
        docs.append((k, "\n".join(body)))
    docs += [(500, "\n".join(["a line that one document repeats"] * 12 + [f"a line that {w} document repeats" for w in ("no", "some", "every")])), (501, ""), (502, " \n ")]
    want = recurring(docs)
    assert sum(map(len, want.values())) > 30 and not want[500]
    got = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {r["doc_id"]: r["n_dropped"] for r in lines.drop_report(got).collect()} == {i: len(g) for i, g in want.items()}
    kept = {r["doc_id"]: r["text"] for r in lines.drop_recurring(got).collect()}
    assert all(kept[i] == ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]) if t else t) for i, t in docs)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(size=(3, 8))
    data = [(int(k), [float(v) for v in center[k % 3] + rng.normal(size=8) * 0.25], [1, 2, None][k % 7 % 3]) for k in range(150)]
    data += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, [float("inf")] * 8, 2), (204, [1.0, None] * 4, 1), (205, [1.0, 2.0], 1), (206, [2.0, 4.0], 1), (207, [], 1)]
    data += [(300 + k, data[0][1], 1) for k in range(4)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)

    def vector(v):
        return np.array(v, np.float32).astype(float) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None

    items = [(i, vector(v), y) for i, v, y in data]

    def linked(a, b):
        return a[1] is not None and b[1] is not None and a[2] is not None and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.93

    comp = components(items, linked)
    want = {i: (sum(linked(x, y) for y in items if y[0] != i), c, c == i) for (i, *_), c, x in zip(items, comp, items, strict=True)}
    assert {r[0]: tuple(r)[1:] for r in embed_join.near_vectors(df).collect()} == want
    assert embed_join.near_vectors(df.where("false")).count() == 0


def test_vectors_by_cells(spark):
    """Small cells of both kinds and small blocks give the same links; names of other columns don't matter."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for name in ("uid", "dim", "cell", "home", "_id", "n_links"):
        df = df.withColumn(name, embed_join.F.lit("x"))
    want = {tuple(r) for r in embed_join.near_vectors(df).collect()}
    assert "op10_embedding_near_dedup" in queries.ORACLE_SQL and len(want) == df.count()
    for split in ({"cell": 10}, {"cell": 10, "block": 7, "inner": 2}, {"inner": 4}, {"block": 5}):
        assert {tuple(r) for r in embed_join.near_vectors(df, **split).collect()} == want


def test_inner_cells_lose_no_pair():
    rng = np.random.default_rng(8)
    center = rng.normal(size=(30, 6))
    x = center[rng.integers(0, 30, 900)] + rng.normal(size=(900, 6)) * 0.2
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = {tuple(p) for p in np.argwhere(x @ x.T >= 0.93).tolist()}
    got, made = set(), 0
    for a, b, hit in embed_join.compared(x, x, 0.93, 20):
        got |= {(int(a[i]), int(b[j])) for i, j in np.argwhere(hit)}
        made += hit.size
    assert got == want and made < 0.7 * len(x) ** 2
