"""Operators 11, 12 and 13 against SQL or brute force."""

import random

import duckdb
import pytest

from embedlake.llm import queries, urlgraph


def same(spark, folder, name, tables):
    """The query over ``tables`` (name to DataFrame) equals its SQL; returns its rows as dicts."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder.removeprefix('file://')}/{t}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, folder)
    cols = sorted(found.columns)
    got = sorted(map(repr, ([r[x] for x in cols] for r in found.collect())))
    want = c.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert got == sorted(map(repr, ([r[want.columns.index(x)] for x in cols] for r in want.fetchall())))
    return [dict(zip(want.columns, r)) for r in c.sql(queries.ORACLE_SQL[name]).fetchall()]


PAGES = [
    (1, "http://a.net/x", "<a href='http://b.com/'>"), (2, "http://b.com/1", "<a HREF = \"//c.net/\"> <a href=https://d.org/fr/>"), (3, "http://d.org/fr/1", "<a href=http://b.com>"),
    (4, "HTTP://E.com", "<a href='ftp://c.net/'><a href='x://q.net/'>"), (5, None, None), (6, "nope", None), (7, "http://f.com?x", "<a href='http://e.com'>"), (8, "http://x.net", None),
    (9, "http://example.net/en/1", None), (10, "a://b.Example.COM/de/?q#z", None), (None, "http://É.org/fr/\n", "<a href="), (10, "a://b.Example.COM/de/?q#z", None), (11, "://", "<a href=//>"),
]
SCHEMA = "page_id long, url string, html string, host string, `_id` string"


def test_url_filters(spark, folder):
    rows = [(*r, "clash", "x") for r in PAGES]
    got = {r["page_id"]: r for r in same(spark, folder, "op13_url_filters", {"pages": spark.createDataFrame(rows, SCHEMA)})}
    assert got[4]["verdict"] == got[7]["verdict"] == "block" and got[4]["rule"] is None  # by links to blocked hosts
    assert got[2]["verdict"] == "allow" and got[8]["rule"] is None and got[5]["host"] == ""
    assert got[9]["rule"] == "example.net/en/" and got[10]["host"] == "b.example.com" and got[None]["host"] == "É.org"


def test_url_filters_on_tables(spark, folder):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert len(same(spark, folder, "op13_url_filters", {"pages": pages})) == 250
    none = urlgraph.judge(pages.where("false"), urlgraph.rule_table(spark, []))
    assert none.count() == 0


@pytest.mark.parametrize("facts", [0, 200_000])
def test_scores_equal_brute_force(spark, monkeypatch, facts):
    """Rounds over a graph with a hub, with and without broadcasts."""
    from embedlake.llm import _work

    monkeypatch.setattr(_work, "BROADCAST_FACTS", facts)
    rnd = random.Random(1)
    edges = {(f"h{rnd.randrange(40)}", f"h{rnd.randrange(40)}"): rnd.randint(1, 9) for _ in range(120)} | {(f"h{k}", "hub"): 1 for k in range(40)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {(1, "h1"): 10**9, (-1, "h2"): 5 * 10**8, (-1, "hub"): 10**9, (1, "hub"): 3}
    both = [(1, a, b, n) for (a, b), n in edges.items()] + [(-1, b, a, n) for (a, b), n in edges.items()]
    total = {}
    for k, a, _, n in both:
        total[k, a] = total.get((k, a), 0) + n
    x = dict(seeds)
    for _ in range(12):
        new = dict(seeds)
        for k, a, b, n in both:
            if (k, a) in x:
                new[k, b] = new.get((k, b), 0) + x[k, a] * (n * 10**9 // total[k, a] * 85) // (100 * 10**9)
        x = {k: v for k, v in new.items() if v}
    ws = _work.Workspace(spark, "test")
    got = urlgraph.scores(ws, spark.createDataFrame([(k, h, s) for (k, h), s in seeds.items()], "kind int, host string, score long"), spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), rounds=12)
    assert {(r["kind"], r["host"]): r["score"] for r in got.collect()} == x


def test_rules_of_many_hosts_without_broadcast(spark, monkeypatch):
    from embedlake.llm import _work

    monkeypatch.setattr(_work, "BROADCAST_FACTS", 0)
    pages = spark.createDataFrame([(k, f"http://s{k % 5}.h{k % 50}.org/p{k % 3}/x", None) for k in range(200)], "page_id long, url string, html string")
    rules = urlgraph.rule_table(spark, [("block", f"h{k}.org/") for k in range(10)] + [("allow", f"h{k}.org/p1/") for k in range(20)] + [("allow", "s1.h2.org/"), ("block", "h3.org/p2/"), ("allow", "H3.org/p2/")])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlgraph.judge(pages, rules).collect()}
    for k in range(200):
        fits = [(len(r), len(r.split("/")[0]), v == "block", r, v) for v, r in [("block", f"h{j}.org/") for j in range(10)] + [("allow", f"h{j}.org/p1/") for j in range(20)] + [("allow", "s1.h2.org/"), ("block", "h3.org/p2/"), ("allow", "H3.org/p2/")]
                if (f"s{k % 5}.h{k % 50}.org" == (at := r.split("/", 1)[0].lower()) or f"s{k % 5}.h{k % 50}.org".endswith("." + at)) and f"/p{k % 3}/x".startswith("/" + r.split("/", 1)[1])]
        if fits:
            assert got[k] == (max(fits)[3], max(fits)[4])
        else:
            assert got[k][0] is None


def _groups(n):
    """Documents of two languages and seven sources, with terms just at and below the least number of documents."""
    rnd, out = random.Random(n), []
    for k in range(n):
        lang = rnd.choice(["en", "en", "de", None])
        words = [rnd.choice(["Alpha", "béta", "g\u0001amma", "Ωmega", "z🐢", "delta", f"w{rnd.randrange(30)}x"]) for _ in range(rnd.randrange(20))]
        out.append((k % 50 or None, rnd.choice([" ", "-", "1"]).join(words) if k % 9 else None, lang, rnd.choice(["s1", "s2", "S1", "é", None, "", "s1"]), "clash", 1))
    out += [(1, f"rare{k % 2} Rare{k % 2}", "en", "s1", "c", 1) for k in range(59)] + [(2, "", "xx", "lone", "c", 1), (3, None, "xx", "pair", "c", 1), (4, "only one", "yy", "one", "c", 1)]
    return out


DOCS = "doc_id long, text string, lang string, source string, term string, n int"


@pytest.mark.parametrize("block, chunk, facts", [(128, 4096, 200_000), (2, 3, 0)])
def test_divergence(spark, folder, monkeypatch, block, chunk, facts):
    """Also with several blocks of sources, chunks of three terms, chunks of few counts, and no broadcasts."""
    from embedlake.llm import _work, divergence

    for m, k, v in ((divergence, "BLOCK", block), (divergence, "CHUNK", chunk), (divergence, "ENTRIES", 9 if chunk == 3 else 1 << 20), (_work, "BROADCAST_FACTS", facts)):
        monkeypatch.setattr(m, k, v)
    docs = spark.createDataFrame(_groups(700), DOCS).repartition(3)
    got = same(spark, folder, "op12_source_divergence", {"documents": docs})
    assert {r["value"] for r in got if r["lang"] == "xx"} == {0} and not [r for r in got if r["lang"] == "yy"]
    assert "rare" in {r["item"] for r in got if r["part"] == "term"} and "béta" in {r["item"] for r in got}


def test_divergence_on_tables(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert same(spark, folder, "op12_source_divergence", {"documents": docs})
    assert queries.QUERIES["op12_source_divergence"](spark, folder).count()
    from embedlake.llm.divergence import audit

    assert audit(docs.where("false")).count() == 0


def test_billionths_are_exact():
    import numpy as np

    from embedlake.llm.divergence import billionths

    rnd = random.Random(3)
    for _ in range(300):
        d = rnd.randrange(1, 9 * 10 ** rnd.randrange(1, 16))
        a = [rnd.randrange(0, d + 1) for _ in range(5)] + [d]
        assert billionths(np.array(a), d).tolist() == [10**9 * x // d for x in a]


CONVS = "conv_id long, turn int, role string, text string, seq string, id int"


def _conversations():
    rnd, out = random.Random(8), []
    for c in [*range(0, 260), *range(-130, -90), 1000, 1001, 10**12, 10**12 + 7]:
        for t in range(rnd.choice([1, 2, 3, 6, 9])):
            out.append((c, t, rnd.choice(["user", "bot"]) if t else "system", f"é{rnd.choice('ab')}" * rnd.randrange(3), "clash", 1))
    out += [(c, t, "user", f"same {t}", "c", 1) for c in range(100_000, 100_400) for t in range(3)]  # copies, but for their openings
    out += [(500, None, None, None, "c", 1), (500, 1, "b", "x", "c", 1), (500, 1, "a", "y", "c", 1), (500, 1, "a", "x", "c", 1), (500, 1, "a", "x", "c", 1), (None, 1, "a", "x", "c", 1), (504, 3, "a", "only", "c", 1)]
    out += [(700, t, "user", "long", "c", 1) for t in range(500)] + [(707, t, "user", "long", "c", 1) for t in range(499)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("run, ids, size, facts", [(4096, 12, 16 << 20, 200_000), (5, 2, 600, 0)])
def test_conversation_trie(spark, folder, monkeypatch, run, ids, size, facts):
    """Also with tiny runs of sequences and ids, many ranges, and no broadcasts."""
    from embedlake.llm import _work, conversation_trie as C

    for m, k, v in ((C, "RUN", run), (C, "IDS", ids), (C, "RANGE", size), (_work, "BROADCAST_FACTS", facts)):
        monkeypatch.setattr(m, k, v)
    got = same(spark, folder, "op11_conversation_trie", {"conversations": spark.createDataFrame(_conversations(), CONVS).repartition(5)})
    assert max(r["depth"] for r in got) == 500 and sum(r["parent_conv_id"] is None for r in got) == 1


def test_conversation_trie_on_tables(spark, folder):
    from embedlake.llm import _work, conversation_trie as C

    convs = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert same(spark, folder, "op11_conversation_trie", {"conversations": convs})
    assert C.trie(C.rebuilt(_work.Workspace(spark, "none"), convs.where("false"))).count() == 0
    # only turnless conversations: a root and nothing else
    one = C.trie(spark.createDataFrame([(3, []), (1, [])], "conv_id long, turns array<struct<key binary, chars int>>")).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["n_children"]) for r in one] == [(1, 0, 2, 1, 0)]


def test_merge_carries_shared_turns():
    import os

    from embedlake.llm import conversation_trie as C

    rnd = random.Random(2)
    words = [bytes([k]) * 8 + bytes([j]) * 8 for k in range(2) for j in range(2)]
    seqs = list({b"".join(rnd.choice(words) for _ in range(rnd.randrange(8))) for _ in range(900)})
    for k in (1, 2, 3, 7, 64, 200):
        runs = [sorted(seqs[j::k]) for j in range(k)]
        runs = [[(s, C.shared(r[i - 1], s) if i else 0, s) for i, s in enumerate(r)] for r in runs]
        got = list(C.merge(runs))
        assert [g[0] for g in got] == sorted(seqs)
        assert [g[1] for g in got[1:]] == [len(os.path.commonprefix([a[0], b[0]])) // 16 for a, b in zip(got, got[1:])]
