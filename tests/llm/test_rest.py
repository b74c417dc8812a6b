"""Operators 3, 8 and 9, and the pipeline."""

import base64
import hashlib
import io
import random
from collections import Counter

import pytest

from embedlake.llm import queries, quality, toxicity, warc

from .conftest import SCHEMA, prose, rows

D = "/root/testdata/sf0.01"


def test_warc(spark, folder):
    data = [(k, f"http://x/{k} \n", f"<p>{prose(k % 5, 30)}</p>") for k in range(40)] + [(50, None, None), (51, "", ""), (3, "again", "<p>other</p>"), (None, "u", "<p>no id</p>"), (60, "big", "y" * 400_000)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("digest", warc.F.lit("clash")).repartition(3)
    assert len(warc.write_archives(pages, folder)) == 3
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        lead = first.get(h or "")
        again = i is not None and lead != i
        want.append(("" if i is None else str(i), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", str(lead) if again else None))
    for split in (200, 4000, 8 << 20):  # records belong to the range they start in
        got = warc.read_archives(spark, folder, split).collect()
        number = lambda x: x and x.rsplit(":", 1)[1]
        assert sorted(str((number(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to"]))) for r in got) == sorted(map(str, want))
        assert all(r["digest_ok"] for r in got if r["record_type"] == "response")
    assert warc.write_archives(pages.where("false"), f"{folder}/none") == [] and warc.read_archives(spark, f"{folder}/none").count() == 0


def test_warc_of_ids_with_several_payloads(spark, tmp_path):
    """References go by id and payload; ids need not be numbers."""
    data = [(1, "A"), (2, "B"), (3, "A"), (3, "unique"), (4, "A"), (4, "B"), (None, "B")]
    for kind, name in (("long", str), ("string", lambda k: f"p:{k}")):
        rows = [(None if i is None else i if kind == "long" else name(i), "u", h) for i, h in data]
        top = f"file://{tmp_path}/{kind}"
        spark.createDataFrame(rows, f"page_id {kind}, url string, html string").write.parquet(f"{top}/pages.parquet")
        got = sorted((str(r["page_id"]), r["payload_digest"], r["record_type"], str(r["refers_to"])) for r in queries.op3_warc(spark, top).collect())
        digest = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        first = {"A": rows[0][0], "B": rows[1][0]}
        want = []
        for i, _, h in rows:
            again = i is not None and h in first and i != first[h]
            want.append((str(i), digest(h), "revisit" if again else "response", str(first[h]) if again else "None"))
        assert got == sorted(want)


def test_warc_keeps_very_long_urls():
    blob = b"".join(warc.record(f"urn:x-page:{k}", "http://a/" + "u" * n, b"text", None, "d") for k, n in enumerate((10, 200_000, 10)))
    got = [r["head"]["warc-target-uri"] for _, r in warc.records_in(io.BytesIO(blob), 0, len(blob))]
    assert [len(u) for u in got] == [19, 200_009, 19]


def test_warc_skips_what_is_broken():
    one = [warc.record(f"urn:x-page:{k}", "u", (f"text {k} " * 50).encode() + warc.MAGIC, None, "d") for k in range(4)]
    broken = bytearray(one[1])
    broken[len(broken) // 2] ^= 0xFF
    blob = b"junk" + warc.MAGIC + one[0] + bytes(broken) + one[2] + one[3][:-5]
    got = [r["head"]["warc-record-id"] for _, r in warc.records_in(io.BytesIO(blob), 0, len(blob))]
    assert got == ["<urn:x-page:0>", "<urn:x-page:2>"]


def test_toxicity_model():
    rnd = random.Random(5)
    bad = ["nasty", "vile"] + [f"grumbl{x}" for x in ("ed", "es", "ing", "er", "ous")]
    texts, labels = [], []
    for k in range(400):
        w = prose(k, 40).split()
        y = k % 4 == 0
        for _ in range(rnd.randint(2, 4) if y else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        texts.append(" ".join(w))
        labels.append(int(y))
    model = toxicity.train(texts[:300], labels[:300])
    import numpy as np

    data = [t.encode() for t in texts[300:] + ["", "a vile thing"]]
    s, spans = toxicity.Scorer(model).run(np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data])), True)
    assert [int(x >= 0.5) for x in s[:100]] == labels[300:]
    assert spans[101] and spans[101][0]["start"] == 2 and spans[101][0]["end"] == 6 and s[100] < 0.5
    assert toxicity.train(["a"], [1]).curve is None


def test_marginals_equal_the_full_chain():
    """Runs of default tokens in closed form against a chain over all tokens."""
    import numpy as np

    m = toxicity.Model(bias=-1.0, enter=-0.7, leave=0.3, stay=1.1)
    u = np.array([0, 0, 2.0, 0, 0, 0, -1.5, 0.7, 0, 0])
    step, pot = np.exp([[0, m.enter], [m.leave, m.stay]]), np.stack([np.ones(10), np.exp(u + m.bias)], 1)
    a, b = np.zeros((10, 2)), np.ones((10, 2))
    a[0] = step[0] * pot[0]
    for t in range(1, 10):
        a[t] = a[t - 1] @ step * pot[t]
    for t in range(8, -1, -1):
        b[t] = step @ (pot[t + 1] * b[t + 1])
    full = (a * b)[:, 1] / (a * b).sum(1)
    at = np.array([2, 6, 7])
    got = toxicity.marginals(m, u[at], np.array([2, 3, 0]), np.array([2]), np.array([0, 3]))
    assert np.allclose(got, full[at])


def test_gradient_is_that_of_the_chain():
    """Expected less observed counts against finite differences of the likelihood of a chain over all tokens."""
    import numpy as np

    rng = np.random.default_rng(3)
    own = [np.where(rng.random(n) < 0.5, rng.normal(size=n), 0.0) for n in (8, 1, 12, 5)] + [np.zeros(4)]
    labels = [(x != 0) & (rng.random(len(x)) < 0.6) for x in own]

    def loss(t):
        bias, enter, leave, stay = t[:4]
        step, total, k = np.exp([[0, enter], [leave, stay]]), 0.0, 4
        for x, y in zip(own, labels, strict=True):
            a, path, last = np.array([1.0, 0.0]), 0.0, 0
            for u, state in zip(x, y, strict=True):
                if u:
                    u, k = t[k], k + 1
                a = a @ step * np.exp([0, u + bias])
                path += np.log(step[last, int(state)]) + int(state) * (u + bias)
                last = int(state)
            total += np.log(a.sum()) - path
        return total

    theta = np.concatenate([[-1.3, -0.7, 0.2, 0.9], *[x[x != 0] for x in own]])
    slope = [(loss(theta + e) - loss(theta - e)) / 2e-5 for e in np.eye(len(theta)) * 1e-5]
    some = [x for x in own if x.any()]
    at = [np.flatnonzero(x) for x in some]
    first = np.append(0, np.cumsum([len(a) for a in at]))
    gaps = np.concatenate([np.diff(a, prepend=-1) - 1 for a in at])
    tail = np.array([len(x) - a[-1] - 1 for x, a in zip(some, at, strict=True)])
    y = np.concatenate([v[a] for v, a in zip([v for x, v in zip(own, labels, strict=True) if x.any()], at, strict=True)])
    m = toxicity.Model(bias=-1.3, enter=-0.7, leave=0.2, stay=0.9)
    bare = np.array([len(x) for x in own if not x.any()])
    p, counts = toxicity.expected(m, np.concatenate([x[a] for x, a in zip(some, at, strict=True)]), gaps, tail, first, bare)
    assert np.allclose(np.concatenate([counts - toxicity.observed(y, gaps, tail, first), p - y]), slope, atol=1e-6)


def test_words_end_alike_in_training_and_scoring():
    """White space of any script, and offsets in code points."""
    import numpy as np

    from embedlake.llm import _text as T

    blanks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    text = "".join(f"wört{k}{b}" for k, b in enumerate(blanks)) + "\ufeff\u200bend"
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = T.words(toxicity._plain_blanks(data), np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == text.split()
    model = toxicity.Model({"vile": 6.0}, -3.0, -1.0, 0.0, 1.0, (-4.0, 1.0, 8.0))
    texts = ["nice vile here", "nice\u3000vile\u3000here", "é🐢 \u2003vile " + "plain " * 30_000 + "vile"]
    raw = [t.encode() for t in texts]
    score, spans = toxicity.Scorer(model).run(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])), True)
    assert score[0] == score[1] and [[t[s["start"] : s["end"]] for s in own] for t, own in zip(texts, spans, strict=True)] == [["vile"], ["vile"], ["vile", "vile"]]


def test_toxicity_query(spark, docs, none):
    got = queries.op8_toxicity(spark, D).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(got) == 1000 and sum(a == b for a, b in held) >= 0.9 * len(held)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.0} and toxicity.score(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).count() == len(rows()) and toxicity.keep_clean(docs, model).columns == docs.columns


def figures(t):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")
    w, t = word.findall(t or ""), t or ""
    own = [x for x in t.split("\n") if word.search(x)]
    tri, cov = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), [0] * len(w)
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] >= 2:
            cov[i : i + 3] = [1, 1, 1]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), sum(cov)


def test_quality(docs, none):
    want = sorted((str(i), *f, f[0] < 50 or 100 * f[4] > 50 * f[0]) for (i, t, *_) in rows() for f in [figures(t)])
    got = quality.quality(docs).collect()
    assert sorted((str(r[0]), *r[1:7]) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"]) and quality.quality(none).count() == 0


def test_quality_fences_follow_the_group(spark):
    rnd = random.Random(1)
    data = [(k, " ".join(prose(k, 60 + rnd.randrange(40)).split()), "en", "calm") for k in range(80)]
    data += [(100 + k, "# ".join(prose(k, 70).split()), "en", "code") for k in range(80)]
    data += [(200, "$$$$ ".join(prose(300, 70).split()), "en", "calm"), (201, "$$$$$$$$ ".join(prose(301, 70).split()), "en", "code")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k] for k in range(80)) and all(got[100 + k] for k in range(80)) and not got[200] and not got[201]


def test_quality_length_decides_nothing(spark):
    """Ten symbols in 20,000 words stay where a group has none; a tenth of symbols goes, in long and short documents."""
    rnd = random.Random(4)
    data = [(k, prose(k, rnd.choice([60, 90, 200, 400, 900])), "en", "calm") for k in range(80)]
    book = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(999)) for _ in range(20_000))  # hardly any window twice
    data += [(100, book + " # $ & | % * # $ & |", "en", "calm"), (101, " &".join(book.split()), "en", "calm"), (102, prose(702, 60) + " &" * 40, "en", "calm"), (103, prose(703, 300) + " &", "en", "calm")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[k]["kept"] for k in range(80)) and got[100]["kept"] and got[103]["kept"]
    assert "symbol_share" in got[101]["beyond"] and "symbol_share" in got[102]["beyond"]
    assert not got[100]["beyond"]


def test_quality_verdicts_equal_exact_quantiles(spark):
    """``kept`` and ``beyond`` of whole tables against quantiles of sorted lists; no figure has a cutoff of its own."""
    import math

    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("_id", quality.F.lit(1)).withColumn("_salt", quality.F.lit("x")).withColumn("beyond", quality.F.lit(0))
    own = {}
    for r in docs.collect():
        n, chars, symbols, dups, repeats = figures(r["text"])
        lines = sum(any(not c in " \t\n\x0b\f\r" for c in x) for x in (r["text"] or "").split("\n"))
        rate = lambda a, b: math.log((a + 1) / (b + 1))
        error = lambda events: 1 / math.sqrt(events + 1)
        p = [rate(symbols, chars), rate(dups, lines), rate(repeats, n), chars / n if n else 0.0]
        own[r["doc_id"]] = (r["lang"], r["source"], n < 50 or 100 * repeats > 50 * n, p, [error(symbols), error(dups), error(repeats / 6), math.sqrt(p[3] / max(n, 1))])
    passed = [v for v in own.values() if not v[2]]

    def fence(lang, source, k):
        for group in ([v for v in passed if v[:2] == (lang, source)], [v for v in passed if v[0] == lang], passed):
            if len(group) >= quality.MIN_GROUP or group is passed:
                x = sorted(v[3][k] for v in group)
                q = lambda p: x[max(0, math.ceil(p * len(x)) - 1)]
                return q(0.75) + 2 * (q(0.75) - q(0.25))

    want, limits = {}, {}
    for i, (lang, source, failed, p, e) in own.items():
        over = []
        for k, name in enumerate(quality.FIGURES):
            limit = limits.setdefault((lang, source, k), fence(lang, source, k))
            if not failed and p[k] - 2 * e[k] > limit:
                over.append(name)
        want[i] = (not failed and not over, over)
    got = {r["doc_id"]: (r["kept"], r["beyond"]) for r in quality.quality(docs).collect()}
    assert got == want
    bad = {r["doc_id"] for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{D}/labels.parquet").where("quality = 1").collect()}
    clean = [i for i in good if not own[i][2]]
    assert not any(got[i][0] for i in bad) and sum(got[i][0] for i in clean) >= 0.98 * len(clean)


def test_pipeline(spark, tmp_path):
    """Planted cases: toxic documents go, one near copy stays, repeated passages and lines go, clean text stays."""
    import corpus_pipeline

    rnd = random.Random(9)
    docs, labels = [], []
    for k in range(120):
        w = prose(k, 60).split()
        y = k % 3 == 0
        for _ in range(3 if y else 0):
            w.insert(rnd.randrange(60), rnd.choice(["nasty", "vile"]))
        docs.append((k, " ".join(w[:30]) + "\n" + "Page 12 of this site" + "\n" + " ".join(w[30:]), "en", "s", 1))
        labels.append((k, 1, int(y)))
    passage = prose(900, 60)
    docs += [(500, prose(901, 80), "en", "s", 1), (501, prose(901, 79) + " end", "en", "s", 1), (502, prose(902, 40) + " " + passage, "en", "s", 1), (503, prose(903, 40) + " " + passage, "en", "s", 1), (504, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{k}")
        at = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept[name] = {r["doc_id"]: r for r in at.collect()} if k < 4 else at.collect()
        assert k == 4 or at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {k for k in range(120) if k % 3}
    assert set(kept["toxicity"]) == clean | {500, 501, 502, 503, 504}
    assert sum("Page 12" in r["text"] for r in kept["line dedup"].values() if r["text"]) == 1
    assert set(kept["n-gram Jaccard join"]) == clean | {500, 502, 503, 504}
    last = kept["substring dedup"]
    assert passage in last[502]["text"] and last[503]["text"] == prose(903, 40) and last[503]["n_chars"] == len(prose(903, 40))
    assert {r["doc_id"] for r in kept["best-fit packing"]} == set(last)
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == len(kept["best-fit packing"])
