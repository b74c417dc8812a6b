import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from embedlake.operators import chunk as K

WITCHES = "if two witches watch two watches, which witch watches which watch?"
ML = (
    "Introduction to Machine Learning\n\nMachine learning is a subset of artificial intelligence that focuses on data and\nalgorithms.\n"
    "It enables systems to learn and improve from experience.\n\nKey Concepts:\n1. Supervised Learning\n2. Unsupervised Learning\n3. Reinforcement Learning\n\n"
    "Each type has its own unique applications and methodologies."
)


def test_character_golden():
    want = ["if two", "witches", "watch two", "watches,", "which", "witch", "watches", "which", "watch?"]
    assert K.split_character(WITCHES, 10, 0, " ") == want


def test_recursive_golden():
    want = ["if", " two", " witches", " watch", " two", " watches,", " which", " witch", " watches", " which", " watch", "?"]
    assert K.split_recursive(WITCHES, 2, 0, [" ", ".", "?"]) == want


def test_recursive_overlap_golden():
    got = K.split_recursive(ML, 100, 20, ["\n\n", "\n", " "])
    assert got == [
        "Introduction to Machine Learning",
        "Machine learning is a subset of artificial intelligence that focuses on data and\nalgorithms.",
        "algorithms.\nIt enables systems to learn and improve from experience.",
        "Key Concepts:\n1. Supervised Learning\n2. Unsupervised Learning\n3. Reinforcement Learning",
        "Each type has its own unique applications and methodologies.",
    ]
    short = "This is a shorter post that shouldn't need splitting."
    assert K.split_recursive(short, 100, 20, ["\n\n", "\n", " "]) == [short]


@pytest.mark.parametrize("text", ["", "   ", "\t\n  \t", None])
def test_blank_text_has_no_chunks(text):
    assert K.split_recursive(text, 100, 20) == [] and K.split_character(text, 100, 20) == []
    assert K.splitter("none")(text) == [text or ""]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=6), min_size=1, max_size=40))
def test_no_overlap_keeps_all_words(words):
    got = K.split_character(" ".join(words), 12, 0, " ")
    assert " ".join(got).split() == words
    assert all(len(c) <= 12 for c in got)


def test_regex_and_bounds():
    assert K.split_character("a1b22c", 1, 0, "[0-9]+", True) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        K.split_character("a", 5, 6)


def test_columns_and_table_functions(spark):
    df = spark.createDataFrame([(1, WITCHES), (2, "  "), (3, None)], "id int, text string")
    got = K.explode_chunks(df, "text", "character_text_splitter", chunk_size=10, chunk_overlap=0, separator=" ").orderBy("id", "chunk_seq").collect()
    assert [r["chunk"] for r in got] == K.split_character(WITCHES, 10, 0, " ") and [r["chunk_seq"] for r in got] == list(range(9))
    for name, f in K.table_functions().items():
        spark.udtf.register(name, f)
    df.createOrReplaceTempView("posts")
    got = spark.sql("SELECT id, c.seq, c.chunk FROM posts, LATERAL ai_chunk_text(text, 10, 0, ' ', false) c ORDER BY id, seq").collect()
    assert [r["chunk"] for r in got] == K.split_character(WITCHES, 10, 0, " ")
    got = spark.sql("SELECT c.chunk FROM posts, LATERAL ai_chunk_text_recursively(text, 2, 0, array(' ', '.', '?'), false) c WHERE id = 1").collect()
    assert len(got) == 12


def test_registered_chunks_of_whole_table(spark):
    from embedlake.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("text is not null").collect()}
    got = {}
    for r in QUERIES["chunk_char_words"](spark, d).orderBy("doc_id", "chunk_seq").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert any(len(t) >= 2000 for t in texts.values())
    assert set(got) == {i for i, t in texts.items() if t.strip()}
    assert all("".join("".join(got[i]).split()) == "".join(t.split()) for i, t in texts.items() if t.strip())
    assert sum(r["n_docs"] for r in QUERIES["chunk_counts_by_lang"](spark, d).collect()) == len(got)
