import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat from one seed to another."""
    return " ".join(f"{LOREM[(seed * 7 + k * k) % 24]}{(seed * 31 + k * 17) % 997}" for k in range(n))


def rows() -> list[tuple]:
    """(doc_id, text, and columns whose names operators use themselves)."""
    base, passage = prose(1, 120), prose(99, 40)
    near = base.split()
    near[60] = "changed"
    texts = [
        (10, base), (11, base), (12, " ".join(near)), (13, None), (14, ""), (15, " \t\n\x0b\f\r "), (16, "one two three"), (17, "one two three"), (18, "ONE two three"),
        (19, prose(2, 60) + " " + passage), (20, passage + " " + prose(3, 50)), (21, "same " * 400), (22, prose(4, 25_000)), (23, "x" * 70_000), (24, "żółw 🐢 　 ideographic space"),
        (25, "  lead and  double   blanks  "), (26, "line one\nline one\n\nline two"), (None, base), (None, "no id"), (27, prose(5, 30)), (27, prose(5, 30)), (28, "<|endoftext|> inside <s> text</s>"),
    ]
    return [(i, t, "en" if k % 2 else None, "src", k, k, f"n{k}", k, "p") for k, (i, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, _row int, node int, `key` string, n_chars int, piece string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
