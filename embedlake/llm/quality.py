"""Operator 9: quality rules with adaptive thresholds. DataFrame functions only.

Base figures come from one pass over the texts. In place of fixed cutoffs, each figure of a document is held
against the fence that its own language and source set: the third quartile of the group and ``FENCE``
interquartile ranges beyond it, both from mergeable sketches (KLL, merged across tasks), one per group and
figure. Quartiles of mostly clean groups hardly move with their bad documents. Shares are taken as logarithms of
(count + 1) / (all + 1), so that a group whose documents hold none at all still has quartiles and a spread of its
own: what so many characters, lines or words without any say about the rate. No fence is a count or a share of
its own. A figure is beyond its fence if it is so by more than ``ERRORS`` standard errors of its own count:
one repeated line of ten says little, a third of symbols among a thousand characters much, and ten symbols in
a book nothing.
A document that passes the base rules is rejected if any figure lies beyond its fence; ``beyond`` names them.
Groups with fewer than ``MIN_GROUP`` documents take the fences of their language, and those of rare languages
the fences of all.

Sketches are built from partial aggregates, so a hot source is summed before it moves. Fences join by group
and salt, so that no task gets a hot group whole.

Cases: null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows are judged each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedlake.llm._work import Workspace

SPACES = " \t\n\u000b\f\r"
WORD, SYMBOLS = r"[^\x20\x09-\x0D]", "#*$%&|<>"
MIN_GROUP = 30
SALTS = 16
#: Interquartile ranges beyond the third quartile of its group, and standard errors beyond that, that a figure may have.
FENCE, ERRORS = 2.0, 2.0
#: Size of the sketches: quantiles are exact up to so many documents of a group, and within 0.3 % of rank beyond.
SKETCH = 1024
#: Words of the smallest repeat (a window of three, twice): they count as one event.
REPEAT_WORDS = 6
FIGURES = ("symbol_share", "dup_line_share", "repeat_share", "long_words")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that a text has twice or more."""
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("p")),
        )

    def twice(s: Column) -> Column:
        """Starts of windows that stand next to their equal among sorted windows."""
        last = F.size(s)
        return F.filter(
            F.transform(
                s,
                lambda x, i: F.when(
                    ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["p"]
                ),
            ),
            lambda p: p.isNotNull(),
        )

    def covered(p: Column) -> Column:
        """Words under windows at the sorted starts ``p``: three each, less what neighbours share."""
        return F.aggregate(
            p,
            F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
            lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")),
            lambda a: a["n"],
        )

    found = _let(F.sort_array(windows(words)), lambda s: F.sort_array(twice(s)))
    return F.when(n >= 3, covered(found)).otherwise(0).cast("bigint")


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """id, the group columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    marked = docs.select(
        F.col(id_col).alias("_id"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], text.alias("_t"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"), lines.alias("_l"),
    )
    joined = F.array_join("_w", "")
    symbols = sum((F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(c), F.lit(""))) for c in SYMBOLS[1:]), F.length("_t") - F.length(F.replace(F.col("_t"), F.lit(SYMBOLS[0]), F.lit(""))))
    return marked.select(
        "_id", *[f"_k{i}" for i in range(len(keys))],
        F.size("_w").cast("bigint").alias("n_words"), F.length(joined).cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        F.size("_l").cast("bigint").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
    )


def _shares() -> dict[str, Column]:
    """Logarithms of symbols a word character, repeated lines a line and repeated words a word; word characters a word."""
    rate = lambda a, b: F.log((F.col(a) + 1) / (F.col(b) + 1))
    return {
        "symbol_share": rate("n_symbols", "word_chars"), "dup_line_share": rate("n_dup_lines", "n_lines"), "repeat_share": rate("n_repeat_words", "n_words"),
        "long_words": F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0),
    }


def _errors() -> dict[str, Column]:
    """Standard errors of the figures: of the logarithm of a count of events, and of a mean of so many counts."""
    of = lambda events: 1 / F.sqrt(events + 1)
    mean = F.sqrt(F.col("long_words") / F.greatest(F.col("n_words").cast("double"), F.lit(1.0)))
    return {"symbol_share": of(F.col("n_symbols")), "dup_line_share": of(F.col("n_dup_lines")), "repeat_share": of(F.col("n_repeat_words") / REPEAT_WORDS), "long_words": mean}


def fences(measured: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group with the upper fence of each figure; coarser groups stand in for small ones.

    ``measured`` has the keys and the figures of ``_shares``. Sketches of the finest groups are merged into
    those of coarser ones; the texts are not read again.
    """
    names = list(FIGURES)
    fine = measured.groupBy(*keys).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(x, SKETCH).alias(x) for x in names])

    def coarser(by: list[str], tag: str) -> DataFrame:
        return fine.groupBy(*by).agg(F.sum("n").alias(f"n_{tag}"), *[F.kll_merge_agg_double(x, SKETCH).alias(f"{x}_{tag}") for x in names])

    out, mid, all_ = fine, coarser(keys[:1], "mid"), coarser([], "all")
    out = out.alias("f").join(F.broadcast(all_), F.lit(True))  # one row
    out = out.join(mid.withColumnRenamed(keys[0], "_mid"), F.col(keys[0]).eqNullSafe(F.col("_mid")), "left").drop("_mid")

    def fence(x: str) -> Column:
        sketch = F.when(F.col("n") >= MIN_GROUP, F.col(x)).when(F.col("n_mid") >= MIN_GROUP, F.col(f"{x}_mid")).otherwise(F.col(f"{x}_all"))
        q = lambda p: F.kll_sketch_get_quantile_double(sketch, F.lit(p))
        return (q(0.75) + FENCE * (q(0.75) - q(0.25))).alias(f"max_{x}")

    return out.select(*keys, *[fence(x) for x in names])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, the base figures, base_failed, kept, and ``beyond``, the figures beyond their fences, of each row of ``docs``."""
    ws = Workspace(docs.sparkSession, "quality")
    ks = [f"_k{i}" for i in range(len(keys))]
    base = ws.save(figures(docs, id_col, text_col, keys), "figures")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = base.withColumn("base_failed", failed).select("*", *[c.alias(n) for n, c in _shares().items()])
    limits = ws.save(fences(rows.where(~F.col("base_failed")), ks), "fences")
    # each fence once for every salt, each row with one of them
    spread = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = lambda cols: F.xxhash64(*cols)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).withColumn("_g", key(ks))
    right = spread.withColumn("_g", key(ks)).select("_g", "_salt", *[F.col(k).alias(f"_f{k}") for k in ks], *[f"max_{x}" for x in FIGURES])
    on = (left["_g"] == right["_g"]) & (left["_salt"] == right["_salt"])
    for k in ks:
        on = on & left[k].eqNullSafe(right[f"_f{k}"])
    errors = _errors()
    over = [F.when(~F.col("base_failed") & (F.col(x) - ERRORS * errors[x] > F.col(f"max_{x}")), F.lit(x)) for x in FIGURES]
    return left.join(right, on, "left").withColumn("beyond", F.array_compact(F.array(*over))).select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("beyond") == 0)).alias("kept"), "beyond",
    )
