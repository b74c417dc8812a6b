"""From documents to packed training sequences: five stages, each over all that the one before kept.

Each stage gets (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlake.llm import lines, ngram_join, packing, substring, toxicity
from embedlake.llm._work import Workspace, fresh

#: SQL can express neither the field model of the first stage nor its successors' digests; see the tests.
ORACLE_SQL = None


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the model rejects go. It learns from all labels but the held-out ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def _fitting(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents`` with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: recurring lines go; so do documents of which nothing is left."""
    n, gone = fresh("_n_lines", docs.columns), fresh("_n_dropped", docs.columns)
    kept = lines.drop_recurring(docs, counts=(n, gone))
    return _fitting(kept.where((F.col(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near copies stays, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def _passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages that an earlier document has go; so do documents of which nothing is left."""
    n, gone = fresh("_n_words", docs.columns), fresh("_n_removed", docs.columns)
    kept = substring.remove_repeats(docs, counts=(n, gone))
    return _fitting(kept.where((F.col(gone) == 0) | (F.col(gone) < F.col(n))), docs.columns)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", _clean), ("line dedup", _lines), ("n-gram Jaccard join", _near), ("substring dedup", _passages), ("best-fit packing", _pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            ws.drop(f"stage-{k - 1}")
    return docs
