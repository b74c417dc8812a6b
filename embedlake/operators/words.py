"""Search by words over postings, ranked by how rare a word is and how often a text has it; and the fusion of rankings.

Postings are lists (ids, tfs, lens) of a term in a batch of texts, counted where the texts are read, so that no word is
shuffled on its own. They lie in Parquet, in folders by a hash of the term and in the order of terms within files, so a
search reads the folders of its terms and skips the rest of their rows by statistics. Texts are not read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedlake.plans.store import Table

#: Words, and the folders that postings lie in.
WORD, BUCKETS = r"[\p{L}\p{N}_]+", 64
#: How soon repeated words count less, and how much the length of a text counts; usual values.
K1, B = 1.2, 0.75
#: Decimals of scores, which decide ties.
DIGITS = 6
#: Added to ranks in a fusion; the usual value.
RANK = 60
#: Words that a task counts at once, about.
WORK = 1 << 20


def terms(text):
    """The words of a text column, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def postings(words: DataFrame) -> DataFrame:
    """(term, ids, tfs, lens, words) of ``words`` (id, _w): a row for each term of some texts that a task reads one behind the other."""
    names, kind = ["term", "ids", "tfs", "lens", "words"], words.schema["id"].dataType.simpleString()

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        held, n = part.column(1), part.num_rows
        size = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = held.flatten().dictionary_encode()
        at, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
        term, text = at // n, at % n
        begin = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        ends = pa.array(np.append(begin, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, v) for v in (part.column(0).take(pa.array(text)), pa.array(tf.astype(np.int32)), pa.array(size[text]))]
        return pa.RecordBatch.from_arrays([coded.dictionary, *lists, pa.array(np.add.reduceat(tf, begin).astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            so_far = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows and so_far[-1] > (done := so_far[first - 1] if first else 0):
                last = max(first + 1, int(np.searchsorted(so_far, done + WORK, side="right")))
                if so_far[last - 1] > done:
                    yield count(batch.slice(first, last - first))
                first = last

    return words.select("id", "_w").mapInArrow(run, f"term string, ids array<{kind}>, tfs array<int>, lens array<int>, words bigint")


class WordIndex:
    """An index below ``path``; building it anew replaces it by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = Table(spark, self.path)

    def _bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")

    def build(self, rows: DataFrame, id_col: str, text_col: str) -> dict:
        """Index the texts of ``rows``; ids should be unique. A text without words counts as one of length 0."""
        words = rows.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("_w"))
        posted = postings(words)
        laid = posted.withColumn("bucket", self._bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
        version = f"v-{uuid.uuid4().hex}"
        laid.write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        total = self.spark.read.schema(posted.schema).parquet(f"{self.path}/{version}").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
        meta = {"texts": rows.count(), "words": total}
        head = meta | {"version": version, "id": words.schema["id"].dataType.simpleString()}
        self.table.write(self.spark.createDataFrame([(json.dumps(head),)], "meta string").coalesce(1))
        return meta

    def _meta(self) -> dict:
        return json.loads(self.table.read().first()["meta"])

    def search(self, query: str, k: int, only: DataFrame | None = None) -> DataFrame:
        """(id, score) of the ``k`` best texts, of those whose id is in ``only``; ties by id."""
        meta = self._meta()
        asked = sorted({w for w in re.findall(r"\w+", query.lower())})
        if not asked or not meta["texts"]:
            return self.spark.createDataFrame([], f"id {meta['id']}, score double")
        wanted = F.array(*[F.lit(w) for w in asked])
        buckets = [r[0] for r in self.spark.range(1).select(F.explode(F.array_distinct(F.transform(wanted, lambda w: self._bucket(w))))).collect()]
        schema = f"term string, ids array<{meta['id']}>, tfs array<int>, lens array<int>, words bigint, bucket int"
        lists = self.spark.read.schema(schema).parquet(f"{self.path}/{meta['version']}").where(F.col("bucket").isin(buckets) & F.col("term").isin(asked))
        each = lists.select("term", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("term", F.col("p.ids").alias("id"), F.col("p.lens").alias("len"), F.col("p.tfs").alias("tf"))
        found = each.repartition("id").groupBy("term", "id", "len").agg(F.sum("tf").alias("tf"))  # repeated ids count as one text
        df = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a word of the query
        rare = F.log(1 + (meta["texts"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean = meta["words"] / meta["texts"] or 1.0
        often = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
        if only is not None:
            found = found.join(only.select(F.col(only.columns[0]).alias("id")).distinct(), "id", "left_semi")
        scored = found.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(rare * often), DIGITS).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)


def fused(rankings: Sequence[DataFrame], key: str, k: int) -> DataFrame:
    """(key, score) by the sum of 1 / (``RANK`` + rank) over short rankings of (key, _by), smaller ``_by`` first; ties by key."""
    parts = [r.select(key, F.row_number().over(Window.orderBy("_by", key)).alias("rank")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    scored = both.groupBy(key).agg(F.round(F.sum(1.0 / (RANK + F.col("rank"))), 9).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)
