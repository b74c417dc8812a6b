"""Versioned Parquet tables: folders of files, and a pointer to those that count, which a rename replaces. One writer a table.

A table with keys is laid out in buckets of their hash: an upsert rewrites the buckets that it touches and no
other, and lays its own rows beside them in a second folder of the bucket (``+`` in the pointer). A table without keys takes appends as further folders, which are put together when they get many.
What a change replaces stays readable until the next change.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a keyed table unless it is made with another number, and folders of one without keys before they are put together.
BUCKETS, PARTS = 16, 32
#: Replaced keys that are broadcast at most; beyond it they and the rows of their buckets are shuffled.
FEW = 1_000_000


class Table:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        name = self._path(f"{self.path}/_current")
        for left in range(20, -1, -1):
            if not self._fs.exists(name):
                return None
            stream = self._fs.open(name)
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except Py4JJavaError as e:
                # a local file system moves a file's checksum in a step of its own, which a reader can meet
                if not left or "ChecksumException" not in str(e.java_exception):
                    raise
                time.sleep(0.05)
            finally:
                stream.close()
        return None

    def exists(self) -> bool:
        return self._pointer() is not None

    def _read(self, parts: list[str], schema) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def read(self) -> DataFrame:
        p = self._pointer()
        if p is None:
            raise FileNotFoundError(self.path)
        return self._read(list(p["parts"].values()), self._schema(p))

    @staticmethod
    def _schema(pointer: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(pointer["schema"])

    def batch(self) -> int | None:
        """The last batch that was written, for writers that may run again."""
        p = self._pointer()
        return p and p.get("batch")

    def _bucket(self, keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _lay(self, df: DataFrame, keys: list[str] | None, buckets: int, deal: bool = True) -> dict[str, str]:
        """Write ``df`` to a folder of its own; the parts by bucket, or one part. Without ``deal`` tasks write the buckets that they have."""
        folder = f"v-{uuid.uuid4().hex}"
        if not keys:
            df.write.parquet(f"{self.path}/{folder}")
            return {folder: folder}
        placed = df.withColumn("_bucket", self._bucket(keys, buckets))
        (placed.hint("rebalance", "_bucket") if deal else placed).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def _publish(self, old: dict | None, now: dict, gone: list[str]) -> None:
        """Replace the pointer; then delete what the change before had replaced."""
        work, name = self._path(f"{self.path}/_current.{uuid.uuid4().hex}"), self._path(f"{self.path}/_current")
        out = self._fs.create(work, True)
        out.write(bytearray(json.dumps(now | {"gone": gone}).encode()))
        out.close()
        fs, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        kind = getattr(fs, "Options$Rename")
        over = gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        fs.FileContext.getFileContext(self._fs.getUri(), conf).rename(self._fs.makeQualified(work), self._fs.makeQualified(name), over)
        for part in (old or {}).get("gone", []):
            self._fs.delete(self._path(f"{self.path}/{part}"), True)

    def write(self, df: DataFrame, batch: int | None = None, keys: list[str] | None = None) -> None:
        """All rows anew, in buckets of ``keys`` if there are any."""
        old = self._pointer()
        parts = self._lay(df, keys, self.buckets)
        now = {"keys": keys, "buckets": self.buckets, "parts": parts, "batch": batch, "schema": json.loads(df.schema.json())}
        self._publish(old, now, list(old["parts"].values()) if old else [])

    def append(self, df: DataFrame, batch: int | None = None) -> None:
        """Add rows; nothing if ``batch`` was the last that was written."""
        old = self._pointer()
        if old is not None and batch is not None and old.get("batch") == batch:
            return
        if old is None or old["keys"] or len(old["parts"]) >= PARTS:
            return self.write(self.read().unionByName(df) if old else df, batch, old and old["keys"])
        self._publish(old, {k: v for k, v in old.items() if k != "gone"} | {"parts": old["parts"] | self._lay(df, None, 0), "batch": batch}, [])

    def upsert(self, new: DataFrame, keys: list[str], gone: DataFrame | None = None, batch: int | None = None) -> None:
        """Replace all rows of the keys in ``new`` and in ``gone`` by those of ``new``, which is worked out once."""
        p = self._pointer()
        if p is not None and batch is not None and p.get("batch") == batch:
            return
        if p is None:
            return self.write(new, batch, keys)
        if p["keys"] != keys:  # another layout
            self.write(self.read(), p.get("batch"), keys)
            p = self._pointer()
        schema, names = self._schema(p), self._schema(p).names
        staged = self._lay(new.select(*names), keys, p["buckets"])
        rows = self._read(list(staged.values()), schema)
        out_keys = rows.select(*keys) if gone is None else rows.select(*keys).unionByName(gone.select(*keys))
        touched = set(staged)
        if gone is not None:
            touched |= {str(r[0]) for r in gone.select(self._bucket(keys, p["buckets"])).distinct().collect()}  # a row a bucket at most
        before = {b: f for b, f in p["parts"].items() if b.rstrip("+") in touched}
        kept = {b: f for b, f in p["parts"].items() if b.rstrip("+") not in touched}
        now = {f"{b}+": f for b, f in staged.items()}
        if before:
            old = self._read(list(before.values()), schema)
            same = [old[k].eqNullSafe(out_keys[k]) for k in keys]
            on = same[0]
            for s in same[1:]:
                on = on & s
            out = out_keys.distinct()
            few = out.limit(FEW + 1).count() <= FEW
            # rows that stay lie by bucket already: with few keys to compare they need no shuffle
            now |= self._lay(old.join(F.broadcast(out) if few else out, on, "left_anti"), keys, p["buckets"], deal=not few)
        self._publish(p, {"keys": keys, "buckets": p["buckets"], "parts": kept | now, "batch": batch, "schema": p["schema"]}, list(before.values()))
