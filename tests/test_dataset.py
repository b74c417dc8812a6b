import pytest
from pyspark.sql import functions as F

from embedlake.sources import commits, dataset


class Killed(Exception):
    pass


def kill(monkeypatch, at, where):
    """Stop the load in its commit ``at``: before its plan, between its moves, or before its mark."""
    put = commits.Load._put

    def broken(self, name, value):
        if where == "plan" and name.endswith(f"stage-{at}/_plan"):
            raise Killed
        put(self, name, value)
        if where == "moves" and name.endswith(f"stage-{at}/_plan") and value["files"]:  # one file is moved, then the end
            first = self._path(value["files"][0])
            assert self._fs.rename(first, self._path(f"{self.location}/{self.load}-{at}-0-{first.getName()}"))
            raise Killed

    def unmarked(self, name, value):
        if name.endswith(f"/{at}.json"):
            raise Killed
        put(self, name, value)

    monkeypatch.setattr(commits.Load, "_put", unmarked if where == "mark" else broken)


def numbers(split, start=0):
    return ((split, k) for k in range(start, {"train": 23, "test": 7, "none": 0}[split]))


EVERY = sorted([("train", k) for k in range(23)] + [("test", k) for k in range(7)])


@pytest.mark.parametrize("where", ["plan", "moves", "mark"])
def test_slices_go_on_behind_the_last_commit(spark, monkeypatch, where):
    spark.dataSource.register(dataset.generator_source("counted", "s string, k int", numbers, ["train", "test", "none"]))
    spark.sql("DROP TABLE IF EXISTS counted_rows")
    ask = lambda **more: dataset.load_dataset(spark, "counted", format="counted", table="counted_rows", batch_size=2, commit_every_n_batches=2, **more)
    with monkeypatch.context() as m:
        kill(m, 2, where)
        with pytest.raises(Killed):
            ask()
    assert len(spark.table("counted_rows").collect()) < 30
    assert ask() == 30  # the table exists, but the load was not whole
    assert sorted(map(tuple, spark.table("counted_rows").collect())) == EVERY
    with pytest.raises(ValueError):
        ask()
    assert ask(if_table_exists="append") == 30 and spark.table("counted_rows").count() == 60
    assert ask(if_table_exists="drop", max_batches=4) == 8 and spark.table("counted_rows").count() == 8


@pytest.mark.parametrize("where", ["plan", "moves", "mark"])
def test_files_go_on_behind_the_last_commit(spark, folder, monkeypatch, where):
    made = spark.range(40).select("id", F.struct((F.col("id") % 3).alias("a")).alias("s"))
    made.repartition(5).write.parquet(f"{folder}/made")
    n = len(spark.read.parquet(f"{folder}/made").inputFiles())
    spark.sql("DROP TABLE IF EXISTS made_rows")
    ask = lambda **more: dataset.load_dataset(spark, f"{folder}/made", table="made_rows", commit_every_n_batches=2, field_types={"s_a": "int"}, **more)
    with monkeypatch.context() as m:
        kill(m, 1, where)
        with pytest.raises(Exception, match="Killed"):
            ask()
    assert ask() == 40 and n == 5
    assert sorted(map(tuple, spark.table("made_rows").collect())) == [(k, k % 3) for k in range(40)]
    assert spark.table("made_rows").dtypes == [("id", "bigint"), ("s_a", "int")]
    assert ask(if_table_exists="drop", batch_size=7, max_batches=3) == 21 and spark.table("made_rows").count() == 21


def test_small(spark, folder):
    spark.dataSource.register(dataset.generator_source("empty", "k int", lambda split: iter(()), ["a"]))
    assert dataset.load_dataset(spark, "empty", format="empty", table="empty_rows", if_table_exists="drop", commit_every_n_batches=1) == 0
    assert spark.table("empty_rows").dtypes == [("k", "int")] and spark.table("empty_rows").count() == 0
    spark.range(9).coalesce(1).write.parquet(f"{folder}/one")
    one = spark.read.parquet(f"{folder}/one").inputFiles()[0]
    assert dataset.load_dataset(spark, one, table="one_rows", if_table_exists="drop", commit_every_n_batches=1) == 9
    with pytest.raises(ValueError):
        dataset.load_dataset(spark, one, table="one_rows", commit_every_n_batches=0)
    plain = dataset.generator_source("plain", "k int", lambda split: iter([(k,) for k in range(5)]), ["a", "b"])
    spark.dataSource.register(plain)  # rows before a slice's start are passed over
    assert dataset.load_dataset(spark, "plain", format="plain", split="b", table="plain_rows", if_table_exists="drop", batch_size=2, commit_every_n_batches=1) == 5
    assert sorted(r["k"] for r in spark.table("plain_rows").collect()) == [0, 1, 2, 3, 4]
