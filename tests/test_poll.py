import datetime
import threading
import time

import pytest

from embedlake import config as C
from embedlake.plans.poll import Worker, due, interval
from embedlake.plans.registry import Registry

UTC = datetime.timezone.utc


def at(minutes):
    return datetime.datetime(2024, 1, 1, 12, tzinfo=UTC) + datetime.timedelta(minutes=minutes)


def test_intervals():
    assert [interval(x) for x in ("5m", "90 seconds", "1h 30m", "1 day")] == [300, 90, 5400, 86400]
    for bad in ("", "5", "soon", "5 parsecs!"):
        with pytest.raises(ValueError):
            interval(bad)


def test_due():
    none, five = C.scheduling_none(), C.scheduling_periodic("5m")
    assert due(none, None, at(0), 60) and not due(none, at(0), at(0.5), 60) and due(none, at(0), at(1), 60)
    assert due(five, None, at(0), 60) and not due(five, at(0), at(4), 60) and due(five, at(0), at(5), 60)
    later = C.scheduling_periodic("5m", initial_start=at(10).isoformat())
    assert not due(later, None, at(9), 60) and due(later, None, at(10), 60)
    grid = C.scheduling_periodic("5m", initial_start=at(0).isoformat(), fixed_schedule=True)
    assert due(grid, at(4), at(5), 60) and not due(grid, at(5), at(9), 60)
    free = C.scheduling_periodic("5m", initial_start=at(0).isoformat())
    assert not due(free, at(4), at(5), 60)


@pytest.fixture
def registry(spark, folder):
    r = Registry(spark, folder)
    for name, n in (("one", 3), ("two", 5), ("off", 2)):
        spark.range(n).selectExpr("id", "concat('text ', id) AS body").createOrReplaceTempView(f"poll_{name}")
        schema = spark.table(f"poll_{name}").schema
        r.create({**C.vectorizer(f"poll_{name}", schema, ["id"], C.loading_column("body"), C.embedding_hash(4), chunking=C.chunking_none()), "name": name})
    r.disable("off")
    return r


def test_round(spark, registry):
    w = Worker(registry, poll=60)
    spark.catalog.dropTempView("poll_one")  # its source is gone: on record, and the other one runs
    rows = {r[1]: r for r in w.round(at(0))}
    assert set(rows) == {"one", "two"} and rows["one"][-1] and rows["two"][-1] is None and rows["two"][4] == 5
    assert w.round(at(0.5)) == []
    spark.range(4).selectExpr("id", "'x' AS body").createOrReplaceTempView("poll_one")
    rows = {r[1]: r[4:] for r in w.round(at(1))}
    assert rows == {"one": (4, 0, 0, 0, 0, None), "two": (0, 0, 0, 0, 0, None)}
    registry.enable("off")  # seen at the next round
    assert "off" in {r[1] for r in w.round(at(2))}
    assert registry.get("one").table("store").read().count() == 4 and w._table("runs").read().count() == 7
    with pytest.raises(KeyError):
        Worker(registry, which=["nope"]).round()
    assert [r[1] for r in Worker(registry, which=["two"]).round()] == ["two"]
    config = C.vectorizer("poll_two", spark.table("poll_two").schema, ["id"], C.loading_column("body"), C.embedding_hash(4), chunking=C.chunking_none(), scheduling=C.scheduling_periodic("1h"))
    registry.create({**config, "name": "hourly"})
    assert [r[1] for r in Worker(registry, which=["hourly"]).round()] == ["hourly"]
    assert Worker(registry, which=["hourly"]).round() == []  # another worker knows of the run


def test_run(spark, registry):
    w = Worker(registry, which=["two"], poll=0.5)
    assert w.run(once=True) is None
    done = []
    t = threading.Thread(target=lambda: done.append(w.run(look=0.2, timeout=60)))
    t.start()
    time.sleep(3)
    w.request_stop()
    t.join(40)
    assert done == [None] and not w._stopping()
    events = [r["event"] for r in w._table("workers").read().where(f"worker = '{w.id}'").orderBy("at").collect()]
    assert events[0] == "started" and events[-1] == "stopped" and "heartbeat" in events
    spark.catalog.dropTempView("poll_two")
    assert "poll_two" in Worker(registry, which=["two"], exit_on_error=True).run(timeout=30)
