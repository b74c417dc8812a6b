"""Sessions, and what a session needs: the package on its executors and the functions in its SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(app: str = "embedlake", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Scratch folder where ``spark.checkpoint.dir`` is unset and all runs on one machine, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints/embedlake"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = LOCAL_SCRATCH
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; needed where they don't have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_embedlake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(prefix="embedlake-"), "embedlake-src.zip")
    with zipfile.ZipFile(name, "w") as z:
        for top, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    own = os.path.join(top, f)
                    z.write(own, os.path.relpath(own, os.path.dirname(here)))
    sc.addPyFile(name)
    sc._embedlake_shipped = True


def register_all(spark: SparkSession) -> None:
    """The SQL functions of the library, under the prefix ``ai_``."""
    from embedlake.functions import models
    from embedlake.functions.vector import SQL_FUNCTIONS
    from embedlake.operators.chunk import table_functions

    ship(spark)
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
    for name, f in table_functions().items():
        spark.udtf.register(name, f)
    models.register(spark)
