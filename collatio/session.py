"""Session construction shared by tests, the bench and the command line."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "collatio", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on, UTC timestamps and Arrow transfer.

    ``master`` is only passed in tests and local benches; under ``spark-submit`` the
    cluster decides. Anything in ``conf`` wins over the defaults here.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves sessions that run in this process alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.get("folder") or _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="collatio-kept-"))
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    For what several later steps read: nothing is held in memory, and a lost executor costs no
    recomputation.
    """
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
