"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made for sessions on one machine that name none, by application.
MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset on one machine, as in tests, a temporary folder is made
    once. On a cluster that is an error: a folder of one machine would lose what
    executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId  # the setting itself cannot change while a session runs
        found = MADE.get(app) or MADE.setdefault(app, "file://" + tempfile.mkdtemp(prefix="stratalens-"))
    return found


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so that what is used several times is made once."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
