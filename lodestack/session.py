"""Session helpers: reading the tables of a folder and cutting lineage safely.

Nothing here starts a cluster; a session is always given by the caller.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir`` as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``, which all executors
    share, so the rows outlive a lost executor. Only a local master, whose
    executors are this machine, gets a temporary folder where the setting is
    missing; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="lodestack-"))
    return df.checkpoint(eager=True)
