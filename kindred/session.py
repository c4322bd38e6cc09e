"""Session settings and the shared folder that lineage cuts are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "kindred", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster leave ``master`` unset and let spark-submit decide. Adaptive
    execution stays on, because hot users are split by its skew-join rule.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all machines can reach.

    Where none is named, a local master (tests, a laptop) gets a new temporary folder.
    A cluster is refused: its machines do not see each other's temporary folders.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not configured and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(
                "spark.checkpoint.dir must name a folder that all machines share"
            )
        spark.sparkContext.setCheckpointDir(
            configured or tempfile.mkdtemp(prefix="kindred-checkpoint-")
        )
        current = spark.sparkContext.getCheckpointDir()
    return configured or current


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder once and go on from the files.

    Used where one result feeds several later steps, or where a later step must
    see exactly the rows an earlier one saw even after an executor is lost. Later
    reads take only the columns and row groups they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, in one sub-folder per application.

    The sub-folder may be deleted when the application has ended.
    """
    folder = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"

