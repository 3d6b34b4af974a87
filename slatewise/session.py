"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Joins on skewed keys are split by adaptive execution, also where that costs one more shuffle.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings every plan here relies on."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "slatewise", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "localhost")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the actions inside; the one before is put back."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed now and read from the shared checkpoint folder from then on.

    The shuffle files of its plan are removed with the job: nothing reads them again, and a loop of checkpoints would
    gather them until the driver's next collection of garbage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):
        return df.select("*").checkpoint()  # a plan takes the setting when it is made


def drop_checkpoint(df: DataFrame) -> None:
    """Remove the files of a table that ``checkpointed`` returned and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="slatewise-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder
