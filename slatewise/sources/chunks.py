"""Scoring in chunks that can be taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise import schema as S

STAGED = "_candidates"  # hidden from readers of the folder by its first character


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed: its last act is the mark ``_SUCCESS``."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    marked = df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    (marked.partitionBy(*partitions) if partitions else marked).parquet(path)


def score_chunks(candidates: DataFrame, folder: str, model: str, score: Callable[[DataFrame], DataFrame], chunks: int,
                 key: str = S.IMPRESSION) -> int:
    """Score ``candidates`` in ``chunks`` parts, each to ``folder``/model=<model>/chunk=<k>; how many were written now.

    All rows of a ``key`` are in one chunk.  A chunk that was committed is left as it is, one that was not is written
    anew, so after a failure the same call does what is left.  Candidates are dealt out to the folder once, by their
    chunk: each chunk reads its own rows only, and a later call scores the same rows, also for other models (which
    must ask for as many chunks).
    """
    spark = candidates.sparkSession
    todo = [k for k in range(chunks) if not finished(spark, f"{folder}/model={model}/chunk={k}")]
    if not todo:
        return 0
    staged = f"{folder}/{STAGED}/of={chunks}"
    if not finished(spark, staged):
        dealt = candidates.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))
        _write(dealt.repartitionByRange("chunk", key), staged, "chunk")
    names = [f.name for f in candidates.schema]
    rows = spark.read.schema(candidates.select(*names, F.lit(0).alias("chunk")).schema).parquet(staged)
    for k in todo:
        _write(score(rows.filter(F.col("chunk") == k).select(*names)), f"{folder}/model={model}/chunk={k}")
    return len(todo)


def read_scores(spark: SparkSession, folder: str, *models: str) -> DataFrame:
    """The committed chunks of the models, with the columns ``model`` and ``chunk``."""
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/model={m}" for m in models])
