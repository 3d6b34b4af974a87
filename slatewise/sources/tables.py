"""Reading the input tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise import schema as S
from slatewise.functions import lists, vectors


def load(spark: SparkSession, catalog: Mapping[str, str], name: str,
         columns: list[str] | None = None) -> DataFrame:
    """A parquet table by catalog name; only ``columns`` are read when given."""
    if not catalog.get(name):
        raise ValueError(f"no path configured for {name}")
    df = spark.read.parquet(catalog[name])
    return df.select(*columns) if columns else df


def load_embeddings(df: DataFrame, id_name: str | None = None) -> DataFrame:
    """(id, embedding, embedding_norm) from a table whose second column is the vector."""
    first, second = df.columns[:2]
    named = df.select(F.col(first).alias(id_name or first), F.col(second).alias("embedding"))
    return named.withColumn("embedding_norm", vectors.norm("embedding"))


def behaviors_with_history(behaviors: DataFrame, history: DataFrame, size: int = 30,
                           padding: int | None = 0) -> DataFrame:
    """Impressions left-joined with the reader's last ``size`` articles, left-padded."""
    pad = None if padding is None else F.lit(padding).cast("long")
    recent = history.select(S.USER, lists.truncate(S.HISTORY_ARTICLES, size, pad).alias(S.HISTORY_ARTICLES))
    return behaviors.join(recent, S.USER, "left")


def behaviors_with_feature_history(behaviors: DataFrame, history: DataFrame, size: int = 30) -> DataFrame:
    """Impressions left-joined with the tails of every history list that is present."""
    names = [S.HISTORY_ARTICLES, S.HISTORY_READ_TIMES, S.HISTORY_SCROLLS]
    tails = [lists.tail(n, size).alias(n) for n in names if n in history.columns]
    return behaviors.join(history.select(S.USER, *tails), S.USER, "left")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All parquet files below a folder, with the file each row came from as ``source_file``."""
    df = spark.read.option("recursiveFileLookup", True).parquet(folder)
    return df.withColumn("source_file", F.input_file_name())


def attach_embeddings(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Left join of vectors; the join itself leaves out vectors nobody asked for."""
    return articles.join(embeddings, S.ARTICLE, "left")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id [a,b,c]`` as (impression_id, scores array<double>)."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).select(
        parts[0].cast("long").alias(S.IMPRESSION),
        F.from_json(parts[1], "array<double>").alias("scores"),
    )


def key_value_table(spark: SparkSession, values: Mapping, key: str = "keys", value: str = "values") -> DataFrame:
    """A two-column table from a small Python mapping."""
    return spark.createDataFrame(list(values.items()), [key, value])
