"""Replacing ids in lists through lookup tables, and the training tables built on that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.functions import lists
from slatewise.operators.aggregates import dense_codes, vector_means
from slatewise.operators.longform import explode_lists


def lookup_table(df: DataFrame, key: str, value: str, latest: Sequence[str]) -> DataFrame:
    """One row per key; of duplicates the last in ``latest`` order wins."""
    order = F.struct(*latest)
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def map_long(df: DataFrame, lookup: DataFrame, key: str, value: str, fill: Column | None = None,
             drop_unknown: bool = False) -> DataFrame:
    """The value of each row's id; unknown ids give null, ``fill``, or lose their row."""
    joined = df.join(lookup.select(key, value), key, "inner" if drop_unknown else "left")
    return joined if fill is None else joined.withColumn(value, F.coalesce(value, fill))


def map_list(df: DataFrame, keys: Sequence[str], column: str, lookup: DataFrame, key: str, value: str,
             fill: Column | None = None, drop_unknown: bool = False) -> DataFrame:
    """A list column mapped through a lookup table, order kept.

    A null list becomes ``[null]`` or ``[fill]`` (null when dropping); an emptied list is null.
    ``keys`` must identify a row.
    """
    whole = df.select(*keys, column)
    long = explode_lists(whole, [column], [key], pos="__pos", keep_empty=True)
    value_col = F.col(value) if fill is None else F.coalesce(F.col(value), fill)
    mapped = long.join(lookup.select(key, value), key, "left").withColumn("__v", value_col)
    if drop_unknown:
        mapped = mapped.filter(F.col("__v").isNotNull())
    # each list came from one row's cell, so folding it back cannot outgrow that cell
    folded = mapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__pos", "__v"))).alias("__rows"))
    back = folded.select(*keys, F.transform("__rows", lists.field("__v")).alias("__mapped"))
    joined = df.join(back, list(keys), "left")
    was_empty = F.size(column) == 0
    out = F.when(was_empty, F.lit(None) if drop_unknown else F.slice("__mapped", 1, 0)).otherwise(F.col("__mapped"))
    return joined.withColumn(column, out).drop("__mapped")


def index_table(vectors_df: DataFrame, key: str, vector: str, unknown: str = "zeros") -> DataFrame:
    """(index, key, vector) with known keys from 1 and row 0 standing for every unknown key."""
    if unknown not in ("zeros", "mean"):
        raise ValueError("unknown must be 'zeros' or 'mean'")
    codes = dense_codes(vectors_df, key, "index", start=1)
    known = vectors_df.join(codes, key).select("index", key, F.col(vector).cast("array<double>").alias(vector))
    null_key = F.lit(None).cast(vectors_df.schema[key].dataType).alias(key)
    if unknown == "mean":
        row = vector_means(vectors_df.select(vector), [], vector, vector)
    else:
        row = vectors_df.agg(F.array_repeat(F.lit(0.0), F.max(F.size(vector))).alias(vector))
    return known.unionByName(row.select(F.lit(0).cast("long").alias("index"), null_key, vector))


def encode(df: DataFrame, codes: DataFrame, key: str, name: str, unknown: int = 0) -> DataFrame:
    """Dense index of a key column, ``unknown`` where the key has none."""
    joined = df.join(codes.select(key, F.col("index").alias(name)), key, "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(unknown).cast("long")))


def encode_lists(behaviors: DataFrame, codes: DataFrame, columns: Sequence[str], key: str = S.ARTICLE,
                 row_key: str = S.IMPRESSION, unknown: int = 0, value: str = "index") -> DataFrame:
    """Training form: every id list of an impression replaced by indexes in one pass.

    All lists are exploded together, joined once, and folded back.
    """
    entries = F.concat(*[
        F.transform(F.coalesce(F.col(c), F.array().cast("array<long>")), lists.tagged(c))
        for c in columns])
    long = behaviors.select(row_key, F.explode(entries).alias("e"))
    long = long.select(row_key, "e.list", "e.pos", F.col("e.id").alias(key))
    found = long.join(codes.select(key, F.col(value).alias("__v")), key, "left")
    found = found.withColumn("__v", F.coalesce("__v", F.lit(unknown)))
    folded = found.groupBy(row_key).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("pos", "__v")))).alias(f"__{c}")
        for c in columns])
    values = folded.select(row_key, *[
        F.transform(f"__{c}", lists.field("__v")).alias(f"__{c}") for c in columns])
    joined = behaviors.join(values, row_key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.array().cast("array<long>")) for c in columns}).drop(
        *[f"__{c}" for c in columns])


def encode_views(behaviors: DataFrame, articles: DataFrame, views: Sequence[str], columns: Sequence[str],
                 key: str = S.ARTICLE, row_key: str = S.IMPRESSION, unknown: int = 0) -> DataFrame:
    """Several attributes (title index, body index, category, ...) of the same lists at once.

    One explode, one join carrying all attributes, one fold; columns are named ``<view>_<list>``.
    """
    entries = F.concat(*[
        F.transform(F.coalesce(F.col(c), F.array().cast("array<long>")), lists.tagged(c))
        for c in columns])
    long = behaviors.select(row_key, F.explode_outer(entries).alias("e"))
    long = long.select(row_key, "e.list", "e.pos", F.col("e.id").alias(key))
    found = long.join(articles.select(key, *views), key, "left")
    found = found.withColumns({v: F.coalesce(F.col(v), F.lit(unknown)) for v in views})
    folded = found.groupBy(row_key).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("pos", *views)))).alias(f"__{c}")
        for c in columns])
    return folded.select(row_key, *[
        F.transform(f"__{c}", lists.field(v)).alias(f"{v}_{c}") for v in views for c in columns])


def scoring_rows(behaviors: DataFrame, history: str, extra: Sequence[str] = ()) -> DataFrame:
    """Scoring form: one row per candidate with the history list beside it and its click label."""
    labelled = behaviors.select(
        S.IMPRESSION, *extra, history, F.col(S.INVIEW), lists.length(S.INVIEW).alias("n_samples"),
        lists.click_labels(S.INVIEW, S.CLICKED).alias(S.LABEL))
    return explode_lists(labelled, [S.INVIEW, S.LABEL], [S.ARTICLE, S.LABEL])
