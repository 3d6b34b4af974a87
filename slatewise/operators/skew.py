"""Ranking and numbering that do not put a hot group, or the whole table, in one task.

A window over ``partitionBy(key)`` sends each key's rows to one task.  That is the right plan
while no key is large, so the functions here first count rows per key (a map-side-combined
aggregate over the key columns only).  Keys above the limit are split off and numbered by a
range shuffle on the whole sort key, which spreads one key over many tasks; all other keys keep
the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise.session import ensure_checkpoint_dir

# A key with more rows than this is hot, whatever the size of the table.  There are at most
# rows / HOT_ROWS such keys: a million in a table of 10^12 rows, some ten megabytes.
HOT_ROWS = 1_000_000

TASK_ROWS = 250_000  # rows of a task where their number is known

DETECT = object()

_SLOT_BITS = 33  # monotonically_increasing_id keeps the row's slot in its low 33 bits


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame | None:
    """The keys with more than ``min_rows`` rows (``HOT_ROWS``), as a checkpointed table, or ``None``.

    Runs a job: one map-side-combined count per key.  Only where a key exceeds the limit a second one writes the table.
    """
    limit = HOT_ROWS if min_rows is None else min_rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if (counts.agg(F.max("n")).first()[0] or 0) <= limit:
        return None
    ensure_checkpoint_dir(df.sparkSession)
    return counts.filter(F.col("n") > limit).select(*keys).checkpoint()


def large_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with more than ``HOT_ROWS`` rows, found within the plan that uses them: no job and no checkpoint."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_ROWS).select(*keys)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows: ``TASK_ROWS`` each, and at least one for each core."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys); null keys compare equal to null."""
    renamed = F.broadcast(hot.toDF(*[f"__hot_{k}" for k in keys]))
    same = None
    for k in keys:
        eq = df[k].eqNullSafe(renamed[f"__hot_{k}"])
        same = eq if same is None else same & eq
    return df.join(renamed, same, "left_anti"), df.join(renamed, same, "left_semi")


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str = "row_number",
                      start: int = 1) -> DataFrame:
    """Number all rows in a total order without a one-partition window.

    ``order`` must be unique per row.  Rows are range-shuffled and sorted, their slot within the
    partition is frozen by a checkpoint, and one offset per partition is broadcast back.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("__place", _SLOT_BITS)
    # one row per partition, so this window and the broadcast are small whatever the table size
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = (
        placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
        .select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    )
    place = F.col("__place").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + place + F.lit(start))
        .drop("__part", "__before", "__place")
    )


def row_number_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                        name: str = "row_number", hot=DETECT) -> DataFrame:
    """``row_number()`` from 1 within each key, with hot keys spread over many tasks.

    ``order`` must be unique within a key.  Pass ``hot`` when it is already known for the base
    table (``None`` for "no hot keys").
    """
    if hot is DETECT:
        hot = hot_keys(df, keys)
    windowed = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")
    if hot is None:
        return df.withColumn(name, windowed)
    cold, heavy = split_hot(df, keys, hot)
    numbered = global_row_number(heavy, [*keys, *order], "__global")
    first = numbered.groupBy(*keys).agg(F.min("__global").alias("__first"))
    first = first.toDF(*[f"__key_{k}" for k in keys], "__first")
    same = None
    for k in keys:
        eq = numbered[k].eqNullSafe(first[f"__key_{k}"])
        same = eq if same is None else same & eq
    ranked = (
        numbered.join(F.broadcast(first), same)  # one row per hot key
        .withColumn(name, F.col("__global") - F.col("__first") + 1)
        .select(*df.columns, name)
    )
    return cold.withColumn(name, windowed).unionByName(ranked)


def with_group_values(df: DataFrame, keys: Sequence[str], values: dict[str, Column], hot=DETECT) -> DataFrame:
    """Each row with aggregates of its key: a window for ordinary keys, and for the few hot keys
    a map-side-combined aggregate broadcast back."""
    if hot is DETECT:
        hot = hot_keys(df, keys)
    whole = W.partitionBy(*keys)
    windowed = {n: v.over(whole) for n, v in values.items()}
    if hot is None:
        return df.withColumns(windowed)
    cold, heavy = split_hot(df, keys, hot)
    totals = heavy.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()])
    totals = totals.toDF(*[f"__key_{k}" for k in keys], *values)
    same = None
    for k in keys:
        eq = heavy[k].eqNullSafe(totals[f"__key_{k}"])
        same = eq if same is None else same & eq
    filled = heavy.join(F.broadcast(totals), same).select(*df.columns, *values)
    return cold.withColumns(windowed).unionByName(filled)


GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def top_n_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int,
                   name: str = "rank") -> DataFrame:
    """First ``n`` rows of each key; Spark's window group limit trims each map task to ``n`` per
    key before the shuffle, so a hot key sends only a few rows.

    Spark applies it up to a threshold of the session, which is raised to ``n`` here.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT, "1000")) < n:
        conf.set(GROUP_LIMIT, str(n))
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(name) <= n)
