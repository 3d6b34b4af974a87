"""Counts, ratios, quantiles, distributions and scalings."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise import schema as S
from slatewise.functions import scalars
from slatewise.functions.lists import field
from slatewise.operators.skew import _SLOT_BITS, global_row_number, large_keys, split_hot
from slatewise.session import ensure_checkpoint_dir


def item_counts(df: DataFrame, item: str = S.ARTICLE, name: str = "n") -> DataFrame:
    return df.groupBy(item).agg(F.count(F.lit(1)).alias(name))


def list_item_counts(df: DataFrame, column: str, item: str = S.ARTICLE, name: str = "n") -> DataFrame:
    return item_counts(df.select(F.explode(column).alias(item)), item, name)


def interactions(df: DataFrame, user: str = S.USER, item: str = S.ARTICLE) -> DataFrame:
    return df.na.drop(subset=[user, item]).groupBy(user, item).agg(F.count(F.lit(1)).alias("value"))


def engagement(df: DataFrame, item: str = S.ARTICLE, columns: Sequence[str] = (S.READ_TIME, S.SCROLL)) -> DataFrame:
    """Mean of each engagement column per article, over rows that have all of them."""
    clean = df.na.drop(subset=[item, *columns])
    return clean.groupBy(item).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def nearest_quantile(df: DataFrame, column: str, q: float) -> Column:
    """The value at sorted position round(q * (rows - 1)), as a literal; null for an empty column.

    Equal values are counted together first, then the cumulative counts decide.  Runs its jobs at once.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__times"))
    ordered = running_sum(counts, [column], "__times", "__upto")
    rows = ordered.agg(F.max("__upto")).first()[0]
    target = math.floor(q * ((rows or 0) - 1) + 0.5) + 1
    return F.lit(ordered.filter(F.col("__upto") >= target).agg(F.min(column)).first()[0])


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of a whole table in a unique order, without a one-partition window.

    Rows are range-shuffled and sorted; sums run within the ranges, and each range starts from the
    total of those before it, one row per range.  The sorted rows are checkpointed at once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("__place", F.monotonically_increasing_id())
              .withColumn("__range", F.shiftright("__place", _SLOT_BITS)).checkpoint())
    sums = placed.groupBy("__range").agg(F.sum(value).alias("__sum"))
    ahead = F.sum("__sum").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select("__range", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    inside = F.sum(value).over(W.partitionBy("__range").orderBy("__place"))
    return (placed.join(F.broadcast(offsets), "__range")
            .withColumn(name, F.col("__ahead") + inside).drop("__range", "__place", "__ahead"))


BLOCK = 16  # vector entries summed per row of the blockwise aggregate


def vector_sums(df: DataFrame, keys: Sequence[str], vector: str, name: str = "sum", count: str = "n",
                others: dict[str, Column] | None = None, present: str | None = None, norm: str | None = None) -> DataFrame:
    """(keys..., name, count, others...): element-wise sum of the non-null vectors of each key.

    A null entry is left out of its dimension's sum, and a dimension that is null in all of a key's vectors
    is null.  Vectors of different lengths count in the dimensions they have; the sum is as long as the
    longest.  ``present`` names an optional list of the non-null entries per dimension.  ``norm`` names a column
    that entries are divided by; where it is not above 0 they count as 0.

    Vectors are cut into blocks of a few entries and the blocks summed as plain columns, which
    stays in generated code, is combined map-side, and works for any length.  Per key only the
    summed blocks are put together again.  Keys without any vector stay, with count 0 and an empty
    sum.  ``others`` are further aggregates over the rows that have a vector.
    """
    others = others or {}
    rest = [c for c in df.columns if c != vector]
    starts = F.sequence(F.lit(0), F.size(vector) - 1, F.lit(BLOCK))
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(vector, i + 1, F.lit(BLOCK)).alias("part")))
    blocks = df.select(*rest, F.explode_outer(F.when(F.size(vector) > 0, cut)).alias("__b"))
    blocks = blocks.select(*rest, F.col("__b.at").alias("__at"), F.col("__b.part").alias("__part"))
    entry = [F.get("__part", F.lit(i)).cast("double") for i in range(BLOCK)]
    if norm is not None:
        entry = [F.when(F.size("__part") > i, F.when(F.col(norm) > 0, e / F.col(norm)).otherwise(0.0)) for i, e in enumerate(entry)]
    counted = [F.count(e).alias(f"__c{i}") for i, e in enumerate(entry)] if present else []
    summed = blocks.groupBy(*keys, "__at").agg(
        F.count("__part").alias(count), F.max(F.size("__part")).alias("__width"),
        *[F.sum(e).alias(f"__s{i}") for i, e in enumerate(entry)], *counted, *[e.alias(o) for o, e in others.items()])
    filled = F.col("__at").isNotNull()

    def cells(kind: str) -> Column:
        return F.slice(F.array(*[f"__{kind}{i}" for i in range(BLOCK)]), F.lit(1), F.greatest("__width", F.lit(0)))

    lists = {"part": cells("s")} | ({"some": cells("c")} if present else {})
    packed = F.when(filled, F.struct("__at", *[c.alias(n) for n, c in lists.items()]))
    folded = summed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(packed)).alias("__parts"), F.max(count).alias(count),
        *[F.first(F.when(filled, F.col(o)), ignorenulls=True).alias(o) for o in others])
    out = [F.flatten(F.transform("__parts", field("part"))).alias(name), count, *others]
    if present:
        out.append(F.flatten(F.transform("__parts", field("some"))).alias(present))
    return folded.select(*keys, *out)


def item_vector_sums(rows: DataFrame, items: DataFrame, keys: Sequence[str], item: str, vector: str, how: str = "inner",
                     **options) -> DataFrame:
    """``vector_sums`` of the vectors that ``items`` has for the long rows (keys..., item).

    Most keys have few rows, and then sums combined before the shuffle take several times the bytes of the vectors
    themselves.  So each row is shuffled once, with its vector as the item table has it, and all sums of its key
    are made behind that shuffle.  Only keys above ``HOT_ROWS`` rows are combined map-side.
    """
    cold, heavy = split_hot(rows, keys, large_keys(rows, keys))
    met = cold.join(items, item, how).repartition(*keys)
    return vector_sums(met, keys, vector, **options).unionByName(vector_sums(heavy.join(items, item, how), keys, vector, **options))


def _mean_of_sums(sums: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return sums.select(*keys, F.zip_with("__sum", "__some", lambda x, k: F.try_divide(x, k)).alias(name))


def vector_means(df: DataFrame, keys: Sequence[str], vector: str, name: str = "mean") -> DataFrame:
    """Element-wise mean over the entries that are there; null where a dimension has none."""
    return _mean_of_sums(vector_sums(df, keys, vector, "__sum", "__n", present="__some"), keys, name)


def item_vector_means(rows: DataFrame, items: DataFrame, keys: Sequence[str], item: str, vector: str, name: str = "mean",
                      norm: str | None = None) -> DataFrame:
    """``vector_means`` over ``item_vector_sums``."""
    sums = item_vector_sums(rows, items, keys, item, vector, name="__sum", count="__n", present="__some", norm=norm)
    return _mean_of_sums(sums, keys, name)


def global_ratio(df: DataFrame, part: str, whole: str) -> Column:
    """sum(part) / sum(whole) as a scalar subquery."""
    return df.select(F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double"))).scalar()


def min_max_scale(df: DataFrame, columns: dict[str, str], to_low: float = 0.0, to_high: float = 1.0,
                  low: float | None = None, high: float | None = None) -> DataFrame:
    """Each column mapped from its own range (or the given one) onto [to_low, to_high].

    All ranges come from one aggregate row.
    """
    ends = [f(name).cast("double").alias(f"{k}{i}") for i, name in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max))]
    row = df.agg(F.struct(*ends).alias("r")).scalar() if low is None or high is None else None
    scaled = {}
    for i, (name, out) in enumerate(columns.items()):
        lo = F.lit(float(low)) if low is not None else row[f"lo{i}"]
        hi = F.lit(float(high)) if high is not None else row[f"hi{i}"]
        scaled[out] = scalars.rescale(F.col(name).cast("double"), lo, hi, to_low, to_high)
    return df.withColumns(scaled)


def max_scale(df: DataFrame, name: str, out: str) -> DataFrame:
    top = df.select(F.max(name).cast("double")).scalar()
    return df.withColumn(out, F.try_divide(F.col(name).cast("double"), top))


def softmax(df: DataFrame, score: str, out: str, temperature: float = 1.0) -> DataFrame:
    """Softmax over the whole column, shifted by its maximum.

    The maximum is read at once, so that the total is the only subquery.
    """
    top = df.agg(F.max(score)).first()[0]
    weight = F.exp((F.col(score) - F.lit(top)) / temperature)
    total = df.select(F.sum(weight)).scalar()
    return df.withColumn(out, weight / total)


def popularity_share(df: DataFrame, item: str, owner: str) -> DataFrame:
    """Occurrences of each item over the number of lists."""
    lists_total = df.select(F.count_distinct(owner).cast("double")).scalar()
    return item_counts(df, item).select(item, (F.col("n") / lists_total).alias("popularity"))


def normalized_distribution(df: DataFrame, value: str, weight: Column | None = None,
                            prior: DataFrame | None = None) -> DataFrame:
    """(value, share): 1/rows per row unless weighted; a prior distribution is added to."""
    if weight is None:
        total = df.select(F.count(F.lit(1)).cast("double")).scalar()
        shares = df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).select(value, (F.col("n") / total).alias("share"))
    else:
        shares = df.groupBy(value).agg(F.sum(weight).alias("share"))
    if prior is None:
        return shares
    return shares.unionByName(prior).groupBy(value).agg(F.sum("share").alias("share"))


def index_of_dispersion(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """k(N^2 - sum f^2) / (N^2 (k - 1)); null for a single item, 0 for a single category."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).cast("double").alias("f"))
    n, k = F.sum("f"), F.count(F.lit(1)).cast("double")
    spread = F.try_divide(k * (n * n - F.sum(F.col("f") * F.col("f"))), n * n * (k - 1))
    out = F.when(n == 1, F.lit(None).cast("double")).when(k == 1, F.lit(0.0)).otherwise(spread)
    return counts.groupBy(*keys).agg(out.alias("dispersion"))


def mean_std(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation."""
    return df.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def negative_ratio(df: DataFrame, label: str = S.LABEL) -> DataFrame:
    """Positives, negatives and negatives per positive."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"),
                  F.try_divide(neg.cast("double"), pos.cast("double")).alias("npratio"))


def history_time_range(df: DataFrame, column: str = S.HISTORY_TIMES) -> DataFrame:
    return df.agg(F.min(F.array_min(column)).alias("min_time"), F.max(F.array_max(column)).alias("max_time"))


def time_range(df: DataFrame, column: str = S.TIME) -> DataFrame:
    return df.agg(F.min(column).alias("min_time"), F.max(column).alias("max_time"))


def dense_codes(df: DataFrame, column: str, name: str, start: int = 0) -> DataFrame:
    """Sorted distinct non-null values numbered without gaps."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return global_row_number(values, [column], name, start=start)


def reciprocal_rank_scores(df: DataFrame, column: str, key: str, desc: bool = True,
                           name: str = "prediction_score") -> DataFrame:
    """1/rank by one column over the whole table; ``key`` breaks ties."""
    first = F.desc(column) if desc else F.asc(column)
    ranked = global_row_number(df, [first, F.asc(key)], "__rn")
    return ranked.withColumn(name, 1.0 / F.col("__rn").cast("double")).drop("__rn")


def describe(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).summary()
