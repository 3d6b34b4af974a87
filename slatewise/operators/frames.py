"""Projections, filters, set operations, splits and samples of whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise import schema as S
from slatewise.operators.skew import global_row_number, top_n_in_group

# ---- projections


def rename_present(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename the columns that exist, ignore the rest."""
    return df.withColumnsRenamed(dict(names))


def require_equal_lengths(df: DataFrame, a: str, b: str) -> DataFrame:
    """Raise unless both lists are equally long on every row."""
    if not df.filter(~F.size(a).eqNullSafe(F.size(b))).isEmpty():
        raise ValueError(f"lists {a} and {b} differ in length")
    return df


def with_row_index(df: DataFrame, order: Sequence[Column | str], name: str = "index") -> DataFrame:
    """Repeatable 0-based row id in the given unique order."""
    return global_row_number(df, order, name, start=0)


def with_known_user(df: DataFrame, known: DataFrame | Sequence[int], user: str = S.USER) -> DataFrame:
    if not isinstance(known, DataFrame):
        return df.withColumn(S.KNOWN_USER, F.coalesce(F.col(user).isin(list(known)), F.lit(False)))
    flags = known.select(F.col(user)).distinct().withColumn("__known", F.lit(True))
    joined = df.join(flags, user, "left")
    return joined.withColumn(S.KNOWN_USER, F.coalesce("__known", F.lit(False))).drop("__known")


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def glue_views(views: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Frames side by side on ``key``, each one's columns carrying its prefix."""
    glued = None
    for prefix, df in views.items():
        part = prefixed(df, prefix, keep=[key])
        glued = part if glued is None else glued.join(part, key)
    return glued


def with_dummy_lists(df: DataFrame, inview: str = S.INVIEW, labels: str = S.LABELS,
                     clicked: str = S.CLICKED) -> DataFrame:
    """Zero labels and "first in view" as the click, for rows whose truth is hidden."""
    return df.withColumns({
        labels: F.transform(inview, lambda x: F.lit(0)),
        clicked: F.array(F.try_element_at(F.col(inview), F.lit(1))),
    })


def flatten_structs(df: DataFrame, sep: str = "-") -> DataFrame:
    """Nested struct fields as flat columns named child first: ``child-parent``."""

    def walk(fields, path):
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(reversed(here)))

    return df.select(*walk(df.schema.fields, []))


# ---- filters


def min_negatives(df: DataFrame, n: int, inview: str = S.INVIEW, clicked: str = S.CLICKED) -> DataFrame:
    return df.filter(F.size(inview) - F.size(clicked) >= n)


def _active(df: DataFrame, n, column: str) -> bool:
    return column in df.columns and n is not None and n > 0


def min_value(df: DataFrame, n: float | None, column: str = S.READ_TIME) -> DataFrame:
    """Rows at or above ``n``; unchanged when the column is absent or ``n`` is not positive."""
    return df.filter(F.col(column) >= n) if _active(df, n, column) else df


def min_length(df: DataFrame, n: int | None, column: str) -> DataFrame:
    return df.filter(F.size(column) >= n) if _active(df, n, column) else df


def max_length(df: DataFrame, n: int | None, column: str) -> DataFrame:
    return df.filter(F.size(column) <= n) if _active(df, n, column) else df


def non_empty_text(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.length(column) > 0)


def null_outside(df: DataFrame, column: str, ids: DataFrame | Sequence) -> DataFrame:
    """Values not in ``ids`` become null, rows stay."""
    if not isinstance(ids, DataFrame):
        return df.withColumn(column, F.when(F.col(column).isin(list(ids)), F.col(column)))
    keep = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    joined = df.join(keep, F.col(column) == F.col("__id"), "left")
    return joined.withColumn(column, F.col("__id")).drop("__id")


def split_by_flag(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(flag)), df.filter(~F.col(flag))


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(ids.select(on), on, "left_semi")


def time_holdout(df: DataFrame, days: int = 1, time: str = S.TIME) -> tuple[DataFrame, DataFrame]:
    """(rows before, rows from) the day ``days`` before the last day of the table."""
    last = df.select(F.date_sub(F.max(F.to_date(time)), days)).scalar()
    day = F.to_date(time)
    return df.filter(day < last), df.filter(day >= last)


def shortest_lists(df: DataFrame, column: str) -> DataFrame:
    """Rows whose list is as short as the shortest one."""
    least = df.select(F.min(F.size(column))).scalar()
    return df.filter(F.size(column) == least)


def same_list_everywhere(df: DataFrame, column: str, given: Sequence | None = None) -> DataFrame:
    """One row: whether every row has the same list (``constant``), and with ``given`` whether it is that
    one (``equals_given``).  Null lists are left out; without any list both are null.

    The least and the greatest list decide, so no list is shuffled.
    """
    least, most = F.min(column), F.max(column)
    out = [(least == most).alias("constant")]
    if given is not None:
        wanted = F.array(*[F.lit(x) for x in given]).cast(df.schema[column].dataType)
        out.append(((least == wanted) & (most == wanted)).alias("equals_given"))
    return df.agg(*out)


# ---- set operations


def article_ids(df: DataFrame, page: str = S.ARTICLE, inview: str = S.INVIEW,
                clicked: str = S.CLICKED) -> DataFrame:
    """Distinct ids over the page, in-view and clicked columns, nulls left out."""
    every = F.flatten(F.array(
        F.array(F.col(page)),
        F.coalesce(F.col(inview), F.array().cast("array<long>")),
        F.coalesce(F.col(clicked), F.array().cast("array<long>")),
    ))
    # distinct within the row first, so the shuffle sees each id once per row and map task
    ids = df.select(F.explode(F.array_distinct(F.array_compact(every))).alias(S.ARTICLE))
    return ids.distinct()


def concat_named(frames: Mapping[str, DataFrame], name: str = "name") -> DataFrame:
    """Union by column name, absent columns null, each row labelled with its frame."""
    out = None
    for label, df in frames.items():
        part = df.withColumn(name, F.lit(label))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ---- order, split, sample (all by hash of a stable key, so a rerun gives the same rows)


def hash_order(seed: int, *keys: str) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *keys), *[F.col(k) for k in keys]]


def shuffle_rows(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    return df.orderBy(*hash_order(seed, *keys))


def sample_exact(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Exactly floor(fraction * rows) rows in hash order."""
    numbered = global_row_number(df, hash_order(seed, *keys), "__rn")
    limit = numbered.select(F.floor(F.count(F.lit(1)) * fraction)).scalar()
    return numbered.filter(F.col("__rn") <= limit).drop("__rn")


def split_fraction(df: DataFrame, fraction: float, seed: int, *keys: str,
                   shuffle: bool = True) -> tuple[DataFrame, DataFrame]:
    """First floor(fraction * rows) rows and the rest, in hash or key order."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie strictly between 0 and 1")
    order = hash_order(seed, *keys) if shuffle else [F.col(k) for k in keys]
    numbered = global_row_number(df, order, "__rn")
    limit = numbered.select(F.floor(F.count(F.lit(1)) * fraction)).scalar()
    head = numbered.filter(F.col("__rn") <= limit).drop("__rn")
    return head, numbered.filter(F.col("__rn") > limit).drop("__rn")


def with_chunk(df: DataFrame, n_chunks: int, *keys: str, name: str = "chunk") -> DataFrame:
    """Chunks of floor(rows / n) rows in key order, the remainder in the last one."""
    numbered = global_row_number(df, list(keys), "__rn", start=0)
    size = numbered.select(F.floor(F.count(F.lit(1)) / n_chunks)).scalar()
    chunk = F.least(F.floor(F.try_divide(F.col("__rn"), size)), F.lit(n_chunks - 1))
    return numbered.withColumn(name, F.coalesce(chunk, F.lit(n_chunks - 1)).cast("long")).drop("__rn")


def with_split(df: DataFrame, n_splits: int, *keys: str, name: str = "split") -> DataFrame:
    """Splits of ceil(rows / n) rows in key order, the last one short."""
    numbered = global_row_number(df, list(keys), "__rn", start=0)
    size = numbered.select(F.ceil(F.count(F.lit(1)) / n_splits)).scalar()
    return numbered.withColumn(name, F.floor(F.col("__rn") / size).cast("long")).drop("__rn")


def with_batch(df: DataFrame, size: int, *keys: str, name: str = "batch") -> DataFrame:
    """Batches of ``size`` rows in key order."""
    numbered = global_row_number(df, list(keys), "__rn", start=0)
    return numbered.withColumn(name, F.floor(F.col("__rn") / size).cast("long")).drop("__rn")


def sample_per_user(df: DataFrame, n: int, seed: int, *keys: str, user: str = S.USER) -> DataFrame:
    """At most ``n`` random rows per user."""
    return top_n_in_group(df, [user], hash_order(seed, *keys), n, "__rank").drop("__rank")


def top_slice(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """The ``n`` highest rows by one column, ``key`` breaking ties (each task keeps only n rows)."""
    return df.orderBy(F.desc_nulls_last(column), F.asc(key)).limit(n)


def softmax_sample(df: DataFrame, n: int, seed: int, score: str, key: str, temperature: float = 1.0) -> DataFrame:
    """``n`` rows without replacement, inclusion weighted by softmax(score / T) (Gumbel top-k)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    noise = F.col(score) / temperature - F.ln(-F.ln(u))
    return df.withColumn("__g", noise).orderBy(F.desc("__g"), key).limit(n).drop("__g")


def column_shape(df: DataFrame, observation, label: str = "rows") -> DataFrame:
    """Count rows passing through a step while another action runs."""
    return df.observe(observation, F.count(F.lit(1)).alias(label))


