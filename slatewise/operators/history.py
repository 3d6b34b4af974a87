"""Reading histories: the previous items of a user, rolling or before a cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise import schema as S
from slatewise.functions import lists
from slatewise.operators.skew import (
    DETECT,
    hot_keys,
    row_number_in_group,
    split_hot,
    top_n_in_group,
)

SPAN = 100_000  # rows of a hot user handled by one task in the rolling history


def dynamic_history(df: DataFrame, size: int, order: Sequence[str], user: str = S.USER,
                    item: str = S.ARTICLE, name: str = "history_dynamic", hot=DETECT,
                    span: int = SPAN) -> DataFrame:
    """Items of the user's previous ``size`` rows, oldest first, nulls dropped after framing.

    ``order`` must be unique within a user.  A hot user's rows are cut into spans; each span also
    receives the last ``size`` rows of the span before it, so no frame is incomplete.
    """
    if hot is DETECT:
        hot = hot_keys(df, [user])
    frame = W.partitionBy(user).orderBy(*order).rowsBetween(-size, -1)
    plain = F.collect_list(item).over(frame)
    if hot is None:
        return df.withColumn(name, plain)
    cold, heavy = split_hot(df, [user], hot)
    span = max(span, size)
    numbered = row_number_in_group(heavy, [user], order, "__seq", hot=hot)
    zero = F.col("__seq") - 1
    own = F.struct(F.floor(zero / span).alias("id"), F.lit(False).alias("context"))
    carried = F.struct((F.floor(zero / span) + 1).alias("id"), F.lit(True).alias("context"))
    copies = F.when(F.pmod(zero, F.lit(span)) >= span - size, F.array(own, carried)).otherwise(F.array(own))
    spread = numbered.withColumn("__copy", F.explode(copies))
    spread = spread.select("*", F.col("__copy.id").alias("__span"), F.col("__copy.context").alias("__context"))
    framed = F.collect_list(item).over(
        W.partitionBy(user, "__span").orderBy("__seq").rowsBetween(-size, -1))
    filled = spread.withColumn(name, framed).filter(~F.col("__context")).select(*df.columns, name)
    return cold.withColumn(name, plain).unionByName(filled)


def history_rows(df: DataFrame, cutoff: Column, size: int, order: Sequence[str], user: str = S.USER,
                 time: str = S.TIME) -> DataFrame:
    """The last ``size`` rows of each user before the cutoff, ``rank`` 1 = latest."""
    before = df.filter(F.col(time) < cutoff)
    return top_n_in_group(before, [user], [F.desc(c) for c in order], size)


def fixed_histories(df: DataFrame, cutoff: Column, order: Sequence[str], columns: Sequence[str],
                    size: int | None = None, user: str = S.USER, time: str = S.TIME,
                    suffix: str = "_fixed") -> DataFrame:
    """One row per user with parallel lists of ``columns`` before the cutoff, oldest first.

    With ``size`` only that many rows per user reach the shuffle; without it a user's whole history is
    one cell.  ``history_rows`` gives the same in long form.
    """
    before = df.filter(F.col(time) < cutoff)
    rows = before if size is None else top_n_in_group(before, [user], [F.desc(c) for c in order], size)
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    folded = rows.groupBy(user).agg(F.array_sort(F.collect_list(packed)).alias("__rows"))
    return folded.select(user, *[
        F.transform("__rows", lists.field(f"c{i}")).alias(c + suffix) for i, c in enumerate(columns)])


def with_fixed_history(df: DataFrame, cutoff: Column, order: Sequence[str], size: int | None = None,
                       user: str = S.USER, item: str = S.ARTICLE, time: str = S.TIME) -> DataFrame:
    """Every row with its user's items before the cutoff; null where there are none."""
    items = fixed_histories(df.filter(F.col(item).isNotNull()), cutoff, order, [item], size, user, time)
    return df.join(items, user, "left")


def with_fixed_columns(df: DataFrame, cutoff: Column, order: Sequence[str], columns: Sequence[str],
                       size: int | None = None, user: str = S.USER, time: str = S.TIME) -> DataFrame:
    """The same for several columns at once, nulls inside the lists kept."""
    return df.join(fixed_histories(df, cutoff, order, columns, size, user, time), user, "left")
