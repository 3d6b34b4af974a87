"""Negative sampling for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.functions import lists


def sample_negatives(df: DataFrame, ratio: int, seed: int, shuffle: bool = False, replace: bool = True,
                     key: str = S.IMPRESSION, inview: str = S.INVIEW, clicked: str = S.CLICKED) -> DataFrame:
    """One row per click: ``ratio`` random unclicked in-view ids, then the click itself.

    Impressions without unclicked ids get nulls.  Randomness is a hash of (seed, impression,
    click), so the rows do not depend on the partitioning.
    """
    if ratio < 0:
        raise ValueError("ratio must not be negative")
    others = [c for c in df.columns if c not in (inview, clicked)]
    pools = df.select(*others, lists.without(inview, clicked).alias("__pool"),
                      F.posexplode_outer(clicked).alias("__slot", "__click"))
    picked = lists.sample("__pool", ratio, seed, [key, "__slot"], replace)
    rows = pools.select(
        *others, "__slot",
        F.concat(picked, F.array("__click")).alias(inview),
        F.array("__click").alias(clicked))
    if shuffle:
        rows = rows.withColumn(inview, lists.stable_shuffle(inview, seed + 1, [key, "__slot"]))
    return rows.drop("__slot").select(*df.columns)
