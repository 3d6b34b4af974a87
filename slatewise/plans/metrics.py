"""Per-impression ranking and classification metrics on one shared ranked plan.

Input is the long form (impression_id, pos, label, score).  Rows are ranked once per impression;
all metrics are sums over those ranks, so the rest is two map-side-combined aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.functions import scalars
from slatewise.operators.skew import DETECT, row_number_in_group

RANK = "rank"


def _label() -> Column:
    return F.col(S.LABEL)


def _score() -> Column:
    return F.col(S.SCORE).cast("double")


def _rank() -> Column:
    return F.col(RANK)


def _pos() -> Column:
    return F.col("__pos")


def _neg() -> Column:
    return F.col("__neg")


def _all() -> Column:
    return F.col("__rows")


@dataclass(frozen=True)
class Metric:
    """A metric as sums over ranked rows and a formula over those sums.

    ``sums`` are row expressions added up per impression, ``least`` row expressions whose minimum
    is taken; ``value`` may also use ``__pos``, ``__neg`` and ``__rows``.
    """

    name: str
    value: Column
    sums: dict[str, Column] = field(default_factory=dict)
    least: dict[str, Column] = field(default_factory=dict)
    ties: bool = False
    ideal: bool = False


def auc(ties: str = "half") -> Metric:
    """Area under the ROC curve; equal scores count one half, or nothing with ``ties='zero'``."""
    # mean rank of a run of equal scores, summed over the positives, with 1 = highest score
    wins = _pos() * (_all() + 1) - F.col("__pos_ranks") - _pos() * (_pos() + 1) / 2
    if ties == "zero":
        wins = wins - F.col("__tied_pairs") / 2
    return Metric("auc" if ties == "half" else "auc_strict", F.try_divide(wins, _pos() * _neg()), ties=True)


def mrr() -> Metric:
    """Mean of label/rank over all positives."""
    return Metric("mrr", F.try_divide(F.col("__recip"), F.col("__gain1")),
                  {"__recip": _label() / _rank(), "__gain1": _label().cast("double")})


def reciprocal_rank() -> Metric:
    """1 / rank of the first positive; 1 when there is none."""
    return Metric("reciprocal_rank", F.coalesce(1.0 / F.col("__first_hit"), F.lit(1.0)),
                  least={"__first_hit": F.when(_label() > 0, _rank())})


def _discounted(label: Column, rank: Column, k: int) -> Column:
    return F.when(rank <= k, scalars.gain(label) / F.log2(rank + 1)).otherwise(F.lit(0.0))


def dcg(k: int = 10) -> Metric:
    return Metric(f"dcg@{k}", F.col(f"__dcg{k}"), {f"__dcg{k}": _discounted(_label(), _rank(), k)})


def _binary_ideal(k: int) -> Column:
    best = F.least(F.lit(k).cast("long"), _pos().cast("long"))
    steps = F.transform(F.sequence(F.lit(1), best), lambda i: 1.0 / F.log2(i.cast("double") + 1))
    return F.when(best > 0, F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))


def ndcg(k: int = 10, graded: bool = False) -> Metric:
    """DCG over the best possible DCG; null without positives.

    0/1 labels have a closed-form ideal.  ``graded`` labels are ranked a second time by label.
    """
    sums = {f"__dcg{k}": _discounted(_label(), _rank(), k)}
    if graded:
        sums[f"__idcg{k}"] = _discounted(_label(), F.col("__ideal_rank"), k)
        ideal = F.col(f"__idcg{k}")
    else:
        ideal = _binary_ideal(k)
    return Metric(f"ndcg@{k}", F.try_divide(F.col(f"__dcg{k}"), ideal), sums, ideal=graded)


def log_loss() -> Metric:
    """Mean negative log likelihood; undefined for a single class."""
    value = F.when((_pos() > 0) & (_neg() > 0), F.col("__nll") / _all())
    return Metric("logloss", value, {"__nll": scalars.log_loss(_label(), _score())})


def rmse() -> Metric:
    gap = _label() - _score()
    return Metric("rmse", F.sqrt(F.col("__sq") / _all()), {"__sq": gap * gap})


def accuracy(threshold: float = 0.5) -> Metric:
    hit = ((_score() >= threshold).cast("int") == _label()).cast("double")
    return Metric("accuracy", F.col("__hits") / _all(), {"__hits": hit})


def f1(threshold: float = 0.5) -> Metric:
    predicted = (_score() >= threshold).cast("double")
    value = F.coalesce(F.try_divide(2 * F.col("__tp"), _pos() + F.col("__predicted")), F.lit(0.0))
    return Metric("f1", value, {"__tp": predicted * _label(), "__predicted": predicted})


def ranked(long: DataFrame, keys: Sequence[str] = (S.IMPRESSION,), hot=DETECT) -> DataFrame:
    """Rank 1 = highest score; of equal scores the later slot first, missing scores last."""
    return row_number_in_group(long, list(keys), [F.desc_nulls_last(S.SCORE), F.desc(S.POS)], RANK, hot)


def per_impression(long: DataFrame, metrics: Sequence[Metric], keys: Sequence[str] = (S.IMPRESSION,),
                   hot=DETECT, carry: Sequence[str] = ()) -> DataFrame:
    """One row per impression with a column per metric; ``carry`` columns are constant per impression."""
    for m in metrics:
        if not isinstance(m, Metric):
            raise TypeError(f"not a metric: {m!r}")
    keys = list(keys)
    rows = ranked(long.select(*keys, *carry, S.POS, S.LABEL, S.SCORE), keys, hot)
    if any(m.ideal for m in metrics):
        rows = row_number_in_group(rows, keys, [F.desc(S.LABEL), F.desc(S.POS)], "__ideal_rank", hot)
    sums = {n: e for m in metrics for n, e in m.sums.items()}
    least = {n: e for m in metrics for n, e in m.least.items()}
    base = {"__pos": F.when(_label() > 0, 1.0).otherwise(0.0), "__rows": F.lit(1.0)}
    sums = {**base, **sums}
    carried = [F.first(c).alias(c) for c in carry]
    if any(m.ties for m in metrics):
        # runs of equal scores first: their rows share one mean rank
        rows = rows.groupBy(*keys, S.SCORE).agg(
            *carried, F.min(RANK).cast("double").alias("__start"),
            *[F.sum(e).alias(n) for n, e in sums.items()], *[F.min(e).alias(n) for n, e in least.items()])
        sums = {n: F.col(n) for n in sums}
        least = {n: F.col(n) for n in least}
        sums["__pos_ranks"] = F.col("__pos") * (F.col("__start") + (F.col("__rows") - 1) / 2)
        sums["__tied_pairs"] = F.col("__pos") * (F.col("__rows") - F.col("__pos"))
    totals = rows.groupBy(*keys).agg(
        *carried, *[F.sum(e).alias(n) for n, e in sums.items()], *[F.min(e).alias(n) for n, e in least.items()])
    totals = totals.withColumn("__neg", F.col("__rows") - F.col("__pos"))
    return totals.select(*keys, *carry, *[m.value.alias(m.name) for m in metrics])


def summarize(scored: DataFrame, names: Sequence[str], keys: Sequence[str] = (),
              on_undefined: str = "skip") -> DataFrame:
    """(keys..., metric, value): mean over impressions.

    Impressions where a metric is undefined are skipped, make it null, or raise.
    """
    means = []
    for n in names:
        gaps = F.count_if(F.col(f"`{n}`").isNull()) > 0
        mean = F.avg(F.col(f"`{n}`"))
        if on_undefined == "null":
            mean = F.when(~gaps, mean)
        elif on_undefined == "error":
            mean = F.when(gaps, F.raise_error(F.lit(f"{n} is undefined for some impressions"))).otherwise(mean)
        elif on_undefined != "skip":
            raise ValueError("on_undefined must be 'skip', 'null' or 'error'")
        means.append(mean.alias(n))
    wide = scored.groupBy(*keys).agg(*means)
    return wide.unpivot(list(keys), [F.col(f"`{n}`") for n in names], "metric", "value")


def evaluate(long: DataFrame, metrics: Sequence[Metric], hot=DETECT, on_undefined: str = "skip") -> DataFrame:
    """Tidy (metric, value) over all impressions."""
    scored = per_impression(long, metrics, hot=hot)
    return summarize(scored, [m.name for m in metrics], on_undefined=on_undefined)


def python_metric(long: DataFrame, name: str, fn: Callable, key: str = S.IMPRESSION) -> DataFrame:
    """Mean of ``fn(labels, scores)`` for a user's own callable, one call per impression.

    The callable sees an impression's whole arrays; that is the interface it is written for.  A task has its
    impressions one after the other in Arrow batches and cuts them there, without a data frame for each.
    """
    if not callable(fn):
        raise TypeError(f"not callable: {fn!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, key):
            columns = [batch.column(c) for c in (S.LABEL, S.SCORE)]
            # a column with nulls becomes floating point, which only the impressions with a null should see
            arrays = [None if c.null_count else c.to_numpy(zero_copy_only=False) for c in columns]
            ends = [*_starts(batch.column(key)), batch.num_rows]
            values = [float(fn(*[c.slice(i, j - i).to_numpy(zero_copy_only=False).copy() if x is None else x[i:j].copy() for c, x in zip(columns, arrays)]))
                      for i, j in zip(ends, ends[1:])]
            # a result that is not a number is no value, as in a data frame
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64(), from_pandas=True)], ["value"])

    rows = long.select(key, S.POS, S.LABEL, S.SCORE).repartition(key).sortWithinPartitions(key, F.asc_nulls_last(S.POS))
    return rows.select(key, S.LABEL, S.SCORE).mapInArrow(run, "value double").agg(F.avg("value").alias("value")).select(F.lit(name).alias("metric"), "value")


def _starts(keys: pa.Array) -> list[int]:
    """Where a run of equal keys begins; nulls are equal."""
    if not len(keys):
        return []
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()]


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that all rows of a key, which follow each other, are in one of them."""
    held: list[pa.RecordBatch] = []  # rows of the last key so far
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch.column(key))
        same = held and held[-1].column(key)[0].as_py() == batch.column(key)[0].as_py()
        cuts = starts[1:] if same else starts
        if not cuts:
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, cuts[-1])]
        ready = [b for b in ready if b.num_rows]
        if ready:
            yield pa.concat_batches(ready)
        held = [batch.slice(cuts[-1])]
    if held:
        yield pa.concat_batches(held)


def category_coverage(long: DataFrame, categories: DataFrame, n_highest: int = 1) -> DataFrame:
    """Mean over users of the distinct (category, subcategory) pairs among each impression's top n,
    as a count and as a fraction of all pairs.  ``categories``: one row per (article, pair)."""
    from slatewise.operators.skew import top_n_in_group

    pair = F.struct("category", "subcategory")
    best = top_n_in_group(long.select(S.IMPRESSION, S.USER, S.POS, S.ARTICLE, S.SCORE), [S.IMPRESSION],
                          [F.desc_nulls_last(S.SCORE), F.asc(S.POS)], n_highest)
    seen = best.select(S.USER, S.ARTICLE).distinct().join(
        categories.select(S.ARTICLE, "category", "subcategory"), S.ARTICLE)
    # distinct pairs first: the count per user is then a plain, map-side-combined count
    per_user = seen.select(S.USER, pair.alias("pair")).distinct().groupBy(S.USER).agg(
        F.count(F.lit(1)).alias("n"))
    total = categories.select(F.count_distinct(pair).cast("double")).scalar()
    return per_user.agg(F.avg("n").alias("count"), F.avg(F.col("n") / total).alias("fraction"))


def project_report(long: DataFrame, categories: DataFrame, hot=DETECT, n_highest: int = 1) -> DataFrame:
    """AUC, MRR, NDCG@5, NDCG@10 and category coverage as (metric, value)."""
    ranking = evaluate(long, [auc(), mrr(), ndcg(5), ndcg(10)], hot)
    coverage = category_coverage(long, categories, n_highest)
    named = coverage.select(F.col("count").alias("category_coverage_count"),
                            F.col("fraction").alias("category_coverage_fraction"))
    return ranking.unionByName(named.unpivot([], ["category_coverage_count", "category_coverage_fraction"],
                                             "metric", "value"))
