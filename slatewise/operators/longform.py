"""Moving between list columns and the long form (impression, pos, article, label, score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.functions import lists


def with_click_labels(df: DataFrame, inview: str = S.INVIEW, clicked: str = S.CLICKED,
                      labels: str = S.LABELS, shuffle_seed: int | None = None,
                      key: Sequence[str] = (S.IMPRESSION,)) -> DataFrame:
    """Binary labels aligned with the in-view list, which may be shuffled first."""
    if shuffle_seed is not None:
        df = df.withColumn(inview, lists.stable_shuffle(inview, shuffle_seed, key))
    return df.withColumn(labels, lists.click_labels(inview, clicked))


def explode_lists(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None,
                  pos: str = S.POS, keep_empty: bool = False) -> DataFrame:
    """One row per list position, aligned lists side by side, ``pos`` from 0."""
    names = list(names or columns)
    others = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    step = F.posexplode_outer(zipped) if keep_empty else F.posexplode(zipped)
    exploded = df.select(*others, step.alias(pos, "__item"))
    return exploded.select(*others, F.col(pos).cast("long").alias(pos),
                           *[F.col(f"__item.{n}").alias(n) for n in names])


def to_long(behaviors: DataFrame, extra: Sequence[str] = (), inview: str = S.INVIEW,
            clicked: str = S.CLICKED) -> DataFrame:
    """(impression, user, extra..., pos, article, label); the clicked list does not travel along."""
    labelled = behaviors.select(S.IMPRESSION, S.USER, *extra, F.col(inview),
                                lists.click_labels(inview, clicked).alias(S.LABEL))
    return explode_lists(labelled, [inview, S.LABEL], [S.ARTICLE, S.LABEL])


def to_lists(df: DataFrame, keys: Sequence[str], columns: dict[str, str], pos: str = S.POS) -> DataFrame:
    """Fold long rows back to aligned lists in ``pos`` order; ``columns`` maps column to list name.

    A list is one cell, built in one task.  For keys of any size use ``to_list_segments``.
    """
    packed = F.struct(pos, *columns)
    folded = df.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("__rows"))
    return folded.select(*keys, *[
        F.transform("__rows", lists.field(c)).alias(name) for c, name in columns.items()])


def to_list_segments(df: DataFrame, keys: Sequence[str], columns: dict[str, str], pos: str = S.POS,
                     size: int = 10_000) -> DataFrame:
    """(keys..., segment, lists...): the same lists in pieces of ``size`` positions, segment = pos div size.

    ``pos`` counts from 0 without gaps.  No cell holds more than ``size`` entries and a long list is spread
    over as many groups; laid end to end by segment, the pieces are the list.
    """
    cut = df.withColumn("segment", F.floor(F.col(pos) / size).cast("long"))
    return to_lists(cut, [*keys, "segment"], columns, pos)


def attach_scores(candidates: DataFrame, scores: DataFrame, on: Sequence[str] = (S.USER, S.ARTICLE),
                  fill: float | None = 0.0) -> DataFrame:
    """Candidates with the score of their key, which must be unique; missing scores get ``fill``."""
    joined = candidates.join(scores.select(*on, S.SCORE), list(on), "left")
    return joined if fill is None else joined.withColumn(S.SCORE, F.coalesce(S.SCORE, F.lit(fill)))


LABELED = {S.LABEL: "clicked_labels", S.SCORE: "predicted_score"}


def labeled_lists(long: DataFrame) -> DataFrame:
    """(impression_id, clicked_labels, predicted_score) in candidate order."""
    return to_lists(long, [S.IMPRESSION], LABELED)


def labeled_segments(long: DataFrame, size: int = 10_000) -> DataFrame:
    """(impression_id, segment, clicked_labels, predicted_score), each at most ``size`` long."""
    return to_list_segments(long, [S.IMPRESSION], LABELED, size=size)


def attach_flat_scores(behaviors: DataFrame, scores: DataFrame, name: str = "scores") -> DataFrame:
    """Impressions with a list of externally computed (impression_id, pos, score) rows."""
    return behaviors.join(to_lists(scores, [S.IMPRESSION], {S.SCORE: name}), S.IMPRESSION, "left")


def attach_score_segments(behaviors: DataFrame, scores: DataFrame, name: str = "scores", size: int = 10_000) -> DataFrame:
    """The same in pieces: a row per impression and segment, one with a null segment where there are no scores."""
    return behaviors.join(to_list_segments(scores, [S.IMPRESSION], {S.SCORE: name}, size=size), S.IMPRESSION, "left")
