"""Scoring in chunks: a run that broke off is taken up where it stopped."""

import pytest
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.sources import chunks as C


def candidates(spark):
    return spark.range(200).select((F.col("id") % 40).alias(S.IMPRESSION), F.col("id").alias(S.ARTICLE))


def scored(df):
    return df.withColumn(S.SCORE, F.col(S.ARTICLE) / 200)


def rows(df):
    return sorted(map(tuple, df.select(S.IMPRESSION, S.ARTICLE, S.SCORE).collect()))


def test_a_broken_run_is_taken_up(spark, tmp_path):
    folder, seen = str(tmp_path / "scores"), []

    def breaks(df):
        seen.append(df.count())
        if len(seen) == 4:
            # some rows are written before a task fails
            return scored(df).withColumn(S.SCORE, F.when(F.col(S.ARTICLE) >= 0, F.raise_error("lost")).cast("double"))
        return scored(df)

    with pytest.raises(Exception, match="lost"):
        C.score_chunks(candidates(spark), folder, "m", breaks, 10)
    assert len(seen) == 4 and C.read_scores(spark, folder, "m").select("chunk").distinct().count() <= 3
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "scores" / "model=m").rglob("*.parquet")}
    assert C.score_chunks(candidates(spark), folder, "m", scored, 10) == 7
    assert all(p.stat().st_mtime_ns == t for p, t in times.items())  # what was finished was not written again
    assert rows(C.read_scores(spark, folder, "m")) == rows(scored(candidates(spark)))
    assert C.score_chunks(candidates(spark), folder, "m", breaks, 10) == 0 and len(seen) == 4
    per = C.read_scores(spark, folder, "m").groupBy(S.IMPRESSION).agg(F.count_distinct("chunk").alias("n"))
    assert per.filter("n > 1").count() == 0


def test_models_share_the_candidates(spark, tmp_path):
    folder = str(tmp_path / "scores")
    C.score_chunks(candidates(spark), folder, "a", scored, 3)
    C.score_chunks(candidates(spark), folder, "b", lambda df: scored(df).withColumn(S.SCORE, -F.col(S.SCORE)), 3)
    both = C.read_scores(spark, folder, "a", "b").groupBy(S.IMPRESSION, S.ARTICLE).agg(F.sum(S.SCORE).alias(S.SCORE), F.count("*").alias("n"))
    assert both.count() == 200 and both.filter("n <> 2 or abs(score) > 1e-12").count() == 0


def test_a_chunk_reads_its_own_rows_only(spark, tmp_path):
    plans = []

    def score(df):
        plans.append(df._jdf.queryExecution().toString())
        return scored(df)

    C.score_chunks(candidates(spark), str(tmp_path / "scores"), "m", score, 2)
    assert all("PartitionFilters: [isnotnull(chunk" in p for p in plans) and len(plans) == 2
