"""Hot keys: the split plans give exactly the rows of the plain ones."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise.operators import history as H
from slatewise.operators import skew
from slatewise.plans import metrics as M
from slatewise.sources.star import Star


@pytest.fixture(scope="module")
def events(spark):
    # user 7 holds a third of the rows, null is a key too
    n = 3_000
    df = spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("user_id"),
        (F.xxhash64("id") % 10).alias("t"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("article_id"))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hot_keys_are_few_and_right(events):
    hot = skew.hot_keys(events, ["user_id"], min_rows=500)
    assert [r[0] for r in hot.collect()] == [7]
    assert skew.hot_keys(events, ["user_id"], min_rows=5_000) is None
    assert skew.hot_keys(events.limit(0), ["user_id"], min_rows=0) is None


def test_split_keeps_every_row(events):
    hot = skew.hot_keys(events, ["user_id"], min_rows=500)
    cold, heavy = skew.split_hot(events, ["user_id"], hot)
    assert cold.count() + heavy.count() == events.count()
    assert heavy.select("user_id").distinct().count() == 1


def test_null_can_be_hot(spark):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"), "id")
    hot = skew.hot_keys(df, ["k"], min_rows=50)
    assert hot.collect()[0][0] is None
    ranked = skew.row_number_in_group(df, ["k"], ["id"], "rn", hot)
    plain = df.withColumn("rn", F.row_number().over(W.partitionBy("k").orderBy("id")).cast("long"))
    assert rows(ranked) == rows(plain)


def test_row_number_in_group(events):
    hot = skew.hot_keys(events, ["user_id"], min_rows=500)
    order = [F.desc("t"), F.asc("id")]
    got = skew.row_number_in_group(events, ["user_id"], order, "rn", hot)
    want = events.withColumn("rn", F.row_number().over(W.partitionBy("user_id").orderBy(*order)).cast("long"))
    assert rows(got) == rows(want)


def test_global_row_number(events):
    order = [F.asc_nulls_last("user_id"), F.desc("t"), F.asc("id")]
    got = skew.global_row_number(events, order, "rn", start=0)
    want = events.withColumn("rn", (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    assert rows(got) == rows(want)
    assert got.columns == [*events.columns, "rn"]


def test_dynamic_history_with_hot_user(events):
    hot = skew.hot_keys(events, ["user_id"], min_rows=500)
    for span in (5, 64, 10_000):
        got = H.dynamic_history(events, 5, ["t", "id"], hot=hot, span=span)
        want = H.dynamic_history(events, 5, ["t", "id"], hot=None)
        assert rows(got) == rows(want)


def test_metrics_with_hot_impression(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("impression_id"), F.col("id").alias("pos"),
        (F.xxhash64("id") % 3 == 0).cast("int").alias("label"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(25)) / 25.0).alias("score"))
    hot = skew.hot_keys(df, ["impression_id"], min_rows=100)
    assert hot.count() == 1
    all_metrics = [M.auc(), M.auc("zero"), M.mrr(), M.ndcg(5), M.ndcg(10), M.reciprocal_rank()]
    got, want = M.per_impression(df, all_metrics, hot=hot), M.per_impression(df, all_metrics, hot=None)
    for g, w in zip(sorted(got.collect()), sorted(want.collect())):
        assert g["impression_id"] == w["impression_id"]
        assert list(g)[1:] == pytest.approx(list(w)[1:])


def test_candidates_with_hot_orders(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    want, lists = rows(Star(spark, folder).candidates()), rows(Star(spark, folder).behaviors())
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    few = lines.groupBy("l_orderkey").count().orderBy(F.desc("count"), "l_orderkey").limit(20)
    hot = few.select(F.col("l_orderkey").alias("impression_id"))
    star = Star(spark, folder)
    star._hot["lineitem"] = hot
    assert rows(star.candidates()) == want and rows(star.behaviors()) == lists


def test_large_top_n_is_trimmed_before_the_shuffle(events):
    best = skew.top_n_in_group(events, ["user_id"], ["t", "id"], 2_000)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and best.groupBy("user_id").count().agg(F.max("count")).first()[0] <= 2_000


def test_results_do_not_depend_on_partitioning(spark, events):
    from slatewise.operators import frames as P

    a = P.sample_exact(events.repartition(3), 0.3, 5, "id")
    b = P.sample_exact(events.repartition(9, "t"), 0.3, 5, "id")
    assert rows(a) == rows(b) and a.count() == 900
    a = P.sample_per_user(events.repartition(3), 2, 5, "id")
    b = P.sample_per_user(events.repartition(9, "t"), 2, 5, "id")
    assert rows(a) == rows(b)


def test_group_values_with_hot_key(events):
    hot = skew.hot_keys(events, ["user_id"], min_rows=500)
    values = {"top": F.max("t"), "total": F.sum("id")}
    got = skew.with_group_values(events, ["user_id"], values, hot)
    want = skew.with_group_values(events, ["user_id"], values, None)
    assert rows(got) == rows(want)


def test_tasks_of_lines_grow_with_the_lines(spark, monkeypatch):
    # adaptive execution merged the shuffled lines to a few tasks, whose memory grew with the table
    monkeypatch.setattr(skew, "TASK_ROWS", 200)
    star = Star(spark, "/root/testdata/sf0.001")
    lines = star.table("lineitem").count()
    assert star.slotless().rdd.getNumPartitions() == -(-lines // 200)
    assert star.candidates().rdd.getNumPartitions() == -(-lines // 200)
    assert skew.tasks_for(spark, 1) == spark.sparkContext.defaultParallelism


def test_own_metric_sees_each_impression_once_and_whole(spark):
    # one data frame for each impression took hours on millions of them
    data = [(k, p, (k * p) % 2, None if (k, p) == (3, 1) else p / 10) for k in range(40) for p in range(k % 9)] + [(None, 0, 1, 0.5), (None, 1, 0, 0.1)]
    long = spark.createDataFrame(data, "impression_id long, pos long, label int, score double").repartition(5)

    def own(labels, scores):
        assert labels.dtype.kind == "i" and len(labels) == len(scores)
        return float("nan") if (scores != scores).any() else labels.sum() * 100 + len(labels)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        value = M.python_metric(long, "own", own).first()["value"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for k, p, label, score in data:
        groups.setdefault(k, []).append((label, score))
    want = [sum(x for x, _ in g) * 100 + len(g) for g in groups.values() if all(s is not None for _, s in g)]
    assert value == pytest.approx(sum(want) / len(want))
    plan = M.python_metric(long, "own", own)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
