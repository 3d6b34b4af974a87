"""Worked examples with known results."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.functions import lists, scalars, vectors
from slatewise.operators import aggregates as A
from slatewise.operators import frames as P
from slatewise.operators import history as H
from slatewise.operators import longform as L
from slatewise.operators import lookup as K
from slatewise.operators.sampling import sample_negatives
from slatewise.plans import beyond_accuracy as B
from slatewise.plans import ensemble
from slatewise.plans import metrics as M

CLICKS = "impression_id bigint, article_ids_inview array<bigint>, article_ids_clicked array<bigint>"


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("x")).first()["x"]


# ---- lists


def test_click_labels(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [2, 3, 4]), (2, [4, 5, 6], [3, 5]), (3, [7, 8], None)], CLICKS)
    got = {r[0]: r[1] for r in L.with_click_labels(df).select(S.IMPRESSION, S.LABELS).collect()}
    assert got == {1: [0, 1, 1], 2: [0, 1, 0], 3: [0, 0]}


def test_labels_survive_a_shuffle(spark):
    df = spark.createDataFrame([(i, list(range(i, i + 9)), [i + 2, i + 5]) for i in range(20)], CLICKS)
    moved = L.with_click_labels(df, shuffle_seed=4).collect()
    assert all(sorted(r[S.INVIEW]) == list(range(r[0], r[0] + 9)) for r in moved)
    assert any(r[S.INVIEW] != sorted(r[S.INVIEW]) for r in moved)
    assert all([int(x in r[S.CLICKED]) for x in r[S.INVIEW]] == r[S.LABELS] for r in moved)


def test_remove_clicked(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1, 2]), (2, [1, 2, 3], [1]), (3, [1, 2, 3], [3])], CLICKS)
    got = {r[0]: r[1] for r in df.select(S.IMPRESSION, lists.without(S.INVIEW, S.CLICKED)).collect()}
    assert got == {1: [3], 2: [2, 3], 3: [1, 2]}


def test_minimum_negatives(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [1]), (2, [1], [1]), (3, [1, 2, 3], [1, 2])], CLICKS)
    assert {r[0] for r in P.min_negatives(df, 1).collect()} == {1, 3}
    assert {r[0] for r in P.min_negatives(df, 2).collect()} == {1}


def test_truncate(spark):
    for value, plain, padded in ((["a", "b", "c"], ["a", "b", "c"], ["a", "b", "c"]),
                                 (["d", "e", "f", "g"], ["e", "f", "g"], ["e", "f", "g"]),
                                 (["h", "i"], ["h", "i"], ["-", "h", "i"]), ([], [], ["-", "-", "-"]), (None, None, None)):
        assert one(spark, value, "array<string>", lists.truncate("v", 3)) == plain
        assert one(spark, value, "array<string>", lists.truncate("v", 3, F.lit("-"))) == padded


def test_ranks(spark):
    for scores, ranks in (([.2, .1, .3], [2, 3, 1]), ([.1, .2], [2, 1]), ([.4, .2, .1, .3], [1, 3, 4, 2]),
                          ([.5, .5], [2, 1]), ([], [])):
        assert one(spark, scores, "array<double>", lists.rank_by_score("v")) == ranks


def test_list_cleaning(spark):
    assert one(spark, [1, None, 2], "array<int>", lists.drop_nulls("v")) == [1, 2]
    assert one(spark, None, "array<int>", lists.drop_nulls("v")) is None
    assert one(spark, [3, 1, 3], "array<int>", lists.distinct_sorted("v")) == [1, 3]
    ids = F.array(F.lit(1), F.lit(3))
    assert one(spark, [1, 2, 3], "array<int>", lists.keep_in("v", ids)) == [1, 3]
    assert one(spark, [2], "array<int>", lists.keep_in("v", ids)) is None
    assert one(spark, [0, 0, 1, 1, 0, 0], "array<int>", lists.chunks("v", 3)) == [[0, 0, 1], [1, 0, 0]]
    assert one(spark, [1, 2, 3], "array<int>", lists.chunks("v", 2)) == [[1, 2], [3]]
    assert one(spark, [], "array<int>", lists.chunks("v", 2)) == []
    assert one(spark, [.5, .4], "array<double>", lists.threshold("v")) == [1, 0]
    assert one(spark, [1.0, None, 3.0], "array<double>", lists.mean("v")) == 2.0
    assert one(spark, [], "array<double>", lists.mean("v")) is None


def test_map_values(spark):
    table = F.create_map(F.lit(1).cast("long"), F.lit("a"), F.lit(2).cast("long"), F.lit("b"))
    long_list = "array<bigint>"
    assert one(spark, [1, 9, 2], long_list, lists.map_values("v", table)) == ["a", None, "b"]
    assert one(spark, [1, 9], long_list, lists.map_values("v", table, F.lit("?"))) == ["a", "?"]
    assert one(spark, None, long_list, lists.map_values("v", table)) == [None]
    assert one(spark, None, long_list, lists.map_values("v", table, F.lit("?"))) == ["?"]
    assert one(spark, [1, 9], long_list, lists.map_values("v", table, drop_unknown=True)) == ["a"]
    assert one(spark, None, long_list, lists.map_values("v", table, drop_unknown=True)) is None


def test_map_list_through_table(spark):
    df = spark.createDataFrame([(1, [1, 9, 2]), (2, None), (3, []), (4, [9])], "impression_id bigint, ids array<bigint>")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "article_id bigint, value string")

    def run(**kw):
        return {r[0]: r["ids"] for r in K.map_list(df, [S.IMPRESSION], "ids", table, S.ARTICLE, "value", **kw).collect()}

    assert run() == {1: ["a", None, "b"], 2: [None], 3: [], 4: [None]}
    assert run(fill=F.lit("?")) == {1: ["a", "?", "b"], 2: ["?"], 3: [], 4: ["?"]}
    assert run(drop_unknown=True) == {1: ["a", "b"], 2: None, 3: None, 4: None}


def test_decay(spark):
    n = F.size("v")
    five = [0] * 5
    assert one(spark, five, "array<int>", lists.linear_decay(n)) == pytest.approx([.2, .4, .6, .8, 1])
    assert one(spark, five, "array<int>", lists.exponential_decay(.5)(n)) == pytest.approx([.0625, .125, .25, .5, 1])
    assert one(spark, five, "array<int>", lists.linear_decay(n, ascending=False)) == pytest.approx([1, .8, .6, .4, .2])
    assert one(spark, None, "array<int>", lists.decay_weights("v")) == []
    nested = spark.createDataFrame([([[1.0, 2.0], None], [0.5, 1.0])], "v array<array<double>>, w array<double>")
    assert nested.select(lists.weight_nested("v", "w")).first()[0] == [[0.5, 1.0], [None]]
    assert nested.select(lists.weight_nested("v", "w", fill=0.0)).first()[0] == [[0.5, 1.0], [0.0]]


def test_sampling_from_lists(spark):
    df = spark.createDataFrame([(i, list(range(6))) for i in range(50)] + [(99, [])], "k bigint, v array<bigint>")
    without = df.select("k", lists.sample("v", 4, 1, ["k"]).alias("s")).collect()
    assert all(len(set(r["s"])) == 4 for r in without if r["k"] != 99)
    assert [r["s"] for r in without if r["k"] == 99] == [[None] * 4]
    assert len({tuple(r["s"]) for r in without}) > 10
    again = df.repartition(5).select("k", lists.sample("v", 4, 1, ["k"]).alias("s")).collect()
    assert sorted(without) == sorted(again)
    with pytest.raises(Exception, match="sample size"):
        df.select(lists.sample("v", 7, 1, ["k"])).collect()
    assert all(len(r[0]) == 9 for r in df.select(lists.sample("v", 9, 1, ["k"], replace=True)).collect())


def test_negative_sampling(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3], [1, 2]), (1, 1, [1, 2, 3, 4], [1, 3]), (2, 2, [1, 2, 3], [1]), (3, 3, [1], [1])],
                               "impression_id bigint, user_id bigint, article_ids_inview array<bigint>, article_ids_clicked array<bigint>")
    for ratio in (1, 2):
        rows = sample_negatives(df, ratio, 5).collect()
        assert len(rows) == 6
        assert all(len(r[S.INVIEW]) == ratio + 1 and r[S.INVIEW][-1:] == r[S.CLICKED] for r in rows)
        assert [r[S.INVIEW] for r in rows if r[0] == 3] == [[None] * ratio + [1]]
    mixed = sample_negatives(df, 2, 5, shuffle=True).collect()
    assert all(set(r[S.CLICKED]) <= set(r[S.INVIEW]) for r in mixed)
    with pytest.raises(ValueError):
        sample_negatives(df, -1, 5)


# ---- frames


def test_columns_and_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert P.rename_present(df, {"a": "x", "z": "y"}).columns == ["x", "b"]
    with pytest.raises(ValueError, match="c, d"):
        S.require_columns(df, ["d", "a", "c"])
    assert S.fresh_name(["x", "x_1"], "x") == "x_2" and S.fresh_name(["y"], "x") == "x"
    same = spark.createDataFrame([([1], [2])], "a array<int>, b array<int>")
    assert P.require_equal_lengths(same, "a", "b") is same
    with pytest.raises(ValueError):
        P.require_equal_lengths(spark.createDataFrame([([1], [2, 3])], "a array<int>, b array<int>"), "a", "b")
    assert S.is_list_column(same, "a") and not S.is_list_column(df, "a")


def test_filters_with_guards(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, [])], "id int, v array<int>")
    assert P.min_length(df, 2, "v").count() == 1 and P.max_length(df, 1, "v").count() == 2
    for n in (None, 0, -1):
        assert P.min_length(df, n, "v") is df and P.min_value(df, n, "id") is df
    assert P.min_length(df, 2, "absent") is df
    kept = P.null_outside(df, "id", [1, 3]).collect()
    assert sorted((r["id"] is None, r["id"]) for r in kept) == [(False, 1), (False, 3), (True, None)]


def test_known_users(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "user_id bigint")
    for known in ([2, 4], spark.createDataFrame([(2,), (4,), (4,)], "user_id bigint")):
        got = {r[0]: r[1] for r in P.with_known_user(df, known).collect()}
        assert got == {1: False, 2: True, 3: False, 4: True}


def test_article_ids(spark):
    df = spark.createDataFrame([(1, [2, 3], None), (None, [1], [4])], "article_id bigint, article_ids_inview array<bigint>, article_ids_clicked array<bigint>")
    assert {r[0] for r in P.article_ids(df).collect()} == {1, 2, 3, 4}


def test_chunks_and_splits(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    assert [r["chunk"] for r in P.with_chunk(df, 3, "k").orderBy("k").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert [r["split"] for r in P.with_split(df, 3, "k").orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert [r["batch"] for r in P.with_batch(df, 3, "k").orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2]
    three = spark.range(3).withColumnRenamed("id", "k")
    assert [r["chunk"] for r in P.with_chunk(three, 2, "k").orderBy("k").collect()] == [0, 1, 1]
    head, rest = P.split_fraction(df, 0.5, 1, "k")
    assert head.count() == 3 and rest.count() == 4 and head.intersect(rest).count() == 0
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            P.split_fraction(df, bad, 1, "k")


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2,)),)], "p struct<a:int,q:struct<b:int>>")
    assert P.flatten_structs(df).columns == ["a-p", "b-q-p"]


# ---- histories


def day(d):
    return dt.datetime(2023, 2, d)


@pytest.fixture(scope="module")
def visits(spark):
    rows = [(0, 0, 9604210, day(18), 1.0), (1, 0, 9634540, day(18), 2.0), (2, 0, 9640420, day(25), None), (3, 1, 9647983, day(22), 4.0),
            (4, 1, 9647984, day(21), 5.0), (5, 1, 9647981, day(23), 6.0), (6, 0, None, day(19), 7.0), (7, 2, None, day(26), 8.0)]
    return spark.createDataFrame(rows, "row bigint, user_id bigint, article_id bigint, impression_time timestamp_ntz, read_time double")


def test_dynamic_history(visits):
    got = {r["row"]: r["history_dynamic"] for r in H.dynamic_history(visits, 3, [S.TIME, "row"]).collect()}
    assert got == {0: [], 1: [9604210], 6: [9604210, 9634540], 2: [9604210, 9634540], 4: [], 3: [9647984],
                   5: [9647984, 9647983], 7: []}


def test_fixed_history(visits):
    cut = F.lit("2023-02-24").cast("timestamp_ntz")
    whole = {r["row"]: r[S.HISTORY_ARTICLES] for r in H.with_fixed_history(visits, cut, [S.TIME, "row"]).collect()}
    assert whole[0] == [9604210, 9634540] and whole[5] == [9647984, 9647983, 9647981] and whole[7] is None
    last = {r["row"]: r[S.HISTORY_ARTICLES] for r in H.with_fixed_history(visits, cut, [S.TIME, "row"], 1).collect()}
    assert last[2] == [9634540] and last[3] == [9647981] and last[7] is None
    both = {r["row"]: r for r in H.with_fixed_columns(visits, cut, [S.TIME, "row"], [S.ARTICLE, S.READ_TIME]).collect()}
    assert both[0][S.HISTORY_ARTICLES] == [9604210, 9634540, None] and both[0][S.HISTORY_READ_TIMES] == [1.0, 2.0, 7.0]


# ---- aggregates


def test_quantiles_and_distributions(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 1, 1, 9, 3, 3, 3, 8, 2, 2])], "id int, n bigint")
    order = sorted([5, 1, 1, 9, 3, 3, 3, 8, 2, 2])
    for q in (0.0, 0.1, 0.35, 0.5, 0.9, 1.0):
        got = spark.range(1).select(A.nearest_quantile(df, "n", q)).first()[0]
        assert got == order[math.floor(q * 9 + 0.5)]
    rows = spark.createDataFrame([("u1", i) for i in ("1", "2", "3")] + [("u2", "1"), ("u2", "3"), ("u3", "1"), ("u3", "4")], "u string, item string")
    shares = {r[0]: r[1] for r in A.popularity_share(rows, "item", "u").collect()}
    assert shares == pytest.approx({"1": 1.0, "2": 1 / 3, "3": 2 / 3, "4": 1 / 3})
    letters = spark.createDataFrame([(c,) for c in "abcc"], "value string")
    dist = A.normalized_distribution(letters, "value")
    assert {r[0]: r[1] for r in dist.collect()} == {"a": .25, "b": .25, "c": .5}
    assert {r[0]: r[1] for r in A.normalized_distribution(letters, "value", prior=dist).collect()} == {"a": .5, "b": .5, "c": 1.0}
    subjects = [("m", 25), ("e", 42), ("c", 13), ("p", 8), ("r", 13)]
    flat = spark.createDataFrame([(s,) for s, k in subjects for _ in range(k)], "x string")
    assert A.index_of_dispersion(flat, "x").first()[0] == pytest.approx(0.9079992157631604)
    assert A.index_of_dispersion(flat.filter("x = 'm'"), "x").first()[0] == 0
    assert A.index_of_dispersion(flat.limit(1), "x").first()[0] is None


def test_reciprocal_ranks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([100, 150, 200, 50, 300])], "article_id bigint, views int")
    got = {r["views"]: r["prediction_score"] for r in A.reciprocal_rank_scores(df, "views", "article_id").collect()}
    assert got == pytest.approx({300: 1, 200: 1 / 2, 150: 1 / 3, 100: 1 / 4, 50: 1 / 5})


def test_negative_ratio_and_intervals(spark):
    df = spark.range(40).select((F.col("id") % 4 == 0).cast("int").alias("label"))
    assert tuple(A.negative_ratio(df).first()) == (10, 30, 3.0)
    assert one(spark, 99774, "bigint", scalars.interval_text(F.col("v"))) == "1 days 3:42:54"
    assert one(spark, "A b, c!", "string", scalars.hashed_token_ids("v", 100, 5))[3:] == [0, 0]
    assert len(one(spark, "a b c d", "string", scalars.hashed_token_ids("v", 100, 2))) == 2
    assert one(spark, 6, "int", scalars.combinations(F.col("v"), 2)) == 15.0
    text = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    assert [r[0] for r in text.select(scalars.join_text(["x", "y"])).collect()] == ["a b", None]
    assert scalars.joined_name(["x", "y"]) == "x-y"


def test_index_table(spark):
    df = spark.createDataFrame([(11, [1.0, 2.0]), (10, [3.0, 4.0])], "article_id bigint, embedding array<float>")
    zero = {r["index"]: (r["article_id"], r["embedding"]) for r in K.index_table(df, "article_id", "embedding").collect()}
    assert zero == {0: (None, [0.0, 0.0]), 1: (10, [3.0, 4.0]), 2: (11, [1.0, 2.0])}
    mean = {r["index"]: r["embedding"] for r in K.index_table(df, "article_id", "embedding", "mean").collect()}
    assert mean[0] == [2.0, 3.0]
    with pytest.raises(ValueError):
        K.index_table(df, "article_id", "embedding", "other")


# ---- metrics


def long_table(spark, labels, scores):
    rows = [(i, p, y, float(x)) for i, (ys, xs) in enumerate(zip(labels, scores)) for p, (y, x) in enumerate(zip(ys, xs))]
    return spark.createDataFrame(rows, "impression_id bigint, pos bigint, label int, score double")


@pytest.fixture(scope="module")
def example(spark):
    return long_table(spark, [[1, 0, 0], [1, 1, 0], [1, 0, 0, 0]], [[.2, .3, .5], [.18, .7, .1], [.18, .2, .1, .1]])


def test_metric_example(example):
    metrics = [M.auc(), M.mrr(), M.ndcg(5), M.ndcg(10), M.log_loss(), M.rmse(), M.accuracy(), M.f1()]
    got = {r["metric"]: r["value"] for r in M.evaluate(example, metrics).collect()}
    assert got == pytest.approx({"auc": 0.5555555555555556, "mrr": 0.5277777777777778, "ndcg@5": 0.7103099178571526,
                                 "ndcg@10": 0.7103099178571526, "logloss": 0.716399020295845, "rmse": 0.5022870658128165,
                                 "accuracy": 0.5833333333333334, "f1": 0.2222222222222222})


def test_graded_ideal_equals_closed_form(example):
    a = M.per_impression(example, [M.ndcg(5)]).orderBy("impression_id").collect()
    b = M.per_impression(example, [M.ndcg(5, graded=True)]).orderBy("impression_id").collect()
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b])


def test_undefined_impressions(spark):
    df = long_table(spark, [[1, 0], [0, 0]], [[.9, .1], [.5, .4]])
    assert [r["value"] for r in M.evaluate(df, [M.auc()]).collect()] == [1.0]
    assert [r["value"] for r in M.evaluate(df, [M.auc()], on_undefined="null").collect()] == [None]
    with pytest.raises(Exception, match="undefined"):
        M.evaluate(df, [M.auc()], on_undefined="error").collect()
    assert M.per_impression(df, [M.reciprocal_rank()]).orderBy("impression_id").collect()[1][1] == 1.0
    with pytest.raises(TypeError):
        M.evaluate(df, ["auc"])


def test_reciprocal_rank(spark):
    df = long_table(spark, [[0, 0, 1], [0, 1, 0], [1, 0, 0]], [[.3, .2, .1]] * 3)
    got = [r[1] for r in M.per_impression(df, [M.reciprocal_rank()]).orderBy("impression_id").collect()]
    assert got == pytest.approx([1 / 3, 1 / 2, 1])


def test_ties_in_auc(spark):
    df = long_table(spark, [[1, 1, 0, 0]], [[.9, .5, .5, .1]])
    row = M.per_impression(df, [M.auc(), M.auc("zero")]).first()
    assert (row["auc"], row["auc_strict"]) == pytest.approx((0.875, 0.75))


def test_python_metric(example):
    value = M.python_metric(example, "hits", lambda y, p: float(y[p.argmax()])).first()["value"]
    assert value == pytest.approx(1 / 3)
    with pytest.raises(TypeError):
        M.python_metric(example, "x", None)


def test_hybrid_mean(spark):
    df = spark.createDataFrame([(1, [0, 1], [.5, .7]), (2, [1], [.1])],
                               "impression_id bigint, clicked_labels array<int>, predicted_score array<double>")
    moved = df.withColumn("predicted_score", F.transform("predicted_score", lambda x: x - 0.5))
    got = {r[0]: r["predicted_score"] for r in ensemble.average_lists([df, moved]).collect()}
    assert got[1] == pytest.approx([.25, .45]) and got[2] == pytest.approx([-.15])
    only = moved.filter("impression_id = 2")
    assert [r[0] for r in ensemble.average_lists([df, only]).collect()] == [2]


# ---- beyond accuracy


def items(spark, values, name="embedding", kind="array<double>"):
    return spark.createDataFrame(list(values.items()), f"item string, {name} {kind}")


def recommended(spark, lists_):
    rows = [(i, p, x) for i, xs in enumerate(lists_) for p, x in enumerate(xs)]
    return spark.createDataFrame(rows, "list_id bigint, pos bigint, item string")


def column(df, key="list_id"):
    return [r[1] for r in df.orderBy(key).collect()]


def test_diversity(spark):
    vecs = items(spark, {"1": [.1, .2], "2": [.2, .3], "3": [.3, .4], "4": [.4, .5]})
    recs = recommended(spark, [["1", "2"], ["2", "3"], ["3", "4"], ["404", "405"], ["1", "404"]])
    got = column(B.intralist_diversity(recs, vecs))
    assert got[:3] == pytest.approx([0.00772212, 0.00153965, 0.00048792], abs=1e-8) and got[3:] == [None, None]
    wide = items(spark, {"a": [.1, .2, .3], "b": [.4, .5, .6], "c": [.7, .8, .9]})
    assert column(B.intralist_diversity(recommended(spark, [["a", "b", "c"]]), wide)) == pytest.approx([0.0225884385], abs=1e-9)
    bounds = B.candidate_diversity(vecs.select("item"), vecs, 2).first()
    assert tuple(bounds) == pytest.approx((0.0004879239, 0.0221975859), abs=1e-8)
    sampled = B.sampled_candidate_diversity(vecs.select("item"), vecs, 2, draws=5).first()
    assert bounds[0] - 1e-9 <= sampled[0] <= sampled[1] <= bounds[1] + 1e-9
    with pytest.raises(ValueError):
        B.candidate_diversity(vecs.select("item"), vecs, 5)
    with pytest.raises(ValueError):
        B.intralist_diversity(recs, vecs, "absent")


def test_other_distances(spark):
    vecs = items(spark, {"a": [0.0, 0.0], "b": [3.0, 4.0], "c": [0.0, 0.0]})
    recs = recommended(spark, [["a", "b"], ["a", "c"]])
    assert column(B.intralist_diversity(recs, vecs, distance="euclidean")) == [5.0, 0.0]
    assert column(B.intralist_diversity(recs, vecs, distance="manhattan")) == [7.0, 0.0]
    with pytest.raises(ValueError):
        vectors.distance("other", F.col("a"), F.col("b"))


def test_distribution(spark):
    recs = recommended(spark, [["1", "2"], ["1", "3"]])
    g = items(spark, {"1": "Action", "2": "Action", "3": "Comedy"}, "g", "string")
    assert {r[0]: r[1] for r in B.distribution(recs, g, "g").collect()} == pytest.approx({"Action": .75, "Comedy": .25})
    sg = items(spark, {"1": ["Action", "Thriller"], "2": ["Action", "Comedy"], "3": ["Comedy"]}, "sg", "array<string>")
    got = {r[0]: r[1] for r in B.distribution(recommended(spark, [["1", "2"], ["2", "3"]]), sg, "sg", is_list=True).collect()}
    assert got == pytest.approx({"Action": 3 / 7, "Thriller": 1 / 7, "Comedy": 3 / 7})


def test_coverage(spark):
    recs = recommended(spark, [["1", "2"], ["2", "3"], ["4", "3"]])
    catalog = spark.createDataFrame([(str(i),) for i in range(1, 7)], "item string")
    assert tuple(B.coverage(recs, catalog).first()) == pytest.approx((4, 2 / 3))
    assert tuple(B.coverage(recs).first()) == (4, -math.inf)


def test_sentiment(spark):
    s = items(spark, {"1": 1.0, "2": .5, "3": .25, "4": 0.0}, "s", "double")
    assert column(B.sentiment(recommended(spark, [["1", "2"], ["2", "3"], ["1", "4"]]), s, "s")) == [.75, .375, .5]
    assert tuple(B.candidate_sentiment(s.select("item"), s, "s", 1).first()) == (1.0, 0.0)


def test_serendipity(spark):
    values = {str(i): [i / 10, (i + 1) / 10] for i in range(1, 9)}
    vecs = items(spark, values)
    recs = recommended(spark, [["1", "2"], ["3", "4"], ["404"]])
    read = recommended(spark, [["5", "6"], ["7", "8"], ["1"]])
    got = column(B.serendipity(recs, read, vecs))
    assert got[:2] == pytest.approx([0.01734935, 0.00215212], abs=1e-8) and got[2] is None


def test_novelty(spark):
    p = items(spark, {"1": .05, "2": .1, "3": .2, "4": .3, "5": .4}, "p", "double")
    assert column(B.novelty(recommended(spark, [["1", "2"], ["3", "4"]]), p, "p")) == pytest.approx([3.82192809, 2.02944684])
    assert tuple(B.candidate_novelty(p.select("item"), p, "p", 2).first()) == pytest.approx((1.52944684, 3.82192809))


def test_random_subsets_are_distinct_and_spread(spark):
    pool = spark.createDataFrame([(str(i),) for i in range(8)], "item string")
    draws = spark.range(400).withColumnRenamed("id", "list_id")
    got = B.random_subsets(pool, draws, "list_id", 3, 9)
    per = got.groupBy("list_id").agg(F.count_distinct("item").alias("n")).select("n").distinct().collect()
    assert [r[0] for r in per] == [3]
    counts = [r[1] for r in got.groupBy("item").count().collect()]
    assert len(counts) == 8 and min(counts) > 100 and max(counts) < 200
    with pytest.raises(ValueError):
        B.random_subsets(pool, draws, "list_id", 9, 9)
