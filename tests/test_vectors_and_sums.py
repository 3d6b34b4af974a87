"""Vector sums with holes, running sums, list segments, subsets and plans without nested subqueries."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import beyond, tables
from slatewise.functions import vectors
from slatewise.operators import aggregates as A
from slatewise.operators import frames as P
from slatewise.operators import longform as L
from slatewise.plans import beyond_accuracy as B
from slatewise.session import configure
from slatewise.sources.star import Star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return Star(configure(spark), FOLDER)


def test_vector_means_keep_their_dimensions(spark):
    rows = [("all null", [1.0, None, 3.0]), ("all null", [2.0, None, 5.0]), ("one null", [1.0, None, 3.0]), ("one null", [2.0, 4.0, 5.0]),
            ("lengths", [1.0]), ("lengths", [3.0, 5.0]), ("empty", []), ("none", None), ("long", [float(k) for k in range(40)])]
    df = spark.createDataFrame(rows, "k string, v array<double>")
    got = {r["k"]: r["mean"] for r in A.vector_means(df, ["k"], "v").collect()}
    assert got == {"all null": [1.5, None, 4.0], "one null": [1.5, 4.0, 4.0], "lengths": [2.0, 5.0], "empty": [], "none": [],
                   "long": [float(k) for k in range(40)]}
    sums = {r["k"]: (r["sum"], r["n"]) for r in A.vector_sums(df, ["k"], "v").collect()}
    assert sums["all null"] == ([3.0, None, 8.0], 2) and sums["lengths"] == ([4.0, 5.0], 2) and sums["none"] == ([], 0)


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sum_and_quantiles(spark, parts):
    df = spark.range(5_000).select(F.pmod(F.col("id") * 7919, F.lit(5_000)).alias("k"), (F.col("id") % 11).alias("x")).repartition(parts)
    got = [r["s"] for r in A.running_sum(df, ["k"], "x", "s").orderBy("k").collect()]
    values = [r["x"] for r in df.orderBy("k").collect()]
    assert got == list(itertools.accumulate(values))
    ordered = sorted(values)
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert spark.range(1).select(A.nearest_quantile(df, "x", q)).first()[0] == ordered[int(q * (len(ordered) - 1) + 0.5)]
    assert spark.range(1).select(A.nearest_quantile(df.limit(0), "x", 0.5)).first()[0] is None


def test_segments_laid_end_to_end(star):
    long = star.candidates()
    whole = {r["impression_id"]: r["a"] for r in L.to_lists(long, ["impression_id"], {"article_id": "a"}).collect()}
    pieces = L.to_list_segments(long, ["impression_id"], {"article_id": "a"}, size=3).orderBy("impression_id", "segment").collect()
    joined = {}
    for r in pieces:
        assert 0 < len(r["a"]) <= 3
        joined.setdefault(r["impression_id"], []).extend(r["a"])
    assert joined == whole


def test_all_subsets(spark):
    items = spark.createDataFrame([(k,) for k in "dacbe"], "item string")
    for n in (1, 2, 3, 5):
        got = B.all_subsets(items, n).groupBy("list_id").agg(F.sort_array(F.collect_list("item")).alias("s")).collect()
        assert sorted(r["s"] for r in got) == [list(c) for c in itertools.combinations("abcde", n)]
    with pytest.raises(ValueError):
        B.all_subsets(items, 6)


def test_given_list_and_own_distance(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), (None,)], "l array<bigint>")
    assert tuple(P.same_list_everywhere(df, "l", [1, 2]).first()) == (True, True)
    assert tuple(P.same_list_everywhere(df, "l", [1]).first()) == (True, False)
    vecs = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0])], "item string, embedding array<double>")
    recs = spark.createDataFrame([(0, "a"), (0, "b")], "list_id int, item string")
    own = B.intralist_diversity(recs, vecs, distance=lambda a, b: vectors.distance("manhattan", a, b))
    assert own.first()["diversity"] == 7.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_do_not_repeat_themselves(star):
    softmax = A.softmax(tables.popularity(star), "score", "p")
    assert plan(softmax).count("Exchange") <= 5
    items = beyond.attributes(star)
    assert plan(items).count("lineitem.parquet") == 0  # the counts are read from the checkpoint


# ---- pairs of any distance in cells of bounded size


def plain_distance(kind, a, b):
    a, b = np.array(a), np.array(b)
    return {"euclidean": np.linalg.norm(a - b), "manhattan": np.abs(a - b).sum(), "skewed": np.abs(a - b).sum() + max(a[0] - b[0], 0)}[kind]


def pair_tables(spark, seed=0):
    rng = random.Random(seed)
    vecs = {i: ([rng.gauss(0, 1) for _ in range(3)] if i % 7 else None) for i in range(20)}
    lists = {k: [rng.randrange(24) for _ in range(n)] for k, n in enumerate([0, 1, 2, 3, 9, 14, 40])}
    lists[7] = [3] * 5 + [4]
    lists[8] = [0, 23]
    recs = spark.createDataFrame([(k, p, i) for k, own in lists.items() for p, i in enumerate(own)], "list_id long, pos long, item long")
    attributes = spark.createDataFrame(list(vecs.items()), "item long, embedding array<double>")
    return {i: v for i, v in vecs.items() if v}, lists, recs, attributes


def skewed(a, b):
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return gap + F.greatest(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), F.lit(0.0))


@pytest.mark.parametrize("kind, distance", [("euclidean", "euclidean"), ("manhattan", "manhattan"), ("skewed", skewed)])
@pytest.mark.parametrize("block", [1, 2, 256])
def test_diversity_over_cells(spark, kind, distance, block):
    vecs, lists, recs, attributes = pair_tables(spark)
    got = {r["list_id"]: r["diversity"] for r in B.intralist_diversity(recs, attributes, distance=distance, block=block).collect()}
    assert got.keys() == {k for k, own in lists.items() if own}
    for k, own in lists.items():
        known = [vecs[i] for i in own if i in vecs]
        if len(known) > 1:
            want = sum(plain_distance(kind, a, b) for a in known for b in known) / (len(known) * (len(known) - 1))
            assert got[k] == pytest.approx(want, abs=1e-9)
        else:
            assert got.get(k) is None


@pytest.mark.parametrize("block", [2, 256])
def test_serendipity_over_cells(spark, block):
    vecs, lists, recs, attributes = pair_tables(spark, 1)
    history = recs.select(F.col("list_id").alias("reader"), "item")
    pairs = spark.createDataFrame([(a, b) for a in lists for b in (a, 6, 99)], "list_id long, reader long").distinct()
    got = B.serendipity(recs, history, attributes, pairs=pairs, history_key="reader", distance="euclidean", block=block).collect()
    assert len(got) == pairs.count()
    for r in got:
        left, right = ([vecs[i] for i in lists.get(k, []) if i in vecs] for k in (r["list_id"], r["reader"]))
        if left and right:
            want = np.mean([plain_distance("euclidean", a, b) for a in left for b in right])
            assert r["serendipity"] == pytest.approx(want, abs=1e-9)
        else:
            assert r["serendipity"] is None
    same = B.serendipity(recs, recs.select("list_id", "item"), attributes, distance="euclidean", block=block).collect()
    assert {r["list_id"] for r in same} == {k for k, own in lists.items() if own}


def test_no_cell_holds_a_whole_list(spark):
    _, _, recs, attributes = pair_tables(spark)
    history = recs.select(F.col("list_id").alias("reader"), "item")
    pairs = recs.select("list_id", F.col("list_id").alias("reader")).distinct()
    for df in (B.intralist_diversity(recs, attributes, distance="euclidean", block=2),
               B.serendipity(recs, history, attributes, pairs=pairs, history_key="reader", distance="euclidean", block=2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        folds = [line for line in plan.splitlines() if "collect_list" in line]
        assert folds and all(re.search(r"Aggregate \[[^\]]*_block#", line) for line in folds)


def _recs_and_items(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(k, [rng.random() - 0.5 for _ in range(20)] if k % 7 else ([0.0] * 20 if k % 2 else None)) for k in range(30)],
                                  "item long, embedding array<float>")
    recs = spark.createDataFrame([(k, rng.randrange(35)) for k in range(12) for _ in range(k)], "list_id long, item long")
    history = spark.createDataFrame([(k % 5, rng.randrange(30)) for k in range(60)], "reader long, item long")
    pairs = recs.select("list_id", (F.col("list_id") % 6).alias("reader")).distinct()
    return recs, items, history, pairs


def _answers(spark, **options):
    recs, items, history, pairs = _recs_and_items(spark)
    frames = [B.intralist_diversity(recs, items), B.intralist_diversity(recs, items, distance="euclidean", **options),
              B.serendipity(recs, history, items, pairs=pairs, history_key="reader"),
              B.serendipity(recs, history, items, pairs=pairs, history_key="reader", distance="euclidean", **options)]
    return [sorted((tuple(-1.0 if x is None else round(x, 9) for x in r) for r in f.collect())) for f in frames]


def test_lists_are_the_same_whole_cut_or_hot(spark, monkeypatch):
    whole = _answers(spark)
    assert _answers(spark, block=3) == whole
    monkeypatch.setattr("slatewise.operators.skew.HOT_ROWS", 4)
    assert _answers(spark) == whole and all(whole)


def test_vectors_of_lists_are_shuffled_as_they_are(spark):
    # sums combined before the shuffle, and cells shuffled again, took several times the bytes of the vectors
    recs, items, history, pairs = _recs_and_items(spark)
    plans = [B.intralist_diversity(recs, items), B.intralist_diversity(recs, items, distance="euclidean")]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Exchange hashpartitioning\(list_id#\d+L?, \d+\), REPARTITION_BY_COL", plan)


@pytest.mark.parametrize("distance", ["cosine", "euclidean"])
def test_ends_of_pairs_form_no_subsets(spark, monkeypatch, distance):
    rng = random.Random(3)
    rows = [(k, [0.0] * 8 if k in (4, 9) else [rng.random() - 0.5 for _ in range(8)]) for k in range(50)]
    items = spark.createDataFrame(rows, "item long, embedding array<float>")
    want = B._ends_of_diversity(B.all_subsets(items.select("item"), 2), items, "embedding", distance).first()
    monkeypatch.setattr(B, "PAIR_ROWS", 8)
    monkeypatch.setattr(B, "all_subsets", None)  # it numbered and listed every pair
    got = B.candidate_diversity(items.select("item"), items, 2, distance=distance).first()
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]


def test_cells_of_vectors_meet_without_a_join(spark):
    items = spark.range(40).selectExpr("id as item", "array(cast(id as float), cast(1 as float)) as embedding")
    plan = B._ends_of_pairs(items.select("item"), items, "embedding", "cosine")._jdf.queryExecution().optimizedPlan().toString()
    # that of the known items only; cells were joined twice, as doubles, each copy sent again
    assert plan.count("Join ") == 1 and "array<double>" not in plan and "cast(lambda" not in plan
