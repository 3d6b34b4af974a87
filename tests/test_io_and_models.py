"""Sources, sinks and fitted models end to end."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.operators import frames as P
from slatewise.plans import collaborative, encoding, ensemble, features
from slatewise.plans import metrics as M
from slatewise.sources import sinks, tables
from slatewise.sources.star import Star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return Star(spark, FOLDER)


def test_catalog_errors(spark):
    with pytest.raises(ValueError, match="articles"):
        tables.load(spark, {"part": "x"}, "articles")


def test_submission_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(237, [2, 3, 1]), (291, [2, 1]), (320, [1, 3, 4, 2])], "impression_id bigint, ranks array<int>")
    assert [r[0] for r in df.select(sinks.submission_line("ranks")).collect()][0] == "237 [2,3,1]"
    path = str(tmp_path / "submission")
    sinks.write_submission(df, path, "ranks")
    back = {r[0]: r[1] for r in tables.read_submission(spark, path).collect()}
    assert back == {237: [2, 3, 1], 291: [2, 1], 320: [1, 3, 4, 2]}


def test_prediction_tree_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5])], "impression_id bigint, predicted_score array<double>")
    folder = str(tmp_path / "predictions")
    for model in ("a", "b"):
        sinks.write_predictions(df, folder, model)
    tree = tables.read_tree(spark, folder)
    assert tree.count() == 2 and tree.select("source_file").distinct().count() == 2
    sinks.write_json(df, str(tmp_path / "json"))
    assert tables.read_json(spark, str(tmp_path / "json")).first()["predicted_score"] == [0.5]
    assert tables.key_value_table(spark, {"a": 1, "b": 2}).columns == ["keys", "values"]


def test_collaborative_beats_chance_and_reloads(star, tmp_path):
    long = star.candidates()
    model, users, items = collaborative.fit(long.filter("label = 1"), factors=8, iterations=3)
    scores = collaborative.scores(model, users, items, long)
    assert scores.count() == scores.select(S.USER, S.ARTICLE).distinct().count()
    joined = long.join(scores, [S.USER, S.ARTICLE], "left").na.fill(0.0, ["score"])
    auc = M.evaluate(joined, [M.auc()]).first()["value"]
    assert auc > 0.6  # fitted and scored on the same clicks
    model.write().overwrite().save(str(tmp_path / "als"))
    assert ALSModel.load(str(tmp_path / "als")).rank == 8


def test_trees_learn_and_reload(spark, tmp_path):
    rows = spark.range(2_000).select(
        (F.col("id") / 10).cast("long").alias(S.IMPRESSION), F.lit(1).alias(S.USER), (F.col("id") % 10).alias(S.POS),
        F.col("id").alias(S.ARTICLE), F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("sentiment_score"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "x").otherwise("y").alias("category"))
    rows = rows.withColumn(S.LABEL, (F.col("sentiment_score") > 0.7).cast("int")).na.fill(0, [S.LABEL])
    with pytest.raises(TypeError):
        features.fit_trees(rows, trees=1)
    rows = features.with_codes(rows, features.category_codes(rows))
    model = features.fit_trees(rows, trees=5, depth=3)
    scored = features.score_trees(model, rows)
    assert M.evaluate(scored, [M.auc()]).first()["value"] > 0.9
    assert features.importances(model)["sentiment_score"] > 0.8
    model.write().overwrite().save(str(tmp_path / "trees"))
    again = features.score_trees(PipelineModel.load(str(tmp_path / "trees")), rows)
    assert sorted(scored.collect()) == sorted(again.collect())


def test_trees_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(500).selectExpr("cast(id as double) as age", "cast(id % 3 = 0 as int) as label")
    features.fit_trees(rows.mapInPandas(counted, rows.schema), trees=2, depth=2)
    assert seen.value == 500


def test_spark_trees_have_the_full_setting(spark, star, monkeypatch):
    import __spark_entry__ as entry

    class Stopped(Exception):
        pass

    def seen(**options):
        raise Stopped(options["maxIter"], options["maxDepth"])

    monkeypatch.setattr(features, "GBTClassifier", seen)
    with pytest.raises(Stopped) as stop:
        entry.queries()["fea_4_spark_trees"](spark, star.folder)
    assert stop.value.args == (300, 6)


def test_trees_beat_chance_on_later_days(star):
    from catalog.models import boosted_trees

    scored = boosted_trees(star, trees=5, depth=3)
    assert M.evaluate(scored, [M.auc()]).first()["value"] > 0.5


def test_feature_vector_keeps_missing_as_nan(spark):
    df = spark.createDataFrame([(1.0, None)], "age double, gender int")
    row = features.feature_vector(df).first()["features"].toArray()
    assert np.isnan(row[0]) and row[1] == 1.0


def test_text_vectors(spark):
    df = spark.createDataFrame([(1, "one two two"), (2, "")], "id int, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in encoding.hashed_vectors(df, "text", 16).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1.0, abs=1e-6) and np.linalg.norm(got[2]) == 0

    def make():
        def predict(texts):
            return np.array([[len(t), t.count(" ")] for t in texts], dtype="float32")
        return predict

    own = {r["id"]: r["embedding"] for r in encoding.model_vectors(df, "text", make, 2).collect()}
    assert own == {1: [11.0, 2.0], 2: [0.0, 0.0]}


def test_experiment_writes_and_scores(star, tmp_path):
    long = star.candidates()
    models = {"good": lambda: long.withColumn(S.SCORE, F.col(S.LABEL).cast("double")),
              "flat": lambda: long.withColumn(S.SCORE, F.lit(0.5))}
    got = {(r["model"], r["metric"]): r["value"] for r in ensemble.run_experiment(models, str(tmp_path / "run")).collect()}
    assert got["good", "auc"] == 1.0 and got["flat", "auc"] == 0.5
    assert len(got) == 8


def test_softmax_sample_prefers_high_scores(spark):
    df = spark.range(50).select(F.col("id"), (F.col("id") >= 45).cast("double").alias("s") * 8)
    picked = P.softmax_sample(df.toDF("id", "s"), 5, 1, "s", "id").collect()
    assert len({r["id"] for r in picked}) == 5 and sum(r["id"] >= 45 for r in picked) >= 4


def test_subword_ids(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    texts = ["A short text, with stops.", "", None, "long " * 500, "\u00dcn\u00ef"]
    df = spark.createDataFrame(list(enumerate(texts)), "text_encode_x int, text string")
    for name, cut in (("byte_bpe_50k.json", None), ("word_bpe_49k.json", 7)):
        plain = tokenizers.Tokenizer.from_file(public.path(name))
        got = encoding.subword_ids(df, "text", public.path(name), max_length=cut, pad=9)
        assert got.columns == ["text_encode_x", "text", f"text_encode_{name.removesuffix('.json')}"]
        for i, text, ids in got.collect():
            want = plain.encode(text or "", add_special_tokens=False).ids
            assert ids == (want if cut is None else (want + [9] * cut)[:cut])
