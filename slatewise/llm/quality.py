"""Quality classifier by co-training: two views teach each other, and both are combined.

One logistic model sees only how the text is written, the other only its metadata (language, source,
length).  In each round both are fitted, calibrated on labelled documents kept aside, and asked about
unlabelled ones; what one view is sure of becomes a training example of the other.  At the end the two
calibrated log-odds are combined by a third model, fitted on the documents kept aside, and every document
is scored in one pass.

Fitting uses a bounded sample of documents, ``SAMPLE`` expected, drawn by a hash of the id; features of the
sample are computed next to the scan and only they are shuffled.  The models are a few hundred numbers,
fitted by Newton steps whose sums Spark gathers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.llm.common import checkpointed, small_batches, table, whole

SAMPLE = 40_000
ROUNDS = 3
SURE = 0.97  # calibrated probability from which a view teaches the other
KEEP = 0.5
ASIDE = 4  # every fourth labelled document of the sample is kept aside for calibration
STEPS = 12
PARTS = 8  # partitions of the sample, which is passed over once a step
RIDGE = 1e-3
SEED = 7

MARKS = b"!|.,;:?-_/()[]{}<>=+*&%$#@'\"~^\\`"
LANGS, SOURCES, LENGTHS = 16, 64, 24
LINE_END = re.compile(rb"[.!?\n]")


def text_features(text: bytes) -> np.ndarray:
    """How a text is written: shares of kinds of characters and words, and how much of it repeats."""
    size = len(text)
    if not size:
        return np.zeros(TEXT_SIZE)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    twice = sum(a == b for a, b in zip(words, words[1:]))
    shouted = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    return np.array([
        seen[65:91].sum() / max(1, letters), seen[48:58].sum() / size, seen[128:].sum() / size, letters / size,
        (seen[32] + seen[9:14].sum()) / size, *(seen[list(MARKS)] / size * 10),
        twice / n, shouted / n, marked / n, len(set(words)) / n, len(set(lines)) / max(1, len(lines)),
        sum(len(w) <= 3 for w in words) / n, min(size / n, 50.0) / 10, np.log1p(len(words)) / 10,
        min(n / max(1, len(LINE_END.findall(text))), 200.0) / 50,
    ], dtype=float)


TEXT_SIZE = 5 + len(MARKS) + 9
META_SIZE = LANGS + SOURCES + LENGTHS + 1


def meta_features(lang, source, chars) -> np.ndarray:
    """Language and source hashed to a place each, the length as a class and as a number."""
    out = np.zeros(META_SIZE)
    out[zlib.crc32(f"{lang}".encode()) % LANGS] = 1
    out[LANGS + zlib.crc32(f"{source}".encode()) % SOURCES] = 1
    length = np.log2(1 + max(0, chars or 0))
    out[LANGS + SOURCES + min(LENGTHS - 1, int(length))] = 1
    out[-1] = length / 20
    return out


@dataclass
class View:
    """A calibrated logistic model: weights of the features, then slope and offset of its log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (x @ self.weights + self.bias) + self.offset, -30, 30)


@dataclass
class Model:
    """Both views and their combination; ``views`` is None when labels of one class or none were given."""

    views: tuple[View, View] | None
    combined: View | None


def _features(rows: DataFrame, keep: list[str], meta: tuple[str, str, str]) -> DataFrame:
    """``keep`` columns of ``rows`` (with __text binary and the metadata) and both feature arrays."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("text_x", T.ArrayType(T.DoubleType())),
                           T.StructField("meta_x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([text_features(t) for t in b.column("__text").to_pylist()], pa.list_(pa.float64()))
            m = pa.array([meta_features(*v) for v in zip(*[b.column(c).to_pylist() for c in meta])], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], x, m], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _newton(z: np.ndarray, y: np.ndarray, reg: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of a small logistic model, offset last, of the documents kept aside.

    The targets are drawn in from 0 and 1 by one document of each class, and a step that does not lower the
    loss is halved, so that a few well separated documents do not lead to boundless weights.
    """
    x = np.column_stack([z, np.ones(len(z))])
    up, down = y.sum(), (1 - y).sum()
    aim = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    loss = lambda w: np.mean(np.logaddexp(0, x @ w) - aim * (x @ w)) + reg * w @ w / 2
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grade = x.T @ (p - aim) / len(y) + reg * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + reg * np.eye(len(w)), grade)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return w


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _examples(batch: pa.RecordBatch, teachers: tuple[View, View] | None, edge: float):
    """(x, y, chosen) of the text view and of the metadata view: the labelled documents, and the unlabelled
    ones that the other view is sure of."""
    x = _matrix(batch.column("text_x")), _matrix(batch.column("meta_x"))
    label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
    open_ = np.isnan(label)
    train = ~open_ & ~batch.column("aside").to_numpy(zero_copy_only=False)
    for view in (0, 1):
        y, chosen = np.where(open_, 0.0, label), train
        if teachers:
            told = teachers[1 - view].log_odds(x[1 - view])
            sure = open_ & (np.abs(told) >= edge)
            y, chosen = np.where(sure, told > 0, y), train | sure
        yield x[view][chosen], y[chosen]


def _fit(rows: DataFrame, teachers: tuple[View, View] | None, edge: float) -> tuple[View, View]:
    """Both views by Newton's method.  A step is one pass over the sample: each partition sums its losses,
    gradients and curvatures, and the driver adds one row per partition.  A step that raised the loss is
    halved."""
    sizes = TEXT_SIZE + 1, META_SIZE + 1
    weights, best, least, ridge = [np.zeros(d) for d in sizes], [None, None], [np.inf, np.inf], [None, None]
    for _ in range(STEPS):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [(np.zeros(d), np.zeros((d, d)), np.zeros(2)) for d in sizes]
            for batch in batches:
                if not batch.num_rows:
                    continue
                for w, (g, h, n), (x, y) in zip(weights, sums, _examples(batch, teachers, edge)):
                    x = np.column_stack([x, np.ones(len(x))])
                    z = x @ w
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                    g += x.T @ (p - y)
                    h += (x * (p * (1 - p))[:, None]).T @ x
                    n += len(y), (np.logaddexp(0, z) - y * z).sum()
            flat = np.concatenate([part.ravel() for view in sums for part in view])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], ["sums"])

        parts = rows.mapInArrow(run, "sums binary").collect()  # one row for each of the sample's few partitions
        total, at = sum(np.frombuffer(r["sums"]) for r in parts), 0
        for k, d in enumerate(sizes):
            g, h = total[at:at + d], total[at + d:at + d + d * d].reshape(d, d)
            n, loss = max(1.0, total[at + d + d * d]), total[at + d + d * d + 1]
            at += d + d * d + 2
            if ridge[k] is None:  # at weight 0 the curvature is a quarter of each feature's mean square
                ridge[k] = RIDGE * 4 * np.diag(h) / n + 1e-9
            loss = loss / n + ridge[k] @ weights[k] ** 2 / 2
            if loss > least[k]:
                weights[k] = (weights[k] + best[k]) / 2
                continue
            best[k], least[k] = weights[k], loss
            weights[k] = weights[k] - np.linalg.solve(h / n + np.diag(ridge[k]), g / n + ridge[k] * weights[k])
    return tuple(View(w[:-1], float(w[-1])) for w in best)


def _calibrated(views: tuple[View, View], rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Set slope and offset of both views on the documents kept aside; their log-odds and labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = [v.log_odds(_matrix(b.column(c))) if b.num_rows else np.zeros(0) for v, c in zip(views, ("text_x", "meta_x"))]
            yield pa.RecordBatch.from_arrays([pa.array(z[0]), pa.array(z[1]), b.column("label")], ["t", "m", "label"])

    # bounded by the sample: a quarter of its labelled documents, three numbers each
    seen = rows.filter("aside and label is not null").mapInArrow(run, "t double, m double, label int").toPandas()
    y = seen["label"].to_numpy(float)
    for view, name in zip(views, ("t", "m")):
        slope, offset = _newton(seen[[name]].to_numpy(), y)
        # a view that orders these documents backwards has nothing to say
        view.slope, view.offset = max(0.0, float(slope)), float(offset)
        seen[name] = np.clip(view.slope * seen[name] + view.offset, -30, 30)
    return seen[["t", "m"]].to_numpy(), y


def co_train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
             meta: tuple[str, str, str] = ("lang", "source", "n_chars"), sample: int = SAMPLE, rounds: int = ROUNDS,
             sure: float = SURE) -> Model:
    """Train on ``labels`` (id, 0/1) and the unlabelled documents of a sample of ``sample`` expected.

    Labels with a null id or value are left out; of labels that contradict each other the smaller counts.
    """
    small_batches(docs.sparkSession)
    share = min(1.0, sample / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit(SEED), id_col), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.filter(drawn).select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("__text"), *[
        F.col(c).alias(f"m{k}") for k, c in enumerate(meta)])
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("label")))
    joined = _features(rows, ["id"], ("m0", "m1", "m2")).join(known, "id", "left")
    x = checkpointed(joined.withColumn("aside", F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(ASIDE)) == 0)
                     .repartition(PARTS, "id")).coalesce(PARTS)
    labelled, pool = x.filter("label is not null"), x.filter("label is null")
    train, aside = labelled.filter("not aside"), labelled.filter("aside")
    both = lambda d: d.select(F.countDistinct("label")).first()[0] == 2
    if not both(train) or not both(aside):
        return Model(None, None)
    edge, views = float(np.log(sure / (1 - sure))), None
    for _ in range(rounds + 1):
        views = _fit(x, views, edge)
        z, y = _calibrated(views, x)
    w = _newton(z, y)
    return Model(views, View(w[:-1], float(w[-1])))


def judged(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text",
           meta: tuple[str, str, str] = ("lang", "source", "n_chars")) -> DataFrame:
    """``keep`` columns of ``docs`` with text_score, metadata_score and score (probabilities of good quality)."""
    small_batches(docs.sparkSession)
    names = ["__text_score", "__metadata_score", "__score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], whole(text_col).cast("binary").alias("__text"), *[
        F.col(c).alias(f"__m{k}") for k, c in enumerate(meta)])
    schema = T.StructType([*rows.schema.fields[:len(keep)], *[T.StructField(c, T.DoubleType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model.views is None or not b.num_rows:
                scores = [np.ones(b.num_rows)] * 3
            else:
                x = np.array([text_features(t) for t in b.column("__text").to_pylist()])
                m = np.array([meta_features(*v) for v in zip(*[b.column(f"__m{k}").to_pylist() for k in range(3)])])
                z = np.stack([model.views[0].log_odds(x), model.views[1].log_odds(m)], axis=1)
                scores = [1 / (1 + np.exp(-s)) for s in (z[:, 0], z[:, 1], model.combined.log_odds(z))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *[pa.array(s) for s in scores]], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP, **options) -> DataFrame:
    """One row per document: id, text_score, metadata_score, score, kept.

    A null or empty text has zero text features; null metadata is a value like any other.  Without labels of
    both classes every score is 1 and every document is kept.  Repeated rows give a row each.
    """
    model = co_train(docs, labels, id_col=id_col, **options)
    return judged(docs, model, [id_col]).select(
        id_col, F.col("__text_score").alias("text_score"), F.col("__metadata_score").alias("metadata_score"),
        F.col("__score").alias("score"), (F.col("__score") >= keep).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP, **options) -> DataFrame:
    """The documents of good quality, all columns as they were."""
    model = co_train(docs, labels, id_col=id_col, **options)
    return judged(docs, model, docs.columns).filter(F.col("__score") >= keep).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
