"""Language-model scores by a hidden Markov model over word classes.

Every token belongs to one class: the ``OWN`` most common training tokens have a class each, the others are
hashed into ``SHARED`` classes.  Latent states emit classes, and a class emits its tokens by their training
counts, so p(token | state) = p(class | state) * p(token | class).  The model has a fixed size, while the
token counts grow with the corpus and stay a table.

Training is Baum-Welch: partitions run forward and backward over their documents and emit expected counts,
which Spark sums per class; one iteration is one pass over all training tokens.  Scoring is the scaled
forward recursion over a whole document, which gives its likelihood exactly, plus the sum of the tokens'
log-probabilities within their classes.

Tokens among the ``COMMON`` most frequent are looked up in the task (a table of bounded size); the rare
rest, one row per document and token, is joined to the counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import small_batches, table, whole, written

STATES = 8
OWN = 2048
SHARED = 2048
CLASSES = OWN + SHARED
COMMON = 1 << 17
ITERATIONS = 5
ADD = 0.1
SEGMENT = 256  # training cuts a document here; a later segment has a start distribution of its own
GROUP = 400_000  # tokens a training step holds at once
SCORE_GROUP = 2_000_000  # tokens a scoring step holds at once
FLUSH = 300_000  # distinct tokens a task counts before it passes them on
END = b""  # the end of a text, which no word can be
SEED = 11


@dataclass
class Hmm:
    """Distributions of a document's first state, a later segment's first state, the next state, and the class."""

    first: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states by classes


@dataclass
class Lexicon:
    """What the counts say, in bounded size: totals, the common tokens with their counts, sums by shared class."""

    total: int
    distinct: int
    common: list[bytes]
    count: np.ndarray
    shared_total: np.ndarray
    shared_distinct: np.ndarray

    def base(self, c):
        """log10 of the smoothed unigram probability of a token with count ``c``."""
        return np.log10((c + ADD) / (self.total + ADD * (self.distinct + 1)))

    def class_weights(self) -> np.ndarray:
        """Training mass of each class."""
        own = np.zeros(OWN)
        own[:len(self.count[:OWN])] = self.count[:OWN]
        return np.concatenate((own + ADD, self.shared_total + ADD * (self.shared_distinct + 1)))


def shared_class(token: bytes) -> int:
    return zlib.crc32(token) % SHARED


def _trained():
    return F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0


def tokens(text: bytes) -> list[bytes]:
    words = text.lower().split()  # of bytes: lower-cases A-Z only, splits at ASCII white space
    words.append(END)
    return words


def token_counts(source: DataFrame) -> DataFrame:
    """(token, n) over the texts of ``source`` (text binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pack = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens(text))
            if len(seen) > FLUSH:
                yield pack()
                seen.clear()
        yield pack()

    return source.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame, common: int = COMMON) -> Lexicon:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "token").limit(common).toArrow()  # bounded by ``common``
    names, n = top.column("token").to_pylist(), top.column("n").to_numpy().astype(float)
    by_class = counts.groupBy(F.pmod(F.crc32("token"), F.lit(SHARED)).alias("c")).agg(F.sum("n"), F.count(F.lit(1))).collect()
    sums, kinds = np.zeros(SHARED), np.zeros(SHARED)
    for c, s, k in by_class:  # at most ``SHARED`` rows
        sums[c], kinds[c] = s, k
    for token, c in zip(names[:OWN], n[:OWN]):  # these have classes of their own
        sums[shared_class(token)] -= c
        kinds[shared_class(token)] -= 1
    return Lexicon(total, distinct, names, n, sums, kinds)


def encoded(source: DataFrame, lex: Lexicon) -> DataFrame:
    """One row per document of ``source`` (id, trained, text): its classes, what its common tokens add up to, and
    its rare tokens; ``row`` numbers the rows.  Written to the shared folder."""
    fields = [("row", pa.int64()), ("id", None), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()),
              ("within", pa.float64()), ("classes", pa.binary()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(lex.common)}.get
        size = len(lex.common)
        base = np.append(lex.base(lex.count), 0.0)  # the last entry stands for a rare token
        shared = np.array([shared_class(t) for t in lex.common], dtype=np.int64)
        classes = np.append(np.where(np.arange(size) < OWN, np.arange(size), OWN + shared), -1)
        inside = np.log10((lex.count + ADD) / (lex.shared_total[shared] + ADD * (lex.shared_distinct[shared] + 1)))
        inside = np.append(np.where(np.arange(size) < OWN, 0.0, inside), 0.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                words = tokens(text)
                at = np.array([place(w, size) for w in words])
                kinds, far = classes[at], np.flatnonzero(at == size)
                rest = [words[k] for k in far]
                kinds[far] = [OWN + shared_class(w) for w in rest]
                seen = Counter(rest)
                out.append((row, len(words), len(words) - len(rest), float(base[at].sum()), float(inside[at].sum()),
                            kinds.astype("<i2").tobytes(), list(seen), list(seen.values())))
                row += 1
            cols = list(zip(*out)) if out else [[]] * 8
            cols = [cols[0], None, None, *cols[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) if n in ("id", "trained") else pa.array(c, t) for (n, t), c in zip(fields, cols)], [n for n, _ in fields])

    kind = source.schema["id"].dataType.simpleString()
    schema = (f"row long, id {kind}, trained boolean, n_tokens long, known long, base double, within double, classes binary, "
              "rare array<binary>, times array<bigint>")
    return written(source.mapInArrow(run, schema), "encoded")


def start(lex: Lexicon) -> Hmm:
    """States that tend to stay, each with its own disturbance of the class frequencies."""
    rng = np.random.default_rng(SEED)
    emit = lex.class_weights() * np.exp(rng.normal(0, 1, (STATES, CLASSES)))
    move = np.full((STATES, STATES), 0.05 / (STATES - 1))
    np.fill_diagonal(move, 0.95)
    even = np.full(STATES, 1 / STATES)
    return Hmm(even, even, move, emit / emit.sum(axis=1, keepdims=True))


@dataclass
class Sums:
    """Expected counts of one partition."""

    first: np.ndarray
    later: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    fit: float = 0.0


def expect(segments: list[np.ndarray], opens: list[bool], model: Hmm, sums: Sums) -> None:
    """Forward and backward over segments side by side; adds their expected counts to ``sums``."""
    order = np.argsort([-len(s) for s in segments], kind="stable")
    length = np.array([len(segments[k]) for k in order])
    flat = np.concatenate([segments[k] for k in order]).astype(np.int64)
    begin = np.cumsum(length) - length
    head = np.array([opens[k] for k in order])
    steps, emit = int(length[0]), np.ascontiguousarray(model.emit.T)
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # segments longer than t
    seen, alpha, scale = [], [], []
    for t in range(steps):
        e = emit[flat[begin[:live[t]] + t]]
        a = np.where(head[:, None], model.first, model.later) if t == 0 else alpha[-1][:live[t]] @ model.move
        a = a * e
        c = a.sum(axis=1, keepdims=True)
        a /= c
        seen.append(e)
        alpha.append(a)
        scale.append(c)
    sums.fit += sum(float(np.log(c).sum()) for c in scale)
    beta = np.ones((live[-1], STATES))
    for t in range(steps - 1, -1, -1):
        gamma = alpha[t] * beta
        alpha[t] = gamma if t == 0 else alpha[t]
        where = flat[begin[:live[t]] + t]
        for k in range(STATES):
            sums.emit[k] += np.bincount(where, weights=gamma[:, k], minlength=CLASSES)
        if t == 0:
            sums.first += gamma[head].sum(axis=0)
            sums.later += gamma[~head].sum(axis=0)
            break
        ahead = seen[t] * beta / scale[t]
        sums.move += model.move * (alpha[t - 1][:live[t]].T @ ahead)
        beta = np.ones((live[t - 1], STATES))
        beta[:live[t]] = ahead @ model.move.T


def likelihoods(documents: list[np.ndarray], model: Hmm) -> np.ndarray:
    """log10 likelihood of each whole sequence by the scaled forward recursion."""
    order = np.argsort([-len(d) for d in documents], kind="stable")
    length = np.array([len(documents[k]) for k in order])
    flat = np.concatenate([documents[k] for k in order]).astype(np.int64)
    begin, emit = np.cumsum(length) - length, np.ascontiguousarray(model.emit.T)
    total, a = np.zeros(len(order)), None
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    for t, n in enumerate(live):
        a = (model.first if a is None else a[:n] @ model.move) * emit[flat[begin[:n] + t]]
        c = a.sum(axis=1)
        a /= c[:, None]
        total[:n] += np.log10(c)
    out = np.empty(len(order))
    out[order] = total
    return out


def baum_welch(codes: DataFrame, model: Hmm, lex: Lexicon) -> tuple[Hmm, float]:
    """One iteration over all rows of ``codes`` (classes); the new model and the old one's log-likelihood."""
    names = [f"s{k}" for k in range(STATES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros
        sums = Sums(z(STATES), z(STATES), z((STATES, STATES)), z((STATES, CLASSES)))
        held, opens, size = [], [], 0
        for batch in batches:
            for code in batch.column("classes").to_pylist():
                whole_text = np.frombuffer(code, "<i2")
                for at in range(0, len(whole_text), SEGMENT):
                    held.append(whole_text[at:at + SEGMENT])
                    opens.append(at == 0)
                    size += len(held[-1])
                    if size >= GROUP:
                        expect(held, opens, model, sums)
                        held, opens, size = [], [], 0
        if held:
            expect(held, opens, model, sums)
        # rows below 0: next states, first states, the fit
        rows = np.concatenate([sums.emit.T, sums.move, sums.first[None], sums.later[None], np.full((1, STATES), sums.fit)])
        slots = np.concatenate([np.arange(CLASSES), -1 - np.arange(STATES + 3)])
        some = rows.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(slots[some]), *[pa.array(rows[some, k]) for k in range(STATES)]], ["slot", *names])

    schema = "slot long, " + ", ".join(f"{n} double" for n in names)
    sums = codes.mapInArrow(run, schema).groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # a fixed number of rows
    slot = sums.column("slot").to_numpy()
    value = np.stack([sums.column(n).to_numpy() for n in names], axis=1)
    found = np.zeros((CLASSES + STATES + 3, STATES))
    found[np.where(slot >= 0, slot, CLASSES - 1 - slot)] = value
    spread = lambda x, prior: (x + prior) / (x + prior).sum(axis=-1, keepdims=True)
    weights = lex.class_weights()
    emit = spread(found[:CLASSES].T, 10.0 * weights / weights.sum())
    move = spread(found[CLASSES:CLASSES + STATES], 1.0)
    return Hmm(spread(found[-3], 1.0), spread(found[-2], 1.0), move, emit), float(found[-1, 0])


def train(codes: DataFrame, lex: Lexicon, iterations: int = ITERATIONS) -> Hmm:
    model = start(lex)
    for _ in range(iterations):
        model, _ = baum_welch(codes, model, lex)
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS,
          common: int = COMMON) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null text is empty and has one token, its end.  A null id counts as the empty text where ids are
    hashed, so it is held out.  Without training documents all counts are 0 and the model is its start.
    Repeated rows are documents each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("text")).withColumn("trained", _trained())
    counts = written(token_counts(source.filter("trained").select("text")), "token-counts")
    lex = lexicon(counts, common)
    rows = encoded(source, lex)
    model = train(rows.filter("trained").select("classes"), lex, iterations)
    head = ["row", "id", "trained", "n_tokens", "known", "base", "within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole_group = pa.Table.from_batches(held).combine_chunks()
            codes = [np.frombuffer(x, "<i2") for x in whole_group.column("classes").to_pylist()]
            model_score = likelihoods(codes, model) if codes else np.zeros(0)
            return pa.RecordBatch.from_arrays([*[whole_group.column(c).combine_chunks() for c in head], pa.array(model_score)], [*head, "path"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("classes").nbytes // 2
            if size >= SCORE_GROUP:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)

    kind = source.schema["id"].dataType.simpleString()
    paths = rows.select(*head, "classes").mapInArrow(
        run, f"row long, id {kind}, trained boolean, n_tokens long, known long, base double, within double, path double")
    rare = rows.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    sizes = lex.shared_total + ADD * (lex.shared_distinct + 1)
    shared = spark.createDataFrame([(k, float(x)) for k, x in enumerate(sizes)], "c int, size double")  # ``SHARED`` rows
    met = (rare.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
           .withColumn("c", F.pmod(F.crc32("token"), F.lit(SHARED)).cast("int")).join(F.broadcast(shared), "c"))
    floor = lex.total + ADD * (lex.distinct + 1)
    adds = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + ADD) / floor)).alias("rare_base"),
        F.sum(F.col("times") * F.log10((F.col("n") + ADD) / F.col("size"))).alias("rare_within"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return paths.join(adds, "row", "left").select(
        F.col("id").alias(id_col), (~F.col("trained")).alias("held_out"), "n_tokens", (F.col("known") + none("rare_known")).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + none("rare_base")).alias("base_score"),
        (F.col("path") + F.col("within") + none("rare_within")).alias("score"))


def op2_hmm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"))
