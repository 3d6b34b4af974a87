"""URL filter: path rules first, and for the rest a ratio of two character language models.

The URLs that a rule allows train one variable-order Markov model, those that a rule blocks another.  A
symbol's probability is interpolated from order 0 up to order ``ORDER``: each order adds its counts to the
next lower order's estimate, so a context never seen falls back to a shorter one.  A URL's score is the
difference of the two log-likelihoods divided by its length; the threshold is chosen on labelled URLs that
were kept out of training.

Counts of all training URLs are summed in Spark.  A model is a table of fixed size (orders above 2 are
hashed into ``BUCKETS`` slots), so what every task receives does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.llm.common import ascii_lower, table, whole

# The rules of the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

SYMBOLS = 64
END, PAD, OTHER = 63, 62, 61
ORDER = 4
BUCKETS = 1 << 14
STRENGTH = 4.0  # how many observations a lower order's estimate counts for
BINS = 2000
SPAN = 5.0  # score differences beyond this share the outermost bins


def _symbol_table() -> np.ndarray:
    """Byte to symbol: letters without case, digits, some marks, and one symbol for all other bytes."""
    marks = b"abcdefghijklmnopqrstuvwxyz0123456789./-_:?=&#%+~,;@!"
    out = np.full(256, OTHER, dtype=np.int64)
    for k, b in enumerate(marks):
        out[b] = k
        out[ord(chr(b).upper())] = k
    return out


BYTES = _symbol_table()


def _sizes() -> list[tuple[int, int]]:
    """(slots of contexts, slots of context and symbol) of each order."""
    return [(min(SYMBOLS**o, BUCKETS), min(SYMBOLS ** (o + 1), BUCKETS)) for o in range(ORDER + 1)]


TABLE = sum(c + j for c, j in _sizes())


def url_slots(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols per URL, slots): row 2 * order of ``slots`` is the context's slot for each symbol, row
    2 * order + 1 that of context and symbol."""
    lengths = np.array([len(u) + 1 for u in urls], dtype=np.int64)
    pieces = [np.concatenate((np.full(ORDER, PAD), BYTES[np.frombuffer(u, np.uint8)], [END])) for u in urls]
    stream = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    begins = np.cumsum(lengths + ORDER) - lengths - ORDER
    at = np.arange(lengths.sum()) + np.repeat(begins + ORDER - (np.cumsum(lengths) - lengths), lengths)
    out = np.empty((2 * ORDER + 2, len(at)), dtype=np.int64)
    base, context = 0, np.zeros(len(at), np.int64)
    for o, (c, j) in enumerate(_sizes()):
        if o:
            context = context + stream[at - o] * SYMBOLS ** (o - 1)
        joint = context * SYMBOLS + stream[at]
        spread = lambda x, n, top: x if top <= n else (x * 0x9E3779B1 >> 7) % n
        out[2 * o] = base + spread(context, c, SYMBOLS**o)
        out[2 * o + 1] = base + c + spread(joint, j, SYMBOLS ** (o + 1))
        base += c + j
    return lengths, out


def log_likelihoods(urls: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each URL under the model with these counts."""
    lengths, slots = url_slots(urls)
    p = np.full(slots.shape[1], 1.0 / SYMBOLS)
    for o in range(ORDER + 1):
        p = (counts[slots[2 * o + 1]] + STRENGTH * p) / (np.maximum(counts[slots[2 * o]], counts[slots[2 * o + 1]]) + STRENGTH)
    total = np.concatenate(([0.0], np.cumsum(np.log(p))))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def host_and_path(url: str) -> tuple[Column, Column]:
    text, form = whole(url), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(text, form, 1)), F.regexp_extract(text, form, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equally long ones a block wins."""
    known = []
    for verdict, rule in rules:
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        known.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.array_max(F.array(*known)) if known else F.lit(None).cast("struct<size:int,verdict:string,rule:string>")


def count_table(urls: DataFrame) -> np.ndarray:
    """Counts of both models, (2, TABLE), from (url binary, rejected int)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, TABLE), dtype=np.int64)
        for batch in batches:
            kinds = batch.column("rejected").to_numpy(zero_copy_only=False)
            texts = batch.column("url").to_pylist()
            for kind in (0, 1):
                _, slots = url_slots([u for u, k in zip(texts, kinds) if k == kind])
                for row in slots:
                    sums[kind] += np.bincount(row, minlength=TABLE)
        kind, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(kind * TABLE + slot), pa.array(sums[kind, slot])], ["slot", "n"])

    totals = urls.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2 * TABLE rows at most
    out = np.zeros(2 * TABLE)
    out[totals.column("slot").to_numpy()] = totals.column("n").to_numpy()
    return out.reshape(2, TABLE)


def _scored(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``rows`` (with a binary column __url) with their length-normalised difference as ``score``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("__url").to_pylist()
            n = np.array([len(u) + 1 for u in urls], dtype=float)
            score = (log_likelihoods(urls, counts[0]) - log_likelihoods(urls, counts[1])) / n if urls else n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    plain = rows.select(*[c for c in rows.columns if c != "__url"], "__url")
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def threshold(held: DataFrame) -> float:
    """The score that best separates held-out (score, rejected) rows: the middle of the range that maximises
    the share of accepted kept plus the share of rejected dropped; 0 without rows of both kinds."""
    place = F.floor((F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) + SPAN) * (BINS / (2 * SPAN))).cast("int")
    seen = held.groupBy(place.alias("bin"), "rejected").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * BINS + 2 rows at most
    hist = np.zeros((2, BINS + 1))
    for r in seen:
        hist[r["rejected"], r["bin"]] += r["n"]
    if not hist[0].sum() or not hist[1].sum():
        return 0.0
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(hist, axis=1)), axis=1) / hist.sum(axis=1, keepdims=True)
    gain = below[1] - below[0]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 / BINS * 2 * SPAN - SPAN)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score, threshold.

    ``verdict`` is the rule's where one fits; elsewhere the URL is blocked if its score (per symbol, accepted
    minus rejected) is below the threshold.  A null URL is an empty text, which has no host and no path.
    Without URLs of both kinds to learn from, nothing is blocked beyond the rules.  Repeated rows give a row
    each and weigh as often in training; an empty table gives no rows.
    """
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), whole(url_col).cast("binary").alias("__url"))
    rows = rows.withColumn("known", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("id", "host", "path", F.col("known.rule").alias("rule"), F.col("known.verdict").alias("given"), "__url")
    held = F.pmod(F.crc32("__url"), F.lit(10)) == 0
    labelled = rows.filter("given is not null").withColumn("rejected", (F.col("given") == "block").cast("int"))
    counts = count_table(labelled.filter(~held).select(F.col("__url").alias("url"), "rejected"))
    able = bool(counts[0, 0] and counts[1, 0])  # slot 0 counts every symbol
    limit = threshold(_scored(labelled.filter(held).select("rejected", "__url"), counts)) if able else -np.inf
    judged = F.when(F.col("score") < limit, "block").otherwise("allow") if able else F.lit("allow")
    return _scored(rows, counts).select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", judged).alias("verdict"), "score",
        F.lit(limit).alias("threshold"))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))
