"""Helpers the training-data operators share: text expressions and tables written to the shared folder."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.session import ensure_checkpoint_dir

# The white space that separates words (space, and U+0009 to U+000D), and the letters lower-cased.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_count(text: Column) -> Column:
    """Words between white space, as a long."""
    parts = F.split(text, SPACE)
    edges = text.rlike(r"^[\x20\x09-\x0D]").cast("int") + text.rlike(r"[\x20\x09-\x0D]\z").cast("int")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.size(parts) - edges).otherwise(0).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared checkpoint folder from then on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as compressed Parquet to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts stays small in a Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside; the session's setting is put back."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with every input bit spread over all output bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def reseeded(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th hash of hashed values."""
    return mixed(x + np.uint64((k + 1) * int(ODD) % 2**64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; A-Z as a-z."""
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the shingle that starts at each word; as long as ``words`` less ``size`` - 1, never 0."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * ODD + words[k:k + n]
    return mixed(out) | np.uint64(1)


def as_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


MAP_BITS = 28


def bit_map(keys: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """A bit for the low ``bits`` bits of each value of the only column, a long: 32 MB at most whatever the table.

    A test against it may let other values through, the more the fuller it is, and never loses one.  It saves
    shuffling rows that a join would drop, and must be followed by that join.
    """
    low = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{keys.columns[0]}` & 63 as int))")
    words = keys.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**22 rows at most
    return _folded(words, 1 << (bits - 6))


def _folded(words: pa.Table, size: int) -> np.ndarray:
    """A map of ``size`` words, a power of two, from those that are not 0; halved while few of its words would be set."""
    out = np.zeros(size, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    while len(out) > max(1024, 16 * words.num_rows):
        out = out[:len(out) // 2] | out[len(out) // 2:]
    return out


def marked(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    low = values.view(np.uint64) & np.uint64(64 * len(bits) - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0


LEVELS = 25


def level_map(counts: DataFrame) -> np.ndarray:
    """The binary logarithm, 15 at most, of the count of each value, found by its low ``LEVELS`` bits: 16 MB at most
    whatever the table, of (value, count).  Values with the same low bits share a level that is no less than any of theirs."""
    slot, count = F.col(counts.columns[0]).bitwiseAND(F.lit((1 << LEVELS) - 1)), F.col(counts.columns[1])
    level = F.least(F.floor(F.log2(count)), F.lit(15)).cast("long")
    words = counts.select(slot.alias("slot"), level.alias("level")).groupBy("slot").agg(F.max("level").alias("level")).groupBy(
        F.shiftright("slot", 4).alias("word")).agg(F.bit_or(F.expr("shiftleft(level, cast(4 * (slot & 15) as int))")).alias("bits")).toArrow()
    return _folded(words, 1 << (LEVELS - 4))


def levels(values: np.ndarray, counted: np.ndarray) -> np.ndarray:
    low = values & np.uint64(16 * len(counted) - 1)
    return (counted[low >> np.uint64(4)] >> (np.uint64(4) * (low & np.uint64(15)))) & np.uint64(15)


def only_marked(df: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose ``key``, a long without nulls, may be in the bit map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(marked(b.column(key).to_numpy(), bits)))

    return df.mapInArrow(run, df.schema)
