"""Token ids of documents in ORC files.

Documents are dealt out by ranges of their id and encoded in order, so that the files, read in the order of
their parts, hold one sequence of ids.  A row is a chunk of a document: its place, how many ids of the part
come before it, and the ids, which ORC keeps as run-length encoded integers.  Files carry stripes of a set
size, row indexes and Bloom filters on the document id: stripes are read side by side, and a look-up of a few
documents skips the stripes and row groups that cannot hold them.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from slatewise.llm.common import batches_of, checkpointed, scratch, table, whole

CHUNK = 8192  # ids in a row
END = 2
STRIPE = 16 << 20
STRIDE = 2000  # rows of a row group
TEXTS = 200  # texts in an Arrow batch
PIECE = 1 << 18  # characters that are split into units at a time
UNITS = 1 << 20  # units that a Python worker remembers
HELD = 1 << 20  # ids that a task holds before it sends them on

# A single space between two characters that are not white space: no token of the pre-tokenizer below goes
# over the place before it.
JOINT = re.compile(r"(?<=\S) (?=\S)")
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
ASCII_SPACES = [c for c in SPACES if c.isascii()]


def _single_spaced(text: str) -> bool:
    """Whether every space is a joint."""
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in (ASCII_SPACES if text.isascii() else SPACES))


class _Numbers(dict):
    """A number for each key, in the order in which they come; ``new`` has the keys since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def taken(self) -> pa.Array:
        out, self.new = self.new, []
        return pa.array(out, pa.string())


# The characters that stand for bytes in a byte-level vocabulary: a printing byte for itself, the others from U+0100 on.
_PRINTING = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_SIGNS = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTING)}
_LETTERS = "^[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+$"  # letters in every version of Unicode


def _byte_signs(text: str) -> str:
    return text if text.isascii() and " " not in text else text.encode().decode("latin-1").translate(_BYTE_SIGNS)


class Encoder:
    """Ids of whole texts, equal to the tokenizer's own.

    A byte-level tokenizer without normalizer cuts before each single space between two other characters, so
    what is between such places (a unit) has the same ids in every text; it is encoded once and remembered.
    Texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str, units: int = UNITS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.units = Tokenizer.from_file(path), units
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        free = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in made["added_tokens"])
        self.by_unit = (before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
                        and made["normalizer"] is None and made["truncation"] is None and made["padding"] is None
                        and made["model"].get("type") == "BPE" and made["model"].get("dropout") is None and free)
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes that each id stands for
        for token, at in self.tokenizer.get_vocab().items():
            self.widths[at] = len(token)  # of a byte-level token: a character for each byte
        for at, token in self.tokenizer.get_added_tokens_decoder().items():
            self.widths[at] = len(token.content.encode())
        stops = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,;:!?"} if self.by_unit else {}
        self.stops = {c: ids[0] for c, ids in stops.items() if len(ids) == 1}
        self.forget()

    def forget(self) -> None:
        # units between joints by their text after the space; of others, which are few, the ids
        self.numbers, self.others = _Numbers(), {}
        # where the ids of each unit begin and how many they are; room is doubled when it is used up
        self.starts, self.sizes, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _learn(self) -> None:
        """The ids of the units that were numbered since the last time."""
        since = len(self.numbers) - len(self.numbers.new)
        new = self.numbers.taken()
        if not len(new):
            return
        # ASCII letters and a stop are tokens of their own: the ids of the letters and that of the stop
        ended = pc.match_substring_regex(new, "^[A-Za-z]+[.,;:!?]$").to_numpy(zero_copy_only=False) & bool(self.stops)
        places = np.flatnonzero(ended)
        heads = pc.utf8_slice_codeunits(new.take(pa.array(places)), 0, -1).to_pylist()
        known = len(self.numbers)
        head = np.fromiter(map(self.numbers.__getitem__, heads), np.int64, len(heads))
        more = self.numbers.taken()
        while len(self.numbers) > len(self.sizes):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        numbers = np.concatenate([np.flatnonzero(~ended) + since, np.arange(len(more)) + known])
        units = pa.concat_arrays([new.filter(pa.array(~ended)), more])
        # a space and letters are one piece for the merges, without what splits other texts
        word = pc.match_substring_regex(units, _LETTERS).to_numpy(zero_copy_only=False)
        self._learn_words(numbers[word], units.filter(pa.array(word)).to_pylist())
        self._learn_joined(numbers[~word], units.filter(pa.array(~word)))
        if len(places):
            sizes = self.sizes[head] + 1
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(self.starts[head] - ends + sizes, sizes)
            at[ends - 1] = 0  # the stop's place
            ids = self.ids[at]
            ids[ends - 1] = [self.stops[c] for c in pc.utf8_slice_codeunits(new.take(pa.array(places)), -1).to_pylist()]
            self._keep(places + since, ids, ends - sizes)

    def _learn_words(self, numbers: np.ndarray, words: list[str]) -> None:
        merged, space = self.tokenizer.model.tokenize, _byte_signs(" ")
        for at in range(0, len(words), 10_000):
            ids = [[t.id for t in merged(space + _byte_signs(w))] for w in words[at:at + 10_000]]
            ends = np.cumsum([0, *map(len, ids)])
            self._keep(numbers[at:at + 10_000], np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends[:-1])

    def _learn_joined(self, numbers: np.ndarray, units: pa.Array) -> None:
        """Units are encoded as one text; each token's bytes tell which unit it is of."""
        words, sizes = units.to_pylist(), pc.binary_length(units).to_numpy(zero_copy_only=False)
        for at in range(0, len(words), 1000):
            part = words[at:at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(self.widths[ids])
            until = np.cumsum(sizes[at:at + 1000] + 1)
            last = np.searchsorted(ends, until)
            if last[-1] == len(ids) - 1 and (ends[last] == until).all():
                self._keep(numbers[at:at + 1000], ids, np.concatenate(([0], last[:-1] + 1)))
            else:  # the vocabulary is not one of bytes
                for n, unit in zip(numbers[at:at + 1000], part):
                    self._keep(np.array([n]), self._alone(" " + unit), np.zeros(1, np.int64))

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _keep(self, units: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used:self.used + len(ids)] = ids
        self.starts[units] = starts + self.used
        self.sizes[units] = np.diff(starts, append=len(ids))
        self.used += len(ids)

    def _units(self, text: str) -> Iterator[tuple[str, list[str], str]]:
        """What begins a part of the text without a joint, its units after joints (without the space) and what ends it."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (cut := JOINT.search(text, at + PIECE)):
                end = cut.start()
            # a part that begins at a joint begins with its space
            rest = text[at + 1:end] if at else text[:end]
            words = rest.split(" ") if _single_spaced(rest) else JOINT.split(rest)
            first = "" if at else words.pop(0)
            last = " " + words.pop() if words and words[-1][-1].isspace() else ""
            yield first, words, last
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_unit:
            return [self._alone(x) for x in texts]
        out = [[] for _ in texts]
        units, spans = [], []

        def done() -> None:
            if len(self.numbers) > self.units:
                self.forget()
            where = np.fromiter(map(self.numbers.__getitem__, units), np.int64, len(units))
            self._learn()
            sizes = self.sizes[where]
            ends = np.cumsum(sizes)
            ids = self.ids[np.arange(sizes.sum()) + np.repeat(self.starts[where] - ends + sizes, sizes)]
            ends = np.concatenate(([0], ends))
            for k, first, a, b, last in spans:
                out[k] += [self._other(first), ids[ends[a]:ends[b]], self._other(last)]
            units.clear()
            spans.clear()

        for k, text in enumerate(texts):
            for first, words, last in self._units(text):
                spans.append((k, first, len(units), len(units) + len(words), last))
                units += words
                if len(units) >= 200_000:
                    done()
        done()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def _other(self, unit: str) -> np.ndarray:
        if (found := self.others.get(unit)) is None:
            found = self.others[unit] = self._alone(unit)
        return found


@cache
def _encoder(path: str) -> Encoder:
    """One for each Python worker, so that a task knows the units of the tasks before it."""
    return Encoder(path)


COLUMNS = ["part", "start", "doc_id", "chunk", "last", "ids"]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, chunk: int) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    encoder, part, before = _encoder(path), TaskContext.get().partitionId(), 0

    def packed(kind: pa.DataType) -> pa.RecordBatch:
        starts, docs, numbers, last, ids = (list(x) for x in zip(*rows))
        ends = np.cumsum([0, *map(len, ids)])
        lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(ids))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), pa.array(starts, pa.int64()), pa.array(docs, kind),
                                           pa.array(numbers, pa.int64()), pa.array(last, pa.bool_()), lists], COLUMNS)

    rows, held, kind = [], 0, None
    for b in batches:
        kind = b.column("id").type
        for doc, ids in zip(b.column("id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
            ids = np.append(ids, np.int32(end))
            for at in range(0, len(ids), chunk):
                rows.append((before, doc, at // chunk, at + chunk >= len(ids), ids[at:at + chunk]))
                held += len(rows[-1][-1])
                if held >= HELD:
                    yield packed(kind)
                    rows, held = [], 0
            before += len(ids)
    if rows:
        yield packed(kind)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END,
                      chunk: int = CHUNK, stripe: int = STRIPE, stride: int = STRIDE) -> DataFrame:
    """Write the ids of ``docs`` to ORC files under ``folder``, documents ascending by id; the files' rows.

    Columns: part, start (ids of the part before this document), doc_id, chunk, last, ids.  A null text is empty
    and has only its end id; a null id comes first; rows that repeat an id are ordered by their text's hash.
    An empty table writes files without rows.  Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    # equal rows can change places without changing the files, but must not all be in one range
    order = ["id", "hash", "place"]
    placed = source.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("chunk", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    options = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
               "orc.stripe.size": str(stripe), "orc.row.index.stride": str(stride)}
    with batches_of(spark, TEXTS):
        ranged.mapInArrow(lambda b: _encoded(b, tokenizer, end, chunk), schema).write.options(**options).orc(folder)
    return read_token_files(spark, folder, schema)


def read_token_files(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of the files; a filter on ``doc_id`` is pushed to their indexes and Bloom filters."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.orc(folder)


DIGEST = ["part", "start", "doc_id", "chunk", "last", "n", "crc"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(flat, dtype="<u4")).cast("B")
        sums = [zlib.crc32(data[4 * i:4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        keep = [b.column(c) for c in DIGEST[:5]]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], DIGEST)


def _times(matrix: list[int], vector: int) -> int:
    out, at = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[at]
        vector >>= 1
        at += 1
    return out


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2 ** ``power`` zero bytes do to a CRC-32, as a matrix over its bits."""
    one = [0xEDB88320, *[1 << k for k in range(31)]]  # a zero bit
    for _ in range(3 + power):
        one = [_times(one, x) for x in one]
    return tuple(one)


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a sequence from (CRC-32, bytes) of its parts, without their bytes."""
    total = 0
    for crc, size in parts:
        for k in range(size.bit_length()):
            if size >> k & 1:
                total = _times(_zeros(k), total)
        total ^= crc
    return total


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums = [joined_crc32([(x["crc"], 4 * x["n"]) for x in sorted(chunks, key=lambda x: x["chunk"])]) for chunks in b.column("chunks").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.int64())], [*b.schema.names[:-1], "crc"])


def documents_of(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from the rows of the files.

    ``start`` counts the ids of all documents before it.  A document of many chunks is read by many tasks:
    lengths and checksums of its chunks are put together, not the ids.
    """
    spark = rows.sparkSession
    fields = T.StructType([*rows.schema.fields[:5], T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])
    with batches_of(spark, 1000):
        parts = checkpointed(rows.mapInArrow(_digests, fields))
    # one row per file, so this window is small whatever the number of documents
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    files = parts.groupBy("part").agg(F.sum("n").alias("ids")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    one = (F.col("chunk") == 0) & F.col("last")
    short = parts.filter(one).select("part", "start", "doc_id", F.col("n").alias("n_tokens"), "crc")
    long = (parts.filter(~one).groupBy("part", "start", "doc_id")
            .agg(F.sum("n").alias("n_tokens"), F.collect_list(F.struct("chunk", "n", "crc")).alias("chunks")))
    long = long.mapInArrow(_joined, T.StructType([*long.schema.fields[:-1], T.StructField("crc", T.LongType())]))
    return short.unionByName(long).join(F.broadcast(files), "part").select(
        F.col("doc_id").alias(id_col), (F.col("before") + F.col("start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    rows = write_token_files(table(spark, folder, "documents"), scratch(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return documents_of(rows)
