"""SimHash near-duplicates by a self-join of a binary trie.

The distinct fingerprints are the leaves of a binary trie.  Pairs of nodes are walked downwards together:
the bits in which their prefixes differ are counted, and a pair goes no further once they exceed the error
budget.  The upper part of the walk is a DataFrame of node pairs, taken four levels at a time; a pair of
nodes that together hold at most ``leaf`` fingerprints is walked to the end inside one task, on two sorted
arrays.  Nothing but trie nodes decides where the work goes, so a crowded prefix (many near copies) is
split further down and a sparse one early.

A task reports how the fingerprints it holds hang together (each linked to the smallest of its part), not
every pair: the output of a crowded group grows with its size and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.llm.common import as_row, checkpointed, small_batches, table, whole
from slatewise.llm.graph import components

SHINGLE = 3
ERRORS = 2
SEED = 42
LEAF = 8192
STEP = 4
SLAB = 1 << 16  # shingles whose bits are spread out at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text as a signed integer; 0 without words."""
    words = text.lower().split()  # of bytes: lower-cases A-Z only, splits at ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return int(np.array([digest(b" ".join(words), SEED)], dtype="<u8").view("<i8")[0])
    grams = zip(*[words[i:] for i in range(shingle)])
    count = len(words) - shingle + 1
    hashes = np.fromiter((digest(b" ".join(g), SEED) for g in grams), dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, SLAB):
        part = hashes[at:at + SLAB].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > count).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) per row of ``docs``; a null text is empty."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), whole(text_col).cast("binary").alias("text"))
    schema = T.StructType([source.schema["id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(x, shingle) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), marks], ["id", "fp"])

    return source.mapInArrow(run, schema)


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")


def walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk two sub-tries (sorted unsigned arrays, each sharing its first ``depth`` bits) down together:
    positions (i, j) with at most ``budget`` differing bits; i < j if both are the ``same`` array."""
    found_i, found_j = [], []
    one = np.ones(1, dtype=np.int64)
    alo, ahi, blo, bhi, left = 0 * one, len(a) * one, 0 * one, len(b) * one, budget * one
    for level in range(depth, 65):
        # pairs of small nodes are compared directly: the buckets at the trie's end
        few = ((ahi - alo) * (bhi - blo) <= 64) if level < 64 else np.ones(len(alo), dtype=bool)
        if few.any():
            n, m = (ahi - alo)[few], (bhi - blo)[few]
            size = n * m
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = alo[few][owner] + place // m[owner], blo[few][owner] + place % m[owner]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            found_i.append(i[near])
            found_j.append(j[near])
            alo, ahi, blo, bhi, left = alo[~few], ahi[~few], blo[~few], bhi[~few], left[~few]
        if not len(alo):
            break
        shift = np.uint64(63 - level)
        a_ones = np.concatenate(([0], np.cumsum((a >> shift) & np.uint64(1)))).astype(np.int64)
        b_ones = np.concatenate(([0], np.cumsum((b >> shift) & np.uint64(1)))).astype(np.int64)
        amid = ahi - (a_ones[ahi] - a_ones[alo])
        bmid = bhi - (b_ones[bhi] - b_ones[blo])
        twin = (alo == blo) & (ahi == bhi) if same else np.zeros(len(alo), dtype=bool)
        paid = left > 0
        parts = [
            (alo, amid, blo, bmid, left, None), (amid, ahi, bmid, bhi, left, None),
            (alo, amid, bmid, bhi, left - 1, paid), (amid, ahi, blo, bmid, left - 1, paid & ~twin),
        ]
        kept = []
        for p in parts:
            keep = (p[1] > p[0]) & (p[3] > p[2])
            if p[5] is not None:
                keep &= p[5]
            kept.append([x[keep] for x in p[:5]])
        alo, ahi, blo, bhi, left = (np.concatenate([k[x] for k in kept]) for x in range(5))
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each of ``n`` positions reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while (root != root[root]).any():
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _walk_pairs(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            tab, d, err, same = (batch.column(c)[row].as_py() for c in ("tab", "depth", "err", "same"))
            a = np.sort(np.asarray(batch.column("fa")[row].values).view(np.uint64))
            b = a if same else np.sort(np.asarray(batch.column("fb")[row].values).view(np.uint64))
            # below two nodes the budget is what their prefixes have left of it, and only the bits below count
            low = np.uint64((1 << (64 - d)) - 1)
            i, j = walk(a & low, b & low, same, d, errors - err)
            if not len(i):
                continue
            every = a if same else np.concatenate([a, b])
            j = j if same else j + len(a)
            top = roots(len(every), i, j)
            moved = np.flatnonzero(top != np.arange(len(every)))
            pairs = np.stack([moved, top[moved]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), tab, np.int32)), *[pa.array(every[pairs[:, k]].view(np.int64)) for k in (0, 1)]], ["tab", "a", "b"])


def near_links(prints: DataFrame, errors: int = ERRORS, leaf: int = LEAF) -> DataFrame:
    """(tab, a, b) over the distinct rows (tab, fp) of ``prints``: one trie for each ``tab``.

    The links join exactly those fingerprints that chains of pairs with at most ``errors`` differing bits join.
    """
    spark = prints.sparkSession
    small_batches(spark, 200)
    zero = F.lit(0).cast("long")
    frontier = checkpointed(prints.groupBy("tab").agg(F.count(F.lit(1)).alias("na")).select(
        "tab", zero.alias("a"), zero.alias("b"), F.lit(0).alias("err"), "na", F.col("na").alias("nb")))
    depth, ready = 0, []
    while True:
        light = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb")) <= leaf
        done = frontier.filter(light)
        if not done.isEmpty():
            ready.append((depth, done))
        frontier = frontier.filter(~light)
        if depth == 64 or frontier.isEmpty():
            break
        step = min(STEP, 64 - depth)
        heavy = frontier.select("tab", "a").unionByName(frontier.select("tab", F.col("b").alias("a"))).distinct()
        nodes = (prints.select("tab", _prefix(depth).alias("a"), _prefix(depth + step).alias("child"))
                 .groupBy("tab", "a", "child").agg(F.count(F.lit(1)).alias("n")).join(heavy, ["tab", "a"], "left_semi"))
        xs = nodes.select("tab", "a", F.col("child").alias("ca"), F.col("n").alias("ma"))
        ys = nodes.select("tab", F.col("a").alias("b"), F.col("child").alias("cb"), F.col("n").alias("mb"))
        low = F.lit((1 << step) - 1).cast("long")
        differ = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(low))
        down = (frontier.join(xs, ["tab", "a"]).join(ys, ["tab", "b"]).withColumn("err", F.col("err") + differ)
                .filter((F.col("err") <= errors) & ((F.col("a") < F.col("b")) | (F.col("ca") <= F.col("cb")))))
        frontier = checkpointed(down.select("tab", F.col("ca").alias("a"), F.col("cb").alias("b"), "err",
                                            F.col("ma").alias("na"), F.col("mb").alias("nb")))
        depth += step
    if not ready:
        return spark.createDataFrame([], "tab int, a long, b long")
    out = None
    for at, pairs in ready:
        nodes = pairs.select("tab", "a").unionByName(pairs.select("tab", F.col("b").alias("a"))).distinct()
        blobs = (prints.select("tab", _prefix(at).alias("a"), "fp").join(nodes, ["tab", "a"], "left_semi")
                 .groupBy("tab", "a").agg(F.collect_list("fp").alias("fa")))
        own = pairs.filter("a = b").join(blobs, ["tab", "a"]).withColumn("fb", F.array().cast("array<bigint>"))
        cross = (pairs.filter("a <> b").join(blobs, ["tab", "a"])
                 .join(blobs.select("tab", F.col("a").alias("b"), F.col("fa").alias("fb")), ["tab", "b"]))
        part = own.unionByName(cross).select(
            "tab", F.lit(at).alias("depth"), "err", (F.col("a") == F.col("b")).alias("same"), "fa", "fb")
        out = part if out is None else out.unionByName(part)
    return out.mapInArrow(lambda batches: _walk_pairs(batches, errors), "tab int, a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    errors: int = ERRORS, leaf: int = LEAF) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits) and component_id.

    Documents whose fingerprints differ in at most ``errors`` bits are linked; ``component_id`` is the
    smallest id a document reaches over links, its own included (null only if all of them are null).  A text
    without words, null included, has fingerprint zero and is linked like any other; a text of fewer words
    than a shingle is one shingle.  Repeated rows give a row each.  An empty table gives no rows.
    """
    marks = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    prints = checkpointed(marks.groupBy("fp").agg(F.min("id").alias("first")))
    tree = components(near_links(prints.select(F.lit(0).alias("tab"), "fp"), errors, leaf).select("a", "b"))
    rooted = (prints.join(tree.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = checkpointed(rooted.join(least, "root").select("fp", "component_id"))
    return marks.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """``docs`` with one document of each group that ``near_duplicates`` finds: the one with the smallest id, a null id last.

    Of rows with that id in one group the one with the smallest SHA-256 of its text stays, and of rows that repeat id
    and text the one whose other columns sort first.  Columns stay as they are, whatever their names; an empty
    table gives no rows.
    """
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.sha2(whole(text_col), 256).alias("sha"))
    found = checkpointed(near_duplicates(docs.select(name.alias("name"), F.col(text_col).alias("text")), "name", "text", shingle, errors)
                         .select(F.col("name"), (F.col("name") != F.col("component_id")).alias("gone")))
    gone = found.filter("gone").select("name").distinct()
    again = found.filter("not gone").groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    rows = docs.select(name.alias("name"), as_row(docs)).join(gone, "name", "left_anti")
    once = rows.join(again, "name", "left_anti").select("row.*")
    return once.unionByName(rows.join(again, "name", "left_semi").groupBy("name").agg(F.min("row").alias("row")).select("row.*"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
