"""The least and most diverse subsets of a set of items, by branch and bound over a tree of cells.

The items start as one cell.  Level by level a cell is split in two, along the line from its centre to its
farthest item.  A pattern says how many items a subset takes from which cells; centres and radii bound the
distances between any items of two cells, and so the diversity of every subset that fits a pattern.  Patterns
that can hold neither the least nor the greatest value go no further, and items that are in no pattern are left
out of the next level, so most subsets are never formed.  Cells, items and patterns are tables; a task only
bounds the patterns it has, each a row of as many cells as a subset has items.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions import vectors
from slatewise.operators.aggregates import vector_means
from slatewise.schema import require_columns
from slatewise.session import checkpointed

ITEM = "item"
POINT = 1e-12  # a cell of this radius is not split
SLACK = 1e-9  # of bounds, for rounding

PATTERNS = "cells array<string>, done boolean, low double, high double"


def pair_bounds(centers: np.ndarray, radii: np.ndarray, distance: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean pairwise distance of patterns: ``centers`` (patterns, n, dimensions), ``radii`` (patterns, n)."""
    n = centers.shape[1]
    i, j = np.triu_indices(n, 1)
    if distance == "cosine":  # of unit or zero vectors: one less their product
        size = np.linalg.norm(centers, axis=2)
        middle = 1 - np.einsum("pid,pid->pi", centers[:, i], centers[:, j])
        around = size[:, i] * radii[:, j] + size[:, j] * radii[:, i] + radii[:, i] * radii[:, j]
        low, high = np.maximum(middle - around, 0.0), np.minimum(middle + around, 2.0)
        exact = around == 0
        low, high = np.where(exact, middle, low), np.where(exact, middle, high)
    else:
        middle = np.linalg.norm(centers[:, i] - centers[:, j], axis=2)
        around = radii[:, i] + radii[:, j]
        low, high = np.maximum(middle - around, 0.0), middle + around
    return low.mean(axis=1), high.mean(axis=1)


def _bounded(batches: Iterator[pa.RecordBatch], distance: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            parts = sorted(parts, key=lambda p: p["at"])
            names = [p["cell"] for p in parts]
            if all(names.count(p["cell"]) <= p["size"] for p in parts):
                out.append((names, [p["center"] for p in parts], [p["radius"] for p in parts]))
        if out:
            names, centers, radii = zip(*out)
            radii = np.array(radii)
            low, high = pair_bounds(np.array(centers), radii, distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(names), pa.list_(pa.string())), pa.array((radii <= POINT).all(axis=1)), pa.array(low), pa.array(high)],
                ["cells", "done", "low", "high"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The patterns of the next level: each item of a cell that is split goes to one of its halves."""
    for b in batches:
        for cells, split in zip(b.column("cells").to_pylist(), b.column("split").to_pylist()):
            found = []
            for sides in itertools.product(*[("0", "1") if s else ("",) for s in split]):
                # items of one cell change places without making another subset
                if all(cells[k] != cells[k + 1] or sides[k] <= sides[k + 1] for k in range(len(cells) - 1)):
                    found.append([c + s for c, s in zip(cells, sides)])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["cells"])


def _cells(items: DataFrame) -> DataFrame:
    """(cell, center, radius, far, size) of (item, cell, v)."""
    centers = vector_means(items.select("cell", "v"), ["cell"], "v", "center")
    gap = F.zip_with("v", "center", lambda x, y: x - y)
    return (items.join(centers, "cell").withColumn("r", vectors.norm(gap))
            .groupBy("cell").agg(F.first("center").alias("center"), F.max("r").alias("radius"),
                                 F.max_by("v", F.struct("r", ITEM)).alias("far"), F.count(F.lit(1)).alias("size"))
            .withColumn("radius", F.when(F.col("size") == 1, 0.0).otherwise(F.col("radius"))))


def _of_cells(patterns: DataFrame, cells: DataFrame, distance: str) -> DataFrame:
    """The patterns with their bounds; those that ask a cell for more items than it has are left out."""
    parts = patterns.select(F.array_join("cells", ",").alias("key"), F.posexplode("cells").alias("at", "cell"))
    met = parts.join(cells.select("cell", "center", "radius", "size"), "cell")
    folded = met.groupBy("key").agg(F.collect_list(F.struct("at", "cell", "center", "radius", "size")).alias("parts"))  # as many as a subset has items
    return folded.mapInArrow(lambda b: _bounded(b, distance), PATTERNS)


def diversity_bounds(candidates: DataFrame, attributes: DataFrame, n: int, vector: str = "embedding", distance: str = "cosine") -> DataFrame:
    """One row (lowest, highest, patterns): exact bounds of the diversity over all ``n``-subsets of the candidates with a vector.

    ``distance`` is ``cosine`` or ``euclidean``; ``patterns`` counts the bounded patterns of all levels.  A subset of
    fewer than two items has no diversity (null); with fewer candidates than ``n`` this is an error.
    """
    if distance not in ("cosine", "euclidean"):
        raise ValueError(f"no bounds for the distance {distance!r}")
    require_columns(attributes, [ITEM, vector])
    spark = candidates.sparkSession
    known = attributes.filter(F.col(vector).isNotNull()).select(ITEM, F.col(vector).alias("v"))
    known = known.withColumn("v", vectors.unit("v") if distance == "cosine" else F.transform("v", lambda x: x.cast("double")))
    items = checkpointed(candidates.select(ITEM).distinct().join(known, ITEM).withColumn("cell", F.lit("r")))
    total = items.count()
    if n > total:
        raise ValueError(f"subset size {n} exceeds the {total} known candidates")
    if n < 2:
        return spark.createDataFrame([(None, None, 0)], "lowest double, highest double, patterns long")
    cells = checkpointed(_cells(items))
    patterns = spark.createDataFrame([(["r"] * n,)], "cells array<string>")
    visited = 0
    while True:
        bounded = checkpointed(_of_cells(patterns, cells, distance))
        count, least, most = bounded.agg(F.count(F.lit(1)), F.min("high"), F.max("low")).first()
        visited += count
        bounded = bounded.filter((F.col("low") <= least + SLACK) | (F.col("high") >= most - SLACK))
        if bounded.filter("not done").isEmpty():
            return bounded.agg(F.min("low").alias("lowest"), F.max("high").alias("highest")).withColumn("patterns", F.lit(visited).cast("long"))
        used = bounded.select(F.explode("cells").alias("cell")).distinct()
        splits = cells.join(used, "cell").select("cell", "center", "far", (F.col("radius") > POINT).alias("split"))
        side = vectors.dot(F.zip_with("v", "center", lambda x, y: x - y), F.zip_with("far", "center", lambda x, y: x - y)) > 0
        items = checkpointed(items.join(splits, "cell").select(ITEM, "v", F.when(
            F.col("split"), F.concat("cell", F.when(side, "1").otherwise("0"))).otherwise(F.col("cell")).alias("cell")))
        # which cells of a pattern are split: as many look-ups as a subset has items
        flags = (bounded.select("cells", F.posexplode("cells").alias("at", "cell")).join(splits.select("cell", "split"), "cell")
                 .groupBy("cells").agg(F.array_sort(F.collect_list(F.struct("at", "split"))).alias("s")))
        patterns = flags.select("cells", F.transform("s", lambda x: x["split"]).alias("split")).mapInArrow(_children, "cells array<string>")
        cells = checkpointed(_cells(items))
