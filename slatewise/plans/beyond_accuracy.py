"""Diversity, distribution, coverage, sentiment, serendipity and novelty of recommended lists.

Recommendations are long rows (list_id, pos, item); item attributes are a table keyed by item.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.functions import scalars, vectors
from slatewise.operators.aggregates import item_vector_means, item_vector_sums, normalized_distribution
from slatewise.operators.skew import global_row_number, large_keys, row_number_in_group, split_hot
from slatewise.schema import require_columns
from slatewise.session import checkpointed

LIST, ITEM = "list_id", "item"
PAIR_BLOCK = 256  # vectors of one cell where pairs are formed
PAIR_ROWS, PAIR_BYTES = 1 << 15, 1 << 24  # vectors of one cell where only the ends of all distances are asked, and their bytes as doubles


def _with_attribute(recs: DataFrame, attributes: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    require_columns(attributes, [ITEM, name])
    return recs.select(*keys, ITEM).join(attributes.select(ITEM, name), ITEM, "left")


def _normed(attributes: DataFrame, vector: str, *others: Column | str) -> DataFrame:
    """(item, __v, __norm, others...) of the items with a vector.

    The norm is taken once per item; the vector is scaled where it is added, as its own entries may be half as wide.
    """
    return attributes.filter(F.col(vector).isNotNull()).select(
        ITEM, F.col(vector).alias("__v"), vectors.norm(vector).alias("__norm"), *others)


def intralist_diversity(recs: DataFrame, attributes: DataFrame, vector: str = "embedding", keys: Sequence[str] = (LIST,),
                        distance: str | Callable[[Column, Column], Column] = "cosine", block: int = PAIR_BLOCK) -> DataFrame:
    """Mean pairwise distance of each list's known items; null when fewer than two are known.

    ``distance`` is a name or a function of two vector columns, of which two equal vectors must have none.
    Distances other than the cosine are added over pairs of cells of at most ``block`` vectors.
    For the cosine, with unit vectors u, the pairwise sum is n(n-1) + m - |sum u|^2 over n items of
    which m are non-zero: one vector sum per list and no pairs.
    """
    require_columns(attributes, [ITEM, vector])
    if distance != "cosine":
        return _pairwise_diversity(recs, attributes, vector, keys, distance, block)
    n, m = F.col("__n").cast("double"), F.coalesce("__m", F.lit(0)).cast("double")
    sums = item_vector_sums(recs.select(*keys, ITEM), _normed(attributes, vector), keys, ITEM, "__v", "left", name="__sum",
                            count="__n", others={"__m": F.count_if(F.col("__norm") > 0)}, norm="__norm")
    pairs = n * (n - 1)
    value = F.when(n > 1, F.try_divide(pairs + m - vectors.dot("__sum", "__sum"), pairs))
    return sums.select(*keys, value.alias("diversity"))


def _counted(rows: DataFrame, keys: Sequence[str], size: int) -> tuple[DataFrame, DataFrame]:
    """(keys..., item, __blocks) of the keys with at most ``size`` rows, and of the others."""
    slim = rows.select(*keys, ITEM)
    counts = slim.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("__blocks"))
    met = slim.join(counts, list(keys))
    return met.filter(F.col("__blocks") == 1), met.filter(F.col("__blocks") > 1)


def _whole_cells(rows: DataFrame, attributes: DataFrame, vector: str, keys: Sequence[str], name: str) -> DataFrame:
    """(keys..., name): the known vectors of keys that have few rows.  Vectors are shuffled once, and listed behind that."""
    known = attributes.filter(F.col(vector).isNotNull()).select(ITEM, F.col(vector).alias("__v"))
    first = rows.withColumn(f"{name}_block", F.col("__blocks") - 1)
    return first.join(known, ITEM).repartition(*keys).groupBy(*keys, f"{name}_block").agg(F.collect_list("__v").alias(name)).drop(f"{name}_block")


def _cut_cells(rows: DataFrame, attributes: DataFrame, vector: str, keys: Sequence[str], size: int, prefix: str) -> DataFrame:
    """(keys..., <prefix>_block, <prefix>_blocks, <prefix>): the known vectors of each key in cells of at most ``size``.

    ``rows`` has the number of blocks of each key.  Items are numbered within their key before the vectors join, so a
    key of any length is cut evenly.
    """
    numbered = row_number_in_group(rows, keys, [ITEM], "__n").withColumn(f"{prefix}_block", F.floor((F.col("__n") - 1) / size))
    known = attributes.filter(F.col(vector).isNotNull()).select(ITEM, F.col(vector).alias("__v"))
    own = [*keys, f"{prefix}_block"]
    return numbered.join(known, ITEM).repartition(*own).groupBy(*own).agg(
        F.first("__blocks").alias(f"{prefix}_blocks"), F.collect_list("__v").alias(prefix))


def _pair_sum(a: str, b: str, distance: str | Callable[[Column, Column], Column]) -> Column:
    """The distances of all vectors of cell ``a`` to all of cell ``b``, added."""
    def from_one(x: Column) -> Column:
        return F.aggregate(b, F.lit(0.0), lambda acc, y: acc + vectors.distance(distance, x, y))

    return F.aggregate(F.transform(a, from_one), F.lit(0.0), lambda acc, x: acc + x)


def _pairwise_diversity(recs: DataFrame, attributes: DataFrame, vector: str, keys: Sequence[str],
                        distance: str | Callable[[Column, Column], Column], size: int) -> DataFrame:
    # other distances need the pairs of a list: within the only cell of a short one; the cells of a long one meet
    # each other, each pair of them under a key of its own
    light, heavy = _counted(recs, keys, size)
    whole = _whole_cells(light, attributes, vector, keys, "__a").select(
        *keys, _pair_sum("__a", "__a", distance).alias("__sum"), F.size("__a").cast("long").alias("__n"))
    cells = _cut_cells(heavy, attributes, vector, keys, size, "__a")
    ahead = F.explode(F.sequence(F.col("__a_block"), F.col("__a_blocks") - 1))
    left = cells.select(*keys, F.col("__a_block").alias("__i"), ahead.alias("__j"), "__a")
    behind = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__a_block")))
    right = cells.select(*keys, behind.alias("__i"), F.col("__a_block").alias("__j"), F.col("__a").alias("__b"))
    apart = F.col("__i") < F.col("__j")
    sums = left.join(right, [*keys, "__i", "__j"]).select(
        *keys, (_pair_sum("__a", "__b", distance) + F.when(apart, _pair_sum("__b", "__a", distance)).otherwise(0.0)).alias("__sum"),
        F.when(~apart, F.size("__a")).otherwise(0).alias("__n"))
    met = sums.groupBy(*keys).agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    n = F.col("__n").cast("double")
    return recs.select(*keys).distinct().join(whole.unionByName(met), list(keys), "left").select(
        *keys, F.when(n > 1, F.try_divide("__sum", n * (n - 1))).alias("diversity"))


def random_subsets(candidates: DataFrame, draws: DataFrame, draw_key: str, n: int, seed: int) -> DataFrame:
    """(draw_key, pos, item): ``n`` distinct random candidates per draw.

    Floyd's algorithm picks the slots inside each row from hashes, so candidates and draws meet in
    an equi-join of n rows per draw instead of a cross product.
    """
    numbered = global_row_number(candidates.select(ITEM).distinct(), [ITEM], "__slot", start=0)
    size = numbered.count()
    if n > size:
        raise ValueError(f"cannot draw {n} of {size} candidates")

    def step(chosen: Column, i: Column) -> Column:
        top = F.lit(size - n) + i
        pick = F.pmod(F.xxhash64(F.lit(seed), F.col(draw_key), i), top + 1).cast("long")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, pick), top.cast("long")).otherwise(pick)))

    slots = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<bigint>"), step)
    drawn = draws.select(draw_key, F.posexplode(slots).alias("pos", "__slot"))
    return drawn.join(numbered, "__slot").select(draw_key, F.col("pos").cast("long").alias("pos"), ITEM)


def all_subsets(items: DataFrame, n: int) -> DataFrame:
    """(list_id, item): every ``n``-subset of the distinct items.

    Items are numbered and a subset lists its numbers upwards: each step appends, inside the row, every
    number above the last.  The numbers then meet the items in an equi-join of n rows per subset.
    """
    numbered = global_row_number(items.select(ITEM).distinct(), [ITEM], "__slot", start=0)
    size = numbered.count()
    if n > size:
        raise ValueError(f"subset size {n} exceeds the {size} known candidates")
    subsets = numbered.select(F.array("__slot").alias("__slots")) if n else numbered.limit(0).select(F.array("__slot").alias("__slots"))
    for k in range(1, n):
        last = F.element_at("__slots", -1)
        above = F.when(last + 1 <= size - n + k, F.sequence(last + 1, F.lit(size - n + k).cast("long")))
        subsets = subsets.select("__slots", F.explode(above).alias("__next")).select(F.concat("__slots", F.array("__next")).alias("__slots"))
    long = subsets.select(F.array_join("__slots", ",").alias(LIST), F.explode("__slots").alias("__slot"))
    return long.join(numbered, "__slot").select(LIST, ITEM)


def _known(candidates: DataFrame, attributes: DataFrame, vector: str) -> DataFrame:
    require_columns(attributes, [ITEM, vector])
    return candidates.select(ITEM).distinct().join(attributes.select(ITEM), ITEM, "left_semi")


def _ends_of_diversity(subsets: DataFrame, attributes: DataFrame, vector: str, distance) -> DataFrame:
    scored = intralist_diversity(subsets, attributes, vector, distance=distance)
    return scored.agg(F.min("diversity").alias("lowest"), F.max("diversity").alias("highest"))


def _ends_of_pairs(known: DataFrame, attributes: DataFrame, vector: str, distance: str) -> DataFrame:
    """Least and greatest distance of two items: cells of up to ``PAIR_ROWS`` vectors meet, each pair of them in one
    task, which multiplies their matrices.  No pair of items becomes a row, and a vector is sent, as it is, once to each cell."""
    rows = attributes.filter(F.col(vector).isNotNull()).join(known, ITEM, "left_semi")
    spark = known.sparkSession
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    # large cells send less; few items are cut into more of them, so that all cores have a pair
    cores = spark.sparkContext.defaultParallelism
    size = min(PAIR_ROWS, max(256, PAIR_BYTES // (8 * width)), max(2048, math.ceil(total / (2 * math.sqrt(cores)))))
    cells = max(1, -(-total // size))
    dealt = rows.select(F.pmod(F.xxhash64(ITEM), F.lit(cells)).cast("int").alias("cell"), F.col(vector).alias("v"))
    packed = dealt.groupBy("cell").agg(F.collect_list("v").alias("vs"))
    meet = F.transform(F.sequence(F.lit(0), F.lit(cells - 1)), lambda k: F.struct(F.least("cell", k).alias("i"), F.greatest("cell", k).alias("j")))
    met = packed.select(F.explode(meet).alias("p"), "cell", "vs").select("p.i", "p.j", "cell", "vs")
    met = met.repartition(max(cores, cells * (cells + 1) // 2), "i", "j").sortWithinPartitions("i", "j", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = x = None
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, cell = (batch.column(c)[k].as_py() for c in ("i", "j", "cell"))
                y = _stacked(batch.column("vs")[k].values, distance)
                if cell == i:
                    now, x = (i, j), y
                if cell != j or now != (i, j):  # the other cell has no vectors or is yet to come
                    continue
                ends = [e for at in range(0, len(x), 64) if (e := _ends_of_block(x[at:at + 64], y, at if i == j else None, distance))]
                if ends:
                    low, high = min(e[0] for e in ends), max(e[1] for e in ends)
                    yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high])], ["low", "high"])

    return met.mapInArrow(run, "low double, high double").agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))


def _stacked(lists: pa.ListArray, distance: str) -> np.ndarray:
    """The vectors as rows; for the cosine of length one, a zero vector stays zero."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    if distance != "cosine":
        return rows
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _ends_of_block(x: np.ndarray, y: np.ndarray, at: int | None, distance: str) -> tuple[float, float] | None:
    """Least and greatest distance of rows of x to rows of y; where x begins at row ``at`` of y, only to later ones."""
    if distance == "cosine":
        apart = 1.0 - x @ y.T
    else:
        apart = np.stack([np.linalg.norm(y - v, axis=1) for v in x])
    if at is not None:
        apart = apart[np.arange(len(y))[None, :] > at + np.arange(len(x))[:, None]]
    return (float(apart.min()), float(apart.max())) if apart.size else None


def candidate_diversity(candidates: DataFrame, attributes: DataFrame, n: int, vector: str = "embedding",
                        distance: str | Callable[[Column, Column], Column] = "cosine") -> DataFrame:
    """Lowest and highest diversity over all ``n``-subsets of the known candidates.

    Their number is a binomial coefficient; for many candidates ask ``sampled_candidate_diversity``.  Pairs, whose
    diversity is their distance, are not formed for the distances ``cosine`` and ``euclidean`` where all vectors are
    alike: of one length, without null entries, and one for each item.
    """
    known = _known(candidates, attributes, vector)
    if n == 2 and distance in ("cosine", "euclidean"):
        chosen = attributes.select(ITEM, vector).join(known, ITEM, "left_semi")
        size, least, most, gaps, named, rows = chosen.agg(
            F.count_distinct(ITEM), F.min(F.size(vector)), F.max(F.size(vector)),
            F.count_if(F.col(vector).isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))), F.count(ITEM), F.count(F.lit(1))).first()
        if size >= 2 and 0 < least == most and not gaps and size == named == rows:
            return _ends_of_pairs(known, attributes, vector, distance)
    return _ends_of_diversity(all_subsets(known, n), attributes, vector, distance)


def sampled_candidate_diversity(candidates: DataFrame, attributes: DataFrame, n: int, draws: int, vector: str = "embedding",
                                distance: str | Callable[[Column, Column], Column] = "cosine", seed: int = 0) -> DataFrame:
    """Lowest and highest diversity over ``draws`` random ``n``-subsets of the known candidates."""
    rows = candidates.sparkSession.range(draws).withColumnRenamed("id", LIST)
    subsets = random_subsets(_known(candidates, attributes, vector), rows, LIST, n, seed)
    return _ends_of_diversity(subsets, attributes, vector, distance)


def distribution(recs: DataFrame, attributes: DataFrame, name: str, is_list: bool = False) -> DataFrame:
    """Share of each attribute value over all recommended known items, list values flattened."""
    known = _with_attribute(recs, attributes, name, []).join(attributes.select(ITEM), ITEM, "left_semi")
    values = known.select(F.explode(name).alias("value")) if is_list else known.select(F.col(name).alias("value"))
    return normalized_distribution(values, "value")


def coverage(recs: DataFrame, catalog: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct items recommended, and their number over the catalogue's (-inf without one)."""
    counts = recs.select(*keys, ITEM).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("coverage_count"))
    if catalog is None:
        return counts.withColumn("coverage_fraction", F.lit(float("-inf")))
    total = catalog.select(F.count_distinct(ITEM).cast("double")).scalar()
    return counts.withColumn("coverage_fraction", F.try_divide(F.col("coverage_count").cast("double"), total))


def sentiment(recs: DataFrame, attributes: DataFrame, name: str, keys: Sequence[str] = (LIST,)) -> DataFrame:
    rows = _with_attribute(recs, attributes, name, keys)
    return rows.groupBy(*keys).agg(F.avg(name).alias("sentiment"))


def novelty(recs: DataFrame, attributes: DataFrame, name: str, keys: Sequence[str] = (LIST,)) -> DataFrame:
    """Mean -log2(popularity) per list over known items."""
    rows = _with_attribute(recs, attributes, name, keys)
    return rows.groupBy(*keys).agg(F.avg(scalars.self_information(name)).alias("novelty"))


def _ends(candidates: DataFrame, attributes: DataFrame, name: str, n: int) -> tuple[DataFrame, DataFrame]:
    require_columns(attributes, [ITEM, name])
    known = candidates.select(ITEM).join(attributes.select(ITEM, name), ITEM)
    return known.orderBy(F.asc(name), ITEM).limit(n), known.orderBy(F.desc(name), ITEM).limit(n)


def candidate_sentiment(candidates: DataFrame, attributes: DataFrame, name: str, n: int) -> DataFrame:
    """(mean of the n highest, mean of the n lowest)."""
    low, high = _ends(candidates, attributes, name, n)
    return high.agg(F.avg(name).alias("highest")).withColumn("lowest", low.select(F.avg(name)).scalar())


def candidate_novelty(candidates: DataFrame, attributes: DataFrame, name: str, n: int) -> DataFrame:
    """Novelty bounds: lowest from the n most popular, highest from the n least popular."""
    rare, common = _ends(candidates, attributes, name, n)
    info = F.avg(scalars.self_information(name))
    return common.agg(info.alias("lowest")).withColumn("highest", rare.select(info).scalar())


def mean_unit(rows: DataFrame, attributes: DataFrame, vector: str, keys: Sequence[str], name: str) -> DataFrame:
    """Mean unit vector of each group's known items."""
    require_columns(attributes, [ITEM, vector])
    return item_vector_means(rows.select(*keys, ITEM), _normed(attributes, vector), keys, ITEM, "__v", name, "__norm")


def _pairwise_serendipity(recs: DataFrame, history: DataFrame, attributes: DataFrame, vector: str, pairs: DataFrame, rec_key: str,
                          history_key: str, distance: str | Callable[[Column, Column], Column], size: int) -> DataFrame:
    """(rec_key, history_key, serendipity) of the pairs with known items on both sides.

    Where list and history have one cell each, the list's items go to the reader before they get their vectors, so
    each vector is shuffled once.  Longer ones, and readers of very many lists, meet cell by cell.  Ids of items are
    checkpointed, as every step begins with them; jobs run when this is called.
    """
    own = list(dict.fromkeys([rec_key, history_key]))
    known = attributes.filter(F.col(vector).isNotNull()).select(ITEM, F.col(vector).alias("__v"))
    listed, read = checkpointed(recs.select(rec_key, ITEM)), checkpointed(history.select(history_key, ITEM))

    def blocks(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))

    met = checkpointed(pairs.select(*own).distinct().join(blocks(listed, rec_key, "__r_blocks"), rec_key)
                       .join(blocks(read, history_key, "__h_blocks"), history_key))
    single = (F.col("__r_blocks") == 1) & (F.col("__h_blocks") == 1)
    light, many = split_hot(met.filter(single), [history_key], large_keys(met.filter(single), [history_key]))
    mine = (light.select(*own, (F.col("__r_blocks") - 1).alias("__r_block")).join(listed, rec_key).join(known, ITEM).repartition(history_key)
            .groupBy(*own, "__r_block").agg(F.collect_list("__v").alias("__r")))
    theirs = _whole_cells(_counted(read, [history_key], size)[0], attributes, vector, [history_key], "__h")
    value, n = _pair_sum("__r", "__h", distance).alias("__sum"), (F.size("__r") * F.size("__h").cast("long")).alias("__n")
    whole = mine.join(theirs, history_key).select(*own, value, n)

    rest = met.filter(~single).unionByName(many)
    if rest.isEmpty():
        return whole.select(*own, F.try_divide("__sum", "__n").alias("serendipity"))
    left = _cut_cells(listed.join(rest.select(rec_key, F.col("__r_blocks").alias("__blocks")).distinct(), rec_key),
                      attributes, vector, [rec_key], size, "__r")
    right = _cut_cells(read.join(rest.select(history_key, F.col("__h_blocks").alias("__blocks")).distinct(), history_key),
                       attributes, vector, [history_key], size, "__h")
    for key, prefix in ((rec_key, "__r"), (history_key, "__h")):
        rest = rest.withColumn(f"{prefix}_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{prefix}_blocks") - 1)))
    cut = (rest.select(*own, "__r_block", "__h_block").join(left.drop("__r_blocks"), [rec_key, "__r_block"])
           .join(right.drop("__h_blocks"), [history_key, "__h_block"]).select(*own, value, n))
    summed = cut.groupBy(*own).agg(F.sum("__sum").alias("__sum"), F.sum("__n").alias("__n"))
    return whole.unionByName(summed).select(*own, F.try_divide("__sum", "__n").alias("serendipity"))


def serendipity(recs: DataFrame, history: DataFrame, attributes: DataFrame, vector: str = "embedding",
                pairs: DataFrame | None = None, rec_key: str = LIST, history_key: str = LIST,
                distance: str | Callable[[Column, Column], Column] = "cosine", block: int = PAIR_BLOCK) -> DataFrame:
    """Mean distance between a list and its reader's history; null if either is unknown.

    For the cosine the mean over all item pairs is 1 - mean(u_R) . mean(u_H), so no pairs are formed.  Other
    distances (a name or a function of two vector columns) need them: lists and histories are cut into cells of at
    most ``block`` vectors, and each cell of a list meets each of its history under a key of its own.  ``pairs``
    maps lists to histories when they are not the same key.
    """
    if pairs is None:
        pairs = recs.select(rec_key).distinct()
    if distance != "cosine":
        means = _pairwise_serendipity(recs, history, attributes, vector, pairs, rec_key, history_key, distance, block)
        return pairs.join(means, list(dict.fromkeys([rec_key, history_key])), "left").select(*pairs.columns, "serendipity")
    left = mean_unit(recs, attributes, vector, [rec_key], "__r")
    right = mean_unit(history, attributes, vector, [history_key], "__h")
    both = pairs.join(left, rec_key, "left").join(right, history_key, "left")
    return both.select(*pairs.columns, (1 - vectors.dot("__r", "__h")).alias("serendipity"))


def report(baselines: Mapping[str, DataFrame], attributes: DataFrame, history: DataFrame,
           vector: str = "embedding", popularity: str = "popularity", sentiment_col: str = "sentiment_score",
           readers: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(baseline, metric, mean, std) for every named set of lists (list_id, pos, item).

    ``history`` is (reader, item); ``readers`` maps a baseline to its (list_id, reader) pairs, by
    default each list belongs to the reader of the same id.
    """
    keys = ["baseline", LIST]
    every = pairs = None
    for name, recs in baselines.items():
        part = recs.select(F.lit(name).alias("baseline"), F.col(LIST).cast("long").alias(LIST), ITEM)
        own = (readers or {}).get(name)
        if own is None:
            own = recs.select(LIST, F.col(LIST).alias("reader")).distinct()
        owned = own.select(F.lit(name).alias("baseline"), F.col(LIST).cast("long").alias(LIST),
                           F.col("reader").cast("long").alias("reader"))
        every = part if every is None else every.unionByName(part)
        pairs = owned if pairs is None else pairs.unionByName(owned)

    # every per-list number comes from one join with the item table and one aggregate
    require_columns(attributes, [ITEM, vector, popularity, sentiment_col])
    # (lists without a known item have no values and drop out here)
    items = _normed(attributes, vector, F.col(sentiment_col).alias("__sentiment"), scalars.self_information(popularity).alias("__info"))
    per_list = item_vector_sums(every, items, keys, ITEM, "__v", name="__sum", count="__n", norm="__norm", others={
        "__m": F.count_if(F.col("__norm") > 0), "sentiment": F.avg("__sentiment"), "novelty": F.avg("__info")})
    n = F.col("__n").cast("double")
    possible = n * (n - 1)
    spread = possible + F.col("__m") - vectors.dot("__sum", "__sum")
    per_list = per_list.withColumn("diversity", F.when(n > 1, F.try_divide(spread, possible)))

    means = item_vector_means(history.select("reader", ITEM), items.select(ITEM, "__v", "__norm"), ["reader"], ITEM, "__v", "__h", "__norm")
    closeness = F.try_divide(vectors.dot("__sum", "__h"), n)
    surprise = pairs.join(per_list.select(*keys, "__n", "__sum"), keys, "left").join(means, "reader", "left").select(
        "baseline", (1 - closeness).alias("serendipity"))
    cover = coverage(every, attributes, ["baseline"])

    def summary(df: DataFrame, names: Sequence[str]) -> DataFrame:
        stats = [f(c).alias(f"{c}_{k}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
        rows = F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"))
            for c in names]))
        return df.groupBy("baseline").agg(*stats).select("baseline", rows.alias("r")).select("baseline", "r.*")

    counts = cover.select("baseline", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("mean"), F.lit(0.0).alias("std"))
        for c in ("coverage_count", "coverage_fraction")])).alias("r")).select("baseline", "r.*")
    return (summary(per_list, ["diversity", "sentiment", "novelty"])
            .unionByName(summary(surprise, ["serendipity"])).unionByName(counts))
