"""Mixing sources to target weights by pivotal dependent rounding.

A source that is to supply ``r`` times its size copies each of its documents floor(r) times, and once more
with probability frac(r).  Which documents get the extra copy is settled by duels.  Two fractional
probabilities meet, and mass, counted in words, moves from one to the other at random until one of them is
0 or 1; the other goes on.  A draw is fair (the expected change is nothing) and a move keeps the sum of
words, so a source's words end within one document of its target.

The duels run in a reduction tree.  Documents of a source are dealt to blocks of about ``BLOCK``, where the
long ones meet first; a block leaves at most one fraction, which moves up; ``FAN`` blocks meet in the next
one, and so on.  A hot source has more blocks, not larger ones.  Masses are whole numbers and every draw is
a hash of the seed and the two documents, so a rerun gives the same copies whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise.llm.common import as_row, checkpointed, table, whole, word_count
from slatewise.operators.skew import global_row_number

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240229
BLOCK = 64
FAN = 64
WORD = 1 << 20  # the mass of a word


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes; a target
    stops at ``cap`` times its source's size, and what is over is shared again by weight until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_row_number(totals.withColumn("last", F.col("source").isNull()), ["last", "source"], "rank", 0)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = checkpointed(ranked.select("source", "source_size", turn.alias("weight")))
    limit, level, stopped = F.col("source_size") * float(cap), 0.0, -1
    while True:
        over = F.col("weight") * level > limit
        total, held, free, count = ranked.agg(
            F.sum("source_size"), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("int"))).first()
        if not total or not free or count == stopped:
            break
        level, stopped = (total - (held or 0.0)) / free, count
    return ranked.select("source", "source_size", F.least(F.col("weight") * level, limit).alias("target"))


def _item(x: Column, mass: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("size", "hash", "id", "nth")], mass.alias("mass"))


def _is_open(x: Column) -> Column:
    return (x["mass"] > 0) & (x["mass"] < x["size"] * WORD)


def _duels(items: Column) -> Column:
    """Fold a sorted array of items with fractional mass into (open: the last fraction, done: settled items).

    ``open`` is itself settled when nothing is left open.
    """
    def meet(state: Column, b: Column) -> Column:
        a, done = state["open"], state["done"]
        up = F.least(a["size"] * WORD - a["mass"], b["mass"])  # what can move from b to a
        down = F.least(a["mass"], b["size"] * WORD - b["mass"])  # and from a to b
        draw = F.pmod(F.xxhash64(F.lit(SEED), a["hash"], b["hash"], a["nth"], b["nth"]), up + down)
        moved = F.when(draw < down, up).otherwise(-down)
        a2, b2 = _item(a, a["mass"] + moved), _item(b, b["mass"] - moved)
        after = (F.when(_is_open(a2), F.struct(a2.alias("open"), F.concat(done, F.array(b2)).alias("done")))
                 .otherwise(F.struct(b2.alias("open"), F.concat(done, F.array(a2)).alias("done"))))
        none = F.struct(_item(b, b["mass"]).alias("open"), F.concat(done, F.array(a)).alias("done"))
        return F.when(_is_open(a), after).otherwise(none)

    first = F.get(items, F.lit(0))
    nothing = F.slice(F.transform(items, lambda x: _item(x, x["mass"])), 1, 0)
    start = F.struct(_item(first, first["mass"]).alias("open"), nothing.alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items) - 1), start, meet)


def extra_copies(items: DataFrame) -> DataFrame:
    """(source, id, size, nth): which of ``items`` (source, id, size, nth, hash, mass) get one more copy.

    ``mass`` is the fraction of a copy in units of 1/``WORD`` word, strictly between none and all.
    """
    level = items.select("source", F.struct("size", "hash", "id", "nth", "mass").alias("item"))
    largest = level.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(1, -(-largest // BLOCK))
    level = level.withColumn("block", F.pmod(F.col("item.hash"), F.lit(blocks)))
    settled = []
    while True:
        met = level.groupBy("source", "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = checkpointed(met.select("source", "block", _duels(F.col("items")).alias("fold")))
        settled.append(folded.select("source", F.explode("fold.done").alias("item")))
        last = folded.select("source", F.floor(F.col("block") / FAN).alias("block"), F.col("fold.open").alias("item"))
        settled.append(last.filter(~_is_open(F.col("item"))).select("source", "item"))
        level = last.filter(_is_open(F.col("item")))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN)
    # a source's last fraction is drawn
    whole_copy = F.col("item.size") * WORD
    luck = F.pmod(F.xxhash64(F.lit(SEED), F.col("item.hash"), F.col("item.nth")), whole_copy) < F.col("item.mass")
    settled.append(level.select("source", _item(F.col("item"), F.when(luck, whole_copy).otherwise(F.lit(0).cast("long"))).alias("item")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.filter(F.col("item.mass") > 0).select("source", "item.id", "item.size", "item.nth")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies, taken, nth.

    ``size`` counts the words of the whole text (null: 0), ``taken`` is copies times size.  A null source is a
    source.  Rows that agree in id, source and size are told apart by ``nth``.  A source without words has
    target 0; an empty table gives no rows.
    """
    counted = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(whole(text_col)).alias("size"))
    rows = checkpointed(counted.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("times")))
    targets = checkpointed(source_targets(rows.select("source", (F.col("size") * F.col("times")).alias("size")), weights, cap))
    t = targets.withColumnRenamed("source", "source2")
    wide = rows.join(t, rows["source"].eqNullSafe(t["source2"])).drop("source2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wide = wide.withColumn("rate", rate).withColumn("base", F.least(F.floor("rate"), F.lit(cap)).cast("long"))
    part = F.when(F.col("base") >= cap, 0.0).otherwise(F.col("rate") - F.col("base"))
    every = (wide.withColumn("mass", F.floor(part * F.col("size") * float(WORD)).cast("long"))
             .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))))
    every = checkpointed(every.select("id", "source", "size", "source_size", "target", "base", "mass", "nth"))
    duel = (every.filter((F.col("mass") > 0) & (F.col("mass") < F.col("size") * WORD))
            .withColumn("hash", F.xxhash64(F.lit(seed), "id", "source", "size", "nth")))
    extra = extra_copies(duel.select("source", "id", "size", "nth", "hash", "mass"))
    chosen = extra.select(*[F.col(c).alias(f"{c}2") for c in ("source", "id", "size", "nth")], F.lit(1).cast("long").alias("extra"))
    same = ((every["nth"] == chosen["nth2"]) & (every["size"] == chosen["size2"])
            & every["id"].eqNullSafe(chosen["id2"]) & every["source"].eqNullSafe(chosen["source2"]))
    copies = F.col("base") + F.coalesce("extra", F.lit(0))
    return every.join(chosen, same, "left").select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), "nth")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents the mix takes: all their columns, and size, source_size, target, copies (1 or more) and taken.

    A column of ``docs`` with one of these names gives way to the added one.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    parts = lambda size: F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), F.coalesce(
        F.col(source_col).cast("string"), F.lit("\x01")), size.cast("string")).alias("key")
    dealt = mix(docs, id_col, text_col, source_col, **options)
    dealt = dealt.groupBy(parts(F.col("size"))).agg(F.sort_array(F.collect_list(F.struct("nth", *added))).alias("dealt"))
    rows = docs.select(parts(word_count(whole(text_col))), F.xxhash64(whole(text_col)).alias("order"), as_row(docs))
    # rows that agree in id, source and size are numbered; their key is the join's, so this shuffles nothing
    nth = F.row_number().over(W.partitionBy("key").orderBy("order"))
    one = rows.join(dealt, "key").withColumn("one", F.element_at("dealt", nth))
    kept = [c for c in docs.columns if c not in added]
    return one.filter("one.copies > 0").select(*[F.col("row").getField(c).alias(c) for c in kept], *[F.col(f"one.{c}") for c in added])


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")
