"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed size.  The distinct blocks are sorted, and a block's place in that
order is its integer name.  Names of adjacent blocks are then paired, the distinct pairs sorted and named
the same way, and so on until each text has a single name.  Equal names mean equal texts: only contents
and pairs of names are ever compared, never hashes, so there are no collisions.

Cost: the text is shuffled twice (distinct blocks, and every block to its name); all later rounds move
three integers a block, and there are log2(blocks of the longest text) of them.  A content that very many
documents share is one row per map task on the naming side, and on the other side a skewed join, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.llm.common import SPACE, as_row, checkpointed, table, whole

BLOCK_CHARS = 4096


def normalised(text: str | Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(whole(text), SPACE, " ")


def _named(rows: DataFrame, content: list[str], name: str) -> DataFrame:
    """``rows`` with the integer name of their ``content``; the content columns (never null) are dropped.

    Sorting inside the partitions makes the names the same when a lost partition is computed again.
    """
    names = (rows.select(*content).distinct().sortWithinPartitions(*content)
             .withColumn(name, F.monotonically_increasing_id()))
    return rows.join(names, content).drop(*content)


def text_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, digest, blocks, name, copies): one row per id and text; equal (blocks, name) mean equal texts.

    ``digest`` is the SHA-256 of the normalised text; it only tells apart rows that share an id.
    ``copies`` counts the rows with this id and text.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    cut = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    blocks = (text.select("id", F.unhex(F.sha2("text", 256)).alias("digest"), cut.alias("cut"))
              .select("id", "digest", F.size("cut").cast("long").alias("blocks"), F.posexplode("cut").alias("pos", "block")))
    rows = checkpointed(_named(blocks, ["block"], "name"))
    longest = rows.agg(F.max("blocks")).first()[0] or 0
    key = ["id", "digest", "blocks"]
    first = F.count(F.when(F.col("pos") == 0, 1)).alias("copies")
    done = rows.filter("blocks = 1").groupBy(*key, "name").agg(first)
    if longest <= 1:
        return done
    many = rows.filter("blocks > 1")
    copies = many.groupBy(*key).agg(first).withColumnRenamed("id", "id2")
    width = longest
    while width > 1:
        width = -(-width // 2)
        side = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(-1))
        pairs = (many.groupBy(*key, F.floor(F.col("pos") / 2).alias("pos"))
                 .agg(side(0).alias("left"), side(1).alias("right")))
        many = checkpointed(_named(pairs, ["left", "right"], "name"))
    same = many["id"].eqNullSafe(copies["id2"]) & (many["digest"] == copies["digest"])
    joined = many.join(copies.drop("blocks"), same).drop("id2", "pos").drop(copies["digest"])
    return done.unionByName(joined)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after white-space runs become one space; a null text counts as empty.  The
    row with the smallest id stays (a null id only if the group has no other).  Of rows that repeat both id
    and text one is kept.  An empty table gives no rows; other columns, whatever their names, are not read.
    """
    names = checkpointed(text_names(docs, id_col, text_col, block_chars))
    # checkpointed, so that the join below shuffles both sides and a hot name can be split
    groups = checkpointed(names.groupBy("blocks", "name").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")))
    every = names.join(groups, ["blocks", "name"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return every.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Of rows that repeat id and text, the one whose other columns sort first stays.
    """
    kept = exact_duplicates(docs, id_col, text_col, block_chars).filter("kept")
    # one string tells id and text, so that the join and the grouping share one shuffle
    key = lambda digest: F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), digest).alias("key")
    rows = docs.select(key(F.sha2(normalised(text_col), 256)), as_row(docs))
    chosen = rows.join(kept.select(key(F.col("text_sha256"))), "key", "left_semi")
    return chosen.groupBy("key").agg(F.min("row").alias("row")).select("row.*")


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
       row_number() over (partition by body order by doc_id) = 1 as kept, sha256(body) as text_sha256
from d window g as (partition by body)
"""
