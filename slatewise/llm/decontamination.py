"""Benchmark decontamination: find the n-word windows of test items in training texts, verify, remove.

The windows of all items, one row per distinct window, form a hash set.  A document's text is cut into
words once; each of its windows is probed by a 64-bit hash, hits are verified word by word, and only hits
and one row per document leave the scan.  While the set is within ``broadcast_windows`` rows (counted, not
assumed) every task holds it; a larger set is shuffled on the hash instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from slatewise.llm.common import as_row, ascii_lower, checkpointed, table, whole

WINDOW = 10
# A window of ten words is some hundred bytes, so a broadcast set stays under about 50 MB.
BROADCAST_WINDOWS = 200_000
# Fixed value: what separates words once A-Z are lower-cased (all of ASCII but digits and a-z).
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same with A-Z still in place, and what a word is then.
RAW_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def with_words(df: DataFrame, keys: list[str], text_col: str, name: str = "w") -> DataFrame:
    """``keys`` and the normalised words of the text as an array; no words for null."""
    parts = df.select(*keys, F.split(ascii_lower(whole(text_col)), BREAK).alias("__p"))
    # a separator at either end leaves an empty string there, and nowhere else
    first = (F.get("__p", F.lit(0)) == "").cast("int")
    last = (F.get("__p", F.size("__p") - 1) == "").cast("int")
    return parts.select(*keys, F.slice("__p", first + 1, F.greatest(F.size("__p") - first - last, F.lit(0))).alias(name))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """(item, window): every window of ``n`` words; a shorter item that has words is one window."""
    cut = with_words(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), ["item"], "text")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0)))
    return (cut.filter(F.size("w") > 0)
            .select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, n))).alias("window"))
            .distinct())


def window_hits(docs: DataFrame, windows: DataFrame, keys: list[str], text_col: str = "text", n: int = WINDOW,
                broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Scan ``docs`` for ``windows``: one row per verified hit, and one row with null ``start`` per document.

    Gives (keys..., n_words, start, len, window): the window starts at word ``start`` and has ``len`` words.
    """
    known = checkpointed(windows.select("window").distinct().withColumn("len", F.size("window")))
    lengths = sorted(r[0] for r in known.select("len").distinct().collect()) or [n]  # at most n values
    small = known.limit(broadcast_windows + 1).count() <= broadcast_windows
    known = known.select("len", "window", F.xxhash64(
        "len", *[F.coalesce(F.get("window", F.lit(i)), F.lit("")) for i in range(n)]).alias("key"))
    # position -1 carries the document itself through the scan
    scan = (with_words(docs, keys, text_col).select(*keys, "w", F.size("w").alias("n_words"))
            .select(*keys, "w", "n_words", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("at")))
    if len(lengths) == 1:
        scan = scan.withColumn("size", F.lit(lengths[0]))
    else:
        every = F.array(*[F.lit(x) for x in lengths])
        scan = scan.withColumn("size", F.explode(F.when(F.col("at") < 0, F.array(F.lit(n))).otherwise(every)))
    word = lambda i: F.when(F.col("size") > i, F.get("w", F.col("at") + i)).otherwise("")
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n_words"))
    probe = scan.withColumn("key", F.when(fits, F.xxhash64("size", *[word(i) for i in range(n)])))
    joined = probe.join(F.broadcast(known) if small else known, "key", "left")
    # a hash that agrees is verified word by word
    same = F.slice("w", F.col("at") + 1, F.col("size")) == F.col("window")
    hits = joined.filter((F.col("at") < 0) | F.col("window").isNotNull() & same)
    return hits.select(*keys, F.col("n_words").cast("long"), F.when(F.col("at") >= 0, F.col("at")).alias("start"), "len", "window")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", n: int = WINDOW,
                  broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A word inside any occurrence of an item's window is hit; ``spans`` lists the hit stretches of words as
    (first, last), counted from 0, merged where they overlap.  A null text has no words and a document
    without hits has the hash of the empty list.  Rows that repeat an id and a text give a row each; a null
    id is an id.  Items without words match nothing; an empty table of items leaves every document clean.
    """
    windows = checkpointed(item_windows(items, item_id, item_text, n))
    source = docs.select(F.col(id_col).alias("id"), F.sha2(whole(text_col), 256).alias("digest"), F.col(text_col).alias("text"))
    hits = checkpointed(window_hits(source, windows, ["id", "digest"], "text", n, broadcast_windows))
    base = hits.filter("start is null").groupBy("id", "digest", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    places = hits.filter("start is not null").select("id", "digest", "start", "len", "window").distinct()
    # words covered by the hits of a document, counted as the part of each that no earlier one covers
    within = W.partitionBy("id", "digest").orderBy("start", "end")
    before = within.rowsBetween(W.unboundedPreceding, -1)
    runs = (places.select("id", "digest", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
            .withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(-1)))
            .withColumn("run", F.sum((F.col("start") > F.col("upto")).cast("int")).over(within)))
    spans = (runs.groupBy("id", "digest", "run").agg(
                 F.min("start").alias("first"), (F.max("end") - 1).alias("last"),
                 F.sum(F.greatest(F.col("end") - F.greatest("start", "upto"), F.lit(0))).alias("covered"))
             .groupBy("id", "digest").agg(F.sum("covered").alias("n_hit"),
                                          F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")))
    found = (places.select("id", "digest", "window").distinct().join(windows, "window")
             .groupBy("id", "digest").agg(F.sort_array(F.collect_set("item")).alias("items")))
    per_text = _same_key(spans, found)
    wide = _same_key(base, per_text, "left")
    copies = wide.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copies.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), "digest",
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>")).alias("spans"))


def _same_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (id, digest) where a null id equals a null id."""
    r = right.withColumnRenamed("id", "id2").withColumnRenamed("digest", "digest2")
    return left.join(r, (left["digest"] == r["digest2"]) & left["id"].eqNullSafe(r["id2"]), how).drop("id2", "digest2")


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of them.

    Cutting a span removes its words and the separators before each of them; the rest of the text is kept
    character by character.  Clean documents stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    bad = (contamination(docs, items, id_col, text_col, **options).filter("contaminated")
           .select(F.col(id_col).alias("id"), "digest", "spans").dropDuplicates(["id", "digest"]))
    tagged = docs.select(F.col(id_col).alias("id"), F.sha2(whole(text_col), 256).alias("digest"), as_row(docs))
    b = bad.withColumnRenamed("id", "id2").withColumnRenamed("digest", "digest2")
    same = (tagged["digest"] == b["digest2"]) & tagged["id"].eqNullSafe(b["id2"])
    if remove == "documents":
        return tagged.join(b, same, "left_anti").select("row.*")
    joined = tagged.join(b, same, "left")
    text = whole(F.col("row").getField(text_col))
    pieces = F.regexp_extract_all(text, F.lit(f"{RAW_BREAK}*{RAW_WORD}+"), F.lit(0))
    hit = lambda i: F.exists("spans", lambda s: (s["first"] <= i) & (i <= s["last"]))
    rest = F.regexp_extract(text, f"({RAW_BREAK}*)\\z", 1)
    cut = F.concat(F.array_join(F.filter(pieces, lambda _, i: ~hit(i)), ""), rest)
    fields = [F.when(F.col("spans").isNotNull(), cut).otherwise(F.col("row").getField(c)).alias(c) if c == text_col
              else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*fields)


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans", "digest")


SQL = r"""
with cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bench as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
wins as (
  select distinct item, array_to_string(w[i:i + 9], ' ') as win, least(len(w), 10) as size
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from bench where len(w) > 0)),
sizes as (select distinct size from wins),
spots as (
  select doc_id, spot, size, array_to_string(w[spot:spot + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as spot from cut cross join sizes where len(w) >= size)),
hits as (select doc_id, spot, spots.size, item from spots join wins using (win) where wins.size = spots.size),
covered as (select doc_id, count(distinct p) as n_hit
            from (select doc_id, unnest(range(spot, spot + size)) as p from (select distinct doc_id, spot, size from hits)) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from cut left join covered using (doc_id) left join named using (doc_id)
"""
