"""The star-schema order tables read as impressions, articles, histories and vectors.

An order is an impression of its customer, the distinct parts on its lines are the candidates in
view, and a returned line (flag ``R``) is a click.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise import schema as S
from slatewise.operators import skew
from slatewise.operators.longform import to_lists
from slatewise.operators.skew import (
    hot_keys,
    row_number_in_group,
    split_hot,
    tasks_for,
    top_n_in_group,
)
from slatewise.sources.tables import load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Star:
    """Views over one folder of parquet tables; footers and key statistics are read once per instance."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._catalog = {t: f"{folder}/{t}.parquet" for t in TABLES}
        self._tables: dict[str, DataFrame] = {}
        self._hot: dict[str, DataFrame | None] = {}
        self._counts: dict[str, int] = {}

    def table(self, name: str, *columns: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = load(self.spark, self._catalog, name)
        df = self._tables[name]
        return df.select(*columns) if columns else df

    def _rows(self, table: str) -> int:
        """Rows of a table, which the file footers tell."""
        if table not in self._counts:
            self._counts[table] = self.table(table).count()
        return self._counts[table]

    def _hot_of(self, table: str, column: str, name: str) -> DataFrame | None:
        if table not in self._hot:
            # a table of so few rows has no key with more
            few = self._rows(table) <= skew.HOT_ROWS
            hot = None if few else hot_keys(self.table(table, column), [column])
            self._hot[table] = hot.toDF(name) if hot is not None else None
        return self._hot[table]

    def hot_impressions(self) -> DataFrame | None:
        """Orders with too many lines for one task; reads one column."""
        return self._hot_of("lineitem", "l_orderkey", S.IMPRESSION)

    def hot_users(self) -> DataFrame | None:
        return self._hot_of("orders", "o_custkey", S.USER)

    def impressions(self) -> DataFrame:
        return self.table("orders", "o_orderkey", "o_custkey", "o_orderdate").toDF(S.IMPRESSION, S.USER, S.TIME)

    def _lines(self) -> DataFrame:
        return self.table("lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag").toDF(
            S.IMPRESSION, S.ARTICLE, "line", "quantity", "flag")

    def unslotted(self, hot: DataFrame | None) -> DataFrame:
        """Candidates without their slot.

        Lines are shuffled once on the order; grouping, the join and later per-impression windows
        all reuse that partitioning.  A line is rarely repeated, so combining before the shuffle
        would only cost.  The tasks grow in number with the lines, so that none grows in memory: without a
        number adaptive execution merges them up to a size of packed bytes, many times less than what the
        sorts and aggregates behind it hold.  A hot order's lines are instead grouped by (order, article), which
        spreads them, and meet the few hot orders by broadcast.
        """
        folded = [F.min("line").alias("raw_pos"),
                  F.max(F.when(F.col("flag") == "R", 1).otherwise(0)).alias(S.LABEL),
                  F.max("quantity").alias(S.READ_TIME)]
        lines, orders = self._lines(), self.impressions()
        if hot is None:
            return self._grouped(lines, folded).join(orders, S.IMPRESSION)
        cold, heavy = split_hot(lines, [S.IMPRESSION], hot)
        few = split_hot(orders, [S.IMPRESSION], hot)[1]
        spread = heavy.groupBy(S.IMPRESSION, S.ARTICLE).agg(*folded).join(F.broadcast(few), S.IMPRESSION)
        return self._grouped(cold, folded).join(orders, S.IMPRESSION).unionByName(spread)

    def _grouped(self, lines: DataFrame, folded: list) -> DataFrame:
        tasks = tasks_for(self.spark, self._rows("lineitem"))
        return lines.repartition(tasks, S.IMPRESSION).groupBy(S.IMPRESSION, S.ARTICLE).agg(*folded)

    def candidates(self) -> DataFrame:
        """(impression, user, time, article, label, read_time, pos), pos from 0 in line order."""
        hot = self.hot_impressions()
        numbered = row_number_in_group(self.unslotted(hot), [S.IMPRESSION], ["raw_pos", S.ARTICLE], S.POS, hot)
        return numbered.select(S.IMPRESSION, S.USER, S.TIME, S.ARTICLE, S.LABEL, S.READ_TIME,
                               (F.col(S.POS) - 1).alias(S.POS))

    def slotless(self) -> DataFrame:
        """Candidates for operators that do not look at slots: no ranking at all."""
        return self.unslotted(self.hot_impressions()).drop("raw_pos")

    def clicks(self) -> DataFrame:
        return self.candidates().filter(F.col(S.LABEL) == 1)

    def behaviors(self) -> DataFrame:
        """One row per impression with in-view and clicked lists; clicked is null without clicks,
        in-view empty for orders without lines."""
        packed = F.array_sort(F.collect_list(F.struct("raw_pos", S.ARTICLE, S.LABEL, S.READ_TIME)))
        folded = self.unslotted(self.hot_impressions()).groupBy(S.IMPRESSION).agg(packed.alias("__rows"))
        clicked = F.transform(F.filter("__rows", lambda r: r[S.LABEL] == 1), lambda r: r[S.ARTICLE])
        lists = folded.select(
            S.IMPRESSION,
            F.transform("__rows", lambda r: r[S.ARTICLE]).alias(S.INVIEW),
            F.when(F.size(clicked) > 0, clicked).alias(S.CLICKED),
            F.transform("__rows", lambda r: r[S.READ_TIME]).alias("read_times"))
        joined = self.impressions().join(lists, S.IMPRESSION, "left")
        return joined.withColumns({
            S.INVIEW: F.coalesce(S.INVIEW, F.array().cast("array<bigint>")),
            "read_times": F.coalesce("read_times", F.array().cast("array<double>"))})

    def shown(self) -> DataFrame:
        """Behaviors that have candidates."""
        return self.behaviors().filter(F.size(S.INVIEW) > 0)

    def recent_clicks(self, size: int) -> DataFrame:
        """Each user's last ``size`` clicks, ``rank`` 1 = latest."""
        order = [F.desc(S.TIME), F.desc(S.IMPRESSION), F.desc(S.POS)]
        return top_n_in_group(self.clicks(), [S.USER], order, size)

    def histories(self, size: int | None = None) -> DataFrame:
        """One row per user with the clicked articles, times and read times, oldest first; all of them,
        or the last ``size``."""
        columns = {S.ARTICLE: S.HISTORY_ARTICLES, S.TIME: S.HISTORY_TIMES, S.READ_TIME: S.HISTORY_READ_TIMES}
        if size is None:
            rows = self.clicks().withColumn("slot", F.struct(S.TIME, S.IMPRESSION, S.POS))
        else:
            rows = self.recent_clicks(size).withColumn("slot", -F.col("rank"))
        return to_lists(rows, [S.USER], columns, pos="slot")

    def articles(self) -> DataFrame:
        part = self.table("part", "p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
        return part.select(
            F.col("p_partkey").alias(S.ARTICLE), F.col("p_name").alias("title"), F.col("p_type").alias("category"),
            F.col("p_size").alias("size"), (F.col("p_size") % 5).alias("subcategory"),
            F.when(F.col("p_retailprice") > 1200, 1).otherwise(0).alias("premium"),
            F.col("p_retailprice").alias("total_pageviews"),
            ((F.col("p_size") % 11).cast("double") / F.lit(10.0)).alias("sentiment_score"))

    def embeddings(self) -> DataFrame:
        """(article_id, embedding): articles share vectors by id modulo the number of vectors."""
        vectors = self.table("embeddings", "vec_id", "embedding")
        count = self.table("embeddings", "vec_id").select(F.count(F.lit(1))).scalar()
        parts = self.table("part", "p_partkey").select(
            F.col("p_partkey").alias(S.ARTICLE), (F.col("p_partkey") % count).alias("vec_id"))
        return parts.join(vectors, "vec_id").select(S.ARTICLE, "embedding")

