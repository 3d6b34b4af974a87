"""Registration of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatewise.session import configure
from slatewise.sources.star import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The same views the Star class builds, in SQL.
VIEWS = """
with br_candidates as (
  select impression_id, user_id, impression_time, article_id, label, read_time,
         cast(row_number() over (partition by impression_id order by raw_pos, article_id) - 1 as bigint) as pos
  from (select o_orderkey as impression_id, o_custkey as user_id, o_orderdate as impression_time,
               l_partkey as article_id, min(l_linenumber) as raw_pos,
               max(case when l_returnflag = 'R' then 1 else 0 end) as label, max(l_quantity) as read_time
        from orders join lineitem on o_orderkey = l_orderkey
        group by o_orderkey, o_custkey, o_orderdate, l_partkey) g),
br_clicks as (select * from br_candidates where label = 1),
br_long as (select *, read_time / 50.0 as score from br_candidates),
br_articles as (
  select p_partkey as article_id, p_name as title, p_type as category, p_size as size, p_size % 5 as subcategory,
         case when p_retailprice > 1200 then 1 else 0 end as premium, p_retailprice as total_pageviews,
         cast(p_size % 11 as double) / 10 as sentiment_score
  from part),
br_vectors as (
  select article_id, cast(embedding as double[]) as embedding
  from (select p_partkey as article_id, p_partkey % (select count(*) from embeddings) as k from part) p
  join embeddings on vec_id = k),
br_lists as (
  select impression_id, list(article_id order by pos) as inview,
         list(article_id order by pos) filter (where label = 1) as clicked,
         list(read_time order by pos) as reads, list(label order by pos) as labels
  from br_candidates group by impression_id),
br_behaviors as (
  select o_orderkey as impression_id, o_custkey as user_id, o_orderdate as impression_time,
         coalesce(inview, cast([] as bigint[])) as inview, clicked,
         coalesce(reads, cast([] as double[])) as reads, coalesce(labels, cast([] as integer[])) as labels
  from orders left join br_lists on o_orderkey = impression_id),
br_history as (
  select user_id, list(article_id order by impression_time, impression_id, pos) as articles,
         list(impression_time order by impression_time, impression_id, pos) as times,
         list(read_time order by impression_time, impression_id, pos) as reads
  from br_clicks group by user_id)
"""


def uniform(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions as doubles at six places, so both engines can be compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(star) -> DataFrame`` as ``name``; ``views`` are further SQL views before ``sql``."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return uniform(fn(Star(configure(spark), folder)))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = VIEWS + (", " + views if views else "") + sql
        return fn

    return register
