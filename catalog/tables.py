"""Aggregates, windows, ordering, splits and samples."""

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from catalog.registry import query
from slatewise import schema as S
from slatewise.functions import lists, vectors
from slatewise.operators import aggregates as A
from slatewise.operators import frames as P
from slatewise.operators import history as H
from slatewise.operators import longform as L
from slatewise.operators.skew import top_n_in_group
from slatewise.plans import content
from slatewise.plans.beyond_accuracy import random_subsets
from slatewise.plans.popularity import item_statistics, popularity_scores

HEAD = [S.IMPRESSION, S.POS]
ORDER = [S.TIME, S.IMPRESSION, S.POS]
CUTOFF = "1998-01-01"


def cutoff():
    return F.lit(CUTOFF).cast("timestamp_ntz")


# ---- aggregates


@query("agg_1_item_counts", "select article_id, count(*) as n from br_candidates group by 1")
def _(s):
    return A.item_counts(s.slotless())


@query("agg_1_list_item_counts", "select article_id, count(*) as n from br_clicks group by 1")
def _(s):
    return A.list_item_counts(s.behaviors(), S.CLICKED)


@query("agg_2_interactions", "select user_id, article_id, count(*) as value from br_clicks group by 1, 2")
def _(s):
    return A.interactions(s.slotless().filter(F.col(S.LABEL) == 1))


def _engagement_rows(s):
    kind = F.col("event_type")
    return s.table("events", "props", "value", "event_type").select(
        F.get_json_object("props", "$.k").cast("long").alias(S.ARTICLE),
        F.when(kind != "error", F.col("value")).alias(S.READ_TIME),
        F.when(kind != "signup", F.col("value") / 2).alias(S.SCROLL))


ENGAGEMENT = """
eng as (select (props::json->>'$.k')::bigint as article_id, avg(value) as mean_read_time,
               avg(value / 2) as mean_scroll_percentage
        from events where event_type not in ('error', 'signup') group by 1)
"""


@query("agg_3_engagement", """
select article_id, round(mean_read_time, 6) as mean_read_time, round(mean_scroll_percentage, 6) as mean_scroll_percentage
from eng""", ENGAGEMENT)
def _(s):
    return A.engagement(_engagement_rows(s))


@query("agg_4_nearest_quantile", """
select (select n from (select n, row_number() over (order by n) - 1 as i, count(*) over () as m from k)
        where i = floor(0.1 * (m - 1) + 0.5)) as q10,
       (select n from (select n, row_number() over (order by n) - 1 as i, count(*) over () as m from k)
        where i = floor(0.5 * (m - 1) + 0.5)) as q50""",
       "k as (select article_id, count(*) as n from br_clicks group by 1)")
def _(s):
    counts = A.item_counts(s.slotless().filter(F.col(S.LABEL) == 1))
    low, mid = A.nearest_quantile(counts, "n", 0.1), A.nearest_quantile(counts, "n", 0.5)
    return counts.groupBy().agg(F.count(F.lit(1)).alias("m")).select(low.alias("q10"), mid.alias("q50"))


@query("agg_5_global_ratio", """
select round(sum(clicks)::double / sum(impressions), 6) as ratio
from (select article_id, count(*) as impressions, sum(label) as clicks from br_candidates group by 1) where clicks > 0""")
def _(s):
    items = item_statistics(s.slotless())
    return items.agg(F.try_divide(F.sum("clicks").cast("double"), F.sum("impressions").cast("double")).alias("ratio"))


USER_VECTORS = """
parts as (select user_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i
          from br_clicks join br_vectors using (article_id)),
um as (select user_id, i, avg(v) as v from parts group by user_id, i),
uv as (select user_id, list(v order by i) as embedding, sqrt(sum(v * v)) as embedding_norm from um group by user_id)
"""


@query("agg_6_user_mean_vectors", """
select user_id, round(embedding_norm, 6) as embedding_norm, i - 1 as dim, round(v, 6) as value
from um join uv using (user_id)""", USER_VECTORS)
def _(s):
    users = content.user_vectors(s.slotless().filter(F.col(S.LABEL) == 1), s.embeddings())
    return users.select(S.USER, "embedding_norm", F.posexplode("embedding").alias("dim", "value"))


@query("agg_7_column_means", """
select round(avg(read_time), 6) as read_time, round(avg(label), 6) as label, round(avg(pos), 6) as pos from br_candidates""")
def _(s):
    return s.candidates().agg(*[F.avg(c).alias(c) for c in (S.READ_TIME, S.LABEL, S.POS)])


PAIR_COUNTS = """
select user_id, count(*) as n_pairs from (
  select distinct user_id, category, subcategory from br_candidates join br_articles using (article_id)) group by 1"""


@query("agg_8_distinct_pairs_per_user", PAIR_COUNTS)
def _(s):
    seen = s.slotless().select(S.USER, S.ARTICLE).distinct().join(s.articles(), S.ARTICLE)
    pairs = seen.select(S.USER, F.struct("category", "subcategory").alias("pair")).distinct()
    return pairs.groupBy(S.USER).agg(F.count(F.lit(1)).alias("n_pairs"))


@query("agg_9_catalogue_pairs", "select count(*) as n_pairs from (select distinct category, subcategory from br_articles)")
def _(s):
    return s.articles().select("category", "subcategory").distinct().agg(F.count(F.lit(1)).alias("n_pairs"))


@query("agg_10_fold_lists", """
select impression_id, pos // 4 as segment, string_agg(label::varchar, ',' order by pos) as labels,
       string_agg(article_id::varchar, ',' order by pos) as articles from br_candidates group by 1, 2""")
def _(s):
    folded = L.to_list_segments(s.candidates(), [S.IMPRESSION], {S.LABEL: "labels", S.ARTICLE: "articles"}, size=4)
    return folded.select(S.IMPRESSION, "segment", lists.text("labels").alias("labels"), lists.text("articles").alias("articles"))


@query("agg_11_history_time_range", """
select min(impression_time) as min_time, max(impression_time) as max_time from br_clicks""")
def _(s):
    whole = H.fixed_histories(s.clicks(), F.lit("9999-01-01").cast("timestamp_ntz"), ORDER, [S.TIME])
    return A.history_time_range(whole)


@query("agg_12_time_range", "select min(o_orderdate) as min_time, max(o_orderdate) as max_time from orders")
def _(s):
    return A.time_range(s.impressions())


@query("agg_13_popularity_share", """
select article_id, round(count(*) / (select count(distinct user_id) from br_clicks), 6) as popularity
from (select distinct user_id, article_id from br_clicks) group by 1""")
def _(s):
    read = s.slotless().filter(F.col(S.LABEL) == 1).select(S.USER, S.ARTICLE).distinct()
    return A.popularity_share(read, S.ARTICLE, S.USER)


@query("agg_14_distribution", """
select category, round(count(*) / (select count(*)::double from br_candidates), 6) as share
from br_candidates join br_articles using (article_id) group by 1""")
def _(s):
    return A.normalized_distribution(s.slotless().join(s.articles(), S.ARTICLE).select("category"), "category")


@query("agg_14_weighted_distribution", """
select category, round(sum(read_time / 50.0 / total) + max(prior), 6) as share from (
  select category, read_time, (select count(*) from br_candidates) as total
  from br_candidates join br_articles using (article_id)) r
join (select category, count(*) / (select count(*)::double from br_articles) as prior from br_articles group by 1) p
  using (category) group by 1""")
def _(s):
    rows = s.slotless().join(s.articles(), S.ARTICLE).select("category", S.READ_TIME)
    prior = A.normalized_distribution(s.articles(), "category")
    total = rows.select(F.count(F.lit(1))).scalar()
    return A.normalized_distribution(rows, "category", F.col(S.READ_TIME) / 50.0 / total, prior)


@query("agg_15_index_of_dispersion", """
select user_id, case when n = 1 then null when k = 1 then 0.0
                else round(k * (n * n - sq) / (n * n * (k - 1)), 6) end as dispersion
from (select user_id, sum(f)::double as n, count(*)::double as k, sum(f * f)::double as sq
      from (select user_id, category, count(*) as f from br_candidates join br_articles using (article_id) group by 1, 2)
      group by 1)""")
def _(s):
    rows = s.slotless().join(s.articles(), S.ARTICLE).select(S.USER, "category")
    return A.index_of_dispersion(rows, "category", [S.USER])


@query("agg_16_mean_std", """
select category, round(avg(read_time), 6) as mean, round(stddev_pop(read_time), 6) as std
from br_candidates join br_articles using (article_id) group by 1""")
def _(s):
    return A.mean_std(s.slotless().join(s.articles(), S.ARTICLE), S.READ_TIME, ["category"])


@query("agg_17_negative_ratio", """
select count(*) filter (where label = 1) as n_pos, count(*) filter (where label = 0) as n_neg,
       round(count(*) filter (where label = 0) / count(*) filter (where label = 1), 6) as npratio from br_candidates""")
def _(s):
    return A.negative_ratio(s.slotless())


@query("agg_18_observed_step", """
select count(*) as rows_before, count(*) filter (where read_time >= 30) as rows_after from br_candidates""")
def _(s):
    seen = Observation("before")
    kept = P.min_value(P.column_shape(s.slotless(), seen, "rows"), 30).agg(F.count(F.lit(1)).alias("rows_after"))
    after = kept.first()[0]  # the observation is filled by this action
    return kept.select(F.lit(seen.get["rows"]).alias("rows_before"), F.lit(after).alias("rows_after"))


@query("agg_19_describe", """
select summary, round(p_size, 6) as p_size, round(p_retailprice, 6) as p_retailprice from (
  select 'count' as summary, count(p_size)::double as p_size, count(p_retailprice)::double as p_retailprice from part
  union all select 'mean', avg(p_size), avg(p_retailprice) from part
  union all select 'stddev', stddev_samp(p_size), stddev_samp(p_retailprice) from part
  union all select 'min', min(p_size)::double, min(p_retailprice) from part
  union all select 'max', max(p_size)::double, max(p_retailprice) from part)""")
def _(s):
    table = A.describe(s.table("part"), "p_size", "p_retailprice").filter(~F.col("summary").endswith("%"))
    return table.select("summary", *[F.col(c).cast("double").alias(c) for c in ("p_size", "p_retailprice")])


# ---- windows


@query("win_1_dynamic_history", """
select impression_id, pos, coalesce(array_to_string(list(article_id) over (
         partition by user_id order by impression_time, impression_id, pos rows between 5 preceding and 1 preceding), ','), '')
       as history from br_clicks""")
def _(s):
    hot = s.hot_users()
    df = H.dynamic_history(s.clicks(), 5, ORDER, hot=hot)
    return df.select(*HEAD, lists.text("history_dynamic").alias("history"))


BEFORE = f"""
hist as (select user_id, list(article_id order by impression_time, impression_id, pos) as articles,
                list(read_time order by impression_time, impression_id, pos) as reads
         from br_clicks where impression_time < timestamp '{CUTOFF}' group by user_id)
"""


@query("win_2_fixed_history", """
select impression_id, array_to_string(articles, ',') as history from br_behaviors left join hist using (user_id)""", BEFORE)
def _(s):
    folded = H.fixed_histories(s.clicks(), cutoff(), ORDER, [S.ARTICLE])
    return s.impressions().join(folded, S.USER, "left").select(
        S.IMPRESSION, lists.text(S.HISTORY_ARTICLES).alias("history"))


@query("win_2_fixed_history_sized", """
select impression_id, pos, array_to_string(articles[-3:], ',') as history
from br_clicks left join hist using (user_id)""", BEFORE)
def _(s):
    df = H.with_fixed_history(s.clicks(), cutoff(), ORDER, 3)
    return df.select(*HEAD, lists.text(S.HISTORY_ARTICLES).alias("history"))


@query("win_2_history_rows", f"""
select user_id, article_id, rank from (
  select user_id, article_id, row_number() over (
    partition by user_id order by impression_time desc, impression_id desc, pos desc) as rank
  from br_clicks where impression_time < timestamp '{CUTOFF}') where rank <= 4""")
def _(s):
    return H.history_rows(s.clicks(), cutoff(), 4, ORDER).select(S.USER, S.ARTICLE, "rank")


@query("win_3_fixed_columns", """
select impression_id, pos, array_to_string(articles[-3:], ',') as history,
       round(list_avg(reads[-3:]), 6) as mean_read_time
from br_clicks left join hist using (user_id)""", BEFORE)
def _(s):
    df = H.with_fixed_columns(s.clicks(), cutoff(), ORDER, [S.ARTICLE, S.READ_TIME], 3)
    return df.select(*HEAD, lists.text(S.HISTORY_ARTICLES).alias("history"),
                     lists.mean(S.HISTORY_READ_TIMES).alias("mean_read_time"))


@query("win_4_reciprocal_rank_scores", """
select article_id, round(1.0 / row_number() over (order by total_pageviews desc, article_id), 6) as prediction_score
from br_articles""")
def _(s):
    return A.reciprocal_rank_scores(s.articles().select(S.ARTICLE, "total_pageviews"), "total_pageviews",
                                    S.ARTICLE).select(S.ARTICLE, "prediction_score")


@query("win_5_rank_in_list", """
select impression_id, pos, row_number() over (partition by impression_id order by score desc, pos desc) as rank
from br_long""")
def _(s):
    ranks = s.shown().select(S.IMPRESSION, lists.rank_by_score("read_times").alias("rank"))
    return L.explode_lists(ranks, ["rank"])


@query("win_6_sample_per_user", "select user_id, least(count(*), 3) as n from br_candidates group by 1")
def _(s):
    kept = P.sample_per_user(s.candidates(), 3, 7, S.IMPRESSION, S.POS)
    return kept.groupBy(S.USER).agg(F.count(F.lit(1)).alias("n"))


@query("win_7_top_candidates", """
select impression_id, article_id, rank from (
  select impression_id, article_id, row_number() over (partition by impression_id order by read_time desc, pos) as rank
  from br_candidates) where rank <= 2""")
def _(s):
    best = top_n_in_group(s.candidates(), [S.IMPRESSION], [F.desc_nulls_last(S.READ_TIME), F.asc(S.POS)], 2)
    return best.select(S.IMPRESSION, S.ARTICLE, "rank")


@query("win_8_min_max", """
select article_id, round((total_pageviews - lo) / (hi - lo), 6) as scaled
from br_articles, (select min(total_pageviews) as lo, max(total_pageviews) as hi from br_articles)""")
def _(s):
    return A.min_max_scale(s.articles(), {"total_pageviews": "scaled"}).select(S.ARTICLE, "scaled")


@query("win_9_popularity_scalings", """
select article_id, round(total_pageviews / hi, 6) as by_max,
       round((total_pageviews - lo) / (hi - lo) * (1.0 - 1e-4) + 1e-4, 6) as by_range
from br_articles, (select min(total_pageviews) as lo, max(total_pageviews) as hi from br_articles)""")
def _(s):
    df = A.max_scale(s.articles(), "total_pageviews", "by_max")
    return A.min_max_scale(df, {"total_pageviews": "by_range"}, 1e-4, 1.0).select(S.ARTICLE, "by_max", "by_range")


@query("win_10_range_scaling", """
select article_id, round((size - 0.0) / (100.0 - 0.0) * 3.0 + 2.0, 6) as scaled from br_articles""")
def _(s):
    return A.min_max_scale(s.articles(), {"size": "scaled"}, 2.0, 5.0, low=0.0, high=100.0).select(S.ARTICLE, "scaled")


@query("win_11_dense_codes", """
select article_id, row_number() over (order by article_id) - 1 as item_code
from (select distinct article_id from br_clicks)""")
def _(s):
    return A.dense_codes(s.slotless().filter(F.col(S.LABEL) == 1), S.ARTICLE, "item_code")


@query("win_12_user_codes", """
select user_id, row_number() over (order by user_id) as user_code from (select distinct o_custkey as user_id from orders)""")
def _(s):
    return A.dense_codes(s.impressions(), S.USER, "user_code", start=1)


# ---- order, splits, samples

POPULARITY = """
st as (select article_id, count(*)::double as impressions, sum(label)::double as clicks
       from br_candidates group by 1 having sum(label) > 0),
q as (select clicks as floor_clicks from (select clicks, row_number() over (order by clicks) - 1 as i, count(*) over () as m from st)
      where i = floor(0.1 * (m - 1) + 0.5)),
g as (select sum(clicks) / sum(impressions) as ratio from st),
ctr as (select article_id, impressions, clicks, (clicks + 200.0 * ratio) / (impressions + 200.0)
               * (case when clicks < floor_clicks then 0.5 else 1.0 end) as ctr from st, g, q),
nm as (select article_id, impressions, clicks, ctr,
              (ctr - min(ctr) over ()) / (max(ctr) over () - min(ctr) over ()) as ctr_norm,
              (clicks - min(clicks) over ()) / (max(clicks) over () - min(clicks) over ()) as clicks_norm from ctr),
pop as (select *, 0.6 * ctr_norm + 0.4 * clicks_norm as score from nm)
"""


def popularity(s):
    return popularity_scores(item_statistics(s.slotless()))


@query("srt_1_most_popular", "select article_id, round(score, 6) as score from pop order by round(score, 9) desc, article_id limit 10",
       POPULARITY)
def _(s):
    return popularity(s).select(S.ARTICLE, S.SCORE).orderBy(F.desc(F.round(S.SCORE, 9)), S.ARTICLE).limit(10)


@query("srt_2_softmax_sample")
def _(s):
    return P.softmax_sample(popularity(s), 10, 11, S.SCORE, S.ARTICLE).select(S.ARTICLE, S.SCORE)


@query("srt_3_softmax", """
select article_id, round(exp(score - top) / sum(exp(score - top)) over (), 6) as probability
from (select article_id, score, max(score) over () as top from pop)""", POPULARITY)
def _(s):
    return A.softmax(popularity(s), S.SCORE, "probability").select(S.ARTICLE, "probability")


@query("srt_4_top_slices", """
select 'popular' as list, article_id, rank from (
  select article_id, row_number() over (order by total_pageviews desc, article_id) as rank from br_articles) where rank <= 5
union all
select 'editorial', article_id, rank from (
  select article_id, row_number() over (order by n desc, article_id) as rank
  from (select article_id, count(*) as n from br_candidates group by 1)) where rank <= 5""")
def _(s):
    popular = P.top_slice(s.articles(), "total_pageviews", S.ARTICLE, 5).select(
        S.ARTICLE, F.row_number().over(W.orderBy(F.desc("total_pageviews"), S.ARTICLE)).alias("rank"))
    editorial = P.top_slice(A.item_counts(s.slotless()), "n", S.ARTICLE, 5).select(
        S.ARTICLE, F.row_number().over(W.orderBy(F.desc("n"), S.ARTICLE)).alias("rank"))
    return P.concat_named({"popular": popular, "editorial": editorial}, "list")


@query("srt_5_random_lists", """
select o_orderkey as impression_id, 5::bigint as n_items, 5::bigint as n_distinct from orders""")
def _(s):
    items = s.table("part", "p_partkey").withColumnRenamed("p_partkey", "item")
    drawn = random_subsets(items, s.impressions().select(S.IMPRESSION), S.IMPRESSION, 5, 3)
    return drawn.groupBy(S.IMPRESSION).agg(F.count(F.lit(1)).alias("n_items"),
                                           F.count_distinct("item").alias("n_distinct"))


@query("srt_6_random_permutation", """
select impression_id, len(inview)::bigint as n, (len(inview) * (len(inview) + 1) // 2)::bigint as total
from br_behaviors""")
def _(s):
    n = F.size(S.INVIEW)
    ranks = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    df = s.behaviors().select(S.IMPRESSION, ranks.alias("ranks"))
    df = df.withColumn("ranks", lists.stable_shuffle("ranks", 5, [S.IMPRESSION]))
    return df.select(S.IMPRESSION, F.size("ranks").alias("n"),
                     F.aggregate("ranks", F.lit(0), lambda a, x: a + x).alias("total"))


@query("srt_7_shuffled_rows", "select o_orderkey as impression_id from orders")
def _(s):
    return P.shuffle_rows(s.impressions().select(S.IMPRESSION), 13, S.IMPRESSION)


@query("srt_8_exact_sample", "select floor(count(*) * 0.3)::bigint as n from br_candidates")
def _(s):
    kept = P.sample_exact(s.candidates().select(*HEAD), 0.3, 17, *HEAD)
    return kept.agg(F.count(F.lit(1)).alias("n"))


@query("srt_9_split_fraction", """
select 'head' as part, floor(count(*) * 0.8)::bigint as n from br_candidates
union all select 'rest', (count(*) - floor(count(*) * 0.8))::bigint from br_candidates""")
def _(s):
    head, rest = P.split_fraction(s.candidates().select(*HEAD), 0.8, 19, *HEAD)
    return P.concat_named({"head": head, "rest": rest}, "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("srt_10_chunks", """
select impression_id, pos, least((rn - 1) // (total // 7), 6)::bigint as chunk
from (select impression_id, pos, row_number() over (order by impression_id, pos) as rn, count(*) over () as total
      from br_candidates)""")
def _(s):
    return P.with_chunk(s.candidates().select(*HEAD), 7, *HEAD)


@query("srt_11_splits", """
select impression_id, pos, ((rn - 1) // ceil(total / 7)::bigint)::bigint as split
from (select impression_id, pos, row_number() over (order by impression_id, pos) as rn, count(*) over () as total
      from br_candidates)""")
def _(s):
    return P.with_split(s.candidates().select(*HEAD), 7, *HEAD)


@query("srt_12_batches", """
select impression_id, ((row_number() over (order by impression_id) - 1) // 100)::bigint as batch
from (select o_orderkey as impression_id from orders)""")
def _(s):
    return P.with_batch(s.impressions().select(S.IMPRESSION), 100, S.IMPRESSION)


@query("srt_13_top_and_bottom", """
select 'top' as part, article_id, total_pageviews from (select article_id, total_pageviews from br_articles
  order by total_pageviews desc, article_id limit 5)
union all
select 'bottom', article_id, total_pageviews from (select article_id, total_pageviews from br_articles
  order by total_pageviews, article_id limit 5)""")
def _(s):
    items = s.articles().select(S.ARTICLE, "total_pageviews")
    return P.concat_named({"top": items.orderBy(F.desc("total_pageviews"), S.ARTICLE).limit(5),
                           "bottom": items.orderBy("total_pageviews", S.ARTICLE).limit(5)}, "part")


# ---- vectors


@query("mth_1_dot_norm_cosine", """
select user_id, article_id, round(list_dot_product(u, v), 6) as dot, round(sqrt(list_dot_product(v, v)), 6) as norm,
       round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))), 6) as cosine
from (select distinct user_id, article_id from br_candidates) c
join (select user_id, embedding as u from uv) using (user_id)
join (select article_id, embedding as v from br_vectors) using (article_id)""", USER_VECTORS)
def _(s):
    vecs = s.embeddings()
    users = content.user_vectors(s.slotless().filter(F.col(S.LABEL) == 1), vecs).select(S.USER, F.col("embedding").alias("u"))
    items = vecs.select(S.ARTICLE, F.col("embedding").alias("v"))
    pairs = s.slotless().select(S.USER, S.ARTICLE).distinct().join(items, S.ARTICLE).join(users, S.USER)
    return pairs.select(S.USER, S.ARTICLE, vectors.dot("u", "v").alias("dot"), vectors.norm("v").alias("norm"),
                        vectors.cosine("u", "v").alias("cosine"))
