"""Sources, projections, filters, joins and set operations."""

from pyspark.sql import functions as F

from catalog.registry import query
from slatewise import schema as S
from slatewise.functions import lists, scalars, vectors
from slatewise.operators import aggregates as A
from slatewise.operators import frames as P
from slatewise.operators import longform as L
from slatewise.operators import lookup as K
from slatewise.plans import content, ensemble
from slatewise.sources import sinks, tables

HEAD = [S.IMPRESSION, S.POS]

# ---- sources and sinks


@query("src_1_load_table", "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, "
                           "round(p_retailprice, 6) as p_retailprice from part")
def _(s):
    return s.table("part")


@query("src_2_embeddings_with_norm",
       "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as embedding_norm "
       "from embeddings")
def _(s):
    return tables.load_embeddings(s.table("embeddings")).select("vec_id", "embedding_norm")


@query("src_3_pruned_scan", "select l_orderkey, l_quantity from lineitem where l_quantity >= 45")
def _(s):
    return s.table("lineitem", "l_orderkey", "l_quantity").filter(F.col("l_quantity") >= 45)


@query("src_4_behaviors_padded_history", """
select impression_id,
       case when articles is not null then array_to_string(list_concat([0,0,0,0,0], articles)[-5:], ',') end as history
from br_behaviors left join br_history using (user_id)""")
def _(s):
    df = tables.behaviors_with_history(s.impressions(), s.histories(), 5, 0)
    return df.select(S.IMPRESSION, lists.text(S.HISTORY_ARTICLES).alias("history"))


@query("src_5_feature_history_tails", """
select impression_id, array_to_string(articles[-3:], ',') as history, round(list_avg(br_history.reads[-3:]), 6) as mean_read_time
from br_behaviors left join br_history using (user_id)""")
def _(s):
    df = tables.behaviors_with_feature_history(s.impressions(), s.histories(), 3)
    return df.select(S.IMPRESSION, lists.text(S.HISTORY_ARTICLES).alias("history"),
                     lists.mean(S.HISTORY_READ_TIMES).alias("mean_read_time"))


@query("src_7_attach_embeddings", """
select p_partkey as article_id, i - 1 as dim, round(v::double, 6) as value
from part left join (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) on p_partkey = vec_id""")
def _(s):
    vecs = s.table("embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", S.ARTICLE)
    df = tables.attach_embeddings(s.articles().select(S.ARTICLE), vecs)
    return df.select(S.ARTICLE, F.posexplode_outer("embedding").alias("dim", "value"))


@query("snk_2_submission_lines", """
select impression_id, impression_id || ' [' || string_agg(rk::varchar, ',' order by pos) || ']' as line
from (select impression_id, pos, row_number() over (partition by impression_id order by score desc, pos desc) as rk
      from br_long) group by impression_id""")
def _(s):
    df = s.shown().select(S.IMPRESSION, lists.rank_by_score("read_times").alias("ranks"))
    return df.select(S.IMPRESSION, sinks.submission_line("ranks").alias("line"))


@query("snk_5_timestamps_as_text",
       "select o_orderkey as impression_id, o_orderdate::varchar as impression_time from orders")
def _(s):
    return sinks.timestamps_as_text(s.impressions().select(S.IMPRESSION, S.TIME), S.TIME)


# ---- projections


@query("prj_1_rename_present", "select p_partkey as article_id, p_name as title from part")
def _(s):
    return P.rename_present(s.table("part", "p_partkey", "p_name"),
                            {"p_partkey": "article_id", "p_name": "title", "p_absent": "nothing"})


@query("prj_4_equal_list_lengths", "select count(*) as n from orders")
def _(s):
    return P.require_equal_lengths(s.behaviors(), S.INVIEW, "read_times").agg(F.count(F.lit(1)).alias("n"))


@query("prj_5_row_index", """
select impression_id, pos, row_number() over (order by impression_id, pos) - 1 as index from br_candidates""")
def _(s):
    return P.with_row_index(s.candidates().select(*HEAD), HEAD)


@query("prj_6_known_user", """
select o_orderkey as impression_id, o_custkey in (select user_id from events) as is_known_user from orders""")
def _(s):
    df = P.with_known_user(s.impressions(), s.table("events", "user_id"))
    return df.select(S.IMPRESSION, S.KNOWN_USER)


@query("prj_7_null_fill", """
select p_partkey as article_id,
       round(coalesce(sqrt(list_dot_product(embedding::double[], embedding::double[])), 0.0), 6) as norm
from part left join embeddings on p_partkey = vec_id""")
def _(s):
    vecs = tables.load_embeddings(s.table("embeddings"), S.ARTICLE).select(S.ARTICLE, "embedding_norm")
    return s.articles().join(vecs, S.ARTICLE, "left").select(
        S.ARTICLE, F.coalesce("embedding_norm", F.lit(0.0)).alias("norm"))


@query("prj_8_glued_views", """
select impression_id, count(*) as click_n, round(avg(read_time), 6) as read_mean
from br_clicks group by impression_id""")
def _(s):
    clicks = s.slotless().filter(F.col(S.LABEL) == 1)
    counts = clicks.groupBy(S.IMPRESSION).agg(F.count(F.lit(1)).alias("n"))
    reads = clicks.groupBy(S.IMPRESSION).agg(F.avg(S.READ_TIME).alias("mean"))
    return P.glue_views({"click_": counts, "read_": reads}, S.IMPRESSION)


@query("prj_9_dummy_lists", """
select impression_id, array_to_string(list_transform(inview, lambda x: 0), ',') as labels, inview[1] as first_click
from br_behaviors""")
def _(s):
    df = P.with_dummy_lists(s.behaviors())
    return df.select(S.IMPRESSION, lists.text(S.LABELS).alias("labels"), F.element_at(S.CLICKED, 1).alias("first_click"))


# ---- filters


@query("flt_1_min_negatives", """
select impression_id, (len(inview) - len(clicked))::bigint as negatives
from br_behaviors where len(inview) - len(clicked) >= 2""")
def _(s):
    df = P.min_negatives(s.behaviors(), 2)
    return df.select(S.IMPRESSION, (F.size(S.INVIEW) - F.size(S.CLICKED)).alias("negatives"))


@query("flt_2_min_read_time", "select impression_id, pos, read_time from br_candidates where read_time >= 30")
def _(s):
    return P.min_value(s.candidates(), 30).select(*HEAD, S.READ_TIME)


@query("flt_3_min_list_length", "select impression_id, len(inview)::bigint as n from br_behaviors where len(inview) >= 5")
def _(s):
    return P.min_length(s.behaviors(), 5, S.INVIEW).select(S.IMPRESSION, F.size(S.INVIEW).alias("n"))


@query("flt_4_max_list_length", "select impression_id, len(inview)::bigint as n from br_behaviors where len(inview) <= 3")
def _(s):
    return P.max_length(s.behaviors(), 3, S.INVIEW).select(S.IMPRESSION, F.size(S.INVIEW).alias("n"))


@query("flt_5_non_empty_text", "select doc_id, lang from documents where length(text) > 0")
def _(s):
    return P.non_empty_text(s.table("documents", "doc_id", "lang", "text"), "text").select("doc_id", "lang")


@query("flt_6_null_outside_ids", """
select impression_id, pos, case when article_id in (select vec_id from embeddings) then article_id end as article_id
from br_candidates""")
def _(s):
    ids = s.table("embeddings", "vec_id")
    return P.null_outside(s.candidates().select(*HEAD, S.ARTICLE), S.ARTICLE, ids)


@query("flt_7_drop_nulls", "select impression_id, user_id from br_behaviors where clicked is not null")
def _(s):
    return s.behaviors().na.drop(subset=[S.USER, S.CLICKED]).select(S.IMPRESSION, S.USER)


@query("flt_8_split_by_flag", """
select case when premium = 1 then 'premium' else 'open' end as part, article_id from br_articles""")
def _(s):
    yes, no = P.split_by_flag(s.articles().withColumn("flag", F.col("premium") == 1), "flag")
    return P.concat_named({"premium": yes.select(S.ARTICLE), "open": no.select(S.ARTICLE)}, "part")


@query("flt_9_id_set_filter", """
select impression_id, pos, article_id from br_candidates where article_id in (select vec_id from embeddings)""")
def _(s):
    ids = s.table("embeddings", "vec_id").withColumnRenamed("vec_id", S.ARTICLE)
    return P.keep_ids(s.candidates().select(*HEAD, S.ARTICLE), ids, S.ARTICLE)


@query("flt_10_time_holdout", """
select o_orderkey as impression_id,
       case when o_orderdate::date < (select max(o_orderdate::date) - 1 from orders) then 'train' else 'held' end as part
from orders""")
def _(s):
    train, held = P.time_holdout(s.impressions().select(S.IMPRESSION, S.TIME))
    return P.concat_named({"train": train, "held": held}, "part").select(S.IMPRESSION, "part")


@query("flt_11_shortest_lists", """
select impression_id, len(inview)::bigint as n from br_lists
where len(inview) = (select min(len(inview)) from br_lists)""")
def _(s):
    return P.shortest_lists(s.shown(), S.INVIEW).select(S.IMPRESSION, F.size(S.INVIEW).alias("n"))


@query("flt_12_same_list_everywhere", """
select min(inview) = max(inview) as constant, min(inview) = [1, 2] and max(inview) = [1, 2] as equals_given from br_behaviors""")
def _(s):
    return P.same_list_everywhere(s.behaviors(), S.INVIEW, given=[1, 2])


# ---- joins


@query("jn_1_behaviors_history", """
select impression_id, len(articles)::bigint as history_len, articles[-1] as last_article
from br_behaviors left join br_history using (user_id)""")
def _(s):
    df = s.impressions().join(s.histories(), S.USER, "left")
    return df.select(S.IMPRESSION, F.size(S.HISTORY_ARTICLES).alias("history_len"),
                     F.try_element_at(S.HISTORY_ARTICLES, F.lit(-1)).alias("last_article"))


@query("jn_2_large_join", """
select impression_id, pos, c_mktsegment as segment from br_candidates left join customer on user_id = c_custkey""")
def _(s):
    segments = s.table("customer", "c_custkey", "c_mktsegment").toDF(S.USER, "segment")
    return s.candidates().join(segments, S.USER, "left").select(*HEAD, "segment")


CODES = """
uc as (select user_id, row_number() over (order by user_id) - 1 as user_code
       from (select distinct user_id from br_clicks)),
ic as (select article_id, row_number() over (order by article_id) - 1 as item_code
       from (select distinct article_id from br_clicks))
"""


@query("jn_3_code_mapping", """
select impression_id, pos, user_code, item_code
from br_candidates join uc using (user_id) join ic using (article_id)""", CODES)
def _(s):
    clicks = s.slotless().filter(F.col(S.LABEL) == 1)
    users, items = A.dense_codes(clicks, S.USER, "user_code"), A.dense_codes(clicks, S.ARTICLE, "item_code")
    return s.candidates().join(users, S.USER).join(items, S.ARTICLE).select(*HEAD, "user_code", "item_code")


USER_VECTORS = """
parts as (select user_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i
          from br_clicks join br_vectors using (article_id)),
um as (select user_id, i, avg(v) as v from parts group by user_id, i),
uv as (select user_id, list(v order by i) as embedding, sqrt(sum(v * v)) as embedding_norm from um group by user_id)
"""


@query("jn_4_user_vectors_or_zero", """
select u.user_id, round(coalesce(embedding_norm, 2.220446049250313e-16), 6) as norm,
       round(coalesce(v, 0.0), 6) as value, coalesce(i - 1, 0) as dim
from (select distinct o_custkey as user_id from orders) u left join uv using (user_id) left join um using (user_id)""", USER_VECTORS)
def _(s):
    clicks = s.slotless().filter(F.col(S.LABEL) == 1)
    users = content.user_vectors(clicks, s.embeddings())
    joined = s.impressions().select(S.USER).distinct().join(users, S.USER, "left")
    filled = F.coalesce("embedding", F.array(F.lit(0.0)))
    return joined.select(S.USER, F.coalesce("embedding_norm", F.lit(vectors.EPSILON)).alias("norm"), F.posexplode(filled).alias("dim", "value"))


@query("jn_5_article_vectors", """
select distinct c.article_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm
from br_candidates c join embeddings on vec_id = c.article_id""")
def _(s):
    vecs = tables.load_embeddings(s.table("embeddings"), S.ARTICLE)
    shown = s.table("lineitem", "l_partkey").distinct().withColumnRenamed("l_partkey", S.ARTICLE)
    return shown.join(vecs, S.ARTICLE).select(S.ARTICLE, F.col("embedding_norm").alias("norm"))


@query("jn_6_candidate_scores", """
select impression_id, pos, coalesce(score, 0.0) as score from br_candidates
left join (select user_id, article_id, count(*)::double as score from br_clicks group by 1, 2) using (user_id, article_id)""")
def _(s):
    long = s.candidates()
    scores = A.interactions(long.filter(F.col(S.LABEL) == 1)).select(
        S.USER, S.ARTICLE, F.col("value").cast("double").alias(S.SCORE))
    return L.attach_scores(long, scores).select(*HEAD, S.SCORE)


@query("jn_7_join_predictions", """
select impression_id, pos, round((read_time / 50.0 + (1 - read_time / 50.0) * 0.5 + label) / 3, 6) as score
from br_candidates""")
def _(s):
    shown = s.shown()
    p = F.transform("read_times", lambda x: x / 50.0)
    labels = lists.click_labels(S.INVIEW, S.CLICKED)
    a = shown.select(S.IMPRESSION, labels.alias("clicked_labels"), p.alias("predicted_score"))
    b = shown.select(S.IMPRESSION, F.transform(p, lambda x: (1 - x) * 0.5).alias("predicted_score"))
    c = shown.select(S.IMPRESSION, labels.cast("array<double>").alias("predicted_score"))
    df = ensemble.average_lists([a, b, c])
    return L.explode_lists(df.drop("clicked_labels"), ["predicted_score"], [S.SCORE])


@query("jn_8_predictions_behaviors", "select impression_id, user_id, pos, article_id, score from br_long")
def _(s):
    predictions = s.candidates().select(*HEAD, S.ARTICLE, (F.col(S.READ_TIME) / 50.0).alias(S.SCORE))
    return predictions.join(s.impressions().select(S.IMPRESSION, S.USER), S.IMPRESSION)


@query("jn_8_unmatched_predictions", """
select count(*) as predictions, count(*) filter (where b.impression_id is null) as unmatched
from (select impression_id + 1 as impression_id from br_candidates) left join (select o_orderkey as impression_id from orders) b using (impression_id)""")
def _(s):
    predictions = s.slotless().select((F.col(S.IMPRESSION) + 1).alias(S.IMPRESSION))
    known = s.impressions().select(S.IMPRESSION, F.lit(True).alias("known"))
    return predictions.join(known, S.IMPRESSION, "left").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("known").isNull()).alias("unmatched"))


@query("jn_9_candidate_metadata", """
select impression_id, pos, category, premium::bigint as premium, round(sentiment_score, 6) as sentiment_score
from br_candidates left join br_articles using (article_id)""")
def _(s):
    return s.candidates().join(s.articles(), S.ARTICLE, "left").select(*HEAD, "category", "premium", "sentiment_score")


@query("jn_10_membership_flag", """
select impression_id, pos, (case when p.user_id is null then 0 else 1 end)::bigint as category_match
from br_candidates c left join br_articles a using (article_id)
left join (select distinct user_id, category from br_clicks join br_articles using (article_id)) p
  on p.user_id = c.user_id and p.category = a.category""")
def _(s):
    from slatewise.plans.features import user_categories

    articles = s.articles().select(S.ARTICLE, "category")
    pairs = user_categories(s.slotless().filter(F.col(S.LABEL) == 1), articles).withColumn("m", F.lit(1))
    df = s.candidates().join(articles, S.ARTICLE, "left").join(pairs, [S.USER, "category"], "left")
    return df.select(*HEAD, F.coalesce("m", F.lit(0)).alias("category_match"))


@query("jn_11_counts_with_engagement", """
select i.article_id, impressions, clicks, round(mean_read_time, 6) as mean_read_time
from (select article_id, count(*) as impressions from br_candidates group by 1) i
join (select article_id, count(*) as clicks from br_clicks group by 1) c using (article_id)
left join (select (props::json->>'$.k')::bigint as article_id, avg(value) as mean_read_time from events group by 1) e
  using (article_id)""")
def _(s):
    from slatewise.plans.popularity import item_statistics

    reads = s.table("events", "props", "value").select(
        F.get_json_object("props", "$.k").cast("long").alias(S.ARTICLE), F.col("value").alias(S.READ_TIME))
    return item_statistics(s.slotless()).join(A.engagement(reads, columns=[S.READ_TIME]), S.ARTICLE, "left")


@query("jn_12_labels_on_rows", "select impression_id, array_to_string(labels, ',') as labels from br_behaviors")
def _(s):
    return L.with_click_labels(s.behaviors()).select(S.IMPRESSION, lists.text(S.LABELS).alias("labels"))


# ---- set operations


@query("set_1_union_all", """
select impression_id, article_id from br_candidates union all select impression_id, article_id from br_clicks""")
def _(s):
    long = s.slotless().select(S.IMPRESSION, S.ARTICLE, S.LABEL)
    clicks = long.filter(F.col(S.LABEL) == 1)
    return long.unionByName(clicks).drop(S.LABEL)


@query("set_2_diagonal_concat", """
select 'segment' as name, c_mktsegment as value, count(*) as n, cast(null as double) as mean_balance
from customer group by 2
union all
select 'type', p_type, cast(null as bigint), round(avg(p_retailprice), 6) from part group by 2""")
def _(s):
    a = s.table("customer", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    b = s.table("part", "p_type", "p_retailprice").groupBy(F.col("p_type").alias("value")).agg(
        F.avg("p_retailprice").alias("mean_balance"))
    return P.concat_named({"segment": a, "type": b})


@query("set_3_article_ids", """
select article_id from br_candidates union select user_id % 97 from br_behaviors""")
def _(s):
    df = s.behaviors().withColumn(S.ARTICLE, F.col(S.USER) % 97)
    return P.article_ids(df)


@query("set_4_distinct_pairs", "select distinct user_id, article_id from br_candidates")
def _(s):
    return s.slotless().select(S.USER, S.ARTICLE).distinct()


@query("set_5_history_in_catalogue", """
select distinct article_id from br_clicks where article_id in (select vec_id from embeddings)""")
def _(s):
    read = s.slotless().filter(F.col(S.LABEL) == 1).select(S.ARTICLE).distinct()
    return P.keep_ids(read, s.table("embeddings", "vec_id").withColumnRenamed("vec_id", S.ARTICLE), S.ARTICLE)


# ---- lookups as tables


@query("map_1_lookup_table", """
select user_id, event_type from (
  select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
where r = 1""")
def _(s):
    return K.lookup_table(s.table("events", "user_id", "event_type", "ts", "event_id"), "user_id", "event_type",
                          ["ts", "event_id"])


@query("map_2_flatten_structs", """
select p_partkey as article_id, p_name as "name-info", p_size::bigint as "size-box-info" from part""")
def _(s):
    nested = s.table("part", "p_partkey", "p_name", "p_size").select(
        F.col("p_partkey").alias(S.ARTICLE),
        F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("size")).alias("box")).alias("info"))
    return P.flatten_structs(nested)


@query("map_3_known_keys", "select distinct article_id from br_candidates where article_id in (select vec_id from embeddings)")
def _(s):
    shown = s.table("lineitem", "l_partkey").distinct().withColumnRenamed("l_partkey", S.ARTICLE)
    return P.keep_ids(shown, s.table("embeddings", "vec_id").withColumnRenamed("vec_id", S.ARTICLE), S.ARTICLE)


@query("map_6_unnest_struct", "select article_id, count(*) as n from br_candidates group by 1")
def _(s):
    counts = A.item_counts(s.slotless()).select(F.struct(S.ARTICLE, "n").alias("s"))
    return counts.select("s.*")


# ---- text and time


@query("str_1_join_columns", """select p_partkey as article_id, p_name || ' ' || p_type || ' ' || p_size as "p_name-p_type-p_size" from part""")
def _(s):
    names = ["p_name", "p_type", "p_size"]
    df = s.table("part", "p_partkey", *names)
    return df.select(F.col("p_partkey").alias(S.ARTICLE), scalars.join_text(names).alias(scalars.joined_name(names)))


WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: length(w) > 0)"


@query("str_2_join_list", f"select doc_id, md5(array_to_string({WORDS}, ' ')) as text_hash from documents")
def _(s):
    df = s.table("documents", "doc_id", "text")
    return df.select("doc_id", F.md5(lists.text(scalars.words("text"), " ")).alias("text_hash"))


@query("str_3_token_ids", f"""
select doc_id, len(w)::bigint as n_tokens,
       md5(array_to_string(list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 30000 + 1), ',')) as ids_hash
from (select doc_id, {WORDS} as w from documents)""")
def _(s):
    ids = s.table("documents", "doc_id", "text").select("doc_id", scalars.hashed_token_ids("text", 30_000).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(lists.text("ids")).alias("ids_hash"))


@query("str_5_cast_to_text", "select o_orderkey::varchar as impression_id, o_orderdate::varchar as impression_time from orders")
def _(s):
    return sinks.timestamps_as_text(s.impressions().select(S.IMPRESSION, S.TIME), S.IMPRESSION, S.TIME)


@query("dt_1_hour_weekday", "select event_id, hour(ts) as hour_of_day, isodow(ts) as day_of_week from events")
def _(s):
    return s.table("events", "event_id", "ts").select(
        "event_id", scalars.hour("ts").alias("hour_of_day"), scalars.weekday("ts").alias("day_of_week"))


@query("dt_2_age_hours", """
select event_id, round(floor(epoch(ts - timestamp '2023-12-30 07:00:00')) / 3600.0, 6) as age_hours from events""")
def _(s):
    start = F.lit("2023-12-30 07:00:00").cast("timestamp_ntz")
    return s.table("events", "event_id", "ts").select("event_id", scalars.age_hours("ts", start).alias("age_hours"))


@query("dt_3_day_and_cutoff", """
select o_orderdate::date as day, count(*) as n, (select max(o_orderdate::date) - 1 from orders) as cutoff
from orders group by 1""")
def _(s):
    df = s.impressions()
    cutoff = df.select(F.date_sub(F.max(F.to_date(S.TIME)), 1)).scalar()
    return df.groupBy(F.to_date(S.TIME).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("cutoff", cutoff)


@query("dt_4_interval_text", """
select event_id, (x // 86400) || ' days ' || (x % 86400 // 3600) || ':' || (x % 3600 // 60) || ':' || (x % 60) as age
from (select event_id, floor(epoch(ts - timestamp '2024-01-01 00:00:00'))::bigint as x from events)""")
def _(s):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", start, F.col("ts"))
    return s.table("events", "event_id", "ts").select("event_id", scalars.interval_text(seconds).alias("age"))
