"""Recommenders, ranking metrics and training tables."""

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import ENGAGEMENT, POPULARITY, USER_VECTORS, _engagement_rows, popularity
from slatewise import schema as S
from slatewise.functions import lists, vectors
from slatewise.operators import aggregates as A
from slatewise.operators import frames as P
from slatewise.operators import longform as L
from slatewise.operators import lookup as K
from slatewise.plans import boosting, collaborative, content, ensemble, encoding, features, history_length, least_squares
from slatewise.plans import metrics as M
from slatewise.plans.popularity import item_statistics, popularity_predictions, popularity_scores
from slatewise.session import ensure_checkpoint_dir
from slatewise.sources import sinks, tables
from slatewise.sources.chunks import read_scores, score_chunks

HEAD = [S.IMPRESSION, S.POS]


def scored(s):
    """Candidates scored by read time / 50: many ties, all values in [0, 1]."""
    return s.candidates().withColumn(S.SCORE, F.col(S.READ_TIME) / 50.0)


# ---- metrics

RANKED = """
rk as (select impression_id, user_id, impression_time, pos, article_id, label, score,
              row_number() over (partition by impression_id order by score desc, pos desc) as rank,
              rank() over (partition by impression_id order by score)
                + (count(*) over (partition by impression_id, score) - 1) / 2.0 as mean_rank,
              row_number() over (partition by impression_id order by label desc, pos desc) as ideal
       from br_long),
im as (select impression_id, min(user_id) as user_id, min(impression_time) as impression_time,
              sum(label)::double as p, (count(*) - sum(label))::double as n, count(*)::double as total,
              sum(case when label = 1 then mean_rank end) as pos_ranks,
              min(case when label = 1 then rank end) as first_hit,
              sum(label::double / rank) as recip,
              sum(case when rank <= 5 then (pow(2, label) - 1) / log2(rank + 1) else 0.0 end) as dcg5,
              sum(case when ideal <= 5 then (pow(2, label) - 1) / log2(ideal + 1) else 0.0 end) as idcg5,
              sum(case when rank <= 10 then (pow(2, label) - 1) / log2(rank + 1) else 0.0 end) as dcg10,
              sum(case when ideal <= 10 then (pow(2, label) - 1) / log2(ideal + 1) else 0.0 end) as idcg10,
              sum(pow(label - score, 2)) as sq,
              sum(-ln(case when label = 1 then greatest(least(score, 1 - 1e-11), 1e-11)
                           else 1 - greatest(least(score, 1 - 1e-11), 1e-11) end)) as nll,
              sum(case when (score >= 0.5)::int = label then 1.0 else 0.0 end) as hits,
              sum(case when score >= 0.5 and label = 1 then 1.0 else 0.0 end) as tp,
              sum(case when score >= 0.5 then 1.0 else 0.0 end) as predicted
       from rk group by impression_id),
au as (select *, (pos_ranks - p * (p + 1) / 2) / nullif(p * n, 0) as auc from im)
"""


@query("met_1_auc", "select impression_id, round(auc, 6) as auc from au", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.auc()], hot=s.hot_impressions())


@query("met_2_auc_strict", """
select impression_id, round(wins / nullif(p * n, 0), 6) as auc_strict from im join (
  select a.impression_id, count(b.label)::double as wins
  from br_candidates a left join br_candidates b
    on a.impression_id = b.impression_id and a.label = 1 and b.label = 0 and b.read_time < a.read_time
  group by 1) w using (impression_id)""", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.auc("zero")], hot=s.hot_impressions())


@query("met_3_mrr", "select impression_id, round(recip / nullif(p, 0), 6) as mrr from im", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.mrr()], hot=s.hot_impressions())


@query("met_4_reciprocal_rank", "select impression_id, round(coalesce(1.0 / first_hit, 1.0), 6) as reciprocal_rank from im", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.reciprocal_rank()], hot=s.hot_impressions())


@query("met_5_dcg", 'select impression_id, round(dcg5, 6) as "dcg@5", round(dcg10, 6) as "dcg@10" from im', RANKED)
def _(s):
    return M.per_impression(scored(s), [M.dcg(5), M.dcg(10)], hot=s.hot_impressions())


@query("met_6_ndcg", """
select impression_id, round(dcg5 / nullif(idcg5, 0), 6) as "ndcg@5", round(dcg10 / nullif(idcg10, 0), 6) as "ndcg@10"
from im""", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.ndcg(5), M.ndcg(10)], hot=s.hot_impressions())


@query("met_6_ndcg_graded", """
select impression_id, round(sum(case when r <= 5 then (pow(2, g) - 1) / log2(r + 1) else 0.0 end)
  / nullif(sum(case when i <= 5 then (pow(2, g) - 1) / log2(i + 1) else 0.0 end), 0), 6) as "ndcg@5"
from (select impression_id, label + article_id % 3 as g,
             row_number() over (partition by impression_id order by score desc, pos desc) as r,
             row_number() over (partition by impression_id order by label + article_id % 3 desc, pos desc) as i
      from br_long) group by 1""")
def _(s):
    graded = scored(s).withColumn(S.LABEL, F.col(S.LABEL) + F.col(S.ARTICLE) % 3)
    return M.per_impression(graded, [M.ndcg(5, graded=True)], hot=s.hot_impressions())


@query("met_7_log_loss", "select impression_id, case when p > 0 and n > 0 then round(nll / total, 6) end as logloss from im", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.log_loss()], hot=s.hot_impressions())


@query("met_8_rmse", "select impression_id, round(sqrt(sq / total), 6) as rmse from im", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.rmse()], hot=s.hot_impressions())


@query("met_9_accuracy", "select impression_id, round(hits / total, 6) as accuracy from im", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.accuracy(0.5)], hot=s.hot_impressions())


@query("met_10_f1", "select impression_id, round(coalesce(2 * tp / nullif(p + predicted, 0), 0.0), 6) as f1 from im", RANKED)
def _(s):
    return M.per_impression(scored(s), [M.f1(0.5)], hot=s.hot_impressions())


MEANS = """
select 'auc' as metric, round(avg(auc), 6) as value from au
union all select 'mrr', round(avg(recip / nullif(p, 0)), 6) from au
union all select 'ndcg@5', round(avg(dcg5 / nullif(idcg5, 0)), 6) from au
union all select 'ndcg@10', round(avg(dcg10 / nullif(idcg10, 0)), 6) from au"""


@query("met_11_evaluate_all", MEANS + """
union all select 'logloss', round(avg(case when p > 0 and n > 0 then nll / total end), 6) from au
union all select 'rmse', round(avg(sqrt(sq / total)), 6) from au
union all select 'accuracy', round(avg(hits / total), 6) from au
union all select 'f1', round(avg(coalesce(2 * tp / nullif(p + predicted, 0), 0.0)), 6) from au""", RANKED)
def _(s):
    metrics = [M.auc(), M.mrr(), M.ndcg(5), M.ndcg(10), M.log_loss(), M.rmse(), M.accuracy(), M.f1()]
    return M.evaluate(scored(s), metrics, s.hot_impressions())


COVERAGE = """
cov as (select user_id, count(distinct (category, subcategory)) as n
        from rk0 join br_articles using (article_id) where r <= 2 group by 1),
tot as (select count(distinct (category, subcategory))::double as t from br_articles)
"""
RK0 = "rk0 as (select *, row_number() over (partition by impression_id order by score desc, pos) as r from br_long),"


@query("met_12_category_coverage", "select round(avg(n), 6) as count, round(avg(n / t), 6) as fraction from cov, tot", RK0 + COVERAGE)
def _(s):
    return M.category_coverage(scored(s), s.articles(), 2)


@query("met_13_project_report", MEANS + """
union all select 'category_coverage_count', round(avg(n), 6) from cov
union all select 'category_coverage_fraction', round(avg(n / t), 6) from cov, tot""", RANKED + ", " + RK0 + COVERAGE)
def _(s):
    return M.project_report(scored(s), s.articles(), s.hot_impressions(), 2)


@query("met_14_grouped_auc", """
select round(avg(a), 6) as auc from (
  select (sum(case when label = 1 then mr end) - sum(label) * (sum(label) + 1) / 2.0)
         / nullif(sum(label) * (count(*) - sum(label)), 0) as a
  from (select g, label, rank() over (partition by g order by score)
               + (count(*) over (partition by g, score) - 1) / 2.0 as mr
        from (select label, score, (row_number() over (order by impression_id, pos) - 1) // 8 as g from br_long)) group by g)""")
def _(s):
    grouped = P.with_batch(scored(s).select(*HEAD, S.LABEL, S.SCORE), 8, *HEAD, name="group_id")
    # within a group of consecutive rows the slot alone is not unique
    grouped = grouped.withColumn(S.POS, F.struct(*HEAD))
    per = M.per_impression(grouped, [M.auc()], ["group_id"], hot=None)
    return per.agg(F.avg("auc").alias("auc"))


@query("met_15_auc_by_history_length", """
select history_length, round(avg(a), 6) as auc from (
  select history_length, impression_id, (sum(case when label = 1 then mr end) - sum(label) * (sum(label) + 1) / 2.0)
         / nullif(sum(label) * (count(*) - sum(label)), 0) as a
  from (select history_length, impression_id, label,
               rank() over (partition by history_length, impression_id order by sc)
               + (count(*) over (partition by history_length, impression_id, sc) - 1) / 2.0 as mr from sc)
  group by 1, 2) group by 1""", """
rec as (select user_id, article_id, row_number() over (partition by user_id
          order by impression_time desc, impression_id desc, pos desc) as r from br_clicks),
ok as (select user_id from rec group by 1 having count(*) >= 10),
parts as (select user_id, l as history_length, unnest(embedding) as v, generate_subscripts(embedding, 1) as i
          from rec join ok using (user_id) join (select unnest([1, 3, 10]) as l) on r <= l join br_vectors using (article_id)),
um as (select user_id, history_length, i, avg(v) as v from parts group by 1, 2, 3),
uv as (select user_id, history_length::bigint as history_length, list(v order by i) as u from um group by 1, 2),
sc as (select history_length, impression_id, label, round(coalesce(list_dot_product(u, embedding)
         / nullif(sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(embedding, embedding)), 0), 0.0), 9) as sc
       from br_candidates join uv using (user_id) join br_vectors using (article_id))
""")
def _(s):
    return history_length.auc_by_history_length(s.candidates(), s.recent_clicks(10), s.embeddings(), [1, 3, 10], 10, 9, s.hot_impressions())


@query("met_16_auc_over_time", """
select date_trunc('month', impression_time)::timestamp as period, round(avg(auc), 6) as auc from au group by 1""", RANKED)
def _(s):
    out = history_length.auc_over_time(scored(s), "month", s.hot_impressions())
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


# ---- recommenders


@query("rec_1_popularity_scores", """
select article_id, round(ctr, 6) as ctr, round(ctr_norm, 6) as ctr_norm, round(clicks_norm, 6) as clicks_norm,
       round(score, 6) as score from pop""", POPULARITY)
def _(s):
    return popularity(s).select(S.ARTICLE, "ctr", "ctr_norm", "clicks_norm", S.SCORE)


@query("rec_1_popularity_with_engagement", """
select article_id, round(coalesce((mean_read_time - lo) / (hi - lo), 0.0), 6) as read_time_norm,
       round(0.4 * ctr_norm + 0.3 * clicks_norm + 0.2 * coalesce((mean_read_time - lo) / (hi - lo), 0.0)
             + 0.1 * coalesce((mean_scroll_percentage - slo) / (shi - slo), 0.0), 6) as score
from (select *, min(mean_read_time) over () as lo, max(mean_read_time) over () as hi,
             min(mean_scroll_percentage) over () as slo, max(mean_scroll_percentage) over () as shi
      from nm left join eng using (article_id))""", POPULARITY + ", " + ENGAGEMENT)
def _(s):
    scores = popularity_scores(item_statistics(s.slotless()), A.engagement(_engagement_rows(s)),
                               w_ctr=0.4, w_clicks=0.3, w_read_time=0.2, w_scroll=0.1)
    return scores.select(S.ARTICLE, F.coalesce("read_time_norm", F.lit(0.0)).alias("read_time_norm"), S.SCORE)


@query("rec_1_popularity_lists", """
select impression_id, pos, label::bigint as label, round(coalesce(score, 0.0), 6) as score
from br_candidates left join pop using (article_id)""", POPULARITY)
def _(s):
    return popularity_predictions(s.candidates(), popularity(s)).select(*HEAD, S.LABEL, S.SCORE)


@query("rec_1_popularity_report", """
select 'auc' as metric, round(avg((pr - p * (p + 1) / 2) / nullif(p * n, 0)), 6) as value from t
union all select 'mrr', round(avg(recip / nullif(p, 0)), 6) from t""", POPULARITY + """,
cs as (select impression_id, pos, label, round(coalesce(score, 0.0), 9) as score
       from br_candidates left join pop using (article_id)),
cr as (select impression_id, label, row_number() over (partition by impression_id order by score desc, pos desc) as rk,
              rank() over (partition by impression_id order by score)
                + (count(*) over (partition by impression_id, score) - 1) / 2.0 as mr from cs),
t as (select sum(label)::double as p, (count(*) - sum(label))::double as n, sum(label::double / rk) as recip,
             sum(case when label = 1 then mr end) as pr from cr group by impression_id)
""")
def _(s):
    predictions = popularity_predictions(s.candidates(), popularity(s))
    predictions = predictions.withColumn(S.SCORE, F.round(S.SCORE, 9))
    return M.evaluate(predictions, [M.auc(), M.mrr()], s.hot_impressions())


CONTENT = USER_VECTORS + """,
ct as (select user_id, article_id, coalesce(list_dot_product(uv.embedding, v.embedding), 0.0)
         / (coalesce(embedding_norm, 2.220446049250313e-16) * sqrt(list_dot_product(v.embedding, v.embedding))) as score
       from (select distinct user_id, article_id from br_candidates) c
       join br_vectors v using (article_id) left join uv using (user_id))
"""


def content_model(s):
    vecs = s.embeddings().withColumn("embedding_norm", vectors.norm("embedding"))
    users = content.user_vectors(s.slotless().filter(F.col(S.LABEL) == 1), vecs)
    return content.content_scores(s.slotless(), users, vecs)


@query("rec_2_content_scores", "select user_id, article_id, round(score, 6) as score from ct", CONTENT)
def _(s):
    return content_model(s)


@query("rec_3_collaborative")
def _(s):
    users, items = least_squares.fit(s.slotless().filter(F.col(S.LABEL) == 1))
    return least_squares.scores(users, items, s.slotless())


@query("rec_3_spark_als")
def _(s):
    clicks = s.slotless().filter(F.col(S.LABEL) == 1)
    model, users, items = collaborative.fit(clicks)
    return collaborative.scores(model, users, items, s.slotless())


@query("rec_4_hybrid_average", """
select impression_id, pos, label::bigint as label, round((coalesce(p.score, 0.0) + coalesce(ct.score, 0.0)) / 2, 6) as score
from br_candidates c left join pop p using (article_id)
left join ct on ct.user_id = c.user_id and ct.article_id = c.article_id""", POPULARITY + ", " + CONTENT)
def _(s):
    long = s.candidates()
    a = popularity_predictions(long, popularity(s))
    b = L.attach_scores(long, content_model(s))
    return ensemble.average([a, b]).select(*HEAD, S.LABEL, S.SCORE)


@query("rec_5_labeled_lists", """
select impression_id, pos // 4 as segment, string_agg(label::varchar, ',' order by pos) as clicked_labels,
       string_agg((round(coalesce(score, 0.0), 3) + 0.0)::varchar, ',' order by pos) as predicted_score
from br_candidates left join ct using (user_id, article_id) group by 1, 2""", CONTENT)
def _(s):
    folded = L.labeled_segments(L.attach_scores(s.candidates(), content_model(s)), size=4)
    return folded.select(S.IMPRESSION, "segment", lists.text("clicked_labels").alias("clicked_labels"), lists.text(
        F.transform("predicted_score", lambda x: F.round(x, 3))).alias("predicted_score"))


@query("rec_6_static_baselines", """
select impression_id, pos,
       row_number() over (partition by impression_id order by clicks desc, pos desc) as click_rank,
       row_number() over (partition by impression_id order by views desc, pos desc) as inview_rank,
       row_number() over (partition by impression_id order by total_pageviews desc, pos desc) as page_rank,
       row_number() over (partition by impression_id order by reads desc, pos desc) as read_rank
from br_candidates join (
  select article_id, count(*) as views, sum(label) as clicks, sum(read_time) as reads from br_candidates group by 1)
  using (article_id) join br_articles using (article_id)""")
def _(s):
    totals = s.slotless().groupBy(S.ARTICLE).agg(
        F.sum(S.LABEL).alias("clicks"), F.count(F.lit(1)).alias("views"), F.sum(S.READ_TIME).alias("reads"))
    articles = s.articles().select(S.ARTICLE, "total_pageviews").join(totals, S.ARTICLE, "left")
    names = {"clicks": "click_rank", "views": "inview_rank", "total_pageviews": "page_rank", "reads": "read_rank"}
    ranks = ensemble.static_baselines(s.shown(), articles, names)
    return L.explode_lists(ranks, list(names.values()))


@query("rec_8_experiment")
def _(s):
    folder = f"{s.spark.conf.get('spark.sql.warehouse.dir')}/experiment-{uuid.uuid4().hex}"
    long = s.candidates()
    models = {
        "popularity": lambda: popularity_predictions(long, popularity(s)),
        "content": lambda: L.attach_scores(long, content_model(s)),
        "read_time": lambda: scored(s),
    }
    return ensemble.run_experiment(models, folder, hot=s.hot_impressions())


@query("rec_9_scoring_heads", """
select impression_id, pos, round(exp(score - top) / sum(exp(score - top)) over (partition by impression_id), 6) as softmax,
       round(1 / (1 + exp(-score)), 6) as sigmoid
from (select impression_id, pos, score, max(score) over (partition by impression_id) as top
      from (select impression_id, pos, list_dot_product(uv.embedding, v.embedding) as score
            from br_candidates join br_vectors v using (article_id) join uv using (user_id)))""", USER_VECTORS)
def _(s):
    vecs = s.embeddings()
    users = content.user_vectors(s.slotless().filter(F.col(S.LABEL) == 1), vecs)
    scores = content.dot_scores(s.candidates().select(*HEAD, S.USER, S.ARTICLE),
                                users.select(S.USER, F.col("embedding").alias("factors")),
                                vecs.withColumnRenamed("embedding", "factors"))
    return content.sigmoid_head(content.softmax_head(scores, name="softmax", hot=s.hot_impressions()), "sigmoid").select(*HEAD, "softmax", "sigmoid")


@query("mth_2_factor_dot", """
select impression_id, pos, round(list_dot_product(uv.embedding, v.embedding), 6) as score
from br_candidates join br_vectors v using (article_id) join uv using (user_id)""", USER_VECTORS)
def _(s):
    vecs = s.embeddings()
    users = content.user_vectors(s.slotless().filter(F.col(S.LABEL) == 1), vecs)
    return content.dot_scores(s.candidates().select(*HEAD, S.USER, S.ARTICLE),
                              users.select(S.USER, F.col("embedding").alias("factors")),
                              vecs.withColumnRenamed("embedding", "factors")).select(*HEAD, S.SCORE)


# ---- training tables

INDEX = """
ix as (select vec_id as article_id, row_number() over (order by vec_id) as index from embeddings),
hs as (select user_id, list(coalesce(index, 0) order by impression_time, impression_id, pos) as history
       from br_clicks left join ix using (article_id) group by 1),
iv as (select impression_id, list(coalesce(index, 0) order by pos) as inview
       from br_candidates left join ix using (article_id) group by 1)
"""


def article_codes(s):
    return A.dense_codes(s.table("embeddings", "vec_id").withColumnRenamed("vec_id", S.ARTICLE), S.ARTICLE, "index", start=1)


def with_history(s):
    return s.behaviors().join(s.histories().select(S.USER, S.HISTORY_ARTICLES), S.USER, "left")


@query("trn_2_index_table", """
select index, vec_id as article_id, i - 1 as dim, round(v::double, 6) as value
from (select row_number() over (order by vec_id) as index, vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)
union all select 0, null, i - 1, round(avg(v::double), 6)
from (select unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by i""")
def _(s):
    table = K.index_table(s.table("embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", S.ARTICLE),
                          S.ARTICLE, "embedding", "mean")
    return table.select("index", S.ARTICLE, F.posexplode("embedding").alias("dim", "value"))


@query("trn_3_training_lists", """
select b.impression_id, array_to_string(coalesce(hs.history, []), ',') as history,
       array_to_string(coalesce(iv.inview, []), ',') as inview
from br_behaviors b left join hs using (user_id) left join iv on iv.impression_id = b.impression_id""", INDEX)
def _(s):
    encoded = K.encode_lists(with_history(s), article_codes(s), [S.HISTORY_ARTICLES, S.INVIEW])
    return encoded.select(S.IMPRESSION, lists.text(S.HISTORY_ARTICLES).alias("history"), lists.text(S.INVIEW).alias("inview"))


@query("trn_4_scoring_rows", """
select c.impression_id, pos, label::bigint as label, n_samples, array_to_string(coalesce(hs.history, []), ',') as history,
       coalesce(ix.index, 0) as candidate
from br_candidates c join (select impression_id, count(*) as n_samples from br_candidates group by 1) using (impression_id)
left join hs using (user_id) left join ix using (article_id)""", INDEX)
def _(s):
    codes = article_codes(s)
    encoded = K.encode_lists(with_history(s), codes, [S.HISTORY_ARTICLES])
    rows = K.scoring_rows(encoded, S.HISTORY_ARTICLES)
    return K.encode(rows, codes, S.ARTICLE, "candidate").select(
        *HEAD, S.LABEL, "n_samples", lists.text(S.HISTORY_ARTICLES).alias("history"), "candidate")


@query("trn_5_user_index", """
select o_orderkey as impression_id, coalesce(u.index, 0) as user_index from orders left join (
  select user_id, row_number() over (order by user_id) as index from (select distinct user_id from br_clicks)) u
  on user_id = o_custkey""")
def _(s):
    codes = A.dense_codes(s.slotless().filter(F.col(S.LABEL) == 1), S.USER, "index", start=1)
    return K.encode(s.impressions().select(S.IMPRESSION, S.USER), codes, S.USER, "user_index").drop(S.USER)


@query("trn_6_attribute_views", """
select b.impression_id, array_to_string(coalesce(s_h, []), ',') as size_article_id_fixed,
       array_to_string(coalesce(s_i, []), ',') as size_article_ids_inview,
       array_to_string(coalesce(c_h, []), ',') as subcategory_article_id_fixed,
       array_to_string(coalesce(c_i, []), ',') as subcategory_article_ids_inview
from br_behaviors b
left join (select user_id, list(size order by impression_time, impression_id, pos) as s_h,
                  list(subcategory order by impression_time, impression_id, pos) as c_h
           from br_clicks join br_articles using (article_id) group by 1) using (user_id)
left join (select impression_id, list(size order by pos) as s_i, list(subcategory order by pos) as c_i
           from br_candidates join br_articles using (article_id) group by 1) i on i.impression_id = b.impression_id""")
def _(s):
    views = K.encode_views(with_history(s), s.articles(), ["size", "subcategory"], [S.HISTORY_ARTICLES, S.INVIEW])
    return views.select(S.IMPRESSION, *[lists.text(c).alias(c) for c in views.columns if c != S.IMPRESSION])


@query("trn_7_shuffled_rows", """
select impression_id, pos, label::bigint as label, article_id, len(articles)::bigint as history_len, array_to_string(articles, ',') as history
from br_candidates left join br_history using (user_id)""")
def _(s):
    rows = K.scoring_rows(with_history(s), S.HISTORY_ARTICLES)
    return P.shuffle_rows(rows, 23, *HEAD).select(*HEAD, S.LABEL, S.ARTICLE, F.size(S.HISTORY_ARTICLES).alias("history_len"),
                                                  lists.text(S.HISTORY_ARTICLES).alias("history"))


# ---- features

PAIRS = """
up as (select distinct user_id, category from br_clicks join br_articles using (article_id)),
uc as (select user_id, count(*) as n from up group by 1)
"""


@query("fea_1_user_categories", """
select u.user_id, category, n as num_history_categories
from up u join uc using (user_id)""", PAIRS)
def _(s):
    pairs = features.user_categories(s.slotless().filter(F.col(S.LABEL) == 1), s.articles())
    return pairs.join(features.category_breadth(pairs), S.USER)


def feature_rows(s):
    """All features from one history, the whole one: its lists and its categories are the same clicks."""
    clicks = s.clicks()
    pairs = features.user_categories(clicks, s.articles())
    history = s.histories().withColumn(S.HISTORY_SCROLLS, F.transform(S.HISTORY_READ_TIMES, lambda x: x * 2))
    nation, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    reader = s.table("customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").select(
        F.col("c_custkey").alias(S.USER), nation.alias("age"), (F.col("c_acctbal") > 0).alias("is_subscriber"),
        (segment == "BUILDING").alias("is_sso_user"), F.when(nation % 3 < 2, nation % 3).alias("gender"), (nation % 4).alias("device_type"))
    behaviors = s.behaviors().join(reader, S.USER, "left")
    totals = s.slotless().groupBy(S.ARTICLE).agg(F.count(F.lit(1)).alias("total_inviews"), F.sum(S.READ_TIME).alias("total_read_time"))
    articles = s.articles().join(totals, S.ARTICLE, "left").withColumn(
        "published_time", F.lit("1994-12-31 12:00:00").cast("timestamp_ntz"))
    return features.feature_table(behaviors, history, articles, pairs)


FEATURE_SQL = PAIRS + """,
hl as (select user_id, count(*) as n, avg(read_time) as reads from br_clicks group by 1),
tot as (select article_id, count(*) as views, sum(read_time) as reads from br_candidates group by 1),
ft as (
  select c.impression_id, c.user_id, pos, c.article_id, label::bigint as label, impression_time, c_nationkey::bigint as age,
         (c_acctbal > 0)::int::bigint as is_subscriber, (c_mktsegment = 'BUILDING')::int::bigint as is_sso_user,
         case when c_nationkey % 3 < 2 then (c_nationkey % 3)::bigint end as gender, (c_nationkey % 4)::bigint as device_type,
         hour(impression_time) as hour_of_day, isodow(impression_time) as day_of_week, n_in as inview_len,
         coalesce(hl.n, 0) as history_len, round(hl.reads, 6) as history_avg_read_time, round(hl.reads * 2, 6) as history_avg_scroll_pct,
         coalesce(uc.n, 0) as num_history_categories, a.category, premium::bigint as premium, tot.views as total_inviews,
         round(total_pageviews, 6) as total_pageviews, round(tot.reads, 6) as total_read_time, round(sentiment_score, 6) as sentiment_score,
         round(epoch(impression_time - timestamp '1994-12-31 12:00:00') / 3600.0, 6) as article_age_hours,
         (case when up.user_id is null then 0 else 1 end)::bigint as category_match
  from br_candidates c
  join (select impression_id, count(*) as n_in from br_candidates group by 1) using (impression_id)
  left join customer on c_custkey = c.user_id left join hl on hl.user_id = c.user_id left join uc on uc.user_id = c.user_id
  left join br_articles a on a.article_id = c.article_id left join tot on tot.article_id = c.article_id
  left join up on up.user_id = c.user_id and up.category = a.category)
"""


@query("fea_2_feature_table", "select * from ft", FEATURE_SQL)
def _(s):
    return feature_rows(s)


@query("fea_3_feature_vector", "select impression_id, pos, " + ", ".join(
    f"coalesce({'cc.code' if n == 'category' else 'ft.' + n}::double, 'nan'::double) as {n}" for n in features.FEATURES) + """
from ft left join (select category, row_number() over (order by category) - 1 as code from (select distinct category from br_articles)) cc
  using (category)""", FEATURE_SQL)
def _(s):
    rows = features.feature_vector(features.with_codes(feature_rows(s), features.category_codes(s.articles())))
    vector = vector_to_array("features")
    return rows.select(*HEAD, *[F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(features.FEATURES)])


def days_split(s):
    """Feature rows of the days before the last fifth, and of that fifth."""
    rows = features.with_codes(feature_rows(s), features.category_codes(s.articles()))
    cutoff = s.impressions().agg(F.percentile_approx(F.unix_date(F.to_date(S.TIME)), 0.8)).first()[0]
    day = F.unix_date(F.to_date(S.TIME))
    return rows.filter(day < cutoff), rows.filter(day >= cutoff)


def boosted_trees(s, trees=300, depth=6):
    """Candidates of the last fifth of the days, scored by trees fitted on those before."""
    before, after = days_split(s)
    model = boosting.fit(before, features.FEATURES, S.LABEL, HEAD, trees=trees, depth=depth)
    return boosting.score(model, after.select(*HEAD, S.LABEL, *features.FEATURES), S.SCORE)


@query("fea_4_boosted_trees")
def _(s):
    return boosted_trees(s).select(*HEAD, S.LABEL, S.SCORE)


def spark_trees(s):
    """The same with Spark ML's trees, of the same full setting."""
    before, after = days_split(s)
    return features.score_trees(features.fit_trees(before), after)


@query("fea_4_spark_trees")
def _(s):
    return spark_trees(s).select(*HEAD, S.LABEL, S.SCORE)


@query("fea_5_attach_flat_scores", """
select o_orderkey as impression_id, segment, scores from orders left join (
  select impression_id, pos // 4 as segment, string_agg((read_time / 50.0)::varchar, ',' order by pos) as scores
  from br_candidates group by 1, 2) on impression_id = o_orderkey""")
def _(s):
    df = L.attach_score_segments(s.impressions().select(S.IMPRESSION), scored(s).select(*HEAD, S.SCORE), size=4)
    return df.select(S.IMPRESSION, "segment", lists.text("scores").alias("scores"))


@query("udf_4_own_metric", """
select 'hit' as metric, round(avg((label = 1)::int), 6) as value from (
  select impression_id, label, row_number() over (partition by impression_id order by score desc, pos) as r from br_long) where r = 1""")
def _(s):
    def hit(labels, scores):
        return labels[scores.argmax()]

    return M.python_metric(scored(s), "hit", hit)


@query("str_4_text_vectors")
def _(s):
    vecs = encoding.hashed_vectors(s.table("documents", "doc_id", "text"), "text", 64)
    return vecs.select("doc_id", F.size("embedding").alias("dims"), vectors.norm("embedding").alias("norm"))


@query("str_3_subword_ids")
def _(s):
    import public_tokenizers

    ids = encoding.subword_ids(s.table("documents", "doc_id", "text"), "text", public_tokenizers.path("word_bpe_49k.json"), max_length=128)
    return ids.select("doc_id", lists.text("text_encode_word_bpe_49k").alias("text_encode_word_bpe_49k"))


@query("snk_1_chunked_scores", "select impression_id, pos, article_id, round(read_time / 50.0, 6) as score from br_candidates")
def _(s):
    folder = f"{ensure_checkpoint_dir(s.spark)}/scores-{uuid.uuid4().hex}"
    long = s.candidates().select(*HEAD, S.ARTICLE, S.READ_TIME)
    score_chunks(long, folder, "read_time", lambda df: df.select(*HEAD, S.ARTICLE, (F.col(S.READ_TIME) / 50.0).alias(S.SCORE)), 5)
    return read_scores(s.spark, folder, "read_time").select(*HEAD, S.ARTICLE, S.SCORE)


@query("src_6_average_of_files", """
select impression_id, pos, label::bigint as label, round((read_time / 50.0 + coalesce(p.score, 0.0)) / 2, 6) as score
from br_candidates left join pop p using (article_id)""", POPULARITY)
def _(s):
    """Every prediction file below a folder is a model; their scores are averaged."""
    folder = f"{ensure_checkpoint_dir(s.spark)}/predictions-{uuid.uuid4().hex}"
    long = s.candidates()
    sinks.write_predictions(scored(s).select(*HEAD, S.LABEL, S.SCORE), folder, "read_time")
    sinks.write_predictions(popularity_predictions(long, popularity(s)).select(*HEAD, S.LABEL, S.SCORE), folder, "popularity")
    files = tables.read_tree(s.spark, folder).withColumn("model", F.regexp_extract("source_file", "model=([^/]*)/", 1))
    return ensemble.average([files.filter(F.col("model") == m) for m in ("read_time", "popularity")]).select(*HEAD, S.LABEL, S.SCORE)
