"""List-column and scalar functions."""

from pyspark.sql import functions as F

from catalog.registry import query
from slatewise import schema as S
from slatewise.functions import lists, scalars
from slatewise.operators import longform as L
from slatewise.operators import lookup as K
from slatewise.operators.sampling import sample_negatives
from slatewise.plans import ensemble

HEAD = [S.IMPRESSION, S.POS]
REMOVED = "list_filter(inview, lambda x: not coalesce(list_contains(clicked, x), false))"


@query("arr_1_click_labels", "select impression_id, pos, label::bigint as label from br_candidates")
def _(s):
    labelled = L.with_click_labels(s.behaviors())
    return L.explode_lists(labelled.select(S.IMPRESSION, S.LABELS), [S.LABELS], [S.LABEL])


@query("arr_1_labels_of_shuffled", "select impression_id, article_id, label::bigint as label from br_candidates")
def _(s):
    labelled = L.with_click_labels(s.behaviors(), shuffle_seed=3)
    return L.explode_lists(labelled.select(S.IMPRESSION, S.INVIEW, S.LABELS), [S.INVIEW, S.LABELS],
                           [S.ARTICLE, S.LABEL]).drop(S.POS)


@query("arr_2_membership", """
select impression_id, coalesce(list_contains(clicked, inview[1]), false) as first_clicked from br_behaviors""")
def _(s):
    first = F.try_element_at(F.col(S.INVIEW), F.lit(1))
    return s.behaviors().select(S.IMPRESSION, lists.contains(S.CLICKED, first).alias("first_clicked"))


@query("arr_3_remove_clicked", f"""
select impression_id, array_to_string({REMOVED}, ',') as unclicked from br_behaviors""")
def _(s):
    return s.behaviors().select(S.IMPRESSION, lists.text(lists.without(S.INVIEW, S.CLICKED)).alias("unclicked"))


@query("arr_4_keep_ids_in_list", """
select impression_id, case when len(k) > 0 then array_to_string(k, ',') end as kept
from (select impression_id, list_filter(inview, lambda x: x % 7 < 2) as k from br_behaviors)""")
def _(s):
    # the id set of each row is a list beside it: here its own ids with remainder 0 or 1
    ids = F.filter(S.INVIEW, lambda x: x % 7 < 2)
    return s.behaviors().select(S.IMPRESSION, lists.text(lists.keep_in(S.INVIEW, ids)).alias("kept"))


@query("arr_4_keep_ids_of_table", """
select impression_id, case when len(k) > 0 then array_to_string(k, ',') end as kept
from (select impression_id, list_filter(inview, lambda x: list_contains(ids, x)) as k
      from br_behaviors, (select list(vec_id) as ids from embeddings))""")
def _(s):
    ids = s.table("embeddings", "vec_id").select(F.col("vec_id").alias(S.ARTICLE), F.col("vec_id").alias("id"))
    mapped = K.map_list(s.behaviors().select(S.IMPRESSION, S.INVIEW), [S.IMPRESSION], S.INVIEW, ids, S.ARTICLE, "id",
                        drop_unknown=True)
    return mapped.select(S.IMPRESSION, lists.text(S.INVIEW).alias("kept"))


@query("arr_5_drop_nulls", """
select impression_id, array_to_string(list_filter(inview, lambda x: x % 3 > 0), ',') as kept from br_behaviors""")
def _(s):
    holes = F.transform(S.INVIEW, lambda x: F.when(x % 3 > 0, x))
    return s.behaviors().select(S.IMPRESSION, lists.text(lists.drop_nulls(holes)).alias("kept"))


@query("arr_6_distinct_values", """
select impression_id, array_to_string(list_sort(list_distinct(list_transform(inview, lambda x: x % 5))), ',') as kept
from br_behaviors""")
def _(s):
    return s.behaviors().select(
        S.IMPRESSION, lists.text(lists.distinct_sorted(F.transform(S.INVIEW, lambda x: x % 5))).alias("kept"))


@query("arr_7_shuffle_list", "select impression_id, array_to_string(list_sort(inview), ',') as members from br_behaviors")
def _(s):
    shuffled = lists.stable_shuffle(S.INVIEW, 9, [S.IMPRESSION])
    return s.behaviors().select(S.IMPRESSION, lists.text(F.array_sort(shuffled)).alias("members"))


@query("arr_8_tail", "select impression_id, array_to_string(inview[-3:], ',') as kept from br_behaviors")
def _(s):
    return s.behaviors().select(S.IMPRESSION, lists.text(lists.tail(S.INVIEW, 3)).alias("kept"))


@query("arr_9_truncate_and_pad", """
select impression_id, array_to_string(list_concat([0,0,0,0], inview)[-4:], ',') as kept from br_behaviors""")
def _(s):
    return s.behaviors().select(S.IMPRESSION, lists.text(lists.truncate(S.INVIEW, 4, F.lit(0).cast("long"))).alias("kept"))


@query("arr_10_sample_list", """
select impression_id, case when len(inview) = 0 then 0 else 4 end::bigint as n, true as members from br_behaviors""")
def _(s):
    drawn = lists.sample(S.INVIEW, 4, 21, [S.IMPRESSION], replace=True)
    df = s.behaviors().select(S.IMPRESSION, S.INVIEW, drawn.alias("d"))
    return df.select(S.IMPRESSION, F.size(F.array_compact("d")).alias("n"),
                     F.forall(F.array_compact("d"), lambda x: F.array_contains(S.INVIEW, x)).alias("members"))


@query("arr_11_append_clicked", f"""
select impression_id, array_to_string(list_concat({REMOVED}, [clicked[1]]), ',') as pool, clicked[1] as last
from br_behaviors where clicked is not null""")
def _(s):
    df = s.behaviors().filter(F.col(S.CLICKED).isNotNull())
    pool = F.concat(lists.without(S.INVIEW, S.CLICKED), F.array(F.element_at(S.CLICKED, 1)))
    return df.select(S.IMPRESSION, lists.text(pool).alias("pool"), F.element_at(lists.tail(pool, 1), 1).alias("last"))


@query("arr_12_explode_aligned", """
select impression_id, pos, article_id, read_time from br_candidates
union all select impression_id, null, null, null from br_behaviors where len(inview) = 0""")
def _(s):
    df = s.behaviors().select(S.IMPRESSION, S.INVIEW, "read_times")
    return L.explode_lists(df, [S.INVIEW, "read_times"], [S.ARTICLE, S.READ_TIME], keep_empty=True)


@query("arr_13_list_reductions", """
select impression_id, len(reads)::bigint as n, round(list_avg(reads), 6) as mean, reads[1] as first,
       list_min(reads) as least, list_max(reads) as most, round(sqrt(list_dot_product(reads, reads)), 6) as norm
from br_behaviors where len(reads) > 0""")
def _(s):
    from slatewise.functions import vectors

    c = F.col("read_times")
    return s.shown().select(S.IMPRESSION, lists.length(c).alias("n"), lists.mean(c).alias("mean"),
                            F.try_element_at(c, F.lit(1)).alias("first"), F.array_min(c).alias("least"),
                            F.array_max(c).alias("most"), vectors.norm(c).alias("norm"))


MAPPED = """
m as (select impression_id, pos, c.article_id, label from br_candidates c join embeddings on vec_id = c.article_id)
"""


def _labels_of_articles(s):
    return s.table("embeddings", "vec_id", "label").select(F.col("vec_id").alias(S.ARTICLE), F.col("label").alias("value"))


@query("arr_14_map_keep_null", """
select impression_id, array_to_string(list_transform(v, lambda x: coalesce(x::varchar, '-')), ',') as mapped
from (select impression_id, list(e.label order by pos) as v
      from br_candidates c left join embeddings e on vec_id = c.article_id group by 1)
union all select impression_id, '' from br_behaviors where len(inview) = 0""")
def _(s):
    mapped = K.map_list(s.behaviors().select(S.IMPRESSION, S.INVIEW), [S.IMPRESSION], S.INVIEW, _labels_of_articles(s),
                        S.ARTICLE, "value")
    return mapped.select(S.IMPRESSION, lists.text(S.INVIEW, null="-").alias("mapped"))


@query("arr_14_map_fill", """
select impression_id, array_to_string(v, ',') as mapped
from (select impression_id, list(coalesce(e.label, -1) order by pos) as v
      from br_clicks c left join embeddings e on vec_id = c.article_id group by 1)
union all select impression_id, '-1' from br_behaviors where clicked is null""")
def _(s):
    mapped = K.map_list(s.behaviors().select(S.IMPRESSION, S.CLICKED), [S.IMPRESSION], S.CLICKED, _labels_of_articles(s),
                        S.ARTICLE, "value", fill=F.lit(-1))
    return mapped.select(S.IMPRESSION, lists.text(S.CLICKED).alias("mapped"))


@query("arr_14_map_drop", """
select b.impression_id, array_to_string(v, ',') as mapped from br_behaviors b left join (
  select impression_id, list(e.label order by pos) as v
  from br_clicks c join embeddings e on vec_id = c.article_id group by 1) x on x.impression_id = b.impression_id""")
def _(s):
    mapped = K.map_list(s.behaviors().select(S.IMPRESSION, S.CLICKED), [S.IMPRESSION], S.CLICKED, _labels_of_articles(s),
                        S.ARTICLE, "value", drop_unknown=True)
    return mapped.select(S.IMPRESSION, lists.text(S.CLICKED).alias("mapped"))


@query("arr_15_replace_or_zero", """
select impression_id, pos, coalesce(e.label, 0)::bigint as value
from br_candidates c left join embeddings e on vec_id = c.article_id""")
def _(s):
    return K.map_long(s.candidates().select(*HEAD, S.ARTICLE), _labels_of_articles(s), S.ARTICLE, "value",
                      fill=F.lit(0)).select(*HEAD, "value")


@query("arr_16_element_arithmetic", """
select impression_id, pos, round(score - 0.5, 6) as shifted, round(1 / score, 6) as inverse, round(score * score, 6) as square
from br_long""")
def _(s):
    p = F.transform("read_times", lambda x: x / 50.0)
    df = s.shown().select(
        S.IMPRESSION, F.transform(p, lambda x: x - 0.5).alias("shifted"),
        F.transform(p, lambda x: F.try_divide(F.lit(1.0), x)).alias("inverse"), F.transform(p, lambda x: x * x).alias("square"))
    return L.explode_lists(df, ["shifted", "inverse", "square"])


@query("arr_17_decay_weights", """
select impression_id, pos, round((pos + 1) / n::double, 6) as linear, round(pow(0.5, n - pos - 1), 6) as exponential
from (select impression_id, pos, count(*) over (partition by impression_id) as n from br_candidates)""")
def _(s):
    n = F.size(S.INVIEW)
    df = s.behaviors().select(S.IMPRESSION, lists.linear_decay(n).alias("linear"),
                              lists.exponential_decay(0.5)(n).alias("exponential"))
    return L.explode_lists(df, ["linear", "exponential"])


@query("arr_18_weights_of_lists", """
select impression_id, len(clicked)::bigint as n, round(coalesce(
  list_sum(list_transform(range(1, coalesce(len(clicked), 0) + 1), lambda i: i / len(clicked)::double)), 0.0), 6) as total
from br_behaviors""")
def _(s):
    df = s.behaviors().withColumn("w", lists.decay_weights(S.CLICKED, lists.linear_decay, ascending=False))
    return df.select(S.IMPRESSION, F.size(S.CLICKED).alias("n"),
                     F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("arr_19_weight_nested_lists", """
select impression_id, pos, round(read_time * (pos + 1) / n, 6) as a, round(label * (pos + 1) / n::double, 6) as b
from (select *, count(*) over (partition by impression_id) as n from br_candidates)""")
def _(s):
    df = s.shown()
    pairs = F.zip_with("read_times", lists.click_labels(S.INVIEW, S.CLICKED), lambda x, y: F.array(x, y.cast("double")))
    weighted = lists.weight_nested(pairs, lists.linear_decay(F.size(S.INVIEW)))
    rows = L.explode_lists(df.select(S.IMPRESSION, weighted.alias("w")), ["w"])
    return rows.select(*HEAD, F.element_at("w", 1).alias("a"), F.element_at("w", 2).alias("b"))


@query("arr_20_sublists", """
select impression_id, string_agg(part, '|' order by c) as parts from (
  select impression_id, pos // 2 as c, string_agg(article_id::varchar, ',' order by pos) as part
  from br_candidates group by 1, 2) group by 1""")
def _(s):
    cut = F.transform(lists.chunks(S.INVIEW, 2), lambda c: F.array_join(c.cast("array<string>"), ","))
    return s.shown().select(S.IMPRESSION, F.array_join(cut, "|").alias("parts"))


@query("arr_21_combinations", """
select impression_id, round(len(inview) * (len(inview) - 1) / 2, 6) as pairs,
       round(len(inview) * (len(inview) - 1) * (len(inview) - 2) / 6, 6) as triples from br_behaviors""")
def _(s):
    n = F.size(S.INVIEW)
    return s.behaviors().select(S.IMPRESSION, scalars.combinations(n, 2).alias("pairs"),
                                scalars.combinations(n, 3).alias("triples"))


@query("arr_22_threshold", "select impression_id, pos, (score >= 0.5)::int::bigint as hit from br_long")
def _(s):
    p = F.transform("read_times", lambda x: x / 50.0)
    return L.explode_lists(s.shown().select(S.IMPRESSION, lists.threshold(p, 0.5).alias("hit")), ["hit"])


@query("trn_1_negative_sampling", """
select impression_id, count(*) as n_rows, 5::bigint as width, true as click_last, true as negatives_unclicked
from br_clicks group by 1""")
def _(s):
    df = s.behaviors().filter(F.col(S.CLICKED).isNotNull()).select(S.IMPRESSION, S.INVIEW, S.CLICKED)
    rows = sample_negatives(df, 4, 31)
    truth = df.select(S.IMPRESSION, F.col(S.CLICKED).alias("all_clicked"))
    checked = rows.join(truth, S.IMPRESSION).select(
        S.IMPRESSION, F.size(S.INVIEW).alias("width"),
        (F.element_at(S.INVIEW, -1) == F.element_at(S.CLICKED, 1)).alias("last"),
        F.forall(F.array_compact(F.slice(S.INVIEW, 1, 4)), lambda x: ~F.array_contains("all_clicked", x)).alias("neg"))
    return checked.groupBy(S.IMPRESSION).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("width").alias("width"), F.bool_and("last").alias("click_last"),
        F.bool_and("neg").alias("negatives_unclicked"))


@query("mth_3_mean_of_scores", """
select impression_id, pos, round((score + label + 0.25) / 3, 6) as score from br_long""")
def _(s):
    long = s.candidates()
    a = long.withColumn(S.SCORE, F.col(S.READ_TIME) / 50.0)
    b = long.withColumn(S.SCORE, F.col(S.LABEL).cast("double"))
    c = long.withColumn(S.SCORE, F.lit(0.25))
    return ensemble.average([a, b, c]).select(*HEAD, S.SCORE)


@query("mth_4_smoothed_ratio", """
select article_id, round((c + 200.0 * 0.5) / (n + 200.0) * (case when c < 10 then 0.5 else 1 end), 6) as ratio
from (select article_id, count(*) as n, sum(label) as c from br_candidates group by 1) where c > 0""")
def _(s):
    from slatewise.plans.popularity import item_statistics

    smooth = scalars.smoothed_ratio(F.col("clicks"), F.col("impressions"), F.lit(0.5), 200)
    return item_statistics(s.slotless()).select(
        S.ARTICLE, F.when(F.col("clicks") < 10, smooth * 0.5).otherwise(smooth).alias("ratio"))


@query("mth_5_information_and_loss", """
select impression_id, pos, round(-log2(score), 6) as information, round(pow(2, label) - 1, 6) as gain,
       round(-ln(case when label = 1 then greatest(least(score, 1 - 1e-11), 1e-11)
                      else 1 - greatest(least(score, 1 - 1e-11), 1e-11) end), 6) as loss
from br_long""")
def _(s):
    p = F.col(S.READ_TIME) / 50.0
    return s.candidates().select(*HEAD, scalars.self_information(p).alias("information"),
                                 scalars.gain(F.col(S.LABEL)).alias("gain"),
                                 scalars.log_loss(F.col(S.LABEL), p).alias("loss"))
