"""Grouped summaries, calibration and weak labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import distance
from tessera.functions.geometry import confidence_bin
from tessera.functions.text import flag, rule_field, words
from tessera.operators import evaluation, labels
from tessera.operators.learning import standardized
from tessera.plans.features import M2_SQL
from tessera.plans.registry import query
from tessera.plans.strings import LINES, NAMES, RENDERED, RULED, STRIP, TURNS, _overlap_sql, _weak_sql, edits, lines, names, rendered, sql_words, turns, up
from tessera.sources.tables import Tables


@query("a1_group_mean", "SELECT user_id, avg(value) AS avg_ocr_conf FROM events GROUP BY 1")
def a1(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.avg("value").alias("avg_ocr_conf"))


@query("a2_ordered_text", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined FROM conversations GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(in_order, " ").alias("joined"))


@query("a3_engine_summary", "SELECT event_type AS engine, round_even(avg(value), 4) AS cer_mean, round_even(avg(value / 500), 4) AS wer_mean, round_even(max(value), 4) AS latency_max FROM events GROUP BY 1")
def a3(t: Tables) -> DataFrame:
    mean = lambda x: F.bround(F.avg(x), 4)
    return t.events.groupBy(F.col("event_type").alias("engine")).agg(
        mean("value").alias("cer_mean"), mean(F.col("value") / 500).alias("wer_mean"), F.bround(F.max("value"), 4).alias("latency_max")
    )


@query("a4_mean_std", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query("a5_median_by_bin", f"SELECT bin, median(value) AS median FROM (SELECT value, {M2_SQL} AS bin FROM events) WHERE bin IS NOT NULL GROUP BY bin")
def a5(t: Tables) -> DataFrame:
    return labels.binned_median(t.events.withColumn("conf", F.col("value") / 500), "conf", "value")


@query("a6_two_keys", "SELECT source AS tier, CASE WHEN lang = 'en' THEN 'home' ELSE 'abroad' END AS origin, avg(n_chars) AS blur_mean FROM documents GROUP BY 1, 2")
def a6(t: Tables) -> DataFrame:
    origin = F.when(F.col("lang") == "en", "home").otherwise("abroad")
    return t.documents.groupBy(F.col("source").alias("tier"), origin.alias("origin")).agg(F.avg("n_chars").alias("blur_mean"))


@query("a7_any", "SELECT user_id, bool_or(event_type = 'purchase') AS has_purchase, bool_or(event_type = 'error') AS has_error FROM events GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    has = lambda k: F.bool_or(F.col("event_type") == k)
    return t.events.groupBy("user_id").agg(has("purchase").alias("has_purchase"), has("error").alias("has_error"))


@query("a8_reject_rate", "SELECT lang, avg(coalesce((quality < 1)::INT, 0)) AS reject_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a8(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(evaluation.rate(F.col("quality") < 1).alias("reject_rate"))


@query("a9_value_counts", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def a9(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("a10_global_stats", "SELECT round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(avg(value / 500), 6) AS latency FROM events")
def a10(t: Tables) -> DataFrame:
    return t.events.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.avg(F.col("value") / 500), 6).alias("latency"))


@query("a11_column_means", "SELECT round(avg(l_quantity), 6) AS baseline, round(avg(l_discount), 6) AS no_spatial, round(avg(l_tax), 6) AS no_regex FROM lineitem")
def a11(t: Tables) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return t.lineitem.agg(mean("l_quantity").alias("baseline"), mean("l_discount").alias("no_spatial"), mean("l_tax").alias("no_regex"))


@query("a12_arg_min", "SELECT event_type, arg_min(event_id, struct_pack(v := value, i := event_id)) AS least, arg_min(event_id, struct_pack(v := -value, i := event_id)) AS most FROM events GROUP BY 1")
def a12(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.min_by("event_id", F.struct("value", "event_id")).alias("least"), F.min_by("event_id", F.struct(-F.col("value"), "event_id")).alias("most")
    )


@query("a13_min_max", "SELECT min(l_quantity) AS q_min, max(l_quantity) AS q_max, min(l_extendedprice) AS p_min, max(l_extendedprice) AS p_max FROM lineitem")
def a13(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.min("l_quantity").alias("q_min"), F.max("l_quantity").alias("q_max"), F.min("l_extendedprice").alias("p_min"), F.max("l_extendedprice").alias("p_max"))


@query("a14_zscore", """SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS z FROM part""")
def a14(t: Tables) -> DataFrame:
    return standardized(t.part.select("p_partkey", "p_size"), {"p_size": "z"}).select("p_partkey", F.round("z", 6).alias("z"))


@query("a16_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS qp, round(corr(l_quantity, l_discount), 6) AS qd, round(corr(l_extendedprice, l_tax), 6) AS pt FROM lineitem")
def a16(t: Tables) -> DataFrame:
    corr = lambda a, b: F.round(F.corr(a, b), 6)
    return t.lineitem.agg(corr("l_quantity", "l_extendedprice").alias("qp"), corr("l_quantity", "l_discount").alias("qd"), corr("l_extendedprice", "l_tax").alias("pt"))


@query("a17_duplicate_identities", "SELECT n, count(*) AS identities FROM (SELECT c_name || '__' || c_mktsegment AS k, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1")
def a17(t: Tables) -> DataFrame:
    key = F.concat_ws("__", "c_name", "c_mktsegment")
    photos = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return photos.groupBy("n").agg(F.count(F.lit(1)).alias("identities"))


KIND = """CASE WHEN x = '' THEN 'empty' WHEN regexp_full_match(x, '\\d{4}-\\d{2}-\\d{2}') THEN 'YYYY-MM-DD' WHEN regexp_full_match(x, '\\d{4}') THEN 'YYYY'
  WHEN regexp_full_match(x, '\\d{2}\\.\\d{2}\\.\\d{4}') THEN 'DD.MM.YYYY' ELSE 'other' END"""


@query("a18_date_formats", f"WITH {RENDERED} SELECT {KIND} AS format, count(*) AS n FROM (SELECT written[7:] AS x FROM d UNION ALL SELECT iso FROM d) GROUP BY 1")
def a18(t: Tables) -> DataFrame:
    d = rendered(t)
    x = d.select(F.substring("written", 7, 100).alias("x")).union(d.select("iso"))
    c = F.col("x")
    kind = F.when(c == "", "empty").when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "YYYY-MM-DD").when(c.rlike(r"^\d{4}$"), "YYYY").when(c.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), "DD.MM.YYYY").otherwise("other")
    return x.groupBy(kind.alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query("a19_length_distribution", "SELECT lang, min(length(text)) AS shortest, quantile_cont(length(text), 0.5)::DOUBLE AS middle, max(length(text)) AS longest FROM documents GROUP BY 1")
def a19(t: Tables) -> DataFrame:
    n = F.length("text").cast("bigint")
    return t.documents.groupBy("lang").agg(F.min(n).alias("shortest"), F.percentile(n, 0.5).alias("middle"), F.max(n).alias("longest"))


@query("m11_latency", "SELECT user_id, sum(CASE event_type WHEN 'view' THEN value END) AS localise, sum(CASE event_type WHEN 'view' THEN value END) + sum(CASE event_type WHEN 'click' THEN value END) AS total FROM events GROUP BY 1")
def m11(t: Tables) -> DataFrame:
    part = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    return t.events.groupBy("user_id").agg(part("view").alias("localise"), (part("view") + part("click")).alias("total"))


@query("w9_first_good_bin", f"SELECT coalesce(min(bin) FILTER (WHERE m >= 150), 0.85::DOUBLE) AS threshold FROM (SELECT bin, median(value) AS m FROM (SELECT value, {M2_SQL} AS bin FROM events) WHERE bin IS NOT NULL GROUP BY bin)")
def w9(t: Tables) -> DataFrame:
    return labels.threshold(t.events.withColumn("conf", F.col("value") / 500), "conf", "value", F.col("median") >= 150)


CURVE = f"""c AS (SELECT conv_id, avg(CASE WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - len(list_intersect(r, h)) / len(r)::DOUBLE END) AS pseudo_cer, avg(length(hyp) % 100) / 100 AS conf
  FROM (SELECT conv_id, hyp, list_distinct(list_filter(regexp_split_to_array({up('hyp')}, '\\s+'), lambda w: w <> '')) AS h, list_distinct(list_filter(regexp_split_to_array({up('ref')}, '\\s+'), lambda w: w <> '')) AS r FROM p) GROUP BY 1)"""


@query("x5_triage_curve", f"WITH {TURNS}, {CURVE}, b AS (SELECT *, {M2_SQL.replace('value / 500', 'conf')} AS bin FROM c) SELECT bin, round(median(pseudo_cer), 9) AS median FROM b WHERE bin IS NOT NULL GROUP BY 1")
def x5(t: Tables) -> DataFrame:
    return labels.binned_median(curve(t), "conf", "pseudo_cer").select("bin", F.round("median", 9).alias("median"))


def curve(t: Tables) -> DataFrame:
    """(conv_id, pseudo_cer, conf): the mean error of a conversation's turns, and a stand-in for confidence."""
    return turns(t).groupBy("conv_id").agg(F.avg(distance.pseudo_cer(F.col("hyp"), F.col("ref"))).alias("pseudo_cer"), (F.avg(F.length("hyp") % 100) / 100).alias("conf"))


READ_SQL = f"""w AS (SELECT conv_id, {sql_words(up('text'))} AS r, (length(text) % 100) / 100 AS conf FROM conversations),
h AS (SELECT conv_id, conf, r, list_distinct(list_filter(r, lambda x, i: i <= ceil(conf * len(r)))) AS h FROM w),
c AS (SELECT conv_id, conf, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(r, lambda x: len(list_filter(h, lambda y:
  CASE WHEN length(x) >= 4 THEN {edits('x', 'y')} <= 1 ELSE x = y END)) > 0)) / len(r)::DOUBLE END AS recall FROM h)"""


def read_in_part(t: Tables) -> DataFrame:
    """(conv_id, conf, recall): turns of which a share of the words, taken for the confidence, is read."""
    read = t.conversations.select("conv_id", "text", ((F.length("text") % 100) / 100).alias("conf"), words(F.upper("text")).alias("w"))
    hyp = F.array_join(F.filter("w", lambda x, i: i < F.ceil(F.col("conf") * F.size("w"))), " ")
    return read.select("conv_id", "conf", distance.token_recall(hyp, F.col("text")).alias("recall"))


@query("l18_train_threshold", f"""WITH {READ_SQL}, k AS (SELECT unnest(range(5)) AS fold),
b AS (SELECT fold, {M2_SQL.replace('value / 500', 'conf')} AS bin, median(recall) AS m FROM c, k WHERE conv_id % 5 <> fold GROUP BY 1, 2)
SELECT fold, coalesce(min(bin) FILTER (WHERE m >= 0.8), 0.85::DOUBLE) AS threshold FROM b WHERE bin IS NOT NULL GROUP BY 1""")
def l18(t: Tables) -> DataFrame:
    """For each fold, the lower edge of the first bin of confidence whose median recall over the other folds is 0.8."""
    rows = read_in_part(t).withColumn("bin", confidence_bin(F.col("conf"))).where("bin IS NOT NULL")
    others = rows.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), lambda k: k != F.col("conv_id") % 5)))
    medians = others.groupBy("fold", "bin").agg(F.median("recall").alias("m"))
    return medians.groupBy("fold").agg(F.coalesce(F.min(F.when(F.col("m") >= 0.8, F.col("bin"))), F.lit(0.85)).alias("threshold"))


@query("x1_overlap_distribution", f"""WITH {TURNS}, o AS (SELECT {_overlap_sql('hyp', 'ref')} AS m FROM p)
SELECT count(*) FILTER (WHERE m >= 0.3) AS at_30, count(*) FILTER (WHERE m >= 0.4) AS at_40, count(*) FILTER (WHERE m >= 0.5) AS at_50, count(*) AS n FROM o""")
def x1(t: Tables) -> DataFrame:
    m = turns(t).select(distance.token_overlap(F.col("hyp"), F.col("ref")).alias("m"))
    at = lambda x: F.count_if(F.col("m") >= x)
    return m.agg(at(0.3).alias("at_30"), at(0.4).alias("at_40"), at(0.5).alias("at_50"), F.count(F.lit(1)).alias("n"))


@query("x2_weak_label", f"""WITH {NAMES}, s AS (SELECT p_partkey, {_overlap_sql("hyp", "ref")} AS name,
  (levenshtein(lower({_weak_sql("hyp")}), '1999-01-01') / 10::DOUBLE < 0.3::DOUBLE)::INT::DOUBLE AS birth, {_overlap_sql("hyp", "'Red Brand'")} AS address FROM n)
SELECT p_partkey, CASE WHEN greatest(name, birth, address) < 0.5 THEN 'other' WHEN name = greatest(name, birth, address) THEN 'name'
  WHEN birth = greatest(name, birth, address) THEN 'birth_date' ELSE 'address' END AS label FROM s""")
def x2(t: Tables) -> DataFrame:
    s = labels.weak_scores(F.col("hyp"), F.col("ref"), F.lit("1999-01-01"), F.lit("Red Brand"))
    scored = names(t).select("p_partkey", *[c.alias(k) for k, c in s.items()])
    return scored.select("p_partkey", labels.weak_label(F.col("name"), F.col("birth_date"), F.col("address")).alias("label"))


@query("x4_borderline", f"WITH {TURNS}, o AS (SELECT conv_id, turn, {_overlap_sql('hyp', 'ref')} AS m FROM p) SELECT conv_id, turn, m FROM o WHERE m >= 0.3 AND m < 0.5")
def x4(t: Tables) -> DataFrame:
    m = turns(t).select("conv_id", "turn", distance.token_overlap(F.col("hyp"), F.col("ref")).alias("m"))
    return m.where("m >= 0.3 AND m < 0.5")


@query("x6_label_coverage", f"""WITH {LINES}, f AS (SELECT doc_id, {RULED} AS field FROM (SELECT *, {up(STRIP.format('text'))} AS u FROM l))
SELECT doc_id, bool_or(field = 'name') AS has_name, bool_or(field = 'birth_date') AS has_dob, bool_or(field = 'address') AS has_addr FROM f GROUP BY 1""")
def x6(t: Tables) -> DataFrame:
    fields = lines(t).select("doc_id", rule_field(F.col("text")).alias("field"))
    has = lambda k: F.bool_or(F.col("field") == k)
    return fields.groupBy("doc_id").agg(has("name").alias("has_name"), has("birth_date").alias("has_dob"), has("address").alias("has_addr"))


@query("a24_subsets", "SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS subset, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY GROUPING SETS ((lang), ())")
def a24(t: Tables) -> DataFrame:
    sets = t.documents.rollup("lang").agg(F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("mean"))
    return sets.select(F.when(F.col("g") == 1, "all").otherwise(F.col("lang")).alias("subset"), "n", "mean")


@query("a26_extracted_rate", f"WITH {RENDERED} SELECT avg((trim(CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE written END) <> '')::INT) AS extracted FROM d")
def a26(t: Tables) -> DataFrame:
    found = F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("written"))
    return rendered(t).agg(F.avg(flag(F.length(F.trim(found)) > 0)).alias("extracted"))
