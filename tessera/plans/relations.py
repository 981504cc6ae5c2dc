"""Scans, sinks, caches, projections, joins, sorts and sets over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import flag, null_literals
from tessera.operators.extraction import country_of
from tessera.plans.registry import query
from tessera.plans.strings import stands, up
from tessera.sources import tables as io
from tessera.sources.tables import Tables


@query("s1_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s1(t: Tables) -> DataFrame:
    path = io.scratch(t.spark, "nation-csv")
    io.write_csv(t.nation, path)
    return io.read_csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("s1b_csv_joined", "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def s1b(t: Tables) -> DataFrame:
    """Two files of declared types, dates and numbers and nulls among them, read and joined."""
    left, right = io.scratch(t.spark, "orders-csv"), io.scratch(t.spark, "customer-csv")
    io.write_csv(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("day")), left)
    io.write_csv(t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment")), right)
    orders = io.read_csv(t.spark, left, "o_orderkey bigint, o_custkey bigint, o_totalprice double, day date")
    people = io.read_csv(t.spark, right, "c_custkey bigint, c_name string, segment string")
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_totalprice", F.date_format("day", "yyyy-MM-dd").alias("day"), "c_name", "segment")


@query("s2_csv_repair", "SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment, NULL::VARCHAR AS extra FROM customer")
def s2(t: Tables) -> DataFrame:
    inner = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('""'), F.col("c_name"), F.lit('""')), F.col("c_mktsegment"))
    lines = t.customer.select(F.explode(F.array(F.concat(F.lit('  "'), inner, F.lit('" ')), F.lit("   "))).alias("value"))
    return io.repaired(lines, "key string, name string, segment string, extra string")


@query("s6_cache_merge", """
SELECT o_orderkey, o_totalprice * 2 AS total FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'""")
def s6(t: Tables) -> DataFrame:
    path = io.scratch(t.spark, "cache")
    t.orders.select("o_orderkey", F.col("o_totalprice").alias("total")).write.parquet(path)
    fresh = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") * 2).alias("total"))
    return io.merged(t.spark.read.parquet(path), fresh, ["o_orderkey"])


@query("s7_mtime_invalidation", """
WITH c AS (SELECT user_id, min(ts) AS cached FROM events WHERE user_id % 3 <> 0 GROUP BY user_id),
f AS (SELECT user_id, max(ts) AS changed FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT f.user_id FROM f LEFT JOIN c USING (user_id) WHERE cached IS NULL OR changed > cached""")
def s7(t: Tables) -> DataFrame:
    cache = t.events.where("user_id % 3 <> 0").groupBy("user_id").agg(F.min("ts").alias("cached"))
    files = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("changed"))
    return io.stale(files, cache, "user_id", "changed", "cached").select("user_id")


@query("s8_result_cache", "SELECT DISTINCT e.event_type, e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.value > 100 AND c.event_type = e.event_type AND c.user_id = e.user_id)")
def s8(t: Tables) -> DataFrame:
    keys = ["event_type", "user_id"]
    return io.missing_keys(t.events.select(*keys).distinct(), t.events.where("value > 100"), keys)


@query("s9_fold_index", "SELECT doc_id % 5 + 1 AS fold, count(*) AS n FROM documents GROUP BY 1")
def s9(t: Tables) -> DataFrame:
    path = io.scratch(t.spark, "folds")
    t.documents.select("doc_id", (F.col("doc_id") % 5 + 1).alias("fold")).write.parquet(path)
    return t.spark.read.schema("doc_id bigint, fold bigint").parquet(path).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("s10_csv_sink", "SELECT r_regionkey, r_name FROM region")
def s10(t: Tables) -> DataFrame:
    path = io.scratch(t.spark, "region-csv")
    io.write_csv(t.region, path)
    return io.read_csv(t.spark, path, "r_regionkey int, r_name string")


@query("s12_routed_sink", "SELECT o_orderstatus AS routing, count(*) AS n FROM orders GROUP BY 1")
def s12(t: Tables) -> DataFrame:
    path = io.scratch(t.spark, "routed")
    t.orders.withColumn("routing", F.col("o_orderstatus")).write.partitionBy("routing").parquet(path)
    return t.spark.read.parquet(path).groupBy(F.col("routing").cast("string").alias("routing")).agg(F.count(F.lit(1)).alias("n"))


@query("s14_sample", "SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 30")
def s14(t: Tables) -> DataFrame:
    return io.sample(t.customer.select("c_custkey"), "c_custkey", 30, 42)


@query("p1_subset", "SELECT doc_id AS filename, lang AS negara FROM documents")
def p1(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("filename"), F.col("lang").alias("negara"))


@query("p2_drop_present", "SELECT doc_id, lang, source FROM documents")
def p2(t: Tables) -> DataFrame:
    return t.documents.drop("text", "n_chars", "not_there")


@query("p3_null_literals", """
WITH s AS (SELECT event_id, CASE event_type WHEN 'error' THEN ' nan ' WHEN 'view' THEN 'None' WHEN 'click' THEN '  ' ELSE ' ' || event_type END AS raw FROM events)
SELECT event_id, CASE WHEN trim(raw) IN ('nan', 'None', '') THEN NULL ELSE trim(raw) END AS clean FROM s""")
def p3(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = F.when(kind == "error", " nan ").when(kind == "view", "None").when(kind == "click", "  ").otherwise(F.concat(F.lit(" "), kind))
    return t.events.select("event_id", null_literals(raw).alias("clean"))


@query("p4_null_flag", "SELECT doc_id, quality IS NOT NULL AS has_label FROM documents LEFT JOIN labels USING (doc_id)")
def p4(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("has_label"))


@query("p5_conditional", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'home' ELSE 'abroad' END AS origin, (lang = 'en')::INT AS target FROM documents")
def p5(t: Tables) -> DataFrame:
    home = F.col("lang") == "en"
    return t.documents.select("doc_id", F.when(home, "home").otherwise("abroad").alias("origin"), home.cast("int").alias("target"))


@query("p6_identity_key", "SELECT c_custkey, coalesce(c_name, 'nan') || '__' || coalesce(c_mktsegment, 'nan') AS identity_key FROM customer")
def p6(t: Tables) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    return t.customer.select("c_custkey", F.concat_ws("__", part("c_name"), part("c_mktsegment")).alias("identity_key"))


@query("p7_dictionary", "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 END::INT AS code FROM events")
def p7(t: Tables) -> DataFrame:
    codes = F.create_map(F.lit("click"), F.lit(0), F.lit("view"), F.lit(1), F.lit("error"), F.lit(2))
    return t.events.select("event_id", F.try_element_at(codes, F.col("event_type")).alias("code"))


@query("p8_point_update", "SELECT s_suppkey, CASE WHEN s_suppkey BETWEEN 5 AND 9 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal FROM supplier")
def p8(t: Tables) -> DataFrame:
    fixes = t.supplier.where("s_suppkey BETWEEN 5 AND 9").select("s_suppkey", F.lit(0.0).alias("fixed"))
    return t.supplier.join(fixes, "s_suppkey", "left").select("s_suppkey", F.coalesce("fixed", "s_acctbal").alias("s_acctbal"))


@query("p9_run_lengths", """
WITH n AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS rn FROM nation),
r AS (SELECT r_name, sum(len) OVER (ORDER BY r_regionkey) - len AS low, sum(len) OVER (ORDER BY r_regionkey) AS high FROM (SELECT *, 3 + r_regionkey AS len FROM region))
SELECT n_nationkey, r_name FROM n JOIN r ON rn > low AND rn <= high""")
def p9(t: Tables) -> DataFrame:
    """Sorted files meet a list of runs of countries: the n-th file belongs to the run that its number falls in. Runs are
    few, files many: files are numbered part by part, and runs broadcast with the numbers they cover."""
    ranked = io.numbered(t.nation.select("n_nationkey"), ["n_nationkey"], "rn")
    runs = io.numbered(t.region.select("r_regionkey", "r_name", (F.col("r_regionkey") + 3).alias("len")), ["r_regionkey"], "nth")
    before = runs.alias("a").join(F.broadcast(runs.select(F.col("nth").alias("other"), F.col("len").alias("length")).alias("b")), F.col("other") < F.col("nth"), "left")
    low = before.groupBy("r_name", "len").agg(F.coalesce(F.sum("length"), F.lit(0)).alias("low"))
    on = (F.col("rn") >= F.col("low")) & (F.col("rn") < F.col("low") + F.col("len"))
    return ranked.join(F.broadcast(low), on).select("n_nationkey", "r_name")


@query("p10_null_fill", "SELECT doc_id, coalesce(quality, 1) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def p10(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").na.fill({"quality": 1, "toxic": 0}).select("doc_id", "quality", "toxic")


@query("p11_optional_column", "SELECT doc_id, lang, 0 AS has_card_word FROM documents")
def p11(t: Tables) -> DataFrame:
    return io.select_available(t.documents, ["doc_id", "lang", "skew_angle", "has_card_word"], {"has_card_word": F.lit(0)})


@query("p12_filter", "SELECT event_id FROM events WHERE value / 500 >= 0.3 AND value / 500 < 0.5")
def p12(t: Tables) -> DataFrame:
    return t.events.where("value / 500 >= 0.3 AND value / 500 < 0.5").select("event_id")


@query("p13_near_filter", "SELECT event_id FROM events WHERE abs(value / 500 - 1.0::DOUBLE / 3) <= 0.01::DOUBLE + 1e-5::DOUBLE * abs(1.0::DOUBLE / 3)")
def p13(t: Tables) -> DataFrame:
    third = F.lit(1.0) / F.lit(3.0)
    return t.events.where(F.abs(F.col("value") / 500 - third) <= F.lit(0.01) + F.lit(1e-5) * F.abs(third)).select("event_id")


@query("p14_method_log", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'missing' WHEN n_chars < 100 THEN 'fallback_original' ELSE 'original' END AS method, 'lines' AS stage FROM documents")
def p14(t: Tables) -> DataFrame:
    method = F.when(F.col("n_chars") == 0, "missing").when(F.col("n_chars") < 100, "fallback_original").otherwise("original")
    return t.documents.select("doc_id", method.alias("method"), F.lit("lines").alias("stage"))


@query("j1_left_join", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query("j2_inner_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j2(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("j3_semi_join", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j3(t: Tables) -> DataFrame:
    train = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(train, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("j4_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j5_unique_lookup", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j5(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment")


@query("j6_first_match", """
SELECT c_custkey, coalesce(first_price, 0) AS first_price FROM customer LEFT JOIN
  (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def j6(t: Tables) -> DataFrame:
    first = t.orders.groupBy("o_custkey").agg(F.min_by("o_totalprice", "o_orderkey").alias("first_price"))
    out = t.customer.join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", F.coalesce("first_price", F.lit(0.0)).alias("first_price"))


@query("j7_skip_absent", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j7(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id")


@query("j8_refresh", """
SELECT c_custkey, c_name, n_name AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j8(t: Tables) -> DataFrame:
    newest = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"))
    return t.customer.drop("c_mktsegment").join(newest, "c_nationkey", "left").select("c_custkey", "c_name", "c_mktsegment")


# Words by which a text's language is told, tried in order.
SPEECH = (("en", ("THE", "AND")), ("de", ("UND", "DER", "ÜBER")), ("fr", ("EST", "LES", "ÉTÉ")), ("es", ("POR", "LOS", "TAMBIÉN")))


@query("j10_alias_scan", f"""
WITH a AS (SELECT * FROM (VALUES (1, 'en', 'THE|AND'), (2, 'de', 'UND|DER|ÜBER'), (3, 'fr', 'EST|LES|ÉTÉ'), (4, 'es', 'POR|LOS|TAMBIÉN')) v(ord, country, alias))
SELECT doc_id, arg_min(country, ord) AS country FROM (SELECT doc_id, {up('text')} AS u FROM documents) JOIN a ON regexp_matches(u, replace('{stands('@')}', '@', alias)) GROUP BY doc_id""")
def j10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", country_of(F.upper("text"), SPEECH).alias("country")).where("country IS NOT NULL")


@query("j11_fold_rows", "SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 3")
def j11(t: Tables) -> DataFrame:
    folds = t.documents.select("doc_id", (F.col("doc_id") % 5).alias("fold"))
    return t.documents.join(folds.where("fold <> 3"), "doc_id").select("doc_id", "lang")


@query("o1_sort_desc", "SELECT event_type, avg(value) AS mean FROM events GROUP BY 1 ORDER BY mean DESC")
def o1(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.avg("value").alias("mean")).orderBy(F.desc("mean"))


@query("o2_sort_numeric_key", "SELECT c_name FROM customer ORDER BY regexp_extract(c_name, '#(\\d+)', 1)::INT")
def o2(t: Tables) -> DataFrame:
    return t.customer.select("c_name").orderBy(F.regexp_extract("c_name", r"#(\d+)", 1).cast("int"))


@query("o3_sort_priority", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS priority FROM orders ORDER BY priority, o_totalprice")
def o3(t: Tables) -> DataFrame:
    priority = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.withColumn("priority", priority).orderBy("priority", "o_totalprice").select("o_orderkey", "priority")


@query("o4_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def o4(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@query("o5_head", "SELECT event_id FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 15")
def o5(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").select("event_id").orderBy("event_id").limit(15)


@query("t1_append", """
SELECT 'customer' AS tier, c_acctbal AS v, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_acctbal, s_suppkey FROM supplier""")
def t1(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("tier"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("id"))
    return a.unionByName(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("v"), F.lit("supplier").alias("tier")))


@query("t2_leak_count", """
SELECT f.fold, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = f.fold INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> f.fold)) AS leaked
FROM (SELECT DISTINCT o_orderkey % 5 AS fold FROM orders) f""")
def t2(t: Tables) -> DataFrame:
    per = t.orders.select("o_custkey", (F.col("o_orderkey") % 5).alias("fold")).distinct()
    spread = per.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per.join(spread, "o_custkey").groupBy("fold").agg(F.sum(flag(F.col("n") > 1)).alias("leaked"))


@query("t3_column_difference", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def t3(t: Tables) -> DataFrame:
    available, group = ["l_orderkey", "l_quantity", "l_discount", "l_tax"], {"l_tax", "absent"}
    return t.lineitem.select(*[c for c in available if c not in group])
