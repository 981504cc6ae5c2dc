"""Numbers, boxes, bins, ranks and segment features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import geometry
from tessera.functions.text import rule_field
from tessera.operators import segments
from tessera.operators.learning import minmax_scaled, standardized
from tessera.plans.registry import query
from tessera.plans.strings import JOINED, LINES, RULED, SQL_ADDRESS, SQL_CARD, SQL_PATRONYMICS, SQL_STATES, STRIP, _any, lines, origin_features, sql_words, stands, up
from tessera.sources.tables import Tables

ORDER = ["l_quantity", "l_partkey", "l_suppkey", "l_extendedprice"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def boxes(t: Tables) -> DataFrame:
    """One four-cornered box for each line item."""
    x, y, w, h = F.col("l_extendedprice") / 100, F.col("l_quantity") * 10, F.col("l_discount") * 1000 + 20, F.col("l_tax") * 500 + 5
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return t.lineitem.select(*KEYS, F.array(point(x + w, y), point(x, y), point(x, y + h), point(x + w, y + h)).alias("box"))


BOX = "b AS (SELECT *, l_extendedprice / 100 AS x, l_quantity * 10 AS y, l_discount * 1000 + 20 AS w, l_tax * 500 + 5 AS h FROM lineitem)"
SHOWN = ", ".join(KEYS)


@query("m1_log1p", "SELECT event_id, round(ln(1 + value), 9) AS logged FROM events")
def m1(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(F.log1p("value"), 9).alias("logged"))


M2_SQL = "CASE WHEN value / 500 > 0 AND value / 500 <= 0.1::DOUBLE THEN 0.0::DOUBLE " + " ".join(
    f"WHEN value / 500 > {a!r}::DOUBLE AND value / 500 <= {b!r}::DOUBLE THEN {round(a, 1)}::DOUBLE" for a, b in zip(geometry.EDGES[1:], geometry.EDGES[2:], strict=False)
) + " END"


@query("m2_confidence_bins", f"SELECT event_id, {M2_SQL} AS bin FROM events")
def m2(t: Tables) -> DataFrame:
    return t.events.select("event_id", geometry.confidence_bin(F.col("value") / 500).alias("bin"))


@query("m3_labelled_bins", "SELECT event_id, CASE WHEN value > 0 AND value <= 50 THEN 'Buram' WHEN value > 50 AND value <= 300 THEN 'Sedang' WHEN value > 300 THEN 'Tajam' END AS quality FROM events")
def m3(t: Tables) -> DataFrame:
    return t.events.select("event_id", geometry.sharpness_class(F.col("value")).alias("quality"))


@query("m4_clipped_ratio", "SELECT o_orderkey, o_totalprice / greatest(o_orderkey % 7, 1) AS ratio FROM orders")
def m4(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.col("o_totalprice") / F.greatest(F.col("o_orderkey") % 7, F.lit(1))).alias("ratio"))


@query("m5_box_relative", f"WITH {BOX} SELECT {SHOWN}, (y + y + (y + h) + (y + h)) / 4 / 600 AS y_rel, ((x + w) + x + x + (x + w)) / 4 / 1000 AS x_rel, ((x + w) - x) / 1000 AS width_rel FROM b")
def m5(t: Tables) -> DataFrame:
    place = geometry.relative(F.col("box"), F.lit(1000), F.lit(600))
    return boxes(t).select(*KEYS, *[v.alias(k) for k, v in place.items()])


@query("m6_rescale", f"WITH {BOX} SELECT {SHOWN}, (x + w) / 2.5::DOUBLE AS x0, (y + h) / 2.5::DOUBLE AS y2 FROM b")
def m6(t: Tables) -> DataFrame:
    scaled = geometry.rescale(F.col("box"), F.lit(2.5))
    return boxes(t).select(*KEYS, F.get(scaled, 0)["x"].alias("x0"), F.get(scaled, 2)["y"].alias("y2"))


@query("m7_order_points", f"WITH {BOX} SELECT {SHOWN}, x AS tl_x, y AS tl_y, x + w AS tr_x, y + h AS br_y, x AS bl_x FROM b")
def m7(t: Tables) -> DataFrame:
    corners = geometry.order_points(F.col("box"))
    tl, tr, br, bl = (F.get(corners, i) for i in range(4))
    return boxes(t).select(*KEYS, tl["x"].alias("tl_x"), tl["y"].alias("tl_y"), tr["x"].alias("tr_x"), br["y"].alias("br_y"), bl["x"].alias("bl_x"))


@query("m8_target_size", f"WITH {BOX} SELECT {SHOWN}, trunc(sqrt(pow((x + w) - x, 2) + pow((y + h) - (y + h), 2)))::INT AS width, trunc(sqrt(pow((x + w) - (x + w), 2) + pow(y - (y + h), 2)))::INT AS height FROM b")
def m8(t: Tables) -> DataFrame:
    width, height = geometry.target_size(geometry.order_points(F.col("box")))
    return boxes(t).select(*KEYS, width.alias("width"), height.alias("height"))


@query("m9_warp_sanity", "SELECT p_partkey, (p_size * p_retailprice >= 0.1::DOUBLE * 100000 AND greatest(p_size, p_retailprice) / greatest(least(p_size, p_retailprice), 1) <= 3.5::DOUBLE) AS sane FROM part")
def m9(t: Tables) -> DataFrame:
    sane = geometry.warp_is_sane(F.col("p_size"), F.col("p_retailprice"), F.lit(100000))
    return t.part.select("p_partkey", sane.alias("sane"))


@query("i5_aspect_ratio", "SELECT p_partkey, p_retailprice / greatest(p_size, 1) AS aspect_ratio FROM part")
def i5(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_retailprice") / F.greatest("p_size", F.lit(1))).alias("aspect_ratio"))


RANKED = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)})"


@query("w1_line_rank", f"SELECT {SHOWN}, ({RANKED} - 1)::INT AS line_rank FROM lineitem")
def w1(t: Tables) -> DataFrame:
    return segments.rank_within(t.lineitem.select(*KEYS), "l_orderkey", [F.col(c) for c in ORDER])


@query("w2_rank_norm", f"""WITH r AS (SELECT {SHOWN}, {RANKED} - 1 AS r FROM lineitem)
SELECT {SHOWN}, (r - min(r) OVER (PARTITION BY l_orderkey)) / greatest(max(r) OVER (PARTITION BY l_orderkey) - min(r) OVER (PARTITION BY l_orderkey), 1)::DOUBLE AS line_rank_norm FROM r""")
def w2(t: Tables) -> DataFrame:
    ranked = segments.rank_within(t.lineitem.select(*KEYS), "l_orderkey", [F.col(c) for c in ORDER])
    return ranked.withColumn("line_rank_norm", segments.scaled_within(F.col("line_rank"), "l_orderkey")).drop("line_rank")


@query("w3_line_groups", """WITH RECURSIVE q AS (SELECT l_orderkey, l_quantity / 50 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k FROM lineitem),
g AS (SELECT l_orderkey, k, y AS anchor, 1 AS line FROM q WHERE k = 1
  UNION ALL SELECT q.l_orderkey, q.k, CASE WHEN q.y - g.anchor > 0.02::DOUBLE THEN q.y ELSE g.anchor END, g.line + (q.y - g.anchor > 0.02::DOUBLE)::INT FROM g JOIN q ON q.l_orderkey = g.l_orderkey AND q.k = g.k + 1)
SELECT l_orderkey, count(*) AS n, max(line)::INT AS n_lines, sum(line)::BIGINT AS line_sum FROM g GROUP BY l_orderkey""")
def w3(t: Tables) -> DataFrame:
    docs = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity") / 50)).alias("ys"))
    line = segments.line_numbers(F.col("ys"))
    out = docs.select("l_orderkey", line.alias("line"))
    return out.select("l_orderkey", F.size("line").cast("bigint").alias("n"), F.array_max("line").alias("n_lines"), F.aggregate("line", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("line_sum"))


@query("w4_dedupe", f"""SELECT {SHOWN} FROM (SELECT {SHOWN}, row_number() OVER (PARTITION BY l_orderkey, round_even(l_discount, 2), round_even(l_tax, 2) ORDER BY {', '.join(ORDER)}) AS k FROM lineitem) WHERE k = 1""")
def w4(t: Tables) -> DataFrame:
    kept = segments.keep_first(t.lineitem, [F.col("l_orderkey"), F.bround("l_discount", 2), F.bround("l_tax", 2)], [F.col(c) for c in ORDER])
    return kept.select(*KEYS)


@query("w5_top_one", f"SELECT l_orderkey, min(struct_pack(q := l_quantity, p := l_partkey, s := l_suppkey, e := l_extendedprice)).p AS l_partkey FROM lineitem GROUP BY 1")
def w5(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct(*ORDER)).alias("l_partkey"))


@query("w7_positions", """SELECT event_type, event_id FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events
  WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id)) WHERE rn IN (1, n // 2 + 1, n)""")
def w7(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type")
    out = t.events.withColumn("rn", F.row_number().over(w.orderBy("value", "event_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return out.where("rn = 1 OR rn = n OR rn = floor(n / 2) + 1").select("event_type", "event_id")


@query("w8_per_category", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 3")
def w8(t: Tables) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))
    return t.events.withColumn("rn", rn).where("rn <= 3").select("event_type", "event_id")


@query("l2_minmax", """WITH b AS (SELECT min(coalesce(l_quantity, 0)) AS lo, max(coalesce(l_quantity, 0)) AS hi FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN hi > lo THEN (coalesce(l_quantity, 0) - lo) / (hi - lo) ELSE 0.0::DOUBLE END AS scaled FROM lineitem, b""")
def l2(t: Tables) -> DataFrame:
    return minmax_scaled(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"), {"l_quantity": "scaled"}).drop("l_quantity")


X3_SQL = f"""WITH {LINES}, j AS (SELECT doc_id, {JOINED} AS u FROM l GROUP BY doc_id),
z AS (SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS quality_pc1 FROM documents),
f AS (SELECT l.*, u, quality_pc1, doc_id % 4 = 0 AS bare, {up(STRIP.format('text'))} AS t FROM l JOIN j USING (doc_id) JOIN z USING (doc_id))
SELECT doc_id, seg_idx, text, 0.5::DOUBLE + seg_idx % 50 / 100 AS ocr_conf, round(CASE WHEN bare THEN 0 ELSE (seg_idx * 20 + 5) / 600 END, 9)::DOUBLE AS y_rel,
  round(CASE WHEN bare THEN 0 ELSE (seg_idx % 7 + 50) / 1000 END, 9)::DOUBLE AS x_rel, CASE WHEN bare THEN 0 ELSE 0.1 END::DOUBLE AS width_rel, bare::INT AS is_spatial_dummy,
  length(text)::INT AS text_len, len({sql_words('text')})::INT AS word_count, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS alpha_ratio,
  length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS digit_ratio, (text = {up('text')} AND text <> lower(text))::INT AS is_all_caps,
  regexp_matches(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|{stands('\\d{4}')}')::INT AS has_date_pattern, {_any(up('text'), SQL_ADDRESS)} AS has_address_kw, {_any(up('text'), SQL_STATES)} AS has_state_kw,
  regexp_matches(text, '{stands('\\d{5}')}')::INT AS has_postcode, {_any(up('text'), SQL_PATRONYMICS)} AS has_bin_binti, seg_idx AS line_rank, {RULED.replace(' u ', ' t ').replace('(u', '(t')} AS label,
  CASE WHEN bare THEN '' ELSE (seg_idx % 7) || ',' || seg_idx * 20 || ' ' || (seg_idx % 7 + 100) || ',' || seg_idx * 20 || ' ' || (seg_idx % 7 + 100) || ',' || (seg_idx * 20 + 10) || ' ' || (seg_idx % 7) || ',' || (seg_idx * 20 + 10) END AS box,
  {_any('u', SQL_CARD)} AS has_mykad_keyword, regexp_matches(u, '{stands('\\d{12}|\\d{6}-\\d{2}-\\d{4}')}')::INT AS has_ic_number_pattern, quality_pc1 FROM f"""


@query("x3_feature_rows", X3_SQL)
def x3(t: Tables) -> DataFrame:
    """All columns of a segment's features. Lines are segments at made-up places; every fourth document has none."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("seg_idx") % 7, F.col("seg_idx") * 20
    box = F.when(F.col("doc_id") % 4 != 0, F.array(point(x, y), point(x + 100, y), point(x + 100, y + 10), point(x, y + 10)))
    segs = lines(t).withColumn("ocr_conf", F.lit(0.5) + F.col("seg_idx") % 50 / 100).withColumn("box", box).withColumn("label", rule_field(F.col("text")))
    size = t.documents.select("doc_id", F.lit(1000).alias("width"), F.lit(600).alias("height"))
    origin = origin_features(t).select("doc_id", "has_mykad_keyword", "has_ic_number_pattern")
    quality = standardized(t.documents.select("doc_id", "n_chars"), {"n_chars": "z"}).select("doc_id", F.round("z", 6).alias("quality_pc1"))
    out = segments.feature_rows(segs, size, "doc_id").join(origin, "doc_id").join(quality, "doc_id")
    corner = lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))
    written = F.coalesce(F.array_join(F.transform("box", corner), " "), F.lit(""))
    return out.withColumn("box", written).withColumns({c: F.round(c, 9) for c in ("y_rel", "x_rel", "width_rel")})


@query("x3_result_rows", "SELECT conv_id, turn AS seg_idx, role AS text FROM conversations WHERE turn < 3")
def x3_results(t: Tables) -> DataFrame:
    """Nested results whose scores are cut short, so that only the first three of each come out."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c])
    docs = t.conversations.groupBy("conv_id").agg(in_order("role").alias("texts"))
    docs = docs.withColumn("scores", F.slice(F.transform("texts", lambda x, i: i * 0.1), 1, 3)).withColumn("boxes", F.transform("texts", lambda x: F.array(F.lit(0.0))))
    return segments.explode_results(docs, "conv_id").select("conv_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text")


@query("i11_payloads", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_idx, role AS text, 0.5::DOUBLE + turn / 100 AS ocr_conf, turn * 10.0::DOUBLE AS top
FROM conversations WHERE conv_id % 5 < 4""")
def i11(t: Tables) -> DataFrame:
    """Answers of an engine in both shapes, with a line of neither among them; every fifth is empty."""
    box = F.concat(F.lit("[[0,"), (F.col("turn") * 10).cast("string"), F.lit("],[9,9]]"))
    score = (F.lit(0.5) + F.col("turn") / 100).cast("string")
    line = F.concat(F.lit("["), box, F.lit(',["'), F.col("role"), F.lit('",'), score, F.lit("]]"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("c")))), lambda x: x["c"]), ",")
    docs = t.conversations.groupBy("conv_id").agg(
        F.concat(F.lit('{"rec_texts":['), in_order(F.concat(F.lit('"'), F.col("role"), F.lit('"'))), F.lit('],"rec_scores":['), in_order(score), F.lit('],"dt_polys":['), in_order(box), F.lit("]}")).alias("named"),
        F.concat(F.lit('[["odd"],'), in_order(line), F.lit("]")).alias("listed"),
    )
    k = F.col("conv_id")
    payload = F.when(k % 5 == 4, F.when(k % 2 == 0, "").otherwise("[]")).when(k % 2 == 0, F.col("named")).otherwise(F.col("listed"))
    out = segments.explode_results(segments.parsed_payload(docs.select("conv_id", payload.alias("payload"))), "conv_id")
    return out.select("conv_id", F.col("seg_idx").cast("bigint").alias("seg_idx"), "text", "ocr_conf", F.get(F.get("box", 0), 1).alias("top"))
