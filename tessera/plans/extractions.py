"""Templates, assembled fields and routing over stand-in segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import strip
from tessera.operators import extraction
from tessera.plans.registry import query
from tessera.plans.strings import LINES, NUMBERED, STRIP, lines, numbered
from tessera.sources.tables import Tables

CARD = r"""s AS (SELECT o_orderkey AS doc, i AS seg_idx, CASE o_orderkey % 6
  WHEN 0 THEN CASE WHEN i = 1 THEN 'P<UTO' || upper(o_orderpriority[3:6]) || '<<ANNA<MARIA<<<<<<<<<<<<<<<<' ELSE 'x' END
  WHEN 1 THEN (i + 1) || '. Value' WHEN 2 THEN CASE WHEN i = 0 THEN 'Height 1.68 PRT' ELSE 'y' END
  WHEN 3 THEN CASE WHEN i = 2 THEN 'Kad Pengenalan' ELSE 'z' END WHEN 4 THEN CASE WHEN i = 1 THEN 'Bundesrepublik Deutschland' ELSE 'Rheinland' END
  ELSE 'Henkilokortti' END AS text FROM orders, (SELECT unnest(range(4)) AS i))"""


def card(t: Tables) -> DataFrame:
    """(doc, seg_idx, text): four lines of one of six kinds of cards for each order."""
    i, k = F.col("seg_idx"), F.col("o_orderkey") % 6
    machine = F.concat(F.lit("P<UTO"), F.upper(F.substring("o_orderpriority", 3, 4)), F.lit("<<ANNA<MARIA<<<<<<<<<<<<<<<<"))
    text = (
        F.when(k == 0, F.when(i == 1, machine).otherwise("x"))
        .when(k == 1, F.concat((i + 1).cast("string"), F.lit(". Value")))
        .when(k == 2, F.when(i == 0, "Height 1.68 PRT").otherwise("y"))
        .when(k == 3, F.when(i == 2, "Kad Pengenalan").otherwise("z"))
        .when(k == 4, F.when(i == 1, "Bundesrepublik Deutschland").otherwise("Rheinland"))
        .otherwise("Henkilokortti")
    )
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seg_idx"))
    return rows.select(F.col("o_orderkey").alias("doc"), "seg_idx", text.alias("text"))


@query("x8_template", f"""WITH {CARD}, g AS (SELECT doc, bool_or(regexp_full_match(upper(replace(text, ' ', '')), '[A-Z0-9<]{{28,44}}') AND length(text) - length(replace(text, '<', '')) >= 5) AS machine,
  count(*) FILTER (WHERE regexp_matches(trim(text), '^\\d[a-c]?\\.\\s*\\S')) AS numbered, upper(string_agg(text, ' ' ORDER BY seg_idx)) AS u FROM s GROUP BY 1)
SELECT doc, CASE WHEN machine THEN 'mrz' WHEN numbered >= 3 THEN 'eu_license' WHEN regexp_matches(u, '\\b\\d\\.\\d{{2}}\\s+[A-Z]{{3}}\\b') THEN 'eu_id_positional'
  WHEN contains(u, 'MYKAD') OR contains(u, 'KAD PENGENALAN') OR contains(u, 'WARGANEGARA') THEN 'mykad'
  WHEN regexp_matches(u, '\\b(GERMANY|DEUTSCHLAND)\\b') THEN 'fallback_GERMANY' ELSE 'unknown' END AS template FROM g""")
def x8(t: Tables) -> DataFrame:
    return extraction.templates(card(t))


ITEMS = """i AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seg_idx,
  CASE WHEN l_partkey % 5 = 0 THEN '12.03.' || (1960 + l_partkey % 50) ELSE 'Kg Word' || chr(65 + (l_partkey % 26)::INT) END AS text,
  0.6 + l_discount * 4 AS ocr_conf, l_quantity / 50 AS y, l_tax * 10 AS x, CASE l_partkey % 5 WHEN 0 THEN 'birth_date' WHEN 1 THEN 'name' WHEN 2 THEN 'address' ELSE 'other' END AS label FROM lineitem)"""


def items(t: Tables) -> DataFrame:
    """(doc, seg_idx, text, ocr_conf, y, x, label): the items of an order as segments."""
    p = F.col("l_partkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    word = F.concat(F.lit("Kg Word"), F.char((p % 26 + 65).cast("int")))
    text = F.when(p % 5 == 0, F.concat(F.lit("12.03."), (p % 50 + 1960).cast("string"))).otherwise(word)
    label = F.when(p % 5 == 0, "birth_date").when(p % 5 == 1, "name").when(p % 5 == 2, "address").otherwise("other")
    return t.lineitem.select(
        F.col("l_orderkey").alias("doc"), (F.row_number().over(order) - 1).alias("seg_idx"), text.alias("text"),
        (F.lit(0.6) + F.col("l_discount") * 4).alias("ocr_conf"), (F.col("l_quantity") / 50).alias("y"), (F.col("l_tax") * 10).alias("x"), label.alias("label"),
    )


SURE = f"""{ITEMS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, label, round_even(y, 2), round_even(x, 2) ORDER BY seg_idx) AS nth FROM i WHERE ocr_conf >= 0.7::DOUBLE) WHERE nth = 1)"""
READ = """o AS (SELECT *, row_number() OVER (PARTITION BY doc, label ORDER BY y, seg_idx) AS k FROM u WHERE label IN ('name', 'address')),
g AS (SELECT doc, label, k, y AS anchor, 1 AS line, x, seg_idx, text, ocr_conf FROM o WHERE k = 1
  UNION ALL SELECT o.doc, o.label, o.k, CASE WHEN o.y - g.anchor > 0.02::DOUBLE THEN o.y ELSE g.anchor END, g.line + (o.y - g.anchor > 0.02::DOUBLE)::INT, o.x, o.seg_idx, o.text, o.ocr_conf
  FROM g JOIN o ON o.doc = g.doc AND o.label = g.label AND o.k = g.k + 1),
f AS (SELECT doc, label, upper(string_agg(text, ' ' ORDER BY line, x, seg_idx)) AS joined, avg(ocr_conf) AS conf FROM g GROUP BY 1, 2)"""


@query("x9_assemble_name", f"WITH RECURSIVE {SURE}, {READ} SELECT doc, joined AS value, round(conf, 9) AS conf FROM f WHERE label = 'name'")
def x9(t: Tables) -> DataFrame:
    return extraction.assembled_text(items(t), "name").withColumn("conf", F.round("conf", 9))


@query("x9_assemble_address", f"WITH RECURSIVE {SURE}, {READ} SELECT doc, regexp_replace(joined, '\\bKG\\b', 'KAMPUNG', 'g') AS value, round(conf, 9) AS conf FROM f WHERE label = 'address'")
def x9_address(t: Tables) -> DataFrame:
    return extraction.assembled_text(items(t), "address").withColumn("conf", F.round("conf", 9))


TOP = "SELECT doc, arg_min(text, struct_pack(y := y, s := seg_idx)) AS text, arg_min(ocr_conf, struct_pack(y := y, s := seg_idx)) AS conf FROM u WHERE label = 'birth_date' GROUP BY 1"


@query("x9_assemble_date", f"WITH {SURE} SELECT doc, text[7:10] || '-03-12' AS value, conf FROM ({TOP})")
def x9_date(t: Tables) -> DataFrame:
    return extraction.assembled_date(items(t))


@query("w6_first_valid", f"""WITH {ITEMS}, d AS (SELECT *, regexp_matches(text, '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') AS dated FROM i)
SELECT doc, arg_min(text[7:10] || '-' || text[4:5] || '-' || text[1:2], seg_idx) AS value, arg_min(ocr_conf, seg_idx) AS conf FROM d WHERE dated GROUP BY 1""")
def w6(t: Tables) -> DataFrame:
    """The first segment, whatever its label, that reads as a whole date."""
    return extraction.scanned_date(items(t))


@query("x10_machine_lines", """SELECT o_orderkey, 'ANNA MARIA ' || trim(upper(o_orderpriority[3:6])) AS name,
  CASE WHEN strftime(o_orderdate, '%y')::INT > 25 THEN '19' ELSE '20' END || strftime(o_orderdate, '%y-%m-%d') AS dob FROM orders""")
def x10(t: Tables) -> DataFrame:
    first = F.concat(F.lit("P<UTO"), F.upper(F.substring("o_orderpriority", 3, 4)), F.lit("<<ANNA<MARIA<<<<<<<<<<<"))
    second = F.concat(F.lit("L898902C36UTO"), F.date_format("o_orderdate", "yyMMdd"), F.lit("1F1204159ZE184226B<<<<<10"))
    three = F.array(F.lit("I<UTOD231458907<<<<<<<<<<<<<<<"), F.concat(F.date_format("o_orderdate", "yyMMdd"), F.lit("1F1204159UTO<<<<<<<<<<<6")), F.substring(first, 6, 60))
    rows = F.when(F.col("o_orderkey") % 2 == 0, F.array(first, second)).otherwise(three)
    name, dob = extraction.machine_fields(rows)
    return t.orders.select("o_orderkey", name.alias("name"), dob.alias("dob"))


@query("x11_numbered_fields", f"""WITH {LINES}, x AS (SELECT doc_id, seg_idx, trim({STRIP.format(NUMBERED)}) AS x FROM l)
SELECT doc_id, seg_idx, regexp_extract(x, '^(\\d[a-c]?)\\.?\\s+', 1) AS field FROM x""")
def x11(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", extraction.numbered_field(strip(numbered()))["field"].alias("field"))


@query("x11_license", "SELECT o_orderkey AS doc, 'Anne ' || o_orderpriority AS pred_name, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS pred_dob FROM orders")
def x11_license(t: Tables) -> DataFrame:
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    dob = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("3"), day)).otherwise("3 unknown")
    parts = F.array(F.concat(F.lit("1. "), F.col("o_orderpriority")), F.lit("2 Anne"), dob)
    return extraction.license_fields(t.orders.select(F.col("o_orderkey").alias("doc"), F.posexplode(parts).alias("seg_idx", "text")))


EXTRACTED = f"""{SURE}, {READ}, h AS (SELECT DISTINCT doc, doc % 2 = 0 AS is_home FROM i), b AS ({TOP}),
c AS (SELECT doc, arg_min(text, seg_idx) AS text, arg_min(ocr_conf, seg_idx) AS conf FROM i WHERE label = 'birth_date' GROUP BY 1),
e AS (SELECT h.doc, is_home, coalesce(n.joined, '') AS pred_name, coalesce(b.text[7:10] || '-03-12', c.text[7:10] || '-03-12', '') AS pred_dob,
  CASE WHEN is_home THEN coalesce(regexp_replace(a.joined, '\\bKG\\b', 'KAMPUNG', 'g'), '') ELSE '' END AS pred_addr, coalesce(n.conf, 0) AS conf_name,
  coalesce(b.conf, c.conf, 0) AS conf_dob, CASE WHEN is_home THEN coalesce(a.conf, 0) ELSE 0 END AS conf_addr
  FROM h LEFT JOIN b USING (doc) LEFT JOIN c USING (doc) LEFT JOIN (SELECT * FROM f WHERE label = 'name') n USING (doc) LEFT JOIN (SELECT * FROM f WHERE label = 'address') a USING (doc))"""


@query("x12_home_and_abroad", f"WITH RECURSIVE {EXTRACTED} SELECT is_home, count(*) AS n, count(*) FILTER (WHERE pred_addr <> '') AS with_address FROM e GROUP BY 1")
def x12(t: Tables) -> DataFrame:
    out = fields(t)
    return out.groupBy("is_home").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred_addr") != "").alias("with_address"))


def fields(t: Tables) -> DataFrame:
    segs = items(t)
    return extraction.extracted(segs, segs.select("doc", (F.col("doc") % 2 == 0).alias("is_home")).distinct())


@query("x13_extract_fields", f"WITH RECURSIVE {EXTRACTED} SELECT doc, is_home, pred_name, pred_dob, pred_addr, round(conf_name, 9) AS conf_name, round(conf_dob, 9) AS conf_dob, round(conf_addr, 9) AS conf_addr FROM e")
def x13(t: Tables) -> DataFrame:
    out = fields(t)
    return out.withColumns({c: F.round(c, 9) for c in ("conf_name", "conf_dob", "conf_addr")})


ROUTE = """CASE WHEN blur < 30 OR bright < 30 OR dark > 0.8::DOUBLE THEN 'REJECT' WHEN length(pred_name) < 2 OR length(pred_name) > 100 OR regexp_matches(pred_name, '[0-9]') OR pred_dob = '' THEN 'HUMAN_REVIEW'
  WHEN readable = 0 THEN 'REJECT' WHEN CASE WHEN is_home THEN least(conf_name, conf_dob, conf_addr) ELSE least(conf_name, conf_dob) END >= 0.75::DOUBLE THEN 'AUTO_APPROVE' ELSE 'HUMAN_REVIEW' END"""


@query("x14_route_decision", f"WITH RECURSIVE {EXTRACTED}, q AS (SELECT *, (doc % 97) + 20 AS blur, (doc % 89) + 25 AS bright, (doc % 100) / 110::DOUBLE AS dark, (doc % 11 > 0)::INT AS readable FROM e) SELECT doc, {ROUTE} AS routing FROM q")
def x14(t: Tables) -> DataFrame:
    return routed(t).select("doc", "routing")


def routed(t: Tables) -> DataFrame:
    d = F.col("doc")
    confs = (F.col("conf_name"), F.col("conf_dob"), F.col("conf_addr"))
    routing = extraction.route(d % 97 + 20, d % 89 + 25, (d % 100) / 110, F.col("pred_name"), F.col("pred_dob"), (d % 11 > 0).cast("int"), F.col("is_home"), confs)
    return fields(t).withColumn("routing", routing)


@query("a22_straight_through_rate", f"WITH RECURSIVE {EXTRACTED}, q AS (SELECT *, (doc % 97) + 20 AS blur, (doc % 89) + 25 AS bright, (doc % 100) / 110::DOUBLE AS dark, (doc % 11 > 0)::INT AS readable FROM e) SELECT avg(({ROUTE} = 'AUTO_APPROVE')::INT) AS stp FROM q")
def a22(t: Tables) -> DataFrame:
    return routed(t).agg(F.avg((F.col("routing") == "AUTO_APPROVE").cast("int")).alias("stp"))


@query("x7_triage_label", "SELECT event_id, CASE WHEN value < 30 THEN 0 ELSE (user_id % 2)::INT END AS label FROM events")
def x7(t: Tables) -> DataFrame:
    return t.events.select("event_id", extraction.triage(F.col("value"), (F.col("user_id") % 2).cast("int")).alias("label"))


@query("a23_country_accuracy", f"""WITH {CARD}, g AS (SELECT doc, upper(string_agg(text, ' ' ORDER BY seg_idx)) AS u FROM s WHERE doc % 6 >= 4 GROUP BY 1)
SELECT avg((doc % 12 = 4)::INT) AS accuracy FROM g WHERE regexp_matches(u, '\\b(GERMANY|DEUTSCHLAND)\\b')""")
def a23(t: Tables) -> DataFrame:
    found = extraction.templates(card(t)).where(F.col("template").startswith("fallback_"))
    truth = F.when(F.col("doc") % 12 == 4, "fallback_GERMANY").otherwise("fallback_SPAIN")
    return found.agg(F.avg((F.col("template") == truth).cast("int")).alias("accuracy"))
