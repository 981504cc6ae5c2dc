"""Evaluation of predicted against true labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import evaluation
from tessera.operators.learning import balanced_weight
from tessera.plans.registry import query
from tessera.plans.strings import stands
from tessera.sources.tables import Tables

GUESS = "g AS (SELECT quality AS y, (n_chars >= 1500)::INT AS yhat FROM documents JOIN labels USING (doc_id))"
CLASSES = f"""g AS (SELECT CASE WHEN lang = 'en' THEN 0 WHEN lang = 'de' THEN 1 WHEN lang = 'fr' THEN 2 ELSE 3 END AS y,
  CASE WHEN regexp_matches(text, '{stands('the')}') THEN 0 WHEN regexp_matches(text, '{stands('und')}') THEN 1 WHEN regexp_matches(text, '{stands('qui')}') THEN 2
    WHEN regexp_matches(text, '{stands('por')}') THEN 3 ELSE 4 END AS yhat FROM documents)"""


def guess(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(F.col("quality").alias("y"), (F.col("n_chars") >= 1500).cast("int").alias("yhat"))


def classes(t: Tables) -> DataFrame:
    lang, says = F.col("lang"), lambda w: F.col("text").rlike(rf"(?iU)\b{w}\b")
    y = F.when(lang == "en", 0).when(lang == "de", 1).when(lang == "fr", 2).otherwise(3)
    yhat = F.when(says("the"), 0).when(says("und"), 1).when(says("qui"), 2).when(says("por"), 3).otherwise(4)
    return t.documents.select(y.alias("y"), yhat.alias("yhat"))


REPORT = """s AS (SELECT c AS class, sum(hit) AS hit, sum(t) AS support, sum(s) AS said FROM (SELECT y AS c, (y = yhat)::INT AS hit, 1 AS t, 0 AS s FROM g UNION ALL SELECT yhat, 0, 0, 1 FROM g) GROUP BY 1),
p AS (SELECT class, support::BIGINT AS support, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM s),
r AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p)"""


@query("a20_confusion", f"WITH {CLASSES} SELECT y, yhat, count(*) AS n FROM g GROUP BY 1, 2")
def a20(t: Tables) -> DataFrame:
    return evaluation.confusion(classes(t))


@query("a20_class_report", f"WITH {CLASSES}, {REPORT} SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r")
def a20_report(t: Tables) -> DataFrame:
    return evaluation.class_report(classes(t)).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("l11_macro_f1", f"WITH {CLASSES}, {REPORT} SELECT round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM r")
def l11(t: Tables) -> DataFrame:
    return evaluation.macro_f1(classes(t)).select(F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1"))


@query("a21_frr_far", f"WITH {GUESS} SELECT count(*) FILTER (WHERE y = 1 AND yhat = 0) / greatest(count(*) FILTER (WHERE y = 1), 1) AS frr, count(*) FILTER (WHERE y = 0 AND yhat = 1) / greatest(count(*) FILTER (WHERE y = 0), 1) AS far FROM g")
def a21(t: Tables) -> DataFrame:
    return evaluation.rejection_rates(guess(t))


@query("a25_acceptance", "SELECT lang, CASE WHEN avg(n_chars) / 10000 < 0.15 AND avg((n_chars > 500)::INT) > 0.70 AND min(n_chars) / 100 < 0.25 THEN 'LULUS' ELSE 'GAGAL' END AS verdict FROM documents GROUP BY 1")
def a25(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    out = t.documents.groupBy("lang").agg((F.avg(n) / 10000).alias("a"), F.avg((n > 500).cast("int")).alias("b"), (F.min(n) / 100).alias("c"))
    return out.select("lang", evaluation.acceptance(F.col("a"), F.col("b"), F.col("c")).alias("verdict"))


@query("a27_summary", """SELECT 'events' AS aspect, count(DISTINCT event_type) || ' kinds' AS compared, 'best ' || arg_min(event_type, m) AS result FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY 1)
UNION ALL SELECT 'documents', count(DISTINCT source) || ' sources', 'most ' || arg_max(source, struct_pack(n := n, s := source)) FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""")
def a27(t: Tables) -> DataFrame:
    kinds = t.events.groupBy("event_type").agg(F.avg("value").alias("m"))
    sources = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    row = lambda df, name, unit, what, best: df.agg(F.lit(name).alias("aspect"), F.format_string(f"%d {unit}", F.count(F.lit(1))).alias("compared"), F.concat(F.lit(what), best).alias("result"))
    a = row(kinds, "events", "kinds", "best ", F.min_by("event_type", "m"))
    return a.unionByName(row(sources, "documents", "sources", "most ", F.max_by("source", F.struct("n", "source"))))


@query("l9_class_weight", "SELECT doc_id, (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * (count(*) OVER (PARTITION BY toxic)))::DOUBLE AS weight FROM labels")
def l9(t: Tables) -> DataFrame:
    return balanced_weight(t.labels, "toxic").select("doc_id", "weight")
