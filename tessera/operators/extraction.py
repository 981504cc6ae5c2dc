"""Templates, field assembly and routing of documents, from their segments.

Segments have (doc, seg_idx, text, ocr_conf, y, x, label); all steps are grouped aggregates and expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions.text import CARD_WORDS, any_of, bound, clean_name, normalize_address, normalize_name, validate_date, validate_name
from tessera.operators.segments import keep_first, line_numbers

CONF_FLOOR, AUTO_APPROVE, LINE_GAP = 0.70, 0.75, 0.02
# Names of countries by which a card is told; no alias has under five letters.
COUNTRIES = (
    ("CROATIA", ("CROATIA", "HRVATSKA")),
    ("CZECH REPUBLIC", ("CZECH REPUBLIC", "CZECHIA", "CESKA REPUBLIKA")),
    ("FINLAND", ("FINLAND", "SUOMI")),
    ("GERMANY", ("GERMANY", "DEUTSCHLAND")),
    ("GREECE", ("GREECE", "HELLAS", "HELLENIC")),
    ("SPAIN", ("SPAIN", "ESPANA", "REINO DE ESPANA")),
)
MACHINE_LINE = r"^[A-Z0-9<]{28,44}$"


def is_machine_line(text: Column) -> Column:
    bare = F.upper(F.replace(text, F.lit(" "), F.lit("")))
    return bare.rlike(MACHINE_LINE) & (F.length(bare) - F.length(F.replace(bare, F.lit("<"), F.lit(""))) >= 5)


def country_of(joined: Column, countries: tuple[tuple[str, tuple[str, ...]], ...] = COUNTRIES) -> Column:
    """The first country, in order, one of whose names stands in the text as whole words."""
    return F.coalesce(*[F.when(joined.rlike(rf"(?U)\b({'|'.join(aliases)})\b"), F.lit(name)) for name, aliases in countries])


def templates(segments: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, template) by signals from the most to the least specific."""
    in_order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), " ")
    signals = segments.where("text IS NOT NULL").groupBy(doc).agg(
        F.bool_or(is_machine_line(F.col("text"))).alias("machine"),
        F.count_if(F.trim("text").rlike(r"^\d[a-c]?\.\s*\S")).alias("numbered"),
        F.upper(in_order).alias("joined"),
    )
    country = country_of(F.col("joined"))
    template = (
        F.when(F.col("machine"), "mrz")
        .when(F.col("numbered") >= 3, "eu_license")
        .when(F.col("joined").rlike(r"\b\d\.\d{2}\s+[A-Z]{3}\b"), "eu_id_positional")
        .when(any_of(F.col("joined"), CARD_WORDS), "mykad")
        .when(country.isNotNull(), F.concat(F.lit("fallback_"), country))
        .otherwise("unknown")
    )
    return signals.select(doc, template.alias("template"))


def sure_segments(segments: DataFrame, label: str, doc: str = "doc") -> DataFrame:
    """Segments of a field above the confidence floor, one for each place rounded to hundredths."""
    subset = segments.where((F.col("label") == label) & (F.col("ocr_conf") >= CONF_FLOOR))
    return keep_first(subset, [F.col(doc), F.bround("y", 2), F.bround("x", 2)], [F.col("seg_idx")])


def _in_reading_order(found: Column, label: str) -> Column:
    """Texts of structs (y, seg_idx, x, text), by lines and then from left to right, cleaned as the field asks."""

    def joined(s: Column) -> Column:
        line = line_numbers(F.transform(s, lambda p: p["y"]), LINE_GAP)
        keyed = F.array_sort(F.zip_with(line, s, lambda n, p: F.struct(n.alias("n"), p["x"].alias("x"), p["seg_idx"].alias("i"), p["text"].alias("t"))))
        return F.array_join(F.transform(keyed, lambda p: p["t"]), " ")

    text = bound(F.array_sort(found), joined)
    return normalize_name(text) if label == "name" else normalize_address(text)


def assembled_text(segments: DataFrame, label: str, doc: str = "doc") -> DataFrame:
    """(doc, value, conf): texts of a field in reading order, by lines and then from left to right."""
    rows = sure_segments(segments, label, doc).groupBy(doc).agg(F.collect_list(F.struct("y", "seg_idx", "x", "text")).alias("s"), F.avg("ocr_conf").alias("conf"))
    return rows.select(doc, _in_reading_order(F.col("s"), label).alias("value"), "conf")


def assembled_date(segments: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, value, conf): the topmost birth date."""
    top = sure_segments(segments, "birth_date", doc).groupBy(doc).agg(F.min_by(F.struct("text", "ocr_conf"), F.struct("y", "seg_idx")).alias("s"))
    return top.select(doc, dates.normalize_date(F.col("s.text")).alias("value"), F.col("s.ocr_conf").alias("conf"))


def _dated(segments: DataFrame) -> DataFrame:
    """Segments with ``dated``, a struct of their number, date and confidence where the whole text reads as a date."""
    value = F.col("_value").rlike(r"^\d{4}-\d{2}-\d{2}$")
    found = F.struct("seg_idx", F.col("_value").alias("value"), F.coalesce("ocr_conf", F.lit(0.5)).alias("conf"))
    return segments.withColumn("_value", dates.normalize_date(F.col("text"))).withColumn("dated", F.when(value, found)).drop("_value")


def scanned_date(segments: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, value, conf): the first segment of any label that reads as a whole date."""
    first = _dated(segments).groupBy(doc).agg(F.min("dated").alias("s")).where("s IS NOT NULL")
    return first.select(doc, "s.value", "s.conf")


def extracted(segments: DataFrame, home: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pred_name, pred_dob, pred_addr, conf_name, conf_dob, conf_addr); ``home``: (doc, is_home), as only
    documents of the home country have addresses. Segments are read once: those at one place of one field become the
    first of them, then all of a document's one row."""
    sure = F.when(F.col("ocr_conf") >= CONF_FLOOR, F.struct("seg_idx", "y", "x", "text", "ocr_conf"))
    places = _dated(segments).groupBy(doc, "label", F.bround("y", 2), F.bround("x", 2)).agg(F.min(sure).alias("p"), F.min("dated").alias("dated"))
    of = lambda label, *names: F.when((F.col("label") == label) & F.col("p").isNotNull(), F.struct(*[F.col(f"p.{n}") for n in names]))
    texts = ("y", "seg_idx", "x", "text")
    conf = lambda label: F.avg(F.when(F.col("label") == label, F.col("p.ocr_conf")))
    rows = places.groupBy(doc).agg(
        F.collect_list(of("name", *texts)).alias("name"), F.collect_list(of("address", *texts)).alias("address"), F.min(of("birth_date", "y", "seg_idx", "text", "ocr_conf")).alias("top"),
        F.min("dated").alias("scan"), conf("name").alias("conf_name"), conf("address").alias("conf_addr"),
    )
    out = home.join(rows, doc, "left").withColumn("pred_dob", dates.normalize_date(F.col("top.text")))
    lacks = F.coalesce("pred_dob", F.lit("")) == ""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return out.select(
        doc, "is_home", clean_name(blank(_in_reading_order(F.col("name"), "name"))).alias("pred_name"),
        F.when(lacks, blank(F.col("scan.value"))).otherwise(F.col("pred_dob")).alias("pred_dob"),
        F.when(F.col("is_home"), blank(_in_reading_order(F.col("address"), "address"))).otherwise("").alias("pred_addr"),
        F.coalesce("conf_name", F.lit(0.0)).alias("conf_name"),
        F.coalesce(F.when(lacks, F.col("scan.conf")).otherwise(F.col("top.ocr_conf")), F.lit(0.0)).alias("conf_dob"),
        F.when(F.col("is_home"), F.coalesce("conf_addr", F.lit(0.0))).otherwise(0.0).alias("conf_addr"),
    )


def machine_fields(lines: Column, pivot: int = 25) -> tuple[Column, Column]:
    """(name, birth date) of machine-readable lines: of two lines, the second holds the date after 13 characters,
    of three, at its start; the name line drops a prefix of five and parts surname from given names at <<."""
    n = F.size(lines)
    name_line = F.when(n >= 3, F.get(lines, 2)).otherwise(F.substring(F.get(lines, 0), 6, 100))
    surname, given = F.split_part(name_line, F.lit("<<"), F.lit(1)), F.split_part(name_line, F.lit("<<"), F.lit(2))
    spaced = lambda c: F.trim(F.replace(c, F.lit("<"), F.lit(" ")))
    digits = F.when(n >= 3, F.substring(F.get(lines, 1), 1, 6)).otherwise(F.substring(F.coalesce(F.get(lines, 1), F.get(lines, 0)), 14, 6))
    century = F.when(F.substring(digits, 1, 2).try_cast("int") > pivot, "19").otherwise("20")
    date = F.concat(century, F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), F.substring(digits, 5, 2))
    return F.trim(F.concat_ws(" ", spaced(given), spaced(surname))), F.when(digits.rlike(r"^\d{6}$"), date).otherwise("")


def numbered_field(text: Column) -> Column:
    """struct(field, value) of a line that starts with a field number, its dot optional; a number that ran into
    the date behind it is parted from it."""
    glued = text.rlike(r"^3\d{2}\.\d{2}\.\d{2,4}$")
    pattern = r"(?U)^(\d[a-c]?)\.?\s+(.*)"
    field = F.when(glued, "3").otherwise(F.regexp_extract(text, pattern, 1))
    value = F.when(glued, F.substring(text, 2, 20)).otherwise(F.regexp_extract(text, pattern, 2))
    return F.struct(field.alias("field"), value.alias("value"))


def license_fields(segments: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, pred_name, pred_dob) of numbered fields: 1 surname, 2 given names, 3 birth date, the first of each."""
    rows = segments.withColumn("_f", numbered_field(F.trim("text"))).where("_f.field IN ('1', '2', '3')")
    got = rows.groupBy(doc).agg(*[F.min(F.when(F.col("_f.field") == n, F.struct("seg_idx", F.col("_f.value").alias("v")))).alias(f"f{n}") for n in "123"])
    return got.select(doc, F.concat_ws(" ", "f2.v", "f1.v").alias("pred_name"), F.coalesce(dates.normalize_date(F.col("f3.v")), F.lit("")).alias("pred_dob"))


def triage(blur: Column, prediction: Column) -> Column:
    """0 for a picture too blurred, else the model's word."""
    return F.when(F.coalesce(blur < 30, F.lit(False)), 0).otherwise(prediction)


def route(blur: Column, brightness: Column, dark: Column, name: Column, dob: Column, readable: Column, home: Column, confs: tuple[Column, Column, Column]) -> Column:
    """REJECT, HUMAN_REVIEW or AUTO_APPROVE by ordered gates: the picture, the fields, the model, the confidence."""
    bad = F.coalesce((blur < 30) | (brightness < 30) | (dark > 0.80), F.lit(False))
    valid = (validate_name(name) == "OK") & (validate_date(dob) == "OK")
    lowest = F.when(home, F.least(*confs)).otherwise(F.least(*confs[:2]))
    return (
        F.when(bad, "REJECT")
        .when(~valid, "HUMAN_REVIEW")
        .when(F.coalesce(readable == 0, F.lit(False)), "REJECT")
        .when(lowest >= AUTO_APPROVE, "AUTO_APPROVE")
        .otherwise("HUMAN_REVIEW")
    )
