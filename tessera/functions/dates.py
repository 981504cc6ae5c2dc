"""Dates written in many ways, as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.distance import cer_at_least_one
from tessera.functions.text import bound, strip

# Month names and their numbers, in the order in which they are tried.
MONTHS = {
    "JAN": "01", "JANUARI": "01", "JANUARY": "01", "FEB": "02", "FEBRUARI": "02", "FEBRUARY": "02", "MAR": "03", "MAC": "03", "MARCH": "03",
    "MARET": "03", "APR": "04", "APRIL": "04", "MAY": "05", "MEI": "05", "JUN": "06", "JUNE": "06", "JUNI": "06", "JUL": "07", "JULY": "07",
    "JULI": "07", "AUG": "08", "OGOS": "08", "AUGUST": "08", "AGUSTUS": "08", "SEP": "09", "SEPTEMBER": "09", "OCT": "10", "OKT": "10",
    "OKTOBER": "10", "OCTOBER": "10", "NOV": "11", "NOVEMBER": "11", "DEC": "12", "DIS": "12", "DISEMBER": "12", "DECEMBER": "12", "DESEMBER": "12",
}
DAY_FIRST = r"(?U)\b(\d{2})[.:/-](\d{2})[.:/-](\d{4})\b"
YEAR_FIRST = r"(?U)\b(\d{4})[.:/-](\d{2})[.:/-](\d{2})\b"


def _upper(text: Column) -> Column:
    return strip(F.replace(F.upper(text), F.lit(","), F.lit("")))


def _swapped(t: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    """Year, month and day of the first match, or null."""
    parts = [F.regexp_extract(t, pattern, i) for i in order]
    return F.when(t.rlike(pattern), F.concat_ws("-", *parts))


#: A day, a month's name and a year, at whatever place one begins.
NAMED = rf"(?U)(?=((\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})))"


def _by_month_name(t: Column) -> Column:
    """The first month name, in order, that stands between a day and a year: all such places are found in one go."""
    names, numbers = F.array(*[F.lit(n) for n in MONTHS]), F.array(*[F.lit(n) for n in MONTHS.values()])
    part = lambda s, i: F.regexp_extract(s, rf"(?U)^(\d{{1,2}})\s+(\S+)\s+(\d{{4}})$", i)
    placed = F.transform(F.regexp_extract_all(t, F.lit(NAMED), F.lit(1)), lambda s, i: F.struct(F.array_position(names, part(s, 2)).alias("k"), i.alias("i"), s.alias("s")))
    first = F.array_min(placed)
    return bound(first, lambda p: F.when(p.isNotNull(), F.concat_ws("-", part(p["s"], 3), F.get(numbers, p["k"].cast("int") - 1), F.lpad(part(p["s"], 1), 2, "0"))))


def normalize_date_weak(text: Column) -> Column:
    """YYYY-MM-DD if the text holds a date, day or year first or with a month's name; else the text in capitals."""
    return bound(_upper(text), lambda t: F.coalesce(_swapped(t, DAY_FIRST, (3, 2, 1)), _swapped(t, YEAR_FIRST, (1, 2, 3)), _by_month_name(t), t))


def _century(two: Column, pivot: int) -> Column:
    return F.concat(F.when(two.cast("int") > pivot, F.lit("19")).otherwise(F.lit("20")), two)


def normalize_date(text: Column, pivot: int = 25) -> Column:
    """YYYY-MM-DD by ordered patterns: printed dates, dates with a month's name, the date in a machine-readable
    line or an identity number, six bare digits; else the empty text. Years above ``pivot`` are 19YY."""

    def read(t: Column) -> Column:
        bare = F.regexp_replace(t, r"[\s-]", "")
        six = F.coalesce(
            F.when((F.length(bare) >= 28) & F.contains(bare, F.lit("<")), F.regexp_extract(F.substring(bare, 14, 6), r"^(\d{6})$", 1)),
            F.when(bare.rlike(r"^\d{12}$"), F.substring(bare, 1, 6)),
            F.when(bare.rlike(r"^\d{6}$"), bare),
        )
        short = F.concat_ws("-", _century(F.substring(six, 1, 2), pivot), F.substring(six, 3, 2), F.substring(six, 5, 2))
        known = F.when(F.coalesce(six, F.lit("")) != "", short)
        return F.coalesce(_swapped(t, DAY_FIRST, (3, 2, 1)), _swapped(t, YEAR_FIRST, (1, 2, 3)), _by_month_name(t), known, F.lit(""))

    return bound(_upper(text), read)


def _compact(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def short_date_found(text: Column, birth: Column) -> Column:
    """Whether YYMMDD of a full birth date stands anywhere in the text, one edit allowed."""
    t = _compact(text)
    wanted = F.concat(F.substring(birth, 3, 2), F.substring(birth, 6, 2), F.substring(birth, 9, 2))
    six = lambda i: F.substr(t, i, F.lit(6))
    hit = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 5)), lambda i: (F.length(six(i)) == 6) & (F.levenshtein(wanted, six(i), 1) >= 0))
    return F.coalesce((F.length(birth) >= 10) & hit, F.lit(False))


def month_day_leads(text: Column, birth: Column) -> Column:
    """Whether the text, of ten characters or more, starts with MMDD of a full birth date, one edit allowed."""
    t = _compact(text)
    wanted = F.concat(F.substring(birth, 6, 2), F.substring(birth, 9, 2))
    return F.coalesce((F.length(birth) >= 10) & (F.length(t) >= 10) & (F.levenshtein(wanted, F.substring(t, 1, 4), 1) >= 0), F.lit(False))


def date_reads_like(text: Column, birth: Column) -> Column:
    return F.coalesce(cer_at_least_one(normalize_date_weak(text), birth) < 0.3, F.lit(False))


def birth_date_evidence(text: Column, birth: Column) -> Column:
    """1 if the text shows the birth date in any of these ways, else 0."""
    return (short_date_found(text, birth) | month_day_leads(text, birth) | date_reads_like(text, birth)).cast("double")
