"""Text expressions: Column to Column, all within Catalyst.

Words are parted by Unicode white space; lengths are code points. A null text gives null unless a function says
otherwise. Flags are integers 0 or 1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# State names and short forms looked for in identity-card text.
STATES = (
    "JOHOR", "KEDAH", "KELANTAN", "MELAKA", "NEGERI SEMBILAN", "PAHANG", "PERAK", "PERLIS", "PULAU PINANG", "SABAH", "SARAWAK", "SELANGOR",
    "TERENGGANU", "KUALA LUMPUR", "LABUAN", "PUTRAJAYA", "W. PERSEKUTUAN", "KL", "SBH", "SWK", "PNG", "TRG", "PHG",
)
# Address words.
ADDRESS_WORDS = ("JALAN", "JLN", "LORONG", "LRG", "KAMPUNG", "KG", "NO.", "NO ", "TAMAN", "TMN", "PERSIARAN", "LEBUH", "BATU", "TINGKAT", "BLOK")
# Patronymic marks.
PATRONYMICS = ("BIN ", "BINTI ", "A/L ", "A/P ")
# Address words of the rule-based field classifier.
RULE_ADDRESS_WORDS = ("JALAN", "JLN", "LORONG", "LRG", "KAMPUNG", "KG", "TAMAN", "TMN", "SELANGOR", "JOHOR", "PERAK", "SABAH", "SARAWAK", "KUALA LUMPUR")
# Noise removed from names and addresses, and abbreviations spelled out.
NAME_NOISE = ("NAMA:", "NAME:", "NAMA", "NAME", "PENUH", "FULL")
NAME_NOISE_WORDS = ("WARGANEGARA", "MALAYSIA", "LELAKI", "PEREMPUAN", "ISLAM", "MYKAD", "KAD", "PENGENALAN")
ADDRESS_NOISE = ("ALAMAT:", "ADDRESS:", "ALAMAT", "ADDRESS")
ABBREVIATIONS = (("JLN", "JALAN"), ("LRG", "LORONG"), ("KG", "KAMPUNG"), ("TMN", "TAMAN"), ("PKR", "PERAK"))
# Words of the identity card, and printed field labels in several languages.
CARD_WORDS = ("MYKAD", "KAD PENGENALAN", "WARGANEGARA")
LABEL_WORDS = (
    "NOMBRES", "APELLIDOS", "NOM", "PRENOM", "COGNOME", "NOME", "SOBRENOME", "FAMILIENNAME", "VORNAME", "IMIE", "NAZWISKO", "IME", "PREZIME",
    "CHILENA", "BRASILEIRO", "ALGERIENNE",
)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def null_literals(text: Column) -> Column:
    """Trimmed text; the spelled-out nulls and the empty text become null."""
    bare = strip(text)
    return F.when(bare.isin("nan", "None", ""), F.lit(None)).otherwise(bare)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def _kept(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, "")) / F.greatest(F.length(text), F.lit(1))


def alpha_ratio(text: Column) -> Column:
    return _kept(text, r"[^\p{L}]")


def digit_ratio(text: Column) -> Column:
    """Share of decimal digits and of raised or lowered ones."""
    return _kept(text, r"[^\p{Nd}²³¹⁰-⁹₀-₉]")


def is_all_caps(text: Column) -> Column:
    return flag((text == F.upper(text)) & (text != F.lower(text)))


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def has_date(text: Column) -> Column:
    return flag(text.rlike(r"(?U)\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\b\d{4}\b"))


def has_address_word(text: Column) -> Column:
    return flag(any_of(F.upper(text), ADDRESS_WORDS))


def has_state(text: Column) -> Column:
    return flag(any_of(F.upper(text), STATES))


def has_postcode(text: Column) -> Column:
    return flag(text.rlike(r"(?U)\b\d{5}\b"))


def has_patronymic(text: Column) -> Column:
    return flag(any_of(F.upper(text), PATRONYMICS))


def has_card_word(text: Column) -> Column:
    return flag(any_of(F.upper(text), CARD_WORDS))


def has_id_number(text: Column) -> Column:
    return flag(text.rlike(r"(?U)\b\d{12}\b|\b\d{6}-\d{2}-\d{4}\b"))


def has_non_ascii(text: Column) -> Column:
    return flag(text.rlike(r"[^\x00-\x7F]"))


def strip_field_number(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"(?U)^\d+[a-c]?\.\s*", "")


def rule_field(text: Column) -> Column:
    """Field of a segment by ordered rules alone: birth_date, address, name or other."""
    t = F.upper(strip(text))
    dated = t.rlike(r"(?U)\d{4}-\d{2}-\d{2}") | t.rlike(r"(?U)\d{2}/\d{2}/\d{4}") | t.rlike(r"(?U)^\d{4}$")
    named = (alpha_ratio(t) > 0.7) & (digit_ratio(t) < 0.1) & (F.length(t) >= 4)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.lit("other"))
        .when(dated, F.lit("birth_date"))
        .when(any_of(t, RULE_ADDRESS_WORDS), F.lit("address"))
        .when(named, F.lit("name"))
        .otherwise(F.lit("other"))
    )


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_name(text: Column) -> Column:
    bare = reduce(lambda t, noise: F.replace(t, F.lit(noise), F.lit("")), NAME_NOISE, F.upper(strip(text)))
    letters = F.regexp_replace(bare, r"[^A-Z /\-]", " ")
    return squeeze(F.regexp_replace(letters, rf"\b({'|'.join(NAME_NOISE_WORDS)})\b", ""))


def normalize_address(text: Column) -> Column:
    bare = reduce(lambda t, noise: F.replace(t, F.lit(noise), F.lit("")), ADDRESS_NOISE, F.upper(strip(text)))
    return squeeze(reduce(lambda t, pair: F.regexp_replace(t, rf"\b{pair[0]}\b", pair[1]), ABBREVIATIONS, bare))


def clean_name(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\d", "")


def validate_name(text: Column) -> Column:
    """OK, or the first rule that a name breaks."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) < 2, "EMPTY").when(t.rlike(r"(?U)\d"), "CONTAINS_DIGIT").when(F.length(t) > 100, "TOO_LONG").otherwise("OK")


def validate_date(text: Column) -> Column:
    """OK, or the first rule that a date, of the form YYYY or YYYY-MM-DD, breaks, with the part at fault."""
    t = F.coalesce(text, F.lit(""))
    part = lambda i: F.regexp_extract(t, r"^(\d{4})(?:-(\d{2})-(\d{2}))?$", i).try_cast("int")
    year, month, day = part(1), part(2), part(3)
    return (
        F.when(t == "", F.lit("EMPTY"))
        .when(year.isNull(), F.lit("BAD_FORMAT"))
        .when(~year.between(1900, 2015), F.concat(F.lit("YEAR_OUT_OF_RANGE:"), year.cast("string")))
        .when(month.isNotNull() & ~month.between(1, 12), F.concat(F.lit("BAD_MONTH:"), month.cast("string")))
        .when(day.isNotNull() & ~day.between(1, 31), F.concat(F.lit("BAD_DAY:"), day.cast("string")))
        .otherwise(F.lit("OK"))
    )


def drop_label_words(text: Column) -> Column:
    """Text without the printed field labels, with or without a colon."""
    return F.array_join(F.filter(words(text), lambda w: ~F.upper(F.regexp_replace(w, ":+$", "")).isin(*LABEL_WORDS)), " ")


def given_name_first(text: Column, surname_first: Column) -> Column:
    """The last word moved to the front where ``surname_first`` holds and there are two words or more."""
    w = words(text)
    moved = F.concat_ws(" ", F.element_at(w, -1), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "))
    return F.when(surname_first & (F.size(w) >= 2), moved).otherwise(text)
