"""Text, distance and date functions over lines, turns and rendered dates.

The checking SQL works on characters, as the engine does, with three helpers: its ``levenshtein`` counts bytes, so
letters beyond ASCII are swapped one to one for control characters first (``flat``); its ``upper`` keeps the sharp s
(``up``); and its word boundaries know ASCII only (``stands``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import dates, distance, text
from tessera.plans.registry import query
from tessera.sources.tables import Tables

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


# Fixed values of the checking SQL: the letters beyond ASCII in the sample tables, and as many control characters
# that aren't blanks.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
CONTROLS = [*range(1, 9), *range(14, 27)]
# Fixed values of the checking SQL: the word lists again, so that a slip in the engine's shows.
SQL_ADDRESS = ("JALAN", "JLN", "LORONG", "LRG", "KAMPUNG", "KG", "NO.", "NO ", "TAMAN", "TMN", "PERSIARAN", "LEBUH", "BATU", "TINGKAT", "BLOK")
SQL_STATES = (
    "JOHOR", "KEDAH", "KELANTAN", "MELAKA", "NEGERI SEMBILAN", "PAHANG", "PERAK", "PERLIS", "PULAU PINANG", "SABAH", "SARAWAK", "SELANGOR",
    "TERENGGANU", "KUALA LUMPUR", "LABUAN", "PUTRAJAYA", "W. PERSEKUTUAN", "KL", "SBH", "SWK", "PNG", "TRG", "PHG",
)
SQL_PATRONYMICS = ("BIN ", "BINTI ", "A/L ", "A/P ")
SQL_CARD = ("MYKAD", "KAD PENGENALAN", "WARGANEGARA")
SQL_RULE_ADDRESS = ("JALAN", "JLN", "LORONG", "LRG", "KAMPUNG", "KG", "TAMAN", "TMN", "SELANGOR", "JOHOR", "PERAK", "SABAH", "SARAWAK", "KUALA LUMPUR")
SQL_NAME_NOISE = ("NAMA:", "NAME:", "NAMA", "NAME", "PENUH", "FULL")
SQL_NAME_WORDS = ("WARGANEGARA", "MALAYSIA", "LELAKI", "PEREMPUAN", "ISLAM", "MYKAD", "KAD", "PENGENALAN")
SQL_ADDRESS_NOISE = ("ALAMAT:", "ADDRESS:", "ALAMAT", "ADDRESS")
SQL_SHORT = (("JLN", "JALAN"), ("LRG", "LORONG"), ("KG", "KAMPUNG"), ("TMN", "TAMAN"), ("PKR", "PERAK"))
SQL_LABELS = (
    "NOMBRES", "APELLIDOS", "NOM", "PRENOM", "COGNOME", "NOME", "SOBRENOME", "FAMILIENNAME", "VORNAME", "IMIE", "NAZWISKO", "IME", "PREZIME",
    "CHILENA", "BRASILEIRO", "ALGERIENNE",
)


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def up(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def flat(x: str) -> str:
    return f"translate({x}, '{LETTERS}', {' || '.join(f'chr({i})' for i in CONTROLS)})"


def edits(x: str, y: str) -> str:
    return f"levenshtein({flat(x)}, {flat(y)})"


def stands(word: str) -> str:
    """Pattern of a whole word, to be searched for in either case."""
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({word})($|[^\\p{{L}}\\p{{N}}_])"


def lines(t: Tables) -> DataFrame:
    """(doc_id, seg_idx, text): the lines of each document."""
    parts = F.split("text", "\n")
    return t.documents.select("doc_id", F.posexplode(parts).alias("seg_idx", "text"))


LINES = """l AS (SELECT doc_id, unnest(range(len(s)))::INT AS seg_idx, unnest(s) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))"""


def turns(t: Tables) -> DataFrame:
    """(conv_id, turn, role, hyp, ref): each turn and the next one of its conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    own = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("hyp"))
    return own.withColumn("ref", F.lead("hyp").over(order)).where("ref IS NOT NULL")


TURNS = """p AS (SELECT * FROM (SELECT conv_id, turn, role, text AS hyp,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM conversations) WHERE ref IS NOT NULL)"""


def names(t: Tables) -> DataFrame:
    """(p_partkey, hyp, ref): a part's words, and the name of the part two keys on."""
    ref = t.part.select((F.col("p_partkey") - 2).alias("p_partkey"), F.col("p_name").alias("ref"))
    hyp = F.concat_ws(" ", "p_brand", F.lower("p_type"), "p_name", F.lit("Red"))
    return t.part.select("p_partkey", hyp.alias("hyp")).join(ref, "p_partkey")


NAMES = """n AS (SELECT a.p_partkey, a.p_brand || ' ' || lower(a.p_type) || ' ' || a.p_name || ' Red' AS hyp, b.p_name AS ref
  FROM part a JOIN part b ON b.p_partkey - 2 = a.p_partkey)"""


def _fold(x: str) -> str:
    return f"lower({STRIP.format(x)})"


@query("f1_normalize", f"SELECT conv_id, turn, lower({STRIP.format('nfc_normalize(text)')}) AS norm FROM conversations")
def f1(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", distance.compatible(F.col("text")).alias("norm"))


@query("f2_cer_one", f"WITH {NAMES} SELECT p_partkey, levenshtein({_fold('hyp')}, {_fold('ref')}) / greatest(length({_fold('ref')}), 1)::DOUBLE AS cer FROM n")
def f2(t: Tables) -> DataFrame:
    return names(t).select("p_partkey", distance.cer_compatible(F.col("hyp"), F.col("ref")).alias("cer"))


@query("f3_cer_pairs", f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN {_fold('ref')} = '' THEN CASE WHEN {_fold('hyp')} = '' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
  ELSE {edits(_fold('hyp'), _fold('ref'))} / length({_fold('ref')})::DOUBLE END AS cer FROM p""")
def f3(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", distance.cer(F.col("hyp"), F.col("ref")).alias("cer"))


@query("f4_wer_pairs", f"""WITH {TURNS}, w AS (SELECT conv_id, turn, {sql_words('lower(hyp)')} AS h, {sql_words('lower(ref)')} AS r FROM p)
  SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END
  ELSE {edits("array_to_string(h, ' ')", "array_to_string(r, ' ')")} / len(r)::DOUBLE END AS wer FROM w""")
def f4(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", distance.wer_charlev(F.col("hyp"), F.col("ref")).alias("wer"))


def _field_sql(by: str) -> str:
    return f"""WITH {NAMES}, w AS (SELECT p_partkey, {sql_words('lower(hyp)')} AS h, {_fold('ref')} AS r, greatest(1, len({sql_words(_fold('ref'))})) AS k FROM n),
e AS (SELECT *, CASE WHEN len(h) < k THEN [array_to_string(h, ' ')]
  ELSE list_transform(range(len(h) - k + 1), lambda i: array_to_string(h[i + 1 : i + k], ' ')) END AS runs FROM w)
SELECT p_partkey, CASE WHEN r = '' THEN 0.0::DOUBLE WHEN len(h) = 0 THEN 1.0::DOUBLE
  ELSE list_min(list_transform(runs, lambda x: levenshtein(x, r))) / {by}::DOUBLE END AS best FROM e"""


@query("f5_best_window", _field_sql("length(r)"))
def f5(t: Tables) -> DataFrame:
    return names(t).select("p_partkey", distance.cer_field(F.col("hyp"), F.col("ref")).alias("best"))


@query("f6_wer_field", _field_sql("k"))
def f6(t: Tables) -> DataFrame:
    return names(t).select("p_partkey", distance.wer_field(F.col("hyp"), F.col("ref")).alias("best"))


@query("w10_windows", f"""WITH {NAMES}, w AS (SELECT p_partkey, {sql_words('lower(hyp)')} AS h FROM n)
SELECT p_partkey, list_transform(range(len(h) - 1), lambda i: array_to_string(h[i + 1 : i + 2], ' '))[2] AS second, greatest(len(h) - 1, 1) AS n_windows FROM w""")
def w10(t: Tables) -> DataFrame:
    runs = distance.windows(text.words(F.lower("hyp")), F.lit(2))
    return names(t).select("p_partkey", F.get(runs, 1).alias("second"), F.size(runs).cast("bigint").alias("n_windows"))


@query("f7_token_f1", f"""WITH {TURNS}, w AS (SELECT conv_id, turn, list_distinct({sql_words('lower(hyp)')}) AS h, list_distinct({sql_words('lower(ref)')}) AS r FROM p),
b AS (SELECT *, len(list_intersect(h, r)) AS k FROM w)
SELECT conv_id, turn, CASE WHEN len(h) = 0 AND len(r) = 0 THEN 1.0::DOUBLE WHEN len(h) = 0 OR len(r) = 0 OR k = 0 THEN 0.0::DOUBLE
  ELSE 2 * (k / len(h)::DOUBLE) * (k / len(r)::DOUBLE) / (k / len(h)::DOUBLE + k / len(r)::DOUBLE) END AS f1 FROM b""")
def f7(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", distance.token_f1(F.col("hyp"), F.col("ref")).alias("f1"))


@query("f8_exact", f"WITH {NAMES} SELECT p_partkey, ({_fold('ref')} = {_fold('upper(ref)')})::INT::DOUBLE AS same FROM n")
def f8(t: Tables) -> DataFrame:
    return names(t).select("p_partkey", distance.exact_match(F.concat(F.lit(" "), F.upper("ref")), F.col("ref")).alias("same"))


def _overlap_sql(hyp: str, ref: str) -> str:
    s, r = f"replace({up(hyp)}, ' ', '')", f"replace({up(ref)}, ' ', '')"
    w, g = sql_words(up(hyp)), f"list_distinct({sql_words(up(ref))})"
    near = f"len(list_filter({g}, lambda y: CASE WHEN length(x) >= 4 THEN {edits('x', 'y')} <= 1 ELSE x = y END)) > 0"
    return f"""CASE WHEN length({r}) >= 4 AND (contains({s}, {r}) OR {edits(s, r)} <= 2) THEN 1.0::DOUBLE
  WHEN len({w}) = 0 OR len({g}) = 0 THEN 0.0::DOUBLE ELSE len(list_filter({w}, lambda x: {near})) / len({w})::DOUBLE END"""


@query("f9_token_overlap", f"WITH {TURNS} SELECT conv_id, turn, role, {_overlap_sql('hyp', 'ref')} AS overlap FROM p")
def f9(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", "role", distance.token_overlap(F.col("hyp"), F.col("ref")).alias("overlap"))


@query("j9_near_tokens", f"""WITH {NAMES}, w AS (SELECT p_partkey, {sql_words('upper(hyp)')} AS h, {sql_words('upper(ref)')} AS r FROM n)
SELECT p_partkey, len(list_filter(h, lambda x: len(list_filter(r, lambda y: levenshtein(x, y) <= 1)) > 0))::INT AS n_near FROM w""")
def j9(t: Tables) -> DataFrame:
    h, r = text.words(F.upper("hyp")), text.words(F.upper("ref"))
    near = F.filter(h, lambda x: F.exists(r, lambda y: (F.abs(F.length(x) - F.length(y)) <= 1) & (F.levenshtein(x, y, 1) >= 0)))
    return names(t).select("p_partkey", F.size(near).alias("n_near"))


@query("f10_pseudo_cer", f"""WITH {TURNS}, w AS (SELECT conv_id, turn, list_distinct({sql_words(up('hyp'))}) AS h, list_distinct({sql_words(up('ref'))}) AS r FROM p)
SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - len(list_intersect(r, h)) / len(r)::DOUBLE END AS pseudo_cer FROM w""")
def f10(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", distance.pseudo_cer(F.col("hyp"), F.col("ref")).alias("pseudo_cer"))


@query("f11_token_recall", f"""WITH {TURNS}, w AS (SELECT conv_id, turn, list_distinct({sql_words(up('hyp'))}) AS h, {sql_words(up('ref'))} AS r FROM p)
SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(r, lambda x: len(list_filter(h, lambda y:
  CASE WHEN length(x) >= 4 THEN {edits('x', 'y')} <= 1 ELSE x = y END)) > 0)) / len(r)::DOUBLE END AS recall FROM w""")
def f11(t: Tables) -> DataFrame:
    return turns(t).select("conv_id", "turn", distance.token_recall(F.col("hyp"), F.col("ref")).alias("recall"))


NUMBERED = "(1 + doc_id % 9) || CASE WHEN seg_idx % 2 = 0 THEN 'a. ' ELSE '.' END || text"


def numbered() -> Column:
    mark = F.when(F.col("seg_idx") % 2 == 0, "a. ").otherwise(".")
    return F.concat((F.col("doc_id") % 9 + 1).cast("string"), mark, F.col("text"))


@query("f12_field_number", f"WITH {LINES} SELECT doc_id, seg_idx, regexp_replace({STRIP.format(NUMBERED)}, '^\\d+[a-c]?\\.\\s*', '') AS bare FROM l")
def f12(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.strip_field_number(numbered()).alias("bare"))


def _any(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")::INT"


DATED = "strftime(o_orderdate, '%Y-%m-%d')"


def rendered(t: Tables) -> DataFrame:
    """(o_orderkey, iso, written): order dates, and the same written in one of six ways."""
    day = F.col("o_orderdate").cast("date")
    ways = ["dd.MM.yyyy", "yyyy/MM/dd", "d MMMM yyyy", "dd-MM-yyyy", "yyyy", "dd/MM/yyyy"]
    k = F.col("o_orderkey") % 6
    written = F.coalesce(*[F.when(k == i, F.date_format(day, way)) for i, way in enumerate(ways)])
    return t.orders.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("iso"), F.concat(F.lit("Born, "), written).alias("written"))


RENDERED = """d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'Born, ' || CASE o_orderkey % 6
  WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%-d %B %Y')
  WHEN 3 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS written FROM orders)"""


@query("f13_has_date", f"WITH {RENDERED} SELECT o_orderkey, regexp_matches(written, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|\\b\\d{{4}}\\b')::INT AS has_date FROM d")
def f13(t: Tables) -> DataFrame:
    return rendered(t).select("o_orderkey", text.has_date(F.col("written")).alias("has_date"))


@query("f14_address_word", f"WITH {LINES} SELECT doc_id, seg_idx, {_any(up('text'), SQL_ADDRESS)} AS has_address_kw FROM l")
def f14(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.has_address_word(F.col("text")).alias("has_address_kw"))


@query("f15_state", f"WITH {LINES} SELECT doc_id, seg_idx, {_any(up('text'), SQL_STATES)} AS has_state_kw FROM l")
def f15(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.has_state(F.col("text")).alias("has_state_kw"))


@query("f16_postcode", "SELECT o_orderkey, regexp_matches('A ' || (o_orderkey * 7) || ' b', '\\b\\d{5}\\b')::INT AS has_postcode FROM orders")
def f16(t: Tables) -> DataFrame:
    written = F.concat(F.lit("A "), (F.col("o_orderkey") * 7).cast("string"), F.lit(" b"))
    return t.orders.select("o_orderkey", text.has_postcode(written).alias("has_postcode"))


@query("f17_patronymic", f"WITH {LINES} SELECT doc_id, seg_idx, {_any(up('text'), SQL_PATRONYMICS)} AS has_bin_binti FROM l")
def f17(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.has_patronymic(F.col("text")).alias("has_bin_binti"))


@query("f18_ratios", f"""WITH {LINES} SELECT doc_id, seg_idx, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS alpha_ratio,
  length(regexp_replace(text, '[^\\p{{Nd}}²³¹⁰-⁹₀-₉]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS digit_ratio FROM l""")
def f18(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.alpha_ratio(F.col("text")).alias("alpha_ratio"), text.digit_ratio(F.col("text")).alias("digit_ratio"))


@query("f19_lengths", f"""WITH {LINES} SELECT doc_id, seg_idx, length(text)::INT AS text_len, len({sql_words('text')})::INT AS word_count,
  (text = {up('text')} AND text <> lower(text))::INT AS is_all_caps FROM l""")
def f19(t: Tables) -> DataFrame:
    c = F.col("text")
    return lines(t).select("doc_id", "seg_idx", F.length(c).alias("text_len"), text.word_count(c).alias("word_count"), text.is_all_caps(c).alias("is_all_caps"))


JOINED = up("string_agg(text, ' ' ORDER BY seg_idx)")


@query("f20_origin_features", f"""WITH {LINES}, j AS (SELECT doc_id, {JOINED} AS u, count(*) AS n_segments, avg(length(text)) AS avg_segment_len FROM l GROUP BY doc_id)
SELECT doc_id, {_any('u', SQL_CARD)} AS has_mykad_keyword, regexp_matches(u, '{stands('\\d{12}|\\d{6}-\\d{2}-\\d{4}')}')::INT AS has_ic_number_pattern,
  {_any('u', SQL_PATRONYMICS)} AS has_bin_binti_any_segment, n_segments, avg_segment_len FROM j""")
def f20(t: Tables) -> DataFrame:
    return origin_features(t)


def origin_features(t: Tables) -> DataFrame:
    """Signs of the home country in all lines of a document, joined in order."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"])
    docs = lines(t).groupBy("doc_id").agg(F.array_join(in_order, " ").alias("joined"), F.count(F.lit(1)).alias("n_segments"), F.avg(F.length("text")).alias("avg_segment_len"))
    c = F.upper("joined")
    return docs.select(
        "doc_id", text.has_card_word(c).alias("has_mykad_keyword"), text.has_id_number(c).alias("has_ic_number_pattern"),
        text.has_patronymic(c).alias("has_bin_binti_any_segment"), "n_segments", "avg_segment_len",
    )


@query("f21_reference_flags", "SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]')::INT AS has_diacritics, regexp_matches(text, '(?i)mykad|kad pengenalan')::INT AS has_card, regexp_matches(text, '[0-9]{12}')::INT AS has_id FROM documents")
def f21(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", text.has_non_ascii(c).alias("has_diacritics"), text.flag(c.rlike("(?i)mykad|kad pengenalan")).alias("has_card"), text.flag(c.rlike("[0-9]{12}")).alias("has_id"))


RULED = f"""CASE WHEN u = '' THEN 'other' WHEN regexp_matches(u, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}/\\d{{2}}/\\d{{4}}|^\\d{{4}}$') THEN 'birth_date'
  WHEN {_any('u', SQL_RULE_ADDRESS)} = 1 THEN 'address'
  WHEN length(regexp_replace(u, '[^\\p{{L}}]', '', 'g')) / greatest(length(u), 1)::DOUBLE > 0.7::DOUBLE AND length(regexp_replace(u, '[^0-9]', '', 'g')) / greatest(length(u), 1)::DOUBLE < 0.1::DOUBLE
    AND length(u) >= 4 THEN 'name' ELSE 'other' END"""


@query("f22_regex_classify", f"WITH {LINES} SELECT doc_id, seg_idx, {RULED} AS field FROM (SELECT *, {up(STRIP.format('text'))} AS u FROM l)")
def f22(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.rule_field(F.col("text")).alias("field"))


def _replaced(x: str, noise: tuple[str, ...]) -> str:
    for n in noise:
        x = f"replace({x}, '{n}', '')"
    return x


def _squeezed(x: str) -> str:
    return STRIP.format(f"regexp_replace({x}, '\\s+', ' ', 'g')")


@query("f23_normalize_name", f"""WITH {LINES} SELECT doc_id, seg_idx, {_squeezed(f"regexp_replace(regexp_replace({_replaced(up(STRIP.format('text')), SQL_NAME_NOISE)}, '[^A-Z /\\-]', ' ', 'g'), '\\b({'|'.join(SQL_NAME_WORDS)})\\b', '', 'g')")} AS name FROM l""")
def f23(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.normalize_name(F.col("text")).alias("name"))


def _spelled(x: str) -> str:
    for short, long in SQL_SHORT:
        x = f"regexp_replace({x}, '\\b{short}\\b', '{long}', 'g')"
    return x


@query("f24_normalize_address", f"SELECT c_custkey, {_squeezed(_spelled(_replaced('''upper('alamat: Jln ' || c_mktsegment || ', Kg  ' || c_name)''', SQL_ADDRESS_NOISE)))} AS address FROM customer")
def f24(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("alamat: Jln "), F.col("c_mktsegment"), F.lit(", Kg  "), F.col("c_name"))
    return t.customer.select("c_custkey", text.normalize_address(raw).alias("address"))


@query("f25_clean_name", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '', 'g') AS name FROM customer")
def f25(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.clean_name(F.col("c_name")).alias("name"))


@query("f26_validate_name", f"""WITH {LINES} SELECT doc_id, seg_idx, CASE WHEN length(text) < 2 THEN 'EMPTY' WHEN regexp_matches(text, '[0-9]') THEN 'CONTAINS_DIGIT'
  WHEN length(text) > 100 THEN 'TOO_LONG' ELSE 'OK' END AS verdict FROM l""")
def f26(t: Tables) -> DataFrame:
    return lines(t).select("doc_id", "seg_idx", text.validate_name(F.col("text")).alias("verdict"))


SHIFTED = "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '20%y-%m-%d') END"


@query("f27_validate_date", f"""WITH d AS (SELECT o_orderkey, {SHIFTED} AS x FROM orders), s AS (SELECT *, regexp_extract(x, '^(\\d{{4}})(-\\d{{2}}-\\d{{2}})?$', 1) AS y,
  regexp_extract(x, '^\\d{{4}}-(\\d{{2}})-(\\d{{2}})$', 1) AS m, regexp_extract(x, '^\\d{{4}}-(\\d{{2}})-(\\d{{2}})$', 2) AS d FROM d)
SELECT o_orderkey, CASE WHEN x = '' THEN 'EMPTY' WHEN y = '' THEN 'BAD_FORMAT' WHEN y::INT NOT BETWEEN 1900 AND 2015 THEN 'YEAR_OUT_OF_RANGE:' || y::INT
  WHEN m <> '' AND m::INT NOT BETWEEN 1 AND 12 THEN 'BAD_MONTH:' || m::INT WHEN d <> '' AND d::INT NOT BETWEEN 1 AND 31 THEN 'BAD_DAY:' || d::INT ELSE 'OK' END AS verdict FROM s""")
def f27(t: Tables) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    x = F.when(k == 0, "").when(k == 1, F.date_format(day, "yyyy")).when(k == 2, F.date_format(day, "yyyy-dd-MM")).otherwise(F.concat(F.lit("20"), F.date_format(day, "yy-MM-dd")))
    return t.orders.select("o_orderkey", text.validate_date(x).alias("verdict"))


LABELLED = "CASE c_custkey % 3 WHEN 0 THEN 'NOMBRES: ' WHEN 1 THEN 'Prenom ' ELSE '' END || c_mktsegment || ' ' || c_name"


def labelled() -> Column:
    k = F.col("c_custkey") % 3
    return F.concat(F.when(k == 0, "NOMBRES: ").when(k == 1, "Prenom ").otherwise(""), F.col("c_mktsegment"), F.lit(" "), F.col("c_name"))


@query("f28_label_words", f"""SELECT c_custkey, array_to_string(list_filter({sql_words(LABELLED)}, lambda w: upper(rtrim(w, ':')) NOT IN ({', '.join(f"'{w}'" for w in SQL_LABELS)})), ' ') AS name FROM customer""")
def f28(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.drop_label_words(labelled()).alias("name"))


@query("f29_surname_first", f"""WITH w AS (SELECT c_custkey, {LABELLED} AS x, {sql_words(LABELLED)} AS w FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND len(w) >= 2 THEN w[-1] || ' ' || array_to_string(w[1 : len(w) - 1], ' ') ELSE x END AS name FROM w""")
def f29(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.given_name_first(labelled(), F.col("c_custkey") % 2 == 0).alias("name"))


def _weak_sql(x: str) -> str:
    """Day or year first, or a month's name: the written dates hold English names only."""
    u = f"upper(replace({x}, ',', ''))"
    months = " ".join(f"WHEN regexp_matches({u}, '\\d{{1,2}}\\s+{m}\\s+\\d{{4}}') THEN regexp_extract({u}, '\\d{{1,2}}\\s+{m}\\s+(\\d{{4}})', 1) || '-{n}-' || lpad(regexp_extract({u}, '(\\d{{1,2}})\\s+{m}\\s+\\d{{4}}', 1), 2, '0')" for m, n in dates.MONTHS.items())
    first, year = "\\b(\\d{2})[.:/-](\\d{2})[.:/-](\\d{4})\\b", "\\b(\\d{4})[.:/-](\\d{2})[.:/-](\\d{2})\\b"
    part = lambda p, i: f"regexp_extract({u}, '{p}', {i})"
    return f"""CASE WHEN regexp_matches({u}, '{first}') THEN {part(first, 3)} || '-' || {part(first, 2)} || '-' || {part(first, 1)}
  WHEN regexp_matches({u}, '{year}') THEN {part(year, 1)} || '-' || {part(year, 2)} || '-' || {part(year, 3)} {months} ELSE {u} END"""


@query("d1_normalize_date_weak", f"WITH {RENDERED} SELECT o_orderkey, {_weak_sql('written')} AS norm FROM d")
def d1(t: Tables) -> DataFrame:
    return rendered(t).select("o_orderkey", dates.normalize_date_weak(F.col("written")).alias("norm"))


NUMBER = "strftime(o_orderdate, '%y%m%d') || '-11-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0')"


def numbers(t: Tables) -> DataFrame:
    """(o_orderkey, number, iso): identity numbers that begin with a date, and the date of another order."""
    day = F.col("o_orderdate").cast("date")
    number = F.concat(F.date_format(day, "yyMMdd"), F.lit("-11-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"))
    other = F.date_add(day, (F.col("o_orderkey") % 3).cast("int") * 11)
    return t.orders.select("o_orderkey", number.alias("number"), F.date_format(other, "yyyy-MM-dd").alias("iso"))


NUMBERS = f"n AS (SELECT o_orderkey, {NUMBER} AS number, strftime(o_orderdate + to_days((o_orderkey % 3)::INT * 11), '%Y-%m-%d') AS iso FROM orders)"


@query("w11_short_date", f"""WITH {NUMBERS}, c AS (SELECT o_orderkey, replace(number, '-', '') AS x, iso[3:4] || iso[6:7] || iso[9:10] AS y FROM n)
SELECT o_orderkey, len(list_filter(range(greatest(1, length(x) - 5)), lambda i: length(substr(x, i + 1, 6)) = 6 AND levenshtein(y, substr(x, i + 1, 6)) <= 1)) > 0 AS found FROM c""")
def w11(t: Tables) -> DataFrame:
    return numbers(t).select("o_orderkey", dates.short_date_found(F.col("number"), F.col("iso")).alias("found"))


@query("d2_birth_evidence", f"""WITH {NUMBERS}, c AS (SELECT o_orderkey, number, iso, replace(number, '-', '') AS x, iso[3:4] || iso[6:7] || iso[9:10] AS y, iso[6:7] || iso[9:10] AS md FROM n)
SELECT o_orderkey, (len(list_filter(range(greatest(1, length(x) - 5)), lambda i: length(substr(x, i + 1, 6)) = 6 AND levenshtein(y, substr(x, i + 1, 6)) <= 1)) > 0
  OR (length(x) >= 10 AND levenshtein(md, substr(x, 1, 4)) <= 1) OR levenshtein(lower({_weak_sql('number')}), iso) / 10::DOUBLE < 0.3::DOUBLE)::INT::DOUBLE AS evidence FROM c""")
def d2(t: Tables) -> DataFrame:
    return numbers(t).select("o_orderkey", dates.birth_date_evidence(F.col("number"), F.col("iso")).alias("evidence"))


@query("d3_month_day", f"""WITH {NUMBERS} SELECT o_orderkey, levenshtein(iso[6:7] || iso[9:10], substr(number[3:] || number, 1, 4)) <= 1 AS leads FROM (SELECT o_orderkey, iso, replace(number, '-', '') AS number FROM n)""")
def d3(t: Tables) -> DataFrame:
    turned = F.concat(F.substring("number", 3, 30), F.col("number"))
    return numbers(t).select("o_orderkey", dates.month_day_leads(turned, F.col("iso")).alias("leads"))


@query("d4_date_cer", f"WITH {RENDERED} SELECT o_orderkey, levenshtein(lower({_weak_sql('written')}), iso) / greatest(length(iso), 1)::DOUBLE < 0.3::DOUBLE AS reads FROM d")
def d4(t: Tables) -> DataFrame:
    return rendered(t).select("o_orderkey", dates.date_reads_like(F.col("written"), F.col("iso")).alias("reads"))


@query("d5_normalize_date", """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%y%m%d')
  WHEN 2 THEN strftime(o_orderdate, '%y%m%d') || '-11-0470' ELSE 'none' END AS x, o_orderdate AS dt FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(dt, '%Y-%m-%d') WHEN o_orderkey % 4 = 3 THEN ''
  ELSE CASE WHEN strftime(dt, '%y')::INT > 25 THEN '19' ELSE '20' END || strftime(dt, '%y-%m-%d') END AS norm FROM d""")
def d5(t: Tables) -> DataFrame:
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    short = F.date_format(day, "yyMMdd")
    x = F.when(k == 0, F.date_format(day, "dd.MM.yyyy")).when(k == 1, short).when(k == 2, F.concat(short, F.lit("-11-0470"))).otherwise("none")
    return t.orders.select("o_orderkey", dates.normalize_date(x).alias("norm"))
