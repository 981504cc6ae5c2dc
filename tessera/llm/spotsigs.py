"""Document fingerprints after SpotSigs, with DataFrame functions only.

A common word (anchor) right before a content word opens a chain: the anchor and the next content words, common
words between them skipped. The text's start is an anchor too. A text's signatures are the distinct chain
hashes; a text without any content word has the hash of the whole text as its only one. Fingerprints are
compared by Jaccard, after the bound that their lengths set. Near copies meet under the rarest signatures of their sets,
partitioned by length, so that only neighbouring lengths meet (``linking``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bound, materialize
from tessera.llm.components import components_by_stars
from tessera.llm.linking import SHARED, STEPS, given_back, links, size_band

# Common words of English, German, French and Spanish and the cell mark of tables, the anchors.
ANCHORS = (
    "| "
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind "
    "so um und vom von war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une "
    "al como con del el ella en entre era es esta este fue ha la las lo los más muy no o para pero por que se ser si sin su sus un una y ya"
).split()
WORD = r"[\p{L}\p{N}]+|\|"
#: Content words in a chain; rows of a group of neighbouring ids; most such groups, which bounds what is broadcast.
CHAIN, GROUP_ROWS, MOST_GROUPS = 2, 2_000, 65_536
#: Likeness of near copies in hundredths; buckets that signatures are counted in.
PERCENT, BUCKETS = 80, 1 << 16
#: Rounds of further tries: edits cost a set of few signatures much, so near copies often lie about the bound.
ROUNDS = 2


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures, 32-bit numbers, of a text that isn't null. At least one."""
    common = sorted(set(ANCHORS))

    def of(tokens: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~F.get(tokens, i).isin(common))

        def chained(at: Column) -> Column:
            return F.filter(
                F.transform(
                    at,
                    lambda i, k: F.when(
                        (i == 0) | F.get(tokens, i - 1).isin(common),
                        F.pmod(F.xxhash64(F.get(tokens, i - 1), *[F.get(tokens, F.get(at, k + j)) for j in range(chain)]), F.lit(1 << 32)),
                    ),
                ),
                lambda s: s.isNotNull(),
            )

        return bound(places, chained)

    whole = F.array(F.pmod(F.xxhash64(text), F.lit(1 << 32)))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    found = F.when(F.size(tokens) > 0, bound(tokens, of)).otherwise(F.array().cast("array<bigint>"))
    return bound(found, lambda s: F.when(F.size(s) > 0, F.sort_array(F.array_distinct(s))).otherwise(whole))


def fingerprint(signs: Column) -> Column:
    """Eight hexadecimal digits for each signature, in order."""
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 where their lengths alone keep it under ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(small < F.lit(least) * large, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def _every(values: DataFrame, rows: int) -> list[int]:
    """Every so many of the sorted numbers in a column ``v``, and the first of each sorted range."""
    nth = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return sorted({r["v"] for r in values.orderBy("v").withColumn("_nth", nth).where(F.col("_nth") % rows == 0).collect()})


def _under(x: Column, cuts: list[int]) -> Column:
    """How many of ``cuts`` are at most x, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        middle = F.shiftright(low + high, 1)
        below = F.get(table, middle) <= x
        return F.struct(F.when((low < high) & below, middle + 1).otherwise(low).alias("low"), F.when((low < high) & ~below, middle).otherwise(high).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, step, lambda acc: acc["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``signs``, ``next_text`` and ``next_signs``: those of the document with the next smaller id, the
    first again after the last. Texts are shuffled once, into groups of about equally many neighbouring ids; the
    row that another group needs goes there as well, known from a broadcast table of at most ``MOST_GROUPS`` ids
    and one for each sorted range. Null ids are grouped by text hash."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = max(GROUP_ROWS, -(-docs.count() // MOST_GROUPS))
    ids = _every(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("v")), rows)
    nameless = _every(docs.where("doc_id IS NULL").select(F.xxhash64("text").alias("v")), rows)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))
    group = F.when(F.col("doc_id").isNull(), _under(F.col("_key"), nameless)).otherwise(_under(F.col("_key"), ids) + len(nameless) + 1)
    docs = docs.withColumn("_key", key).withColumn("_group", group)
    order = Window.orderBy("_group")
    last = docs.groupBy("_group").agg(F.max("_key").alias("_last"))
    last = last.select("_group", "_last", F.coalesce(F.lead("_group").over(order), F.min("_group").over(order)).alias("_also"))
    sent = docs.join(F.broadcast(last.withColumnRenamed("_group", "_of")), (F.col("_group") == F.col("_of")) & (F.col("_key") == F.col("_last")), "left")
    ghosts = F.filter(F.array(F.struct(F.col("_group").alias("g"), F.lit(1).alias("own")), F.struct(F.col("_also").alias("g"), F.lit(0).alias("own"))), lambda x: x["g"].isNotNull())
    sent = sent.select("doc_id", "text", "_key", F.explode(ghosts).alias("_to")).select("doc_id", "text", "_key", F.col("_to.g").alias("_g"), F.col("_to.own").alias("_own"))
    signed = sent.repartition("_g").withColumn("signs", signatures(F.col("text")))
    near = Window.partitionBy("_g").orderBy("_own", "_key", F.xxhash64("text"))
    out = signed.withColumn("next_text", F.coalesce(F.lag("text").over(near), F.col("text")))
    out = out.withColumn("next_signs", F.coalesce(F.lag("signs").over(near), F.col("signs")))
    return out.where("_own = 1").drop("_g", "_own", "_key")


def set_hash(signs: Column) -> tuple[Column, Column]:
    """128 bits of a set of signatures."""
    return F.xxhash64(signs), F.xxhash64(F.lit(1), signs)


def rarest_first(signed: DataFrame, percent: int) -> Column:
    """The prefix of ``signs``, the rarest first, as columns (order, signature) in 64 bits. Signatures are counted in
    ``BUCKETS`` buckets, whose orders are broadcast; the order of a signature matters for speed alone."""
    counts = signed.select(F.explode("signs").alias("s")).groupBy(F.pmod("s", F.lit(BUCKETS)).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = signed.sparkSession.range(BUCKETS).join(counts, "id", "left")
    order = F.least(F.lit(127), F.floor(F.log2(F.coalesce("n", F.lit(1))) * STEPS)).cast("string")
    lines = every.groupBy(F.shiftright("id", 10).alias("line")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", order.alias("o")))), lambda x: x["o"]), ",").alias("orders"))
    orders = F.split(F.lit(",".join(r["orders"] for r in sorted(lines.collect(), key=lambda r: r["line"]))), ",").cast("array<bigint>")
    n = F.size("signs")
    least = F.floor((F.lit(percent) * n + 99) / 100)
    keyed = F.transform("signs", lambda s: F.shiftleft(F.get(orders, F.pmod(s, F.lit(BUCKETS)).cast("int")), 56).bitwiseOR(s))
    return F.slice(F.sort_array(keyed), F.lit(1), (n - least + F.least(F.lit(SHARED), least)).cast("int"))


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, near_class) of every row: the smallest id among the documents whose fingerprints are linked with
    that of the row, directly or through others, by a Jaccard of ``percent`` at least. Equal fingerprints are one class; sets meet
    under a rare signature, by neighbouring lengths first, then within bands of length, and no pair outside the
    bounds of its lengths is compared. Rows without an id are left out; a null text counts as empty, and equal texts are
    one class; an empty table gives no rows; other columns are ignored."""
    k1, k2 = set_hash(F.col("signs"))
    signed = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs")).withColumn("k1", k1).withColumn("k2", k2)
    signed = materialize(signed, "signatures")
    named = signed.where("doc_id IS NOT NULL")
    classes = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("signs").alias("signs"))
    classes = materialize(classes, "sets")
    firsts = materialize(classes.select("k1", "k2", "copies", "rep", F.size("signs").alias("n"), rarest_first(classes, percent).alias("columns")), "prefixes")
    sets = classes.select("rep", "signs")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("signs").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("signs").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")

    _, merged = links(firsts, percent, confirmed, components_by_stars, ROUNDS)
    classes = firsts.join(merged, F.col("rep") == F.col("id"), "left").select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component"))
    out = given_back(named.select("doc_id", "k1", "k2"), ["k1", "k2"], classes, named.count())
    return out.select("doc_id", F.col("component").alias("near_class"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to that and to the next document.

    A null text counts as empty; the only document is its own next; rows with equal ids follow each other by
    text hash; a null id is the smallest; a very long text has a very long fingerprint; an empty table gives no rows;
    other columns, whatever their names, are ignored."""
    docs = docs.select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - _half)"), F.expr("substring(next_text, 1, _half)"))
    out = with_next(docs).withColumn("_half", half).withColumn("_edited", edited).withColumn("_edited_signs", signatures(F.col("_edited")))
    return out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("_edited", "utf-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("signs")).alias("fingerprint"), fingerprint(F.col("_edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("_edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of near fingerprints, and membership: returns all pairs between classes of equal fingerprints,
    named by their smallest doc_id, with the classes' sizes ``n_a`` and ``n_b``. Sets meet in partitions of
    neighbouring lengths, under a signature of their prefix, the rarest first; every set in a pair is then compared
    in full. Where pairs are too many to be listed, ``near_classes`` gives their components. Null
    texts count as empty, and empty texts are one class; classes whose ids are all null are left out; an empty
    table gives no pairs."""
    signed = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("signs"))
    classes = signed.groupBy("signs").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    n = F.size("signs")
    band = size_band(n, round(threshold * 100))
    prefix = rarest_first(classes, round(threshold * 100))
    keyed = classes.withColumn("_n", n).withColumn("_key", F.explode(prefix)).withColumn("_band", F.explode(F.array(band, band + 1)))
    keyed = keyed.select("doc_id", "_n", "_key", "_band")
    left, right = keyed.alias("l"), keyed.alias("r")
    on = (F.col("l._key") == F.col("r._key")) & (F.col("l._band") == F.col("r._band")) & (F.col("l.doc_id") < F.col("r.doc_id"))
    fits = F.least("l._n", "r._n") >= F.lit(threshold) * F.greatest("l._n", "r._n")
    pairs = left.join(right, on & fits).select(F.col("l.doc_id").alias("a"), F.col("r.doc_id").alias("b")).distinct()
    a = classes.select(F.col("doc_id").alias("a"), F.col("signs").alias("sa"), F.col("n").alias("n_a"))
    b = classes.select(F.col("doc_id").alias("b"), F.col("signs").alias("sb"), F.col("n").alias("n_b"))
    out = pairs.join(a, "a").join(b, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"), threshold))
    return out.where(F.col("likeness") >= threshold).select("a", "b", "likeness", "n_a", "n_b")
