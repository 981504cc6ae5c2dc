"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence are the sorted distinct shingle hashes of a text; equal rows are one class, named by its
smallest id, before anything is joined. Columns are ordered rarest first, by the number of documents in each,
counted over all documents and told to the blocks of documents that hold them (``counting``).
If 100 |x & y| >= 85 |x | y|, the first n - ceil(0.85 n) + L columns of both rows share at least L entries, so:

* the product is formed over those prefix columns only, dealt out in blocks by column; a column with a single
  row is dropped; pairs outside the size bound are discarded before they are counted, pairs with under L
  shared entries after;
* a column first contributes its neighbours in order of size, and the pairs with its hub, the row that meets
  most others: a number of pairs linear in its rows. What the exact product of these full rows confirms is
  merged into components;
* then each column contributes the pairs of rows that are still in different components, so that no possible
  link is lost, while a group of copies never emits all of its pairs. Rows meet within bands of size.

Hot columns are split into parts (``linking``); what a hot class is given back is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import counting
from tessera.llm.common import chunks, materialize, real_ids, small_batches, whole_ids
from tessera.llm.components import components
from tessera.llm.linking import SHARED, STEPS, given_back, links

WIDTH, PERCENT = 4, 85
#: Bits by which the hashes that columns are counted under outnumber the incidences; entries in a range of columns, as
#: a share of a block's.
SPARE_BITS, COUNT_SHARE = 6, 1.0
#: Ids that are broadcast at most, 16 MB; more are joined by shuffle.
FEW_IDS = 2_000_000
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHashes(dict):
    room = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, cache: WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text: ASCII letters in lower case, words parted
    by blanks. A shorter text is one shingle; one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
    n = len(h) - width + 1
    mixed = np.full(n, ODD[4])
    for i in range(width):
        mixed = (mixed ^ h[i : i + n]) * ODD[i % 4]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def needed(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


class Rows(counting.Items):
    """The incidence rows of a block, and its columns with the number of its rows in each. Columns are counted by
    the upper ``bits`` of their hashes: what they share there is counted together, and only their order hangs on it."""

    def __init__(self, frame: pd.DataFrame, cache: WordHashes, width: int, bits: int):
        self.held = [shingle_set(t, cache, width) for t in frame["text"]]
        self.sizes = np.array([len(x) for x in self.held], np.int64)
        upper = np.concatenate(self.held) >> np.uint64(64 - bits)
        columns, self.at, counts = np.unique(upper, return_inverse=True, return_counts=True)
        super().__init__([columns], [counts])


def incidence(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, k1, k2, columns): the size of each row, a 128-bit hash of it, and its rarest columns in order,
    as (order, hash) in 64 bits."""
    held = counting.corpus(whole_ids(counting.numbered(docs.select("doc_id", "text"), "jaccard")))
    bits = min(63, max(20, held.size.bit_length() + SPARE_BITS - 2))  # a shingle for each four characters at most
    cache, ranges = WordHashes(), [held.ranges(COUNT_SHARE)]
    rows_of = lambda frame: Rows(frame, cache, width, bits)
    answers = counting.totals(held, rows_of, ranges, bits, "columns")

    def rows(frame: pd.DataFrame, block: Rows, counts: list[np.ndarray]) -> pd.DataFrame:
        rank = np.minimum(np.log2(counts[0]) * STEPS, 255).astype(np.uint64) << np.uint64(56)
        out, start = [], 0
        for columns in block.held:
            n, least = len(columns), needed(len(columns), percent)
            key = np.frombuffer(xxhash.xxh3_128_digest(columns.tobytes()), np.int64)
            order = rank[block.at[start : start + n]] | (columns >> np.uint64(8))
            order.sort()
            out.append((n, key[0], key[1], order[: n - least + min(SHARED, least)].view(np.int64)))
            start += n
        n, k1, k2, columns = zip(*out, strict=True)
        return pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "n": n, "k1": k1, "k2": k2, "columns": columns})

    return real_ids(counting.applied(held, answers, rows_of, ranges, bits, rows, "doc_id long, n long, k1 long, k2 long, columns array<long>"))


def full_rows(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, held): the incidence row of each of ``ids``, as sorted 64-bit hashes. Equal ids give one row."""
    few = ids.count() <= FEW_IDS
    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for frame in chunks(frames, "text"):
            yield pd.DataFrame({"id": frame["id"].to_numpy(), "held": [shingle_set(t, cache, width).tobytes() for t in frame["text"]]})

    return wanted.mapInPandas(rows, "id long, held binary")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose rows' exact product reaches the bound, as edges with their ``overlap``."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    rows = materialize(full_rows(docs, ids, width), "rows")

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(frame["x"], frame["y"], strict=True)]
            sizes = np.array([(len(x) + len(y)) // 8 for x, y in zip(frame["x"], frame["y"], strict=True)], np.int64)
            out = pd.DataFrame({"a": frame["a"], "b": frame["b"], "overlap": np.array(both, np.int64)})
            yield out[100 * out["overlap"] >= percent * (sizes - out["overlap"])]

    joined = pairs.select("a", "b").join(rows.select(F.col("id").alias("a"), F.col("held").alias("x")), "a")
    joined = joined.join(rows.select(F.col("id").alias("b"), F.col("held").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInPandas(product, "a long, b long, overlap long")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when 100 |x & y| >= ``percent`` |x | y|.

    Null or empty texts have size 0 and link with nothing; a null id, having no name, neither. Rows with equal
    ids and texts are one document, given for each row; of an id with several texts, the rows of that id fall
    together in the component of its smallest. Very long texts are rows like others, in whole. Ties in the order
    of columns and of hubs are broken by hash and id. An empty table gives no rows; other columns are ignored."""
    docs = small_batches(docs).select("doc_id", "text")
    rows = materialize(incidence(docs, width, percent), "incidence")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    # rows of a class are equal: any of them will do, so a class of very many is summed up where it is read
    firsts = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("columns").alias("columns"))
    firsts = materialize(firsts, "classes")
    _, merged = links(firsts, percent, lambda pairs: confirmed(pairs, docs, width, percent), components)
    named = firsts.join(merged, F.col("rep") == F.col("id"), "left").select("k1", "k2", "copies", F.coalesce("component", "rep").alias("component"))
    out = given_back(rows.select("doc_id", "n", "k1", "k2"), ["k1", "k2"], named, rows.count())
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_first(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of each component the document with its smallest id; all columns of ``docs``. Texts without words, null
    texts and null ids are linked with nothing and stay; rows that share an id are one document and stay together;
    an empty table gives no rows."""
    found = join(docs, width, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def join_sql(width: int = WIDTH, percent: int = PERCENT) -> str:
    """DuckDB SQL for (doc_id, n_shingles, component_id) of ``documents``, by all pairs that share a shingle."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
