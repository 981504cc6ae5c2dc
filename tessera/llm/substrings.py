"""Exact substring dedup: every byte covered by a string of ``LEAST`` bytes that also starts earlier.

1. Anchors. Of the 40-byte strings in each 100-byte window, that with the smallest hash is an anchor, so equal
   windows hold equal anchors at equal places. An anchor's context is what a window around it can reach: 60
   bytes on each side. Occurrences are gathered by anchor hash, each with a hash of its context under another base:
   copies agree in 128 bits.
2. Copies of a context are settled there: all but the first are covered from end to end. Only the first of each
   context goes on, and only if its anchor has several contexts, so a passage copied everywhere costs its edges.
   Contexts of an anchor are trimmed to what they share with any other, dropped if that is too short, and settled
   once more, so what differs everywhere, as around a common line, goes no further.
3. Run-length index. The contexts of a range of anchors, concatenated with separators of their own, are indexed by
   a run-compressed Burrows-Wheeler transform with the suffix sampled at each run's first row, together with its
   neighbour above and the length they share. Between samples, the neighbour moves along with the text and the
   shared length falls by one: streaming the text through the samples gives the matching statistics (length and
   place of a match) of every position. Positions whose match is long enough are chained, and all of a chain but
   its earliest are marked.
4. Marks meet their documents, spans are merged and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NO_ID, chunks, materialize, real_ids, release, small_batches, whole_ids
from tessera.llm.counting import LINEAR_BYTES

LEAST, GRAM = 100, 40
SIDE, WINDOW = LEAST - GRAM, LEAST - GRAM + 1
#: Rows of documents for each range of anchor hashes; contexts for each index; bytes gathered before entries go out.
RANGE_ROWS, INDEX_CONTEXTS, GATHER = 3000, 2000, 4_000_000
#: Ids that are broadcast at most, 16 MB; more are joined by shuffle.
FEW_IDS = 2_000_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class Roller:
    """Hashes of a byte string's substrings, by prefix sums of byte values times powers of an odd base."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.values = np.random.default_rng(seed).integers(0, 1 << 64, 512, np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (self.base, self.inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.down[start]
        h ^= h >> np.uint64(31)
        h *= MIX
        return h ^ (h >> np.uint64(29))


def rollers() -> tuple[Roller, Roller]:
    return Roller(BASES[0], 5), Roller(BASES[1], 6)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours."""
    pick, fill = (np.minimum, ~np.uint64(0)) if least else (np.maximum, np.uint64(0))
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, pair: tuple[Roller, Roller]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, hash of the context) of the anchors of a text of at least ``LEAST`` bytes."""
    first, second = pair
    sums = first.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    h = first.between(sums, at, at + GRAM)
    lows = np.zeros(len(h) + WINDOW - 1, np.uint64)
    lows[WINDOW - 1 : len(h)] = _sliding(h, WINDOW, True)
    place = np.flatnonzero(_sliding(lows, WINDOW, False) == h)
    start, end = np.maximum(place - SIDE, 0), np.minimum(place + GRAM + SIDE, len(data))
    around = second.between(second.sums(data), start, end)
    around ^= ((place - start) * 1024 + (end - start)).astype(np.uint64) * MIX
    # least hashes crowd at the low end: spread them again, one to one, so that ranges of them are even
    spread = h[place] * np.uint64(BASES[1])
    spread ^= spread >> np.uint64(32)
    return place, spread * MIX, around


def _planes(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _copy_spans(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) that copied contexts cover. Copies in a row, as in a text that repeats itself, are one
    span. An end may lie beyond the text's, where the text is cut."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > GRAM + 2 * SIDE)
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(doc))[: len(at)] - 1
    return doc[at], np.maximum(place[at] - SIDE, 0), place[last] + GRAM + SIDE


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; ``symbols`` must make all suffixes differ."""
    key = symbols.astype(np.int64)
    step, n = 1, len(key)
    width = int(key.max()) + 2
    key *= width
    key[: n - 1] += symbols[1:] + 1
    while True:
        step *= 2
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.zeros(n, np.int32)
        np.cumsum(key[1:] != key[:-1], out=new[1:], dtype=np.int32)
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int32)
        rank[order] = new
        key = rank.astype(np.int64) * (n + 1)
        key[: n - step] += rank[step:] + 1


class RunIndex:
    """Run-length index of separated contexts: one sample for each run of the Burrows-Wheeler transform."""

    def __init__(self, contexts: list[bytes], longest: int):
        self.starts = np.cumsum([0, *(len(c) + 1 for c in contexts)])
        text = np.zeros(int(self.starts[-1]), np.int32)
        for i, c in enumerate(contexts):
            a = self.starts[i]
            text[a : a + len(c)] = np.frombuffer(c, np.uint8).astype(np.int32) + len(contexts)
            text[a + len(c)] = i
        order = suffix_array(text)
        transform = text[order - 1]
        heads = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1]]))
        self.runs, self.size = len(heads), len(text)
        heads = heads[heads > 0]
        places, above = order[heads], order[heads - 1]
        by_place = np.argsort(places)
        #: Sampled places in the text, their neighbours above, and the lengths that they share.
        self.place, self.above = places[by_place], above[by_place]
        self.shared = self._common(text, self.place, self.above, longest)

    @staticmethod
    def _common(text: np.ndarray, x: np.ndarray, y: np.ndarray, longest: int) -> np.ndarray:
        """Length that suffixes share, ``longest`` at most: one symbol at a time, for those still equal."""
        out, open_ = np.zeros(len(x), np.int32), np.arange(len(x))
        for length in range(longest):
            a, b = x[open_] + length, y[open_] + length
            inside = (a < len(text)) & (b < len(text))
            open_ = open_[inside][text[a[inside]] == text[b[inside]]]
            out[open_] = length + 1
            if not len(open_):
                break
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, place) of a match of each position of the text, streamed from the samples."""
        position = np.arange(self.size, dtype=np.int32)
        sample = (np.searchsorted(self.place, position, side="right") - 1).astype(np.int32)
        behind = position - self.place[sample]
        length = np.where(sample >= 0, np.maximum(self.shared[sample] - behind, 0), 0).astype(np.int32)
        return length, np.where(length > 0, self.above[sample] + behind, position)


def long_matches(doc: np.ndarray, start: np.ndarray, contexts: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(doc, from, to) of what ``least``-byte strings that start earlier cover in contexts at given places."""
    index = RunIndex(contexts, max(map(len, contexts)) + 1)
    length, above = index.statistics()
    lead = np.where(length >= least, above, np.arange(index.size, dtype=np.int32))
    del length, above
    while not np.array_equal(further := lead[lead], lead):
        lead = further
    ids, nth = np.unique(doc, return_inverse=True)
    which = np.repeat(np.arange(len(contexts), dtype=np.int32), np.diff(index.starts))
    place = start[which] + np.arange(index.size) - index.starts[:-1][which]
    key = (nth[which].astype(np.int64) << 40) | place
    earliest = np.full(index.size, np.iinfo(np.int64).max)
    np.minimum.at(earliest, lead, key)
    late = key > earliest[lead]
    edge = np.diff(np.concatenate([[0], late.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    # a run of late positions stays within a context: its last positions are too short to match
    return [(int(ids[nth[which[a]]]), int(place[a]), int(place[b]) + least) for a, b in zip(first, last, strict=True)]


def _spans_frame(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"hash": np.full(len(doc), -1), "doc": doc, "start": start, "end": end})


def marks(docs: DataFrame) -> DataFrame:
    """(doc, start, end): spans to remove, which may overlap, from rows (doc, text)."""
    sums = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("bigint")).alias("size")).first()
    # both sides of the table of batches by ranges grow with the root of the corpus, so its rows stay in proportion
    growth = max(1.0, ((sums["size"] or 0) / LINEAR_BYTES) ** 0.5)
    ranges, gather = max(1, round(sums["rows"] / RANGE_ROWS / growth)), GATHER * growth
    cuts_at = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, held, size = rollers(), [], 0

        def emit() -> pd.DataFrame:
            doc, place, h, around = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((place, doc, around, h))
            doc, place, h, around = doc[order], place[order], h[order], around[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
            settled_here = _copy_spans(doc[~new], place[~new])
            doc, place, h, around = doc[new], place[new], h[new], around[new]
            edges = [0, *np.searchsorted(h, cuts_at).tolist(), len(h)]
            rows = [(int(settled_here[0][0] % ranges), b"", b"", *(_planes(x.view(np.uint64)) for x in settled_here))] if len(settled_here[0]) else []
            for part, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                if b > a:
                    ids, nth = np.unique(doc[a:b], return_inverse=True)
                    steps = np.diff(h[a:b], prepend=np.uint64(0))
                    rows.append((part, _planes(steps), _planes(around[a:b]), _planes(ids.view(np.uint64)), _planes(nth), _planes(place[a:b])))
            return pd.DataFrame(rows, columns=["part", "hash", "around", "ids", "nth", "place"])

        for frame in chunks(frames, "text"):
            for doc, text in zip(frame["doc"], frame["text"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else ()
                if len(data) >= LEAST:
                    place, h, around = anchors(data, pair)
                    held.append((np.full(len(place), doc, np.int64), place, h, around))
                    size += len(data)
            if size > gather:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    def gathered(frame: pd.DataFrame) -> pd.DataFrame:
        done = frame["hash"].str.len() == 0
        out = [_spans_frame(*(_numbers(x).view(np.int64) for x in row)) for row in frame.loc[done, ["ids", "nth", "place"]].itertuples(index=False)]
        frame = frame[~done]
        if not len(frame):
            return pd.concat(out)
        h = np.concatenate([np.cumsum(_numbers(x), dtype=np.uint64) for x in frame["hash"]])
        around = np.concatenate([_numbers(x) for x in frame["around"]])
        doc = np.concatenate([_numbers(i).view(np.int64)[_numbers(n).astype(np.int64)] for i, n in zip(frame["ids"], frame["nth"], strict=True)])
        place = np.concatenate([_numbers(x) for x in frame["place"]]).astype(np.int64)
        order = np.lexsort((place, doc, around, h))
        h, around, doc, place = h[order], around[order], doc[order], place[order]
        new_hash = np.concatenate([[True], h[1:] != h[:-1]])
        new = new_hash | np.concatenate([[True], around[1:] != around[:-1]])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (doc != doc[first]) | (place != place[first])
        group = np.cumsum(new_hash) - 1
        several = np.bincount(group, weights=new)[group] > 1
        firsts = pd.DataFrame({"hash": (h[new & several] >> np.uint64(1)).astype(np.int64), "doc": doc[new & several], "start": place[new & several], "end": -1})
        out += [firsts, _spans_frame(*_copy_spans(doc[later], place[later]))]
        del h, around, doc, place, order, first, group, frame
        release()
        return pd.concat(out)

    parts = docs.mapInPandas(found, "part int, hash binary, around binary, ids binary, nth binary, place binary")
    seen = materialize(parts.groupBy("part").applyInPandas(gathered, "hash long, doc long, start long, end long"), "anchors")
    copies = seen.where("end >= 0").select("doc", "start", "end")

    wants = seen.where("end < 0").groupBy("doc").agg(F.collect_list(F.struct(F.col("start").alias("place"), "hash")).alias("wants"))
    n_contexts, n_ids = seen.where("end < 0").count(), wants.count()
    buckets = max(1, -(-n_contexts // INDEX_CONTEXTS))
    if n_ids <= FEW_IDS:
        docs = docs.join(F.broadcast(wants.select("doc")), "doc", "left_semi")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, wanted in zip(frame["doc"], frame["text"], frame["wants"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    start = max(w["place"] - SIDE, 0)
                    rows.append((w["hash"] * buckets >> 63, w["hash"], doc, start, w["place"] - start, data[start : w["place"] + GRAM + SIDE]))
            yield pd.DataFrame(rows, columns=["bucket", "hash", "doc", "start", "left", "context"])

    def indexed(frame: pd.DataFrame) -> pd.DataFrame:
        rows, frame = settled(frame.drop_duplicates(["hash", "doc", "start", "left"]))
        frame = frame.sort_values(["hash", "doc", "start"], kind="stable")
        # anchors apart: an index takes whole anchors, as many as make up its size
        ends = np.flatnonzero(np.diff(frame["hash"].to_numpy(), append=np.int64(-1))) + 1
        first = 0
        for end in ends.tolist():
            if end - first >= INDEX_CONTEXTS or end == len(frame):
                part = frame.iloc[first:end]
                rows += long_matches(part["doc"].to_numpy(), part["start"].to_numpy(), list(part["context"]))
                first = end
        del frame
        release()
        return pd.DataFrame(rows, columns=["doc", "start", "end"], dtype="int64")

    contexts = docs.join(wants, "doc").mapInPandas(cut, "bucket long, hash long, doc long, start long, left long, context binary")
    return copies.union(contexts.groupBy("bucket").applyInPandas(indexed, "doc long, start long, end long"))


def _shared_side(group: np.ndarray, sides: list[bytes]) -> np.ndarray:
    """The longest start that each string shares with another of its group."""
    sizes = np.array([len(x) for x in sides], np.int64)
    padded = np.array(sides, f"S{SIDE}")
    order = np.lexsort((padded, group))
    table = padded[order].view(np.uint8).reshape(-1, SIDE)
    same = np.minimum.accumulate(table[1:] == table[:-1], axis=1).sum(axis=1)
    same = np.where(group[order][1:] == group[order][:-1], same, 0)
    # null bytes at a string's end look like padding: never count beyond the longer string, which only keeps more
    shared = np.zeros(len(sides), np.int64)
    shared[order[1:]] = same
    shared[order[:-1]] = np.maximum(shared[order[:-1]], same)
    return np.minimum(shared, sizes)


def settled(frame: pd.DataFrame) -> tuple[list[tuple[int, int, int]], pd.DataFrame]:
    """Spans of trimmed contexts that equal an earlier one of the same anchor, and the contexts that are left."""
    group, left, contexts = frame["hash"].to_numpy(), frame["left"].to_numpy(), list(frame["context"])
    before = _shared_side(group, [c[:n][::-1] for c, n in zip(contexts, left, strict=True)])
    behind = _shared_side(group, [c[n + GRAM :] for c, n in zip(contexts, left, strict=True)])
    long = before + GRAM + behind >= LEAST
    frame = frame.assign(start=frame["start"] + left - before, left=before, context=[c[n - a : n + GRAM + b] for c, n, a, b in zip(contexts, left, before, behind, strict=True)])
    frame = frame[long].sort_values(["doc", "start"], kind="stable")
    again = frame.duplicated(["hash", "left", "context"])
    spans = frame[again]
    ends = spans["start"] + spans["context"].str.len() if len(spans) else spans["start"]
    return list(zip(spans["doc"].tolist(), spans["start"].tolist(), ends.tolist(), strict=True)), frame[~again]


#: Names that no column of the input should have.
KEY, SPANS = "__tessera_doc", "__tessera_spans"


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.coalesce("doc_id", F.lit(NO_ID)))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``SPANS`` of spans to remove, as start * 2**31 + end, null if there are none. Texts without spans are
    not shuffled, if the ids of the others are few enough to broadcast."""
    small_batches(docs)
    named = _named(docs)
    found = marks(named.select(F.col(KEY).alias("doc"), "text"))
    spans = found.groupBy(F.col("doc").alias(KEY)).agg(F.collect_list(F.col("start") * F.lit(1 << 31) + F.col("end")).alias(SPANS))
    spans = materialize(spans, "spans")
    if spans.count() > FEW_IDS:
        return named.join(spans, KEY, "left").drop(KEY)
    ids = F.broadcast(spans.select(KEY))
    cut = named.join(ids, KEY, "left_semi").join(spans, KEY)
    whole = named.join(ids, KEY, "left_anti").withColumn(SPANS, F.lit(None).cast(spans.schema[SPANS].dataType))
    return cut.select(*[F.col(f"`{c}`") for c in whole.columns]).union(whole).drop(KEY)


def kept_bytes(text: str | None, spans) -> tuple[int, int, int, bytes]:  # noqa: ANN001
    """(bytes, bytes removed, maximal runs removed, what is left)."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if spans is None or not len(spans):
        return len(data), 0, 0, data
    held = np.sort(np.asarray(spans, np.int64))
    starts, ends = held >> 31, np.minimum(np.maximum.accumulate(held & ((1 << 31) - 1)), len(data))
    opens = np.concatenate([[True], starts[1:] > ends[:-1]])
    merged = list(zip(starts[opens].tolist(), ends[np.append(np.flatnonzero(opens)[1:], len(ends)) - 1].tolist(), strict=True))
    left, at = [], 0
    for a, b in merged:
        left.append(data[at:a])
        at = b
    left.append(data[at:])
    kept = b"".join(left)
    return len(data), len(data) - len(kept), len(merged), kept


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A null text counts as empty and a null id as the smallest; texts under ``LEAST`` bytes lose nothing; rows with
    one id are one document and must have one text; very long texts are cut in whole, and of equal strings the one of the
    smallest id and place stays; an empty table gives no rows; other columns are ignored."""

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [kept_bytes(t, s) for t, s in zip(frame["text"], frame[SPANS], strict=True)]
            n, gone, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": n, "n_removed": gone, "n_spans": spans, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    spanned = with_spans(docs.select("doc_id", "text")).select("doc_id", "text", SPANS)
    return real_ids(whole_ids(spanned).mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def dedup(docs: DataFrame, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with the repeated strings cut from ``text`` (a character that loses a byte goes too) and
    ``n_chars``, if there is such a column, counted anew. Rows stay, even if nothing of their text does, unless not
    ``keep_emptied``: then rows go that lost bytes and are left without any word."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else kept_bytes(t, s)[3].decode("utf-8", "ignore") for t, s in zip(text, spans, strict=True)], dtype=object)

    out = with_spans(docs)
    left = F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(cut(F.col("text"), F.col(SPANS)))
    if not keep_emptied:
        out = out.where(left.eqNullSafe(F.col("text")) | left.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("text", left)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest_sql(least: int = LEAST) -> str:
    """DuckDB SQL for the rows of ``digests`` on ``documents``, by all windows; for small tables."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * least})) AS x FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {least - 1})) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
i AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > {least}, true)::INT AS opens FROM r)),
s AS (SELECT doc_id, min(p) AS a, max(p) + {least} AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
