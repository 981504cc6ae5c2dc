"""Exact totals of hashed items over a corpus, told to each block of documents for its own items only.

Totals grow with the corpus, so they are neither broadcast nor collected. A scan forms blocks of documents, bounded
by their bytes. Each block lists its distinct items with its own counts, sorted by hash and cut into ranges of
hashes; a range is added up over all blocks, and answers each block with the totals that differ from its own
counts. Documents and answers are then dealt out by stretches of a file and sorted so that a block's answers come
right before its documents, which are read as a stream. An item that is everywhere is one entry a block.

Blocks and ranges hold ``BLOCK_BYTES`` up to ``LINEAR_BYTES`` of text and grow with the square root of the corpus
beyond, so that the number of (block, range) rows stays in proportion to the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, steady

#: Characters of a block, but for one longer text; the corpus beyond which blocks grow; rows of a file dealt out as one.
BLOCK_BYTES, LINEAR_BYTES, STRETCH_ROWS = 4_000_000, 8_000_000_000, 2_000
#: Names of a row's place: its file, and its number there.
FILE, NTH = "__tessera_file", "__tessera_nth"
#: Sorts documents behind the answers of all kinds; marks the sums of a range.
TEXT, SUMS = 127, -1


def to_blob(numbers: np.ndarray) -> bytes:
    """Rising numbers by their differences, byte planes apart."""
    return plain_blob(np.diff(numbers.astype(np.uint64), prepend=np.uint64(0)))


def of_blob(blob: bytes) -> np.ndarray:
    return np.cumsum(of_plain(blob), dtype=np.uint64)


def plain_blob(numbers: np.ndarray) -> bytes:
    return zstandard.compress(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def of_plain(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with ``FILE`` and ``NTH``, which come from the files and so are the same in every scan, however
    it is dealt out. Rows that don't come straight from files are written first."""
    docs = steady(docs, name)
    place = docs.metadataColumn("_metadata")
    return docs.withColumns({FILE: F.xxhash64(place["file_path"]), NTH: place["row_index"]})


@dataclass(frozen=True)
class Corpus:
    """Documents with their places, a column ``text`` among them, and their number and bytes."""

    docs: DataFrame
    rows: int
    size: int

    @property
    def growth(self) -> float:
        return max(1.0, (self.size / LINEAR_BYTES) ** 0.5)

    @property
    def block(self) -> int:
        """Characters of a block."""
        return int(BLOCK_BYTES * self.growth)

    @property
    def stretch(self) -> int:
        """Rows of a file that are dealt out as one; no block goes beyond them."""
        return int(STRETCH_ROWS * self.growth)

    def ranges(self, share: float = 1.0) -> int:
        """Ranges of hashes, so that a range holds about ``share`` times as many entries as a block."""
        return max(1, round(self.size / self.block / share))


def corpus(placed: DataFrame) -> Corpus:
    """Numbered documents, which have a column ``text``, measured."""
    sums = placed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text").cast("bigint")).alias("size")).first()
    return Corpus(placed, sums["rows"], sums["size"] or 0)


class Items:
    """The distinct items of a block, for each kind: sorted hashes, and how often the block itself holds them."""

    def __init__(self, keys: list[np.ndarray], own: list[np.ndarray]):
        self.keys, self.own = keys, own

    def mark(self) -> int:
        """Tells whether a block has been put together again as it was."""
        return int(sum(int(np.bitwise_xor.reduce(k)) >> 2 for k in self.keys if len(k)) % (1 << 62)) + sum(len(k) for k in self.keys)


def edges_of(ranges: int, bits: int) -> np.ndarray:
    """First hash of each range but the first."""
    return np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)


LISTS = "kind int, part int, file long, nth long, mark long, keys binary, counts binary"
ANSWERS = "kind int, part int, file long, nth long, mark long, at binary, total binary, items long, occurrences long"


def totals(docs: Corpus, items_of: Callable[[pd.DataFrame], Items], ranges: list[int], bits: int, name: str) -> DataFrame:
    """Answers to all blocks, written once, and a row with ``nth`` of ``SUMS`` for each range: its number of items and of
    their occurrences. ``ranges``: how many for each kind; hashes have ``bits`` bits."""
    limit, stretch_rows = docs.block, docs.stretch
    cuts_at = [edges_of(r, bits) for r in ranges]

    def emit(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held) if len(held) > 1 else held[0]
        items = items_of(rows)
        file, nth, mark = int(rows[FILE].iloc[0]), int(rows[NTH].iloc[0]), items.mark()
        out = []
        for kind, (keys, counts) in enumerate(zip(items.keys, items.own, strict=True)):
            cuts = [0, *np.searchsorted(keys, cuts_at[kind]).tolist(), len(keys)]
            out += [(kind, part, file, nth, mark, to_blob(keys[a:b]), plain_blob(counts[a:b])) for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        if not out:
            out = [(0, 0, file, nth, mark, to_blob(np.zeros(0, np.uint64)), plain_blob(np.zeros(0, np.uint64)))]
        return pd.DataFrame(out, columns=["kind", "part", "file", "nth", "mark", "keys", "counts"])

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, last = [], 0, (None, -1)
        for frame in frames:
            first = 0
            for i, (text, file, nth) in enumerate(zip(frame["text"], frame[FILE].tolist(), frame[NTH].tolist(), strict=True)):
                # a task may read parts of a file in any order
                if size >= limit or (file, nth) != last or nth % stretch_rows == 0:
                    if i > first:
                        held.append(frame.iloc[first:i])
                    if held:
                        yield emit(held)
                    held, size, first = [], 0, i
                last = (file, nth + 1)
                size += len(text) if text else 0
            if first < len(frame):
                held.append(frame.iloc[first:])
        if held:
            yield emit(held)
        release()

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [of_blob(x) for x in frame["keys"]]
        own = np.concatenate([of_plain(x) for x in frame["counts"]]).astype(np.int64)
        sizes = np.array([len(x) for x in keys])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(which, weights=own, minlength=len(distinct)).astype(np.int64)
        kind, part = int(frame["kind"].iloc[0]), int(frame["part"].iloc[0])
        answers = [(kind, part, 0, SUMS, 0, b"", b"", int((summed > 0).sum()), int(summed.sum()))]
        total, ends = summed[which], np.cumsum(sizes)
        for file, nth, mark, a, b in zip(frame["file"].tolist(), frame["nth"].tolist(), frame["mark"].tolist(), ends - sizes, ends, strict=True):
            other = np.flatnonzero(total[a:b] != own[a:b])
            answers.append((kind, part, file, nth, mark, to_blob(other), plain_blob(total[a:b][other]), 0, 0))
        del keys, own, distinct, which, summed, total, frame
        release()
        return pd.DataFrame(answers, columns=["kind", "part", "file", "nth", "mark", "at", "total", "items", "occurrences"])

    lists = docs.docs.mapInPandas(listed, LISTS)
    return materialize(lists.groupBy("kind", "part").applyInPandas(added, ANSWERS), name)


def applied(docs: Corpus, answers: DataFrame, items_of: Callable[[pd.DataFrame], Items], ranges: list[int], bits: int, body: Callable[[pd.DataFrame, Items, list[np.ndarray]], pd.DataFrame], schema: str) -> DataFrame:
    """What ``body`` makes of each block: its rows, its items and their totals over the corpus."""
    cuts_at = [edges_of(r, bits) for r in ranges]

    def block(told: list[pd.DataFrame], texts: list[pd.DataFrame]) -> pd.DataFrame:
        rows, answered = pd.concat(texts), pd.concat(told)
        items = items_of(rows)
        if (answered["_mark"] != items.mark()).any():
            raise RuntimeError("a block of documents is not what it was when its items were listed")
        counts = [x.copy() for x in items.own]
        cuts = [np.array([0, *np.searchsorted(keys, at)]) for keys, at in zip(items.keys, cuts_at, strict=True)]
        for kind, part, at, value in zip(answered["_kind"], answered["_part"], answered["_at"], answered["_total"], strict=True):
            counts[kind][cuts[kind][part] + of_blob(at).astype(np.int64)] = of_plain(value).astype(counts[kind].dtype)
        return body(rows, items, counts)

    def streamed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told, texts = [], []
        for frame in frames:
            is_told = frame["_kind"].to_numpy() != TEXT
            cuts = [0, *(np.flatnonzero(np.diff(is_told)) + 1).tolist(), len(frame)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if is_told[a] and texts:
                    yield block(told, texts)
                    told, texts = [], []
                (told if is_told[a] else texts).append(frame.iloc[a:b])
        if texts:
            yield block(told, texts)
        release()

    # no nulls in columns of numbers, which pandas would turn into fractions
    plain = {"bigint": F.lit(0).cast("bigint"), "boolean": F.lit(False)}
    own = [c for c in docs.docs.columns if c not in (FILE, NTH)]
    texts = docs.docs.select(
        FILE, NTH, F.lit(TEXT).alias("_kind"), F.lit(0).alias("_part"), F.lit(0).cast("bigint").alias("_mark"),
        F.lit(None).cast("binary").alias("_at"), F.lit(None).cast("binary").alias("_total"), *own,
    )
    told = answers.where(F.col("nth") != SUMS).select(
        F.col("file").alias(FILE), F.col("nth").alias(NTH), F.col("kind").alias("_kind"), F.col("part").alias("_part"), F.col("mark").alias("_mark"),
        F.col("at").alias("_at"), F.col("total").alias("_total"), *[plain.get(t, F.lit(None).cast(t)).alias(c) for c, t in docs.docs.select(*own).dtypes],
    )
    dealt = texts.unionByName(told).repartition(F.col(FILE), F.floor(F.col(NTH) / docs.stretch))
    return dealt.sortWithinPartitions(FILE, NTH, "_kind").mapInPandas(streamed, schema)
