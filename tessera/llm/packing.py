"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Bulk-synchronous: documents are sorted by length and open sequences by gap. A superstep takes the longest
length that still has documents and sweeps the gaps upwards from its successor, the smallest gap that holds it;
documents of that length and sequences of that gap are matched by rank, so that no two want the same place;
the gaps shrink, and the next superstep starts. Lengths and gaps are whole numbers up to the capacity, so the
supersteps work on runs of ranks over a table of at most ``capacity`` lengths, whatever the number of
documents; ranks are given to the documents, and runs joined to them, in distributed steps.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, materialize, real_ids, salted_rank, small_batches, whole_ids

CAPACITY, END = 2048, 0
#: Groups that the documents of one length are ranked in.
SALTS = 64
# Fixed value: the pattern by which byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The blanks of that pattern, and the longest run of them left to it: its library gives up at 10^6.
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
LONGEST_RUN = 500_000


@lru_cache(maxsize=2)
def encoder(path: str, special: bool = False):  # noqa: ANN201
    """Text to ids under the byte-level BPE file at ``path``, the same ids as the tokenizers library gives without
    adding special tokens. ``special``: the strings of the file's added tokens become their ids, as the library has it
    by default; else they are text like any other, as it has it with ``encode_special_tokens`` on, which is how the
    file's description uses it: a crawled text can't end a document. The file's vocabulary lists merges in order of
    rank, which is all that the faster library needs. Very long runs of blanks are cut out as the pattern would: before
    their last blank, or at the end of the text, and merged as one piece."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    vocabulary, added = held["model"]["vocab"], {t["content"]: t["id"] for t in held["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(stands[c] for c in word): i for word, i in vocabulary.items() if word not in added}
    bpe = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) <= LONGEST_RUN:
            return bpe.encode_ordinary(text)
        ids, at = [], 0
        for run in BLANKS.finditer(text):
            if run.end() - run.start() > LONGEST_RUN:
                end = run.end() - (run.end() < len(text))
                ids += bpe.encode_ordinary(text[at : run.start()])
                ids += bpe._encode_single_piece(text[run.start() : end])
                at = end
        return ids + bpe.encode_ordinary(text[at:])

    marks = re.compile("|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))

    def encode_marked(text: str) -> list[int]:
        ids, at = [], 0
        for mark in marks.finditer(text):
            ids += [*encode(text[at : mark.start()]), added[mark.group()]]
            at = mark.end()
        return ids + encode(text[at:])

    return encode_marked if special and added else encode


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row. A document is its ids and the end id; a
    longer one is cut into pieces of the capacity, the first of which may be shorter. A null text counts as
    empty, one id; each of equal rows is cut; other columns are ignored."""
    path = path or default_path()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, special)
        for part in chunks(frames, "text"):
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                ids = np.array([*(encode(text) if text else ()), END], "<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[start : first if not start else start + capacity]
                    rows.append((doc_id, piece, start, len(own), crc32(own.tobytes()), *([own.astype("int32")] if with_ids else [])))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": part["doc_id"].dtype})

    kept = ", ids array<int>" if with_ids else ""
    rows = whole_ids(small_batches(docs).select("doc_id", "text"))
    return real_ids(rows.mapInPandas(cut, f"doc_id long, piece int, start long, length long, ids_crc32 long{kept}"))


@dataclass(frozen=True)
class Run:
    """Documents of ``length`` ranked ``low`` to ``high - 1``: each ``per`` of them, in order, fill a sequence from
    ``offset`` on, beginning with sequence ``first``."""

    length: int
    low: int
    high: int
    per: int
    first: int
    offset: int


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs that place all documents, given the number of each length."""
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), sorted
    runs: list[Run] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                more = -(-left // (capacity // length))
                insort(gaps, (capacity, opened, more))
                opened += more
                continue
            gap, first, number = gaps.pop(at)
            per = min(gap // length, left)
            filled = min(number, left // per)
            if filled < number:
                insort(gaps, (gap, first + filled, number - filled))
            if gap > per * length:
                insort(gaps, (gap - per * length, first, filled))
            runs.append(Run(length, rank, rank + filled * per, per, first, capacity - gap))
            rank, left = rank + filled * per, left - filled * per
    return runs


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset. Null and empty texts are the end id alone; very long texts
    are cut into pieces; equal rows and null ids are packed each; pieces of one length are interchangeable and ranked by id,
    piece and crc32; an empty table gives no rows; other columns, whatever their names, are ignored. ``special``: see
    ``encoder``."""
    cut = materialize(pieces(docs, path, capacity, with_ids, special), "pieces")
    counts = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = [(r.length, r.low, r.high, r.per, r.first, r.offset) for r in supersteps(counts, capacity)]
    table = docs.sparkSession.createDataFrame(runs, "_length long, _low long, _high long, _per long, _first long, _offset long")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS))
    ranked = salted_rank(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], salt, "_rank")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    nth = F.col("_rank") - F.col("_low")
    placed = ranked.join(F.broadcast(table), on).withColumns({
        "sequence_id": F.expr("_first + (_rank - _low) div _per"),
        "offset": F.col("_offset") + nth % F.col("_per") * F.col("length"),
    })
    return placed.select(*cut.columns, "sequence_id", "offset")
