"""Language-model scoring by a weighted backoff automaton.

The model is a trigram model over words and an end. With c(h) the count of a history h, p(w|h) is
(1 - l) c(h, w) / c(h) + l p(w|h less its first word), down to add-one unigrams; l falls with c(h) and is 1 for a
history that was never seen. As an automaton: the known histories of two words, of one and of none are states; a
counted n-gram is an arc with its log p, which leads to the longest known history; every state has a failure arc
with log l to the history less its first word; the root has an arc for every word. A text is walked once, from the
start state: where the state has no arc for the next word, failure arcs are followed until there is one.

Counts grow with the corpus, so they are neither broadcast nor collected: each block of documents lists its n-grams
and is told their totals (``counting``). It then holds the part of the automaton that its documents can reach, which
scores them exactly. Its texts are walked side by side, long ones in stretches that begin a history early.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import counting
from tessera.llm.common import real_ids, small_batches, whole_ids

#: Entries of words, bigrams and trigrams in a range of hashes, as a share of a block's.
SHARES = (4.0, 1.0, 1.0)
#: For histories of one word and of two: the failure weight after one occurrence, how much it falls with each doubling of that count, and its least value.
FAILURE = ((0.72, 0.03, 0.1), (0.75, 0.05, 0.3))
#: Tokens of a text that are walked in one go; a state remembers two.
WALK, MEMORY = 512, 2
# A blank can't be in a word.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(b)) for b in (b" start", b" end"))
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


class WordHashes(dict):
    room = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def failure_weight(count: np.ndarray, words: int) -> np.ndarray:
    """Weight of the failure arc of a history of so many words that was seen ``count`` times."""
    first, fall, least = FAILURE[words - 1]
    return np.where(count > 0, np.clip(first - fall * np.log2(np.maximum(count, 1)), least, 1.0), 1.0)


def tokens_of(texts: list[str | None], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text included, and the number of tokens of each text."""
    parts = []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        hashes = np.full(len(words) + 1, END, np.uint64)
        hashes[:-1] = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        parts.append(hashes)
    return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def joined(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a history with one more token."""
    mixed = (history * ODD[0]) ^ (token * ODD[1])
    mixed ^= mixed >> np.uint64(31)
    mixed *= ODD[0]
    return mixed ^ (mixed >> np.uint64(29))


class NGrams(counting.Items):
    """The words (the start among them), bigrams and trigrams of a block, and which of them each token ends."""

    def __init__(self, rows: pd.DataFrame, cache: WordHashes):
        tokens, self.sizes = tokens_of(list(rows["text"]), cache)
        n = len(tokens)
        self.first = np.cumsum(self.sizes) - self.sizes
        opens = np.zeros(n, bool)
        opens[self.first] = True
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[opens] = START
        words, at = np.unique(np.concatenate([tokens, before]), return_inverse=True)
        self.word, self.before = at[:n], at[n:]
        bigrams, self.bigram = np.unique(joined(before, tokens), return_inverse=True)
        #: Tokens that end a trigram: all but the first of a text, whose history is the start alone.
        self.third = np.flatnonzero(~opens)
        trigrams, self.trigram = np.unique(joined(bigrams[self.bigram[self.third - 1]], tokens[self.third]), return_inverse=True)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        train = rows["train"].to_numpy(bool)
        taught = train[self.row]
        counts = np.bincount(self.word[taught], minlength=len(words))
        counts[np.searchsorted(words, START)] = train.sum()  # once for each text
        super().__init__([words, bigrams, trigrams], [counts, np.bincount(self.bigram[taught], minlength=len(bigrams)), np.bincount(self.trigram[taught[self.third]], minlength=len(trigrams))])


class Automaton:
    """States: 0 is the root, then the block's words, then its bigrams, as histories; those never seen in training
    are no states, and no arc leads to them."""

    def __init__(self, grams: NGrams, counts: list[np.ndarray], total: int, types: int):
        words, bigrams, trigrams = counts
        self.width, n_states = len(words), 1 + len(words) + len(bigrams)
        # the words of a bigram and the bigram before a trigram's last word, from any of their occurrences
        first, last = np.zeros(len(bigrams), np.int64), np.zeros(len(bigrams), np.int64)
        first[grams.bigram], last[grams.bigram] = grams.before, grams.word
        history, third = np.zeros(len(trigrams), np.int64), np.zeros(len(trigrams), np.int64)
        history[grams.trigram], third[grams.trigram] = grams.bigram[grams.third - 1], grams.word[grams.third]
        tail = np.zeros(len(trigrams), np.int64)
        tail[grams.trigram] = grams.bigram[grams.third]

        root = (words + 1.0) / (total + types + 1.0)
        one, two = failure_weight(words, 1), failure_weight(bigrams, 2)
        pair = (1 - one[first]) * bigrams / np.maximum(words[first], 1) + one[first] * root[last]
        triple = (1 - two[history]) * trigrams / np.maximum(bigrams[history], 1) + two[history] * pair[tail]
        self.fails_to = np.zeros(n_states, np.int64)
        self.fails_to[1 + len(words) :] = 1 + last
        self.failure = np.log10(np.concatenate([[1.0], one, two]))

        word_state = np.where(words > 0, 1 + np.arange(len(words)), 0)
        bigram_state = 1 + len(words) + np.arange(len(bigrams))
        seen, known = np.flatnonzero(bigrams > 0), np.flatnonzero(trigrams > 0)
        arcs = np.concatenate([np.arange(len(words)), (1 + first[seen]) * self.width + last[seen], (bigram_state[history[known]]) * self.width + third[known]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.weight = np.log10(np.concatenate([root, pair[seen], triple[known]]))[order]
        self.leads_to = np.concatenate([word_state, bigram_state[seen], bigram_state[tail[known]]])[order]
        start = np.searchsorted(grams.keys[0], START)
        self.start = word_state[start]

    def walk(self, tokens: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token each of many texts: the log probabilities, and the states that follow."""
        weight, state = np.zeros(len(tokens)), state.copy()
        todo = np.arange(len(tokens))
        place = np.empty(len(tokens), np.int64)
        while len(todo):
            arc = state[todo] * self.width + tokens[todo]
            at = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
            place[todo] = at
            todo = todo[self.arcs[at] != arc]
            weight[todo] += self.failure[state[todo]]
            state[todo] = self.fails_to[state[todo]]
        return weight + self.weight[place], self.leads_to[place]

    def score(self, grams: NGrams) -> np.ndarray:
        """Log10 probability of each text: walked from left to right, all texts of the block side by side."""
        n_walks = -(-grams.sizes // WALK)
        text = np.repeat(np.arange(len(grams.sizes)), n_walks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_walks) - n_walks, n_walks)
        # a stretch within a text starts MEMORY tokens early, unweighed: then its state is that of the whole walk
        first = grams.first[text]
        begin = first + nth * WALK
        end = np.minimum(begin + WALK, first + grams.sizes[text])
        at = np.maximum(begin - MEMORY, first)
        state, sums = np.where(at > first, 0, self.start), np.zeros(len(text))
        order = np.argsort(at - end, kind="stable")
        at, end, begin, state, text = at[order], end[order], begin[order], state[order], text[order]
        shorter = at - end  # longest first
        for step in range(-int(shorter.min(initial=0))):
            live = int(np.searchsorted(shorter, -step))
            place = at[:live] + step
            weight, state[:live] = self.walk(grams.word[place], state[:live])
            sums[:live] += np.where(place >= begin[:live], weight, 0.0)
        return np.bincount(text, weights=sums, minlength=len(grams.sizes))


def score_language(docs: DataFrame, train: Column) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``; the model
    learns from the rows for which ``train`` holds.

    A null text counts as empty: its only token is the end. A very long text is scored whole, in a block of its
    own. Equal rows are counted and scored each; without any training row, counts are 0 and scores those of
    unigrams; an empty table gives no rows; other columns, whatever their names, are ignored."""
    held = counting.numbered(small_batches(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))), "language")
    docs = counting.corpus(whole_ids(held))
    ranges, cache = [docs.ranges(s) for s in SHARES], WordHashes()
    items_of = lambda rows: NGrams(rows, cache)
    answers = counting.totals(docs, items_of, ranges, 64, "ngrams")
    # the start is among the words, but is no token
    found = {r["kind"]: r for r in answers.where(F.col("nth") == counting.SUMS).groupBy("kind").agg(F.sum("items").alias("items"), F.sum("occurrences").alias("occurrences")).collect()}
    texts = docs.docs.where("train").count()
    total = found[0]["occurrences"] - texts if found else 0
    types = found[0]["items"] - (texts > 0) if found else 0

    def scored(rows: pd.DataFrame, grams: NGrams, counts: list[np.ndarray]) -> pd.DataFrame:
        add = lambda x: np.bincount(grams.row, weights=x, minlength=len(rows))
        root = np.log10((counts[0] + 1.0) / (total + types + 1.0))
        return pd.DataFrame({
            "doc_id": rows["doc_id"].to_numpy(), "train": rows["train"].to_numpy(bool), "n_tokens": grams.sizes,
            "n_known": add(counts[0][grams.word] > 0).astype(np.int64), "base_score": add(root[grams.word]),
            "score": Automaton(grams, counts, total, types).score(grams), "train_tokens": np.full(len(rows), total, np.int64),
        })

    schema = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"
    return real_ids(counting.applied(docs, answers, items_of, ranges, 64, scored, schema))


def score_sql(train: str) -> str:
    """DuckDB SQL for (doc_id, n_tokens, n_known, train_tokens, base_score, score) of ``documents``, and ``train``, which
    is given as SQL over doc_id: the interpolated probabilities themselves, without an automaton."""
    weight = lambda c, words: f"CASE WHEN {c} > 0 THEN least(1, greatest({FAILURE[words - 1][2]}::DOUBLE, {FAILURE[words - 1][0]}::DOUBLE - {FAILURE[words - 1][1]}::DOUBLE * log2({c}))) ELSE 1.0::DOUBLE END"
    return f"""
WITH d AS (SELECT doc_id, {train} AS train, list_append(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''), '</s> ') AS w FROM documents),
t AS (SELECT doc_id, train, unnest(w) AS w, unnest(list_prepend('<s> ', w)[1 : len(w)]) AS v, unnest(list_concat([NULL, '<s> '], w)[1 : len(w)]) AS u FROM d),
c1 AS (SELECT w, count(*) AS c FROM t WHERE train GROUP BY 1 UNION ALL SELECT '<s> ', count(*) FROM d WHERE train),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE train GROUP BY 1, 2),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE train AND u IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT coalesce(sum(c) FILTER (WHERE w <> '<s> '), 0) AS n, count(*) FILTER (WHERE w <> '<s> ') AS types FROM c1),
j AS (SELECT t.doc_id, t.train, t.u, coalesce(a.c, 0) AS w1, coalesce(b.c, 0) AS h1, coalesce(e.c, 0) AS w2, coalesce(f.c, 0) AS h2, coalesce(g.c, 0) AS w3
      FROM t LEFT JOIN c1 a ON a.w = t.w LEFT JOIN c1 b ON b.w = t.v LEFT JOIN c2 e ON e.v = t.v AND e.w = t.w LEFT JOIN c2 f ON f.v = t.u AND f.w = t.v LEFT JOIN c3 g ON g.u = t.u AND g.v = t.v AND g.w = t.w),
p AS (SELECT *, (w1 + 1) / (n + types + 1)::DOUBLE AS p1, {weight('h1', 1)} AS l1, {weight('h2', 2)} AS l2, n FROM j, k),
q AS (SELECT *, (1 - l1) * w2 / greatest(h1, 1) + l1 * p1 AS p2 FROM p)
SELECT doc_id, train, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE w1 > 0)::BIGINT AS n_known, max(n)::BIGINT AS train_tokens, sum(log10(p1)) AS base_score,
       sum(log10(CASE WHEN u IS NULL THEN p2 ELSE (1 - l2) * w3 / greatest(h2, 1) + l2 * p2 END)) AS score FROM q GROUP BY 1, 2
"""
