"""Edit-distance and token metrics between a recognised text and its reference, as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import bound, strip, words


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def fold(text: Column) -> Column:
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def compatible(text: Column) -> Column:
    """NFKC, trimmed, in lower case. The vectorised function is handed every row, whichever branch it takes; texts of ASCII
    alone come back from it as they are."""
    return fold(F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(_nfkc(text)))


def _both(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of two values, each worked out once: within a lambda it would be again for each element."""
    return bound(a, lambda x: bound(b, lambda y: body(x, y)))


def cer_compatible(hyp: Column, ref: Column) -> Column:
    # no lambda here: it may not hold a vectorised function
    return F.levenshtein(compatible(hyp), compatible(ref)) / F.greatest(F.length(compatible(ref)), F.lit(1))


def cer_at_least_one(hyp: Column, ref: Column) -> Column:
    """Edits over the reference's length, 1 at least."""
    return _both(fold(hyp), fold(ref), lambda h, r: F.levenshtein(h, r) / F.greatest(F.length(r), F.lit(1)))


def cer(hyp: Column, ref: Column) -> Column:
    """Edits over the reference's length; against an empty reference 0 if nothing was read, else 1."""
    return _both(fold(hyp), fold(ref), lambda h, r: F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(h, r) / F.length(r)))


def wer_charlev(hyp: Column, ref: Column) -> Column:
    """Character edits of the words joined by blanks, over the reference's number of words."""

    def rate(h: Column, r: Column) -> Column:
        edits = F.levenshtein(F.array_join(h, " "), F.array_join(r, " "))
        return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(edits / F.size(r))

    return _both(words(fold(hyp)), words(fold(ref)), rate)


def windows(tokens: Column, n: Column) -> Column:
    """All runs of ``n`` neighbouring tokens, or the one run of all if there are fewer."""

    def runs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(each)

    return bound(tokens, runs)


def _best(hyp: Column, ref: Column, by: Callable[[Column], Column]) -> Column:
    def least(h: Column, r: Column) -> Column:
        edits = bound(F.greatest(F.lit(1), F.size(words(r))), lambda n: F.array_min(F.transform(windows(h, n), lambda w: F.levenshtein(w, r))))
        return F.when(r == "", 0.0).when(F.size(h) == 0, 1.0).otherwise(edits / by(r))

    return _both(words(fold(hyp)), fold(ref), least)


def cer_field(hyp: Column, ref: Column) -> Column:
    """CER of the window of the hypothesis that fits the reference best."""
    return _best(hyp, ref, F.length)


def wer_field(hyp: Column, ref: Column) -> Column:
    return _best(hyp, ref, lambda r: F.size(words(r)))


def token_f1(hyp: Column, ref: Column) -> Column:
    def harmonic(h: Column, r: Column) -> Column:
        both = F.size(F.array_intersect(h, r))
        precision, recall = both / F.size(h), both / F.size(r)
        score = F.when(both == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
        return F.when((F.size(h) == 0) & (F.size(r) == 0), 1.0).when((F.size(h) == 0) | (F.size(r) == 0), 0.0).otherwise(score)

    return _both(F.array_distinct(words(fold(hyp))), F.array_distinct(words(fold(ref))), harmonic)


def exact_match(hyp: Column, ref: Column) -> Column:
    return (fold(hyp) == fold(ref)).cast("double")


def _close(token: Column, others: Column) -> Column:
    """Whether any of ``others`` equals the token, or is one edit away if it has four characters or more. Lengths
    are compared first, and the edit distance is bounded."""
    near = lambda g: (F.abs(F.length(token) - F.length(g)) <= 1) & (F.levenshtein(token, g, 1) >= 0)
    return F.array_contains(others, token) | ((F.length(token) >= 4) & F.exists(others, near))


def token_overlap(seg: Column, ref: Column) -> Column:
    """Share of a segment's tokens found in the reference, one edit allowed from four characters on; 1 if the
    reference lies within the segment, blanks aside, or is two edits away at most."""
    s, r = F.upper(F.coalesce(seg, F.lit(""))), F.upper(F.coalesce(ref, F.lit("")))
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))

    def alike(x: Column, y: Column) -> Column:
        near = (F.abs(F.length(x) - F.length(y)) <= 2) & (F.levenshtein(x, y, 2) >= 0)
        return (F.length(y) >= 4) & (F.contains(x, y) | near)

    def share(tokens: Column, wanted: Column) -> Column:
        found = F.size(F.filter(tokens, lambda t: _close(t, wanted)))
        return F.when((F.size(tokens) == 0) | (F.size(wanted) == 0), 0.0).otherwise(found / F.size(tokens))

    return F.when(_both(bare(s), bare(r), alike), 1.0).otherwise(_both(words(s), F.array_distinct(words(r)), share))


def pseudo_cer(hyp: Column, ref: Column) -> Column:
    """1 less the share of the reference's distinct tokens that were read; 1 without a reference."""

    def missed(h: Column, r: Column) -> Column:
        return F.when(F.size(r) == 0, 1.0).otherwise(1.0 - F.size(F.array_intersect(r, h)) / F.size(r))

    return _both(F.array_distinct(words(F.upper(hyp))), F.array_distinct(words(F.upper(ref))), missed)


def token_recall(hyp: Column, ref: Column) -> Column:
    """Share of the reference's tokens found in the hypothesis, one edit allowed from four characters on."""

    def found(h: Column, r: Column) -> Column:
        return F.when(F.size(r) == 0, 0.0).otherwise(F.size(F.filter(r, lambda t: _close(t, h))) / F.size(r))

    return _both(F.array_distinct(words(F.upper(hyp))), words(F.upper(ref)), found)
