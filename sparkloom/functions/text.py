"""Trigrams, unaccent, full-text matching, quoting and other string functions."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import stored

#: Letters without a decomposition, and what stands for them.
SPELLED = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
STROKED = ("øØđĐðÐłŁħĦŧŦıŋŊ", "oOdDdDlLhHtTinN")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")


def left(s: Column, n: int) -> Column:
    """The first n characters; for a negative n all but the last -n."""
    return F.substring(s, F.lit(1), F.lit(n) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """The last n characters; for a negative n all but the first -n."""
    keep = F.least(F.lit(n), F.length(s)) if n >= 0 else F.greatest(F.length(s) + n, F.lit(0))
    return F.substring(s, F.length(s) - keep + 1, keep)


def concat(*parts: Column) -> Column:
    """Joins what isn't null."""
    return F.concat_ws("", *parts)


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def replace_first(s: Column, pattern: str, put: str) -> Column:
    """The first match of a pattern without groups replaced; what is before it may have line ends."""
    return F.regexp_replace(s, f"(?s)^(.*?)(?:{pattern})", "$1" + put)


@functools.cache
def marked_letters() -> tuple[str, str]:
    """Letters that Unicode decomposes into one letter and marks, their plain letters, and the marks, which have none."""
    letters, plain, marks = list(STROKED[0]), list(STROKED[1]), []
    for code in range(0x80, 0x1F000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        kinds = [unicodedata.category(p) for p in parts]
        if len(parts) > 1 and kinds[0] != "Mn" and all(k == "Mn" for k in kinds[1:]):
            letters.append(c)
            plain.append(parts[0])
        elif kinds == ["Mn"] and unicodedata.combining(c):
            marks.append(c)
    return "".join(letters + marks), "".join(plain)


def unaccent(s: Column) -> Column:
    """Letters without their marks, by the Unicode decomposition and a few fixed spellings. JVM functions only."""
    out = F.translate(s, *marked_letters())
    for c, spelled in SPELLED.items():
        out = F.replace(out, F.lit(c), F.lit(spelled))
    return F.when(s.rlike(r"\A\p{ASCII}*\z"), s).otherwise(out)


def trigrams(s: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each with two blanks before and one behind."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - both
    return F.when(total > 0, both / total).otherwise(F.lit(0.0))


def similarity_join(left_df: DataFrame, right_df: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """Pairs of similarity >= least; columns must have distinct names.

    Two sets as similar as that share one of the n - ceil(least * n) + 1 rarest trigrams of each, so only those are joined;
    pairs are made distinct and compared once. Counts of trigrams: there are no more of them than triples of characters.
    """
    x = left_df.withColumns({"__x": trigrams(F.col(a)), "__i": F.monotonically_increasing_id()})
    y = right_df.withColumns({"__y": trigrams(F.col(b)), "__j": F.monotonically_increasing_id()})
    x, y = stored(x.where(F.size("__x") > 0)), stored(y.where(F.size("__y") > 0))
    grams = x.select(F.explode("__x").alias("g")).unionByName(y.select(F.explode("__y").alias("g"))).groupBy("g").agg(F.count(F.lit(1)).alias("c"))

    def prefix(df: DataFrame, sets: str, key: str) -> DataFrame:
        counted = df.select(key, F.size(sets).alias(f"{key}n"), F.explode(sets).alias("g")).join(grams, "g")
        ordered = counted.groupBy(key, f"{key}n").agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("o"))  # a text's own trigrams
        n = F.col(f"{key}n")
        return ordered.select(key, f"{key}n", F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * F.lit(least)) + 1).cast("int"))).alias("o")).select(key, f"{key}n", "o.g")

    fits = F.least("__in", "__jn") >= F.greatest("__in", "__jn") * F.lit(least)
    pairs = prefix(x, "__x", "__i").join(prefix(y, "__y", "__j"), "g").where(fits).select("__i", "__j").distinct()
    both = F.size(F.array_intersect("__x", "__y"))
    hits = pairs.join(x, "__i").join(y, "__j").withColumn("similarity", both / (F.size("__x") + F.size("__y") - both))
    return hits.where(F.col("similarity") >= least).select(*left_df.columns, *right_df.columns, "similarity")


def terms(s: Column) -> Column:
    """Lower-cased words without stop words."""
    words = F.split(F.lower(s), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def matches_all(s: Column, words: list[str]) -> Column:
    own = terms(s)
    out = F.lit(True)
    for w in words:
        out = out & F.array_contains(own, w)
    return out


def matches_any(s: Column, words: list[str]) -> Column:
    return F.arrays_overlap(terms(s), F.array(*[F.lit(w) for w in words]))


def matches_phrase(s: Column, words: list[str]) -> Column:
    """Words that follow one another."""
    own = F.array_join(terms(s), " ")
    return F.contains(F.concat(F.lit(" "), own, F.lit(" ")), F.lit(" " + " ".join(words) + " "))


def term_frequency(s: Column, words: list[str]) -> Column:
    own = terms(s)
    return F.size(F.filter(own, lambda w: w.isin(*words)))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x) if x is not None else None)


def normalize_nfc(s: Column) -> Column:
    """Unicode NFC, which no built-in function has. ASCII texts are in it already and never go to Python."""
    ascii_only = s.rlike(r"\A\p{ASCII}*\z")
    return F.when(ascii_only, s).otherwise(_nfc(F.when(~ascii_only, s)))


@F.pandas_udf(T.IntegerType())
def weighted_levenshtein(a: pd.Series, b: pd.Series, insert: pd.Series, delete: pd.Series, change: pd.Series) -> pd.Series:
    """Edit distance with costs; Spark's own has unit costs only. All rows of a batch advance together, a letter of `a` at a time.

    The cost of insertions along a row is a running minimum: cost[j] = min over k <= j of (best[k] - k * insert) + j * insert.
    """
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series([None] * len(a), dtype="Int32")
    rows = np.flatnonzero(known)
    rows = rows[np.argsort(b.iloc[rows].str.len().to_numpy(), kind="stable")]
    at = 0
    while at < len(rows):
        wide = len(b.iloc[rows[at]])
        n = max(1, min(1024, (1 << 22) // max(1, wide + 1)))  # rows advance together while their table is small
        part = rows[at : at + n]
        at += n
        x, y = ([np.frombuffer(t.encode("utf-32-le"), np.int32) for t in s.iloc[part]] for s in (a, b))
        i, d, c = (s.iloc[part].to_numpy(np.int64)[:, None] for s in (insert, delete, change))
        size = np.array([len(t) for t in y])
        letters = np.full((len(part), int(size.max())), -1, np.int32)
        for r, t in enumerate(y):
            letters[r, : len(t)] = t
        j = np.arange(letters.shape[1] + 1, dtype=np.int64)[None, :]
        cost = j * i
        for k in range(max((len(t) for t in x), default=0)):
            live = np.array([k < len(t) for t in x])
            letter = np.array([t[k] if k < len(t) else -2 for t in x], np.int32)[:, None]
            best = cost + d
            best[:, 1:] = np.minimum(best[:, 1:], cost[:, :-1] + np.where(letters == letter, 0, c))
            best = np.minimum.accumulate(best - j * i, axis=1) + j * i
            cost = np.where(live[:, None], best, cost)
        out.iloc[part] = cost[np.arange(len(part)), size]
    return out


def difference(a: Column, b: Column) -> Column:
    """Equal places of the two soundex codes, 0 to 4."""
    x, y = F.soundex(a), F.soundex(b)
    return sum(((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5)), F.lit(0))
