"""SIMILAR TO, phonetic codes, word similarity, quoting, and text search with stems and ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOP_WORDS, quote_literal, trigrams


def similar_to(pattern: str, escape: str = "\\") -> str:
    """An SQL regular expression as a Java one that must match the whole text."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif inside:
            out += c
            inside = c != "]"
        elif c == "[":
            out, inside = out + c, True
        elif c in "|*+?{}()":
            out += "(?:" if c == "(" else c
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^(?:{out})$"


def quote_ident(s: Column) -> Column:
    """As it is if it is a plain lower-case name, else in double quotes."""
    return F.when(s.rlike("^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_text(template: str, *values: Column) -> Column:
    """format(): %s, %I, %L, %%, with positions (%2$s) and widths (%-10s)."""
    parts, at, last = [], 0, 0
    for m in re.finditer(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL%])", template):
        parts.append(F.lit(template[last : m.start()]))
        last = m.end()
        if m[4] == "%":
            parts.append(F.lit("%"))
            continue
        at = int(m[1]) if m[1] else at + 1
        v = values[at - 1].cast("string")
        shown = {"s": F.coalesce(v, F.lit("")), "I": quote_ident(v), "L": F.coalesce(quote_literal(v), F.lit("NULL"))}[m[4]]
        if m[3]:
            wide = F.greatest(F.length(shown), F.lit(int(m[3])))
            shown = F.rpad(shown, wide, F.lit(" ")) if m[2] else F.lpad(shown, wide, F.lit(" "))
        parts.append(shown)
    return F.concat(*parts, F.lit(template[last:]))


def escape_bytes(s: Column) -> Column:
    """encode(…, 'escape') of ASCII texts: backslashes doubled, zero bytes as \\000."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\0"), F.lit("\\000"))


def word_similarity(a: Column, b: Column) -> Column:
    """The greatest share of a's trigrams in a stretch of b's words: all trigrams of a against those of each run of words."""
    x = trigrams(a)
    words = F.filter(F.split(F.lower(b), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def share(run: Column) -> Column:
        y = trigrams(F.array_join(run, " "))
        both = F.size(F.array_intersect(x, y))
        return both / (F.size(x) + F.size(y) - both)

    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.slice(words, i, j - i + 1))))
    return F.when((n > 0) & (F.size(x) > 0), F.array_max(F.transform(runs, share))).otherwise(F.lit(0.0))


#: Consonant rules of the phonetic code, in order, for upper-case letters.
METAPHONE = (
    ("([A-BD-Z])\\1", "$1"), ("^AE", "E"), ("^[GKP]N", "N"), ("^WR", "R"), ("^X", "S"), ("^WH", "W"), ("MB$", "M"), ("SCH", "SK"), ("CIA", "XIA"), ("CH", "X"), ("C([IEY])", "S$1"), ("C", "K"), ("DG([EIY])", "J$1"), ("D", "T"),
    ("GH([^AEIOU])", "$1"), ("GH$", ""), ("GN$", "N"), ("GNED$", "NED"), ("G([IEY])", "J$1"), ("G", "K"), ("PH", "F"), ("Q", "K"), ("SH", "X"), ("SI([AO])", "XI$1"), ("TI([AO])", "XI$1"), ("TH", "0"), ("V", "F"),
    ("([^AEIOU])H", "$1"), ("H([^AEIOU]|$)", "$1"), ("KK", "K"), ("W([^AEIOU]|$)", "$1"), ("Y([^AEIOU]|$)", "$1"), ("Z", "S"),
)


def phonetic(s: Column) -> Column:
    """A consonant skeleton of a word after the public metaphone rules; vowels stay at the beginning only."""
    out = F.regexp_replace(F.upper(s), "[^A-Z]", "")
    for pattern, put in METAPHONE:
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, "(?<!^)[AEIOU]", "")


#: Endings that the light English stemmer takes off, longest first, from words that keep three letters.
ENDINGS = "(?:ingly|edly|ings|ing|ies|ied|ed|es|ly|s)$"


def stem(word: Column) -> Column:
    """A light stem: plural, past and -ing endings off, `y` for `ies`."""
    w = F.when(word.rlike("^.{2,}(?:ies|ied)$"), F.regexp_replace(word, "(?:ies|ied)$", "y")).otherwise(word)
    return F.when(w.rlike("ss$"), w).otherwise(F.regexp_replace(w, f"(?<=^.{{3,200}}){ENDINGS}", ""))


def tsvector(s: Column) -> Column:
    """(lexeme, position) of each word that isn't a stop word; positions count all words from 1."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i + 1).alias("pos")))
    kept = F.filter(placed, lambda x: ~x["word"].isin(*STOP_WORDS))
    return F.transform(kept, lambda x: F.struct(stem(x["word"]).alias("lexeme"), x["pos"].alias("pos")))


def lexemes(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(tsvector(s), lambda x: x["lexeme"])))


def tsquery(vector: Column, query: str) -> Column:
    """A query of words, & | ! <-> and parentheses, and `word:*` for a prefix, as a condition on a tsvector."""
    tokens = re.findall(r"<->|[&|!()]|[^\s&|!()<>:]+(?::\*)?", query.lower())
    at = 0

    def take(*wanted: str) -> str | None:
        nonlocal at
        if at < len(tokens) and tokens[at] in wanted:
            at += 1
            return tokens[at - 1]
        return None

    def places(word: str) -> Column:
        if word.endswith(":*"):
            return F.transform(F.filter(vector, lambda x: F.startswith(x["lexeme"], F.lit(word[:-2]))), lambda x: x["pos"])
        return F.transform(F.filter(vector, lambda x: x["lexeme"] == stem(F.lit(word))), lambda x: x["pos"])

    def follow(before: Column, after: Column) -> Column:
        return F.filter(after, lambda p: F.array_contains(before, p - 1))

    def either() -> Column:
        out = both()
        while take("|"):
            out = out | both()
        return out

    def both() -> Column:
        out = one()
        while take("&"):
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if take("!"):
            return ~one()
        if take("("):
            out = either()
            if not take(")"):
                raise ValueError(f"tsquery: no closing parenthesis in {query}")
            return out
        if at >= len(tokens) or tokens[at] in ("&", "|", ")", "<->"):
            raise ValueError(f"tsquery: a word is missing in {query}")
        at += 1
        where = places(tokens[at - 1])
        while take("<->"):
            at += 1
            where = follow(where, places(tokens[at - 1]))
        return F.size(where) > 0

    out = either()
    if at < len(tokens):
        raise ValueError(f"tsquery: {tokens[at]} is not expected in {query}")
    return out


def ts_rank(vector: Column, words: list[str]) -> Column:
    """A rank by frequency: for each lexeme the sum of 1 / i^2 over its occurrences i, times a tenth (the lowest weight), averaged over the query."""
    def one(word: str) -> Column:
        n = F.size(F.filter(vector, lambda x: x["lexeme"] == stem(F.lit(word))))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 0.1 / (i * i))).otherwise(F.lit(0.0))

    return sum((one(w) for w in words[1:]), one(words[0])) / len(words)


def headline(s: Column, words: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    """The text with the query's words marked."""
    return F.regexp_replace(s, "(?i)\\b(" + "|".join(map(re.escape, words)) + ")\\b", f"{start}$1{stop}")
