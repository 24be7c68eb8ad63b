"""PII by information-theoretic sanitisation. DataFrame functions only.

Base spans come from patterns (email, ip, card, phone) with their checks. Every base value, and every kind, is a protected
entity c. Terms (runs of letters, lower-cased, outside base spans) within REACH characters of its spans co-occur with it.
How often they do, against how often they occur in the whole corpus, estimates p(c | t), and so the pointwise mutual
information PMI(c; t) = log2 p(c | t) / p(c). A term discloses c by PMI(c; t) / IC(c), where IC(c) = -log2 p(c): 1 means
that whoever reads t knows of c. An occurrence counts once, however many spans of the entity are near. A term counts only
if its sightings can't be chance: m different contexts near c (copies of a context are one) would come about with the
probability p(c) ^ m, which must stay below ALPHA even if every word of the corpus is tried; no other support is asked for.
Terms of a disclosure of at least DISCLOSURE become spans of kind `term` wherever they stand in a text that holds c.
sanitise() generalises base spans to their kind and removes terms.

The patterns here find what those of the contract find, leftmost and not overlapping, in time linear in the text: a match
begins where a run of its first class begins, or where the last match ended.

Defined results. A null text is an empty text without spans. Repeated rows and null ids each get their row; equal rows
have equal spans. Very long texts are read whole. An empty table gives an empty result. Other columns are never looked at;
sanitise() sets a column of text lengths (`length_col`), if there is one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import HOT, Filter, join_hot, maybe_in
from .runtime import drop, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; `phone` needs no lead, as a plus sign is not part of its inside.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Characters around a span, disclosure from which a term is marked, and the chance of one term by mere chance.
REACH, DISCLOSURE, ALPHA = 80, 0.95, 0.01
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits(x)).between(16, 19) & F.call_function("luhn_check", digits(x))
    if kind == "phone":
        return F.length(digits(x)).between(8, 15)
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """The valid spans of a kind, in order: what lies between matches, and the matches, add up to positions."""
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)

    def step(at: Column, x: Column) -> Column:
        start = at["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        return F.struct(end.alias("pos"), F.when(valid(kind, x["hit"]), F.concat(at["out"], span)).otherwise(at["out"]).alias("out"))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    none = F.array().cast(_SPANS)
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step)["out"]
    return spans if MARKS[kind] is None else F.when(F.contains(text, F.lit(MARKS[kind])), spans).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs[id_col].cast("long"), F.xxhash64(text), text


WORDS = r"\p{L}+"


def word_spans(text: Column) -> Column:
    """(term, start, end) of each run of letters, in order."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.split(text, WORDS, -1)

    def step(at: Column, x: Column) -> Column:
        start = at["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(end.alias("pos"), F.concat(at["out"], F.array(F.struct(x["hit"].alias("term"), start.alias("start"), end.alias("end")))).alias("out"))

    pairs = F.zip_with(words, F.slice(gaps, F.lit(1), F.size(words)), lambda h, g: F.struct(h.alias("hit"), g.alias("gap")))
    none = F.array().cast("array<struct<term:string,start:int,end:int>>")
    return F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step)["out"]


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False) -> DataFrame:
    """doc_id, h (of the text), the number of words, the base spans, the contexts and a number of its own for each row.

    clean: with the whole row, and its text without base values.
    """
    doc_id, h, text = _key(docs, id_col, text_col)
    row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col], F.lit(0).alias("__")).alias("row"), docs[text_col].isNull().alias("was_null")] if clean else []
    rows = docs.select(*row, doc_id.alias("doc_id"), h.alias("h"), text.alias("body"), *[kind_spans(text, k).alias(k) for k in KINDS])
    spans = F.concat(*[F.col(k) for k in KINDS])
    left = lambda s: F.greatest(s["start"] - REACH, F.lit(0))
    near = F.transform(
        spans,
        lambda s: F.struct(
            s["kind"].alias("kind"), s["value"].alias("value"), left(s).alias("left_at"), F.substring(F.col("body"), left(s) + 1, s["start"] - left(s)).alias("left"), s["end"].alias("right_at"),
            F.substring(F.col("body"), s["end"] + 1, F.lit(REACH)).alias("right"), (s["end"] + REACH >= F.length("body")).alias("to_end"),
        ),
    )
    out = rows.select(*rows.columns[: len(row)], "doc_id", "h", "body", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], spans.alias("spans"), near.alias("near"), F.regexp_count("body", F.lit(WORDS)).alias("words"), F.monotonically_increasing_id().alias("row_id"))
    return out.withColumn("body", replaced(F.col("body"), F.col("spans"))) if clean else out.drop("body")


def terms(found: DataFrame) -> DataFrame:
    """doc_id, h, row, kind, value, context, term, start of each term near a base span and in none; terms cut off by the window are not taken."""
    some = found.where(F.size("spans") > 0).select("doc_id", "h", F.col("row_id").alias("row"), "spans", F.explode("near").alias("n"))
    side = lambda at, text, whole_from, whole_to: F.struct(F.col(at).alias("at"), F.col(text).alias("side"), whole_from.alias("first"), whole_to.alias("last"))
    sides = F.explode(F.array(side("n.left_at", "n.left", F.col("n.left_at") == 0, F.lit(True)), side("n.right_at", "n.right", F.lit(True), F.col("n.to_end")))).alias("s")
    rows = some.select("doc_id", "h", "row", "spans", "n.kind", "n.value", F.xxhash64("n.left", "n.right").alias("context"), sides)
    rows = rows.select("doc_id", "h", "row", "spans", "kind", "value", "context", "s.at", "s.first", "s.last", F.length("s.side").alias("size"), F.explode(word_spans(F.col("s.side"))).alias("t"))
    start, end = F.col("at") + F.col("t.start"), F.col("at") + F.col("t.end")
    whole = ((F.col("t.start") > 0) | F.col("first")) & ((F.col("t.end") < F.col("size")) | F.col("last")) & (F.length("t.term") >= 3)
    outside = ~F.exists("spans", lambda s: (s["start"] < end) & (start < s["end"]))
    return rows.where(whole & outside).select("doc_id", "h", "row", "kind", "value", "context", F.lower("t.term").alias("term"), start.alias("start"))


def entities() -> Column:
    """The protected entities of a term's row: the value and its kind."""
    return F.explode(F.array(F.concat_ws(":", "kind", "value"), F.col("kind"))).alias("entity")


def disclosure(share: Column, content: Column) -> Column:
    """PMI over information content: log2 p(c | t) / p(c) over -log2 p(c)."""
    return 1 + F.log2(F.least(share, F.lit(1.0))) / content


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, together) where the term discloses the entity."""
    each = near.select(entities(), "term", "row", "start", "context").groupBy("entity", "term", "row", "start").agg(F.min("context").alias("context"))
    contexts = each.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(contexts.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("contexts")), "pii-pairs")
    total = F.greatest(found.agg(F.sum("words").alias("n")).scalar(), F.lit(2)).cast("double")
    weight = written(near.select(entities(), "row", "start").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("weight")), "pii-weights")
    weighed = join_hot(pairs, weight, ["entity"]).withColumn("content", -F.log2(F.least(F.col("weight") / total, F.lit(0.5))))
    able = written(weighed.where(F.col("contexts") * F.col("content") >= F.log2(total / ALPHA)), "pii-able")
    wanted = written(able.select("term").distinct(), "pii-terms")
    among = lambda words: words.where(maybe_in(wanted, "term", F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    every = among(docs.select(F.explode(F.split(F.lower(docs[text_col].cast("string")), r"[^\p{L}]+")).alias("term")))
    inside = among(found.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).select(F.explode(F.split(F.lower("s.value"), r"[^\p{L}]+")).alias("term")))
    counts = every.join(inside.withColumnRenamed("n", "less"), "term", "left").select("term", F.greatest(F.col("n") - F.coalesce("less", F.lit(0)), F.lit(1)).alias("n"))
    told = join_hot(able, counts, ["term"])
    out = written(told.where(disclosure(F.col("together") / F.col("n"), F.col("content")) >= DISCLOSURE).select("entity", "term", "together"), "pii-told")
    drop(pairs, weight, able, wanted)
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """The base table (one row a row) and the term spans (doc_id, h, terms) of the rows that have any."""
    found = written(base(docs, id_col, text_col, clean), "pii-base")
    near = written(terms(found), "pii-near")
    told = disclosing(docs, found, near, text_col)
    key = F.xxhash64("entity", "term")
    asked = near.select("doc_id", "h", entities(), "term").where(maybe_in(told.select(key.alias("k")), "k", key)).distinct()
    hot = told.where(F.col("together") * HOT > near.agg(F.count(F.lit(1)).alias("n")).scalar()).orderBy(F.desc("together"), "entity", "term").limit(HOT)  # the others are dealt by key
    own = join_hot(asked, told.select("entity", "term"), ["entity", "term"], hot=hot).groupBy("doc_id", "h").agg(F.collect_set("term").alias("own"))  # terms of one text
    own = written(own, "pii-own").withColumnsRenamed({"doc_id": "i", "h": "g"})
    # each of those texts once more, for all places of its terms
    doc_id, h, text = _key(docs, id_col, text_col)
    again = maybe_in(own.select(F.xxhash64("i", "g").alias("k")), "k", F.xxhash64(doc_id, h))
    rows = docs.where(again).select(doc_id.alias("doc_id"), h.alias("h"), text.alias("body"))
    rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).dropDuplicates(["doc_id", "h"])
    kept = F.concat(*[kind_spans(F.col("body"), k) for k in KINDS])
    rows = rows.select("doc_id", "h", "own", kept.alias("kept"), word_spans(F.col("body")).alias("words"))
    mine = F.filter("words", lambda w: F.array_contains("own", F.lower(w["term"])) & ~F.exists("kept", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    spans = F.transform(mine, lambda w: F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end"), F.lit("").alias("value")))
    marked = written(rows.select("doc_id", "h", spans.cast(_SPANS).alias("terms")), "pii-marked")
    drop(near, told, own)
    return found, marked


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row. Only rows that may have term spans are shuffled."""
    found, marked = find(docs, id_col, text_col)
    m = marked.withColumnsRenamed({"doc_id": "i", "h": "g"})
    maybe = maybe_in(m.select(F.xxhash64("i", "g").alias("k")), "k", F.xxhash64("doc_id", "h"))
    found, none = found.drop("near", "words", "row_id"), F.array().cast(_SPANS)
    some = found.where(maybe).join(m, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    rows = found.where(~maybe).withColumn("terms", none).unionByName(some.drop("i", "g"))
    every = F.concat("spans", F.coalesce("terms", none))
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(every).alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to [KIND] and terms removed; overlapping spans are one."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def step(at: Column, s: Column) -> Column:
        end = -s["less"]
        mark = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        put = F.concat(at["out"], F.substring(text, at["pos"] + 1, s["start"] - at["pos"]), mark)
        return F.struct(F.greatest(at["pos"], end).alias("pos"), F.when(s["start"] >= at["pos"], put).otherwise(at["out"]).alias("out"))

    rest = lambda at: F.concat(at["out"], F.substring(text, at["pos"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(order, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, rest)).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with sanitised texts and all their columns; length_col, if docs has it, gets the new lengths.

    One scan finds the base spans and writes the rows without them. Only rows with term spans are read from docs again.
    """
    found, marked = find(docs, id_col, text_col, clean=True)
    m = marked.withColumnsRenamed({"doc_id": "i", "h": "g"})
    held = Filter(m.select(F.xxhash64("i", "g").alias("k")), "k")
    doc_id, h, text = _key(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    maybe = held.may_hold(F.xxhash64("doc_id", "h"))
    clean = found.select("row", "was_null", "doc_id", "h", "body")
    plain_rows = clean.where(~maybe).unionByName(clean.where(maybe).join(m.select("i", "g"), same, "left_anti"))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text_col], F.lit(0).alias("__")).alias("row")
    own = F.concat(*[kind_spans(text, k) for k in KINDS])
    again = docs.where(held.may_hold(F.xxhash64(doc_id, h))).select(row, docs[text_col].isNull().alias("was_null"), doc_id.alias("doc_id"), h.alias("h"), text.alias("body"), own.alias("own")).join(m, same)
    again = again.select("row", "was_null", "doc_id", "h", replaced(F.col("body"), F.concat("own", "terms")).alias("body"))
    out = plain_rows.unionByName(again)
    columns = []
    for c in docs.columns:
        value = F.col("row")[c] if c != text_col else F.when(~F.col("was_null"), F.col("body"))
        if c == length_col and c != text_col:
            value = F.when(F.col("was_null"), value).otherwise(F.length("body").cast(docs.schema[c].dataType))
        columns.append(value.alias(c))
    return out.select(*columns)
