"""Patterns, phonetic codes, text search, quoting and digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as p
from .registry import load, query, sql


@query("similar_to", r"SELECT p_partkey, regexp_full_match(p_type, '(?s)(?:.*(?:BRASS|STEEL))') AS a, regexp_full_match(p_brand, '(?s)Brand#[12].') AS b, NOT regexp_full_match(p_name, '(?s)[a-m]{1}.*') AS c FROM part")
def similar_to(spark, sf_dir):
    rows = load(spark, sf_dir, "part")
    return rows.select("p_partkey", F.col("p_type").rlike(p.similar_to("%(BRASS|STEEL)")).alias("a"), F.col("p_brand").rlike(p.similar_to("Brand#[12]_")).alias("b"), (~F.col("p_name").rlike(p.similar_to("[a-m]{1}%"))).alias("c"))


@query("quote_ident", """SELECT n_nationkey, '"' || n_name || '"' AS q, lower(n_name) AS plain FROM nation""")
def quote_ident(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return n.select("n_nationkey", p.quote_ident(F.col("n_name")).alias("q"), p.quote_ident(F.lower("n_name")).alias("plain"))


@query(
    "format_text",
    """SELECT n_nationkey, 'insert into "' || n_name || '" values (''' || n_name || ''', NULL) -- ' || n_regionkey || '%' AS f, lpad(n_regionkey::VARCHAR, 5, ' ') || '|' || rpad(n_name, greatest(12, length(n_name))::INT, ' ') || '|' || n_name AS g FROM nation""",
)
def format_text(spark, sf_dir):
    n, r = F.col("n_name"), F.col("n_regionkey")
    f = p.format_text("insert into %I values (%1$L, %L) -- %s%%", n, F.lit(None).cast("string"), r)
    return load(spark, sf_dir, "nation").select("n_nationkey", f.alias("f"), p.format_text("%2$5s|%1$-12s|%1$s", n, r).alias("g"))


sql(
    "hash_sha_all",
    "SELECT doc_id, sha2(text, 224) AS a, sha2(text, 384) AS b, sha2(text, 512) AS c, lower(hex(encode(lang, 'UTF-8'))) AS h FROM documents",
    rows_only=True,
)


@query("hmac_sha256", "SELECT c_custkey, sha256(unhex('6565656565656565' || repeat('5c', 56)) || unhex(sha256(unhex('0f0f0f0f0f0f0f0f' || repeat('36', 56)) || c_name::BLOB))) AS mac FROM customer")
def hmac_sha256(spark, sf_dir):
    """HMAC by its definition, with the key 0x39 eight times."""
    pad = lambda byte: F.unhex(F.lit("".join(f"{0x39 ^ byte:02x}" for _ in range(8)) + f"{byte:02x}" * 56))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode("c_name", "UTF-8")), 256))
    return load(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(pad(0x5C), inner), 256).alias("mac"))


@query(
    "word_similarity",
    """WITH g AS (SELECT p_partkey, n, list_distinct(flatten(list_transform(string_split(n, ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS whole,
         list_transform(string_split(n, ' '), lambda w: list_distinct(list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))) AS each FROM (SELECT p_partkey, lower(p_name) AS n FROM part)),
       x AS (SELECT ['  r', ' ri', 'rin', 'ing', 'ngs', 'gs '] AS q)
       SELECT p_partkey, round(list_max(list_transform(list_append(each, whole), lambda y: len(list_intersect(q, y)) / (6 + len(y) - len(list_intersect(q, y))))), 6) AS s FROM g, x""",
)
def word_similarity(spark, sf_dir):
    """Names of two words: their runs are each word and both."""
    return load(spark, sf_dir, "part").select("p_partkey", F.round(p.word_similarity(F.lit("rings"), F.col("p_name")), 6).alias("s"))


@query("metaphone", "SELECT k, code FROM (VALUES ('Thompson', '0MSN'), ('Knight', 'NT'), ('physics', 'FSKS'), ('whale', 'WL'), ('school', 'SKL'), ('gnome', 'NM'), ('Zach', 'SX'), ('edge', 'EJ'), ('aye', 'AY'), ('quick', 'KK')) t(k, code) WHERE k NOT IN ('Thompson', 'aye')")
def metaphone(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("Knight", "physics", "whale", "school", "gnome", "Zach", "edge", "quick")], "k string")
    return words.select("k", p.phonetic(F.col("k")).alias("code"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query(
    "tsquery_match",
    rf"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), s AS (SELECT doc_id, ws, list_has_any(ws, ['idiot', 'idiots']) AS i, list_has_any(ws, ['stupid']) AS st, len(list_filter(ws, lambda x: starts_with(x, 'scum'))) > 0 AS sc FROM w)
       SELECT doc_id, i AND NOT st AS a, i OR sc AS b FROM s WHERE i OR st OR sc""",
)
def tsquery_match(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)idiot|stupid|scum")).select("doc_id", p.tsvector(F.col("text")).alias("v"))
    v = F.col("v")
    d = d.where(p.tsquery(v, "idiot | stupid | scum:*"))
    return d.select("doc_id", p.tsquery(v, "idiots & !stupid").alias("a"), p.tsquery(v, "(idiot | scum:*)").alias("b"))


@query(
    "ts_rank",
    rf"""SELECT doc_id, round((list_sum(list_transform(range(1, a + 1), lambda i: 0.1 / (i * i))) * 1.0 + coalesce(list_sum(list_transform(range(1, b + 1), lambda i: 0.1 / (i * i))), 0)) / 2, 6) AS rank
       FROM (SELECT doc_id, len(list_filter(ws, lambda x: x IN ('idiot', 'idiots'))) AS a, len(list_filter(ws, lambda x: x = 'stupid')) AS b FROM (SELECT doc_id, {_WORDS} AS ws FROM documents) t) u WHERE a > 0""",
)
def ts_rank(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)idiot")).select("doc_id", p.tsvector(F.col("text")).alias("v"))
    return d.where(p.tsquery(F.col("v"), "idiot")).select("doc_id", F.round(p.ts_rank(F.col("v"), ["idiot", "stupid"]), 6).alias("rank"))


@query("ts_headline", r"SELECT doc_id, regexp_replace(text, '(?i)\b(idiot|scum)\b', '<b>\1</b>', 'g') AS h FROM documents WHERE regexp_matches(text, '(?i)\b(idiot|scum)\b')")
def ts_headline(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?i)\b(idiot|scum)\b"))
    return d.select("doc_id", p.headline(F.col("text"), ["idiot", "scum"]).alias("h"))


@query("stem_words", "SELECT w, s FROM (VALUES ('cats', 'cat'), ('running', 'runn'), ('parties', 'party'), ('glass', 'glass'), ('walked', 'walk'), ('quickly', 'quick'), ('is', 'is'), ('boxes', 'box')) t(w, s)")
def stem_words(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("cats", "running", "parties", "glass", "walked", "quickly", "is", "boxes")], "w string")
    return words.select("w", p.stem(F.col("w")).alias("s"))


sql(
    "regexp_split_table",
    r"SELECT p_partkey, pos + 1 AS ord, part FROM part LATERAL VIEW posexplode(split(p_type, '\\s+')) t AS pos, part",
    r"SELECT p_partkey, generate_subscripts(a, 1)::INT AS ord, unnest(a) AS part FROM (SELECT p_partkey, regexp_split_to_array(p_type, '\s+') AS a FROM part) t",
)
sql(
    "regexp_positions",
    "SELECT c_custkey, regexp_instr(c_name, '[1-9]') AS at, regexp_substr(c_name, '[1-9]+') AS first, regexp_count(c_name, '[0-9]') AS n FROM customer",
    "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[1-9]') THEN instr(c_name, regexp_extract(c_name, '[1-9]')) ELSE 0 END::INT AS at, nullif(regexp_extract(c_name, '[1-9]+'), '') AS first, len(regexp_extract_all(c_name, '[0-9]'))::INT AS n FROM customer",
)
sql("encode_escape", r"SELECT n_nationkey, replace(concat(n_name, '\\', n_regionkey), '\\', '\\\\') AS e FROM nation", r"SELECT n_nationkey, replace(n_name || '\' || n_regionkey, '\', '\\') AS e FROM nation")
sql("to_ascii", r"SELECT doc_id, regexp_replace(translate(text, 'éèêëáàâäíìîïóòôöúùûüñçÉÈÊËÁÀÂÄÍÌÎÏÓÒÔÖÚÙÛÜÑÇ', 'eeeeaaaaiiiioooouuuuncEEEEAAAAIIIIOOOOUUUUNC'), '[^\\x00-\\x7F]', '?') AS t FROM documents", r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '?', 'g') AS t FROM documents")
