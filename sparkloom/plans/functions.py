"""Scalar functions: strings, numbers, vectors, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from .registry import load, query, sql

# ---- strings

sql("str_concat", "SELECT o_orderkey, concat_ws('', o_orderstatus, nullif(o_orderpriority, '5-LOW'), '!') AS c, concat_ws('-', o_orderstatus, nullif(o_orderstatus, 'F')) AS w FROM orders", "SELECT o_orderkey, concat(o_orderstatus, nullif(o_orderpriority, '5-LOW'), '!') AS c, concat_ws('-', o_orderstatus, nullif(o_orderstatus, 'F')) AS w FROM orders")
sql("str_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(octet_length(text) AS BIGINT) AS b, CAST(bit_length(text) AS BIGINT) AS t FROM documents", "SELECT doc_id, length(text)::BIGINT AS n, strlen(text)::BIGINT AS b, bit_length(text)::BIGINT AS t FROM documents")


@query("str_left_right", "SELECT p_partkey, left(p_name, 3) AS a, left(p_name, -3) AS b, right(p_name, 3) AS c, right(p_name, -3) AS d, reverse(p_name) AS r FROM part")
def str_left_right(spark, sf_dir):
    n = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", text.left(n, 3).alias("a"), text.left(n, -3).alias("b"), text.right(n, 3).alias("c"), text.right(n, -3).alias("d"), F.reverse(n).alias("r"))


sql("str_case", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, initcap(lower(c_mktsegment)) AS i FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i FROM customer")
sql(
    "str_split_part",
    "SELECT c_custkey, split_part(c_name, '#', 2) AS p, substring(c_name, 3, 4) AS s, position('#' IN c_name) AS at, overlay(c_name PLACING 'XX' FROM 2 FOR 3) AS o, replace(c_name, '0', 'o') AS r FROM customer",
    "SELECT c_custkey, split_part(c_name, '#', 2) AS p, substring(c_name, 3, 4) AS s, strpos(c_name, '#')::INTEGER AS at, c_name[1:1] || 'XX' || c_name[5:] AS o, replace(c_name, '0', 'o') AS r FROM customer",
)
sql("str_translate", "SELECT c_custkey, translate(c_mktsegment, 'AEIO', '4310') AS t FROM customer")
sql("str_pad", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '.') AS r, trim(BOTH 'N' FROM n_name) AS b, repeat(left(n_name, 1), 3) AS p, ascii(n_name) AS a, chr(65 + n_nationkey) AS c FROM nation", "SELECT n_nationkey, lpad(n_name, 12, '*') AS l, rpad(n_name, 12, '.') AS r, trim(n_name, 'N') AS b, repeat(left(n_name, 1), 3) AS p, ascii(n_name) AS a, chr(65 + n_nationkey) AS c FROM nation")
sql("str_format", "SELECT n_nationkey, format_string('%s is %05d of %.2f', n_name, n_nationkey, CAST(n_regionkey AS DOUBLE)) AS f FROM nation", "SELECT n_nationkey, printf('%s is %05d of %.2f', n_name, n_nationkey, n_regionkey::DOUBLE) AS f FROM nation")


@query("quote_literal", "SELECT n_nationkey, '''' || replace('it''s ' || n_name, '''', '''''') || '''' AS q, coalesce('''' || nullif(n_name, 'NATION_1') || '''', 'NULL') AS n FROM nation")
def quote_literal(spark, sf_dir):
    name = F.col("n_name")
    return load(spark, sf_dir, "nation").select("n_nationkey", text.quote_literal(F.concat(F.lit("it's "), name)).alias("q"), text.quote_nullable(F.nullif(name, F.lit("NATION_1"))).alias("n"))


sql("encode_hex_b64", "SELECT n_nationkey, lower(hex(encode(n_name, 'UTF-8'))) AS h, base64(encode(n_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS d FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(n_name::BLOB) AS b, n_name AS d FROM nation")
sql("hash_md5_sha", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, sha1(c_name) AS o FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, sha1(c_name) AS o FROM customer")
sql(
    "digest",
    "SELECT doc_id, sha2(text, 256) AS s, decode(aes_decrypt(aes_encrypt(encode(lang, 'UTF-8'), encode('0123456789abcdef', 'UTF-8')), encode('0123456789abcdef', 'UTF-8')), 'UTF-8') AS back FROM documents",
    "SELECT doc_id, sha256(text) AS s, lang AS back FROM documents",
)
sql(
    "regexp_ops",
    r"""SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#(0*)([1-9][0-9]*)', 3) AS x, regexp_replace(c_name, '0+', '-') AS r, regexp_count(c_name, '0') AS n, regexp_like(c_name, '[0-9]{3}') AS k,
       size(split(c_name, '0')) AS parts, array_join(regexp_extract_all(c_name, '([1-9])', 1), '') AS all FROM customer""",
    r"""SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#(0*)([1-9][0-9]*)', 3) AS x, regexp_replace(c_name, '0+', '-', 'g') AS r, len(regexp_extract_all(c_name, '0'))::INTEGER AS n, regexp_matches(c_name, '[0-9]{3}') AS k,
       len(string_split(c_name, '0'))::INTEGER AS parts, array_to_string(regexp_extract_all(c_name, '([1-9])', 1), '') AS all FROM customer""",
)


@query("regexp_replace_first", "SELECT c_custkey, regexp_replace(c_name, '0', 'Z') AS r FROM customer")
def regexp_replace_first(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", text.replace_first(F.col("c_name"), "0", "Z").alias("r"))


@query("normalize_nfc", "SELECT doc_id, nfc_normalize(text) AS t FROM documents")
def normalize_nfc(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.normalize_nfc(F.col("text")).alias("t"))


sql("to_char_fmt", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS d, format_number(o_custkey, 0) AS n, trim(to_char(CAST(o_orderkey AS DECIMAL(10,0)) + 1, '9999999')) AS k FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS d, format('{:,}', o_custkey) AS n, (o_orderkey + 1)::VARCHAR AS k FROM orders")
sql("input_is_valid", "SELECT n_nationkey, try_cast(substring(n_name, 8, 3) AS INT) IS NOT NULL AS i, try_cast(n_name AS DATE) IS NOT NULL AS d FROM nation", "SELECT n_nationkey, try_cast(substring(n_name, 8, 3) AS INT) IS NOT NULL AS i, try_cast(n_name AS DATE) IS NOT NULL AS d FROM nation")
sql("levenshtein", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name) AS d, CASE WHEN levenshtein(a.n_name, b.n_name, 2) < 0 THEN 3 ELSE levenshtein(a.n_name, b.n_name, 2) END AS capped FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS d, least(levenshtein(a.n_name, b.n_name), 3)::INTEGER AS capped FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")


@query("levenshtein_weighted")
def levenshtein_weighted(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select("n_nationkey", text.weighted_levenshtein(F.col("n_name"), F.lit("NATION"), F.lit(2), F.lit(1), F.lit(3)).alias("d"))


@query("soundex")
def soundex(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.soundex("c_mktsegment").alias("s"), text.difference(F.col("c_mktsegment"), F.lit("BILDING")).alias("d"))


GRAMS = """SELECT k, n, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS g
  FROM (SELECT min(p_partkey) AS k, count(*) AS n, p_name || ' ' || p_type AS t FROM part GROUP BY t)"""


@query(
    "trgm_similarity",
    f"""WITH c AS ({GRAMS}), e AS (SELECT k, unnest(g) AS x FROM c), p AS (SELECT a.k AS a, b.k AS b, count(*) AS o FROM e a JOIN e b ON a.x = b.x AND a.k < b.k GROUP BY a.k, b.k)
        SELECT a, b, ca.n AS a_rows, cb.n AS b_rows, round(o / (len(ca.g) + len(cb.g) - o), 6) AS s FROM p JOIN c ca ON ca.k = a JOIN c cb ON cb.k = b WHERE o / (len(ca.g) + len(cb.g) - o) >= 0.7""",
)
def trgm_similarity(spark, sf_dir):
    """Similar texts of all parts: one row a pair of different texts, each named by its smallest key, with the rows that have it."""
    t = load(spark, sf_dir, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("t")).agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("n"))
    x, y = t.select(F.col("k").alias("a"), F.col("n").alias("a_rows"), F.col("t").alias("an")), t.select(F.col("k").alias("b"), F.col("n").alias("b_rows"), F.col("t").alias("bn"))
    return text.similarity_join(x, y, "an", "bn", 0.7).where("a < b").select("a", "b", "a_rows", "b_rows", F.round("similarity", 6).alias("s"))


@query("unaccent", "SELECT doc_id, replace(strip_accents(text), 'ß', 'ss') AS t FROM documents")
def unaccent(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.unaccent(F.col("text")).alias("t"))


WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("fts_match", f"SELECT doc_id, list_contains({WORDS}, 'idiot') AS one, list_contains({WORDS}, 'stupid') OR list_contains({WORDS}, 'scum') AS either FROM documents WHERE list_contains({WORDS}, 'idiot') OR list_contains({WORDS}, 'stupid') OR list_contains({WORDS}, 'scum')")
def fts_match(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where(text.matches_any(F.col("text"), ["idiot", "stupid", "scum"]))
    return d.select("doc_id", text.matches_all(F.col("text"), ["idiot"]).alias("one"), text.matches_any(F.col("text"), ["stupid", "scum"]).alias("either"))


@query("fts_rank", f"SELECT doc_id, len(list_filter({WORDS}, lambda w: w IN ('idiot', 'stupid', 'scum'))) AS n FROM documents WHERE len(list_filter({WORDS}, lambda w: w IN ('idiot', 'stupid', 'scum'))) > 0 ORDER BY n DESC, doc_id LIMIT 20")
def fts_rank(spark, sf_dir):
    n = text.term_frequency(F.col("text"), ["idiot", "stupid", "scum"]).cast("long").alias("n")
    return load(spark, sf_dir, "documents").select("doc_id", n).where("n > 0").orderBy(F.desc("n"), "doc_id").limit(20)


# ---- numbers and vectors

sql("int_arith", "SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS q, l_orderkey % 7 AS r, abs(-l_linenumber) AS a, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey % 7 AS r, abs(-l_linenumber) AS a, -l_linenumber AS neg FROM lineitem")
sql("bit_ops", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 5 AS o, c_custkey ^ 9 AS x, ~c_custkey AS n, shiftleft(c_custkey, 2) AS l, shiftright(c_custkey, 1) AS r, bit_count(c_custkey) AS c FROM customer", "SELECT c_custkey, c_custkey & 12 AS a, c_custkey | 5 AS o, xor(c_custkey, 9) AS x, ~c_custkey AS n, c_custkey << 2 AS l, c_custkey >> 1 AS r, bit_count(c_custkey)::INTEGER AS c FROM customer")


@query("gcd_lcm", "SELECT p_partkey, gcd(p_partkey, p_size)::BIGINT AS g, lcm(p_partkey, p_size)::BIGINT AS l FROM part")
def gcd_lcm(spark, sf_dir):
    a, b = F.col("p_partkey"), F.col("p_size").cast("long")
    return load(spark, sf_dir, "part").select("p_partkey", numbers.gcd(a, b).alias("g"), numbers.lcm(a, b).alias("l"))


sql(
    "math_funcs",
    """SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(exp(c_nationkey / 10), 6) AS e, round(ln(c_custkey + 1), 8) AS l, round(power(c_nationkey, 2), 4) AS p,
       round(sin(c_custkey), 8) AS si, round(atan2(c_custkey, 3), 8) AS a, round(cbrt(c_custkey), 8) AS cb, round(degrees(1.5), 6) AS d, CAST(sign(c_acctbal) AS INT) AS g, CAST(factorial(5) AS BIGINT) AS fa FROM customer""",
)
sql("width_bucket", "SELECT c_custkey, width_bucket(c_acctbal, -1000, 10000, 11) AS b FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 12 ELSE floor((c_acctbal + 1000) / 1000) + 1 END::BIGINT AS b FROM customer")
sql("random_normal", "SELECT id, 10 + 2 * randn(7) AS x FROM range(1000)", rows_only=True)
sql("hash_bucket", "SELECT pmod(xxhash64(o_orderkey), 16) AS b, count(*) AS n FROM orders GROUP BY 1", rows_only=True)

Q = "(SELECT vec_id AS q, embedding AS v FROM embeddings WHERE vec_id % 100 = 0)"
for name, column, other in (
    ("vector_l2", "sqrt(aggregate(zip_with(e.embedding, x.v, (a, b) -> pow(CAST(a AS DOUBLE) - b, 2)), 0D, (s, y) -> s + y))", "list_distance(e.embedding::DOUBLE[], x.v::DOUBLE[])"),
    ("vector_l1", "aggregate(zip_with(e.embedding, x.v, (a, b) -> abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE))), 0D, (s, y) -> s + y)", "list_sum(list_transform(range(1, len(x.v) + 1), lambda i: abs(e.embedding[i]::DOUBLE - x.v[i]::DOUBLE)))"),
    ("vector_linf", "array_max(zip_with(e.embedding, x.v, (a, b) -> abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE))))", "list_max(list_transform(range(1, len(x.v) + 1), lambda i: abs(e.embedding[i]::DOUBLE - x.v[i]::DOUBLE)))"),
):
    sql(name, f"SELECT /*+ BROADCAST(x) */ x.q, e.vec_id, round({column}, 5) AS d FROM embeddings e JOIN {Q} x ON e.vec_id <> x.q", f"SELECT x.q, e.vec_id, round({other}, 5) AS d FROM embeddings e JOIN {Q} x ON e.vec_id <> x.q")


@query("geo_distance", "SELECT s_suppkey, round(2 * 6378168.0 * asin(sqrt(least(1.0, sin(radians(48.0 - s_nationkey) / 2) ** 2 + cos(radians(s_nationkey)) * cos(radians(48.0)) * sin(radians(11.0 - (s_suppkey % 90)) / 2) ** 2))), 3) AS m FROM supplier")
def geo_distance(spark, sf_dir):
    d = numbers.haversine(F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 90).cast("double"), F.lit(48.0), F.lit(11.0))
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.round(d, 3).alias("m"))


# ---- dates

sql(
    "extract_fields",
    """SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS INT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS INT) AS q, CAST(extract(MONTH FROM o_orderdate) AS INT) AS mo, CAST(extract(WEEK FROM o_orderdate) AS INT) AS w,
       CAST(extract(DAY FROM o_orderdate) AS INT) AS d, CAST(extract(DOY FROM o_orderdate) AS INT) AS doy, CAST(dayofweek(o_orderdate) - 1 AS INT) AS dow, CAST(timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate) AS BIGINT) AS epoch,
       CAST(floor((year(o_orderdate) + 99) / 100) AS INT) AS century, CAST(floor(year(o_orderdate) / 10) AS INT) AS decade FROM orders""",
    """SELECT o_orderkey, extract(YEAR FROM o_orderdate)::INT AS y, extract(QUARTER FROM o_orderdate)::INT AS q, extract(MONTH FROM o_orderdate)::INT AS mo, extract(WEEK FROM o_orderdate)::INT AS w,
       extract(DAY FROM o_orderdate)::INT AS d, extract(DOY FROM o_orderdate)::INT AS doy, extract(DOW FROM o_orderdate)::INT AS dow, epoch(o_orderdate)::BIGINT AS epoch,
       extract(CENTURY FROM o_orderdate)::INT AS century, extract(DECADE FROM o_orderdate)::INT AS decade FROM orders""",
)
sql("date_trunc_agg", "SELECT CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS m, CAST(CAST(date_trunc('WEEK', o_orderdate) AS DATE) AS STRING) AS w, count(*) AS n FROM orders GROUP BY 1, 2")
sql(
    "date_bin",
    "SELECT CAST(floor((timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) - 150000000) / 900000000) * 900 + 150 AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1",
    "SELECT epoch(time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01 00:02:30'))::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1",
)
sql("make_date", "SELECT n_nationkey, CAST(make_date(2000 + n_nationkey, 1 + n_regionkey, 15) AS STRING) AS d FROM nation")
sql(
    "date_arith",
    "SELECT o_orderkey, CAST(date_add(CAST(o_orderdate AS DATE), 10) AS STRING) AS a, datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS n, CAST(add_months(CAST(o_orderdate AS DATE), 1) AS STRING) AS m FROM orders",
    "SELECT o_orderkey, (o_orderdate::DATE + 10)::VARCHAR AS a, (DATE '2000-01-01' - o_orderdate::DATE)::INTEGER AS n, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE::VARCHAR AS m FROM orders",
)
sql("date_spine", "SELECT CAST(d AS STRING) AS d FROM (SELECT explode(sequence(DATE '2024-01-30', DATE '2024-03-02', INTERVAL 1 DAY)) AS d) t", "SELECT d::DATE::VARCHAR AS d FROM generate_series(TIMESTAMP '2024-01-30', TIMESTAMP '2024-03-02', INTERVAL 1 DAY) t(d)")
