"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from sparkloom.llm import bpe, exact_dedup, licenses, ngram_join, packing, pii, sharding, token_counts, topk, toxicity
from sparkloom.llm.runtime import written

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "word another third " * 4000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, "the quick brown fox jumps over the lazy dog", None),
    (4, "the quick brown fox jumps over the lazy dog", None),
    (None, "mail me at a.b@c.de or +1 (234) 567-8901", "en"),
    (7, LONG, "en"),
    (8, "x" * 30000, "de"),
    (9, "é ü\n\t¿", "es"),
    (10, LONG + " tail", "en"),
]
#: Names that the operators use inside.
CLASHES = ["digest", "n", "class", "token", "component", "part", "rank", "row", "i", "h", "body", "keep_id"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("z").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "dedup": lambda d: exact_dedup.exact_dedup(d),
    "shard": lambda d: sharding.shard(d),
    "jaccard": lambda d: ngram_join.jaccard_components(d),
    "bpe": lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN),
    "counts": lambda d: token_counts.count_tokens(d, PIECES),
    "pii": lambda d: pii.spans_of(d),
    "toxicity": lambda d: toxicity.score(d, None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_a_row(name, docs):
    got = OPERATORS[name](docs)
    assert got.count() == len(ROWS)
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_stages_keep_columns(spark, docs, labels):
    model = toxicity.fit(docs, labels)
    for stage in (lambda d: toxicity.keep_clean(d, model), exact_dedup.keep_first, ngram_join.keep_one, pii.sanitise):
        assert stage(docs).columns == docs.columns
        assert stage(docs.where("false")).count() == 0


def test_packing_and_licenses_take_anything(docs):
    packed = packing.pack(packing.token_pieces(docs, WORD))
    assert packed.where("piece = 0").count() == len(ROWS)
    empty = docs.where("false")
    assert packing.pack(packing.token_pieces(empty, WORD)).count() == 0
    assert licenses.license_matches(docs).count() == 0 and licenses.license_matches(empty).count() == 0


def test_dedup_keeps_the_largest_id_and_one_of_repeated_rows(docs):
    rows = exact_dedup.exact_dedup(docs).collect()
    fox = [r for r in rows if r["text_sha256"] == hashlib.sha256(ROWS[0][1].encode()).hexdigest()]
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in fox) == [(1, 4, 3, False), (4, 4, 3, False), (4, 4, 3, True)]
    empty = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"], r["kept"]) for r in empty) == [(2, False), (3, True)]
    assert exact_dedup.keep_first(docs).count() == 7


def test_dedup_compares_bytes_where_digests_meet(docs):
    weak = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1))
    strong, poor = (sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, digest=d).collect()) for d in (exact_dedup.sha256_digest, weak))
    assert strong == poor
    assert exact_dedup.keep_first(docs, digest=weak).count() == 7


def test_jaccard_groups_and_leftovers(docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert {(1, 5, 1), (4, 5, 1), (2, 0, 2), (3, 0, 3), (8, 1, 8), (9, 1, 9), (7, 3, 7)} <= got
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "10", "2", "3", "7", "8", "9", "None"]


def test_pii_is_generalised(docs):
    row = pii.sanitise(docs).where("doc_id is null").first()
    assert row["text"] == "mail me at [EMAIL] or [PHONE]"
    assert pii.sanitise(docs).where("doc_id = 2").first()["text"] is None


def test_terms_that_give_an_entity_away_go(spark):
    rows = [(i, f"w{i}a w{i}b some words falconry mail boss@corp.example about w{i}c w{i}d and more w{i}e") for i in range(8)]
    rows += [(100 + i, f"some words about mail and more things of day {i} without anything else in them at all") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.spans_of(docs).collect()}
    at = rows[0][1].index("falconry")
    assert f"term:{at}:{at + 8}" in spans[0] and "term" not in spans[100]
    assert "falconry" not in " ".join(r["text"] for r in pii.sanitise(docs).collect())
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(20)], "doc_id long, text string")
    assert all("term" not in r["spans"] for r in pii.spans_of(copies).collect())


def test_a_term_that_stands_elsewhere_as_often_discloses_nothing(spark):
    rows = [(i, f"w{i}a some boss@corp.example and falconry or boss@corp.example again w{i}b") for i in range(8)]
    rows += [(100 + i, f"falconry on day {i} without any address near it") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = {r["doc_id"]: re.findall(r"term:(\d+):(\d+)", r["spans"]) for r in pii.spans_of(docs).collect()}
    words = {rows[i][1][int(a) : int(b)] for i in range(8) for a, b in marked[i]}
    assert "falconry" not in words and not any(marked[100 + i] for i in range(8))
    assert words == {"some", "and", "again"}  # these stand nowhere else
    near = pii.terms(written(pii.base(docs), "test-pii"))
    assert near.where("term in ('boss', 'corp', 'example')").isEmpty()  # parts of the address itself


def test_terms_by_plain_loops(spark):
    import math

    names, words = ["ann", "bob", "cy"], "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(90):
        who = names[i % 3]
        rest = " ".join(words[(i * k + k) % 10] for k in range(1, 12))
        rows.append((i, f"{rest} {who}nickname wrote {who}@x.org today{i} {rest}" if i % 9 < 6 else f"{rest} {who}nickname" if i % 9 == 7 else rest))
    total, near, seen, weight, contexts = 0, {}, {}, {}, {}
    for i, t in rows:
        spans = base_email(t)
        inside = lambda a, b: any(s < b and a < e for s, e in spans)  # noqa: E731, B023
        found = [(m.group().lower(), *m.span()) for m in re.finditer("[a-z]+", t)]
        total += len(found)
        for w, a, b in found:
            if not inside(a, b):
                seen[w] = seen.get(w, 0) + 1
        for s, e in spans:
            lo, hi = max(0, s - pii.REACH), min(len(t), e + pii.REACH)
            for w, a, b in found:
                if len(w) >= 3 and not inside(a, b) and a >= lo and b <= hi and (a > lo or lo == 0) and (b < hi or hi == len(t)):
                    for c in (f"email:{t[s:e]}", "email"):
                        near.setdefault((c, w), set()).add((i, a))
                        contexts.setdefault((c, w), set()).add(t[lo:s] + "|" + t[e:hi])
                        weight.setdefault(c, set()).add((i, a))
    want = set()
    for (c, w), at in near.items():
        content = -math.log2(min(0.5, len(weight[c]) / total))
        chance = 2.0 ** (-len(contexts[c, w]) * content)
        if chance * total <= pii.ALPHA and 1 + math.log2(min(1.0, len(at) / max(1, seen[w]))) / content >= 0.6:
            want.add((c, w))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = written(pii.base(docs), "test-pii")
    before, pii.DISCLOSURE = pii.DISCLOSURE, 0.6
    try:
        got = {(r["entity"], r["term"]) for r in pii.disclosing(docs, found, written(pii.terms(found), "test-pii")).collect()}
    finally:
        pii.DISCLOSURE = before
    assert want and got == want


def base_email(text):
    return [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_topk_ignores_what_is_not_finite_and_breaks_ties_by_id(spark):
    rows = [(0, [1.0, 0.0]), (5, [1.0, 0.0]), (3, [1.0, 0.0]), (7, [float("nan"), 0.0]), (8, None), (9, [1.0, None]), (None, [1.0, 0.0]), (100, [0.5, 0.5]), (0, [1.0, 0.0]), (200, [float("inf"), 1.0]), (11, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("z"))
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 3, one), (0, 2, 5, one), (0, 3, 100, one // 2), (100, 1, 0, one // 2), (100, 2, 0, one // 2), (100, 3, 3, one // 2)]
    assert topk.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_license_lines_are_found_with_spans(spark):
    text = "Ünder the tree. Released under the MIT  License! more words\nThis work is licensed under the GNU General Public License, version 3."
    df = spark.createDataFrame([(1, text), (2, "released the license under MIT"), (3, None)], "doc_id long, text string")
    got = licenses.license_matches(df).collect()
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in got] == [(1, "MIT", 1.0), (1, "GPL-3.0", 1.0)]
    assert text[got[0]["start_pos"] : got[0]["end_pos"]] == "Released under the MIT  License"


def test_license_with_changed_words_is_aligned(spark):
    words = licenses.TEMPLATES["MIT-notice"].split()
    words[10:10] = ["oh", "well"]
    del words[30]
    got = licenses.license_matches(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).collect()
    assert got[0]["license"] == "MIT-notice" and got[0]["matched_words"] == len(licenses.TEMPLATES["MIT-notice"].split()) - 1


def test_cache_encodes_only_what_it_lacks(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = sorted(map(str, token_counts.count_tokens(docs, PIECES, cache).collect()))
    n = spark.read.parquet(cache).count()
    assert n == docs.select("text").na.fill("").distinct().count()
    assert sorted(map(str, token_counts.count_tokens(docs, PIECES, cache).collect())) == first
    assert spark.read.parquet(cache).count() == n
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "new text"), (51, "new text")], "doc_id long, text string"))
    assert token_counts.count_tokens(more, PIECES, cache).count() == len(ROWS) + 2
    assert spark.read.parquet(cache).count() == n + 1


def test_pipeline_stages_are_the_registered_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None and re.match(r".*", corpus_pipeline.__doc__)


def test_topk_by_brute_force_over_clusters_and_lengths(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (8, 16))
    vectors = {i: (centres[i % 8] + rng.normal(0, 0.1, 16))[: 16 if i % 50 else 7].tolist() for i in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    table = topk.found(df, F.col("vec_id") % 100 == 0, k=5)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 100 == 0, k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    whole = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in vectors.items()}
    for q in range(0, 3000, 100):
        scores = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q and len(x) == len(whole[q]))[:5]
        assert sorted(got[q]) == [(n, -s, i) for n, (s, i) in enumerate(scores, 1)]
    few = {r["query_id"]: r["evaluated"] for r in topk.evaluated(table).collect()}
    assert all(few.get(q, 0) <= 3000 for q in range(0, 3000, 100))


def test_topk_bounds_are_never_below_a_score():
    import numpy as np

    rng = np.random.default_rng(8)
    for n, m, dim in ((40, 5, 12), (30, 48, 9), (20, 1, 4), (20, 0, 4)):
        x = rng.integers(-900, 900, (n, dim))
        x[3], x[4] = x[5], 0
        pivots = topk.choose_pivots(x, m)
        at, rest = topk.Space(pivots).place(topk.distances(x, pivots), (x.astype(float) ** 2).sum(axis=1))
        bound, score = at @ at.T + np.outer(rest, rest), x @ x.T
        norm = np.diag(score).astype(float)
        assert (bound + 1e-6 * (norm[:, None] + norm[None, :]) + 0.5 >= score).all()
        for p in pivots:  # the distance's bound is never below that of a single pivot
            d = np.linalg.norm(x - p, axis=1)
            lower = np.sqrt(np.maximum(norm[:, None] + norm[None, :] - 2 * bound, 0))
            assert (lower + 1e-3 >= np.abs(d[:, None] - d[None, :])).all()


def test_topk_of_vectors_that_are_all_zero(spark):
    df = spark.createDataFrame([(i, [0.0, 0.0]) for i in (0, 1, 2, 100)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 100 == 0, k=2).collect()}
    assert got == {(0, 1, 1, 0), (0, 2, 2, 0), (100, 1, 0, 0), (100, 2, 1, 0)}
