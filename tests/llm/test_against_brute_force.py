"""Registered queries against oracles, the libraries themselves and brute force on the smallest tables."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, exact_dedup, ngram_join, packing, pii, queries, sharding, toxicity
from sparkloom.llm.runtime import written


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, spark, sf_dir):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = c.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.astype(str).to_numpy())) == sorted(map(tuple, want.astype(str).to_numpy()))


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(texts):
    ids, sets = list(texts), [shingle_set(t) for t in texts.values()]
    posts = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            posts[g].append(k)
    shared = collections.Counter((a, b) for p in posts.values() for i, a in enumerate(p) for b in p[i + 1 :])
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            up[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, i in enumerate(ids)}


def test_jaccard_components(spark, sf_dir, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_join(spark, sf_dir).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("light", [1, 64])
def test_jaccard_of_chains_and_crowds(spark, monkeypatch, light):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        words = list(base)
        for p in rng.choice(60, rng.integers(0, 5), replace=False):
            words[p] = f"x{rng.integers(0, 40)}"
        texts[i] = " ".join(words)
    for i in range(60, 90):  # a chain: each drops one word more
        texts[i] = " ".join(f"c{j}" for j in range(i - 60, i - 10))
    texts[90], texts[91] = texts[70], None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == brute_components(texts)


def test_packing(spark, sf_dir, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op3_packing(spark, sf_dir).toPandas()
    by = {i: g.sort_values("piece") for i, g in rows.groupby("doc_id")}
    total = 0
    for i, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        own = by[i]
        assert own["piece"].tolist() == list(range(-(-len(ids) // 4096)))
        for r in own.itertuples():
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096
    assert rows["sequence_id"].nunique() <= -(-total // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 60))
def test_fullest_room_by_all_subsets(counts, room):
    sums = {0}
    for x, c in counts.items():
        sums = {s + x * k for s in sums for k in range(c + 1) if s + x * k <= room}
    found = packing.fullest(room, counts)
    assert sum(x * n for x, n in found) == max(sums) and all(n <= counts[x] for x, n in found)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_places_every_piece_once(histogram):
    made = packing.plan(histogram, 50)
    placed = collections.Counter()
    for combination, times in made:
        assert sum(x * n for x, n in combination) <= 50
        for x, n in combination:
            placed[x] += n * times
    assert placed == collections.Counter(histogram)


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, sf_dir, texts, coder):
    rows = {r["doc_id"]: r for r in queries.op5_byte_bpe(spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = coder.encode_ordinary(text or "")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


_REPLAY = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("aábnt he'1 \n", max_size=80), max_size=6))
def test_replay_equals_the_library(coder, texts):
    if not _REPLAY:
        ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
        _REPLAY["x"] = bpe.Replay(ranks), bpe.Splitter(public_tokenizers.PATTERN, bpe.odd_characters()), bpe.Recent(bpe.KEEP)
    for text, (n, ids, data) in zip(texts, bpe.encode_block(texts, *_REPLAY["x"]), strict=True):
        want = coder.encode_ordinary(text)
        assert ids == ",".join(map(str, want)) and n == len(want) and data == text.encode()


def test_decode_round_trip(spark, sf_dir, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    back = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN, keep_ids=True), path).collect()
    assert len(back) == 50 and all(bytes(r["data"]).decode() == (texts[r["doc_id"]] or "") for r in back)


def test_token_counts(spark, sf_dir, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op10_token_counts(spark, sf_dir).collect()}
    for i, text in texts.items():
        n = len(sp.encode(text or ""))
        assert got[i] == (len((text or "").encode()), n, n > 4096)


def place(key, node):
    """The tree's choice with the hash library itself."""
    while node.children:
        live = [c for c in node.children if c.load() > 0]

        def draw(c):
            h = xxhash.xxh64(c.name.encode(), seed=xxhash.xxh64(key.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
            return -np.log(((h >> 11) + 0.5) / 2.0**53) / c.load()

        node = min(live, key=draw) if len(live) > 1 else live[0]
    return node.shard


def test_sharding(spark, sf_dir, texts):
    rows = queries.op7_sharding(spark, sf_dir).collect()
    root = sharding.tree(16)
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == place(r["doc_id"], root) and r["grown_shard"] == place(r["doc_id"], sharding.grow(root))
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_weights_move_keys_only_where_they_change(spark):
    ids = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(ids, sharding.tree(16)).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(ids, sharding.tree(16, weights={5: 3.0})).collect()}
    counts = collections.Counter(b.values())
    assert counts[5] > 2 * np.median([counts[s] for s in range(16)])
    assert all(b[k] // 8 == 0 for k in a if a[k] // 8 == 0)  # nothing leaves the region that grew


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def test_pii(spark, sf_dir, texts):
    rng = np.random.default_rng(3)
    odd = {10**6 + i: "".join(rng.choice(list("a1.@+-4 (0)é9b_%\n"), 200)) for i in range(200)}
    odd |= {2 * 10**6: "a@b.c_d@e.f 00012.1.1.1 1.2.3.4.5.256.1.1 4111 1111-1111 1111", 2 * 10**6 + 1: "a" * 20000 + "@", 2 * 10**6 + 2: "1 " * 5000, 2 * 10**6 + 3: "a@" + "b.c" * 5000}
    extra = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(extra)
    every = texts | odd
    for r in pii.spans_of(docs).collect():
        spans = base_spans(every[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]


def test_toxicity_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op8_toxicity(spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count() and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows["doc_id"]]).all()
    held = rows[rows["held_out"]].merge(labels, on="doc_id")
    assert (held["predicted"] == held["toxic"]).mean() >= 0.95


def test_pipeline_by_brute_force(spark, sf_dir, texts):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    stage = {}
    for name, f in corpus_pipeline.STAGES:
        docs = stage[name] = written(f(spark, docs, sf_dir), "test-pipeline")
    ids = lambda name: {r["doc_id"] for r in stage[name].collect()}
    assert ids("toxicity") == texts.keys() - bad
    last = {}
    for i in sorted(ids("toxicity")):
        last[texts[i]] = i
    assert ids("exact_dedup") == set(last.values())
    left = {i: texts[i] for i in ids("exact_dedup")}
    assert ids("ngram_jaccard_join") == {c for _, c in brute_components(left).values()}
    clean = {r["doc_id"]: r for r in stage["pii"].collect()}
    assert clean.keys() == ids("ngram_jaccard_join")
    assert all(r["n_chars"] == len(r["text"]) and not PATTERNS["email"].search(r["text"]) for r in clean.values())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = collections.Counter()
    for r in stage["best_fit_packing"].collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == {i: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in clean.items()}
