"""Long words in the merge replay, license scans against full alignment, and the classifier against plain loops."""

import base64
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe, licenses, packing, toxicity
from sparkloom.llm.text import plain

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def replay():
    return bpe.Replay(bpe.load_ranks(PATH))


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=40) | st.text("eorstn", min_size=1, max_size=300) | st.binary(max_size=60).map(lambda b: b.decode("latin-1")), max_size=5))
def test_all_occurrences_at_once_give_the_ids_of_one_by_one(replay, coder, words):
    words = [w.encode() for w in words]
    assert replay.encode(words) == [tuple(coder._core_bpe.encode_single_piece(w)) if w else () for w in words]


def test_a_word_of_a_million_letters(replay, coder):
    rng = np.random.default_rng(1)
    for word in (b"x" * 1_000_000, b"ab" * 500_000, bytes(rng.choice(np.frombuffer(b"etaoinshr", np.uint8), 1_000_000))):
        began = time.time()
        ids = replay.encode([word])[0]
        assert time.time() - began < 60 and replay.decode(ids) == word
    piece = bytes(rng.choice(np.frombuffer(b"etaoinshr", np.uint8), 20_000))
    assert replay.encode([piece])[0] == tuple(coder._core_bpe.encode_single_piece(piece))


def by_full_alignment(text, index, least):
    """Every template at every diagonal."""
    raw, off = plain(pa.array([text]))
    words = licenses.word_hashes(raw, off)[0]
    found = []
    for t, template in enumerate(index.words):
        for shift in range(-len(template), len(words) + 1):
            a, b = max(0, shift - licenses.BAND), min(len(words), shift + len(template) + licenses.BAND + 1)
            n, start, end = licenses.align(template, words[a:b].tolist(), shift - a) if a < b else (0, 0, 0)
            if n >= least * len(template):
                found.append((index.names[t], n, len(template), a + start, a + end))
    out = []
    for m in sorted(found, key=lambda m: (-m[1], -m[1] / m[2], m[0], m[3])):
        if all(m[4] < o[3] or m[3] > o[4] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: m[3])


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        p = int(rng.integers(0, len(words)))
        kind = rng.integers(0, 3)
        words[p : p + (kind != 0)] = [] if kind == 1 else [f"odd{rng.integers(0, 99)}"]
    return " ".join(words)


def test_scan_equals_full_alignment():
    rng = np.random.default_rng(11)
    # a template of five words has no whole fingerprint left after an edit: it is a match by alignment, but no candidate
    short = {k: v for k, v in licenses.TEMPLATES.items() if 8 <= len(v.split()) < 80}
    index = licenses.Index(short)
    names = sorted(short)
    for _ in range(25):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            parts.append(" ".join(f"w{rng.integers(0, 50)}" for _ in range(int(rng.integers(0, 30)))))
            template = short[names[int(rng.integers(0, len(names)))]]
            parts.append(edited(rng, template, int(rng.integers(0, max(1, len(template.split()) // 20) + 1))))
        text = " ".join(parts)
        raw, off = plain(pa.array([text]))
        got = licenses.scan(licenses.word_hashes(raw, off)[0], index, 0.8)
        want = by_full_alignment(text, index, 0.8)
        assert [(m[0], m[1]) for m in got] == [(m[0], m[1]) for m in want], text


def test_scan_of_documents_equals_full_alignment(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {}
    for r in licenses.license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["matched_words"]))
        assert 0 <= r["start_pos"] < r["end_pos"] <= len(texts[r["doc_id"]])
    index = licenses.Index(licenses.TEMPLATES)
    some = sorted(got)[:6] + [i for i in sorted(texts) if i not in got and len(texts[i].split()) < 60][:10]
    for i in some:
        if len(texts[i].split()) < 400:
            want = [(m[0], m[1]) for m in by_full_alignment(texts[i], index, 0.8) if m[1] == m[2] or m[2] >= 8]
            assert sorted(got.get(i, [])) == sorted(want)


def test_whole_license_texts_win_over_their_notices(spark):
    text = "Copyright (c) someone\n\n" + licenses.TEMPLATES["MIT-text"].replace("Software", "software") + "\nint main;"
    many = "\n".join([licenses.TEMPLATES["MIT"]] * 300)
    got = licenses.license_matches(spark.createDataFrame([(1, text), (2, many)], "doc_id long, text string")).collect()
    assert [(r["license"], r["coverage"]) for r in got if r["doc_id"] == 1] == [("MIT-text", 1.0)]
    assert [r["license"] for r in got if r["doc_id"] == 2] == ["MIT"] * 300


def small_model(seed=3):
    model = toxicity.Model(seed)
    rng = np.random.default_rng(seed)
    model.embed = rng.normal(0, 1, model.embed.shape).astype(np.float64)
    model.filters = [f.astype(np.float64) for f in model.filters]
    return model, rng


def logit_by_loops(model, buckets):
    """One text: every filter at every word, or once if there is none, with empty words behind them."""
    words = [sum(model.embed[b] for b in row) for row in buckets] + [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    out = []
    for f in model.filters:
        best = [-np.inf] * toxicity.FILTERS
        for p in range(max(1, len(buckets))):
            y = sum(words[p + j] @ f[j] for j in range(len(f)))
            best = [max(a, b) for a, b in zip(best, y, strict=True)]
        out += best
    return float(np.dot(out, model.out) + model.bias)


def test_forward_pass_equals_plain_loops():
    model, rng = small_model()
    rows = [rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.uint32) for n in (0, 1, 2, 7, 40)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = model.logits(np.concatenate(rows), first)
    assert np.allclose(got, [logit_by_loops(model, r) for r in rows], rtol=1e-4, atol=1e-4)
    alone = [model.logits(r, np.array([0, len(r)]))[0] for r in rows]
    assert np.allclose(got, alone, rtol=1e-5, atol=1e-5)  # a score doesn't depend on the rows beside it


def test_training_follows_the_numeric_gradient():
    """The first step of Adam moves each number against the sign of its gradient: compared with finite differences."""
    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 40, (int(rng.integers(3, 9)), 4)).astype(np.uint32) for _ in range(40)]
    y = np.array([int(r[:, 0].min() < 8) for r in rows])
    if not 0 < y.sum() < len(y):
        pytest.skip("one kind only")
    before, after = toxicity.Model(7), toxicity.train(rows, y, epochs=1, rate=1e-4)
    order = np.random.default_rng(7).permutation(len(rows))
    fit = order[len(rows) // 5 :]
    toxicity.start_from_log_odds(before, [rows[i] for i in fit], y[fit])
    weight = np.where(y == 1, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, (1 - y[fit]).sum())) * len(fit)

    def loss(model):
        first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in fit])])
        z = model.logits(np.concatenate([rows[i] for i in fit]), first).astype(np.float64)
        return float((weight[fit] * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y[fit] * z)).mean())

    for which in ("out", 0, 1, 2):
        value = before.out if which == "out" else before.filters[which]
        moved = (after.out if which == "out" else after.filters[which]) - value
        checked = 0
        for i in np.ndindex(value.shape):
            keep = value[i]
            value[i] = keep + 2e-3
            up = loss(before)
            value[i] = keep - 2e-3
            down = loss(before)
            value[i] = keep
            slope = (up - down) / 4e-3
            if abs(slope) > 5e-3:
                checked += 1
                assert np.sign(moved[i]) == -np.sign(slope), (which, i, slope, moved[i])
        assert checked


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    data = open(path, encoding="utf-8").read()
    assert not packing.goes_by_word(data) and packing.goes_by_word(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    texts = ["Two  words, and\nmore.", "", "É"]
    want = [e.ids for e in Tokenizer.from_str(data).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.WordIds(data).encode(texts)] == want
