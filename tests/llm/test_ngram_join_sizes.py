"""Linked pairs of unequal sizes: one text is the other plus more words."""

import pytest

from sparkloom.llm import ngram_join


@pytest.mark.parametrize("light", [1, 64])
def test_a_text_and_the_same_with_more_words_are_linked(spark, monkeypatch, light):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    texts, want = {}, {}
    for k, (n, more) in enumerate([(100, 9), (100, 10), (100, 17), (100, 25), (100, 26), (400, 100), (20, 5), (20, 6)]):
        base = [f"b{k}x{i}" for i in range(n + 4)]
        added = [f"a{k}x{i}" for i in range(more)]
        texts[2 * k] = " ".join(base)
        texts[2 * k + 1] = " ".join(base + added if k % 2 else added + base)
        want[2 * k] = (n, 2 * k)
        want[2 * k + 1] = (n + more, 2 * k if 100 * n >= 80 * (n + more) else 2 * k + 1)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want
