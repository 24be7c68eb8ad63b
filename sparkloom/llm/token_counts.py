"""Token counts through a digest cache.

The cache is a Parquet table of (tokenizer version, content digest, n_tokens), partitioned by version; the version is the
digest of the tokenizer's file. Counting joins the digests of the texts to it, encodes each distinct text that it lacks
once, and appends those counts. Texts that a fixed-size filter proves to be distinct misses are encoded where they were
read and have their counts at once. Of texts with copies one is dealt out by digest and id and encoded; the rows of copies,
without texts, get the counts by digest, where digests of more than one row in 256 meet a broadcast of those few counts.

Defined results. A null text is an empty text (0 bytes, 0 tokens). Repeated rows and null ids each get their row. An empty
table gives an empty result and appends nothing. Content is taken as it is: texts count as one only if they are identical.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import HOT, Filter, join_hot, maybe_in
from .runtime import drop, ship, tidy, work_dir, written

_CACHE = "version string, digest binary, n_tokens long"
#: Characters that go to the library in one call.
SLICE = 1 << 18
#: Digests that a task remembers as encoded.
SEEN = 1 << 16


def counter(model: bytes, kind: str):
    """A function from texts to token counts."""
    if kind == "model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(model.decode("utf-8"))
    t.no_padding()
    t.no_truncation()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def _encode(sent, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = None, set()
        for batch in batches:
            digests, first, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            if len(seen) > SEEN:
                seen.clear()
            # a digest of several rows may come from several rows of one id: once is enough
            todo = [i for i, k in enumerate(digests) if not first[i] or k not in seen and not seen.add(k)]
            counts, part, size = [], [], 0
            for i in todo:
                part.append(texts[i].as_py())
                size += len(part[-1])
                if size > SLICE:
                    count = count or counter(sent.value, kind)
                    counts += count(part)
                    part, size = [], 0
            if part:
                count = count or counter(sent.value, kind)
                counts += count(part)
            at = pa.array(todo, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:4]), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "digest", "shared", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. cache_path: None for a new cache in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = f.read()  # a vocabulary file: its size doesn't depend on the data
    version = hashlib.sha256(model).hexdigest()
    sent = spark.sparkContext.broadcast(model)
    cache_path = cache_path or work_dir(spark, "token-cache")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    doc_id, digest, n_bytes = docs[id_col].cast("long"), F.unhex(F.sha2(text, 256)), F.octet_length(text).cast("long")
    keyed = written(docs.select(doc_id.alias("doc_id"), digest.alias("digest"), n_bytes.alias("n_bytes")), "token-keys")
    spark.createDataFrame([], _CACHE).write.mode("append").partitionBy("version").parquet(cache_path)
    stored = lambda: spark.read.schema(_CACHE).parquet(cache_path).where(F.col("version") == version).select("digest", "n_tokens")
    distinct = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    known = stored().select("digest").distinct().withColumn("known", F.lit(True))
    state = written(distinct.join(known, "digest", "left"), "token-state")
    several = state.where("n > 1 or known")
    held = Filter(several, "digest")
    shared = held.may_hold(digest)
    # rows of shared digests that are encoded: the first of each digest that the cache lacks; and distinct misses that the filter took for shared
    firsts = several.where("known is null").select("digest", "doc_id", F.lit(True).alias("shared"))
    mistaken = state.where("n = 1 and known is null").where(held.may_hold(F.col("digest"))).select("digest", "doc_id", F.lit(False).alias("shared"))
    todo = written(firsts.unionByName(mistaken), "token-todo")
    asked = maybe_in(todo.select(F.xxhash64("digest", "doc_id").alias("k")), "k", F.xxhash64(digest, doc_id))
    rows = docs.select(doc_id.alias("doc_id"), n_bytes.alias("n_bytes"), digest.alias("digest"), text.alias("body"), shared.alias("maybe"), asked.alias("asked"))
    alone = rows.where("not maybe").select("doc_id", "n_bytes", "digest", F.lit(False).alias("shared"), "body")
    t = todo.withColumnsRenamed({"digest": "d", "doc_id": "i"})
    dealt = rows.where("maybe and asked").join(t, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "n_bytes", "digest", "shared", "body")
    found = alone.unionByName(dealt).mapInArrow(tidy(_encode(sent, "model" if model_path.endswith(".model") else "json")), "doc_id long, n_bytes long, digest binary, shared boolean, n_tokens long")
    found = written(found, "token-found")
    found.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(cache_path)
    drop(todo)
    sent.destroy()
    # distinct misses have their counts; the others get them by digest
    counts = stored().join(several.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    hot = several.where(F.col("n") * HOT > keyed.agg(F.count(F.lit(1)).alias("n")).scalar())  # fewer than HOT digests
    copies = join_hot(keyed.where(held.may_hold(F.col("digest"))), counts, ["digest"], hot=hot)
    every = found.where("not shared").select("doc_id", "n_bytes", "n_tokens").unionByName(copies.select("doc_id", "n_bytes", "n_tokens"))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)
