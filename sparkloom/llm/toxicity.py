"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of four hashed embeddings (the word trimmed of punctuation, and its first 3, 4 and 5 letters). Filters of
1, 2 and 3 words run over every position of the whole text, max pooling keeps each filter's strongest response, and a
logistic layer gives the logit. Training: embeddings start from the log-odds of each bucket among the labelled texts,
then Adam on minibatches, gradients through the pooled positions only. Thresholds are calibrated by language on labelled
rows that training doesn't see, where the language is guessed from the text itself (frequent function words), never read
from a column; the logit is shifted so that a score of 0.5 is the threshold.

Labels come from at most MOST labelled rows (BYTES of features) of the learning folds, taken by a hash of the id; all else
covers all rows.

Defined results. A null or empty text gets the score of no words. Repeated rows and null ids each get a row; a null id is
not held out. Labels that are null or without a document are not used; without labels of both kinds every score is 0.
An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import drop, ship, tidy, written
from .text import pieces, plain, span_hashes, word_bounds

#: Labelled rows of each kind that training takes at most: a documented bound.
MOST = {1: 2500, 0: 4000}
#: Bytes of their features (16 a word) that training takes at most: a documented bound as well.
BYTES = {1: 8 << 20, 0: 12 << 20}
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
PREFIXES = (3, 4, 5)
FOLDS = 5
#: Frequent function words that tell a text's language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with on are as at by this",
    "de": "der die und das den von zu ist mit des auf für nicht ein dem im",
    "fr": "le la les de des et un une du dans est que pour qui par sur",
    "es": "el la los de y en que un una las por con del para se es",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "other")
_TRIM = np.zeros(256, dtype=bool)
_TRIM[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four buckets for each word and each row's first word."""
    starts, ends, first = word_bounds(raw, offsets)
    a, b = starts.copy(), ends.copy()
    out = np.empty((len(a), 1 + len(PREFIXES)), dtype=np.uint32)
    if len(a):
        for _ in range(4):
            a += (b - a > 1) & _TRIM[raw[a]]
            b -= (b - a > 1) & _TRIM[raw[b - 1]]
        letter = (raw & 0xC0) != 0x80  # the first byte of each code point
        places = np.append(np.flatnonzero(letter), len(raw))
        at = np.cumsum(letter)[a] - 1
        to = [b, *(np.minimum(b, places[np.minimum(at + n, len(places) - 1)]) for n in PREFIXES)]
        for k, end in enumerate(to):
            out[:, k] = span_hashes(raw, a, end, seed=k) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return out, first


def language_words() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, LANGUAGES.index(lang)) for lang, text in FUNCTION_WORDS.items() for w in text.split()]
    raw, off = plain(pa.array([" ".join(w for w, _ in words)]))
    return features(raw, off)[0][:, 0], np.array([x for _, x in words])


@functools.cache
def _language_table() -> np.ndarray:
    keys, lang = language_words()
    table = np.zeros((len(LANGUAGES) - 1, BUCKETS), dtype=bool)
    table[lang, keys] = True
    return table


def guess_languages(buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The language whose function words a row has most of; `other` without any."""
    table = _language_table()
    counts = np.zeros((len(first) - 1, len(LANGUAGES) - 1), np.int64)
    for x in range(len(LANGUAGES) - 1):
        total = np.concatenate([[0], np.cumsum(table[x][buckets[:, 0]])])
        counts[:, x] = total[first[1:]] - total[first[:-1]]
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1), len(LANGUAGES) - 1)


class Model:
    """Embeddings, filters, output layer and thresholds."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0.3, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.shift = np.zeros(len(LANGUAGES), np.float32)

    def pooled(self, buckets: np.ndarray, first: np.ndarray, places: bool = False):
        """Max-pooled responses of each row and, if asked for, where they are in the padded sequence."""
        pad = max(WIDTHS)
        count = np.diff(first)
        begin = first[:-1] + pad * np.arange(len(count))  # empty words follow each row, so no filter reads the next one
        taken = np.maximum(count, 1)  # places of a row; one without words has one
        cuts = np.stack([begin, begin + taken], axis=1).ravel()
        x = np.zeros((len(buckets) + pad * len(count), DIM), dtype=np.float32)
        slot = np.arange(len(buckets)) + pad * np.repeat(np.arange(len(count)), count)
        x[slot] = sum(self.embed[buckets[:, c]] for c in range(buckets.shape[1]))
        out, at = [], []
        for f in self.filters:
            y = x @ f[0]
            for j in range(1, len(f)):
                y[:-j] += x[j:] @ f[j]
            top = np.maximum.reduceat(y, cuts, axis=0)[::2] if len(count) else np.zeros((0, FILTERS), np.float32)
            out.append(top)
            if places:
                where = np.empty((len(count), FILTERS), np.int64)
                for r, (a, n) in enumerate(zip(begin, taken, strict=True)):
                    where[r] = a + y[a : a + n].argmax(axis=0)
                at.append(where)
        pool = np.concatenate(out, axis=1)
        return (pool, at, x, slot, begin) if places else pool

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(buckets, first) @ self.out + self.bias

    def scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        shift = self.shift[guess_languages(buckets, first)]
        return 1 / (1 + np.exp(-np.clip(self.logits(buckets, first).astype(np.float64) - shift, -60, 60)))


def start_from_log_odds(model: Model, rows: list[np.ndarray], y: np.ndarray) -> None:
    """Dimension 0 of a bucket: how much more often it occurs in rows of label 1; the first filter of each width reads it."""
    seen = np.zeros((2, BUCKETS))
    for b, label in zip(rows, y, strict=True):
        seen[int(label), np.unique(b)] += 1
    n = np.maximum([len(y) - y.sum(), y.sum()], 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    model.embed[:, 0] = np.clip(odds, 0, 5) * (seen[1] >= 3) * 0.5
    for f in model.filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3 / len(f)


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, rate: float = 0.02, seed: int = 7) -> Model:
    """rows: the buckets of each text; y: 0 or 1. A fifth of the rows calibrates the thresholds."""
    model, rng = Model(seed), np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[: len(rows) // 5], order[len(rows) // 5 :]
    start_from_log_odds(model, [rows[i] for i in fit], y[fit])
    weight = np.where(y == 1, 0.5 / max(1, y[fit].sum()), 0.5 / max(1, (1 - y[fit]).sum())) * len(fit)
    params = {"out": model.out, **{f"f{k}": f for k, f in enumerate(model.filters)}}
    m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    embed_m, embed_v = np.zeros_like(model.embed), np.zeros_like(model.embed)
    bias_m = bias_v = 0.0
    step = 0
    for _ in range(epochs):
        for a in range(0, len(fit), 128):
            at = fit[a : a + 128]
            at = at[np.argsort(rng.random(len(at)))]
            buckets, first = np.concatenate([rows[i] for i in at]), np.concatenate([[0], np.cumsum([len(rows[i]) for i in at])])
            pool, places, x, slot, _ = model.pooled(buckets, first, True)
            p = 1 / (1 + np.exp(-np.clip(pool @ model.out + model.bias, -30, 30)))
            g = ((p - y[at]) * weight[at] / len(at)).astype(np.float32)
            grad = {"out": pool.T @ g}
            rows_hit, grads_hit = [], []
            back = np.full(len(x), -1, np.int64)
            back[slot] = np.arange(len(slot))
            for k, f in enumerate(model.filters):
                gp = g[:, None] * model.out[None, k * FILTERS : (k + 1) * FILTERS]
                gf = np.zeros_like(f)
                for j in range(len(f)):
                    where = np.minimum(places[k] + j, len(x) - 1)
                    gf[j] = np.einsum("rfd,rf->df", x[where], gp)
                    word = back[where.ravel()]
                    good = word >= 0
                    each = (gp[:, :, None] * f[j].T[None, :, :]).reshape(-1, DIM)[good]
                    for c in range(buckets.shape[1]):
                        rows_hit.append(buckets[word[good], c])
                        grads_hit.append(each)
                grad[f"f{k}"] = gf
            step += 1
            fix = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, q in params.items():
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                q -= fix * m[k] / (np.sqrt(v[k]) + 1e-8)
            # of the embeddings only the buckets behind a pooled response change
            hit, where = np.unique(np.concatenate(rows_hit), return_inverse=True)
            ge = np.zeros((len(hit), DIM), np.float32)
            np.add.at(ge, where, np.concatenate(grads_hit))
            embed_m[hit] += 0.1 * (ge - embed_m[hit])
            embed_v[hit] += 0.001 * (ge**2 - embed_v[hit])
            model.embed[hit] -= fix * embed_m[hit] / (np.sqrt(embed_v[hit]) + 1e-8)
            gb = float(g.sum())
            bias_m, bias_v = bias_m + 0.1 * (gb - bias_m), bias_v + 0.001 * (gb * gb - bias_v)
            model.bias = np.float32(model.bias - fix * bias_m / (np.sqrt(bias_v) + 1e-8))
    calibrate(model, [rows[i] for i in held], y[held])
    return model


def calibrate(model: Model, rows: list[np.ndarray], y: np.ndarray) -> None:
    """For each guessed language the logit that separates the held rows best, midway between its neighbours; few rows go by all."""
    if not rows:
        return
    logit, lang = [], []
    for a in range(0, len(rows), 64):
        part = rows[a : a + 64]
        buckets, first = np.concatenate(part), np.concatenate([[0], np.cumsum([len(r) for r in part])])
        logit.append(model.logits(buckets, first))
        lang.append(guess_languages(buckets, first))
    logit, lang = np.concatenate(logit), np.concatenate(lang)

    def best(z: np.ndarray, label: np.ndarray) -> float:
        order = np.argsort(-z, kind="stable")
        z, label = z[order], label[order]
        # errors of each cut, both kinds weighing alike per row; among equal cuts the one in the middle of the widest gap
        wrong = np.concatenate([[label.sum()], label.sum() - np.cumsum(label) + np.cumsum(1 - label)])
        edge = np.concatenate([[z[0] + 1], z, [z[-1] - 1]])
        gap = np.where(wrong == wrong.min(), edge[:-1] - edge[1:], -1)
        k = int(gap.argmax())
        return float((edge[k] + edge[k + 1]) / 2)

    overall = best(logit, y) if y.any() and not y.all() else 0.0
    for x in range(len(LANGUAGES)):
        own = lang == x
        enough = y[own].sum() >= 20 and (1 - y[own]).sum() >= 20
        model.shift[x] = best(logit[own], y[own]) if enough else overall


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS)) == 0, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw_all, off_all = plain(batch.column(2))
        for x, y in pieces(off_all):
            raw, off = raw_all[off_all[x] : off_all[y]], off_all[x : y + 1] - off_all[x]
            buckets, first = features(raw, off)
            data = [buckets[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], batch.column(1)[x:y], pa.array(map(len, data), pa.int64()), pa.array(data, pa.binary())], names=["i", "toxic", "size", "data"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, DataFrame]:
    """(toxic, data) of at most MOST labelled rows outside the held-out fold, and of at most BYTES of features; and a table that it reads.

    Rows are taken by a hash of the id, one row an id; the features stay in the shared folder until they are chosen.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(labels[id_col].cast("long").alias("i"), labels[label_col].cast("int").alias("toxic")).where(~held_out(F.col("i")) & F.col("i").isNotNull())
    known = known.groupBy("i").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == kind).orderBy(F.xxhash64("i"), "i").limit(most) for kind, most in MOST.items()]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # the sum of MOST at most
    rows = docs.select(docs[id_col].cast("long").alias("i"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).join(chosen, "i")
    found = written(rows.select("i", "toxic", "text").mapInArrow(tidy(_features), "i long, toxic int, size long, data binary"), "toxicity-features")
    # of the rows of an id one with the fewest words; no id has more than one row from here on
    one = found.groupBy("i", "toxic").agg(F.min(F.struct("size", F.xxhash64("data").alias("h"))).alias("r")).select("i", "toxic", "r.*")
    total = F.sum("size").over(W.partitionBy("toxic").orderBy(F.xxhash64("i"), "i").rowsBetween(W.unboundedPreceding, 0))  # the sum of MOST rows at most
    taken = one.withColumn("total", total).where(F.col("total") <= F.when(F.col("toxic") == 1, BYTES[1]).otherwise(BYTES[0])).select("i", "size", "h")
    few = found.withColumn("h", F.xxhash64("data")).join(F.broadcast(taken), ["i", "size", "h"]).dropDuplicates(["i"])
    return few.select("toxic", "data"), found


def arrays(toxic: pa.Array, data: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The buckets of each row and the labels, in an order of their own, so that the model doesn't depend on partitions."""
    y = toxic.to_numpy(zero_copy_only=False).astype(np.int64)
    each = [np.frombuffer(d, np.uint32).reshape(-1, 1 + len(PREFIXES)) for d in data.to_pylist()]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(each[i]), each[i][:64].tobytes()))
    return [each[i] for i in order], y[order]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the sample's size is bounded."""
    held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if held is not None:
        rows, y = arrays(held.column("toxic").combine_chunks(), held.column("data").combine_chunks())
        if y.any() and not y.all():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows, y))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from the bounded sample of labelled rows, trained by a task; None without labels of both kinds."""
    rows, found = sample(docs, labels, id_col, text_col, label_col)
    made = rows.coalesce(1).mapInArrow(tidy(_train), "model binary").collect()  # a model: of fixed size
    drop(found)
    return pickle.loads(made[0]["model"]) if made else None


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            raw_all, off_all = plain(batch.column(0))
            out = [np.zeros(0)]
            for a, b in pieces(off_all):
                raw, off = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a]
                out.append(model.scores(*features(raw, off)) if model is not None else np.zeros(b - a))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(out), pa.float64())], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # of fixed size
    rows = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col].cast("long")).alias("held_out"))
    scored = rows.mapInArrow(tidy(_score(sent)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    schema, name = docs.schema, text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            only = pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index(name))], names=["text"])
            found = next(_score(sent)(iter([only])))
            yield batch.filter(pa.array(found.column(0).to_numpy() < 0.5))

    return docs.mapInArrow(tidy(run), schema)
