"""Best-fit packing of tokenized documents into sequences of a fixed capacity, by minimum bin slack.

Only the histogram of piece lengths (at most `capacity` numbers, whatever the input) is planned: per bin the longest
length left goes in, and a bitset subset-sum over the lengths still available finds the fullest feasible rest. The
combination is then removed as often as the histogram holds it, so the plan has a few combinations per length and its
work doesn't grow with the number of documents. Pieces get a rank among those of their length by counts of salted
parts, and a sorted search in the plan turns (length, rank) into a sequence and an offset.

Defined results. A null text is an empty document: its end token alone, one piece. Documents longer than the capacity
are cut into pieces of the capacity, of which the last may be shorter; nothing else is cut. Repeated rows and null ids
are documents of their own. An empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import give_back, ship, tidy, written
from .text import pieces, plain, word_bounds

#: Units whose ids a Python worker keeps (half as many more between two blocks), their most bytes and ids, bytes of texts that are cut
#: at once, parts of the pieces of one length that are numbered on their own.
KEEP, LONG, BLOCK, PARTS = 60_000, 64, 1 << 20, 256
#: Fixed value: what the word-wise way takes a tokenizer's pieces to be.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORKER: dict = {}
assert sys.byteorder == "little" and array("I").itemsize == 4


# ---- tokens


def goes_by_word(data: str) -> bool:
    """Whether a tokenizer's file says that it lower-cases, splits off letters and marks, and drops blanks."""
    d = json.loads(data)
    normal, before, model = (d.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    first, *rest = before.get("pretokenizers") or [{}]
    splits = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": WORD_PATTERN}
    steps = [n.get("type") for n in normal.get("normalizers") or []]
    plain_bytes = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("add_prefix_space") and rest[0].get("use_regex") is False
    blanks = all(" " not in t["content"] and not t.get("lstrip") and not t.get("rstrip") for t in d.get("added_tokens") or [])
    return steps == ["NFC", "Replace", "Lowercase"] and splits and plain_bytes and blanks and model.get("end_of_word_suffix") == "</w>" and not d.get("post_processor")


class WordIds:
    """Token ids of texts, unit by unit: the tokenizer never joins what a blank, or a change between letters and marks, separates.

    Only for tokenizers that goes_by_word() knows; texts go to any other one whole.

    A word of Latin letters (ASCII and U+00C0 to U+00FF), digits and ASCII marks is cut as the tokenizer cuts it, into lower-cased
    runs of letters, single digits and runs of marks. Any other word (with an apostrophe, which may begin a piece of its own,
    a <, which may begin a special token, or other characters) is one unit and goes to the tokenizer with all its steps.
    The plain units of a block that the worker doesn't know yet go to it in few calls, without the steps that would leave them as they
    are; an id that ends a word shows where each unit's ids end.
    """

    def __init__(self, data: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.by_word = Tokenizer.from_str(data), goes_by_word(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.usual = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.bare = normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._keep(pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        del vocabulary
        give_back()  # what reading the vocabulary took

    def _keep(self, names: pa.Array, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, seen: np.ndarray) -> None:
        """What stays for the next blocks: units, their ids and how often they came; the most frequent KEEP when there are half as many more."""
        if len(names) > KEEP * 3 // 2:
            order = np.argpartition(-seen, KEEP)[:KEEP]
            stay = np.sort(order[(sizes[order] <= LONG) & (pc.binary_length(names.take(pa.array(order))).to_numpy() <= LONG)])
            names, ids, sizes, seen = names.take(pa.array(stay)), _gather(ids, begin[stay], sizes[stay]), sizes[stay], seen[stay] // 2
            begin = np.cumsum(sizes) - sizes
        self.names, self.ids, self.begin, self.sizes, self.seen = names, ids, begin, sizes, seen

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one behind the other, and their numbers, by all steps of the tokenizer."""
        ids, sizes = array("I"), []
        for a in range(0, len(words), 1024):
            for e in self.tokenizer.encode_batch_fast(words[a : a + 1024], add_special_tokens=False):
                ids.extend(e.ids)
                sizes.append(len(e.ids))
        return np.frombuffer(ids, dtype="<u4"), np.array(sizes, dtype=np.int64)

    def _steps(self, steps: tuple) -> None:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps

    def _plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain units."""
        made = []
        for a in range(0, len(units), 4096):
            parts = [units[b : b + 256] for b in range(a, min(a + 4096, len(units)), 256)]
            self._steps(self.bare)
            done = self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)
            self._steps(self.usual)
            for part, e in zip(parts, done, strict=True):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                made.append((ids, np.diff(cuts, prepend=0)) if len(cuts) == len(part) else self._whole(part))
        return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else self._whole([])

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as little-endian 32-bit numbers, and the first one of each text (with their number at the end)."""
        if not self.by_word:
            made = [e.ids for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter((i for ids in made for i in ids), dtype="<u4"), np.cumsum([0, *map(len, made)])
        units, first, odd = units_of(*plain(texts))
        known = len(self.names)
        coded = pa.concat_arrays([self.names, units]).dictionary_encode()  # known units keep their numbers, new ones come behind
        names, at = coded.dictionary, coded.indices.to_numpy()[known:]
        strange = np.zeros(len(names), dtype=bool)
        strange[at[odd]] = True
        whole = np.flatnonzero(strange[known:]) + known
        bare = np.flatnonzero(~strange[known:]) + known
        (x, n), (y, m) = self._plain(names.take(pa.array(bare)).to_pylist()), self._whole(names.take(pa.array(whole)).to_pylist())
        ids, added, new = np.concatenate([self.ids, x, y]), np.concatenate([n, m]), np.concatenate([bare, whole])
        sizes, begin = (np.concatenate([old, np.zeros(len(new), np.int64)]) for old in (self.sizes, self.begin))
        sizes[new] = added
        begin[new] = len(self.ids) + np.cumsum(added) - added
        count = sizes[at]
        out, ends = _gather(ids, begin[at], count), np.cumsum(count)
        seen = np.bincount(at, minlength=len(names))
        seen[:known] += self.seen
        self._keep(names, ids, begin, sizes, seen)
        return out, np.concatenate([[0], ends])[first]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, first = self.column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]


def _gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of values that begin there, one behind the other."""
    shift = begin - (np.cumsum(sizes) - sizes)
    at = np.repeat(shift, sizes)
    at += np.arange(len(at))
    return values[at]


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.full(256, ODD, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        kind[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else ODD if c in "'<" else MARK
    kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BLANK
    low[ord("A") : ord("Z") + 1] += 32
    return kind, low


BLANK, LETTER, MARK, DIGIT, ODD = range(5)
_KIND, _LOW = _kinds()


def units_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of texts (bytes and offsets of rows), each row's first one (with their number at the end), and which units are odd words."""
    kind, low = _KIND[raw], _LOW[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF, letters but for the signs of multiplication and division
    after = raw[lead + 1]
    fine = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
    lead, after = lead[fine] + 1, after[fine]
    kind[lead - 1] = kind[lead] = LETTER
    low[lead[after <= 0x9E]] += 32
    odd = np.flatnonzero(kind == ODD)
    if len(odd):
        starts, ends, _ = word_bounds(raw, offsets)
        which = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        change = np.zeros(len(raw) + 1, dtype=np.int8)
        change[starts[which]] += 1
        change[ends[which]] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)
        kind[inside] = ODD
        low[inside] = raw[inside]
    edge = kind == DIGIT
    edge[1:] |= kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    stays = kind != BLANK
    edge &= stays
    data, bounds = low[stays], np.flatnonzero(edge[stays])
    starts = np.flatnonzero(edge)
    units = pa.Array.from_buffers(pa.large_string(), len(bounds), [None, pa.py_buffer(np.append(bounds, len(data))), pa.py_buffer(data)])
    return units, np.searchsorted(starts, offsets), kind[starts] == ODD


def _cut(sent, capacity: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = zlib.crc32(sent.value.encode())
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = WordIds(sent.value)
        coder = _WORKER[key]
        step = 4 * capacity

        def block(ids: list, texts: pa.Array) -> pa.RecordBatch:
            rows: list[tuple] = []
            tokens, first = coder.column(texts)
            first = first.tolist()
            for i, x, y in zip(ids, first[:-1], first[1:], strict=True):
                data = tokens[x:y].tobytes() + end
                for piece, a in enumerate(range(0, len(data), step)):
                    part = data[a : a + step]
                    rows.append((i, piece, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in pieces(plain(texts)[1], BLOCK):
                yield block(ids[a:b], texts.slice(a, b - a))
            give_back()

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    return rows.mapInArrow(tidy(_cut(sent, capacity, end)), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- plan


def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """Lengths and copies out of counts whose sum is the largest that room holds, by bitset subset sums; stops at a full room."""
    if room <= 0:
        return []
    if counts.get(room):
        return [(room, 1)]
    keep = (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left:
            n = min(size, left)
            steps.append((length, n, bits))
            bits = (bits | bits << (length * n)) & keep
            left -= n
            size *= 2
        if bits >> room & 1:
            break
    total, taken = bits.bit_length() - 1, {}
    for length, n, was in reversed(steps):
        if not was >> total & 1:
            total -= length * n
            taken[length] = taken.get(length, 0) + n
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations of (length, copies) and the number of sequences filled by each; all pieces are placed."""
    counts = {x: c for x, c in histogram.items() if c > 0}
    out = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        rest = dict(fullest(capacity - top, counts))
        counts[top] += 1
        rest[top] = rest.get(top, 0) + 1
        times = min(counts[x] // n for x, n in rest.items())
        for x, n in rest.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((sorted(rest.items(), reverse=True), times))
    return out


def lookup(made: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset in a sequence), sorted."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for combination, times in made:
        offset = 0
        for length, n in combination:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += length * n
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        key = made[:, 0] << 44 | made[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            row = made[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            keep = [n for n in names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n)) for n in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*keep, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces (length: 1 to capacity), with sequence_id and offset."""
    spark = pieces.sparkSession
    ship(spark)
    pieces = written(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    salted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(PARTS)).cast("int"))
    counts = written(salted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # capacity rows at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = spark.sparkContext.broadcast(lookup(plan(histogram, capacity)))  # a few rows a length
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = salted.withColumn("at", F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(starts, ["length", "part"]).select(*pieces.columns, (F.col("first") + F.col("at")).alias("rank"))
    return ranked.mapInArrow(tidy(_place(made)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
