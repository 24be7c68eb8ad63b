"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct words of a block of the corpus are laid out as one array of tokens. An inverted index holds, for each rank,
the positions of the pairs that merge into that rank's token; ranks are replayed from the lowest, each over all words at
once, and a merge looks up only the two pairs beside it. A pair of a lower rank that a merge brings about is replayed
before anything else: of a word's occurrences of a rank, those up to the first that brings such a pair go at once, so the
ids are those of merging each word on its own by lowest rank, and a long word takes few passes. Words that are tokens
themselves are taken whole.

Blocks bound the memory; what a Python worker has encoded stays with it, up to KEEP words.

Defined results. A null text is an empty text: no tokens, the digests of nothing. Texts of any length are encoded whole.
Repeated rows and null ids each get their row; an empty table gives an empty result. Other columns are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, tidy
from .text import Recent

#: Characters of a block, and words whose ids a worker keeps.
BLOCK, KEEP = 24 << 20, 200_000
_NONE = np.int32(1 << 30)
_WORKER: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    """Merges by rank. encode() takes distinct words, decode() token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        # tokens that are part of a pair of lower rank than their own
        self.lower = np.zeros(max(ranks.values()) + 1, dtype=bool)
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            self.lower[part[self.made < part]] = True

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.made[at], _NONE)

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            r = self.ranks.get(w)
            if r is not None:
                out[i] = (r,)
            elif w:
                rest.append(i)
            else:
                out[i] = ()
        if rest:
            ids, first = self._replay([words[i] for i in rest])
            ids = ids.tolist()
            for k, i in enumerate(rest):
                out[i] = tuple(ids[first[k] : first[k + 1]])
        return out

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        length = np.fromiter(map(len, words), np.int64, len(words))
        n = int(length.sum())
        token = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(length)
        after[ends - 1], before[ends - length] = -1, -1
        pair = np.full(n, _NONE, np.int32)
        has = np.flatnonzero(after >= 0)
        pair[has] = self.rank_of(token[has], token[after[has]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = pair[at]
            live = rank < _NONE
            if not live.any():
                return
            at, rank = at[live], rank[live]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(rank[starts[:-1]].tolist(), starts[:-1], starts[1:], strict=True):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        add(has)
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = np.unique(at[pair[at] == r])
            if not len(at):
                continue
            if len(at) > 1:
                now, later = self._at_once(r, at, word[at], token, after, before)
                if len(later):
                    index[r] = [later]
                    heapq.heappush(heap, r)
                at = now
            right = after[at]
            beyond = after[right]
            token[at] = r
            after[at] = beyond
            pair[right] = _NONE
            token[right] = -1
            pair[at] = _NONE
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            pair[at[inner]] = self.rank_of(token[at[inner]], token[beyond[inner]])
            left = before[at]
            outer = left >= 0
            left = left[outer]
            pair[left] = self.rank_of(token[left], token[at[outer]])
            add(np.concatenate([at, left]))
        live = token >= 0
        counts = np.add.reduceat(live, ends - length) if n else np.zeros(0, np.int64)
        return token[live], [0, *np.cumsum(counts).tolist()]

    def _at_once(self, r: int, at: np.ndarray, word: np.ndarray, token: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of a rank to merge now, and those to look at again.

        Of occurrences that overlap, every second one from the left merges. In a word, all go at once up to the first whose
        merge brings about a pair of lower rank, which must be replayed before those behind it.
        """
        follows = np.zeros(len(at), dtype=bool)
        follows[1:] = after[at[:-1]] == at[1:]  # shares a token with the occurrence before
        place = np.arange(len(at))
        alternate = (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0
        now, w = at[alternate], word[alternate]
        if not self.lower[r]:
            return now, np.zeros(0, at.dtype)
        own = np.full(len(now), r, np.int32)
        stops = self.rank_of(own, own) < r
        left, beyond = before[now], after[after[now]]
        stops |= (left >= 0) & (self.rank_of(token[left], own) < r)
        stops |= (beyond >= 0) & (self.rank_of(own, token[beyond]) < r)
        if not stops.any():
            return now, np.zeros(0, at.dtype)
        first = np.concatenate([[True], w[1:] != w[:-1]])
        run = np.cumsum(first) - 1
        stopped = np.cumsum(stops) - stops  # stops before each
        good = stopped == stopped[np.flatnonzero(first)][run]
        rest = at[~np.isin(at, now[good])]
        return now[good], rest

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


class Splitter:
    """Matches of a pattern as the rank library's own engine finds them.

    The two engines may know different versions of Unicode: `odd` has, for \\p{L} and \\p{N}, the characters that only
    the library counts and those that it doesn't count. Texts that hold any of them go by a pattern with these sets.
    """

    def __init__(self, pattern: str, odd: dict[str, tuple[str, str]]):
        import regex

        self.usual, self.exact = regex.compile(pattern), None
        both = "".join(sorted(set("".join(a + b for a, b in odd.values()))))
        if both:
            self.any_odd = regex.compile(f"[{ranges(both)}]")
            exact = pattern
            for name, (more, less) in odd.items():
                known = f"[{name}||[{ranges(more)}]]" if more else name
                exact = exact.replace(name, f"[{known}--[{ranges(less)}]]" if less else known)
            self.exact = regex.compile(exact, regex.V1)

    def __call__(self, text: str) -> list[str]:
        if self.exact is not None and not text.isascii() and self.any_odd.search(text):
            return self.exact.findall(text)
        return self.usual.findall(text)


def ranges(chars: str) -> str:
    """Sorted characters as the inside of a character class."""
    codes, out = list(map(ord, chars)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def odd_characters() -> dict[str, tuple[str, str]]:
    """Where the library's character classes differ from the splitting engine's, found by asking both about every character."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    out = {}
    for name in (r"\p{L}", r"\p{N}"):
        coder = tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(bytes(coder.encode_ordinary(every)).decode("utf-8")), set(regex.findall(name, every))
        out[name] = ("".join(sorted(theirs - ours)), "".join(sorted(ours - theirs)))
    return out


def _worker(ranks: dict[bytes, int], pattern: str, odd: dict):
    """The replay, the splitter and the words encoded so far of this Python worker."""
    key = (len(ranks), hash(pattern))
    if key not in _WORKER:
        _WORKER[key] = (Replay(ranks), Splitter(pattern, odd), Recent(KEEP))
    return _WORKER[key]


def encode_block(texts: list[str], replay: Replay, split, known: Recent):
    """(n_tokens, ids joined by commas, decoded bytes) of each text, by one replay over the words not known yet."""
    found = [split(t) for t in texts]
    new: set[str] = set()
    for words in found:
        new.update(words)
    new = known.lacking(new)
    values = known.young
    for w, ids in zip(new, replay.encode([w.encode("utf-8") for w in new]), strict=True):
        values[w] = (",".join(map(str, ids)), len(ids), replay.decode(ids))
    for words in found:
        parts = [values[w] for w in words]
        yield sum([p[1] for p in parts]), ",".join([p[0] for p in parts]), b"".join([p[2] for p in parts])


def _run(sent, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split, known = _worker(sent.value[0], pattern, sent.value[1])

        def block(ids: list, texts: list[str]) -> pa.RecordBatch:
            counts, sums, backs, lists = [], [], [], []
            for n, joined, data in encode_block(texts, replay, split, known):
                counts.append(n)
                sums.append(hashlib.sha256(joined.encode()).hexdigest())
                backs.append(hashlib.sha256(data).hexdigest())
                if keep_ids:
                    lists.append([int(x) for x in joined.split(",")] if joined else [])
            cols = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums), pa.array(backs)] + ([pa.array(lists, pa.list_(pa.int32()))] if keep_ids else [])
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BLOCK:
                    yield block(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield block(ids, texts)
        known.rest()

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of each row. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((load_ranks(ranks_path), odd_characters()))  # a vocabulary: its size doesn't depend on the data
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(tidy(_run(sent, pattern, keep_ids)), shape)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and data (binary) from doc_id and ids."""
    spark = encoded.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches):
        tokens = {r: t for t, r in sent.value.items()}
        for batch in batches:
            data = [b"".join([tokens[i] for i in ids or []]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
