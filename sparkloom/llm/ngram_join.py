"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

A document's set is its distinct 5-word shingles as 64-bit hashes. Documents with one set are one class; links are
looked for between classes and every step below carries class ids and hashes only.

1. One scan counts shingles in a sketch (all documents; it grows with the input up to MOST_COUNTERS) and gives each
   document's set size and class. The global order is (counter, hash): shingles of much repeated passages come last.
2. A second scan emits each set's prefix (the 1 - ceil(0.8 n) + n rarest shingles). Dealt by shingle and sorted, a
   streaming pass keeps the shingles of several classes; a run of any length passes through in constant memory, and runs
   that the sketch shows to be hot are dealt to several tasks.
   A shingle that no other prefix has may still lie behind the prefix of a larger set, so it bounds no overlap.
3. Star round: in each run the smallest class is paired with the others, if the length and positional filters
   allow it. Pairs are made distinct, then verified once: suffix filter, then the exact overlap. Links merge
   classes into components, so that a group of near copies costs one pair a member instead of all pairs.
4. Runs that still hold several components give the pairs across components. Short runs (up to LIGHT classes) are
   joined on the shingle under all filters. Classes of longer runs form families; a family is cut into blocks by set
   size and hash, of BLOCK sets and BLOCK_BYTES at most, and each pair of blocks is verified within one task by one matrix
   product, from which only links between components leave. No step emits the pairs of a group.

Equal classes are found by 64-bit digests of sets; a second digest shows collisions, upon which another seed is taken.

Defined results. A null text, or one without words, has the empty set: n_shingles 0, linked with nothing, its own
component. Fewer than 5 words are one shingle. Repeated rows and ids: each row has its result; the smallest id counts. A
row without an id gets the component's smallest id, or null if there is none. An empty table gives an empty result.
Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .filters import HOT, Filter, few, join_hot, maybe_in
from .runtime import drop, scope, ship, tidy, written
from .text import mix, pieces, plain, shingles, span_hashes, word_bounds

#: Counters of the frequency sketch at least and at most (powers of two), bytes of input for each, and counters of one of its rows.
LEAST_COUNTERS, MOST_COUNTERS, COUNTER_BYTES, SKETCH_ROW = 1 << 18, 1 << 24, 512, 1 << 14
#: Classes of a run up to which it is joined pair by pair; classes and bytes of sets of a block of a family.
LIGHT, BLOCK, BLOCK_BYTES = 64, 256, 8 << 20
#: Parts of a hot run.
SALTS = 61
#: Classes that a task remembers as sent; what it sends again is made distinct later on.
SEEN = 1 << 16
_U = np.uint64


def row_sets(column: pa.Array, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each row."""
    raw_all, off_all = plain(column)
    for a, b in pieces(off_all):
        raw, off = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a]
        starts, ends, first = word_bounds(raw, off)
        found, at = shingles(span_hashes(raw, starts, ends, seed), first)
        for r in range(b - a):
            own = np.sort(found[at[r] : at[r + 1]])
            yield a + r, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def digests(own: np.ndarray) -> tuple[int, int]:
    """Two independent digests of a set."""
    if not len(own):
        return 0, 0
    n = _U(len(own))
    one, two = mix(own).sum(dtype=np.uint64) + n, mix(own ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ n
    return tuple(np.array([one, two], np.uint64).view(np.int64).tolist())


def need(n):
    """The least overlap of a set of n with any linked set: ceil(0.8 n)."""
    return -(-80 * n // 100)


def overlap_needed(a, b):
    """The least overlap of linked sets of sizes a and b: 100 o >= 80 (a + b - o)."""
    return -(-80 * (a + b) // 180)


_COUNTED = "doc_id long, h long, n long, class long, proof long, part int, counts binary"


def counters(docs: DataFrame) -> int:
    """The size of the sketch, by the size that Spark expects docs to have."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (size // COUNTER_BYTES).bit_length()))


def _shift(size: int) -> np.uint64:
    return _U(64 - size.bit_length() + 1)


def _tally(sketch: np.ndarray, held: list[np.ndarray]) -> None:
    if held:
        at = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sketch[at[new].astype(np.int64)] += np.diff(np.append(new, len(at))).astype(np.int32)


def _count(seed: int, size_of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(size_of, np.int32)
        shift = _shift(size_of)
        for batch in batches:
            sizes, one, two, held, size = [], [], [], [], 0
            for _, own in row_sets(batch.column(2), seed):
                sizes.append(len(own))
                d = digests(own)
                one.append(d[0])
                two.append(d[1])
                held.append((own >> shift).astype(np.uint32))
                size += len(own)
                if size > 1 << 20:
                    _tally(sketch, held)
                    held, size = [], 0
            _tally(sketch, held)
            nulls = pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *nulls], names=["doc_id", "h", "n", "class", "proof", "part", "counts"])
        parts = [p for p in range(size_of // SKETCH_ROW) if sketch[p * SKETCH_ROW : (p + 1) * SKETCH_ROW].any()]
        if parts:
            no = [pa.nulls(len(parts), pa.int64())] * 5
            data = [sketch[p * SKETCH_ROW : (p + 1) * SKETCH_ROW].tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([*no, pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["doc_id", "h", "n", "class", "proof", "part", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(data, np.int32 if len(data) == 4 * SKETCH_ROW else np.int64)
            total[p] = total[p] + own if p in total else own.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def frequency_sketch(counted: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' sketches, added up in two levels; MOST_COUNTERS numbers of 4 bytes at the driver at most."""
    rows = counted.where("part is not null").select("part", "counts")
    some = rows.repartition(16, "part", F.pmod(F.xxhash64("counts"), F.lit(16))).mapInArrow(tidy(_add), "part int, counts binary")
    total = np.zeros(size, np.uint32)
    for r in some.repartition(8, "part").mapInArrow(tidy(_add), "part int, counts binary").toLocalIterator():
        total[r["part"] * SKETCH_ROW : (r["part"] + 1) * SKETCH_ROW] = np.minimum(np.frombuffer(r["counts"], np.int64), (1 << 32) - 1)
    return total


def _prefixes(sent, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = sent.value, set()
        shift = _shift(len(sketch))
        # of the prefixes, about a fifth of all shingles, a hot run has one in HOT at least
        hot = float(sketch.sum(dtype=np.float64)) * 0.2 / HOT
        for batch in batches:
            tokens, classes, places, sizes, salts, held = [], [], [], [], [], 0
            for _, own in row_sets(batch.column(0), seed):
                n = len(own)
                name = digests(own)[0]
                if not n or name in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                most = n - need(n) + 1
                seen_of = sketch[(own >> shift).astype(np.int64)]
                order = np.argsort(seen_of, kind="stable")[:most]
                tokens.append(own[order])
                salts.append(np.where(seen_of[order] > hot, name % SALTS + 1, 0).astype(np.int8))
                classes.append(np.full(most, name, np.int64))
                places.append(np.arange(most, dtype=np.int32))
                sizes.append(np.full(most, n, np.int32))
                held += most
                if held > 1 << 18:
                    yield _postings(tokens, classes, places, sizes, salts)
                    tokens, classes, places, sizes, salts, held = [], [], [], [], [], 0
            if tokens:
                yield _postings(tokens, classes, places, sizes, salts)

    return run


def _postings(tokens, classes, places, sizes, salts) -> pa.RecordBatch:
    cols = [np.concatenate(tokens).view(np.int64), np.concatenate(classes), np.concatenate(places).astype(np.int64) | np.concatenate(sizes).astype(np.int64) << 32]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(np.concatenate(salts))], names=["token", "class", "at", "salt"])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, class): one row each, if the token has several classes or is hot. Holds one row back."""
    last, sent = None, False
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if last is not None:
            rows = np.concatenate([last, rows], axis=1)
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        kept = rows[:, new]
        like_next = np.zeros(kept.shape[1], dtype=bool)
        like_next[:-1] = kept[0, 1:] == kept[0, :-1]
        good = like_next.copy()
        good[1:] |= like_next[:-1]
        good |= kept[3] > 0  # a part of a hot run: its other classes may be elsewhere
        if last is not None and sent:
            good[0] = False  # it has gone out before
        tail = kept[:, -1:]
        out = kept[:, good]
        # the last row goes out now if it has a fellow before it, and is held back to be compared with what follows
        sent = bool(good[-1]) or (sent and kept.shape[1] == 1)
        last = tail
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out[:3]], names=["token", "class", "at"])


def _set_rows(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            names, data, held = [], [], 0
            for _, own in row_sets(batch.column(0), seed):
                name = digests(own)[0]
                if len(own) and name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    data.append(own.tobytes())
                    held += len(data[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["class", "shingles"])
                    names, data, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(data, pa.binary())], names=["class", "shingles"])

    return run


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """An upper bound of the overlap of two sorted sets: both are cut at probe values, and no part shares more than its smaller side."""
    probes = a[(np.arange(1, 1 << depth) * len(a)) >> depth]
    x = np.concatenate([[0], np.searchsorted(a, probes), [len(a)]])
    y = np.concatenate([[0], np.searchsorted(b, probes), [len(b)]])
    return int(np.minimum(np.diff(x), np.diff(y)).sum())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    least = overlap_needed(len(a), len(b))
    if min(len(a), len(b)) < least or suffix_bound(a, b) < least:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum()) >= least


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, two = batch.column(0), batch.column(1)
        good = np.zeros(batch.num_rows, dtype=bool)
        sets = batch.column(2), batch.column(3)
        for r in range(batch.num_rows):
            good[r] = linked(*(np.frombuffer(s[r].as_buffer(), np.uint64) for s in sets))
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([one.filter(keep), two.filter(keep)], names=["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked."""
    first = pairs.join(sets.withColumnsRenamed({"class": "a", "shingles": "sa"}), "a")
    both = first.join(sets.withColumnsRenamed({"class": "b", "shingles": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(_verify), "a long, b long")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()


def sets_of(rows: DataFrame, members: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(class, shingles) of the wanted classes, from a scan of one row of each and few others."""
    owners = written(members.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "set-owners")
    found = rows.where(maybe_in(owners, "doc_id", F.col("doc_id")) | F.col("doc_id").isNull()).select("text").mapInArrow(tidy(_set_rows(seed)), "class long, shingles binary")
    return written(found.join(wanted, "class", "left_semi").dropDuplicates(["class"]), "shingle-sets")


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile; of each tile the links that join components. A tile has at most some blocks' rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if held and held[-1][0] != row[0]:
                yield _tile_links(held)
                held = []
            held.append(row)
    if held:
        yield _tile_links(held)


def _tile_links(rows: list[tuple]) -> pa.RecordBatch:
    side = [[(c, comp, np.frombuffer(s, np.uint64)) for _, half, c, comp, s in rows if half in (k, 2)] for k in (0, 1)]
    out: list[tuple[int, int]] = []
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while group.get(x, x) != x:
            group[x] = group.get(group[x], group[x])
            x = group[x]
        return x

    if side[0] and side[1]:
        every = np.unique(np.concatenate([s for k in (0, 1) for _, _, s in side[k]]))
        size = [np.array([len(s) for _, _, s in side[k]]) for k in (0, 1)]
        shared = np.zeros((len(side[0]), len(side[1])), np.float32)
        for a in range(0, len(every), 8192):
            part = every[a : a + 8192]
            flat = []
            for k in (0, 1):
                m = np.zeros((len(side[k]), len(part)), np.float32)
                for r, (_, _, s) in enumerate(side[k]):
                    own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], "right")]
                    m[r, np.searchsorted(part, own)] = 1
                flat.append(m)
            shared += flat[0] @ flat[1].T
        good = 100 * shared >= 80 * (size[0][:, None] + size[1][None, :] - shared)
        for i, j in zip(*np.nonzero(good), strict=True):
            (a, ca, _), (b, cb, _) = side[0][i], side[1][j]
            if a != b and root(ca) != root(cb):
                group[root(ca)] = root(cb)
                out.append((a, b))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], names=["a", "b"])


def _bound_ok(a: dict[str, str], b: dict[str, str]) -> str:
    """Length filter, and the positional filter at a shared shingle: what both have before it is in both prefixes."""
    least = f"ceil(80 * ({a['n']} + {b['n']}) / 180)"
    return (
        f"100 * least({a['n']}, {b['n']}) >= 80 * greatest({a['n']}, {b['n']}) "
        f"AND least({a['before']}, {b['before']}) + 1 + least({a['n']} - {a['pos']} - 1, {b['n']} - {b['pos']} - 1) >= {least}"
    )


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, n, class, proof) of each row, h being a hash of the text, and the component of each linked class."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    seed, size = 0, counters(docs)
    while True:
        counted = written(rows.mapInArrow(tidy(_count(seed, size)), _COUNTED), "shingle-counts")
        members = counted.where("class is not null").select("doc_id", "h", "n", "class", "proof")
        clash = members.groupBy("class").agg(F.min("proof").alias("x"), F.max("proof").alias("y"), F.min("n").alias("u"), F.max("n").alias("v"))
        if clash.where("x <> y or u <> v").isEmpty():
            break
        drop(counted)
        seed += 1
    sketch = spark.sparkContext.broadcast(frequency_sketch(counted, size))  # MOST_COUNTERS numbers at most
    narrow = written(members, "set-members")
    drop(counted)
    members = narrow
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    postings = rows.select("text").mapInArrow(tidy(_prefixes(sketch, seed)), "token long, class long, at long, salt byte")
    several = postings.repartition(deal, "token", "salt").sortWithinPartitions("token", "class").mapInArrow(tidy(_several), "token long, class long, at long")
    several = written(several, "shared-prefixes")
    sketch.destroy()
    posts = several.select("token", "class", F.shiftright("at", 32).alias("n"), F.expr("at & 4294967295").alias("pos"))
    # how many shared shingles a class has in its prefix before each
    places = posts.groupBy("class").agg(F.sort_array(F.collect_list("pos")).alias("all_pos"))
    posts = posts.join(places, "class").withColumn("before", F.expr("cast(array_position(all_pos, pos) - 1 as bigint)")).drop("all_pos")
    posts = written(posts, "bounded-prefixes")
    drop(several)

    sizes = posts.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("n", "class", "pos", "before")).alias("r"))
    first = written(sizes.select("token", "size", F.col("r.n").alias("qn"), F.col("r.class").alias("q"), F.col("r.pos").alias("qpos"), F.col("r.before").alias("qbefore")), "run-heads")
    every = posts.agg(F.count(F.lit(1)).alias("n")).scalar()
    hot = few(first.where(F.col("size") * HOT > every), ["token"])  # fewer than HOT runs
    star = join_hot(posts, first, ["token"], hot=hot).where("class <> q").where(_bound_ok({"n": "n", "pos": "pos", "before": "before"}, {"n": "qn", "pos": "qpos", "before": "qbefore"}))
    tried = written(star.selectExpr("least(class, q) AS a", "greatest(class, q) AS b").distinct(), "star-pairs")
    some = sets_of(rows, members, ends(tried), seed)
    links = written(verified(tried, some), "star-links")
    drop(some)
    merged = components(links)

    grouped = written(posts.join(merged.withColumnsRenamed({"node": "class", "component": "comp"}), "class", "left").withColumn("comp", F.coalesce("comp", "class")), "grouped-prefixes")
    drop(posts, merged)
    runs = grouped.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("class").alias("head")).where("low <> high").select("token", "size", "head")
    runs = written(runs, "open-runs")
    open_posts = written(join_hot(grouped, runs, ["token"], hot=hot), "open-prefixes")
    drop(grouped, runs, first)
    light = open_posts.where(F.col("size") <= LIGHT)
    sides = ({c: f"{t}.{c}" for c in ("n", "pos", "before")} for t in "pq")
    cross = light.alias("p").join(light.alias("q"), F.expr("p.token = q.token AND p.class < q.class AND p.comp <> q.comp AND " + _bound_ok(*sides)))
    pairs = written(cross.selectExpr("p.class AS a", "q.class AS b").distinct().join(tried, ["a", "b"], "left_anti"), "cross-pairs")
    heavy = open_posts.where(F.col("size") > LIGHT)
    sets = sets_of(rows, members, ends(pairs).unionByName(heavy.select("class")).distinct(), seed)
    more = written(verified(pairs, sets).unionByName(_heavy_links(heavy, sets, deal)), "cross-links")
    drop(tried, pairs, sets, open_posts)
    final = components(links.unionByName(more))
    drop(links, more)
    return members, final


def _heavy_links(posts: DataFrame, sets: DataFrame, deal: int) -> DataFrame:
    """Links across components among the classes of long runs, block by block."""
    edges = posts.where("class <> head").selectExpr("class AS a", "head AS b").distinct()
    family = components(edges).withColumnsRenamed({"node": "class", "component": "family"})
    own = written(posts.select("class", "n", "comp").distinct().join(family, "class").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")), "family-members")
    drop(family)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    count = own.groupBy("family", "band").agg(blocks.alias("blocks"))
    above = count.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = count.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    bands = written(count.join(above, ["family", "band"], "left").join(below, ["family", "band"], "left"), "family-bands")
    own = join_hot(own, bands, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    tile = lambda band, i, upper, j: f"struct({band} AS band, {i} AS i, {upper} AS upper, {j} AS j)"
    places = F.expr(
        f"""concat(
          transform(sequence(0, blocks - 1), x -> struct({tile('band', 'least(block, x)', 'band', 'greatest(block, x)')} AS tile, CASE WHEN x = block THEN 2 WHEN block < x THEN 0 ELSE 1 END AS half)),
          transform(CASE WHEN above IS NULL THEN array() ELSE sequence(0, above - 1) END, x -> struct({tile('band', 'block', 'band + 1', 'x')} AS tile, 0 AS half)),
          transform(CASE WHEN below IS NULL THEN array() ELSE sequence(0, below - 1) END, x -> struct({tile('band - 1', 'x', 'band', 'block')} AS tile, 1 AS half)))"""
    )
    placed = own.select("family", "class", "comp", F.explode(places).alias("p")).select(F.struct("family", "p.tile").cast("string").alias("tile"), "p.half", "class", "comp")
    # a tile whose classes are all of one component has nothing to tell
    placed = written(placed, "tile-members")
    open_tiles = placed.groupBy("tile").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("tile")
    placed = placed.join(open_tiles, "tile", "left_semi").join(sets, "class")
    dealt = placed.select("tile", "half", "class", "comp", "shingles").repartition(deal, "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(tidy(_tile), "a long, b long")


def with_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h, n_shingles, component (a class), component_id for each row; a row without words has no component."""
    members, merged = classes_of(docs, id_col, text_col)
    own = members.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    own = own.join(merged.withColumnsRenamed({"node": "class"}), "class", "left").select("class", "least", "rows", F.coalesce("component", "class").alias("component"))
    own = written(own, "class-components")
    least = own.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    least = written(least, "component-ids")
    classes = own.agg(F.count(F.lit(1)).alias("n")).scalar()
    of = join_hot(own, least, ["component"], hot=least.where(F.col("classes") * HOT > classes))
    of = written(of.select("class", "rows", "component", "component_id"), "classes")
    drop(own, least, merged)
    every = members.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = members.where("n > 0").select("doc_id", "h", "n", "class")
    out = join_hot(joined, of.drop("rows"), ["class"], hot=of.where(F.col("rows") * HOT > every))
    out = out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component", "component_id")
    none = F.lit(None).cast("long").alias("component")
    return out.unionByName(members.where("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), none, F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    return with_components(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that of the smallest id, with all its columns; rows without words all stay.

    Rows that nothing is said about pass through the scan; only the others, and few more, are shuffled.
    """
    with scope():
        rows = written(with_components(docs, id_col, text_col).select("doc_id", "h", "component"), "components", outer=True)
    # only components of several rows say anything about a row
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    best = rows.where("component is not null").groupBy("component").agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("rows"))
    best = written(best.where("rows > 1"), "best-of-components")
    hot = best.where(F.col("rows") * HOT > rows.agg(F.count(F.lit(1)).alias("n")).scalar())
    concerned = rows.where(F.col("component").isNotNull() & maybe_in(best, "component", F.col("component")))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("h") == F.col("best.h"))
    told = join_hot(concerned, best.drop("rows"), ["component"], hot=hot).groupBy("doc_id", "h").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    told = written(told, "told")
    drop(best)
    # the filter lets rows through that nothing is said about: they stay, as do the best; the others end in the scan
    key = lambda i, h: F.xxhash64(i, h)
    held = Filter(told.select(key("doc_id", "h").alias("k")), "k")
    t = told.select(F.col("doc_id").alias("i"), F.col("h").alias("g"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    mistaken = rows.where(held.may_hold(key("doc_id", "h"))).select("doc_id", "h").distinct().join(t, same, "left_anti").withColumn("n", F.lit(1).cast("long"))
    stay = told.where("stays").select("doc_id", "h", "n").unionByName(mistaken).withColumnsRenamed({"doc_id": "i", "h": "g"})
    stay = written(stay, "staying")
    drop(rows)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs[id_col].cast("long"), F.xxhash64(text)
    maybe, asked = held.may_hold(key(*own)), maybe_in(stay.select(key("i", "g").alias("k")), "k", key(*own))
    packed = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    found = docs.where(maybe & asked).select(packed, own[0].alias("doc_id"), own[1].alias("h")).join(stay, same)
    one = found.where("n > 1").groupBy("doc_id", "h").agg(F.first("row").alias("row")).select("row")
    return docs.where(~maybe).unionByName(found.where("n = 1").select("row").unionByName(one).select("row.*"))
