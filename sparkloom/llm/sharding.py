"""Sharding by a hierarchical weighted hash tree. DataFrame functions only; no shuffle carries a text.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, with u in (0, 1) from a hash of
the key and the child's name, and the smallest draw wins: a child gets keys in proportion to its weight, and a change
of one weight moves keys only into or out of that child's subtree. grow() adds a region with one shard of its own, so
that every key that moves goes to the new shard.

Defined results. The key is the doc_id alone: equal texts with other ids may be in other shards. A null id is a key of
its own. A null text has no bytes. Repeated rows get the same shard and slots of their own. An empty table gives an
empty result. Other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .runtime import written

#: Parts of each shard that are numbered on their own; their counts (shards x parts rows at most) give the offsets.
PARTS = 1024


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = field(default_factory=tuple)
    shard: int = -1

    def load(self) -> float:
        return sum(c.load() for c in self.children) if self.children else self.weight

    def leaves(self) -> list[int]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self.shard]


def tree(shards: int, per_rack: int = 4, racks: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to shards - 1, per_rack in a rack and `racks` racks in a region."""
    leaf = lambda s: Node(f"shard{s}", (weights or {}).get(s, 1.0), (), s)
    rack = [Node(f"rack{r}", 0, tuple(leaf(s) for s in range(r * per_rack, min(shards, (r + 1) * per_rack)))) for r in range(-(-shards // per_rack))]
    region = [Node(f"region{g}", 0, tuple(rack[g * racks : (g + 1) * racks])) for g in range(-(-len(rack) // racks))]
    return Node("root", 0, tuple(region))


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own: keys move only into it."""
    s = max(root.leaves()) + 1
    return Node(root.name, 0, (*root.children, Node(f"grown-region{s}", 0, (Node(f"grown-rack{s}", 0, (Node(f"shard{s}", weight, (), s),)),))))


def draw(key: Column, child: Node) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.ln(u) / F.lit(float(child.load()))


def place(key: Column, node: Node) -> Column:
    """The shard of a key below a node."""
    live = [c for c in node.children if c.load() > 0]
    if not node.children:
        return F.lit(node.shard)
    if len(live) == 1:
        return place(key, live[0])
    best = F.array_min(F.array(*[F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(live)]))["i"]
    out = F.when(best == 0, place(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(best == i, place(key, c))
    return out


def shard(docs: DataFrame, root: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    root = root or tree(16)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", place(F.col("doc_id"), root).cast("int"))
    # only the added child's draws can change a key's way: both placements share the hash of the unchanged children
    rows = rows.withColumn("grown_shard", place(F.col("doc_id"), grow(root)).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(PARTS)).cast("int"))
    rows = written(rows, "shard-rows")  # the texts are read once; what follows reads a few numbers a row
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("at", F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1)
    # starts: shards x PARTS rows at most
    out = numbered.join(F.broadcast(starts), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), "grown_shard")
