"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftline.llm.common import gapless, read, store


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def fleet(regions: int = 5, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """An even tree; shards are numbered from 0."""
    return [Leaf(f"region{a}", f"region{a}/rack{b}", (a * racks + b) * shards + c) for a in range(regions) for b in range(racks) for c in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: no old subtree's weight changes, so rows move into the new shard and nowhere else."""
    n = max(x.shard for x in leaves) + 1
    return [*leaves, Leaf(f"region+{n}", f"region+{n}/rack0", n, weight)]


def _draw(key: Column, level: str, node: str, weight: float) -> Column:
    """An exponential draw of rate weight, from 53 bits of a hash of the key and the node."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(f"{level}|{node}"), key), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(u) / F.lit(weight)


def _choose(key: Column, level: str, weights: dict) -> Column:
    """The node with the least draw; of equal draws the first."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.array_min(F.array(*[F.struct(_draw(key, level, str(k), w).alias("d"), F.lit(k).alias("n")) for k, w in weights.items()]))["n"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: a weighted draw among regions, then among the chosen region's racks, then among that rack's shards.

    A change of weight in one subtree moves rows into or out of that subtree and shuffles rows only inside it; draws of other
    nodes don't change. Leaves of weight 0 get no rows. A null key is a key like any other."""
    leaves = [x for x in leaves if x.weight > 0]
    if not leaves:
        raise ValueError("a fleet needs a leaf of positive weight")
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for x in leaves:
        tree.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x.weight
    weigh = lambda node: sum(weigh(v) for v in node.values()) if isinstance(node, dict) else node

    def descend(node: dict, level: int) -> Column:
        names = ("region", "rack", "shard")
        if level == 2:
            return _choose(key, names[2], node)
        if len(node) == 1:
            return descend(next(iter(node.values())), level + 1)
        # the draw is made once and bound, then the branch of the winner alone is worked out
        drawn = F.array(_choose(key, names[level], {k: weigh(v) for k, v in node.items()}))

        def pick(won: Column) -> Column:
            out = None
            for k, v in node.items():
                out = (F.when if out is None else out.when)(won == k, descend(v, level + 1))
            return out

        return F.transform(drawn, pick)[0]

    return descend(tree, 0)


def shard_documents(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places every row. -> key, size, text_crc32, shard, slot, grown_shard (its shard in `grown`).

    size: the text's UTF-8 bytes and 16; a null text counts as empty. slot: gapless from 0 in each shard, in no given order. Repeated
    rows get the same shard and different slots. Null keys share one shard. Other columns are not read; no rows give no rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    placed = store(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + 16).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            shard_of(F.col(key), leaves).cast("int").alias("shard"),
            shard_of(F.col(key), grown).cast("int").alias("grown_shard"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "placed",
    )
    return gapless(placed, "shard", len(leaves), "uid", "slot").drop("uid").withColumnRenamed("doc_id", key)


def op2_shards(spark, sf_dir: str) -> DataFrame:
    now = fleet()
    out = shard_documents(read(spark, sf_dir, "documents"), now, grow(now))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
