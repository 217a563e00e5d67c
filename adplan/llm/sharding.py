"""Hierarchical weighted hash tree: region, rack and shard are drawn one below the other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one counting bucket of a shard should hold.
ROWS_PER_BUCKET = 50_000


@dataclass(frozen=True)
class Tree:
    """shards leaves; racks of per_rack shards and regions of per_region racks are filled in order."""

    shards: int
    per_rack: int = 4
    per_region: int = 2

    def racks(self) -> list[list[int]]:
        return [list(range(i, min(i + self.per_rack, self.shards))) for i in range(0, self.shards, self.per_rack)]

    def regions(self) -> list[list[list[int]]]:
        racks = self.racks()
        return [racks[i:i + self.per_region] for i in range(0, len(racks), self.per_region)]


def _draw(key: Column, level: str, nodes: list[tuple[int, int]]) -> Column:
    """The node whose weighted draw is the smallest. nodes: (number, weight).

    Node n draws -ln(u) / weight, u from the hash of key, level and n. A node that gains weight
    can only win keys, never hand one on to a sibling.
    """
    if len(nodes) == 1:
        return F.lit(nodes[0][0])

    def draw(number: int, weight: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{number}")), 11) + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("d"), F.lit(number).alias("n"))

    return F.array_min(F.array(*[draw(n, w) for n, w in nodes])).n


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: three draws, each among the children of the node drawn before.

    Only the key and the tree decide. A shard that opens a new region (as shard 16 does next to
    two full regions) takes rows only into itself; one that joins an existing rack changes the
    weights on its own path alone, so rows move only into its region and, there, its rack.
    """
    if tree.shards < 1:
        raise ValueError("a tree needs a shard")
    size = lambda racks: sum(map(len, racks))
    regions = tree.regions()
    region = _draw(key, "region", [(i, size(r)) for i, r in enumerate(regions)])
    shard = None
    for i, racks in enumerate(regions):
        rack = _draw(key, f"region {i}", [(j, len(s)) for j, s in enumerate(racks)])
        inner = None
        for j, shards in enumerate(racks):
            leaf = _draw(key, f"region {i} rack {j}", [(s, 1) for s in shards])
            inner = leaf if inner is None else F.when(rack == j, leaf).otherwise(inner)
        shard = inner if shard is None else F.when(region == i, inner).otherwise(shard)
    return shard.cast("int")


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Law `key`: doc_id and the number of shards decide; grown_shard is the place among one shard
    more. size is the text's UTF-8 bytes plus 1; a null text has no bytes. slot counts the rows of
    a shard from 0 without gaps; repeated rows get slots of their own. A null doc_id is a key like
    any other. Extra columns are ignored; an empty table gives no rows. Rows are numbered inside
    hash buckets of a shard whose number grows with the table, so no task orders a whole shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), place(F.col("doc_id"), Tree(shards)).alias("shard"),
        place(F.col("doc_id"), Tree(shards + 1)).alias("grown_shard"))
    buckets = max(16, docs.count() // (ROWS_PER_BUCKET * shards) + 1)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard",
                           (F.col("start") + F.col("at")).cast("long").alias("slot"), "grown_shard")
