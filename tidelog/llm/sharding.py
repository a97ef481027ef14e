"""Hierarchical weighted hash tree: rows go to shards by weighted draws at region, rack and shard level.

At each level every child of the node that a row has come to draws
``-ln(u) / weight`` from a hash of the row's key and the child's own level and
number; the row goes on to the least draw.  A node weighs what its shards weigh
together.  So a row's way hangs on the weights along it only: a changed weight
moves rows into or out of the subtrees whose weights change, from the region
down, and leaves the others' rows where they are.  A region gets rows in
proportion to its weight, a rack to its share of the region, and so on.

A row costs a hash for each child of the nodes on its way, so the number of
expressions follows the largest fan-out of each level, not the number of shards.
With n shards, racks and regions of about n ** (1/3) members are best.

Shards beyond the planned ones stand in regions of their own.  A further shard
then changes no other node's weight and takes rows only into itself, which is
the law ``key``.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fixed, fresh, gapless_rank

#: Shards in a rack, racks in a region.
RACK, REGION = 4, 4
LEVELS = ("region", "rack", "shard")

Tree = list[list[list[tuple[int, float]]]]


def layout(weights: list[float], planned: int, rack: int = RACK, region: int = REGION) -> Tree:
    """Regions of racks of (shard, weight): the first ``planned`` shards fill racks and regions in order, each further one
    has a region of its own."""
    shards = list(enumerate(weights))
    inner = shards[:planned]
    racks = [inner[i : i + rack] for i in range(0, len(inner), rack)]
    return [racks[i : i + region] for i in range(0, len(racks), region)] + [[[s]] for s in shards[planned:]]


def _uniform(*parts: Column) -> Column:
    """A number over 0 and up to 1 from 53 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 1.0) / F.lit(2.0**53)


def descend(df: DataFrame, key: str, tree: Tree, to: str = "shard") -> DataFrame:
    """Adds the shard (int) that the row descends to.  Shards of weight 0 get no rows; all weights 0 are an error.

    A null key draws like any other value, so all null keys meet in one shard.
    """
    weigh = lambda node: node[1] if isinstance(node, tuple) else sum(map(weigh, node))
    lead = lambda node: node[0] if isinstance(node, tuple) else lead(node[0])
    of = lambda values, at: F.get(F.lit(values), at)
    own, here, parents = df.columns, None, [tree]
    for depth, level in enumerate(LEVELS):
        # the nodes of a level, in order of their parents; a node is known by its first shard
        live = [[node for node in children if weigh(node) > 0] for children in parents]
        nodes = [node for children in live for node in children]
        if not nodes:
            raise ValueError("no shard has a weight")
        counts = [len(children) for children in live]
        starts = [sum(counts[:i]) for i in range(len(counts))]
        ids, weights = [lead(node) for node in nodes], [float(weigh(node)) for node in nodes]
        first, most = (F.lit(0), F.lit(counts[0])) if here is None else (of(starts, here), of(counts, here))
        offers = []
        for j in range(max(counts)):
            at = first + j
            draw = -F.log(_uniform(F.lit(depth), of(ids, at), F.col(key), F.lit(0x5EED))) / of(weights, at)
            offers.append(F.when(F.lit(j) < most, F.struct(draw.alias("draw"), at.alias("at"))))
        name = fresh(level)
        df = df.withColumn(name, fixed((F.least(*offers) if len(offers) > 1 else offers[0])["at"]))
        here, parents = F.col(name), nodes
    return df.select(*own, of(ids, here).cast("int").alias(to))


def assign(df: DataFrame, key: str, weights: list[float], to: str = "shard") -> DataFrame:
    """The same without a tree, to compare with: every shard draws, and a changed weight moves rows into or out of its own
    shard only.  A row costs a hash for each shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    draws = [F.struct((-F.log(_uniform(F.lit(s), F.col(key), F.lit(0x5EED))) / F.lit(float(w))).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return df.withColumn(to, (F.least(*draws) if len(draws) > 1 else draws[0])["shard"].cast("int"))


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    ``grown_shard`` is the shard with one more, of the mean weight.  A null text
    has no bytes (size 16, CRC of nothing: 0), an empty one neither; a very long
    one costs no more than its own pass.  A null id is a key like any other.
    Slots number the rows of a shard without gaps; no task holds a whole shard.
    Repeated rows go to one shard, with neighbouring slots.  Further columns are
    left out.  An empty table gives an empty result.
    """
    weights = list(weights or [1.0] * shards)
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data).cast("long") + 16).alias("size"), F.crc32(data).alias("text_crc32"))
    rows = descend(rows, "doc_id", layout(weights, len(weights)))
    rows = descend(rows, "doc_id", layout([*weights, sum(weights) / len(weights)], len(weights)), "grown_shard")
    rows = gapless_rank(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
