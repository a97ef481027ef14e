"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table lookups, exact rerank.

1. Equal vectors of a label form one class, which counts its copies.
2. Coarse centroids and, for the residuals, a codebook for each of ``SUBSPACES``
   parts of a vector are fitted on a bounded sample of classes.  Every class is
   put into the list of its nearest centroid with its residual's codes and the
   length of the error that the codes make.
3. A class queries all lists that a vector within reach could be in: those
   whose side of the plane towards its own list meets the cap of directions
   around it whose cosine is at least the threshold.  This loses nothing, for
   vectors of any spread and length.
4. Lists of a label are laid together, or split, to tiles of about ``TILE``
   classes.  A pair of tiles is worked off, once, if some class of one queries a
   list of the other.  Queries travel as vectors, members as codes: asymmetric
   distances (the query itself against the codes, by table lookup) drop what lies
   farther than ``reach`` plus the error of the codes, which loses nothing.
5. Vectors are fetched for what is left, and cosines in double precision decide.
   A pair of tiles writes the number of links of each class and a spanning forest
   of the links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import components, drop, lookup, salts, written
from tidelog.llm.kernels import runs

THRESHOLD = 0.93
#: Most classes that the index is fitted on, subspaces, words of a codebook, most lists.
SAMPLE, SUBSPACES, CODEWORDS, LISTS = 16384, 8, 256, 1024
#: Classes of a tile, and queries of a tile that are compared at a time.
TILE, BLOCK = 2048, 512


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means (Lloyd) from evenly spaced rows; a mean that loses all its rows stays where it was."""
    k = max(1, min(k, len(x)))
    means = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(x[i : i + 2048], means)[0] for i in range(0, len(x), 2048)])
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(means)
        np.add.at(total, near, x)
        means[count > 0] = total[count > 0] / count[count > 0, None]
    return means


def _nearest(x: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest mean of each row, and the squared distances to all means."""
    square = np.maximum((x * x).sum(1)[:, None] - 2 * x @ means.T + (means * means).sum(1), 0)
    return square.argmin(1), square


@dataclass
class Index:
    coarse: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int, subspaces: int = SUBSPACES, codewords: int = CODEWORDS) -> Index:
        """``unit``: a sample of vectors of length 1."""
        width = unit.shape[1]
        coarse = _means(unit, lists)
        rest = unit - coarse[np.concatenate([_nearest(unit[i : i + 2048], coarse)[0] for i in range(0, len(unit), 2048)])]
        cuts = np.linspace(0, width, max(1, min(subspaces, width)) + 1).astype(int).tolist()
        return cls(coarse, cuts, [_means(rest[:, a:b], codewords) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def coded(self, rest: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows x subspaces) of residuals, the length of the error that they make, and their part of a distance that
        doesn't hang on the query: for a member m (mean c, coded residual r) |q - c - r|**2 is |q - c|**2 + (2cr + rr) - 2qr."""
        codes = np.stack([_nearest(p, book)[0] for p, book in zip(self.parts(rest), self.books, strict=True)], axis=1)
        back = np.hstack([book[codes[:, m]] for m, book in enumerate(self.books)])
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1)), (2 * self.coarse[home] * back + back * back).sum(1)

    def distances(self, unit: np.ndarray, home: np.ndarray, codes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Squared asymmetric distances (queries x members) of queries to coded members, by table lookup."""
        total = np.empty((len(codes), len(unit)), np.float32)
        apart = np.ascontiguousarray(_nearest(unit, self.coarse)[1].T).astype(np.float32)
        tables = [(2 * book @ p.T).astype(np.float32) for p, book in zip(self.parts(unit), self.books, strict=True)]
        for low in range(0, len(codes), BLOCK):
            part = apart[home[low : low + BLOCK]] + shift[low : low + BLOCK, None].astype(np.float32)
            for m, table in enumerate(tables):
                part -= table[codes[low : low + BLOCK, m]]
            total[low : low + BLOCK] = part
        return total.T

    def probes(self, unit: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
        """Which lists (rows x lists) can hold a vector whose cosine with the row is at least ``threshold``.

        Such a vector is in a list only if it is no farther from its mean than from that of the row's home list, so if its
        product with the difference of the means reaches ``level``; ``most`` is the greatest such product in the cap.
        """
        own, length = self.coarse[home], (self.coarse * self.coarse).sum(1)
        level = (length - length[home][:, None]) / 2
        apart = np.maximum((own * own).sum(1)[:, None] - 2 * own @ self.coarse.T + length, 0)
        along = unit @ self.coarse.T - (unit * own).sum(1)[:, None]
        aside = np.sqrt(np.maximum(apart - along * along, 0))
        apart = np.sqrt(apart)
        most = np.where(along >= threshold * apart, apart, threshold * along + sqrt(max(0.0, 1 - threshold * threshold)) * aside)
        return most + 1e-6 >= level


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, with zeros behind shorter ones."""
    off = column.offsets.to_numpy()
    size = np.diff(off)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return out


def _scaled(x: np.ndarray, kind: str) -> np.ndarray:
    """Components as doubles whose squares neither overflow nor vanish."""
    return x if kind == "<f4" else x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


ASSIGNED = "label long, dim int, node long, rep long, n long, vector binary, home int, probes array<int>, codes binary, error float, shift float"


def _assigned(index: Index, width: int, threshold: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                raw = _scaled(_matrix(part.column(5), width), kind)
                unit = _unit(raw)
                home = _nearest(unit, index.coarse)[0]
                codes, error, shift = index.coded(unit - index.coarse[home], home)
                probed = index.probes(unit, home, threshold)
                off = np.concatenate([[0], np.cumsum(probed.sum(1))]).astype(np.int32)
                vectors = pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary())
                probes = pa.ListArray.from_arrays(pa.array(off), pa.array(np.nonzero(probed)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:5], vectors, pa.array(home.astype(np.int32)), probes, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.float32)), pa.array(shift.astype(np.float32))], names=[f.split()[0] for f in ASSIGNED.split(", ")])

    return run


def _sided(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Members (side 0, which come first) and queries of a pair of tiles."""
    m = int((rows.column(4).to_numpy() == 0).sum())
    return rows.slice(0, m), rows.slice(m)


def _vectors(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)
    return x, np.sqrt((x * x).sum(1))


PAIR = ["label", "dim", "t1", "t2"]
NEAR = "label long, dim int, t1 long, t2 long, side int, node long"


def _near(index: Index, reach: float, kind: str):
    """(pair of tiles, side, node) of the classes of a pair of tiles that have a class of the other side within reach."""

    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        members, asking = _sided(rows)
        if not len(members) or not len(asking):
            return
        codes = np.frombuffer(b"".join(members.column(8).to_pylist()), np.uint8).reshape(len(members), -1)
        home, node, shift = members.column(7).to_numpy(), members.column(5).to_numpy(), members.column(10).to_numpy()
        far = (np.float32(reach + 1e-4) + members.column(9).to_numpy()) ** 2
        hit, found = np.zeros(len(members), bool), []
        for low in range(0, len(asking), BLOCK):
            part = asking.slice(low, BLOCK)
            x, norm = _vectors(part.column(6), kind)
            near = index.distances(x / norm[:, None], home, codes, shift) <= far
            near &= part.column(5).to_numpy()[:, None] != node[None, :]
            hit |= near.any(0)
            found.append(near.any(1))
        for side, keep in ((members, hit), (asking, np.concatenate(found))):
            yield side.select(range(6)).filter(pa.array(keep))

    return runs(work)


def _linked(threshold: float, kind: str):
    """Rows (a, b, n) of a pair of tiles: n links of class a (b is null), or a link between ids a and b (n is null)."""

    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        members, asking = _sided(rows)
        if not len(members) or not len(asking):
            return
        both_ways = rows.column(2)[0].as_py() != rows.column(3)[0].as_py()  # a tile with itself meets each pair twice
        node, rep, copies = (members.column(i).to_numpy() for i in (5, 6, 7))
        y, y_norm = _vectors(members.column(8), kind)
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while (up := parent.setdefault(i, i)) != i:
                parent[i] = i = parent.setdefault(up, up)
            return i

        a, b, counts, counted = [], [], np.zeros(len(members), np.int64), []
        for low in range(0, len(asking), BLOCK):
            part = asking.slice(low, BLOCK)
            own, own_rep, own_copies = (part.column(i).to_numpy() for i in (5, 6, 7))
            x, norm = _vectors(part.column(8), kind)
            linked = x @ y.T / (norm[:, None] * y_norm[None, :]) >= threshold
            linked &= own[:, None] != node[None, :]
            counted.append((own, linked @ copies))
            if both_ways:
                counts += own_copies @ linked
            for i, j in np.argwhere(linked).tolist():
                s, t = root(int(own_rep[i])), root(int(rep[j]))
                if s != t:
                    parent[max(s, t)] = min(s, t)
                    a.append(int(own_rep[i]))
                    b.append(int(rep[j]))
        counted.append((node, counts))
        who, n = (np.concatenate([c[i] for c in counted]) for i in range(2))
        who, n = who[n > 0].tolist(), n[n > 0].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([*who, *a], pa.int64()), pa.array([*[None] * len(who), *b], pa.int64()), pa.array([*n, *[None] * len(a)], pa.int64())], names=["a", "b", "n"])

    return runs(work)


def _tiles(assigned: DataFrame) -> DataFrame:
    """(label, dim, home, salts, base, subs): the list's tiles are base ... base + subs - 1.  Small lists share a tile; a list of
    more than ``TILE`` classes has several of its own."""
    sizes = assigned.groupBy("label", "dim", "home").agg(F.count("*").alias("n"), salts("node"))
    before = Window.partitionBy("label", "dim").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as lists
    small, own = F.col("n") <= TILE, F.ceil(F.col("n") / TILE).cast("long")
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    base = F.when(small, F.floor(sums(F.when(small, F.col("n"))) / TILE)).otherwise((1 << 40) + sums(F.when(~small, own)))
    return sizes.select("label", "dim", "home", "salts", base.cast("long").alias("base"), F.when(small, F.lit(1)).otherwise(own).cast("long").alias("subs"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, lists: int | None = None, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows whose vector or label or id is null, or whose vector is empty, all zeros
    or holds a null or a number that isn't finite, link with nothing; a null id is
    its own component (null) and is kept.  Vectors of different lengths never
    link.  Rows that share an id are counted one by one in n_links and are one
    node.  Repeated rows link with each other.  A vector's length is bounded by
    memory alone; further columns are left out.  An empty table gives an empty
    result.

    ``label_col`` holds whole numbers.  ``lists`` grows with the square root of
    the number of classes, to ``LISTS`` at most.  No pair is missed; vectors
    without coarse structure query most lists.
    """
    kind = "<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    equal = ["label", "dim", "d1", "d2"]
    known = rows.where(good).withColumns({"dim": F.size("v"), "d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(1), "v")})
    classes = known.groupBy(*equal).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), salts("vec_id"), F.first("v").alias("v"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))
    total, width = classes.agg(F.count("*"), F.max("dim")).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = classes.orderBy(F.xxhash64("rep", "label"), "rep", "label", "d1").limit(sample).select("v").toArrow().column("v").combine_chunks()
    unit = _unit(_scaled(_matrix(chosen, width), kind))
    index = Index.fit(unit, lists or max(1, min(LISTS, isqrt(total) // 4)))
    reach = sqrt(max(0.0, 2 - 2 * threshold))
    assigned = written(classes.select("label", "dim", "node", "rep", "n", "v").mapInArrow(_assigned(index, width, threshold, kind), ASSIGNED))

    home = ["label", "dim", "home"]
    tiles = written(_tiles(assigned))
    tile = F.col("base") + F.pmod(F.xxhash64("node"), F.col("subs"))
    placed = lookup(assigned.withColumnRenamed("n", "copies"), tiles, home, "node")
    placed = written(placed.select(*home, "node", "rep", "copies", "vector", "codes", "error", "shift", "probes", tile.alias("tile")))
    asked = placed.select("label", "dim", "tile", F.explode("probes").alias("home")).distinct().join(tiles.drop("salts"), home)
    asked = asked.select("label", "dim", "tile", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("subs") - 1)).alias("other"))
    pairs = written(asked.select("label", "dim", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2")).distinct())
    none = lambda kind: F.lit(None).cast(kind)
    members = placed.withColumnRenamed("tile", "t2").join(pairs, ["label", "dim", "t2"]).select(*PAIR, F.lit(0).alias("side"), "node", none("binary").alias("vector"), "home", "codes", "error", "shift")
    asking = placed.withColumnRenamed("tile", "t1").join(pairs, ["label", "dim", "t1"]).select(*PAIR, F.lit(1).alias("side"), "node", "vector", none("int").alias("home"), none("binary").alias("codes"), none("float").alias("error"), none("float").alias("shift"))
    near = members.union(asking).repartition(*PAIR).sortWithinPartitions(*PAIR, "side").mapInArrow(_near(index, reach, kind), NEAR)
    near = written(near)
    fetched = near.join(placed.select("node", "rep", "copies", "vector"), "node").select(*PAIR, "side", "node", "rep", "copies", "vector")
    found = written(fetched.repartition(*PAIR).sortWithinPartitions(*PAIR, "side").mapInArrow(_linked(threshold, kind), "a long, b long, n long"))

    # rows that share an id join their classes
    several = known.groupBy("vec_id").agg(F.min(F.struct(*equal)).alias("lo"), F.max(F.struct(*equal)).alias("hi")).where("lo < hi").select("vec_id")
    shared = known.select("vec_id", *equal).join(several, "vec_id", "left_semi").distinct().join(classes.select(*equal, "rep"), equal)
    label = components(found.where("n is null").select("a", "b").union(shared.select("vec_id", "rep")))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = classes.select(*equal, "rep", "n", "node", "salts").join(label.select(F.col("node").alias("rep"), F.col("label").alias("component")), "rep", "left").join(links, "node", "left")
    named = named.select(*equal, "salts", F.coalesce("component", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = lookup(known.select("vec_id", *equal), named, equal, "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    drop(assigned, tiles, placed, pairs, near)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
