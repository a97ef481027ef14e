"""Near-duplicate documents by SuperMinHash signatures, banding, verification and component search.

Every document becomes the set of its distinct word shingles (64-bit hashes).
A SuperMinHash signature gives each shingle a pseudo-random permutation of the
``m`` places; a shingle offers ``rank + uniform`` to the place that its
permutation has at that rank, and each place keeps the smallest offer.  Ranks
are worked off for all shingles of a slice at once, and a document leaves as
soon as its largest kept offer is under the next rank: no later offer can win.

Documents with equal sets form one class.  Classes that agree on a whole band
are candidates; candidates are confirmed on full sets:

1. Each class meets the lowest class of all its buckets.  The links found join
   most groups.
2. Buckets that still hold more than one component are worked off in blocks of
   at most ``BLOCK`` members against ``BLOCK`` members.  The members of a
   bucket's largest component meet only those of the others, so a bucket of one
   great group and a few more costs its members times those few.  Signatures (a
   byte a place) first drop members with no counterpart of another component near
   the threshold; full sets, as products of incidence matrices, decide the rest.
   A block writes a spanning forest of the links between its components, never
   its pairs, so no link that could join two components is lost.

Components are searched over ids (a class goes by its smallest), and rows that
share an id join their classes.  The members of a bucket, a class or a hub never
meet in one task: they are dealt over parts, and what they need goes to each
part that there is (``lookup``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import components, drop, each_salt, keyed_texts, lookup, salt, salts, written
from tidelog.llm.kernels import PLACE, U64, Words, each_slice, mix, runs

SHINGLE, ROWS = 5, 5
#: Sets that agree in these are taken as equal.
EQUAL = ["n_shingles", "d1", "d2"]
#: How often a pair at the threshold may share no band; 20 bands of 5 at 0.85 do about 8 times in a million.
MISS = 1e-5
#: Members of a bucket that one block takes from each side, and columns of an incidence matrix held at a time.
BLOCK, COLUMNS = 512, 2048


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """The fewest bands of which a pair at the threshold shares none with a probability of at most ``miss``."""
    return 1 if percent >= 100 else ceil(log(miss) / log1p(-((percent / 100) ** rows)))


def screen_for(percent: int, places: int, miss: float = MISS) -> int:
    """How many signature places must agree before full sets are compared: at the threshold fewer do with a probability of at most ``miss`` / 40."""
    p, low, tail = min(percent, 100) / 100, 0, 0.0
    while low < places and (tail := tail + comb(places, low) * p**low * (1 - p) ** (places - low)) <= miss / 40:
        low += 1
    return low


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a slice, sorted within the text, and where each text's begin."""
    texts = len(words.first) - 1
    count = np.diff(words.first)
    at, value = words.windows(size)
    owner = words.owner()[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        total = np.zeros(len(short), U64)
        for j in range(size - 1):
            has = count[short] > j
            total[has] += words.hash[words.first[short[has]] + j] * PLACE[j]
        value = np.concatenate([value, mix(total ^ count[short].astype(U64) * PLACE[62], 7)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(texts + 1))


def superminhash(value: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Signatures (texts x m, float64) of the sets ``value[first[i]:first[i+1]]``; a row of an empty set is inf."""
    texts = len(first) - 1
    sign = np.full((texts, m), np.inf)
    flat = sign.reshape(-1)
    owner = np.repeat(np.arange(texts), np.diff(first))
    place = None
    for rank in range(m):
        if not len(value):
            break
        draw = mix(value, 1000 + rank)
        offer = rank + (draw >> U64(32)).astype(np.float64) / 2.0**32
        pick = rank + (((draw & U64(0xFFFFFFFF)) * U64(m - rank)) >> U64(32)).astype(np.int64)
        if rank == 0:
            slot = first_pick = pick
        else:
            rows = np.arange(len(value))
            slot = place[rows, pick].astype(np.int64)
            place[rows, pick] = place[rows, rank]
            place[rows, rank] = slot
        np.minimum.at(flat, owner * m + slot, offer)
        going = sign.max(axis=1) > rank + 1
        stay = going[owner]
        if not stay.all():
            value, owner = value[stay], owner[stay]
            if rank == 0:
                first_pick = first_pick[stay]
            else:
                place = place[stay]
        if rank == 0:
            place = np.tile(np.arange(m, dtype=np.uint16), (len(value), 1))
            rows = np.arange(len(value))
            place[rows, first_pick] = 0
            place[rows, 0] = first_pick
    return sign


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key (as int64) of each band of each signature."""
    bits = np.ascontiguousarray(sign).view(U64).reshape(len(sign), bands, rows)
    key = np.zeros((len(sign), bands), U64)
    for j in range(rows):
        key += mix(bits[:, :, j], 50 + j) * PLACE[j]
    return mix(key + np.arange(bands, dtype=U64) * PLACE[40], 3).view(np.int64)


def _sum(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(value, out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _digests(value: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """The columns EQUAL: size and two digests of each set."""
    return [pa.array(np.diff(first).astype(np.int64)), pa.array(_sum(mix(value, 11), first)), pa.array(_sum(mix(value, 12), first))]


def _rows(table: np.ndarray) -> pa.Array:
    """A binary value for each row of a table of bytes."""
    size = table.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(np.arange(0, len(table) * size + 1, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(table))])


def _signed(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, _, words in each_slice(batch.column(1), lower=True):
                value, first = shingle_sets(words, size)
                sign = superminhash(value, first, bands * rows)
                keys = band_keys(sign, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), *_digests(value, first), pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a) * bands + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1))), _rows((mix(np.ascontiguousarray(sign).view(U64), 5) >> U64(56)).astype(np.uint8))],
                    names=["doc_id", *EQUAL, "bands", "bytes"],
                )

    return run


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, _, words in each_slice(batch.column(1), lower=True):
                value, first = shingle_sets(words, size)
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *_digests(value, first), data.cast(pa.binary())], names=["rep", *EQUAL, "shingles"])

    return run


def _confirmed(percent: int):
    """Keeps (a, b) whose sets ``sa`` and ``sb`` meet ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, other = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = (one, other) if len(one) <= len(other) else (other, one)
                if 100 * len(small) < percent * len(large) or not len(small):
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= percent * (len(one) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])

    return run


def _sides(rows: pa.RecordBatch) -> np.ndarray:
    """Which pairs of rows a block has to compare: not within one component, and each pair in one block only."""
    label = rows.column(5).to_numpy()
    wanted = label[:, None] != label[None, :]
    if rows.column(2)[0].as_py() != rows.column(3)[0].as_py():
        side = rows.column(6).to_numpy()
        wanted &= side[:, None] != side[None, :]
    return wanted


def _screened(least: int):
    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        wanted = _sides(rows)
        signs = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        alike = np.zeros(wanted.shape, np.int16)
        for place in range(signs.shape[1]):
            alike += signs[:, place, None] == signs[None, :, place]
        near = (wanted & (alike >= least)).any(axis=1)
        if near.any():
            yield rows.select(range(7)).filter(pa.array(near))

    return runs(work)


def _joined(percent: int):
    def work(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, wanted = rows.num_rows, _sides(rows)
        if not wanted.any():
            return
        sets = [np.frombuffer(x.as_buffer(), U64) for x in rows.column(7)]
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(n), size)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = (np.cumsum(shared) - 1)[code]
        use = shared[code]
        owner, column = owner[use], column[use]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        both = np.zeros((n, n), np.float64)
        for low in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            part = np.zeros((n, COLUMNS), np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            both += part @ part.T
        both = np.rint(both).astype(np.int64)
        linked = wanted & (100 * both >= percent * (size[:, None] + size[None, :] - both))
        label = rows.column(5).to_pylist()
        parent: dict[int, int] = {x: x for x in label}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for i, j in np.argwhere(np.triu(linked)).tolist():
            a, b = root(label[i]), root(label[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((label[i], label[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], names=["a", "b"])

    return runs(work)


def _links_to_lowest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b: ids) between each class and the lowest class of its buckets.  The set of a class that many meet goes to
    each part that those are dealt to."""
    pairs = members.where("node <> lo").groupBy("node").agg(F.min("lo").alias("hub"))
    one = pairs.join(sets.select("node", F.col("rep").alias("b"), F.col("shingles").alias("sb")), "node").select("hub", salt("node").alias("part"), "b", "sb")
    hubs = each_salt(pairs.groupBy("hub").agg(salts("node")), "part")
    two = hubs.join(sets.select(F.col("node").alias("hub"), F.col("rep").alias("a"), F.col("shingles").alias("sa")), "hub")
    return written(one.join(two, ["hub", "part"]).select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long"))


def _dealt(members: DataFrame, label: DataFrame) -> DataFrame:
    """(band, key, bi, bj, node, label, side): members of buckets with several components, dealt to blocks."""
    place = ["band", "key"]
    named = members.select(*place, "node", "rep").join(label.select(F.col("node").alias("rep"), "label"), "rep", "left").select(*place, "node", F.coalesce("label", "rep").alias("label"))
    sizes = named.groupBy(*place, "label").agg(F.count("*").alias("n"), salts("node")).groupBy(*place).agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "label")).alias("top"), F.bit_or("salts").alias("salts"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    largest = F.col("top.n")
    # the largest component's members are dealt to blocks 0 ... nt - 1, the others' to nt ... nt + no - 1
    open_ = sizes.where("parts > 1").select(*place, "salts", F.col("top.label").alias("top"), blocks(largest).alias("nt"), blocks(F.col("n") - largest).alias("no"))
    found = lookup(named, open_, place, "node")
    mine = F.col("label") == F.col("top")
    own = F.when(mine, F.pmod(F.xxhash64("node"), F.col("nt"))).otherwise(F.col("nt") + F.pmod(F.xxhash64("node"), F.col("no"))).cast("int")
    others = F.explode(F.sequence(F.when(mine, F.col("nt")).otherwise(F.lit(0)), F.col("nt") + F.col("no") - 1))
    found = found.withColumn("own", own).withColumn("other", others)
    return found.select(*place, F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", "label", F.col("own").alias("side"))


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, bands: int | None = None, rows: int = ROWS, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Bands (unless given) and screen follow ``percent``, so that a pair at the
    threshold shares no band with a probability of at most ``miss``: 20 bands of 5
    at 0.85, (1 - 0.85**5)**20 being about 8 in a million.  A null text, or one
    without words, has no shingles and links with nothing.  A null id is its own
    component (null) and is kept.  Rows that share an id are one node, with the
    links of all their texts.  Repeated rows get equal results.  A very long text
    takes memory in proportion, some 15 times its size.  Further columns of
    ``docs`` are left out.  An empty table gives an empty result.
    """
    bands = bands or bands_for(percent, rows, miss)
    docs = keyed_texts(docs, id_col, text_col)
    digests = ", ".join(f"{c} long" for c in EQUAL)
    signed = written(docs.mapInArrow(_signed(bands, rows, shingle), f"doc_id long, {digests}, bands array<long>, bytes binary").withColumn("turn", F.monotonically_increasing_id()))
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy(*EQUAL).agg(F.min("doc_id").alias("rep"), salts("turn"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()))

    place = ["band", "key"]
    members = classes.select("node", "rep", F.posexplode("bands").alias("band", "key"))
    crowded = members.groupBy(*place).agg(F.min("node").alias("lo"), F.max("node").alias("hi"), salts("node")).where("lo < hi").drop("hi")
    members = written(lookup(members, crowded, place, "node"))
    used = members.select("node").distinct().join(classes.select("node", "rep", *EQUAL), "node")
    sets = docs.join(used.select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi").mapInArrow(_packed(shingle), f"rep long, {digests}, shingles binary")
    sets = written(sets.join(used, ["rep", *EQUAL]).dropDuplicates(["node"]).select("node", "rep", "shingles"))
    links = _links_to_lowest(members, sets, percent)
    # rows that share an id join their classes
    several = filled.groupBy("doc_id").agg(F.min(F.struct(*EQUAL)).alias("lo"), F.max(F.struct(*EQUAL)).alias("hi")).where("lo < hi").select("doc_id")
    shared = filled.select("doc_id", *EQUAL).join(several, "doc_id", "left_semi").distinct().join(classes.select(*EQUAL, "rep"), EQUAL)
    label = written(components(links.union(shared.select("doc_id", "rep"))))

    keys = [*place, "bi", "bj"]
    dealt = _dealt(members, label)
    shape = T.StructType(dealt.schema.fields)
    dealt = dealt.join(classes.select("node", "bytes"), "node").select(*shape.names, "bytes")
    near = written(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_screened(screen_for(percent, bands * rows, miss)), shape))
    more = near.join(sets, "node").select(*shape.names, "shingles").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_joined(percent), "a long, b long")
    more = written(more)
    joined = components(more)
    # (rep, label): the label of the first search, and where the second joined that to another
    final = label.groupBy("label").agg(salts("node")).join(joined.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left")
    final = lookup(label, final, ["label"], "node").select(F.col("node").alias("rep"), F.coalesce("lower", "label").alias("component_id"))
    # ids that the first search has no row for, met or not, can still have been joined in the second
    alone = joined.join(label.select("node"), "node", "left_anti").select(F.col("node").alias("rep"), F.col("label").alias("component_id"))
    named = classes.select(*EQUAL, "rep", "salts").join(final.union(alone), "rep", "left").select(*EQUAL, "salts", F.coalesce("component_id", "rep").alias("component_id"))
    out = lookup(filled.select("doc_id", "turn", *EQUAL), named, EQUAL, "turn").select("doc_id", "n_shingles", "component_id")
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    drop(members, sets, links, near)
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
