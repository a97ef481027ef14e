"""Removal of passages that an earlier document already has.

A window is ``size`` consecutive words of one document.  A word goes when some
window over it also starts in a document with a smaller id.

``remove_repeats`` is what the query runs.  It finds repeated windows by routed
hashes, since broadcasting automata of all documents to all documents costs the
square of the table (see the README for figures):

1. Each window of 13 words is known by the smallest of the hashes of the runs of
   five words in it.  About one run in five is some window's smallest, and equal
   windows have equal ones, so only these values travel to find which of them
   more than one document has.
2. Documents with a shared value take their windows under it to the window's
   96-bit key, where those that a smaller document has are found.
3. Each document loses the words under the windows that came back to it.

In steps 1 and 2 a worker first settles what its own documents can settle among
themselves and sends a value on once per batch, so that a passage in a third of
all documents sends a row a batch, not a row a document.

``remove_by_automata`` is the method by the book: documents are dealt to
reference shards of a bounded number of words, each shard becomes a suffix
automaton whose states know the smallest document they end in, the automaton is
broadcast, and all documents stream past it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import keyed_columns
from tidelog.llm.kernels import PLACE, U64, Words, each_slice, mix

WINDOW, RUN = 13, 5
#: Bytes of text whose values a worker settles together before it sends them on.
TOGETHER = 8 << 20
#: Words in one reference shard: the proven bound of what is broadcast at a time.
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """All substrings of several word sequences, each with the smallest id of a sequence that it ends in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.lowest = [-1], [0], [1 << 63]
        self._last = 0
        self._gap = -1

    def _extend(self, word: int, owner: int) -> None:
        nxt, link, length, lowest = self.next, self.link, self.length, self.lowest
        state, p = len(nxt), self._last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        lowest.append(owner)
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                lowest.append(1 << 63)
                while p >= 0 and nxt[p].get(word) == q:
                    nxt[p][word] = copy
                    p = link[p]
                link[q] = link[state] = copy
        self._last = state

    def add(self, words: list[int], owner: int) -> None:
        """Takes in one sequence; word codes are not negative."""
        for word in words:
            self._extend(word, owner)
        self._extend(self._gap, owner)  # a sign of its own keeps matches inside one sequence
        self._gap -= 1

    def close(self) -> SuffixAutomaton:
        """Hands each state the smallest owner of all places where its substrings end."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.lowest[state] < self.lowest[up]:
                self.lowest[up] = self.lowest[state]
        return self

    def earlier(self, words: list[int], owner: int, size: int) -> list[int]:
        """Matching statistics: places where a window of ``size`` words of ``words`` begins that a smaller owner has."""
        nxt, link, length, lowest = self.next, self.link, self.length, self.lowest
        state = matched = 0
        found = []
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched >= size:
                while length[link[state]] >= size:
                    state = link[state]
                matched = min(matched, length[state])
                if lowest[state] < owner:
                    found.append(i - size + 1)
        return found


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    machine = SuffixAutomaton()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for a, b, _, words in each_slice(batch.column(1)):
            codes = (words.hash >> np.uint64(1)).tolist()
            for row in range(a, b):
                machine.add(codes[words.first[row - a] : words.first[row - a + 1]], ids[row])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine.close())], pa.binary())], names=["machine"])


def _matched(machine, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        own = pickle.loads(machine.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple[int, list[int]]] = []
            for a, b, _, words in each_slice(batch.column(1)):
                codes = (words.hash >> np.uint64(1)).tolist()
                for row in range(a, b):
                    if places := own.earlier(codes[words.first[row - a] : words.first[row - a + 1]], ids[row], size):
                        out.append((ids[row], places))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.list_(pa.int32()))], names=["doc_id", "places"])

    return run


def _without(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for i in places or ():
                    gone[i] += 1
                    gone[min(i + size, len(words))] -= 1
                keep = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
                rows.append((len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if not keep.all() else text))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "left_text"])

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, left_text string"


def remove_by_automata(docs: DataFrame, size: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, left_text) by broadcast suffix automata of reference shards."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // (6 * shard_words)))
    places = spark.createDataFrame([], "doc_id long, places array<int>")
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    for shard in range(shards):
        machine = dealt.where(F.col("shard") == shard).select("doc_id", "text").coalesce(1).mapInArrow(_built, "machine binary").first()[0]
        sent = spark.sparkContext.broadcast(bytes(machine))
        places = places.union(docs.mapInArrow(_matched(sent, size), "doc_id long, places array<int>"))
    places = places.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    return docs.join(places, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(_without(size), KEPT)


def _sampled(words: Words, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: the word it begins at, the smallest hash of a run of words in it, its own hash."""
    at, whole = words.windows(size)
    if not len(at):
        return at, whole, whole
    total = np.zeros(len(words.hash) - run + 1, U64)
    for j in range(run):
        total += words.hash[j : j + len(total)] * PLACE[20 + j]
    low, width = mix(total, 99), 1
    while width < size - run + 1:  # minima over 1, 2, 4 ... runs
        step = min(width, size - run + 1 - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return at, low[at], whole


def _together(batches: Iterator[pa.RecordBatch], size: int, run: int) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """Windows of the documents of about ``TOGETHER`` bytes: (id, smallest hash, own hash) and the row number in the batch."""
    held: list[tuple[np.ndarray, ...]] = []
    room = TOGETHER
    for number, batch in enumerate(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, _, chars, words in each_slice(batch.column(1)):
            at, low, whole = _sampled(words, size, run)
            row = np.searchsorted(words.first, at, "right") - 1 + a
            held.append((ids[row], low, whole, row + (number << 32), batch))
            room -= len(chars)
            if room <= 0:
                yield held
                held, room = [], TOGETHER
    if held:
        yield held


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by ``keys`` (the last one first, as lexsort does), and where the values of all but the first key change."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys[1:]])
    return order, new


def _values(size: int, run: int):
    """Rows (told, k, v) of one exchange.  Not told: k is a value to be judged, v its document, null where this worker
    saw it in several; told: k is one of those documents, v the value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches, size, run):
            parts = []
            for ids, low, *_ in held:
                turn = np.ones(len(low), bool)
                turn[1:] = (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])
                parts.append((ids[turn], low[turn]))
            ids, low = (np.concatenate([p[i] for p in parts]) for i in range(2))
            if not len(ids):
                continue
            order, new = _first_of(ids, low)
            ids, low = ids[order], low[order]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(low)) - 1
            several = ids[first] != ids[last]
            yield pa.RecordBatch.from_arrays([pa.array(low[first].view(np.int64)), pa.array(ids[first], mask=several), pa.array(np.zeros(len(first), bool))], names=["k", "v", "told"])
            fresh = np.ones(len(low), bool)
            fresh[1:] = new[1:] | (ids[1:] != ids[:-1])
            told = several[group] & fresh
            yield pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(low[told].view(np.int64)), pa.array(np.ones(int(told.sum()), bool))], names=["k", "v", "told"])

    return work


def _under(size: int, run: int):
    """Rows (gone, k, k2, v) for windows under a shared value.  Of equal windows met together only the smallest
    document's is sent to be judged (k, k2: the window's key, v: the document); the others are gone already (k: the
    document, v: the window)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _together(batches, size, run):
            parts = []
            for batch, rows in itertools.groupby(held, key=lambda h: h[4]):
                rows = list(rows)
                ids, low, whole, row = (np.concatenate([r[i] for r in rows]) for i in range(4))
                shared = batch.column(2)
                off, value = shared.offsets.to_numpy(), shared.values.to_numpy().view(U64)
                owner = np.repeat(np.arange(len(shared)), np.diff(off))
                value = value[off[0] : off[-1]]
                row = row & 0xFFFFFFFF
                mine, theirs = mix(low) ^ row.astype(U64) * PLACE[60], mix(value) ^ owner.astype(U64) * PLACE[60]
                known = np.isin(mine, theirs)
                parts.append((ids[known], whole[known], low[known]))
            ids, whole, low = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order, new = _first_of(ids, whole, low)
            ids, whole, low = ids[order], whole[order], low[order]
            first = np.flatnonzero(new)
            lowest = ids[first][np.cumsum(new) - 1] if len(first) else ids
            fresh = np.ones(len(ids), bool)
            fresh[1:] = new[1:] | (ids[1:] != ids[:-1])
            gone = ids > lowest
            use = (new | gone) & fresh
            ids, whole, low, gone = ids[use], whole[use].view(np.int64), (low[use] & U64(0xFFFFFFFF)).astype(np.int64), gone[use]
            yield pa.RecordBatch.from_arrays([pa.array(gone), pa.array(np.where(gone, ids, whole)), pa.array(np.where(gone, 0, low)), pa.array(np.where(gone, whole, ids))], names=["gone", "k", "k2", "v"])

    return work


def _kept(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1), batch.column(2)
            for a, b, chars, words in each_slice(texts):
                count = np.diff(words.first)
                gone = np.zeros(len(words.hash) + 1, np.int64)
                if lists.null_count < len(lists):
                    at, whole = words.windows(size)
                    row = np.searchsorted(words.first, at, "right") - 1
                    for i in range(a, b):
                        if lists[i].is_valid:
                            x, y = np.searchsorted(row, [i - a, i - a + 1])
                            hit = at[x:y][np.isin(whole[x:y], lists[i].values.to_numpy().view(U64))]
                            np.add.at(gone, hit, 1)
                            np.add.at(gone, hit + size, -1)
                lost = np.cumsum(gone)[:-1] > 0
                total = np.concatenate([[0], np.cumsum(lost)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept = []
                blob, start, end = chars.tobytes(), words.start, words.end
                for i in range(b - a):
                    f, g = words.first[i], words.first[i + 1]
                    if f == g:
                        kept.append(b"")
                        continue
                    own = blob[start[f] : end[g - 1]].split()
                    if removed[i]:
                        own = list(itertools.compress(own, (~lost[f:g]).tolist()))
                    kept.append(b" ".join(own))
                left = pc.if_else(pa.array(removed > 0), pa.array(kept, pa.binary()).cast(pa.string()), texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), left, *[c.slice(a, b - a) for c in batch.columns[3:]]],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "left_text", *batch.schema.names[3:]],
                )

    return work


def repeated_windows(docs: DataFrame, size: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, windows): for each document with any, the hashes of its windows that a document with a smaller id has too.

    ``docs`` has doc_id (long, not null) and text first; further columns travel along unread, so that a plan which
    needs them later can use the same exchange.
    """
    values = docs.select("doc_id", "text").mapInArrow(_values(size, run), "k long, v long, told boolean")
    judged = values.withColumn("n", F.count("*").over(Window.partitionBy("told", "k"))).where("v is not null and (told or n > 1)")
    judged = judged.select(F.expr("if(told, k, v)").alias("doc"), F.expr("if(told, v, k)").alias("value"))
    lists = judged.groupBy("doc").agg(F.collect_list("value").alias("shared"))
    under = docs.join(lists, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "shared", *docs.columns[2:]).mapInArrow(_under(size, run), "gone boolean, k long, k2 long, v long")
    under = under.withColumn("lowest", F.min("v").over(Window.partitionBy("gone", "k", "k2"))).where("gone or v > lowest")
    under = under.select(F.expr("if(gone, k, v)").alias("doc"), F.expr("if(gone, v, k)").alias("window"))
    return under.groupBy("doc").agg(F.collect_list("window").alias("windows"))


def remove_repeats(docs: DataFrame, size: int = WINDOW, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, left_text) and the columns in ``carry`` for each row of ``docs``.

    ``left_text`` is the text as it was if it loses nothing, else its kept words
    joined by one space; ``kept_sha256`` is that of the kept words so joined.  A
    null or empty text has no words.  A row with a null id neither loses words
    nor makes others lose them.  Rows that share an id count as one document:
    they don't make each other lose words, but identical rows lose the same
    ones.  An empty table gives an empty result.
    """
    more = [F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry)]
    kind = dict(docs.dtypes)
    docs = docs.select(*keyed_columns(docs, id_col, text_col), *more)
    names = docs.columns[2:]
    known = docs.where("doc_id is not null")  # the same exchange of texts serves both joins
    joined = known.join(repeated_windows(known, size, run), F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "windows", *names)
    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("windows"), *names)
    schema = ", ".join([KEPT, *[f"{n} {kind[c]}" for n, c in zip(names, carry, strict=True)]])
    return joined.union(rest).mapInArrow(_kept(size), schema).toDF(*[f.split()[0] for f in KEPT.split(", ")], *carry)
