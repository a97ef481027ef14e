"""Packing of tokenised documents into sequences of a fixed number of tokens.

Only lengths matter to the packing, and a length lies between 1 and the size of
a sequence.  So the plan is made on a histogram, whose size doesn't depend on
the number of documents, by the linear grouping scheme:

1. Pieces over ``LARGE`` of a sequence are sorted and cut into groups of about
   equal cardinality; each length is rounded up to the largest of its group.
2. The few rounded sizes are packed by whole configurations: a linear programme
   over configurations is solved by column generation, its counts are rounded
   down, and what remains is placed first-fit decreasing.
3. Actual pieces take the places of the rounded ones: the largest of the group,
   and in the last place of a configuration the largest piece of any group that
   still fits, so that what rounding up left free is used.
4. The small pieces go, largest first, best fit into the gaps, then into new
   sequences.

Sequences with the same content are kept as one run with a count, so the plan
has a few thousand rows at most.  A second stage numbers the pieces of each
length without gaps (no task holds a whole length) and looks up their places.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import gapless_rank, keyed_texts, written

SIZE, LARGE, END = 1024, 0.25, 2
#: Numbers of groups that are tried.  The plan with the fewest sequences is taken.
GROUPS = (16, 32, 64, 96)
#: What stands for the vocabulary's special token in a text, and its id.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Distinct chunks whose ids a worker remembers at a time.
REMEMBERED = 200_000

_encoders: dict[str, _Chunks] = {}


class _Chunks(dict):
    """Ids (little-endian bytes) of `` chunk``, made when first asked for."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        super().__init__()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.encode(f" {chunk}"), "<u4").tobytes()
        self[chunk] = ids
        return ids

    def text(self, text: str) -> bytes:
        """Ids of a whole text, in which the special token's string stands for the token."""
        if SPECIAL not in text:
            return self._plain(text)
        return np.array([SPECIAL_ID], "<u4").tobytes().join(map(self._plain, text.split(SPECIAL)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens.

        A single space between characters other than white space always begins a
        token, so there the text can be cut; texts with other white space beside
        a space are encoded in one go.
        """
        odd = "  " in text or text[-1:] == " " or " \n" in text or "\n " in text
        if odd or not text.replace("\n", "").isprintable() and any(c in text for c in ODD):
            return np.array(self.encode(text), "<u4").tobytes()
        head, *rest = text.split(" ")
        return np.array(self.encode(head), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


#: White space other than space and line feed, none of which is printable.
ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def encoder(path: str) -> _Chunks:
    if path not in _encoders:
        _encoders[path] = _Chunks(path)
    return _encoders[path]


def _tokenised(path: str, size: int):
    """One row for each piece: (doc_id, piece, start, length, ids_crc32).  Of a cut document only the first piece may be shorter than ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        last = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            row_of: list[int] = []
            for row, text in enumerate(batch.column(1)):
                ids = coder.text(text.as_py() or "") + last
                head = len(ids) % (4 * size) or 4 * size
                for piece, end in enumerate(range(head, len(ids) + 1, 4 * size)):
                    at = max(0, end - 4 * size)
                    part = ids[at:end]
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    row_of.append(row)
            table = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row_of, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *[pa.array(np.ascontiguousarray(table[:, i])) for i in (1, 2, 3)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def _price(worth: np.ndarray, sizes: np.ndarray, limit: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The configuration of the greatest worth: a bounded knapsack over token counts."""
    best = np.zeros(size + 1)
    taken = np.zeros((len(sizes), size + 1), np.int32)
    for k, (length, value) in enumerate(zip(sizes.tolist(), worth.tolist(), strict=True)):
        if value <= 1e-12:
            continue
        most = int(min(limit[k], size // length))
        old = best.copy()
        for n in range(1, most + 1):
            better = old[: size + 1 - n * length] + n * value
            place = slice(n * length, size + 1)
            win = better > best[place] + 1e-12
            best[place] = np.where(win, better, best[place])
            taken[k, place] = np.where(win, n, taken[k, place])
    room, pattern = int(best.argmax()), np.zeros(len(sizes), np.int64)
    worthiest = float(best[room])
    for k in range(len(sizes) - 1, -1, -1):
        pattern[k] = taken[k, room]
        room -= int(pattern[k]) * int(sizes[k])
    return worthiest, pattern


def configurations(sizes: np.ndarray, need: np.ndarray, size: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (counts of each size, how often) that together hold at most ``need`` and leave little over.

    The linear programme over all configurations is solved by column generation; its basis is kept as an inverse.
    """
    k = len(sizes)
    patterns = [np.eye(k, dtype=np.int64)[i] * max(1, min(int(need[i]), size // int(sizes[i]))) for i in range(k)]
    inverse = np.diag([1.0 / p[i] for i, p in enumerate(patterns)])
    basis = np.stack(patterns).astype(float)
    amount = inverse @ need
    for _ in range(rounds):
        duals = np.ones(k) @ inverse
        worth, column = _price(duals, sizes, need, size)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        amount = amount - ratio[leave] * step
        amount[leave] = ratio[leave]
        basis[leave] = column
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
    return [(basis[i].astype(np.int64), int(amount[i] + 1e-7)) for i in range(k) if amount[i] + 1e-7 >= 1]


def plan(histogram: dict[int, int], size: int = SIZE, large: float = LARGE, groups: tuple[int, ...] = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Packs pieces given by length -> count.  Returns (lengths in one sequence, number of such sequences) runs."""
    return min((_grouped(histogram, size, large if n else 1.0, n) for n in groups), key=lambda runs: sum(count for _, count in runs))


def _grouped(histogram: dict[int, int], size: int, large: float, groups: int) -> list[tuple[tuple[int, ...], int]]:
    left = Counter({int(k): int(v) for k, v in histogram.items() if v > 0})
    runs: Counter[tuple[int, ...]] = Counter()
    if left.get(size):
        runs[(size,)] += left.pop(size)
    big = sorted(x for x in left if x > large * size)
    # linear grouping: the lengths, largest first, in groups of about equal cardinality, rounded up to the group's largest
    total = sum(left[x] for x in big)
    members: list[list[int]] = []
    seen, now = 0, -1
    for x in reversed(big):
        if (g := seen * groups // total) > now:
            members.append([])
            now = g
        members[-1].append(x)
        seen += left[x]
    sizes = np.array([m[0] for m in members], np.int64)
    need = np.array([sum(left[x] for x in m) for m in members], np.int64)

    def substitute(pattern: np.ndarray, times: int) -> None:
        """Puts actual pieces in the places of the rounded ones, in runs of equal content: in all places but the last the
        largest of the group, in the last the largest piece of any group that fits, which is one of its own or larger."""
        groups = [i for i, n in enumerate(pattern.tolist()) for _ in range(n)]
        while times > 0:
            want, room, chosen = Counter(), size, []
            for i in groups[:-1]:
                x = next((y for y in members[i] if left[y] - want[y] > 0), None)
                if x is None:
                    return
                want[x] += 1
                chosen.append(x)
                room -= x
            at = bisect.bisect_right(big, room) - 1
            while at >= 0 and left[big[at]] - want[big[at]] <= 0:
                at -= 1
            if at < 0:
                return
            want[big[at]] += 1
            chosen.append(big[at])
            share = min(times, *[left[x] // n for x, n in want.items()])
            for x, n in want.items():
                left[x] -= n * share
            open_runs[tuple(chosen)] += share
            times -= share

    open_runs: Counter[tuple[int, ...]] = Counter()
    if len(sizes):
        for pattern, times in sorted(configurations(sizes, need, size), key=lambda p: -int(p[0] @ sizes)):
            if pattern.sum():
                substitute(pattern, times)
    # gaps: free tokens -> contents with a count; what is left goes best fit, largest first
    gaps: dict[int, Counter[tuple[int, ...]]] = defaultdict(Counter)
    for content, count in open_runs.items():
        gaps[size - sum(content)][content] += count
    frees = sorted(gaps)
    for x in sorted(left, reverse=True):
        count = left[x]
        while count > 0:
            i = bisect.bisect_left(frees, x)
            if i == len(frees):
                fit = size // x
                full, rest = divmod(count, fit)
                for n, times in ((fit, full), (rest, 1)):
                    if n and times:
                        free = size - n * x
                        if free not in gaps:
                            bisect.insort(frees, free)
                        gaps[free][(x,) * n] += times
                break
            free = frees[i]
            content, there = next(iter(gaps[free].items()))
            fit = free // x
            if count >= fit:  # fill as many equal sequences as possible to the brim with this length
                n, times = fit, min(there, count // fit)
            else:
                n, times = count, 1
            count -= n * times
            gaps[free][content] -= times
            if not gaps[free][content]:
                del gaps[free][content]
                if not gaps[free]:
                    del gaps[free]
                    frees.pop(i)
            after = free - n * x
            if after not in gaps:
                bisect.insort(frees, after)
            gaps[after][(*content, *(x,) * n)] += times
    for contents in gaps.values():
        runs.update(contents)
    return sorted(runs.items(), reverse=True)


def places(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each place of each run: (length, first rank, last rank + 1, first sequence, offset).

    Pieces of one length are ranked 0, 1, 2 ...; rank r in a row of this table goes to sequence ``first sequence + r -
    first rank`` at ``offset``.
    """
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for content, count in runs:
        at = 0
        for length in content:
            rows.append((length, used[length], used[length] + count, sequence, at))
            used[length] += count
            at += length
        sequence += count
    return rows


def pack(pieces: DataFrame, size: int = SIZE, large: float = LARGE, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to ``size``)."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    table = places(plan(counts, size, large, groups))
    where = spark.createDataFrame(table or [(0, 0, 0, 0, 0)], "p_length long, low long, high long, first long, offset long")
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    found = ranked.join(F.broadcast(where), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return found.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low")).drop("p_length", "low", "high", "first", "rank")


def tokenised_pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``size`` tokens of every text; a null text is empty and has the end token only."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return keyed_texts(docs, id_col, text_col).mapInArrow(_tokenised(path, size), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row for each piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end token only.  Repeated rows are packed each on
    its own, a null id likewise; pieces of one length take their places in order of
    doc_id and piece.  A very long text is cut into as many pieces as it needs, and
    takes some 20 times its size while it is encoded.  Further columns are left
    out.  An empty table gives an empty result.
    """
    pieces = written(tokenised_pieces(docs, path, size))
    return pack(pieces, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
