"""SentencePiece encoding and decoding by weighted finite-state transduction.

Three machines are compiled from a model file and composed with each input:

* the normaliser N is a transducer: two tries, of the user-defined pieces (which
  stay as they are) and of the model's table of character replacements, take the
  longest match at each place of the input, and what they write goes through two
  states, in a gap or not, that write a dummy prefix, U+2581 for white space, and
  one for a run where the model collapses them;
* the piece acceptor P is a trie of all pieces, whose final states name a piece,
  and one arc for every character that no piece has, which writes its bytes;
* the merge machine M reads pieces and has the last piece as its state.  For a
  unigram model an arc costs minus the score of its piece.  For a BPE model an
  arc from piece a to piece b costs 0 if merging the characters of a + b by the
  model's scores gives back exactly a, b, and infinity if not: a sequence of
  pieces is the model's encoding just if all its neighbours are such pairs.  Its
  arcs are made when they are first met and kept.  User-defined pieces of a BPE
  model are never merged: the longest at a place, from the left, stand for
  themselves, and what lies between them is read on its own.

The encoding is the shortest path of the input composed with N, P and M in the
tropical semiring (costs add along a path, the least path counts).  Places of the
input are left in order; from each, the trie is walked along the input, and every
final state met relaxes the cost of the place behind it.  Where two neighbouring
characters stand side by side in no piece, as before any run of U+2581, every
path splits; the parts between such places are solved once and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import keyed_texts
from tidelog.llm.kernels import raw, slices

SPACE = "▁"
RUNS = re.compile(" |[^ ]+")
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = range(1, 7)
#: What an unknown character costs a unigram model beyond its worst piece, and what a user-defined piece costs.
UNKNOWN_COST, DEFINED_COST = 10.0, 0.1
#: Distinct chunks whose ids a worker remembers at a time.
REMEMBERED = 600_000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size


class Replacements:
    """A model's table of character replacements: a double array over UTF-8, and the texts that its values point to.

    A unit holds the byte that leads to it, the place of its children and whether a
    word ends there; the child by a byte stands at that place with the byte's bits
    turned over.  The array shares the ends of words, so it is walked as it is.
    """

    def __init__(self, table: bytes):
        size = struct.unpack_from("<I", table)[0] if table else 0
        self.units, self.texts = np.frombuffer(table, "<u4", size // 4, 4 if table else 0).tolist(), table[4 + size :]
        self._said: dict[int, str] = {}

    @staticmethod
    def _children(at: int, unit: int) -> int:
        return at ^ (unit >> 10 << ((unit & 512) >> 6))

    def walk(self, text: str, start: int = 0) -> tuple[int, int, str | None]:
        """How many characters the table has in a row, the end of the longest word, and what is written for it."""
        units, end, value, stop = self.units, start, None, start
        if not units:
            return 0, start, None
        at = self._children(0, units[0])
        while stop < len(text):
            for byte in text[stop].encode():
                at ^= byte
                unit = units[at] if at < len(units) else 0
                if unit & 0x800000FF != byte:
                    return stop - start, end, self._text(value)
                at = self._children(at, unit)
            stop += 1
            if unit >> 8 & 1:
                end, value = stop, units[at] & 0x7FFFFFFF
        return stop - start, end, self._text(value)

    def _text(self, value: int | None) -> str | None:
        if value is not None and value not in self._said:
            self._said[value] = self.texts[value : self.texts.index(0, value)].decode()
        return None if value is None else self._said[value]


class Normaliser:
    """N: the longest user-defined piece or entry of the table at each place, then white space."""

    def __init__(self, prefix: bool, collapse: bool, table: bytes, defined: list[str]):
        self.lead, self.collapse = SPACE if prefix else "", collapse
        self.table, self.defined = Replacements(table), trie({p: p for p in defined})
        self.rewrites = bool(table or defined)
        ascii_ = list(map(chr, range(128)))
        single = {c for c in ascii_ if self.table.walk(c)[2] is not None}
        second = {d for c in ascii_ if self.table.walk(c)[0] for d in ascii_ if self.table.walk(c + d)[0] == 2}
        #: An ASCII text without any of these signs has no match: single ones, and the second signs of longer ones.
        self.marks = single | second | {p[:2][-1] for p in defined}

    def keeps(self, text: str) -> bool:
        """Whether a text surely has no match."""
        return not self.rewrites or text.isascii() and self.marks.isdisjoint(text)

    def _units(self, text: str) -> list[str]:
        if self.keeps(text):
            return RUNS.findall(text) if self.collapse else [text]
        out, at = [], 0
        while at < len(text):
            end, said = longest(self.defined, text, at)
            if said is None:
                _, end, said = self.table.walk(text, at)
            if said is None:
                end, said = at + 1, text[at]
            out.append(said)
            at = end
        return out

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        out, gap = [], self.collapse
        for unit in self._units(text):
            if gap:  # white space at the start and behind white space goes
                unit = unit.lstrip(" ")
            if unit:
                out.append(unit)
                gap = self.collapse and unit[-1] == " "
        said = self.lead + "".join(out).replace(" ", SPACE)
        return said.rstrip(SPACE) if self.collapse else said


def trie(words: dict) -> dict:
    """Nodes are dicts from a character to a node; under the empty string, what stands for the word that ends there."""
    root: dict = {}
    for word, number in words.items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = number
    return root


def longest(root: dict, text: str, start: int) -> tuple:
    """The end of the longest word of a trie at a place of a text, and what stands for it (None: no word)."""
    node, end, found = root, start, None
    for at in range(start, len(text)):
        node = node.get(text[at])
        if node is None:
            break
        if "" in node:
            end, found = at + 1, node[""]
    return end, found


class Transducer:
    """The composed machines of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or trainer.get(24, 0) or not normalizer.get(5, 1) or self.bpe and UNUSED in kinds:
            raise ValueError("only unigram and BPE models are supported, with U+2581 before words, and BPE without unused pieces")
        self.prefix, self.collapse = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.kinds, self.unknown = kinds, kinds.index(UNKNOWN)
        defined = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == DEFINED}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        normal = [self.scores[i] for i in self.ids.values()]
        self.unknown_cost = UNKNOWN_COST - min(normal, default=0.0)
        every = [*self.ids, *defined]
        if not self.bpe:
            for p, i in defined.items():
                self.scores[i] = len(p.encode()) * max([0.0, *normal]) - DEFINED_COST
            self.ids |= defined
        #: User-defined pieces that stand for themselves before anything is merged.
        self.frozen = trie(defined) if self.bpe else {}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        #: Characters that pieces have but that are none by themselves stand behind the pieces; they are unknown if they stay alone.
        halves = sorted({c for p in self.ids for c in p} - self.ids.keys())
        self.names, self.costs = self.pieces + halves, [-x for x in self.scores] + [self.unknown_cost] * len(halves)
        self.trie = trie(self.ids | {c: len(self.pieces) + i for i, c in enumerate(halves)})
        self.normalise = Normaliser(self.prefix, self.collapse, normalizer.get(2, b""), list(defined))
        self.text = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self._pair: dict[int, float] = {}
        #: Neighbours inside some piece.  Between two characters that never are, every path splits.
        self.inside = {p[i : i + 2] for p in every for i in range(len(p) - 1)}
        #: Whether every path splits before any run of U+2581, as it does unless a piece holds one behind another sign.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in every)
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def _merged(self, text: str) -> list[str]:
        """The pieces that merging by score leaves of a short text: the best pair first, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = -inf, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and scores[k] > best:
                    best, at = scores[k], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def arc(self, last: int, piece: int) -> float:
        """The cost in M of reading ``piece`` after ``last`` (-1: at the start; -2: a character without a piece)."""
        if not self.bpe:
            return self.costs[piece] if piece >= 0 else self.unknown_cost
        if piece < 0 or last == -2:
            return 0.0 if piece < 0 or self._merged(self.names[piece]) == [self.names[piece]] else inf
        key = (last + 1) << 32 | piece
        cost = self._pair.get(key)
        if cost is None:
            own = [self.names[piece]] if last < 0 else [self.names[last], self.names[piece]]
            cost = self._pair[key] = 0.0 if self._merged("".join(own)) == own else inf
        return cost

    def shortest(self, chunk: str) -> list[int]:
        """Ids on the shortest path of one normalised chunk."""
        if self.bpe and (whole := self.ids.get(chunk)) is not None and not self.arc(-1, whole):
            return [whole]
        n, root, pair, least = len(chunk), self.trie, self._pair, 0.0 if self.bpe else -inf
        cost, last, back = [inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for start in range(n):
            so_far = cost[start]
            if so_far == inf:
                continue
            before, node = last[start], root
            for at in range(start, n):
                node = node.get(chunk[at])
                if node is None:
                    break
                piece = node.get("")
                if piece is None or cost[at + 1] <= least:  # no path is cheaper than ``least``
                    continue
                more = pair.get((before + 1) << 32 | piece)
                total = so_far + (self.arc(before, piece) if more is None else more)
                if total < cost[at + 1]:
                    cost[at + 1], last[at + 1], back[at + 1] = total, piece, start
            if chunk[start] not in root or "" not in root[chunk[start]]:
                total = so_far + self.arc(before, -2)
                if total < cost[start + 1]:
                    cost[start + 1], last[start + 1], back[start + 1] = total, -2, start
        path, at = [], n
        while at:
            if last[at] == -2 or last[at] >= len(self.pieces):
                code = chunk[back[at] : at].encode()
                path += [self.bytes[b] for b in reversed(code)] if self.bytes else [self.unknown]
            else:
                path.append(last[at])
            at = back[at]
        return path[::-1]

    def _solved(self, chunk: str) -> bytes:
        """Ids of a chunk: those of its parts between places where every path splits.  The chunks met last are kept."""
        found = self._chunks.get(chunk) or self._older.pop(chunk, None)
        if found is None:
            inside, start, out = self.inside, 0, []
            for at in range(1, len(chunk)):
                if chunk[at - 1 : at + 1] not in inside:
                    out.append(self._part(chunk[start:at]))
                    start = at
            out.append(self._part(chunk[start:]))
            found = b"".join(out)
        if len(self._chunks) >= REMEMBERED // 2:
            self._chunks, self._older = {}, self._chunks
        self._chunks[chunk] = found
        return found

    def _part(self, part: str) -> bytes:
        found = self._parts.get(part)
        if found is None:
            if len(self._parts) >= REMEMBERED:
                self._parts.clear()
            ids, start, at = [], 0, 0
            while self.frozen and at < len(part):
                end, piece = longest(self.frozen, part, at)
                if piece is not None:
                    ids += [*self.shortest(part[start:at]), piece]
                    start = end
                at = max(end, at + 1)
            found = self._parts[part] = np.array(ids + self.shortest(part[start:]), "<i4").tobytes()
        return found

    def packed(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.prefix and self.splits and "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text and self.bytes and self.normalise.keeps(text):
            return b"".join([self._chunks.get(c) or self._solved(c) for c in map(SPACE.__add__, text.split(" "))])
        text = self.normalise(text)
        chunks = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text) if self.splits else [text] if text else []
        found = b"".join(map(self._solved, chunks))
        if self.bytes:
            return found
        ids = np.frombuffer(found, "<i4")  # neighbouring unknown characters are one
        return ids[(ids != self.unknown) | (np.r_[-1, ids[:-1]] != self.unknown)].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def lead(self, ids: list[int]) -> int:
        """How many blanks at the start decoding takes off: the dummy prefix, or all where the model collapses them."""
        off = 0
        if self.prefix or self.collapse:
            for k in ids:
                if self.kinds[k] == CONTROL:
                    continue
                if self.kinds[k] in (BYTE, UNKNOWN) or self.pieces[k][:1] != SPACE:
                    break
                off += 1
                if not self.collapse or self.pieces[k] != SPACE:
                    break
        return off

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))[self.lead(ids) :]

    def decode(self, ids: list[int]) -> str:
        """Bytes that don't make UTF-8 become U+FFFD each."""
        data, out = self.decode_bytes(ids), []
        while data:
            try:
                out.append(data.decode())
                break
            except UnicodeDecodeError as e:
                out.append(data[: e.start].decode() + "�")
                data = data[e.start + 1 :]
        return "".join(out)


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        with open(path, "rb") as file:
            _machines[path] = Transducer(file.read())
    return _machines[path]


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(raw(texts)[0]):
                part = texts.slice(a, b - a).to_pylist()
                packed = [own.packed(t or "") for t in part]
                off = np.zeros(b - a + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=off[1:])
                values = np.frombuffer(b"".join(packed), "<i4")
                listed = values.tolist()
                every = list(map(own.text.__getitem__, listed))
                same = []
                for i, text in enumerate(part):
                    said = b"".join(every[off[i] : off[i + 1]])
                    same.append(said[own.lead(listed[off[i] : off[i + 1]]) :] == (text or "").encode())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(off).astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(values)), pa.array(same)], names=["doc_id", "n_ids", "ids", "decodes_back"])

    return run


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids (array of int) and decodes_back for each row of ``docs``.

    ``decodes_back``: the ids decode to the text itself (they don't where the text
    has U+2581, or the model replaces characters or collapses white space).  A null text is empty and has
    no ids.  A very long text is encoded whole, part by part, and takes some 20
    times its size.  Repeated rows are encoded alike, whatever their id.  Further
    columns are left out.  An empty table gives an empty result.

    Unigram and BPE models are taken, with tables of character replacements,
    user-defined pieces and byte fallback.  Models of words or characters, those
    that put U+2581 behind words or keep blanks, and BPE models with unused pieces
    raise ``ValueError``.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return keyed_texts(docs, id_col, text_col).mapInArrow(_encoded(path), "doc_id long, n_ids long, ids array<int>, decodes_back boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text for each row of ``encoded``; null ids give a null text."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(_decoded(path), "doc_id long, text string")
