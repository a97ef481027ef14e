"""The pipeline by hand: quality rules, near-dedup, substring dedup, pseudonyms, token pieces."""

import hashlib
import re
import zlib

import numpy as np

from tests.llm import test_operators as t
from tidelog.llm import pii, queries


def good(text):
    w, s = t.words(text), text or ""
    seen = t.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    repeated = {j + o for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for o in range(5)}
    lines = [x for x in s.split("\n") if t.words(x)]
    n, chars, signs, twice = len(w), sum(map(len, w)), sum(s.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    stutter = re.search(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:\x20\1){4}(?:[\x20\x09-\x0D]|$)", s)
    return n >= 10 and 100 * len(repeated) <= 20 * n and 10 * signs <= n and chars <= 15 * n and 2 * chars >= 5 * n and 5 * twice <= 2 * max(3, len(s.split("\n"))) and not stutter


def pipeline(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = [(r["doc_id"], r["text"]) for r in rows if good(r["text"])]
    _, label = t.near(docs)
    docs = [(i, x) for i, x in docs if label[i] == i]
    left = t.without(docs)
    docs = [(i, left[i][2] if left[i][1] else x) for i, x in docs]
    key = hashlib.sha256(queries.PII_KEY.encode()).digest()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {}
    for i, x in docs:
        ids = np.array([*coder.encode(pii.replace(x, key)[0], add_special_tokens=False).ids, 2], "<u4")
        ends = range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)
        out[i] = [(k, end - max(0, end - 1024), zlib.crc32(ids[max(0, end - 1024) : end].tobytes())) for k, end in enumerate(ends)]
    return out
