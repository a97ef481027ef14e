"""Toxicity by a chain of linear classifiers.

The chain predicts categories one after the other; the probabilities of the
earlier categories are features of the later models.  A later model is trained
on out-of-fold probabilities of the earlier ones, so that it meets in training
what it will meet in use.  Texts become sets of hashed words and word prefixes.

The label table has one verdict, toxic.  The categories before it are taken
from the same verdict: ``insult`` (toxic texts of several marked words) and
``slur`` (toxic texts of any marked word), where marked words are those that
training finds far more often in toxic texts.  Models are fitted on a bounded
sample of labelled rows and applied to every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import keyed_texts
from tidelog.llm.kernels import PUNCTUATION, U64, Words, each_slice, mix

#: Most labelled rows that the models are fitted on, and features that they keep.
ROWS, FEATURES = 6000, 3000
FOLDS, STEPS, PENALTY = 4, 120, 1e-4
PREFIXES = range(3, 10)
CHAIN = ("insult", "slur", "toxic")
BUCKETS = 1 << 22


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a slice, each pair once: whole words and beginnings of words."""
    owner = words.owner()
    rows, codes = [owner], [words.hash]
    for length in PREFIXES:
        at, value = words.prefixes(length)
        rows.append(owner[at])
        codes.append(value)
    row, code = np.concatenate(rows), (np.concatenate(codes) % U64(BUCKETS)).astype(np.int64)
    both = np.unique(row * BUCKETS + code)
    return both // BUCKETS, both % BUCKETS


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, _, words in each_slice(batch.column(1), lower=True, blank=PUNCTUATION):
            row, code = features(words)
            off = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(off), pa.array(code.astype(np.int32)))], names=["doc_id", "toxic", "codes"])


@dataclass
class Chain:
    """``codes`` (sorted) are the features kept; ``weights`` has a row for each category: features, earlier categories, bias."""

    names: tuple[str, ...]
    codes: np.ndarray
    weights: list[np.ndarray]

    def scores(self, row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """Probabilities (n x categories) of texts given as (row, feature) pairs."""
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        row, at = row[known], at[known]
        root = np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        out = np.zeros((n, len(self.names)))
        for k, w in enumerate(self.weights):
            z = np.bincount(row, w[at], n) / root
            out[:, k] = _logistic(z + out[:, :k] @ w[len(self.codes) : -1] + w[-1])
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Logistic regression by Adam on the rows in ``use``; rare verdicts weigh as much as common ones do."""
    share = min(max(float(y[use].mean()), 1e-6), 1 - 1e-6)
    weight = (use * np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5).astype(np.float32)
    weight /= weight.sum()
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for step in range(1, STEPS + 1):
        g = x.T @ (weight * (_logistic(x @ w) - y).astype(np.float32)) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit_chain(docs: list[np.ndarray], toxic: np.ndarray, names: tuple[str, ...] = CHAIN) -> Chain:
    """Fits the chain on feature sets (arrays of codes) and verdicts.

    A row's fold hangs on the least mixed code of its features, which near copies
    mostly share, so that they are held out together.
    """
    toxic = np.asarray(toxic, float)
    empty = Chain(names, np.zeros(0, np.int64), [np.append(np.zeros(k), -3.0) for k in range(len(names))])
    if not len(docs) or toxic.min() == toxic.max():
        return empty
    fold = np.array([int(mix(d.astype(U64), 77).min()) % FOLDS if len(d) else 0 for d in docs])
    code = np.concatenate(docs)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    all_codes, column = np.unique(code, return_inverse=True)
    with_it = np.bincount(column, toxic[row], len(all_codes))
    count = np.bincount(column, minlength=len(all_codes))
    odds = np.log((with_it + 0.5) / (toxic.sum() + 1)) - np.log((count - with_it + 0.5) / (len(toxic) - toxic.sum() + 1))
    use = np.flatnonzero(count >= 3)
    use = np.sort(use[np.argsort(-np.abs(odds[use]) * np.sqrt(count[use]), kind="stable")[:FEATURES]])
    place = np.full(len(all_codes), -1)
    place[use] = np.arange(len(use))
    row, at = row[place[column] >= 0], place[column[place[column] >= 0]]
    # one matrix for all models: features, the earlier categories (nothing in them till they are known), a column of ones
    x = np.zeros((len(docs), len(use) + len(names)), np.float32)
    x[row, at] = 1
    marked = (odds[use] > 2.5) & (with_it[use] >= 0.02 * toxic.sum())
    hits = x[:, : len(use)] @ marked.astype(np.float32)
    x /= np.sqrt(np.maximum(np.bincount(row, minlength=len(docs)), 1)).astype(np.float32)[:, None]
    x[:, -1] = 1
    target = {"insult": toxic * (hits >= 3), "slur": toxic * (hits >= 1), "toxic": toxic}
    weights, everything = [], np.ones(len(docs), bool)
    for k, name in enumerate(names):
        y, known = target[name], len(use) + k
        w = _fit(x, y, everything)
        weights.append(np.append(w[:known], w[-1]).astype(float))
        if k + 1 < len(names):
            held_out = np.zeros(len(docs), np.float32)
            for f in range(FOLDS):
                if (fold == f).any() and (fold != f).any():
                    held_out[fold == f] = _logistic(x[fold == f] @ _fit(x, y, fold != f))
            x[:, known] = held_out
    return Chain(names, all_codes[use].astype(np.int64), weights)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Chain:
    """Fits the chain on ``rows`` labelled documents at most, those with the lowest hashes of their ids.

    Labels with a null id or verdict, or of an unknown document, are left out; an
    id labelled twice counts twice (``rows`` bounds the labels, twice that the
    documents they meet).  Without labels of both verdicts the chain finds nothing
    toxic.
    """
    sample = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("l_id"), "toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = keyed_texts(docs)
    found = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_feature_sets, "doc_id long, toxic int, codes array<int>")
    table = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows).toArrow()
    column = table.column("codes").combine_chunks()
    off, values = column.offsets.to_numpy(), column.values.to_numpy()
    return fit_chain([values[a:b].astype(np.int64) for a, b in zip(off[:-1], off[1:], strict=True)], table.column("toxic").to_numpy().astype(float))


def _scored(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, words in each_slice(batch.column(1), lower=True, blank=PUNCTUATION):
                row, code = features(words)
                p = chain.scores(row, code, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(p[:, k].copy()) for k in range(p.shape[1])]], names=["doc_id", *[f"p_{n}" for n in chain.names]])

    return run


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, a probability for each category, and is_toxic for each row of ``docs``.

    A null or empty text has no features and gets the models' base rates.  A very
    long text is scored whole; its features take some 100 times its number of words
    in bytes.  Repeated rows get equal scores, whatever their id.  Further columns
    are left out.  An empty table gives an empty result.
    """
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names)
    out = keyed_texts(docs).mapInArrow(_scored(chain), schema)
    return out.withColumn("is_toxic", F.col(f"p_{chain.names[-1]}") >= threshold)
