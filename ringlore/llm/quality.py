"""Quality classifier of supervised subword embeddings.

A document's features are its words, the character n-grams of its words (over UTF-8 bytes, with word bounds)
and its word pairs, hashed into ``BUCKETS`` vectors.  A pair's hash is the exclusive or of its words', so a
word that follows itself is one feature whatever the word.  The vectors are averaged and a softmax layer
tells the two classes; all of it is learned by stochastic gradient descent in numpy, a document at a time
(Joulin et al., "Bag of tricks for efficient text classification").

Training reads a bounded sample of the labelled rows; scoring reads every whole text.  With two classes
and a linear layer, a feature's part in the score is one number, so scoring sums numbers per distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .textcodes import give_back, slices

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4)
#: characters that are scored at a time
SLICE = 2 << 20
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, RATE = 3000, 16 << 20, 8, 0.5


class Model(NamedTuple):
    """The part of each feature in the logit of class 1, and the bias; ``learned``: whether there were labels of both classes."""

    part: np.ndarray
    bias: float
    learned: bool = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (_mix(h) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


class Features(NamedTuple):
    """Of a batch of texts: words as codes, and each distinct word's hash and features."""

    codes: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray

    def pairs(self) -> np.ndarray:
        """Bucket of the pair of each word and the one before it; of a text's first word -1."""
        h = self.hashes[self.codes]
        out = np.full(len(h), -1, np.int64)
        out[1:] = _bucket((h[1:] ^ h[:-1]) + np.uint64(1))
        out[self.at[:-1][self.at[:-1] < len(h)]] = -1
        return out


def features(texts: pa.Array) -> Features:
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    at = lists.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    ends = np.cumsum(size)
    start = ends - size
    # <word> of all distinct words, one after the other
    data = np.full(int(size.sum()), ord("<"), np.uint64)
    raw = np.frombuffer(b"><".join(words.cast(pa.binary()).to_pylist()), np.uint8)
    if len(words):
        data[1:-1], data[-1] = raw, ord(">")
    hashes, grams, of = np.zeros(len(words), np.uint64), [], []
    if len(words):
        # a word's hash: the sum of its bytes, mixed with their places
        place = np.arange(len(data)) - np.repeat(start, size)
        hashes = _mix(np.add.reduceat(_mix(data + np.uint64(257) * place.astype(np.uint64)), start))
        word = np.repeat(np.arange(len(words)), size)
        for n in GRAMS:
            if len(data) >= n:
                h = np.full(len(data) - n + 1, n, np.uint64)
                for i in range(n):
                    h = h * np.uint64(1099511628211) ^ data[i : len(data) - n + 1 + i]
                inside = word[: len(h)] == word[n - 1 :]
                grams.append(_bucket(h[inside]))
                of.append(word[: len(h)][inside])
    grams, of = [_bucket(hashes), *grams], [np.arange(len(words)), *of]
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return Features(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), at, hashes, np.concatenate(grams)[order], np.searchsorted(of[order], np.arange(len(words) + 1)))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> Model:
    """SGD over the documents; the learning rate falls linearly. Without both labels, nothing is learned."""
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    bias = np.log(share / (1 - share))
    part = np.zeros(BUCKETS, np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(part, float(bias) if len(labels) else 0.0, False)
    docs = []
    for i in range(0, len(texts), 256):
        f = features(pa.array(texts[i : i + 256], pa.string()))
        pairs = f.pairs()
        for a, b in zip(f.at[:-1], f.at[1:]):
            word, n = np.unique(f.codes[a:b], return_counts=True)
            k = f.gram_at[word + 1] - f.gram_at[word]
            where = np.repeat(f.gram_at[word] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            pair = pairs[a:b][pairs[a:b] >= 0]
            ids, back = np.unique(np.concatenate([f.grams[where], pair]), return_inverse=True)
            weight = np.bincount(back, np.concatenate([np.repeat(n, k), np.ones(len(pair))]), len(ids))
            docs.append((ids.astype(np.int32), (weight / max(1.0, weight.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    out, out_bias = np.zeros((2, DIM), np.float32), np.array([0.0, bias], np.float32)
    step, total = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, weight = docs[i]
            lr = rate * (1 - step / total)
            step += 1
            mean = weight @ vectors[ids]
            z = out @ mean + out_bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, mean)
            out_bias -= 0.1 * lr * p
            if len(ids):
                # each feature moves by its share, scaled so that documents of any length move alike
                vectors[ids] -= np.outer(weight * (lr / float(weight @ weight) ** 0.5), back)
    return Model(vectors @ (out[1] - out[0]), float(out_bias[1] - out_bias[0]))


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of class 1 of each text."""
    f = features(texts)
    n_words = len(f.hashes)
    sums = np.add.reduceat(model.part[f.grams].astype(np.float64), f.gram_at[:-1]) if n_words else np.zeros(0)
    pairs = f.pairs()
    own = sums[f.codes] + np.where(pairs >= 0, model.part[pairs], 0)
    n = (np.diff(f.gram_at)[f.codes] if n_words else np.zeros(0, np.int64)) + (pairs >= 0)
    # each document's sum is taken over its own words alone, so that its score doesn't depend on its neighbours
    full = f.at[:-1] < f.at[1:]
    z = np.full(len(full), model.bias)
    z[full] += np.add.reduceat(own, f.at[:-1][full]) / np.maximum(1, np.add.reduceat(n, f.at[:-1][full])) if full.any() else 0
    return 1 / (1 + np.exp(-z))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Model:
    """Learns from at most ``rows`` labelled documents of at most ``size`` bytes together, drawn by a hash of the id.

    Rows with a null or other label than 0 and 1, and held-out rows, are not learned from.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_quality"))
    drawn = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    # as many rows as were drawn, a broadcast of `rows` rows at most; their sizes first, then the texts within `size`
    sizes = texts.join(F.broadcast(drawn), "_id").groupBy("_id").agg(F.max(F.octet_length("_text")).alias("n"), F.max("_quality").alias("_quality"))
    chosen, left = [], size
    for r in sizes.orderBy(F.xxhash64("_id"), "_id").collect():
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["_id"], r["_quality"]))
    if not chosen:
        return train([], np.zeros(0, np.int64))
    keys = docs.sparkSession.createDataFrame(chosen, T.StructType([texts.schema["_id"], T.StructField("_quality", T.IntegerType())]))
    got = texts.join(F.broadcast(keys), "_id").groupBy("_id", "_quality").agg(F.max("_text").alias("_text")).orderBy("_id").toArrow()
    labels, texts = got["_quality"].to_numpy().astype(np.int64), got["_text"].to_pylist()
    del got
    model = train(texts, labels)
    del texts
    give_back()
    return model


def _score_task(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            yield pa.record_batch([batch.column("doc_id"), pa.array(score(model, batch.column("text")))], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every document; null and empty texts get the score of no features, the bias alone."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_score_task(model), T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The documents that score ``least`` or more, with their own columns.

    Null and empty texts score by the bias alone.  Repeated rows and null ids are each judged by their text.  A model that
    had no two classes to learn from rejects nothing.
    """
    if not model.learned:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SLICE):
            yield batch.filter(pa.array(score(model, batch.column(text_col)) >= least))

    return docs.mapInArrow(run, docs.schema)
