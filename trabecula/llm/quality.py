"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed words, of word shapes (runs of upper case, lower case, digits and marks) and of a few binned
measures such as the share of repeated neighbours. Inverse document frequencies are counted over all documents; the latent
space is the leading right singular vectors of a bounded sample of labelled texts. The sample's latent vectors are broadcast
(MOST_LABELLED rows of N_LATENT numbers at most) and every document's cosine with all of them is computed in blocks. The
nearest K vote, each with its similarity to the power SHARPEN.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, thrifty

WORDS, SHAPES, BINNED = 768, 256, 64
DIMS = WORDS + SHAPES + BINNED
MOST_LABELLED, N_LATENT, K, SHARPEN, BLOCK = 4096, 48, 25, 8, 512
#: Weights of the three parts of a text's vector.
PARTS = (0.25, 1.0, 0.75)


_RUNS = re.compile(r"([A-Z]+)|([a-z]+)|([0-9]+)|(.)\4*", re.S)
_NAMES = ("A", "a", "0")


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a and 0, other characters once for each run.

    Letters beyond ASCII are taken for a small or a capital e.
    """
    if word.isalpha() and (word.islower() or word.istitle() and word[1:].islower()):  # most words
        return "a" if word.islower() else "Aa"
    if not word.isascii():
        word = "".join(c if c < "\x80" else "E" if c.isupper() else "e" if c.isalpha() else c for c in word)
    return "".join([m[4] or _NAMES[m.lastindex - 1] for m in _RUNS.finditer(word)])


class Featurizer:
    """Texts to rows of DIMS numbers. Words met before are looked up; the table starts anew when it is full."""

    def __init__(self) -> None:
        self.known = Known()

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), DIMS), np.float32)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for row, text in zip(out, texts):
            ws = (text or "").split()
            if not ws:
                continue
            n = len(ws)
            counts = Counter(ws)
            ij = np.array(list(map(known.__getitem__, counts)))
            c = np.fromiter(counts.values(), np.float64, len(counts))
            row[:WORDS] = np.bincount(ij & 0xFFFF, c, WORDS)
            row[WORDS : WORDS + SHAPES] = np.bincount(ij >> 16, c, SHAPES)
            row[: WORDS + SHAPES] /= n
            measures = (sum(map(eq, ws, ws[1:])) / n, len(counts) / n if n > 30 else 1.0, len(text) / n / 20, min(1.0, float(c.max()) / n * 2) if n > 30 else 0.0)
            for k, v in enumerate(measures):
                row[WORDS + SHAPES + 16 * k + min(15, int(v * 16))] = 1.0
        np.sqrt(out, out)
        return out


class Known(dict):
    """Word -> hash of the word below WORDS, and the hash of its shape below SHAPES in the higher bits."""

    def __missing__(self, word: str) -> int:
        x = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS | zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPES << 16
        return x


def features(texts: list[str | None], featurizer: Featurizer) -> np.ndarray:
    x = featurizer(texts)
    for (lo, hi), w in zip(((0, WORDS), (WORDS, WORDS + SHAPES), (WORDS + SHAPES, DIMS)), PARTS):
        x[:, lo:hi] *= w
    return x


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f, total, n = Featurizer(), np.zeros(DIMS, np.int64), 0
    for b in batches:
        for i in range(0, len(b), BLOCK):
            x = f(b.column("text").slice(i, BLOCK).to_pylist())
            total += (x > 0).sum(0)
            n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), -1], pa.int32()), pa.array([*total.tolist(), n], pa.int64())], ["dim", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Featurizer()
    for b in batches:
        texts = b.column("text").to_pylist()
        x = features(texts, f).astype(np.float16)
        yield pa.RecordBatch.from_arrays([b.column("sample_label"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


class Model:
    def __init__(self, idf: np.ndarray, axes: np.ndarray, latent: np.ndarray, labels: np.ndarray, prior: float) -> None:
        self.idf, self.axes, self.latent, self.labels, self.prior = idf, axes, latent, labels, prior

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest, drawn a little to the share of all; texts with no words get that."""
        if not len(self.latent):
            return np.full(len(x), self.prior)
        s = self.project(x) @ self.latent.T
        k = min(K, s.shape[1])
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(s, at, 1), 0.0).astype(np.float64) ** SHARPEN
        out = ((w * self.labels[at]).sum(1) + 0.05 * self.prior) / (w.sum(1) + 0.05)
        return np.where(x.any(1), np.clip(out, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """docs(doc_id, text), labels(doc_id, quality): the caller has left out what may not be learnt from.

    Ids labelled more than once count by their mean, from 0.5 as 1; null ids and labels are left out. Of several rows of one id
    the least text is learnt from. The sample is the
    most_labelled labelled ids with the smallest hashes; it bounds what is collected and broadcast.
    """
    labelled = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("sample_label"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "sample_label").agg(F.min("text").alias("text"))
    rows = chosen.select("text", "sample_label").mapInArrow(thrifty(_vectors), "label int, x binary").collect()
    counts = {r[0]: r[1] for r in docs.select("text").mapInArrow(thrifty(_frequencies), "dim int, n long").groupBy("dim").agg(F.sum("n")).collect()}
    n = max(counts.get(-1, 0), 1)
    idf = np.log1p(n / (1.0 + np.array([counts.get(d, 0) for d in range(DIMS)]))).astype(np.float32)
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y):
        return Model(idf, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32) * idf
    _, axes = np.linalg.eigh(x.T.astype(np.float64) @ x)
    model = Model(idf, np.ascontiguousarray(axes[:, ::-1][:, :N_LATENT]).astype(np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()))
    z = x @ model.axes
    model.latent = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return model


def scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """docs with one more column, double: the score of its text. All in one pass over docs, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast((model.idf, model.axes, model.latent, model.labels, model.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, m = Featurizer(), Model(*held.value)
        for b in batches:
            parts = [m.score(features(b.column("text").slice(i, BLOCK).to_pylist(), f)) for i in range(0, len(b), BLOCK)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(thrifty(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """-> one row for each row of docs: doc_id, held_out, score, predicted.

    Labels are learnt from rows whose crc32(doc_id as text) mod `modulus` isn't `held_out`; null ids count as empty text. Only
    the text is an input of the score. Null and empty texts get the labelled share of 1 (0.5 without labels). Repeated rows
    score alike. Empty tables give empty results. Other columns aren't read.
    """
    model = fit(docs, labels.filter(bucket_of("doc_id", modulus) != held_out), most_labelled)
    out = scored(docs.select("doc_id", "text"), model, "score")
    return out.select("doc_id", (bucket_of("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
