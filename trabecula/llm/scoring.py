"""Language-model scores by the likelihood of a subword lattice.

The vocabulary's existing unigram scores weight every way to cut a word into pieces: a unigram model's are log-probabilities as
they stand, those of a BPE model are ranks, which Zipf's law turns into log-probabilities. ROUNDS passes over the different
training words take the expected number of times that each piece is used, over all segmentations; with the existing weights as
a prior of PRIOR uses a piece these make the weights that score. A word's probability is the sum over all its segmentations, by
a forward recursion in logs. Words are independent, so a text's marginal log-probability is the sum over its words and its end.

The recursion goes over many words at once: a trie of the pieces is walked from all characters, a step for each further
character, and the edges found are summed end by end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, discard, staged
from .pieces import MODEL, SPACE, UNIT, Pieces, load
from .vocabulary import Blocks, strings, text_bytes

ROUNDS, PRIOR = 2, 0.1
#: Bytes of words that the recursion takes at once.
AT_ONCE = 1 << 20


def cut_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each text with A-Z in lower case."""
    data, at = text_bytes(texts)
    inside = (data != 32) & ((data < 9) | (data > 13))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][np.diff(at) > 0]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return strings(lower[inside], np.concatenate([[0], np.cumsum(inside)])[starts]), np.diff(np.searchsorted(starts, at))


def first_weights(v: Pieces) -> dict[str, float]:
    """Probabilities of the pieces by the vocabulary's own scores; a byte is <n>, as likely as the least likely piece."""
    raw = {p: math.exp(-c / UNIT) for p, c in v.costs.items()}
    raw |= {f"<{b}>": min(raw.values()) for b in range(256)}
    total = sum(raw.values())
    return {p: x / total for p, x in raw.items()}


def _sums(place: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of equal places: the place, and ln of the sum of exp(x)."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    top = np.maximum.reduceat(x, first)
    return place[first], top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(first, len(x))))), first))


class Lattice:
    """The pieces as a trie of sorted (node, character) keys, with the logs of their weights."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.names = [*weights]
        self.logs = np.log(np.array([weights[p] for p in self.names]))
        self.byte = {b: self.names.index(f"<{b}>") for b in range(256)}
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for i, p in enumerate(self.names):
            if i in self.byte.values():
                continue
            node = 0
            for c in map(ord, p):
                node = edges.setdefault((node, c), len(edges) + 1)
            ends[node] = i
        keys = np.array([n << 21 | c for n, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([*edges.values()], np.int64)[order]
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[[*ends]] = [*ends.values()]

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of all words, each after a space: the places of their first characters (one more for the end), the characters, and
        start, end and piece of each edge. A word's end has a place too. A character that is no piece has an edge of piece -1.
        """
        chars = np.frombuffer("".join(f"{SPACE}{w}\0" for w in words).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.concatenate([[0], np.cumsum([len(w) + 2 for w in words], dtype=np.int64)])
        last = np.repeat(at[1:] - 1, np.diff(at))
        start = np.flatnonzero(np.arange(len(chars)) < last)
        here, node, found = start, np.zeros(len(start), np.int64), []
        while len(start):
            key = node << 21 | chars[here]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            if not found:
                found.append((start, start + 1, np.where(hit, self.piece[self.to[i]], -1)))
                start, here, node = start[hit], here[hit] + 1, self.to[i[hit]]
            else:
                start, here, node = start[hit], here[hit] + 1, self.to[i[hit]]
                is_piece = self.piece[node] >= 0
                found.append((start[is_piece], here[is_piece], self.piece[node[is_piece]]))
            go = here < last[start]
            start, here, node = start[go], here[go], node[go]
        return at, chars, *(np.concatenate(x) for x in zip(*found))

    def weigh(self, chars: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        x = self.logs[piece]
        odd = piece < 0
        kinds, which = np.unique(chars[start[odd]], return_inverse=True)
        x[odd] = np.array([sum(self.logs[self.byte[b]] for b in chr(c).encode()) for c in kinds.tolist()])[which] if len(kinds) else x[odd]
        return x

    def forward(self, at: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray) -> np.ndarray:
        """ln of the sum over all ways from a word's first place to each place."""
        f = np.full(at[-1], -np.inf)
        f[at[:-1]] = 0.0
        depth = end - at[np.searchsorted(at, start, "right") - 1]
        order = np.lexsort((end, depth))
        start, end, x = start[order], end[order], x[order]
        cuts = np.searchsorted(depth[order], np.arange(1, depth.max() + 2))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
            place, s = _sums(end[i:j], f[start[i:j]] + x[i:j])
            f[place] = s
        return f

    def marginals(self, words: list[str]) -> np.ndarray:
        """ln of each word's probability, the sum over its segmentations."""
        at, chars, start, end, piece = self.edges(words)
        return self.forward(at, start, end, self.weigh(chars, start, piece))[at[1:] - 1]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """How often each piece is used when each word occurs so many times, over all segmentations."""
        at, chars, start, end, piece = self.edges(words)
        x = self.weigh(chars, start, piece)
        f = self.forward(at, start, end, x)
        word = np.searchsorted(at, start, "right") - 1
        # the same recursion from the ends: places mirrored within each word
        low, high = at[word], at[word + 1] - 1
        b = self.forward(at, low + high - end, low + high - start, x)
        used = times[word] * np.exp(f[start] + x + b[low + high - end] - f[high])
        out = np.bincount(piece[piece >= 0], used[piece >= 0], len(self.names))
        for c, n in zip(*(v.tolist() for v in _totals(chars[start[piece < 0]], used[piece < 0]))):
            for y in chr(c).encode():
                out[self.byte[y]] += n
        return out


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, which = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(which, values, len(kinds))


def _slices(words: list[str]) -> Iterator[slice]:
    lo = size = 0
    for i, w in enumerate(words):
        size += len(w) + 2
        if size > AT_ONCE or i + 1 == len(words):
            yield slice(lo, i + 1)
            lo, size = i + 1, 0


def _use(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        found = np.zeros(len(weights))
        for b in batches:
            words, n = b.column("word").to_pylist(), b.column("n").to_numpy()
            for s in _slices(words):
                found += lattice.expected(words[s], n[s])
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([lattice.names[i] for i in at], pa.string()), pa.array(found[at])], ["piece", "used"])

    return run


def _marginals(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for b in batches:
            words = b.column("word").to_pylist()
            x = [lattice.marginals(words[s]) / math.log(10) for s in _slices(words)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(x) if x else np.zeros(0))], [*b.schema.names, "spelt"])

    return run


def learnt(used: dict[str, float], ends: int, prior: dict[str, float]) -> tuple[dict[str, float], float]:
    """Weights of the pieces and of the end, which sum to 1: uses and ends counted, the prior as PRIOR uses a piece and one end."""
    mass = PRIOR * len(prior)
    total = sum(used.values()) + mass + ends + 1
    return {p: (used.get(p, 0.0) + mass * x) / total for p, x in prior.items()}, (ends + 1) / total


def lm_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2, model: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row.

    Tokens are the words of the text, A-Z in lower case, and one end. Rows whose crc32(doc_id as text) mod `modulus` isn't
    `held_out` are learnt from; null ids count as empty text. base_score is the add-one score of the training counts, score the
    lattice's log10 probability. Null and empty texts are an end only. Repeated rows are learnt from and scored each. Without
    training rows no token is known and the pieces keep the vocabulary's weights. An empty table gives an empty result. Other
    columns aren't read. The driver gathers the pieces' use, which the vocabulary file bounds.
    """
    prior = first_weights(load(model))
    src = docs.select("doc_id", (bucket_of("doc_id", modulus) != held_out).alias("learn"), "text")
    blocks = Blocks(src, cut_tokens, "lm-blocks", counted=True)
    same = Window.partitionBy("word")
    counted = blocks.words.withColumn("c", F.sum("n").over(same)).withColumn("nth", F.row_number().over(same.orderBy("super")))
    # as many files as tasks are wanted: the recursion over the words is what takes long
    words = staged(counted.repartition(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "super", "part", "rank"), "lm-words")
    ends = src.filter("learn").count()
    seen, kinds = words.agg(F.sum("n"), F.sum(((F.col("nth") == 1) & (F.col("c") > 0)).cast("long"))).first()
    total, distinct = (seen or 0) + ends, (kinds or 0) + (ends > 0)
    weights, end = learnt({}, ends, prior)
    for _ in range(rounds):
        rows = words.filter("n > 0").select("word", "n").mapInArrow(_use(weights), "piece string, used double").groupBy("piece").agg(F.sum("used")).collect()
        weights, end = learnt(dict(map(tuple, rows)), ends, prior)
    spelt = staged(words.select("super", "part", "rank", "word", "c").mapInArrow(_marginals(weights), "super int, part int, rank int, word string, c long, spelt double").drop("word"), "lm-marginals")
    discard(words)
    rare, base_end, score_end = -math.log10(total + distinct + 1), math.log10(ends + 1), math.log10(end)

    def each(table: pa.Table, codes: np.ndarray, known: pa.Table | None) -> pa.Table:
        n = table.column("n").to_numpy()
        c, spelled = (known.column(x).to_numpy() if known is not None else np.zeros(0) for x in ("c", "spelt"))
        row = np.repeat(np.arange(len(n)), n)
        of = lambda values: np.bincount(row, values[codes], len(n))
        return pa.table({
            "doc_id": table.column("doc_id"), "n_tokens": pa.array(n + 1, pa.int64()), "n_known": pa.array(of((c > 0).astype(float)).astype(np.int64) + (ends > 0), pa.int64()),
            "base_score": pa.array(of(np.log10(c + 1.0)) + (n + 1) * rare + base_end), "score": pa.array(of(spelled) + score_end),
        })

    out = blocks.applied(spelt, each, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (bucket_of("doc_id", modulus) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
