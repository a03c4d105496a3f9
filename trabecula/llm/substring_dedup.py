"""Substring deduplication over a log-structured fingerprint index.

The fingerprint of a window of WINDOW words is the hash of its least GRAM-word run, so that equal windows have equal
fingerprints and neighbouring windows mostly share one: about one position in seven is kept. Each batch's fingerprints are an
immutable run, a table bucketed and sorted by fingerprint. A new run is merge-joined with itself and with the runs before it,
bucket by bucket without a shuffle; the positions whose fingerprint occurs elsewhere are what could repeat. Runs are compacted
into one when FAN have gathered. Only the windows at those positions are then verified: their own hashes of 98 bits are grouped,
the earliest of a group stays, and every later one marks its words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, release, staged
from .shingles import flat, mixed, runs, slices, word_hashes

WINDOW, GRAM, FAN = 20, 6, 2
#: A window's start has the low bits of its place, 34 more bits of its hash the high ones. A string of 2 GB has fewer words.
START_BITS = 30


def least_grams(hashes: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of all texts: index of the window's first word, index of the first word of its least run, that run's hash.

    Ties of hashes within a window go to the first, which equal windows share too.
    """
    n, spread = len(hashes), window - gram + 1
    starts = np.arange(max(0, n - window + 1))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = starts[text[starts] == text[starts + window - 1]] if len(starts) else starts
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    g = runs(hashes, gram)
    low, at = g[: n - window + 1].copy(), np.arange(n - window + 1)
    for j in range(1, spread):
        other = g[j : j + n - window + 1]
        less = other < low
        low[less] = other[less]
        at[less] = np.nonzero(less)[0] + j
    return starts, at[starts], low[starts]


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch)):
            hashes, offsets = flat(b.column("hashes"))
            _, at, low = least_grams(hashes, offsets, window, gram)
            at, first = np.unique(at, return_index=True)
            row = np.searchsorted(offsets, at, "right") - 1
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(low[first].view(np.int64)), pa.array(ids[row].astype(np.int64)), pa.array((at - offsets[row]).astype(np.int32))], ["fp", "doc_id", "pos"])

    return run


class FingerprintIndex:
    """Runs of (fp, doc_id, pos), bucketed and sorted by fp in the session's warehouse."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan: int = FAN, window: int = WINDOW, gram: int = GRAM) -> None:
        self.spark, self.fan, self.window, self.gram = spark, fan, window, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        release(self.spark)
        return name

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text) as a run; -> doc_id, pos of the batch's and of earlier runs' positions whose fingerprint the batch repeats."""
        hashed = batch.select("doc_id", word_hashes(F.col("text")).alias("hashes")).filter(F.size("hashes") >= self.window)
        name = self._write(hashed.mapInArrow(_fingerprints(self.window, self.gram), "fp long, doc_id long, pos int"))
        new = self.spark.table(name)
        counts = new.groupBy("fp").agg(F.count("*").alias("n"))
        found = [new.join(counts.filter("n > 1").select("fp"), "fp", "left_semi").select("doc_id", "pos")]
        for run in self.runs:
            old = self.spark.table(run)
            found.append(new.join(old.select("fp"), "fp", "left_semi").select("doc_id", "pos"))
            found.append(old.join(new.select("fp"), "fp", "left_semi").select("doc_id", "pos"))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        hits = staged(out, "repeated-positions")
        self.runs.append(name)
        if len(self.runs) > self.fan:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merges all runs into one; the old ones go when the new one is whole."""
        rows = self.spark.table(self.runs[0])
        for run in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(run))
        old, self.runs = self.runs, [self._write(rows)]
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE {run}")
        self.runs = []


class Offsets:
    """Where the texts of one id begin when its different texts are put one after another; rows come in the order of (doc_id, key)."""

    def __init__(self) -> None:
        self.id = self.key = None
        self.begin = self.end = 0

    def __call__(self, ids: list, keys: list, sizes: list[int]) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for i, (doc_id, key, n) in enumerate(zip(ids, keys, sizes)):
            if doc_id != self.id:
                self.begin, self.end = 0, n
            elif key != self.key:
                self.begin, self.end = self.end, self.end + n
            self.id, self.key = doc_id, key
            out[i] = self.begin
        if len(out) and out.max() >= 1 << START_BITS:
            raise OverflowError(f"the texts of one id have over {1 << START_BITS} words")
        return out


def _windows(window: int, gram: int):
    """Documents with the positions that could repeat -> for each window there: hash, doc_id, start with more bits of the hash.

    Of equal windows that one batch holds only the first goes on as a contender. The later ones are known to repeat; a row for
    each of their documents has their starts in late, and its doc_id for a hash, with `more` beyond what windows have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = Offsets()
        for b in (part for batch in batches for part in slices(batch.filter(batch.column("positions").is_valid()))):
            hashes, offsets = flat(b.column("hashes"))
            begin = begins(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), np.diff(offsets).tolist())
            starts, at, _ = least_grams(hashes, offsets, window, gram)
            pos, where = flat(b.column("positions"))
            hot = np.zeros(len(hashes) + 1, bool)
            pos, row = pos.view(np.int64), np.repeat(np.arange(len(b)), np.diff(where))
            own = pos < np.diff(offsets)[row]  # a position may be of another text of the id
            hot[pos[own] + offsets[row[own]]] = True
            starts = starts[hot[at]] if len(starts) else starts
            h, more = runs(hashes, window, 1)[starts], runs(mixed(hashes), window, 2)[starts] >> np.uint64(START_BITS)
            row = np.searchsorted(offsets, starts, "right") - 1
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[row]
            start = starts - offsets[row] + begin[row]
            order = np.lexsort((start, ids, more, h))
            again = np.zeros(len(order), bool)
            again[1:] = (h[order][1:] == h[order][:-1]) & (more[order][1:] == more[order][:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order)))) if len(order) else order
            late = np.empty(len(order), bool)
            late[order] = again & ((ids[order] != ids[order][head]) | (start[order] != start[order][head]))  # equal rows are one
            packed = (more << np.uint64(START_BITS)) | start.astype(np.uint64)
            own, begin = np.unique(row[late], return_index=True)  # rows come in order, so late ones of a document are together
            lists = [x.tolist() for x in np.split(start[late], begin[1:])] if len(own) else []
            names = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[own]
            keep = ~late
            columns = (
                np.concatenate([h[keep].view(np.int64), names]), np.concatenate([ids[keep], names]),
                np.concatenate([packed[keep].view(np.int64), np.full(len(own), -1)]),
            )
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([None] * int(keep.sum()) + lists, pa.list_(pa.int64()))], ["h", "doc_id", "packed", "late"])

    return run


def covered(n: int, starts: list[int], window: int) -> np.ndarray:
    """Which of n words a window from one of the starts covers."""
    edge = np.zeros(n + 1, np.int32)
    at = np.array(starts, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = Offsets()
        for b in batches:
            out = []
            for text, starts, doc_id, key in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "doc_id", "key"))):
                ws = WORD_RE.findall(text or "")
                begin = int(begins([doc_id], [key], [len(ws)])[0])
                starts = [x - begin for x in starts or () if begin <= x < begin + len(ws)]
                kept = ws
                spans: list[list[int]] = []
                if starts:
                    gone = covered(len(ws), starts, window)
                    kept = [w for w, g in zip(ws, gone.tolist()) if not g]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = edges.reshape(-1, 2).tolist()
                body = " ".join(kept)
                out.append((len(ws), len(ws) - len(kept), body, spans))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.list_(pa.int32())))], ["doc_id", "n_words", "n_removed", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, hits: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...), hits(doc_id, pos): the positions that could repeat -> doc_id, n_words, n_removed, kept, spans.

    docs is dealt by doc_id once; both joins of the plan use that exchange.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).repartition(parts, "doc_id")
    lists = hits.repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_set(F.col("pos").cast("long")).alias("positions"))
    # a left join, as for the result: an inner one would filter ids below the exchange, and so need an exchange of its own
    hot = dealt.join(lists, "doc_id", "left").sortWithinPartitions("doc_id", "key").select("doc_id", "key", F.when(F.col("positions").isNotNull(), word_hashes(F.col("text"))).alias("hashes"), "positions")
    rows = hot.mapInArrow(_windows(window, gram), "h long, doc_id long, packed long, late array<long>").repartition(parts, "h")
    at = F.struct("doc_id", F.col("packed").bitwiseAND((1 << START_BITS) - 1).alias("start"))
    same = Window.partitionBy("h", "more")
    judged = rows.select("h", F.shiftrightunsigned("packed", START_BITS).alias("more"), at.alias("at"), "late").withColumn("first", F.min("at").over(same))
    later = judged.filter("late is not null or at <> first").select("at.doc_id", F.explode(F.coalesce("late", F.array("at.start"))).alias("start"))
    # dealt before it is grouped: lists of one element would only make the exchange larger
    starts = later.repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))
    return dealt.join(starts, "doc_id", "left").sortWithinPartitions("doc_id", "key").select("doc_id", "key", "text", "starts").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string, spans array<array<int>>")


def substring_dedup(docs: DataFrame, batches: int = 2, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_removed, kept, spans, kept_sha256: one row for each row of docs.

    A window is `window` consecutive words of one document. Each word covered by a window whose words also start earlier (in a
    smaller doc_id, or before in the same document) is removed; kept has the other words joined by one space, spans the removed
    ranges of word numbers, end exclusive. Null and empty texts have no words. Documents are added to a fingerprint index in
    `batches` ranges of doc_id. Rows with a null doc_id are left as they are and remove nothing. Equal rows are judged as one;
    different texts of one doc_id are parts of one document, in the order of their hashes, and no window spans two of them.
    Empty tables give empty results. Other columns aren't read.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "text").filter("doc_id is not null")
    low, high = known.agg(F.min("doc_id"), F.max("doc_id")).first()
    index = FingerprintIndex(spark, window=window, gram=gram)
    hits = None
    if low is not None:
        step = (high - low) // batches + 1
        for k in range(batches):
            found = index.add(known.filter((F.col("doc_id") >= low + k * step) & (F.col("doc_id") < low + (k + 1) * step)))
            hits = found if hits is None else hits.unionByName(found)
        index.drop()
    else:
        hits = spark.createDataFrame([], "doc_id long, pos int")
    out = remove_repeats(docs, hits, window, gram)
    return out.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256))
