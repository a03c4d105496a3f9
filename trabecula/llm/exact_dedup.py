"""Exact deduplication by an extendible-hash index on shared files.

The directory maps the leading bits of a text's hash to buckets. It starts with one bucket and doubles while a bucket holds
more bytes than its capacity; only overfull buckets split. Tasks first combine the equal texts that they see, so that a group
of copies sends one entry for each task; each bucket's entries then go to an owner task that reads them in the order of the
hash, chains the different texts of one hash and tells them apart by their bytes. The owners write the index to the shared
folder; documents look up their class in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, thrifty

KEYS = "doc_id long, hash long, sha binary, n_bytes long"
ENTRIES = "bucket int, hash long, sha binary, body binary, n_rows long, last_id long"
CLASSES = "bucket int, hash long, chain int, sha binary, n_bytes long, group_size long, keep_id long, body binary"
#: Deepest directory, bytes of a bucket's texts before it splits, bytes of texts that a task combines at once.
MAX_DEPTH, CAPACITY, COMBINE = 16, 32 << 20, 48 << 20


def digest(body: bytes) -> tuple[int, bytes]:
    """The 64-bit hash that places a text, and its SHA-256. The hash is drawn apart from the digest's own bytes."""
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "big", signed=True), hashlib.sha256(body).digest()


def normalised(text: str | None) -> bytes:
    """A-Z in lower case, nothing else changed; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() knows A-Z only


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bodies = [normalised(x) for x in b.column("text").to_pylist()]
        both = [digest(x) for x in bodies]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h for h, _ in both], pa.int64()), pa.array([s for _, s in both], pa.binary()), pa.array([len(x) for x in bodies], pa.int64())], ["doc_id", "hash", "sha", "n_bytes"])


def _combiner(directory: np.ndarray, depth: int, most: int, place: Callable[[bytes], tuple[int, bytes]]):
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            items = list(seen.items())
            seen.clear()
            for i in range(0, len(items), 256):
                rows = []
                for body, (n, last) in items[i : i + 256]:
                    h, sha = place(body)
                    rows.append((int(directory[(h & (1 << 64) - 1) >> (64 - depth)]), h, sha, body, n, last))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "hash", "sha", "body", "n_rows", "last_id"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                body = normalised(text)
                if (x := seen.get(body)) is None:
                    seen[body] = [1, doc_id]
                    held += len(body) + 200
                    if held > most:
                        yield from out()
                        held = 0
                else:
                    x[0] += 1
                    if doc_id is not None and (x[1] is None or doc_id > x[1]):
                        x[1] = doc_id
        yield from out()

    return combine


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of (bucket, hash) -> the chain of classes of each hash, compared byte by byte."""
    place, chain = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if chain:
            rows = [(*place, i, sha, len(body), n, last, body) for i, (body, sha, n, last) in enumerate(chain)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["bucket", "hash", "chain", "sha", "n_bytes", "group_size", "keep_id", "body"])

    pending: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for bucket, h, sha, body, n, last in zip(*(b.column(c).to_pylist() for c in ("bucket", "hash", "sha", "body", "n_rows", "last_id"))):
            if (bucket, h) != place:
                pending += out()
                size += sum(len(x[0]) for x in chain)
                if size > 4 << 20 or len(pending) > 500:
                    yield from (t.to_batches()[0] for t in [pa.Table.from_batches(pending).combine_chunks()] if pending)
                    pending, size = [], 0
                place, chain = (bucket, h), []
            for x in chain:
                if len(x[0]) == len(body) and x[0] == body:
                    x[2] += n
                    x[3] = max((y for y in (x[3], last) if y is not None), default=None)
                    break
            else:
                chain.append([body, sha, n, last])
    pending += out()
    if pending:
        yield from pa.Table.from_batches(pending).combine_chunks().to_batches()


def split_directory(cells: dict[int, int], depth: int, capacity: int) -> tuple[np.ndarray, int]:
    """cells: bytes by the leading `depth` bits. -> directory of 2**g bucket numbers, and g, its global depth.

    A bucket is a prefix of (bits, length). The directory doubles when a bucket as deep as the directory splits; it stops
    doubling at `depth`, where an overfull bucket stays whole and is read in the order of its hashes all the same.
    """
    load = np.zeros(1 << depth, np.int64)
    for k, v in cells.items():
        load[k] = v
    sums = np.concatenate([[0], np.cumsum(load)])
    done, todo, g = [], [(0, 0)], 0
    while todo:
        prefix, length = todo.pop()
        lo, hi = prefix << (depth - length), (prefix + 1) << (depth - length)
        if sums[hi] - sums[lo] > capacity and length < depth:
            todo += [(2 * prefix + 1, length + 1), (2 * prefix, length + 1)]
            g = max(g, length + 1)
        else:
            done.append((prefix, length))
    directory = np.zeros(1 << g, np.int32)
    for number, (prefix, length) in enumerate(sorted(done, key=lambda x: x[0] << (depth - x[1]))):
        directory[prefix << (g - length) : (prefix + 1) << (g - length)] = number
    return directory, g


def exact_classes(docs: DataFrame, capacity: int = CAPACITY, place: Callable[[bytes], tuple[int, bytes]] = digest) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> (keys of all rows, the index of classes), both on shared files.

    keys: doc_id, hash, sha, n_bytes. classes: one row for each different normalised text with its place, the number of rows,
    the largest doc_id (null if all are null) and the bytes themselves. Other columns of docs aren't read.
    """
    src = docs.select("doc_id", "text")
    keys = staged(src.mapInArrow(thrifty(_keys if place is digest else _keys_by(place)), KEYS), "dedup-keys")
    top = F.shiftrightunsigned("hash", 64 - MAX_DEPTH)
    once = keys.groupBy("hash", "sha").agg(F.max("n_bytes").alias("n"))
    cells = {int(r[0]): int(r[1]) for r in once.groupBy(top.alias("cell")).agg(F.sum(F.col("n") + 200)).collect()}  # 2**MAX_DEPTH rows at most
    directory, g = split_directory(cells, MAX_DEPTH, capacity)
    n_buckets = int(directory.max()) + 1
    depth = max(g, 1)
    spread = directory if g else np.zeros(2, np.int32)
    entries = src.mapInArrow(thrifty(_combiner(spread, depth, COMBINE, place)), ENTRIES)
    owned = entries.repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "hash")
    return keys, staged(owned.mapInArrow(thrifty(_own), CLASSES), "dedup-index")


def _keys_by(place):
    def run(batches):
        for b in batches:
            bodies = [normalised(x) for x in b.column("text").to_pylist()]
            both = [place(x) for x in bodies]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([h for h, _ in both], pa.int64()), pa.array([s for _, s in both], pa.binary()), pa.array([len(x) for x in bodies], pa.int64())], ["doc_id", "hash", "sha", "n_bytes"])

    return run


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays; rows of
    that id with that text are one document and all stay. In a group whose ids are all null keep_id is null and all stay; other
    null ids go. Empty tables give empty results. Other columns aren't read.

    Classes of over a thousandth of all rows are less than a thousand; they are broadcast. The others meet their rows in a join
    on the hash, in which no key has more rows than that thousandth.
    """
    keys, classes = exact_classes(docs, capacity)
    total = keys.count()
    found = classes.select("hash", "sha", "group_size", "keep_id")
    hot = found.filter(F.col("group_size") * 1000 > total)
    rest = found.filter(F.col("group_size") * 1000 <= total)
    small = hot.withColumn("hot", F.lit(True))
    tagged = keys.select("doc_id", "hash", "sha").join(F.broadcast(small), ["hash", "sha"], "left")
    big = tagged.filter("hot").drop("hot")
    other = tagged.filter("hot is null").select("doc_id", "hash", "sha").join(rest, ["hash", "sha"])
    both = big.select("doc_id", "keep_id", "group_size", "sha").unionByName(other.select("doc_id", "keep_id", "group_size", "sha"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
