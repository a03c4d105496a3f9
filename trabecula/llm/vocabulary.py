"""Work on the different words of a corpus instead of on their occurrences, without a broadcast that grows.

Each task cuts its rows into blocks of BLOCK_BYTES of text. A block's texts become numbers of its different words; the words
go out in packets by a hash of the word. PER_SUPER blocks form a superblock: the packets of one hash part of a superblock meet
and get ranks among its different words, which an operator resolves once for each superblock. The resolved values go back as
packets to their blocks, where they meet the blocks' numbers. A part's size depends on BLOCK_BYTES, PER_SUPER and PARTS only,
not on the corpus; a word travels once for each block that has it, never once for each occurrence. Blocks don't depend on ids.
They are written before they are used, so that a task that runs again doesn't cut them anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, release, staged, thrifty

#: Text of a block, text that is cut into words at once, text of one packet of documents, all in bytes.
BLOCK_BYTES, CUT_BYTES, DOCS_BYTES = 32 << 20, 2 << 20, 2 << 20
PARTS, PER_SUPER = 64, 256
#: Words whose parts are found at once; rows that go to Python at once while blocks are cut.
PART_WORDS, CUT_ROWS = 1 << 15, 1000
#: Of zstd: packets lie on disk twice while they are dealt. On texts 9 takes a tenth less than 1; on numbers without order it doesn't.
LEVEL = 9

#: Cuts a column of texts into words: all of them in a row, and how many each text has.
Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as w:
        w.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def text_bytes(texts: pa.Array, before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more for the end). `before` goes before each that isn't empty."""
    texts = pc.fill_null(texts, "")
    if before:
        texts = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", before.decode()), texts, "")
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)), ends - ends[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Strings that lie in `data` one after another."""
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))


def part_of(words: pa.Array) -> np.ndarray:
    """A number below PARTS for each word: a sum of its bytes times odd numbers that depend on their places, mixed."""
    out = [_part_of(words.slice(i, PART_WORDS)) for i in range(0, len(words), PART_WORDS)]
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _part_of(words: pa.Array) -> np.ndarray:
    data, at = text_bytes(words)
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    odd = np.random.default_rng(5).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * odd[place & 63])])  # all of 64 bits, no float
    h = sums[at[1:]] - sums[at[:-1]]
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int32) % PARTS


def planes(codes: np.ndarray) -> bytes:
    """32-bit numbers, packed byte by byte: the high bytes are mostly zeros."""
    return pa.Codec("zstd", compression_level=LEVEL).compress(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def from_planes(blob: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(pa.decompress(blob, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, a row at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


BLOCKS = "block long, part int, words binary, docs binary, codes binary, parts binary"


_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("docs", pa.binary()), ("codes", pa.binary()), ("parts", pa.binary())])


def _cut_blocks(cut: Cut, block_bytes: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def hold(rows: pa.RecordBatch, sizes: np.ndarray) -> None:
            """Cuts the rows at once and keeps numbers and different words; what is kept are copies, so that the texts can go."""
            for lo, hi in _runs(sizes, CUT_BYTES):
                words, n = cut(rows.column("text").slice(lo, hi - lo))
                own = rows.select(["doc_id", "learn"]).take(pa.array(np.arange(lo, hi)))
                held.append((words.dictionary_encode(), n, own, sizes[lo:hi]))

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            found, counts, rows, sizes = zip(*held)
            held.clear()
            rows, counts, sizes = pa.Table.from_batches(rows), np.concatenate(counts), np.concatenate(sizes)
            ids, learn = rows.select(["doc_id"]), rows.column("learn").to_numpy(zero_copy_only=False) if counted else None
            del rows
            chunks = pa.chunked_array(found).unify_dictionaries().chunks
            del found
            words, chunks = chunks[0].dictionary, [c.indices.to_numpy() for c in chunks]
            # frequent words get small numbers
            times = np.zeros(len(words), np.int64)
            for c in chunks:
                times += np.bincount(c, minlength=len(words))
            order = np.argsort(-times, kind="stable")
            number_of = np.empty(len(order), np.uint32)
            number_of[order] = np.arange(len(order))
            words, codes = words.take(pa.array(order)), np.concatenate([number_of[c] for c in chunks])
            del chunks, times, order, number_of
            learnt = np.bincount(codes[np.repeat(learn, counts)], minlength=len(words)) if counted else None
            at = np.concatenate([[0], np.cumsum(counts)])
            block, where = part << 32 | number, part_of(words)
            one = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, *row), _SCHEMA)], schema=_SCHEMA)
            parts = where.astype(np.uint8).tobytes()
            for lo, hi in _runs(sizes, DOCS_BYTES):
                docs = packed(ids.slice(lo, hi - lo).append_column("n", pa.array(counts[lo:hi], pa.int64())))
                yield one(-1, None, docs, planes(codes[at[lo] : at[hi]]), parts)
                parts = None
            # a part's words are in the order of their numbers, so that the numbers needn't travel
            order = np.argsort(where, kind="stable")
            edges = np.searchsorted(where[order], np.arange(PARTS + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                mine = order[edges[p] : edges[p + 1]]
                table = {"word": words.take(pa.array(mine))} | ({"n": pa.array(learnt[mine], pa.int64())} if counted else {})
                yield one(p, packed(pa.table(table)), None, None, None)
            number, size = number + 1, 0
            del words, codes, ids, order
            give_back()

        for b in batches:
            if not len(b):
                continue
            sizes = pc.add(pc.fill_null(pc.binary_length(b.column("text")), 0), 16).to_numpy()
            for lo, hi in _runs(sizes, block_bytes):
                more = int(sizes[lo:hi].sum())
                if held and size + more > block_bytes:
                    yield from out()
                hold(b.slice(lo, hi - lo), sizes[lo:hi])
                size += more
        if held:
            yield from out()

    return run


class Blocks:
    """The blocks of docs(doc_id, learn, text), on the shared folder; `counted` if words are to be counted in the rows with learn."""

    def __init__(self, docs: DataFrame, cut: Cut, name: str, counted: bool = False, block_bytes: int = BLOCK_BYTES, per_super: int = PER_SUPER) -> None:
        self.name, self.spark = name, docs.sparkSession
        rows = docs.select("doc_id", "learn", "text").mapInArrow(thrifty(_cut_blocks(cut, block_bytes, counted)), BLOCKS)
        table = staged(rows.withColumn("kind", F.when(F.col("part") < 0, "docs").otherwise("words")), name, "kind", CUT_ROWS)
        self.docs = table.filter("kind = 'docs'").select("block", "docs", "codes", "parts")
        supers = -(-self.docs.select("block").distinct().count() // per_super)
        super_of = F.pmod(F.xxhash64("block"), F.lit(max(1, supers))).cast("int").alias("super")
        packets = table.filter("kind = 'words'").select(super_of, "part", "block", "words")

        def run(key, packets):
            tables = [unpacked(x) for x in packets.column("words").to_pylist()]
            every = pa.concat_tables(tables).combine_chunks()
            coded = every.column("word").combine_chunks().dictionary_encode()
            ranks, size = coded.indices.to_numpy(), len(coded.dictionary)
            n = np.bincount(ranks, every.column("n").to_numpy(), size).astype(np.int64) if counted else np.zeros(size, np.int64)
            ends = np.cumsum([len(t) for t in tables])
            links = [planes(ranks[a:b].astype(np.uint32)) for a, b in zip([0, *ends.tolist()], ends.tolist())]
            super, part = (x.as_py() for x in key)
            both = size + len(links)
            blank = lambda k, t: pa.nulls(k, t)
            return pa.table({
                "super": pa.array(np.full(both, super, np.int32)), "part": pa.array(np.full(both, part, np.int32)),
                "rank": pa.concat_arrays([pa.array(np.arange(size, dtype=np.int32)), blank(len(links), pa.int32())]),
                "word": pa.concat_arrays([coded.dictionary, blank(len(links), pa.string())]), "n": pa.concat_arrays([pa.array(n), blank(len(links), pa.int64())]),
                "block": pa.concat_arrays([blank(size, pa.int64()), packets.column("block").combine_chunks()]),
                "size": pa.concat_arrays([blank(size, pa.int64()), pa.array([len(t) for t in tables], pa.int64())]),
                "ranks": pa.concat_arrays([blank(size, pa.binary()), pa.array(links, pa.binary())]),
            })

        found = packets.groupBy("super", "part").applyInArrow(run, "super int, part int, rank int, word string, n long, block long, size long, ranks binary")
        met = staged(found.withColumn("kind", F.when(F.col("word").isNull(), "links").otherwise("words")), f"{name}-ranks", "kind")
        discard(table, only="kind=words")
        release(self.spark)
        #: super, part, rank, word, n: every different word of a superblock once, with its count in the rows with learn.
        self.words = met.filter("kind = 'words'").select("super", "part", "rank", "word", "n")
        self._links = met.filter("kind = 'links'").select("super", "part", "block", "size", "ranks")
        self._ranks = met

    def forget_words(self) -> None:
        """Once resolved values are written, nothing reads the words any more, nor what was shuffled for them."""
        discard(self._ranks, only="kind=words")
        release(self.spark)

    def applied(self, resolved: DataFrame, each: Callable[[pa.Table, np.ndarray, pa.Table | None], pa.Table], schema: str) -> DataFrame:
        """resolved(super, part, rank, ...) for all words -> what `each` makes of a packet's (doc_id, n), of its words' numbers, and of
        the other columns of resolved by number. The words are deleted, so this is asked once.
        """

        def answer(key, links, known):
            known = known.sort_by("rank").drop_columns(["super", "part", "rank"]).combine_chunks()
            out = [packed(known.take(pa.array(from_planes(blob, n)))) for n, blob in zip(links.column("size").to_pylist(), links.column("ranks").to_pylist())]
            return pa.table({"block": links.column("block"), "part": links.column("part"), "answer": pa.array(out, pa.binary())})

        def apply(key, packets, replies):
            known, size = None, 0
            parts = next((x for x in packets.column("parts").to_pylist() if x is not None), b"")
            if parts:
                replies = replies.sort_by("part")
                known = pa.concat_tables([unpacked(x) for x in replies.column("answer").to_pylist()])
                order = np.argsort(np.frombuffer(parts, np.uint8), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                known, size = known.take(pa.array(place)).combine_chunks(), len(place)
            out = []
            for docs, blob in zip(packets.column("docs").to_pylist(), packets.column("codes").to_pylist()):
                docs = unpacked(docs)
                codes = from_planes(blob, pc.sum(docs.column("n")).as_py() or 0)
                if len(codes) and int(codes.max()) >= size:
                    raise RuntimeError("words of a block have no answers")
                out.append(each(docs, codes, known))
            del known
            give_back()
            return pa.concat_tables(out) if out else each(pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())}), np.zeros(0, np.uint32), None)

        answers = self._links.groupBy("super", "part").cogroup(resolved.groupBy("super", "part")).applyInArrow(answer, "block long, part int, answer binary")
        found = staged(answers, f"{self.name}-answers")
        discard(resolved, self._ranks)
        release(self.spark)
        return self.docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(apply, schema)
