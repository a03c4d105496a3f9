"""SentencePiece encoding and decoding over a relational lattice.

The different words of the corpus are exploded into their substrings of up to the longest piece's length; an equi-join with the
piece table, whose size the vocabulary file bounds, leaves the edges of each word's lattice; they are grouped by word and a
higher-order aggregate folds Viterbi's best path over them. Unigram models bring log-probabilities as scores. The scores of a
BPE model are ranks of merges, which Zipf's law turns into log-probabilities; the pieces of its best path are the most likely
ones, not always those that the model's merges make. `merges=True` replays the merges instead, word by word.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .vocabulary import Blocks, Cut, strings, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Costs are whole numbers of this part of a natural logarithm, so that sums are exact; what a character that is no piece costs
#: more than the dearest piece; states of a word's fold that are put away together, as an array grows by being copied.
UNIT, LOST, CHUNK = 1 << 14, 10, 256


@dataclass
class Pieces:
    """A vocabulary: ids and scores by piece, ids of the 256 bytes if it falls back to them, and what it does with a text."""

    by_piece: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    names: list[str]
    merges: bool
    prefix: bool

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.by_piece))

    @cached_property
    def costs(self) -> dict[str, int]:
        """-ln of the pieces' weights, in UNITs: a unigram model's scores as they stand, a BPE model's ranks by Zipf's law to a 1024th."""
        if self.merges:
            return {p: round(1024 * math.log(i + 2.7)) * (UNIT // 1024) for p, (i, _) in self.by_piece.items()}
        return {p: round(-s * UNIT) for p, (_, s) in self.by_piece.items()}


def load(path: str = MODEL) -> Pieces:
    """Reads a model file on the driver. Only models that keep texts as they are and whose pieces have spaces at their start only are taken."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    by_piece, byte_ids = {}, [0] * 256
    for i, p in enumerate(m.pieces):
        if p.type in (p.NORMAL, p.USER_DEFINED):
            by_piece[p.piece] = (i, p.score)
        elif p.type == p.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
    if any("\n" in p or SPACE in p.lstrip(SPACE) for p in by_piece) or m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError(f"{path}: pieces that cross words, or texts that are changed before they are encoded, aren't supported")
    return Pieces(by_piece, byte_ids if any(byte_ids) else [], sp.unk_id(), [p.piece for p in m.pieces], m.trainer_spec.model_type == m.trainer_spec.BPE, m.normalizer_spec.add_dummy_prefix)


def cutter(v: Pieces) -> Cut:
    """Cuts texts, each with a space before it, where two bytes meet that meet in no piece: no path and no merge crosses such a place."""
    met = np.zeros((256, 256), bool)
    met[:, 0x80:0xC0] = True  # not within a character
    for p in v.by_piece:
        data = np.frombuffer(p.replace(SPACE, " ").encode(), np.uint8)
        met[data[:-1], data[1:]] = True

    def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        data, at = text_bytes(texts, b" ")
        first = np.zeros(len(data), bool)
        first[1:] = ~met[data[:-1], data[1:]]
        first[1:] |= (data[1:] == 32) & (data[:-1] != 32)
        first[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(first)
        return strings(data, starts), np.diff(np.searchsorted(starts, at))

    return cut


def best_path(word: str, v: Pieces) -> list[int]:
    """Viterbi's path of one word in plain Python, which the fold in Spark must equal; of equal paths the longest last piece wins."""
    w, costs = word.replace(" ", SPACE), v.costs
    lost = max(costs.values()) + LOST * UNIT
    states: list[tuple[int, int]] = [(0, -1)]
    for e in range(1, len(w) + 1):
        into = [(states[s][0] + costs[w[s:e]], s) for s in range(max(0, e - v.longest), e) if w[s:e] in costs]
        if w[e - 1 : e] not in costs:
            into.append((states[e - 1][0] + lost, e - 1))
        states.append(min(into))
    spans, e = [], len(w)
    while e:
        spans.append((states[e][1], e))
        e = states[e][1]
    return _ids(w, spans[::-1], v)


def merged(word: str, v: Pieces) -> list[int]:
    """A word's ids by a BPE model's merges: the best pair of neighbours merges, leftmost first, again and again."""
    w = word.replace(" ", SPACE)
    n = len(w)
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[float, int, int, int]] = []

    def offer(a: int) -> None:
        b = right[a]
        if b < n and (x := v.by_piece.get(w[a : right[b]])) is not None:
            heapq.heappush(heap, (-x[1], a, b, right[b]))

    for a in range(n):
        offer(a)
    while heap:
        _, a, b, end = heapq.heappop(heap)
        if alive[a] and b < n and alive[b] and right[a] == b and right[b] == end:
            alive[b], right[a] = False, end
            if end < n:
                left[end] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
    return _ids(w, [(a, right[a]) for a in range(n) if alive[a]], v)


def _ids(w: str, spans: list[tuple[int, int]], v: Pieces) -> list[int]:
    out = []
    for s, e in spans:
        if (x := v.by_piece.get(w[s:e])) is not None:
            out.append(x[0])
        else:
            out += [v.byte_ids[c] for c in w[s:e].encode()] if v.byte_ids else [v.unknown]
    return out


def _merge_words(vocab: DataFrame, v: Pieces) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([merged(w, v) for w in b.column("word").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("super", "part", "rank")), ids], ["super", "part", "rank", "ids"])

    return vocab.select("super", "part", "rank", "word").mapInArrow(run, "super int, part int, rank int, ids array<int>")


def let(value: Column, body) -> Column:
    """body with the value bound to a name: within a lambda an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _path_fold(chunks: Column, n: Column, v: Pieces) -> Column:
    """Ids of Viterbi's path; a character that is no piece gives -1 less its place.

    chunks has the edges by CHUNK of their ends: end, length below 0, and a number: the cost, then what is left of the longest
    length, so that of equal costs the longest piece wins, then the id. A state is the least such number with the costs before.
    """
    id_bits, length_bits = _bits(v)
    low, ids, lengths = id_bits + length_bits, (1 << id_bits) - 1, (1 << length_bits) - 1

    def steps(done: Column, edges: Column) -> Column:
        k = F.size(done)
        # a chunk starts from the states that its edges may come from
        before = F.when(k == 0, F.array(F.lit(0).cast("long"))).otherwise(F.slice(F.element_at(done, -1), -v.longest, v.longest))

        def step(now: Column, e: Column) -> Column:
            into = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.element_at(now, x["back"]).bitwiseAND(-1 << low) + x["weight"])
            return F.array_append(now, F.array_min(into))

        return F.array_append(done, F.aggregate(F.sequence(k * CHUNK + 1, F.least(n, k * CHUNK + CHUNK)), before, step))

    states = F.aggregate(chunks, F.array().cast("array<array<bigint>>"), steps)

    def walk(states: Column) -> Column:
        def of(e: Column) -> Column:
            """The state of an end: a chunk that isn't the first begins with states of the one before it."""
            k = ((e - 1) / CHUNK).cast("int")
            return F.get(F.get(states, k), (e - 1) % CHUNK + F.when(k == 0, 1).otherwise(v.longest))

        def cut(cuts: Column, e: Column) -> Column:
            return F.when(F.element_at(cuts, -1) != e, cuts).otherwise(F.array_append(cuts, e - v.longest + F.shiftright(of(e), id_bits).bitwiseAND(lengths).cast("int")))

        def cuts_of(done: Column, k: Column) -> Column:
            # the cuts of a chunk, from the one that the chunk behind it has found
            behind = F.array(F.when(F.size(done) == 0, n).otherwise(F.element_at(F.element_at(done, -1), -1)))
            return F.array_append(done, F.aggregate(F.sequence(F.least(n, k * CHUNK + CHUNK), k * CHUNK + 1, F.lit(-1)), behind, cut))

        def named(e: Column) -> Column:
            return let(of(e).bitwiseAND(ids).cast("int"), lambda i: F.when(i == len(v.names), -e).otherwise(i))

        found = F.aggregate(F.sequence(F.size(states) - 1, F.lit(0), F.lit(-1)), F.array().cast("array<array<int>>"), cuts_of)
        # each chunk's last cut is the next one's first
        return F.reverse(F.transform(F.flatten(F.transform(found, lambda x: F.slice(x, 1, F.size(x) - 1))), named))

    return let(states, walk)


def _bits(v: Pieces) -> tuple[int, int]:
    """Bits of an id, with one more for what is no piece, and of a length."""
    return len(v.names).bit_length(), v.longest.bit_length()


def encode_words(spark: SparkSession, vocab: DataFrame, v: Pieces) -> DataFrame:
    """vocab(super, part, rank, word) of words that aren't empty -> super, part, rank, ids."""
    costs, (id_bits, length_bits) = v.costs, _bits(v)
    weight = lambda cost, id, length: (cost << length_bits | v.longest - length) << id_bits | id
    # rows of the vocabulary file; a join on numbers is faster than one on strings, which are compared where the numbers agree
    table = spark.createDataFrame([(p, weight(costs[p], i, len(p))) for p, (i, _) in v.by_piece.items()], "name string, weight long").withColumn("hash", F.xxhash64("name"))
    lost = weight(max(costs.values()) + LOST * UNIT, len(v.names), 1)
    key = ("super", "part", "rank")
    # many small tasks: the edges of a task's words are sorted by word, which had better not spill
    dealt = vocab.select(*key, "word").repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    sized = dealt.select(*key, "word", F.translate("word", " ", SPACE).alias("w"), F.length("word").alias("n"))
    tails = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s")).select(*key, "word", "n", "s", F.substring("w", F.col("s") + 1, F.lit(v.longest)).alias("tail"))
    sub = tails.select(*key, "word", "s", "tail", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("s"), F.lit(v.longest)))).alias("length"))
    piece = F.substring("tail", F.lit(1), F.col("length"))
    hit = sub.join(F.broadcast(table), (F.xxhash64(piece) == F.col("hash")) & (piece == F.col("name")), "left").filter("weight is not null or length = 1")
    end = F.col("s") + F.col("length")
    edge = F.struct(end.alias("e"), (-F.col("length")).alias("back"), F.coalesce("weight", F.lit(lost)).alias("weight"))
    grouped = hit.groupBy(*key, "word", ((end - 1) / CHUNK).cast("int").alias("chunk")).agg(F.collect_list(edge).alias("edges"))
    whole = grouped.filter(F.length("word") <= CHUNK).select(*key, "word", F.array("edges").alias("chunks"))
    put = grouped.filter(F.length("word") > CHUNK).groupBy(*key, "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "edges"))), lambda x: x["edges"]).alias("chunks"))
    lattice = whole.unionByName(put).withColumn("n", F.length("word"))
    byte_ids, one = F.array(*map(F.lit, v.byte_ids)), F.lit(1)

    def bytes_at(s: Column) -> Column:
        if not v.byte_ids:
            return F.array(F.lit(v.unknown))
        pairs = lambda h: F.transform(F.sequence(one, F.length(h), F.lit(2)), lambda i: F.get(byte_ids, F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int")))
        return let(F.hex(F.encode(F.substring("word", s + 1, one), "utf-8")), pairs)

    spelt = lambda ids: F.when(~F.exists(ids, lambda x: x < 0), ids).otherwise(F.flatten(F.transform(ids, lambda x: F.when(x >= 0, F.array(x)).otherwise(bytes_at(-x - 1)))))
    return lattice.select(*key, let(_path_fold(F.col("chunks"), F.col("n"), v), spelt).alias("ids"))


def decode(ids: list[int], v: Pieces) -> str:
    """The text of the ids: pieces joined, bytes put together, and the space before the text taken off."""
    place = {i: c for c, i in enumerate(v.byte_ids)} if v.byte_ids else {}
    out = b"".join(bytes([place[i]]) if i in place else v.names[i].replace(SPACE, " ").encode() for i in ids).decode("utf-8", "surrogatepass")
    return out[1:] if v.prefix and out.startswith(" ") else out


def encode(docs: DataFrame, model: str = MODEL, merges: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, ids, n_pieces, decoded: one row for each row of docs.

    ids are the pieces of the best path; for a unigram model they are the SentencePiece library's. merges=True gives those that
    the library has for a BPE model. decoded is the text of the ids. Null and empty texts have no ids and decode to the empty
    string. Texts and words of any length are encoded whole. Repeated rows and ids are encoded alike, null ids stay null. An
    empty table gives an empty result. Other columns aren't read.
    """
    v = load(model)
    blocks = Blocks(docs.select("doc_id", F.lit(True).alias("learn"), "text"), cutter(v), "piece-blocks")
    resolved = staged(_merge_words(blocks.words, v) if merges else encode_words(docs.sparkSession, blocks.words, v), "piece-ids")
    blocks.forget_words()
    place, prefix = {i: bytes([c]) for c, i in enumerate(v.byte_ids)} if v.byte_ids else {}, v.prefix
    texts = [place.get(i, x.replace(SPACE, " ").encode()) for i, x in enumerate(v.names)]

    def each(table: pa.Table, codes: np.ndarray, known: pa.Table | None) -> pa.Table:
        n = table.column("n").to_numpy()
        lists = known.column("ids").combine_chunks().take(pa.array(codes)) if known is not None else pa.array([], pa.list_(pa.int32()))
        ends = lists.offsets.to_numpy()[np.concatenate([[0], np.cumsum(n)])].astype(np.int32)
        ids = lists.values.slice(0, int(ends[-1]))
        # the pieces' bytes one after another are the texts
        data, at = text_bytes(pa.array(texts, pa.large_binary()).take(ids).cast(pa.large_string(), safe=False)) if len(ids) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        begin, end = at[ends[:-1]], at[ends[1:]]
        raw = data.tobytes()
        decoded = [raw[a + (prefix and raw[a : a + 1] == b" ") : b] for a, b in zip(begin.tolist(), end.tolist())]
        return pa.table({"doc_id": table.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), ids), "n_pieces": pa.array(np.diff(ends), pa.int64()), "decoded": pa.array(decoded, pa.binary()).cast(pa.string(), safe=False)})

    return blocks.applied(resolved, each, "doc_id long, ids array<int>, n_pieces long, decoded string")
