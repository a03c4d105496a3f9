"""Secret scans: fixed patterns, and a randomness test battery over long tokens with false-discovery control.

A candidate is a run of letters, digits and + / _ = - of MIN_LENGTH characters or more that holds a letter and a digit. Runs are
cut at = but for padding at their end, and what then fits no alphabet at + and /, at - and _, and at all four: each part is a
candidate, and of overlapping ones that are reported the most random stays. Its
encoding is the smallest alphabet that has its characters. Three tests ask whether the token looks drawn evenly from that
alphabet: Pearson's chi-squared for uniformity, the runs test about the alphabet's middle, and lag-1 serial correlation;
Fisher's method joins their p-values. How random natural text looks by chance is measured, not assumed: the ASCII letters of
every text, cut into pieces of the least lengths in turn and written in each family of alphabets, give the null distribution of
the joined score for each stratum of family and length. A candidate's p-value is the share of natural pieces of its stratum
that look as random, and Benjamini-Hochberg within the stratum holds the false discoveries at FDR. A stratum with few natural
pieces can't reach a small p-value and so reports nothing of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
VALUE = re.compile(r"[^=]+(?:=+\Z)?")
SPLITS = tuple(re.compile(f"[^{c}]+") for c in ("+/", "_-", "+/_-"))
#: A keyword of ASSIGN holds one of these, whatever its case.
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")
MIN_LENGTH, FDR, BINS = 20, 0.01, 400
LENGTHS = (20, 24, 32, 48, 96)  # least lengths of the strata; the last is open
#: Families of alphabets: the one that natural text is written in for them, and the encodings that they hold.
FAMILIES = (("base32", ("HEX", "base32")), ("lower36", ("hex", "lower36")), ("base62", ("base62", "base64", "base64url")))
STRATA = len(FAMILIES) * len(LENGTHS)
#: Alphabets in the order of their collating, smallest first.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
)
NOT_LETTERS = bytes(c for c in range(256) if not chr(c).isascii() or not chr(c).isalpha())
_INDEX = [(name, {c: i for i, c in enumerate(a)}, frozenset(a)) for name, a in ENCODINGS]
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<s:int,k:int,e:int>>, cands array<struct<s:int,e:int,stratum:int,bin:int>>, natural array<struct<cell:int,n:long>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' whole matches, in the order of start, then kind."""
    out = []
    if any(h in low for low in [text.lower()] for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding_of(token: str) -> str | None:
    """The smallest alphabet that has the token's characters, but for = at its end."""
    chars = set(token.rstrip("="))
    return next((name for name, _, members in _INDEX if chars <= members), None)


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of the run's candidates: what = parts in it, or where no alphabet has that, what its separators part."""
    out = set()
    for m in VALUE.finditer(run):
        if encoding_of(m.group()):
            out.add(m.span())
        else:
            out |= {(m.start() + p.start(), m.start() + p.end()) for split in SPLITS for p in split.finditer(m.group())}
    return sorted((s, e) for s, e in out if e - s >= MIN_LENGTH)


def randomness(token: str) -> float | None:
    """log10 of the joined p-value that the token is drawn evenly from its inferred alphabet; None if no alphabet has it."""
    body = token.rstrip("=")
    chars = set(body)
    name = encoding_of(token)
    if name is None:
        return None
    index = next(index for e, index, _ in _INDEX if e == name)
    n, k = len(body), len(index)
    if n < 8:
        return None
    x = [index[c] for c in body]
    chi = k / n * sum(body.count(c) ** 2 for c in chars) - n
    uniform = _tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    half = k / 2
    up = [v >= half for v in x]
    a = sum(up)
    b = n - a
    if a and b:
        runs = 1 + sum(map(lambda p, q: p != q, up, up[1:]))
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        level = 2 * _tail(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        level = 2 * 0.5**n
    m = sum(x) / n
    power = sum((v - m) ** 2 for v in x)
    serial = 2 * _tail(abs(sum((p - m) * (q - m) for p, q in zip(x, x[1:])) / power) * math.sqrt(n)) if power else 0.0
    stat = -2 * sum(math.log(max(p, 1e-60)) for p in (uniform, level, serial))
    h = stat / 2
    return -h / math.log(10) + math.log10(1 + h + h * h / 2)  # the upper tail of chi-squared of 6 degrees


def _tails(z: np.ndarray) -> np.ndarray:
    return np.fromiter((0.5 * math.erfc(v) for v in (z / math.sqrt(2)).tolist()), np.float64, len(z))


def randomness_rows(x: np.ndarray, k: int) -> np.ndarray:
    """randomness() of many tokens of one length, given as rows of places in an alphabet of k."""
    m, n = x.shape
    counts = np.bincount((x + k * np.arange(m)[:, None]).ravel(), minlength=m * k).reshape(m, k)
    uniform = _tails((k / n * (counts**2).sum(1) - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    up = x >= k / 2
    a = up.sum(1)
    mean = 2 * a * (n - a) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + (up[:, 1:] != up[:, :-1]).sum(1)
    level = np.where(spread > 0, 2 * _tails(np.abs(runs - mean) / np.sqrt(np.where(spread > 0, spread, 1))), 1.0)
    level = np.where((a == 0) | (a == n), 2 * 0.5**n, level)
    d = x - x.mean(1, keepdims=True)
    power = (d * d).sum(1)
    serial = np.where(power > 0, 2 * _tails(np.abs((d[:, 1:] * d[:, :-1]).sum(1) / np.where(power > 0, power, 1)) * math.sqrt(n)), 0.0)
    h = -(np.log(np.maximum(uniform, 1e-60)) + np.log(np.maximum(level, 1e-60)) + np.log(np.maximum(serial, 1e-60)))
    return -h / math.log(10) + np.log10(1 + h + h * h / 2)


def _places(name: str) -> np.ndarray:
    """Places in the alphabet by byte; letters of the case that it lacks have that of the other."""
    out = np.zeros(256, np.int64)
    index = next(index for e, index, _ in _INDEX if e == name)
    for c in map(chr, range(128)):
        out[ord(c)] = index.get(c, index.get(c.swapcase(), 0))
    return out


def natural_cells(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """letters: bytes a-z and A-Z of the texts one after another, sizes: how many each has. -> counts by stratum * BINS + bin.

    Every text is cut into pieces of the least lengths in turn, again and again; a piece that it ends in doesn't count.
    """
    out = np.zeros(STRATA * BINS, np.int64)
    tables = [(_places(name), len(next(a for e, a in ENCODINGS if e == name))) for name, _ in FAMILIES]
    turn, at = sum(LENGTHS), 0
    begin = np.cumsum(sizes) - sizes
    for length, n in enumerate(LENGTHS):
        times = np.maximum((sizes - at - n) // turn + 1, 0)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts = np.repeat(begin + at, times) + nth * turn
        at += n
        for i in range(0, len(starts), 8192):
            rows = letters[starts[i : i + 8192, None] + np.arange(n)]
            for family, (places, k) in enumerate(tables):
                bins = np.clip((-randomness_rows(places[rows], k) * 10).astype(np.int64), 0, BINS - 1)
                s = family * len(LENGTHS) + length
                out[s * BINS : (s + 1) * BINS] += np.bincount(bins, minlength=BINS)
    return out


def stratum_of(n: int, encoding: str) -> int:
    return next(f for f, (_, names) in enumerate(FAMILIES) if encoding in names) * len(LENGTHS) + sum(n >= x for x in LENGTHS[1:])


def bin_of(score: float) -> int:
    return min(BINS - 1, int(-score * 10))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))), ("cands", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32())]))), ("natural", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())])))])
    for b in batches:
        rows = []
        natural, letters, held = np.zeros(STRATA * BINS, np.int64), [], 0
        for text in b.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            cands = []
            for s, e in ((m.start() + a, m.start() + b) for m in RUN.finditer(text) for a, b in parts(m.group())):
                token = text[s:e]
                if not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token) or any(x[0] < e and s < x[2] for x in base):
                    continue
                if (score := randomness(token)) is not None:
                    cands.append({"s": s, "e": e, "stratum": stratum_of(len(token), encoding_of(token)), "bin": bin_of(score)})
            letters.append(text.encode("utf-8", "surrogatepass").translate(None, NOT_LETTERS))
            held += len(letters[-1])
            if held > 4_000_000:
                natural += natural_cells(np.frombuffer(b"".join(letters), np.uint8), np.array([len(x) for x in letters]))
                letters, held = [], 0
            kinds = [x[1] for x in base]
            rows.append([kinds.count(0), kinds.count(1), kinds.count(2), [{"s": s, "k": k, "e": e} for s, k, e in base], cands, []])
        natural += natural_cells(np.frombuffer(b"".join(letters), np.uint8), np.array([len(x) for x in letters], np.int64))
        if rows:  # the first row carries the batch's counts
            rows[0][5] = [{"cell": int(c), "n": int(natural[c])} for c in np.nonzero(natural)[0]]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)


def thresholds(counts: dict[tuple[str, int, int], int], fdr: float = FDR) -> dict[int, int]:
    """counts by (natural or cands, stratum, bin) -> for each stratum the last bin that Benjamini-Hochberg still reports."""
    out = {}
    for s in range(STRATA):
        natural = [counts.get(("natural", s, b), 0) for b in range(BINS)]
        found = [counts.get(("cands", s, b), 0) for b in range(BINS)]
        below = above = 0
        for b in range(BINS):
            below, above = below + natural[b], above + found[b]
            if above and (1 + below) / (1 + sum(natural)) <= fdr * above / sum(found):
                out[s] = b
    return out


def secret_scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs(doc_id, text, ...) -> one row for each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Null texts are empty and have no spans; the digest is then that of the empty string. Spans are of code points, end
    exclusive. Repeated rows are scanned alike. Null ids stay null. Empty tables give empty results; other columns aren't read.
    The counts that set the thresholds cover the whole table: natural runs and candidates by stratum and bin, at most
    2 * STRATA * BINS cells, are what the driver gathers.
    """
    found = staged(docs.select("doc_id", "text").mapInArrow(_scan, FOUND), "secrets")
    natural = found.select(F.explode("natural").alias("x")).select(F.lit("natural").alias("what"), F.floor(F.col("x.cell") / BINS).cast("int").alias("stratum"), (F.col("x.cell") % BINS).alias("bin"), "x.n")
    cands = found.select(F.explode("cands").alias("x")).select(F.lit("cands").alias("what"), "x.stratum", "x.bin", F.lit(1).cast("long").alias("n"))
    cells = natural.unionByName(cands).groupBy("what", "stratum", "bin").agg(F.sum("n")).collect()
    limits = thresholds({(r[0], r[1], r[2]): r[3] for r in cells}, fdr)
    kinds = F.array(*map(F.lit, KINDS))
    per_stratum = F.array(*(F.lit(limits.get(s, -1)) for s in range(STRATA)))
    over = F.filter("cands", lambda x: x["bin"] <= F.element_at(per_stratum, x["stratum"] + 1))
    ranked = F.array_sort(F.transform(over, lambda x: F.struct(x["bin"].alias("bin"), (x["s"] - x["e"]).alias("short"), x["s"].alias("s"), x["e"].alias("e"))))
    apart = lambda a, x: F.when(F.exists(a, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), a).otherwise(F.concat(a, F.array(x)))
    best = F.aggregate(ranked, F.array().cast("array<struct<bin:int,short:int,s:int,e:int>>"), apart)
    added = F.transform(best, lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", added))).alias("spans"), F.size(added).alias("n_random"))
