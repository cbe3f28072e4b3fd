"""Packing documents into sequences: dominance reduction, then best fit.

Lengths are small integers (1..capacity), so the whole instance is its
histogram of lengths: at most ``capacity`` numbers, however many documents
there are.  The driver solves that instance in groups of equal bins:

1. Martello-Toth dominance: a bin {j}, or {j, k} with k the largest item that
   still fits, is fixed for good when no other filling of j's bin can be
   better (nothing else fits; k fills it exactly; or no set of smaller items
   that fits sums to more than k).  Fixed items leave the instance.
2. Best fit in decreasing order packs what remains.

Each piece then looks its place up by its rank among the pieces of its length;
the lookup table's size depends on ``capacity`` alone and is broadcast.

Only documents longer than the capacity are cut.  Defined cases: null and
empty texts are one separator token; repeated rows are packed each; null ids
are packed like others; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import batches_of, bounded_batches, cut

CACHE_SIZE = 500_000
CACHED_CHARS = 64  # longer runs aren't cached: a text without spaces is one
BATCH_BYTES = 4_000_000
_workers: dict = {}

Bins = list[tuple[int, tuple[tuple[int, int], ...]]]  # (bins, ((length, how many of it), ...))


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """Bins that some optimal packing holds, and the counts left over."""
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: Bins = []
    changed = True
    while changed and left:
        changed = False
        sizes = sorted(left)
        for j in reversed(sizes):
            while left.get(j):
                room = capacity - j
                own = left[j]
                sizes = [s for s in sizes if left.get(s)]
                fits = [s for s in sizes[: bisect_right(sizes, room)] if left[s] - (s == j) > 0]
                if not fits:
                    fixed.append((own, ((j, 1),)))
                    del left[j]
                    changed = True
                    break
                k = fits[-1]
                if k < room and _best_below(fits, left, j, room, k) > k:
                    break
                n = own // 2 if k == j else min(own, left[k])
                fixed.append((n, ((j, 2),) if k == j else ((j, 1), (k, 1))))
                for s, used in ((j, 2 * n),) if k == j else ((j, n), (k, n)):
                    left[s] -= used
                    if not left[s]:
                        del left[s]
                changed = True
    return fixed, left


def _best_below(fits: list[int], left: dict[int, int], j: int, room: int, k: int) -> int:
    """The largest sum, up to ``room``, of two or more items from ``fits`` (``room`` if three fit: not examined further)."""
    least, total = 0, 0
    for s in fits:
        free = left[s] - (s == j)
        take = min(free, 3 - least)
        least, total = least + take, total + take * s
        if least == 3:
            break
    if least == 3 and total <= room:
        return room
    best, lo, hi = 0, 0, len(fits) - 1
    while lo <= hi:
        x = fits[lo] + fits[hi]
        if x > room or (lo == hi and left[fits[lo]] - (fits[lo] == j) < 2):
            hi -= 1
        else:
            best, lo = max(best, x), lo + 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first, on groups of equal bins: a group splits once per length at most."""
    free: dict[int, list] = {}
    mask = 0

    def put(room: int, bins: int, items: tuple) -> None:
        nonlocal mask
        if bins:
            free.setdefault(room, []).append((bins, items))
            mask |= 1 << room

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            fitting = mask >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                bins, items = free[room].pop()
                if not free[room]:
                    mask &= ~(1 << room)
            else:
                room, items = capacity, ()
                bins = -(-n // (capacity // size))
            each = min(room // size, max(1, n // bins))
            used = min(bins, n // each)
            put(room, bins - used, items) if items else None
            put(room - each * size, used, (*items, (size, each)))
            n -= used * each
    return [g for groups in free.values() for g in groups]


def solve(counts: dict[int, int], capacity: int) -> Bins:
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """For each length, by rank among the pieces of that length: sequence and offset."""

    def __init__(self, bins: Bins):
        rows, first, seen = [], 0, {}
        for n, items in bins:
            at = 0
            for size, each in items:
                rows.append((size, seen.get(size, 0), first, each, at))
                seen[size] = seen.get(size, 0) + n * each
                at += size * each
            first += n
        self.sequences = first
        t = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key = (t[:, 0] << 48) + t[:, 1]
        self.start, self.first, self.each, self.at = t[:, 1], t[:, 2], t[:, 3], t[:, 4]

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (size << 48) + rank, side="right") - 1
        k = rank - self.start[i]
        return self.first[i] + k // self.each[i], self.at[i] + k % self.each[i] * size


class Ids(dict):
    """Run of characters that the tokenizer merges on its own -> its ids as little-endian 32-bit bytes, cached up to a bound.

    The tokenizer splits at white space, drops it, lower-cases, and merges
    within runs of letters, single digits and runs of the rest.  For plain
    Latin characters a pattern gives those runs; any other stretch between
    ASCII white space goes to the tokenizer as it is.
    """

    def __init__(self, path: str, bound: int = CACHE_SIZE):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.bound, self.encode, self.merge = bound, tokenizer.encode, tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}  # the generation before: what is still in use moves over
        self.whole: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = np.array([x.id for x in self.merge(run.encode().decode("latin-1").translate(_BYTE_LETTERS))], "<u4").tobytes()
        if len(run) <= CACHED_CHARS:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[run] = ids
        return ids

    def odd(self, chunk: str) -> bytes:
        """Ids of a chunk as the tokenizer itself gives them."""
        ids = self.whole.get(chunk)
        if ids is None:
            ids = np.array(self.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            if len(chunk) <= CACHED_CHARS:
                if len(self.whole) >= self.bound // 4:
                    self.whole.clear()
                self.whole[chunk] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _PLAIN(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _RUNS(text.lower())))
        return b"".join(b"".join(map(self.__getitem__, _RUNS(w.lower()))) if _PLAIN(w) and "<|" not in w else self.odd(w) for w in _CHUNKS(text))


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from code 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()

#: Printable ASCII, ASCII white space and the letters of Latin-1: lower-casing and composing are the same everywhere.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]+").fullmatch
_RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+").findall
_CHUNKS = re.compile("[^\t-\r ]+").findall


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32."""

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _workers:
            _workers[tokenizer] = Ids(tokenizer)
        ids_of = _workers[tokenizer]
        last = np.array([end], "<u4").tobytes()
        for b in batches_of(it, BATCH_BYTES, "text"):
            out: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(b.column("text").to_pylist()):
                ids = ids_of.of(text) + last
                out += [(row, i, i * capacity, min(capacity, len(ids) // 4 - i * capacity), zlib.crc32(ids[4 * i * capacity : 4 * (i + 1) * capacity])) for i in range(-(-len(ids) // (4 * capacity)))]
            row, piece, start, length, crc = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], [id_col, "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col(id_col), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(cut_up, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    # The bucket splits the ranks of a common length over many tasks.
    rows = cut(pieces(docs, tokenizer, capacity, end, id_col).withColumn("uid", F.expr(f"xxhash64(`{id_col}`, piece, start, ids_crc32)")))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    total = sum(counts.values())
    places = rows.sparkSession.sparkContext.broadcast(Places(solve(counts, capacity)))
    buckets = max(8, total // 20_000)
    rows = rows.withColumn("bucket", F.expr(f"pmod(uid, {buckets})"))
    base = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = base.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    w = Window.partitionBy("length", "bucket").orderBy("uid", id_col, "piece")
    ranked = rows.withColumn("rank", F.row_number().over(w) - 1).join(base, ["length", "bucket"])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = places.value.of(size, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = rows.schema[id_col].dataType.simpleString()
    return ranked.select(F.col(id_col), "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).cast("long").alias("rank")).mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
