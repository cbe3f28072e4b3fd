"""Removal of repeated byte strings by suffix sorting.

Every byte that lies in a ``length``-byte string which also starts earlier
(smaller id, or same text and earlier start) goes.

Whole copies go first: a text that equals an earlier one (by SHA-256) is
covered altogether.  Getting other equal strings together: each window of ``length`` bytes is named by
the least hash of its ``GRAM``-byte grams, so equal windows have equal names.
Neighbouring windows mostly share their name; a maximal run of such windows is
a stretch, kept as one piece of text.  Names that occur once are dropped after
one shuffle of (name, place) rows; the texts of the other stretches are
shuffled by name, equal ones aggregated to their first place before they move.
A name with more than ``STRETCHES`` different texts is split by longer grams,
at last by whole windows; so no task collects an unbounded group.

Within a batch of whole names, the windows are sorted by two-stage suffix
sorting: only suffixes smaller than their successors are sorted directly (by
eight bytes at a time, ties only); a scan over the buckets of first bytes
induces all others from their successors.  Common prefixes of neighbours then
tell equal windows; all but the first place of each are marked.  A stretch
that is not its text's first place is marked whole.

Defined cases: null and empty texts have no bytes; texts shorter than
``length`` lose nothing; where ids are repeated or null, rows are ordered by
id (null first) and then by text, and identical rows one after the other;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.llm.common import batches_of, bounded_batches, byte_rows, cut, free_name, mix64, release

LENGTH = 100
GRAM = 32
STRETCHES = 20_000
BATCH_BYTES = 1_000_000
HOT_NAMES = 65_536
NAME_BYTES = 250_000  # small enough for the arrays to stay in cache
BROADCAST_COPIES = 1_000_000


# --- names ----------------------------------------------------------------


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each place on (the last k - 1 are of no use)."""
    out, done, rest = None, 0, k
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    power = np.array([0x100000001B3], np.uint64)  # an array: scalars warn when they wrap
    while rest:
        if rest & 1:
            if out is None:
                out = h.copy()
            else:
                shifted = np.zeros_like(h)
                shifted[: len(h) - done] = h[done:]
                out = out * power + shifted
            done += size
        rest >>= 1
        if rest:
            shifted = np.zeros_like(h)
            shifted[: len(h) - size] = h[size:]
            h = h * power + shifted
            power = power * power
            size *= 2
    return mix64(out)


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Least of w values from each place on (the last w - 1 are of no use)."""
    size = 1
    least = h
    while size * 2 <= w:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(least) - (w - size)], least[w - size :])
    return least


def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, windows and name of every stretch; and whether its name's gram stands in it more than once."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    end = np.cumsum(size)
    empty = np.zeros(0, np.int64)
    if not len(size) or end[-1] < length:
        return empty, empty, empty, empty, np.zeros(0, bool)
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = length - gram + 1
    hashes = _gram_hashes(data, gram)[: len(data) - gram + 1]
    name = _window_least(hashes, width)
    row = np.repeat(np.arange(len(texts)), size)[: len(name)]
    at = np.arange(len(name))
    fits = at + length <= end[row]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1]) | ~fits[:-1]
    first = np.flatnonzero(new & fits)
    # A stretch ends where the next begins or where its text has no further window.
    last = np.minimum(np.append(first[1:], len(name)), end[row[first]] - length + 1)
    begin = end - size
    # A gram names a window around it if its hash is as large as the largest name of those windows.
    pad = np.concatenate([np.zeros(width - 1, np.uint64), name, np.zeros(width - 1, np.uint64)])
    naming = np.flatnonzero(~_window_least(~pad, width) == hashes)
    x, y = naming[:-1], naming[1:]
    of = np.repeat(np.arange(len(texts)), size)
    twice = np.flatnonzero((hashes[x] == hashes[y]) & (of[x] == of[y]) & (y - x <= width))
    at = np.maximum(y[twice] - width + 1, begin[of[y[twice]]])
    inner = np.zeros(len(first), bool)
    if len(at):
        inner[np.searchsorted(first, at, side="right") - 1] = True
    return row[first], first - begin[row[first]], last - first, name[first].view(np.int64), inner


# --- two-stage suffix sorting ---------------------------------------------


def _eight(data: np.ndarray) -> np.ndarray:
    """Big-endian number of the eight bytes from each place on."""
    k = data.astype(np.uint64)
    for step in (1, 2, 4):
        shifted = np.zeros_like(k)
        shifted[: len(k) - step] = k[step:]
        k = (k << np.uint64(8 * step)) | shifted
    return k


def _sort_directly(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes: eight at a time, ties only."""
    order = places[np.argsort(keys[places], kind="stable")]
    same = keys[order[1:]] == keys[order[:-1]]
    for done in range(8, depth, 8):
        tied = np.zeros(len(order), bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.append(True, ~same))[at]
        part = order[at]
        key = keys[part + done]
        by = np.lexsort((key, group))
        order[at] = part[by]
        key, group = key[by], group[by]
        still = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        same = np.zeros(len(order) - 1, bool)
        same[at[1:][still] - 1] = True
    return order


def sort_suffixes(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places, ordered by the first ``depth`` bytes of their suffixes.

    ``data`` ends in at least ``depth + 8`` zeros; ``wanted`` marks places, and
    each wanted place with a smaller successor must have that one wanted too.
    """
    step = np.sign(np.diff(data.astype(np.int16)))
    at = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    rises = step[np.minimum.accumulate(at[::-1])[::-1]] > 0  # suffix smaller than its successor
    rises = np.append(rises, False)
    rises[data == 0] = True  # separators are sorted directly
    keys = _eight(data)
    direct = _sort_directly(np.flatnonzero(wanted & rises), keys, depth)
    induced = wanted & ~rises
    first = data[direct]
    ends = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(part: np.ndarray) -> np.ndarray:
        """Deals the predecessors of a finished part to their buckets; returns those of bucket ``c`` itself."""
        before = part[part > 0] - 1
        before = before[induced[before]]
        kind = data[before]
        own = before[kind == c]
        others = kind != c
        before, kind = before[others], kind[others]
        by = np.argsort(kind, kind="stable")
        before, kind = before[by], kind[by]
        values, starts = np.unique(kind, return_index=True)
        for v, piece in zip(values, np.split(before, starts[1:]), strict=False):
            waiting[v].append(piece)
        return own

    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(part):
            out.append(part)
            part = scan(part)
        part = direct[ends[c] : ends[c + 1]]
        if len(part):
            out.append(part)
            scan(part)
    return np.concatenate(out) if out else direct


def repeated_windows(texts: list[bytes], windows: np.ndarray, ord_: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the offsets of its windows that also start at an earlier (ord, place) among all texts' windows."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.zeros(int(size.sum()) + len(texts) + length + 16, np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"\x00".join(texts), np.uint8)
    data[: len(joined)] = joined
    is_window = np.zeros(len(data), bool)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + windows, -1)
    is_window[:] = np.cumsum(edge)[:-1] > 0
    # Close the set: from the last window on, successors as far as they get smaller, and the place that ends them.
    falls = np.append(data[:-1] >= data[1:], False)
    need = is_window.copy()
    need[begin + windows] = True
    front = begin + windows
    while len(front):
        front = front[falls[front] & (data[front] > 0)] + 1
        front = front[~need[front]]
        need[front] = True
    order = sort_suffixes(data, need, length + 8)
    order = order[is_window[order]]
    keys = _eight(data)
    same = np.ones(max(0, len(order) - 1), bool)
    for done in range(0, length, 8):
        shift = np.uint64(8 * max(0, done + 8 - length))
        left = np.flatnonzero(same)
        same[left] = (keys[order[left] + done] >> shift) == (keys[order[left + 1] + done] >> shift)
    group = np.cumsum(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    at = order[tied]
    text = np.searchsorted(begin, at, side="right") - 1
    place = at - begin[text]
    by = np.lexsort((start[text] + place, ord_[text], group[tied]))
    g = group[tied][by]
    later = np.append(False, g[1:] == g[:-1]) if len(g) else np.zeros(0, bool)
    text, place = text[by][later], place[by][later]
    by = np.lexsort((place, text))
    return np.split(place[by], np.searchsorted(text[by], np.arange(1, len(texts))))


# --- Spark ----------------------------------------------------------------


def _with_order(docs: DataFrame, id_col: str, others: list[str]) -> tuple[DataFrame, str]:
    """Adds ``ord``, a long that orders the rows: the id itself where ids are whole numbers, present and distinct."""
    docs = docs.select(F.col(id_col).alias("id"), "text", *(F.col(c).alias(f"_{c}") for c in others))
    if isinstance(docs.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n = docs.agg(F.count("*").alias("rows"), F.count("id").alias("ids"), F.countDistinct("id").alias("distinct")).first()
        if n.rows == n.ids == n.distinct:
            return docs.withColumn("ord", F.col("id").cast("long")), docs.schema["id"].dataType.simpleString()
    ordered = docs.orderBy(F.col("id").asc_nulls_first(), "text").withColumn("ord", F.monotonically_increasing_id())
    return cut(ordered), docs.schema["id"].dataType.simpleString()


def _repeated_names(docs: DataFrame, copies: DataFrame, length: int) -> DataFrame:
    """Stretches (ord, start, windows, name) whose name occurs more than once, in another stretch or within (windows < 0 until then)."""

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All stretches; ``sure`` are those whose name this task has given out several times before."""
        hot, recent, held = np.zeros(0, np.int64), [], 0
        for b in batches_of(it, NAME_BYTES, "text"):
            row, start, n, names, inner = stretches([t or b"" for t in byte_rows(b, "text")], length, GRAM)
            sure = hot[np.minimum(np.searchsorted(hot, names), len(hot) - 1)] == names if len(hot) else np.zeros(len(names), bool)
            yield pa.RecordBatch.from_arrays([b.column("ord").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(np.where(inner, -n, n).astype(np.int32)), pa.array(names), pa.array(sure)], ["ord", "start", "windows", "name", "sure"])
            recent.append(names[~sure])
            held += len(recent[-1])
            if held >= HOT_NAMES:
                found, often = np.unique(np.concatenate(recent), return_counts=True)
                hot, recent, held = np.union1d(hot, found[often >= 4])[:HOT_NAMES], [], 0

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by name: those with a neighbour of the same name; the last row waits for the next batch."""
        held, repeats = None, False
        for b in it:
            if not b.num_rows:
                continue
            names = b.column("name").to_numpy()
            first = held is not None and held.column("name")[0].as_py() == names[0]
            if held is not None and (repeats or first):
                yield held
            same = names[1:] == names[:-1]
            often = np.zeros(len(names), bool)
            often[1:] |= same
            often[:-1] |= same
            often[0] |= first
            often |= (b.column("windows").to_numpy() < 0) | b.column("sure").to_numpy(zero_copy_only=False)
            out = np.flatnonzero(often[:-1])
            yield b.take(pa.array(out))
            held, repeats = b.slice(len(names) - 1, 1), bool(often[-1])
        if held is not None and repeats:
            yield held

    schema = "ord long, start int, windows int, name long, sure boolean"
    rows = docs.select("ord", "text").mapInArrow(name, schema)
    few = copies.count() <= BROADCAST_COPIES
    rows = rows.join(F.broadcast(copies) if few else copies, "ord", "left_anti")
    # Stretches of a very common name are dealt by their place: the ones given out by name before tell the others of it.
    to = F.when(F.col("sure"), F.xxhash64("ord", "start")).otherwise(F.col("name"))
    kept = rows.repartition(to).sortWithinPartitions("name").mapInArrow(keep, schema)
    return cut(kept.select("ord", "start", F.abs("windows").alias("windows"), "name"))


PIECE = "name long, piece binary, windows int, ord long, start int"


def _first_places(pieces: DataFrame) -> DataFrame:
    """Equal pieces of a name to one, at its first place."""
    first = pieces.groupBy("name", "piece").agg(F.min(F.struct("ord", "start")).alias("f"), F.min("windows").alias("windows"))
    return first.select("name", "piece", "windows", F.col("f.ord").alias("ord"), F.col("f.start").alias("start"))


def _marked(pieces: DataFrame, length: int) -> DataFrame:
    """(ord, start, marks): for each distinct piece, at its first place, the offsets of its repeated windows."""

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(t: pa.Table) -> pa.RecordBatch:
            ord_, start, n = (t.column(c).to_numpy().astype(np.int64) for c in ("ord", "start", "windows"))
            marks = repeated_windows(t.column("piece").to_pylist(), n, ord_, start, length)
            return pa.RecordBatch.from_arrays([pa.array(ord_), pa.array(start.astype(np.int32)), pa.array([m.astype("<u4").tobytes() for m in marks], pa.binary())], ["ord", "start", "marks"])

        size = 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column("piece").nbytes
            if size >= BATCH_BYTES:
                t = pa.Table.from_batches(held)
                names = t.column("name").to_numpy()
                whole = int(np.searchsorted(names, names[-1], side="left"))  # the last name may go on
                if whole:
                    yield settle(t.slice(0, whole))
                    held = t.slice(whole).combine_chunks().to_batches()
                    size = sum(x.column("piece").nbytes for x in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    return pieces.repartition("name").sortWithinPartitions("name").mapInArrow(mark, "ord long, start int, marks binary")


def _finer(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Pieces cut again by longer grams."""

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column("piece").to_pylist()
            row, start, n, name, _ = stretches(texts, length, gram)
            take = pa.array(row)
            cuts = pa.array([texts[r][s : s + w + length - 1] for r, s, w in zip(row, start, n, strict=True)], pa.binary())
            place = b.column("start").take(take).to_numpy() + start
            yield pa.RecordBatch.from_arrays([pa.array(name), cuts, pa.array(n.astype(np.int32)), b.column("ord").take(take), pa.array(place.astype(np.int32))], ["name", "piece", "windows", "ord", "start"])

    return pieces.mapInArrow(again, PIECE)


def _copies(docs: DataFrame, length: int) -> DataFrame:
    """(ord) of every text of ``length`` bytes or more that equals an earlier one."""
    keys = docs.filter(F.octet_length("text") >= length).select("ord", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    firsts = keys.groupBy("key").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return cut(keys.join(firsts, "key").filter("ord <> first").select("ord"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per ord with something to remove: spans, each a run of repeated windows or the offsets of some (``marks``).

    ``docs`` has ord and text.  A text that equals an earlier one has a run of
    -1 windows: all of them.
    """
    copies = _copies(docs, length)
    found = _repeated_names(docs, copies, length)
    release(docs.sparkSession)
    lists = found.groupBy("ord").agg(F.collect_list(F.struct("start", "windows", "name")).alias("all"))  # as many as a text has bytes, at most
    joined = docs.select("ord", "text").join(lists, "ord")

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, BATCH_BYTES, "text"):
            out: list[tuple] = []
            for t, ord_, all_ in zip(byte_rows(b, "text"), b.column("ord").to_pylist(), b.column("all").to_pylist(), strict=True):
                out += [(x["name"], t[x["start"] : x["start"] + x["windows"] + length - 1], x["windows"], ord_, x["start"]) for x in all_]
            cols = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["name", "piece", "windows", "ord", "start"])

    level = cut(_first_places(joined.select("ord", "text", "all").mapInArrow(fetch, PIECE)))
    release(docs.sparkSession)
    places, parts = found.select("ord", "start", "windows"), copies.select("ord", F.lit(0).alias("start"), F.lit(-1).alias("windows"), F.lit(None).cast("binary").alias("marks"))
    for gram in (2 * GRAM, length, None):
        # Places that are not their piece's first are repeated whole; first places get their marks.
        firsts = level.select("ord", "start")
        part = places.join(firsts, ["ord", "start"], "left_anti").select("ord", "start", "windows", F.lit(None).cast("binary").alias("marks"))
        crowded = cut(level.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") > STRETCHES).select("name"))
        last = gram is None or not crowded.limit(1).count()
        part = part.unionByName(_marked(level if last else level.join(crowded, "name", "left_anti"), length).filter("length(marks) > 0").select("ord", "start", F.lit(0).alias("windows"), "marks"))
        parts = parts.unionByName(part)
        if last:
            break
        finer = cut(_finer(level.join(crowded, "name", "left_semi"), length, gram))
        level, places = cut(_first_places(finer)), finer.select("ord", "start", "windows")
    spans = cut(parts.groupBy("ord").agg(F.collect_list(F.struct("start", "windows", "marks")).alias("spans")))
    release(docs.sparkSession)
    return spans


def _covered(spans: list[dict] | None, size: int, length: int) -> np.ndarray:
    """Which of a text's bytes go."""
    edge = np.zeros(size + 1, np.int32)
    for s in spans or ():
        if s["marks"] is None:
            edge[s["start"]] += 1
            edge[s["start"] + s["windows"] + length - 1 if s["windows"] >= 0 else size] -= 1
        else:
            at = s["start"] + np.frombuffer(s["marks"], "<u4").astype(np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _each(docs: DataFrame, length: int, id_col: str, schema: str, make, others: list[str] = ()) -> DataFrame:
    """``make(text, mask)`` for every row, beside its id and ``others``."""
    types = {c: docs.schema[c].dataType.simpleString() for c in others}
    bounded_batches(docs.sparkSession)
    docs, kind = _with_order(docs, id_col, list(others))
    spans = repeated_spans(docs, length)

    names = [id_col, *(x.split()[0] for x in schema.split(", ")), *others]
    kinds = [{"bigint": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, BATCH_BYTES, "text"):
            out = [make(t, _covered(s, len(t or b""), length) if s else None) for t, s in zip(byte_rows(b, "text"), b.column("spans").to_pylist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), *(b.column(f"_{c}") for c in others)], names)

    joined = docs.join(spans, "ord", "left").select("id", "text", "spans", *(f"_{c}" for c in others))
    return joined.mapInArrow(apply, ", ".join([f"`{id_col}` {kind}", schema, *(f"`{c}` {t}" for c, t in types.items())]))


def suffix_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""

    def make(text: bytes | None, gone: np.ndarray | None) -> tuple[int, int, int, str]:
        text = text or b""
        if gone is None:
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()

    return _each(docs, length, id_col, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", make)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", count: str = "n_removed") -> DataFrame:
    """Per row: id, text without its repeated bytes (null stays null; bytes of a cut character go too), the number removed as ``count``, other columns.

    Where ``docs`` has a column ``count`` of its own, that one stays and the number gets the next free name (``n_removed_``).
    """
    count = free_name(docs.columns, count)

    def make(text: bytes | None, gone: np.ndarray | None) -> tuple[str | None, int]:
        if text is None or gone is None:
            return None if text is None else text.decode(), 0
        return np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"), int(gone.sum())

    return _each(docs, length, id_col, f"text string, {count} bigint", make, [c for c in docs.columns if c not in (id_col, "text")])


SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, substr(h, cast(2 * p + 1 as bigint), 200) as s from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as p from d where len(h) >= 200)),
r as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from w) where k > 1),
e as (select doc_id, p, max(p + 100) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as before from r),
g as (select doc_id, p, sum(case when before is null or p > before then 1 else 0 end) over (partition by doc_id order by p) as run from e),
t as (select doc_id, run, min(p) as first, max(p) + 100 as last from g group by doc_id, run),
k as (select doc_id, first, last, coalesce(lag(last) over (partition by doc_id order by first), 0) as before from t),
x as (select doc_id, cast(sum(last - first) as bigint) as n_removed, count(*) as n_spans, max(last) as last from t group by doc_id),
y as (select k.doc_id, string_agg(substr(d.h, cast(2 * k.before + 1 as bigint), cast(2 * (k.first - k.before) as bigint)), '' order by k.first) as h from k join d on k.doc_id = d.doc_id group by k.doc_id)
select d.doc_id, len(d.h) // 2 as n_bytes, coalesce(x.n_removed, 0) as n_removed, coalesce(x.n_spans, 0) as n_spans,
  sha256(unhex(case when x.doc_id is null then d.h else y.h || substr(d.h, cast(2 * x.last + 1 as bigint)) end)) as kept_sha256
from d left join x on d.doc_id = x.doc_id left join y on d.doc_id = y.doc_id
"""
