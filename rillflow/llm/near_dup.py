"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document's set of word shingles, its
   size, a 128-bit key of the set and a MinHash signature.  Documents with
   equal sets are one class from here on; only classes are compared.
2. Signatures are cut into bands; classes that agree in a band are candidates.
   A pair at the threshold misses all bands with a chance of
   (1 - t**rows)**bands: 5e-8 at the defaults.
3. Candidates of a bucket are first the pairs with its least member: one pair
   per class, then one per class and component it is still apart from, so
   their number is linear.  Signatures are compared batch by batch; a
   pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls under ``MISS`` (uniform prior).
4. Survivors are verified on their full sets; links give components.
5. Where a bucket still holds several components, its rows outside the largest
   meet all its others in blocks of bounded size, each pair in the first bucket
   that its two share.  Signatures go first, without texts; only rows with a
   pair that they don't rule out are compared on their full sets, a pair only
   while its two components are apart.  So no candidate pair of different
   components stays untested, and only links come out.

Defined cases: null, empty and blank texts have an empty set and no links; a
text with fewer words than a shingle is one shingle; rows with a null id are
returned unlinked with component null and kept true; repeated rows are
documents with equal sets; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import MIX, batches_of, bounded_batches, byte_rows, cut, drop_cut, free_name, mix64
from rillflow.llm.graph import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, HASHES)
MISS = 1e-6
BLOCK, SIGNATURE_BLOCK = 512, 2_048
PAIRS = 200_000  # compared at a time
SHARE = 256
BROADCAST_IDS = 500_000
BATCH_BYTES = 4_000_000
WORD_CACHE = 300_000


class WordHash(dict):
    """word -> 64-bit hash, cached up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h
        return h


_hashes = WordHash()


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(_hashes.__getitem__, w)), np.uint64, int(n.sum()))
    m = len(flat)
    factor = mix64(np.arange(1, k + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    h = np.zeros(m, np.uint64)
    for j in range(min(k, m)):
        h[: m - j] += flat[j:] * factor[j]
    h = mix64(h)
    start = np.concatenate([[0], np.cumsum(n)])
    out = []
    for i, size in enumerate(n):
        if size >= k:
            out.append(np.unique(h[start[i] : start[i + 1] - k + 1]))
        elif size:
            out.append(mix64((flat[start[i] : start[i + 1]] * factor[:size]).sum(keepdims=True) + np.array([size], np.uint64) * MIX))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per set (all sets non-empty)."""
    flat = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    a = mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
    b = mix64(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64))
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(((flat * a[i] + b[i]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches that keep a pair.

    With m of n matching and a uniform prior the similarity is Beta(m + 1,
    n - m + 1); it reaches t with probability P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in STEPS:
        p = 0.0
        for m in range(n + 1):
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if p >= miss:
                break
        out[n] = m
    return out


def may_link(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Rows of two signature matrices that no batch's posterior rules out."""
    alive, seen, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n in STEPS:
        seen = seen + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        keep = seen >= least[n]
        alive, seen, done = alive[keep], seen[keep], n
    return alive


def _signature_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _texts(need: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(cid, text): one text of each class in ``need`` (cid)."""
    need = cut(need.join(classes.select("cid", "key", F.col("rep").alias("id")), "cid"))
    few = need.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(need) if few else need, "id")

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where an id is repeated, only the rows with the class's set."""
        for b in it:
            t = byte_rows(b, "text")
            keep = [i for i, (s, key) in enumerate(zip(shingle_sets(t, k), b.column("key").to_pylist(), strict=True)) if set_key(s) == key]
            yield b.take(pa.array(keep, pa.int64())).select(["cid", "text"])

    if docs.groupBy("id").count().filter("count > 1").isEmpty():
        return rows.select("cid", "text")
    return rows.select("cid", "key", "text").mapInArrow(own, "cid long, text string").dropDuplicates(["cid"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    need = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = cut(_texts(need, classes, docs, k))
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("tb"))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for b in batches_of(it, BATCH_BYTES, "tb"):
            a, keep = b.column("a").to_pylist(), []
            sets, ta = shingle_sets(byte_rows(b, "tb"), k), b.column("ta")
            for i, y in enumerate(sets):
                if a[i] != last:
                    last, of_last = a[i], shingle_sets([ta[i].as_py().encode()], k)[0]
                if _similar(of_last, y, percent):
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select(["a", "b"])
        _hashes.clear()

    # A class with very many pairs is dealt, with a copy of its text each, to as many tasks as SHARE of them make.
    hot = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).filter("shares > 1"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    share = F.coalesce(F.pmod(F.xxhash64("b"), F.col("shares")), F.lit(0)).cast("int")
    pairs = pairs.join(hot, "a", "left").select("a", "b", share.alias("share"))
    left = left.join(hot, "a", "left").select("a", "ta", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    joined = pairs.join(right, "b").join(left.hint("merge"), ["a", "share"]).select("a", "b", "ta", "tb")
    links = cut(joined.mapInArrow(check, "a long, b long"))
    drop_cut(texts)
    return links


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Rows of buckets with several components, dealt to groups of two sides that have to meet: band, number, kind, i, j, side, cid, comp.

    Groups of a band: (0, i, j) two blocks of what lies outside the largest
    component, (1, i, j) a block of that and one of the largest.
    """
    sizes = placed.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band")
    mixed = sizes.agg(F.count("*").alias("comps"), F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("all")).filter("comps > 1")
    number = lambda n: F.ceil(n / block).cast("int")
    mixed = mixed.select("band", F.col("main.comp").alias("main"), number(F.col("main.n")).alias("mains"), number(F.col("all") - F.col("main.n")).alias("rests"))
    rows = placed.join(mixed, "band").withColumn("rest", F.col("comp") != F.col("main"))
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(cid), if(rest, rests, mains)) as int)"))
    rest_rest = "transform(sequence(0, rests - 1), j -> struct(0 as kind, least(own, j) as i, greatest(own, j) as j, int(own > j) as side))"
    rest_main = "transform(sequence(0, mains - 1), j -> struct(1 as kind, own as i, j as j, 0 as side))"
    main_rest = "transform(sequence(0, rests - 1), j -> struct(1 as kind, j as i, own as j, 1 as side))"
    return rows.withColumn("to", F.explode(F.expr(f"if(rest, concat({rest_rest}, {rest_main}), {main_rest})"))).select("band", "number", "to.*", "cid", "comp")


def _grouped(rows: DataFrame, work: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work(table, group, first, last)`` on many whole groups at a time: row x of side 0 meets rows ``first[x]`` up to ``last[x]``."""
    keys = ["band", "kind", "i", "j"]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            end = np.append(start[1:], t.num_rows)[group]
            side = t.column("side").to_numpy()
            ones = np.bincount(group, side, len(start)).astype(np.int64)  # rows of side 1 come last
            same = (t.column("kind").to_numpy() == 0) & (t.column("i").to_numpy() == t.column("j").to_numpy())
            first = np.where(same, np.arange(t.num_rows) + 1, end - ones[group])
            return work(t, group, first, np.where((side == 0) | same, end, first))

        def edges(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[:1] = True
            for c in keys:
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            return new

        for b in it:
            held.append(b)
            if sum(x.num_rows for x in held) >= 4 * BLOCK or sum(x.nbytes for x in held) >= 2 * BATCH_BYTES:
                t = pa.Table.from_batches(held)
                new = edges(t)
                whole = int(np.flatnonzero(new)[-1])  # the last group may go on
                if whole:
                    yield done(t.slice(0, whole), new[:whole])
                    held = t.slice(whole).combine_chunks().to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield done(t, edges(t))
        _hashes.clear()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "side", "cid").mapInArrow(read, schema)


def _candidates(t: pa.Table, percent: int, least: dict[int, int], first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (x, y, equal hashes) that may be linked: of two components, alike in size, and in no earlier bucket together."""
    comp, size, number = (t.column(c).to_numpy() for c in ("comp", "size_", "number"))
    sig = _signature_rows(t.column("sig"))
    length = np.maximum(0, last - first)
    total = np.cumsum(length)
    lo = 0
    while lo < len(length):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        n = length[lo:hi]
        x = np.repeat(np.arange(lo, hi), n)
        y = np.repeat(first[lo:hi] - np.cumsum(n) + n, n) + np.arange(len(x))
        keep = (comp[x] != comp[y]) & (np.minimum(size[x], size[y]) * 100 >= np.maximum(size[x], size[y]) * percent)
        x, y = x[keep], y[keep]
        equal, done = np.zeros(len(x), np.int32), 0
        for step in STEPS:
            equal = equal + (sig[:, done:step][x] == sig[:, done:step][y]).sum(axis=1)
            keep = equal >= least[step]
            x, y, equal, done = x[keep], y[keep], equal[keep], step
        earliest = (sig[x] == sig[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        keep = earliest == number[x]
        yield x[keep], y[keep], equal[keep]
        lo = hi


def _across_components(placed: DataFrame, classes: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, least: dict[int, int]) -> DataFrame:
    """Links (a, b) between components of a bucket.  ``placed`` has band, number, cid and comp."""

    def alive(t: pa.Table, group: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """Rows with a pair that signatures don't rule out."""
        found = np.zeros(t.num_rows, bool)
        for x, y, _ in _candidates(t, percent, least, first, last):
            found[x] = found[y] = True
        return t.select(["band", "cid"]).filter(pa.array(found)).combine_chunks().to_batches(max_chunksize=t.num_rows)[0] if found.any() else pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["band", "cid"])

    def across(t: pa.Table, group: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """Links between components, until no pair of a group's two sides is both apart and untested."""
        cid, comp, text = t.column("cid").to_numpy(), t.column("comp").to_numpy(), t.column("text")
        sets: dict[int, np.ndarray] = {}
        top: dict[tuple[int, int], tuple[int, int]] = {}

        def set_of(i: int) -> np.ndarray:
            if cid[i] not in sets:
                sets[cid[i]] = shingle_sets([text[i].as_py().encode()], k)[0]
            return sets[cid[i]]

        def root(i: int) -> tuple[int, int]:
            at = (int(group[i]), int(comp[i]))
            while (up := top.get(at, at)) != at:
                at = up
            return at

        out = []
        for xs, ys, equal in _candidates(t, percent, least, first, last):
            order = np.lexsort((-equal, xs, group[xs]))
            for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
                a, b = root(x), root(y)
                if a != b and _similar(set_of(x), set_of(y), percent):
                    out.append((int(cid[x]), int(cid[y])))
                    top[max(a, b)] = min(a, b)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    left = cut(_grouped(_blocks(placed, SIGNATURE_BLOCK).join(sigs, "cid"), alive, "band long, cid long").distinct())
    texts = cut(_texts(left.select("cid").distinct(), classes, docs, k).join(sigs, "cid"))
    return cut(_grouped(_blocks(placed.join(left, ["band", "cid"], "left_semi"), BLOCK).join(texts, "cid"), across, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), "text")
    kind = docs.schema["id"].dataType.simpleString()
    least = least_matches(percent / 100)

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(it, BATCH_BYTES, "text"):
            sets = shingle_sets(byte_rows(b, "text"), k)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([next(sig).tobytes() if len(s) else b"" for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), *cols], ["id", "n", "key", "sig"])
        _hashes.clear()  # workers live on; later tasks need the memory more than these words

    members = cut(docs.mapInArrow(describe, f"id {kind}, n long, key binary, sig binary"))
    classes = members.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))

    def band(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)[None, :] * MIX
        for b in it:
            if b.num_rows:
                s = _signature_rows(b.column("sig")).astype(np.uint64).reshape(-1, BANDS, ROWS)
                h = number.repeat(len(s), 0)
                for r in range(ROWS):
                    h = mix64(h ^ s[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), len(s))), pa.array(np.repeat(b.column("cid").to_numpy(), BANDS))], ["band", "number", "cid"])

    bands = classes.select("cid", "sig").mapInArrow(band, "band long, number byte, cid long")
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("cid").alias("first")).filter("size > 1")
    buckets = cut(bands.join(shared, "band"))
    sigs = classes.select("cid", "sig", F.col("n").alias("size_"))
    ratio = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)

    def prune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                keep = may_link(_signature_rows(b.column("sa")), _signature_rows(b.column("sb")), least)
                yield b.take(pa.array(keep)).select(["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among (a, b): sizes, then signatures, then full sets."""
        pairs = pairs.join(sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sb"), F.col("size_").alias("nb")), "b").join(sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sa"), F.col("size_").alias("na")), "a").filter(ratio(F.col("na"), F.col("nb")))
        return _verified(cut(pairs.select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long")), classes, docs, k, percent)

    star = cut(buckets.filter("cid <> first").select("first", "cid").distinct())

    def unresolved(comp: DataFrame) -> DataFrame:
        """Pairs (first, cid) whose components a and b differ."""
        at = star.join(comp, F.col("cid") == F.col("node"), "left").select("first", "cid", F.coalesce("comp", "cid").alias("b"))
        at = at.join(comp, F.col("first") == F.col("node"), "left").select("first", "cid", F.coalesce("comp", "first").alias("a"), "b")
        return at.filter("a <> b")

    # One pair per class first; then one per class and component that it is still apart from.
    links = linked(star.groupBy(F.col("cid").alias("b")).agg(F.min("first").alias("a")).select("a", "b"))
    comp = components(links)
    second = linked(unresolved(comp).groupBy(F.col("cid").alias("b"), F.col("a").alias("other")).agg(F.min("first").alias("a")).select("a", "b"))
    if not second.isEmpty():
        links = links.unionByName(second)
        comp = components(links)

    # Buckets whose components are still apart.
    of = buckets.join(comp, F.col("cid") == F.col("node"), "left").select("band", "number", "cid", F.coalesce("comp", "cid").alias("comp"))
    mixed = of.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("band")
    placed = cut(of.join(mixed, "band", "left_semi"))
    if not placed.isEmpty():
        more = _across_components(placed, classes, sigs, docs, k, percent, least)
        if not more.isEmpty():
            comp = components(links.unionByName(more))
    final = classes.select("key", "cid", "rep").join(comp, F.col("cid") == F.col("node"), "left").select(F.col("key").alias("key_"), "rep", "comp")
    names = cut(final.filter("comp is not null").groupBy("comp").agg(F.min("rep").alias("component")))
    few = names.count() <= BROADCAST_IDS
    final = final.join(F.broadcast(names) if few else names, "comp", "left").select("key_", F.coalesce("component", "rep").alias("component"))
    done = members.select("id", "n", "key").join(final, (F.col("key") == F.col("key_")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return done.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near-duplicates (its least id)."""
    n = docs.agg(F.count("*").alias("rows"), F.count(id_col).alias("ids"), F.countDistinct(id_col).alias("distinct")).first()
    if n.rows == n.ids == n.distinct:
        key, rows = id_col, docs
    else:  # repeated or null ids: rows are told apart by a number of their own, in the order of ids
        key = free_name(docs.columns, "_row")
        rows = cut(docs.orderBy(F.col(id_col).asc_nulls_last()).withColumn(key, F.monotonically_increasing_id()))
    gone = cut(near_duplicates(rows, k, percent, key).filter("not kept").select(key))
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*docs.columns)


SQL = r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
i as (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s from i),
n as (select doc_id, count(*) as n from s group by doc_id),
b as (select x.doc_id as a, y.doc_id as b, count(*) as both from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
l as (select b.a, b.b from b join n x on b.a = x.doc_id join n y on b.b = y.doc_id where 100 * b.both >= 80 * (x.n + y.n - b.both)),
c as (select doc_id, doc_id as component from d union select l.b, c.component from c join l on c.doc_id = l.a),
m as (select doc_id, min(component) as component_id from c group by doc_id)
select m.doc_id, coalesce(n.n, 0) as n_shingles, component_id, m.doc_id = component_id as kept from m left join n on m.doc_id = n.doc_id
"""
