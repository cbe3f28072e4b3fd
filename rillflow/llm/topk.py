"""Exact top-k inner-product search on a bit-sliced index.

Every attribute of a block of rows is quantised (its low ``DROP`` bits go) and
stored as slices: one bitmap over the rows per bit.  For a query the slices are
added with bitmap arithmetic (carry-save adders over 64 rows a word), each at
the weight of the query's component; a negative component reads complemented
codes, so all weights are positive.  The sum is again a bit-sliced attribute.
Its k largest rows are found from the most significant slice downward; the
quantisation error bounds how far below the k-th sum an exact winner can be,
and every row within that bound is scored exactly.

Rows are dealt into blocks of bounded size.  A task builds a block's index
once and lets all queries pass by it, batch by batch; it returns k rows per
query.  So a row moves once, a query once per block.  Identical rows are added
up first and stand for as many as could be among the k, so that copies of one
row don't crowd a block.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do rows with a null id; rows bearing the query's
id are not its candidates; repeated rows count each; a query meets vectors of
its own length only; identical rows with a query's id are one query.  Scores are exact while they fit 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_batches

BLOCK = 65_536
LEAST_BLOCK, TASKS = 2_048, 12  # small tables are dealt into up to TASKS blocks of at least so many rows
DROP = 2


def _add(slices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of equally weighted bitmaps: their sum's low bitmap and the carries, one weight up."""
    carries = []
    while len(slices) > 2:
        n = len(slices) // 3
        a, b, c = slices[:n], slices[n : 2 * n], slices[2 * n : 3 * n]
        half = a ^ b
        carries.append((a & b) | (half & c))
        slices = np.concatenate([half ^ c, slices[3 * n :]])
    if len(slices) == 2:
        carries.append((slices[:1] & slices[1:]))
        slices = slices[:1] ^ slices[1:]
    return slices[0], np.concatenate(carries) if carries else slices[:0]


class SlicedIndex:
    """Bit slices of one block: ``x`` is rows x attributes, integers."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, drop: int = DROP):
        self.x, self.ids, self.drop = x, ids, drop
        self.low = x.min(axis=0)
        codes = (x - self.low) >> drop
        self.top = codes.max(axis=0)
        self.bits = np.maximum(1, np.array([int(t).bit_length() for t in self.top]))
        self.words = -(-len(x) // 64)
        self.first = np.concatenate([[0], np.cumsum(self.bits)])
        # The second half holds the complemented codes' slices, for negative weights.
        self.slices = np.zeros((2 * self.first[-1], self.words), np.uint64)
        pad = self.words * 64 - len(x)
        self.all = self._pack(np.ones((1, len(x)), bool), pad)[0]
        full = (1 << self.bits) - 1
        for half, c in ((0, codes), (self.first[-1], full - codes)):
            for d in range(x.shape[1]):
                rows = (c[:, d][None, :] >> np.arange(self.bits[d])[:, None]) & 1
                self.slices[half + self.first[d] : half + self.first[d + 1]] = self._pack(rows.astype(bool), pad)

    def _pack(self, rows: np.ndarray, pad: int) -> np.ndarray:
        return np.packbits(np.pad(rows, ((0, 0), (0, pad))), axis=1, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the weighted sum of codes."""
        weight = np.abs(q).astype(np.int64)
        base = self.first[:-1] + np.where(q < 0, self.first[-1], 0)
        d = np.repeat(np.arange(len(q)), self.bits)
        bit = np.arange(self.first[-1]) - np.repeat(self.first[:-1], self.bits)
        at = base[d] + bit
        out: list[np.ndarray] = []
        carry = self.slices[:0]
        width = int(weight.max(initial=0)).bit_length() + int(self.bits.max())
        position = 0
        while position < width or len(carry):
            shift = position - bit
            use = (shift >= 0) & ((weight[d] >> np.maximum(shift, 0)) & 1 == 1)
            low = np.concatenate([self.slices[at[use]], carry])
            if len(low):
                s, carry = _add(low)
            else:
                s, carry = np.zeros(self.words, np.uint64), low
            out.append(s)
            position += 1
        return out

    @staticmethod
    def count(bitmap: np.ndarray) -> int:
        return int(np.bitwise_count(bitmap).sum())

    def kth(self, sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
        """The k-th largest sum among ``rows`` (the least, if there are fewer), slice by slice from the top."""
        sure, tied, value = 0, rows, 0
        k = min(k, self.count(rows))
        for i in reversed(range(len(sums))):
            high = tied & sums[i]
            n = sure + self.count(high)
            if n >= k:
                tied = high
                value |= 1 << i
            else:
                sure = n
                tied = tied & ~sums[i]
        return value

    @staticmethod
    def at_least(sums: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
        if value <= 0:
            return rows
        if value >> len(sums):
            return rows & np.uint64(0)
        above, equal = np.zeros_like(rows), rows
        for i in reversed(range(len(sums))):
            if value >> i & 1:
                equal = equal & sums[i]
            else:
                above |= equal & sums[i]
                equal = equal & ~sums[i]
        return above | equal

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, ties to smaller ids."""
        rows = self.all.copy()
        for r in np.flatnonzero(self.ids == own):
            rows[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        if not rows.any():
            return self.ids[:0], self.ids[:0]
        sums = self.sums(q)
        # Dropped bits add up to sum(|q|) * (2**drop - 1) to a score: that many code units, rounded up.
        slack = -(-(int(np.abs(q).sum()) * ((1 << self.drop) - 1)) // (1 << self.drop))
        found = self.at_least(sums, rows, self.kth(sums, rows, k) - slack)
        at = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little", count=len(self.x)))
        score = self.x[at] @ q
        best = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][best], score[best]


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Per query (id divisible by ``query_every``): query_id, rank from 1, vec_id, score."""
    ok = f"`{id_col}` is not null and `{vec_col}` is not null and size(`{vec_col}`) > 0 and forall(`{vec_col}`, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col)).filter(ok)
    rows = rows.select("id", F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    rows = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k + 1)).cast("int").alias("copies"))
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // BLOCK), min(TASKS, total // LEAST_BLOCK))
    base = rows.withColumn("v_", F.explode(F.array_repeat("v", F.col("copies")))).select(F.expr(f"pmod(xxhash64(id, v), {blocks})").cast("int").alias("block"), F.lit(0).alias("side"), "id", F.col("v_").alias("v"))
    queries = rows.filter(F.col("id") % query_every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "id", "v")

    def arrays(b: pa.RecordBatch | pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Ids and matrix, by vector length; ids in order."""
        v = b.column("v")
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        ids, offsets = b.column("id").to_numpy(), v.offsets.to_numpy()
        size, flat, start = np.diff(offsets), v.values.to_numpy(zero_copy_only=False), offsets[:-1]
        out = {}
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            at = at[np.argsort(ids[at], kind="stable")]
            out[int(n)] = ids[at], flat[start[at][:, None] + np.arange(n)]
        return out

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block, rows before queries: an index per vector length from the rows, then the queries as they come."""
        block, held, index = None, [], {}
        for whole in it:
            number, side = whole.column("block").to_numpy(), whole.column("side").to_numpy()
            edges = np.flatnonzero(np.diff(number.astype(np.int64) * 2 + side)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(number)], strict=True):
                if lo == hi:
                    continue
                part = whole.slice(lo, hi - lo)
                if number[lo] != block:
                    block, held, index = number[lo], [], {}
                if side[lo] == 0:
                    held.append(part)
                    continue
                if held:
                    index = {n: SlicedIndex(x, ids) for n, (ids, x) in arrays(pa.Table.from_batches(held)).items()}
                    held = []
                out: list[list] = [[], [], []]
                for n, (ids, qs) in arrays(part).items():
                    for own, q in zip(ids, qs, strict=True) if n in index else ():
                        found, score = index[n].search(q, own, k)
                        out[0] += [own] * len(found)
                        out[1] += found.tolist()
                        out[2] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    bounded_batches(vectors.sparkSession)
    both = base.unionByName(queries).repartition(blocks, "block").sortWithinPartitions("block", "side")
    found = both.mapInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
