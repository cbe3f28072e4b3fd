"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A window is ``size`` consecutive words of an item (an item of fewer words is
one window); it is the set of its word shingles with their places.  All its
shingles must occur in a document, so one is enough as prefix: its rarest.

1. Rarity: one scan counts, per shingle of the windows, its places in the
   documents; nothing but the hash moves, added up before it does.
2. A window with a shingle that never occurs is done; the others are ordered by
   rarity and join by their rarest shingle alone, in a second scan.
3. The shingle's place in the window gives the start; starts before the text
   or windows past its end fall to the position and length bounds, and the
   words around the hit are compared with the window's: exact containment.

Either scan meets a sieve first: the wanted hashes as bits of ``SLOTS`` rows at
most, which are broadcast.  What falls through joins the wanted shingles
themselves, broadcast up to ``BROADCAST`` of them (checked), by shuffle beyond.
So whatever the benchmark's size, words move only for places of prefixes.

Defined cases: null texts have no words, items without words no windows;
repeated rows get the same result each; items with equal windows all count;
null item ids are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import cut

WORD_SIZE = 10
SHINGLE = 3
BROADCAST = 500_000
SLOTS = 1 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Lower-cases A-Z and splits at ASCII characters that are neither letters nor digits; null gives no words."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WORD_SIZE, id_col: str = "item_id") -> DataFrame:
    """Per item and distinct window: item, words, n, wid (a hash of the words)."""
    w = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words("text").alias("w")).filter("size(w) > 0")
    w = w.select("item", F.expr(f"explode(transform(sequence(0, greatest(size(w) - {size}, 0)), i -> slice(w, i + 1, {size})))").alias("words"))
    return w.distinct().withColumns({"n": F.size("words"), "wid": F.sha2(F.concat_ws(" ", "words"), 256)})


def _shingled(rows: DataFrame, w: str, k: int, at: str) -> DataFrame:
    """The columns of ``rows`` with every place ``at`` of ``k`` consecutive words of ``w`` and their hash ``h``: all in generated code.

    Short arrays have no place by a null sequence, not by a filter: that would be pushed below and split the texts a second time.
    """
    rows = rows.select("*", F.explode(F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k))).alias(at))
    return rows.withColumn("h", F.xxhash64(F.lit(k), *[F.get(w, F.col(at) + j) for j in range(k)]))


def _slot(h: str = "h") -> tuple[Column, Column]:
    """A hash's row of the sieve and its bit there."""
    return F.col(h).bitwiseAND(F.lit(SLOTS - 1)), F.shiftrightunsigned(h, 58).cast("int")


def _sieved(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose ``h`` may be among ``wanted`` (h, distinct): its bits, in ``SLOTS`` rows at most, are broadcast."""
    slot, bit = _slot()
    sieve = wanted.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, int(shiftrightunsigned(h, 58)))")).alias("bits"))
    return rows.withColumn("slot", slot).join(F.broadcast(sieve), "slot").filter(F.getbit("bits", bit) == 1).drop("slot", "bits")


def _few(rows: DataFrame, n: int) -> DataFrame:
    """To be broadcast if ``n``, the number of rows, allows it."""
    return F.broadcast(rows) if n <= BROADCAST else rows


def occurrences(docs: DataFrame, wins: DataFrame, size: int = WORD_SIZE) -> DataFrame:
    """Per document row key and occurrence: doc, uid, start, n, wid.  ``docs`` has doc, uid, w."""
    keys = wins.select("wid", "words", "n").distinct().withColumn("k", F.least(F.lit(SHINGLE), "n"))
    each = [_shingled(keys.filter(F.col("k") == k), "words", k, "o") for k in range(1, SHINGLE + 1)]
    shingles = cut(each[0].unionByName(each[1]).unionByName(each[2]))
    wanted = cut(shingles.select("k", "h").distinct())
    sizes = {r.k: r.n for r in wanted.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    if not sizes:
        return docs.select("doc", "uid", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("wid")).filter("false")

    def places(k: int, of: DataFrame) -> DataFrame:
        """doc, uid, w, pos, h of the documents' shingles of ``k`` words that may be among ``of``."""
        return _sieved(_shingled(docs.select("doc", "uid", "w"), "w", k, "pos"), of)

    seen = None
    for k in sorted(sizes):
        want = wanted.filter(F.col("k") == k).select("h")
        part = places(k, want).groupBy("h").agg(F.count("*").alias("often")).join(_few(want, sizes[k]), "h", "left_semi").withColumn("k", F.lit(k))
        seen = part if seen is None else seen.unionByName(part)
    seen = cut(seen)
    ranked = shingles.join(_few(seen, sum(sizes.values())), ["k", "h"], "left").groupBy("wid", "words", "n", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "o", "h")).alias("p"))
    prefix = cut(ranked.filter("p.often > 0").select("wid", "words", "n", "k", F.col("p.o").alias("o"), F.col("p.h").alias("h")))
    left = {r.k: r.n for r in prefix.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    found = None
    for k in sorted(left):
        own = prefix.filter(F.col("k") == k)
        first = F.greatest(F.col("pos") - (size - k), F.lit(0))
        hits = places(k, own.select("h").distinct()).select("doc", "uid", "pos", "h", first.alias("first"), F.slice("w", first + 1, F.lit(2 * size)).alias("around"))
        start = F.col("pos") - F.col("o")
        part = hits.join(_few(own, left[k]), "h").filter(start >= 0).filter(F.slice("around", start - F.col("first") + 1, F.col("n")) == F.col("words"))
        part = part.select("doc", "uid", start.alias("start"), "n", "wid")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.select("doc", "uid", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit("").alias("wid")).filter("false")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WORD_SIZE, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), "text").alias("uid"), words("text").alias("w"))
    wins = cut(windows(items, size, item_col))
    found = cut(occurrences(keyed, wins, size).distinct())
    by_start = Window.partitionBy("doc", "uid").orderBy("start", "n")
    end = F.col("start") + F.col("n")
    before = F.max(end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    hit = found.select("doc", "uid", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("new"))
    hit = hit.groupBy("doc", "uid").agg(F.sum("new").alias("n_hit"))
    # A set of item ids, at most as many as the benchmark has.
    of = found.select("doc", "uid", "wid").distinct().join(wins.select("wid", "item").distinct(), "wid")
    of = of.groupBy("doc", "uid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = hit.join(of, ["doc", "uid"]).withColumnsRenamed({"doc": "doc_", "uid": "uid_"})
    rows = keyed.select("doc", "uid", F.size("w").alias("n_words"))
    rows = rows.join(both, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("uid") == F.col("uid_")), "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(F.col("doc").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WORD_SIZE, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, without a word inside an occurrence of an item's window."""
    uid = F.xxhash64(F.col(id_col), "text")
    keyed = docs.select(F.col(id_col).alias("doc"), uid.alias("uid"), words("text").alias("w"))
    bad = cut(occurrences(keyed, cut(windows(items, size, item_col)), size).select("doc", "uid").distinct())
    few = bad.count() <= BROADCAST
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(id_col).alias("a"), uid.alias("b"))
    return rows.join(F.broadcast(bad) if few else bad, F.col("a").eqNullSafe(F.col("doc")) & (F.col("b") == F.col("uid")), "left_anti").select("all.*")


SQL = r"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (
  select cast(item_id as varchar) as item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark where item_id is not null),
bi as (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0),
bw as (select distinct item, least(len(w), 10) as n, array_to_string(w[i : i + 9], ' ') as s from bi),
sizes as (select distinct n from bw),
di as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from di),
hits as (select distinct dw.doc_id, dw.i, dw.n, bw.item from dw join bw on dw.n = bw.n and dw.s = bw.s),
pos as (select distinct doc_id, unnest(range(i, i + n)) as p from hits),
nh as (select doc_id, count(*) as n_hit from pos group by doc_id),
it as (select doc_id, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items_sha256 from hits group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join nh on d.doc_id = nh.doc_id left join it on d.doc_id = it.doc_id
"""
