"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked.  Linked documents of one group that sit
in one shard are alike, so the propagation moves counts: a cell is (group,
shard, how many).  It starts from a hash of the id.  In every round each cell
looks at its neighbours' shards and asks to move to the one holding most of
its group among those with room; a shard that is asked for more than its
quota lets in the same fraction of everyone.  Rounds end when no cell asks to
move.  They do end: a move goes to a cell of the group no smaller than its own
or brings the whole group together, so the squares of the counts only grow.

Documents then take their cell's shard.  Unlinked documents have no neighbour
and fill what is left, so the law ``rows`` holds exactly: shard sizes differ
by one row at most.  Ranks are two-level (bucket counts, then rows within a
bucket), so no shard or group is ever sorted in one task.

Defined cases: a null text has size 8, a null crc and no links; repeated rows
are documents of their own with equal texts; null ids are placed like others;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.llm.common import cut, drop_cut

SHARDS = 24
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 256
FINE = 2**53


def propagate(groups: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Cells (g, shard, cnt) after balanced label propagation; ``groups`` has one such row per group and first shard."""
    cells = groups
    for r in itertools.count():
        load = {x.shard: x.n for x in cells.groupBy("shard").agg(F.sum("cnt").alias("n")).collect()}  # at most `shards` rows
        room = [max(0, capacity - load.get(s, 0)) for s in range(shards)]
        free = F.array(*[F.lit(x) for x in room])
        at_home = F.when(F.get(free, F.col("shard")) > 0, F.struct("cnt", (-F.col("shard")).alias("neg")))
        best = cells.groupBy("g").agg(F.max(at_home).alias("best"), F.sum("cnt").alias("all"), F.count("*").alias("apart"))
        # A small group with no room in any of its shards meets in the roomiest one.
        roomiest = room.index(max(room))
        meets = F.col("best").isNull() & (F.col("apart") > 1) & (F.col("all") <= max(room))
        to = F.when(meets, F.lit(roomiest)).otherwise(-F.col("best.neg"))
        want = cells.join(best, "g").withColumns({"to": to, "more": F.when(meets, F.col("all")).otherwise(F.col("best.cnt"))})
        asks = F.col("to").isNotNull() & (F.col("to") != F.col("shard")) & ((F.col("more") > F.col("cnt")) | ((F.col("more") == F.col("cnt")) & (F.col("to") < F.col("shard"))))
        want = want.withColumn("asks", F.coalesce(asks, F.lit(False)))
        want = want.withColumn("meets", meets)
        demand = {x["to"]: x.n for x in want.filter("asks").groupBy("to").agg(F.sum("cnt").alias("n")).collect()}
        if not demand:
            return cells
        share = F.array(*[F.lit(min(1.0, room[s] / demand[s]) if demand.get(s) else 0.0) for s in range(shards)])
        # A group that meets goes as a whole or not at all.
        chance, whole = (F.expr(f"pmod(xxhash64({x}, {r}), {FINE}L) / {FINE}D") for x in ("g, shard", "g"))
        moved = F.when(F.col("asks") & F.col("meets"), F.when(whole < F.get(share, F.col("to")), F.col("cnt")).otherwise(0)).when(F.col("asks"), F.least(F.col("cnt"), F.floor(F.col("cnt") * F.get(share, F.col("to")) + chance).cast("long"))).otherwise(0)
        want = want.withColumn("moved", moved)
        both = want.select("g", F.explode(F.array(F.struct("shard", (F.col("cnt") - F.col("moved")).alias("cnt")), F.struct(F.coalesce("to", "shard").alias("shard"), F.col("moved").alias("cnt")))).alias("c"))
        last, cells = cells, cut(both.filter("c.cnt > 0").groupBy("g", F.col("c.shard").alias("shard")).agg(F.sum("c.cnt").alias("cnt")))
        if r:
            drop_cut(last)


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text").cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("crc"), F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.crc32(text).alias("b"), F.octet_length("text").alias("c"))).alias("t"))
    rows = cut(rows.withColumns({"g": F.xxhash64("t.a", "t.b", "t.c"), "mix": F.xxhash64("id", "crc", "size")}).drop("t"))
    rows = rows.withColumn("g", F.when(F.col("crc").isNotNull(), F.col("g")))
    first = rows.filter("g is not null").groupBy("g", F.expr(f"pmod(mix, {shards})").cast("int").alias("shard")).agg(F.count("*").alias("cnt"))
    linked = first.groupBy("g").agg(F.sum("cnt").alias("all")).filter("all > 1").select("g")
    total = rows.count()
    low, extra = divmod(total, shards)
    cells = propagate(cut(first.join(linked, "g")), shards, low)
    # Each document of a group takes a cell by its hash; a group in one cell has no choice.
    order = Window.partitionBy("g").orderBy("shard")  # at most `shards` rows
    ends = cells.withColumn("end", F.sum("cnt").over(order)).groupBy("g").agg(F.max("end").alias("all"), F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    choice = F.expr("filter(ends, e -> e.end > pmod(mix, all))[0].shard")
    # What a full shard gives up are its last buckets: groups of a bucket's size or less stay together there.
    near = F.when(F.col("all") <= BUCKET_ROWS // 4, F.col("g")).otherwise(F.col("mix")).alias("near")
    placed = rows.join(ends, "g", "left").select("id", "size", "crc", "mix", near, F.coalesce(choice, F.lit(-1)).alias("p"))
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    placed = cut(placed.withColumn("bucket", F.expr(f"pmod(xxhash64(near, 7), {buckets})").cast("int")))
    counts = placed.groupBy("p", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("p").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("base", F.coalesce(before, F.lit(0))).drop("n")
    load = {r.p: r.n for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most shards + 1 rows
    size = [low + (s < extra) for s in range(shards)]
    kept = [min(size[s], load.get(s, 0)) for s in range(shards)]
    over, fill, gaps = [0], [0], []
    for s in range(shards):
        over.append(over[-1] + load.get(s, 0) - kept[s])
        fill.append(fill[-1] + size[s] - kept[s])
    gaps = F.array(*[F.struct(F.lit(fill[s + 1]).cast("long").alias("end"), F.lit(s).alias("s"), F.lit(kept[s] - fill[s]).cast("long").alias("add")) for s in range(shards)])
    inner = Window.partitionBy("p", "bucket").orderBy("near", "mix", "id", "crc")
    ranked = placed.withColumn("r", F.row_number().over(inner) - 1).join(base, ["p", "bucket"]).withColumn("r", F.col("r") + F.col("base"))
    longs = lambda x: F.array(*[F.lit(v).cast("long") for v in x])
    stays = (F.col("p") >= 0) & (F.col("r") < F.get(longs(kept), F.col("p")))
    pool = F.when(F.col("p") < 0, F.col("r") + over[-1]).otherwise(F.get(longs(over), F.col("p")) + F.col("r") - F.get(longs(kept), F.col("p")))
    ranked = ranked.withColumns({"stays": stays, "pool": pool}).withColumn("gap", F.when(~F.col("stays"), F.get(F.filter(gaps, lambda g: g["end"] > F.col("pool")), F.lit(0))))
    return ranked.select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        F.when(F.col("stays"), F.col("p")).otherwise(F.col("gap.s")).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("r")).otherwise(F.col("pool") + F.col("gap.add")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
