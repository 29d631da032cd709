"""Sharding by balanced label propagation (DataFrame functions only).

Documents with equal texts are linked. A shard is a label; linked documents move towards the shard that most of their
group holds, admitted by quotas, so that few links are cut while every shard keeps the same number of rows (law
``rows``: counts differ by one at most).

* A vertex is a bundle: the documents of one group whose id hash is equal modulo ``BUNDLES``. A group thus has at most
  ``BUNDLES`` vertices whatever its size, so no key of a join or window holds more than a small, fixed part of all rows.
* Bundles of a group that is small against a shard start with one label, drawn by the group; those of larger ones with labels of their own.
* A round sums the rows of each (group, shard) cell, orders a group's shards by what it already has there, walks
  that order while the shards have room, and so gives each bundle a wanted shard. Movers to a shard are dealt over
  lanes; each lane gets its part of the shard's room and admits bundles in the order of their gain.
* Rows that are linked with nothing, and bundles that found no room, fill the shards up to their exact quota.

Defined results: null text counts as empty (16 bytes); empty texts are linked like other equal texts; repeated rows are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from broadsheet.llm import common

BUNDLES = 1024
LANES = 32
#: Bundles of a (shard, lane) group in which movers are ranked; few lanes round quotas less.
BUNDLES_PER_LANE = 2_000
STAY_SLOTS = 1024
#: A group of up to this part of a shard's rows starts in one shard.
SMALL_GROUP = 1 / 4
#: Up to so many quotas (a row a shard and lane) are broadcast.
BROADCAST_QUOTAS = 100_000
#: Lanes whose first ranks are summed together.
LANES_TOGETHER = 4096
#: Rows of a (shard, lane) group in which slots are numbered.
ROWS_PER_LANE = 100_000


def _hash(*cols) -> F.Column:
    return F.xxhash64(*cols)


def _settled(wanted: DataFrame, room: list[int], lanes: int) -> DataFrame:
    """Bundles (gid, bundle, n, shard, moved) after the moves that the quotas admit.

    wanted: gid, bundle, n, shard, want (null: stays), gain. A lane of a shard gets its part of the shard's room, and admits its
    movers in the order of their gain while they fit. Bundles that stay are dealt by hash, so no key gathers them.
    """
    lane = F.col("want") * lanes + F.pmod(_hash("gid", "bundle"), F.lit(lanes)).cast("int")
    rows = common.scratch(wanted.withColumn("slot", F.coalesce(lane, -1 - F.pmod(_hash("gid", "bundle"), F.lit(STAY_SLOTS)).cast("int"))), "shard-wanted")
    asked = rows.where("slot >= 0").groupBy("slot").agg(F.sum("n").alias("asked")).withColumn("to", F.floor(F.col("slot") / lanes).cast("int"))
    free = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to") + 1)
    asked = asked.withColumn("total", F.sum("asked").over(Window.partitionBy("to"))).withColumn("room", free)  # lanes of a shard
    quota = asked.selectExpr("slot", "least(asked, CAST(room AS DECIMAL(19, 0)) * asked DIV total) AS quota")
    quota = F.broadcast(quota) if len(room) * lanes <= BROADCAST_QUOTAS else quota
    order = Window.partitionBy("slot").orderBy(F.col("gain").desc(), "gid", "bundle")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    moved = F.coalesce(F.col("upto") <= F.col("quota"), F.lit(False))
    out = rows.withColumn("upto", upto).join(quota, "slot", "left").withColumn("moved", moved)
    settled = common.scratch(out.select("gid", "bundle", "n", F.when(F.col("moved"), F.col("want")).otherwise(F.col("shard")).alias("shard"), "moved"), "shard-labels")
    common.drop(rows)
    return settled


def _wanted(bundles: DataFrame, room: list[int]) -> DataFrame:
    """The shard that each bundle wants: its group's shards in the order of what they hold of it, as far as they have room.

    All of it works on one exchange by group; a group has at most BUNDLES rows.
    """
    rows = bundles.select("gid", "bundle", "n", "shard").repartition("gid")
    has = Window.partitionBy("gid", "shard")
    liked = Window.partitionBy("gid").orderBy(F.col("has").desc_nulls_last(), F.xxhash64("gid", "shard"), F.col("shard").asc_nulls_last())
    inside = Window.partitionBy("gid").orderBy("place", "bundle").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("has", F.when(F.col("shard").isNotNull(), F.sum("n").over(has))).withColumn("place", F.dense_rank().over(liked))
    rows = rows.withColumn("at", F.sum("n").over(inside) - F.col("n"))
    free = F.element_at(F.array(*[F.lit(r).cast("long") for r in room]), F.col("to") + 1)
    cells = rows.where("shard IS NOT NULL").groupBy(F.col("gid").alias("c_gid"), F.col("shard").alias("to")).agg(F.first("place").alias("c_place"), F.first("has").alias("holds"))
    upto = Window.partitionBy("c_gid").orderBy("c_place").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("hi", F.sum(F.col("holds") + free).over(upto)).withColumn("lo", F.col("hi") - F.col("holds") - free)
    met = rows.join(cells, (F.col("gid") == F.col("c_gid")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")), "left")
    want = F.when(F.col("to").isNotNull() & ~F.col("to").eqNullSafe(F.col("shard")), F.col("to"))
    return met.select("gid", "bundle", "n", "shard", want.alias("want"), (F.col("holds") - F.coalesce("has", F.lit(0))).alias("gain"))


def _first_ranks(counts: DataFrame) -> DataFrame:
    """(lane, first): the rank of a lane's first row, from (lane, k); lanes are summed in two levels."""
    rows = counts.withColumn("block", F.floor(F.col("lane") / LANES_TOGETHER))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    blocks = rows.groupBy("block").agg(F.sum("k").alias("b"))
    blocks = blocks.select("block", (F.sum("b").over(upto(Window.orderBy("block"))) - F.col("b")).alias("before"))  # a row for LANES_TOGETHER lanes
    inside = F.sum("k").over(upto(Window.partitionBy("block").orderBy("lane"))) - F.col("k")
    return rows.withColumn("inside", inside).join(blocks, "block").select("lane", (F.col("before") + F.col("inside")).alias("first"))


def _room(bundles: DataFrame, n_shards: int, most: int) -> list[int]:
    """Rows that each shard can still take."""
    loads = {r.shard: r.load for r in bundles.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("n").alias("load")).collect()}  # one row a shard
    return [most - loads.get(s, 0) for s in range(n_shards)]


def shard_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = 40,
    rounds: int = 6,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard (null under law ``rows``)."""
    text = common.text_or_empty(text_col)
    heads = common.scratch(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.sha2(text, 256).alias("gid"),
            F.pmod(_hash(F.col(id_col)), F.lit(BUNDLES)).cast("int").alias("bundle"),
        ),
        "shard-heads",
    )
    all_bundles = heads.groupBy("gid", "bundle").agg(F.count("*").alias("n"))
    group_rows = Window.partitionBy("gid")  # at most BUNDLES rows
    linked = all_bundles.withColumn("m", F.sum("n").over(group_rows)).where("m > 1")
    linked = common.scratch(linked, "shard-linked")
    n_rows = heads.count()
    most = n_rows // n_shards  # the quota that every shard has, whichever get the rows left over

    lanes_n = max(1, -(-linked.count() // (n_shards * BUNDLES_PER_LANE)))
    own = F.when(F.col("m") <= SMALL_GROUP * most, _hash("gid", F.lit(1))).otherwise(_hash("gid", "bundle", F.lit(1)))
    first = F.pmod(own, F.lit(n_shards)).cast("int")
    start = linked.select("gid", "bundle", "n", F.lit(None).cast("int").alias("shard"), first.alias("want"), F.lit(0).cast("long").alias("gain"))
    bundles = _settled(start, [most] * n_shards, lanes_n)
    for _ in range(rounds):
        room = _room(bundles, n_shards, most)
        after = _settled(_wanted(bundles, room), room, lanes_n)
        common.drop(bundles)
        bundles = after
        if not bundles.where("moved").limit(1).count():
            break

    # Final quotas: the first shards take the rows that are left over.
    room = _room(bundles, n_shards, most)
    total = 0
    ends = [total := total + r + (s < n_rows % n_shards) for s, r in enumerate(room)]
    lanes = max(LANES, -(-n_rows // (n_shards * ROWS_PER_LANE)))
    lane = F.pmod(_hash("id", F.lit(2)), F.lit(lanes * n_shards)).cast("int")
    placed = heads.join(bundles.select("gid", "bundle", "shard"), ["gid", "bundle"], "left").select("id", "size", "text_crc32", "shard", lane.alias("lane"))
    placed = common.scratch(placed, "shard-placed")
    pool = placed.where("shard IS NULL")
    counts = pool.groupBy("lane").agg(F.count("*").alias("k"))
    firsts = _first_ranks(counts)
    rank = F.row_number().over(Window.partitionBy("lane").orderBy("id", "text_crc32", "size")) - 1
    ranked = pool.withColumn("rank", rank).join(firsts, "lane").withColumn("rank", F.col("rank") + F.col("first"))
    filled = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank"))).cast("int")
    ranked = ranked.withColumn("shard", filled)
    columns = ["id", "size", "text_crc32", "shard", "lane"]
    everyone = common.scratch(placed.where("shard IS NOT NULL").select(columns).unionByName(ranked.select(columns)).withColumn("lane", F.pmod("lane", F.lit(lanes))), "shard-filled")
    counts = everyone.groupBy("shard", "lane").agg(F.count("*").alias("k"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
    firsts = counts.select("shard", "lane", (F.sum("k").over(before) - F.col("k")).alias("first"))
    inner = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("id", "text_crc32", "size")) - 1
    numbered = everyone.withColumn("inner", inner).join(firsts, ["shard", "lane"])
    return numbered.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("inner") + F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
