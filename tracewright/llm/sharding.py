"""Balanced label propagation over groups of equal texts, in DataFrame operations only.

Documents begin in shards drawn from their ids, their labels.  Copies of a text
are linked, so that a document's neighbours are the other copies, and what they
say about a shard is how many of them are in it.  In every round each group of
copies that has not settled proposes to move to the shard where most of it is,
among those that have room for all of it; if none of its own has, to one that
has.  A shard takes proposals up to its quota, groups that save most links
first.  Groups that were refused propose again in the next round, together with
those of the next smaller sizes: large groups come first, since small ones fit
later too.  A group that is larger than any room left moves in parts of the
largest room, and the rest.  Rounds end when all have settled: in each, the
first of the proposals to a shard is taken, so that there is none without a move.

Texts that occur once have no neighbours; they fill every shard to its quota, so
that counts differ by one at most (law rows).

Ranks and running sums come in two levels: totals by salt, and rows within a
salt; a text's shards reach its copies by a join on counted keys, in which a
very common text is broadcast.  So no group, however large, meets in one task.

Defined cases: a null text counts as an empty one, with a size of 16 and the
checksum of no bytes; rows without doc_id and repeated rows are placed each by
itself; a very long text is only hashed and measured; with fewer documents than
shards some shards stay empty; an empty table gives no rows; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_counted, written

SHARDS = 40
#: Sizes of groups that propose together are within this ratio, refused ones aside.
BAND = 4


def _ranked(df: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """df with __rank, from 0 without gaps among rows of equal keys; df: a table with a unique column row."""
    df = df.withColumn("__salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    counts = df.groupBy(*keys, "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__from", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("row")) - 1
    return df.withColumn("__own", own).join(counts, [*keys, "__salt"]).withColumn("__rank", F.col("__from") + F.col("__own")).drop("__salt", "__own", "__from")


def _by_shard(key: Column, values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), key)


def _proposals(nodes: DataFrame, room: list[int], turn: int) -> DataFrame:
    """nodes, of which those larger than any room are parted, with the shard to that each wants to move."""
    top = max(room)
    parts = F.expr(f"if(w > {top}L, concat(array_repeat({top}L, int((w - 1) div {top}L)), array((w - 1) % {top}L + 1)), array(w))")
    rows = nodes.select("g1", "g2", "part", "labels", F.posexplode(parts).alias("k", "w"))
    rows = rows.withColumn("part", F.when(F.col("k") == 0, F.col("part")).otherwise(F.xxhash64("part", "k", F.lit(turn))))
    rooms = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(n).cast("long").alias("room")) for s, n in enumerate(room) if n])
    fits = lambda x: F.get(F.array(*[F.lit(n).cast("long") for n in room]), x["shard"]) >= F.col("w")
    # labels are sorted, the shard with most neighbours first; without one, any shard with room, drawn by the group
    mine = F.get(F.filter("labels", fits), F.col("k"))["shard"]
    others = F.filter(rooms, lambda x: x["room"] >= F.col("w"))
    drawn = F.get(others, F.pmod(F.xxhash64("g1", "g2", F.lit(turn)) + F.col("k"), F.size(others)).cast("int"))["shard"]
    return rows.withColumn("to", F.coalesce(mine, F.when(F.size(others) > 0, drawn))).drop("k")


def _taken(rows: DataFrame, room: list[int], salts: int) -> DataFrame:
    """rows with taken: whether the shard has room, after the larger groups that propose to it, and equal ones before it."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("g1", "g2", "part"), F.lit(salts)))
    totals = rows.where("to is not null").groupBy("to", "w", "salt").agg((F.count("*") * F.col("w")).alias("sum"))
    before = Window.partitionBy("to").orderBy(F.desc("w"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("from", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    own = F.row_number().over(Window.partitionBy("to", "w", "salt").orderBy("g1", "g2", "part")) * F.col("w")
    rows = rows.withColumn("own", own).join(totals, ["to", "w", "salt"], "left")
    return rows.withColumn("taken", F.coalesce(F.col("from") + F.col("own") <= _by_shard(F.col("to"), room), F.lit(False))).drop("salt", "own", "from")


def propagate(labels: DataFrame, quota: list[int]) -> DataFrame:
    """A table of g1, g2, shard, w: how many copies of each group each shard takes, within its quota.

    labels: g1, g2, shard and n, copies of a group that begin in a shard; groups of one copy take no part.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.xxhash64("g1", "shard").alias("h"), "shard")))
    nodes = labels.groupBy("g1", "g2").agg(F.sum("n").alias("w"), order.alias("labels")).where("w > 1")  # a label for each shard at most
    every = written(nodes.withColumn("part", F.lit(0).cast("long")), "groups")
    band = F.floor(F.log(F.col("w").cast("double")) / math.log(BAND) + 1e-9)
    bands = {r[0]: r[1] for r in every.groupBy(band.alias("band")).agg(F.count("*")).collect()}  # a row for each size, in powers of BAND
    room, turn = list(quota), 0
    settled: DataFrame | None = None
    nodes: DataFrame | None = None
    n = 0
    while bands or n:
        if bands:
            size = max(bands)
            n += bands.pop(size)
            new = every.where(band == size)
            nodes = new if nodes is None else nodes.unionByName(new)
        rows = written(_taken(_proposals(nodes, room, turn), room, max(1, math.isqrt(n))), f"proposals-{turn}")
        took = {r[0]: (r[1], r[2]) for r in rows.groupBy(F.when(F.col("taken"), F.col("to")).alias("to")).agg(F.sum("w"), F.count("*")).collect()}  # a row for each shard and one more
        went = rows.where("taken").select("g1", "g2", F.col("to").alias("shard"), "w")
        settled = went if settled is None else settled.unionByName(went)
        n = took.pop(None, (0, 0))[1]
        nodes = rows.where("not taken").select("g1", "g2", "labels", "w", "part") if n else None
        for s, (w, _) in took.items():
            room[s] -= w
        turn += 1
    if settled is None:
        return every.select("g1", "g2", F.lit(0).alias("shard"), "w")
    return written(settled.groupBy("g1", "g2", "shard").agg(F.sum("w").alias("w")), "settled")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(17), text).alias("g2"))
    slim = written(slim.withColumn("row", F.monotonically_increasing_id()).withColumn("first", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")), "sizes")
    n = slim.count()
    salts = max(1, 4 * math.isqrt(n))
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    state = propagate(slim.groupBy("g1", "g2", F.col("first").alias("shard")).agg(F.count("*").alias("n")), quota)
    until = Window.partitionBy("g1", "g2").orderBy("shard")  # a row for each shard at most
    deal = state.withColumn("until", F.sum("w").over(until)).groupBy("g1", "g2").agg(F.array_sort(F.collect_list(F.struct("until", "shard"))).alias("deal"), F.sum("w").alias("copies"))
    deal = written(deal, "deals")
    held = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("w")).collect()}
    held = [held.get(s, 0) for s in range(shards)]
    # a text that occurs once has no deal; the ranks of a text with one deal don't matter
    dealt = join_counted(slim, deal, ["g1", "g2"], "copies", "left", n).withColumn("deal", F.coalesce("deal", F.array().cast("array<struct<until:bigint,shard:int>>")))
    several = _ranked(dealt.where("size(deal) > 1"), ["g1", "g2"], salts)
    several = several.withColumn("key", F.get(F.filter("deal", lambda x: F.col("__rank") < x["until"]), F.lit(0))["shard"])
    whole = dealt.where("size(deal) < 2").withColumn("key", F.coalesce(F.get("deal", F.lit(0))["shard"], F.lit(shards)))
    columns = ["row", "doc_id", "size", "text_crc32", "key"]
    ranked = _ranked(written(whole.select(*columns).unionByName(several.select(*columns)), "keys"), ["key"], salts)
    # texts that occur once fill the shards one after the other
    fill, at = [], 0
    for s in range(shards):
        fill.append(at)
        at += quota[s] - held[s]
    key, rank = F.col("key"), F.col("__rank")
    ends = F.array(*[F.lit(x).cast("long") for x in [*fill[1:], at]])
    target = F.size(F.filter(ends, lambda x: x <= F.col("__rank"))).cast("int")
    out = ranked.withColumn("shard", F.when(key < shards, key).otherwise(target))
    slot = F.when(key < shards, rank).otherwise(_by_shard(F.col("shard"), held) + rank - _by_shard(F.col("shard"), fill))
    return out.select("doc_id", "size", F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
