"""Consistent-hash placement as joins: a ring of virtual nodes, owners, replicas and what moves when nodes change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: The hash space: 60 bits of MD5, which every SQL engine can compute.
BITS = 60


def ring_hash(text: Column) -> Column:
    """Place of a text on the ring."""
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def build_ring(spark: SparkSession, nodes: list[str], vnodes: int = 150) -> DataFrame:
    """``node, vnode, hash``; equal members count once."""
    names = F.explode(F.array(*map(F.lit, dict.fromkeys(nodes)))) if nodes else F.explode(F.array().cast("array<string>"))
    ring = spark.range(1).select(names.alias("node")).withColumn("vnode", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))))
    return ring.withColumn("hash", ring_hash(F.concat_ws("#", "node", "vnode")))


def intervals(ring: DataFrame, replicas: int = 1) -> DataFrame:
    """Hash intervals ``(lo, hi]`` with the nodes in charge of them, nearest first: ``lo, hi, nodes``.

    The ring (members times virtual nodes) is the small side, whatever the number of keys. The interval before
    the first place wraps round: its keys lie above the last place or up to the first.
    """
    places = ring.groupBy("hash").agg(F.min("node").alias("node"))
    size = places.agg(F.count("*").alias("places"), F.countDistinct("node").alias("nodes")).first()
    need, ahead = min(replicas, size.nodes), 1 if replicas == 1 else 8 * replicas
    twice = places.unionByName(places.select((F.col("hash") + F.lit(1 << BITS)).alias("hash"), "node"))
    order = Window.orderBy("hash")
    while True:  # look further ahead until every place has seen enough different nodes
        seen = F.array_distinct(F.collect_list("node").over(order.rowsBetween(0, ahead - 1)))
        chosen = twice.select(F.col("hash").alias("hi"), F.lag("hash").over(order).alias("lo"), seen.alias("nodes")).filter(F.col("hi") < F.lit(1 << BITS))
        if ahead >= size.places or not size.places or chosen.agg(F.min(F.size("nodes"))).first()[0] >= need:
            break
        ahead *= 4
    chosen = chosen.withColumn("nodes", F.slice("nodes", 1, max(1, need)))
    last = chosen.agg(F.max("hi").alias("top"))
    wrap = chosen.filter("lo is null").crossJoin(last)
    return (
        chosen.filter("lo is not null").select("lo", "hi", "nodes")
        .unionByName(wrap.select(F.lit(-1).cast("long").alias("lo"), "hi", "nodes"))
        .unionByName(wrap.select(F.col("top").alias("lo"), F.lit((1 << BITS) - 1).alias("hi"), "nodes"))
    )


#: Rings of up to this many virtual nodes are sent to all tasks; a larger one is joined by bins of the hash space.
MOST_SENT = 200_000


def place(keys: DataFrame, ring: DataFrame, key: str, replicas: int = 1, bins: int = 4096) -> DataFrame:
    """``keys`` with ``nodes``, the first ``replicas`` different nodes at or after the key's place; null for an empty ring.

    A range join as an equi-join: intervals are listed under every bin of the hash space that they touch, so a
    key meets the one or two intervals of its bin. A ring of up to MOST_SENT places is sent to all tasks, keys
    aren't shuffled then; a larger one, with more bins, is joined by them.
    """
    places = ring.count()
    width = (1 << BITS) // max(bins, places)
    side = intervals(ring, replicas).withColumn("bin", F.explode(F.sequence(F.expr(f"(lo + 1) div {width}"), F.expr(f"hi div {width}"))))
    k = keys.withColumn("_h", ring_hash(F.col(key))).withColumn("_bin", F.expr(f"_h div {width}"))
    on = (F.col("_bin") == F.col("bin")) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi"))
    return k.join(F.broadcast(side) if places <= MOST_SENT else side, on, "left").drop("_h", "_bin", "bin", "lo", "hi")


def owners(keys: DataFrame, ring: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``owner``, the node in charge."""
    return place(keys, ring, key).withColumn("owner", F.try_element_at("nodes", F.lit(1))).drop("nodes")


def local(keys: DataFrame, ring: DataFrame, key: str, node: str) -> DataFrame:
    """``keys`` with ``is_local``: whether ``node`` is in charge; false for an empty ring."""
    return owners(keys, ring, key).withColumn("is_local", F.coalesce(F.col("owner") == node, F.lit(False))).drop("owner")


def first_live(keys: DataFrame, ring: DataFrame, key: str, failed: list[str], replicas: int = 3) -> DataFrame:
    """``keys`` with ``owner``, the first of their replicas that hasn't failed; null if all have."""
    bad = F.array(*map(F.lit, failed)) if failed else F.array().cast("array<string>")
    return place(keys, ring, key, replicas).withColumn("owner", F.try_element_at(F.array_except("nodes", bad), F.lit(1))).drop("nodes")


def remapped(keys: DataFrame, before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``owner_before``, ``owner_after``."""
    return owners(owners(keys, before, key).withColumnRenamed("owner", "owner_before"), after, key).withColumnRenamed("owner", "owner_after")
