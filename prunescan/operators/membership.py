"""Cluster membership as a fold over events: Joined, Left, and Snapshot, which replaces all."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold(events: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Members after all events (``cluster, seq, kind, node, members``): one row a member, ``cluster, node``.

    Only the last snapshot and the last event of each node after it matter; all are aggregates, so a cluster's
    events are never gathered.
    """
    last = events.filter("kind = 'Snapshot'").groupBy(cluster).agg(F.max("seq").alias("snap"), F.max_by("members", "seq").alias("members"))
    later = events.join(last.select(cluster, "snap"), cluster, "left").filter("kind <> 'Snapshot' and seq > coalesce(snap, -1)")
    base = last.select(cluster, F.explode("members").alias("node")).select(cluster, "node", F.lit(-1).cast("long").alias("seq"), F.lit("Joined").alias("kind"))
    steps = later.select(cluster, "node", F.col("seq").cast("long").alias("seq"), "kind").unionByName(base)
    return steps.groupBy(cluster, "node").agg(F.max_by("kind", "seq").alias("kind")).filter("kind = 'Joined'").drop("kind")


def latest(events: DataFrame, cluster: str = "cluster") -> DataFrame:
    """The events that decide the members: of each cluster the last snapshot, of each node the last other event.

    ``fold`` of these is ``fold`` of all, also where they were taken of parts of the events one after the other, in
    whatever order events came. Over a stream they are the state (a row a node and one for the snapshot), and what is
    aggregated before the shuffle is one row a node and task.
    """
    snapshot = F.col("kind") == "Snapshot"
    e = events.select(cluster, "seq", "kind", F.when(~snapshot, F.col("node")).alias("node"), "members", snapshot.alias("snapshot"))
    last = e.groupBy(cluster, "node", "snapshot").agg(F.max("seq").alias("seq"), F.max_by(F.struct("kind", "members"), "seq").alias("last"))
    return last.select(cluster, "seq", "last.kind", "node", "last.members")


def peers(members: DataFrame, own: str, node: str = "node") -> DataFrame:
    """The other members: all but the node itself."""
    return members.filter(F.col(node) != own)


def static_members(own: str, others: list[str]) -> list[str]:
    """A fixed cluster: the node itself and its peers, as given."""
    return [own, *others]
