"""Nodes and links as DataFrames; the peers of all nodes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TopologyError
from ..schemas import TOPOLOGY
from .order import with_position


MODES = ("full-mesh", "file")


def load(spark: SparkSession, path: str, local_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a topology file; nodes carry their 0-based position. Refuses bad JSON, repeated ids and a local
    id that is not among the nodes."""
    raw = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(TOPOLOGY).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("node_idx", "n")).select("node_idx", "n.*")
    links = raw.select(F.inline("links"))
    if again := [r["id"] for r in duplicate_ids(nodes).limit(10).collect()]:
        raise TopologyError(f"repeated node ids: {again}")
    if local_id is not None and not nodes.where(F.col("id") == local_id).limit(1).count():
        raise TopologyError(f"the topology has no node {local_id}")
    return nodes, links


def peers_of(nodes: DataFrame, links: DataFrame, mode: str = "full-mesh", key: str = "id") -> DataFrame:
    """node_id, peer_id of all nodes: every other node, or those that the file links."""
    if mode not in MODES:
        raise TopologyError(f"mode {mode} is not one of {', '.join(MODES)}")
    return mesh_peers(nodes, key) if mode == "full-mesh" else link_peers(nodes, links, key)


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with their 0-based place in ``order`` as ``node_idx``."""
    return with_position(nodes, order).withColumn("node_idx", F.col("__pl_pos").cast("int")).drop("__pl_pos")


def duplicate_ids(nodes: DataFrame, key: str = "id") -> DataFrame:
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mesh_peers(nodes: DataFrame, key: str = "id") -> DataFrame:
    """Every ordered pair of different nodes (the result is quadratic by definition)."""
    a, b = nodes.select(F.col(key).alias("node_id")), nodes.select(F.col(key).alias("peer_id"))
    return a.crossJoin(b).where("node_id <> peer_id")


def link_peers(nodes: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """Links in both directions, once each; links to unknown nodes fall away and a self-link is kept."""
    both = links.select(F.col("source").alias("node_id"), F.col("target").alias("peer_id"))
    both = both.union(both.select("peer_id", "node_id")).distinct()
    known = nodes.select(key)
    return both.join(known, F.col("node_id") == known[key], "left_semi").join(known, F.col("peer_id") == known[key], "left_semi")


def unknown_ids(nodes: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    ends = links.select(F.col("source").alias("id")).union(links.select(F.col("target").alias("id"))).distinct()
    return ends.join(nodes.select(F.col(key).alias("id")), "id", "left_anti")


def exclude(peers: DataFrame, excluded: DataFrame) -> DataFrame:
    """Peers less those excluded for the whole run, on either side."""
    for side in ("peer_id", "node_id"):
        peers = peers.join(excluded.select(F.col("id").alias(side)), side, "left_anti")
    return peers.select("node_id", "peer_id")
