"""Seed tables of the graph and the topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsloom import rules as R


def seed_entities(spark: SparkSession) -> DataFrame:
    rows = [(name, kind, 1.0) for kind, names in R.SEED_ENTITIES.items() for name in names]
    return spark.createDataFrame(rows, "name string, type string, confidence double")


def seed_relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.SEED_RELATIONS, "src string, src_type string, dst string, dst_type string, type string")


def topology_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(R.SEED_TOPOLOGY_NODES, "name string, type string")


def topology_edges(spark: SparkSession) -> DataFrame:
    """Seeded edges, and DEPLOYED_IN from each host to its data center."""
    inside = [(host, center, "DEPLOYED_IN") for host, center in R.HOST_DATACENTER]
    return spark.createDataFrame(R.SEED_TOPOLOGY_EDGES + inside, "src string, dst string, type string")
