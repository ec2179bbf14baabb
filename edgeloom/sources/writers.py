"""Sinks: edge lists, matrices, maps, folds and tagged files. Every sink is a Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edges import dense_incidence


def write_edges(edges: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    edges.write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def write_matrix(edges: DataFrame, rows: DataFrame, columns, path: str) -> None:
    """0/1 matrix as space-separated text without header, rows sorted by id."""
    wide = dense_incidence(edges, rows, columns).orderBy("id")
    wide.select(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in columns])).write.mode("overwrite").text(path)


def write_map(idmap: DataFrame, path: str) -> None:
    """One JSON object per entry."""
    idmap.select("k", "v").write.mode("overwrite").json(path)


def write_folds(folds: DataFrame, path: str) -> None:
    """One folder per seed and fold."""
    folds.write.mode("overwrite").partitionBy("seed", "fold").parquet(path)


def write_tagged(rows: DataFrame, path: str, tag: str = "tag") -> None:
    """One folder per tag (see ``split_by_source``)."""
    rows.write.mode("overwrite").partitionBy(tag).option("sep", "\t").csv(path)
