"""Connected components of a link table, by large-star and small-star rounds; few links are joined by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.common import map_batches, remove_folder, shared_folder

FEW_LINKS = 500_000  # 8 MB


def join_links(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links with the least id of its component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return ids, ids[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _joined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cols = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for part in parts:
        for k in range(2):
            cols[k].append(part.column(k).to_numpy(zero_copy_only=False))
    found = join_links(*map(np.concatenate, cols))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "component"])


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(id, component): every id that occurs in ``links`` (u, v) with the least id of its component.

    Up to ``few`` links are one task's work. For more, each round joins a row for each link with the least neighbour of its end;
    no list of neighbours is gathered. Rounds are written to the shared folder.
    """
    spark = links.sparkSession
    schema = "u bigint, v bigint"
    between = links.where("u <> v").selectExpr("cast(u as bigint) u", "cast(v as bigint) v")
    if between.count() <= few:
        return map_batches(between.repartition(1), _joined, "id bigint, component bigint")

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_folder(spark, "links")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    edges, path = put(between.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        # large star: every larger neighbour of u gets u's least neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: all smaller neighbours of u, and u, get the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = put(small)
        now = _state(after)
        remove_folder(spark, path)
        edges, path = after, after_path
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
