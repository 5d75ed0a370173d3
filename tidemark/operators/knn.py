"""Exact nearest neighbours by squared distance, a set of queries against all rows in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, EVERY, MOST_QUERIES = 5, 50, 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, vec_id, d2, rank) of the k nearest other rows.

    Queries come in blocks of MOST_QUERIES, each sent to all partitions (a bounded size); a partition
    answers with its k best a query, so what is shuffled is k rows a query and partition.
    """
    ids = queries.select(F.col("vec_id").alias("query_id"), "embedding").orderBy("query_id")
    out = None
    total = ids.count()
    for lo in range(0, max(total, 1), MOST_QUERIES):
        block = ids.offset(lo).limit(MOST_QUERIES).toPandas()
        names = block.query_id.to_numpy()
        q = np.array([np.asarray(v, float) for v in block.embedding]).reshape(len(block), -1)

        def best(batches, names=names, q=q):
            kept = pd.DataFrame({"query_id": [], "vec_id": [], "d2": []})
            for pdf in batches:
                if not len(pdf) or not len(names):
                    continue
                x = np.array([np.asarray(v, float) for v in pdf.embedding])
                d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(2) if len(pdf) * len(names) < 100_000 else (q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :]
                rows = pd.DataFrame({"query_id": np.repeat(names, len(pdf)), "vec_id": np.tile(pdf.vec_id.to_numpy(), len(names)), "d2": d.ravel()})
                kept = pd.concat([kept, rows[rows.query_id != rows.vec_id]]).sort_values(["query_id", "d2", "vec_id"]).groupby("query_id").head(k)
            yield kept.astype({"query_id": "int64", "vec_id": "int64"})

        part = vectors.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, d2 double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("d2", 9), "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(v, v.filter(F.col("vec_id") % EVERY == 0)).select("query_id", "vec_id", F.round("d2", 6).alias("d2"), "rank")


SQL = f"""SELECT query_id, vec_id, round(d2, 6) AS d2, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {K}"""
