"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is taken relative to the centre, rotated by a fixed random rotation and kept as its sign bits with
two scalars: its distance to the centre and the inner product of its direction with its code. From these the
inner product of a query's direction with the vector's is estimated, with an error bound that shrinks with the
number of dimensions. A vector is reranked (its exact distance computed) only if its least possible distance is
no larger than the k-th exact distance known so far.

The index is a table of blocks of packed vectors; queries are cut into blocks as well and visit every data
block. A pair of blocks gives at most k rows per query, so no group grows with the data; the k best of all blocks
follow from partial lists.

Results for odd input: vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part; ties go to the smaller id; repeated ids are separate candidates, except that a query never meets
rows of its own id; a query id that repeats is asked once, with its smallest vector; with fewer than k candidates all are returned; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.frames import map_columns, pick

K = 10
DATA_BLOCK = 4_096
QUERY_BLOCK = 256
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 3.0
SEED = 7


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed sign bits, distance to the centre, inner product of direction and code) of each row."""
    offset = vectors - centre
    norm = np.sqrt((offset * offset).sum(axis=1))
    direction = (offset / np.where(norm > 0, norm, 1)[:, None]) @ turn
    sign = direction > 0
    agree = np.abs(direction).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(sign, axis=1), norm, np.where(agree > 0, agree, 1.0)


def search_block(
    vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, agree: np.ndarray,
    queries: np.ndarray, query_ids: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int = K,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k nearest of a block for each query, as (query id, id, distance), and how many vectors were reranked."""
    dim = vectors.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    offset = queries - centre
    q_norm = np.sqrt((offset * offset).sum(axis=1))
    q_dir = (offset / np.where(q_norm > 0, q_norm, 1)[:, None]) @ turn
    inner = (q_dir.astype(np.float32) @ signs.T) / np.float32(np.sqrt(dim))
    estimate = inner / agree
    slack = WIDTH * np.sqrt(np.clip(1 - agree**2, 0, None) / (agree**2 * max(1, dim - 1)))
    base = norms**2 + q_norm[:, None] ** 2
    scale = 2 * norms * q_norm[:, None]
    near = base - scale * estimate
    least = base - scale * (estimate + slack)
    out_q, out_v, out_d, reranked = [], [], [], 0

    def exact(rows: np.ndarray, q: int) -> np.ndarray:
        diff = vectors[rows] - queries[q]
        return np.sqrt((diff * diff).sum(axis=1))

    for q in range(len(queries)):
        own = np.flatnonzero(ids != query_ids[q])
        if not len(own):
            continue
        first = own if len(own) <= k else own[np.argpartition(near[q][own], k - 1)[:k]]
        limit = exact(first, q).max() if len(first) == k else np.inf
        rows = own[least[q][own] <= limit * limit * (1 + 1e-6) + 1e-9]
        rows = np.union1d(rows, first)
        reranked += len(rows)
        distance = exact(rows, q)
        best = np.lexsort((ids[rows], distance))[:k]
        out_q.append(np.full(len(best), query_ids[q]))
        out_v.append(ids[rows][best])
        out_d.append(distance[best])
    if not out_q:
        return np.array([], np.int64), np.array([], np.int64), np.array([], float), 0
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_d), reranked


def _valid(vec: str, dim: int) -> Column:
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def _pack(dim: int, centre: np.ndarray | None, block: str):
    """Blocks of rows as single rows; codes and scalars are added where a centre is given."""
    turn = rotation(dim)

    def run(columns: list) -> Iterator[tuple[list, ...]]:
        ids = columns[0].to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = columns[1].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        size = DATA_BLOCK if block == "data" else QUERY_BLOCK
        for at in range(0, len(ids), size):
            part = vectors[at : at + size]
            row = [[ids[at : at + size].tobytes()], [part.tobytes()]]
            if block == "data":
                codes, norm, agree = encode(part, centre, turn)
                row += [[codes.tobytes()], [norm.tobytes()], [agree.tobytes()]]
            yield tuple(row)

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, *, key: str = "vec_id", vec: str = "embedding", k: int = K, dim: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors of every query row.

    ``dim`` is the length of a vector; left out, the most frequent length is taken. The centre is the mean of all vectors.
    """
    doubles = T.ArrayType(T.DoubleType())
    rows = pick(vectors, id=key, v=vec).select(F.col("id").cast("long"), F.col("v").cast(doubles)).where("id is not null")
    asked = pick(queries, id=key, v=vec).select(F.col("id").cast("long"), F.col("v").cast(doubles)).where("id is not null")
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    spark = rows.sparkSession
    if dim is None:
        sizes = rows.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        dim = sizes[0]["d"] if sizes else 0
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.where(_valid("v", dim)), asked.where(_valid("v", dim))
    means = rows.agg(F.count("*").alias("n"), *(F.avg(F.col("v")[i]).alias(f"c{i}") for i in range(dim))).first()
    if not means["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centre = np.array([means[f"c{i}"] for i in range(dim)])
    turn = rotation(dim)

    # stripes: data blocks stay where they are dealt, query blocks are copied to every stripe
    stripes = max(1, -(-means["n"] // (4 * DATA_BLOCK)))
    data = map_columns(rows, _pack(dim, centre, "data"), "ids binary, vecs binary, codes binary, norms binary, agree binary")
    data = data.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)))
    blocks = map_columns(asked, _pack(dim, None, "query"), "q_ids binary, q_vecs binary")
    blocks = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)).cast("array<long>")))
    met = data.join(blocks, "stripe")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind, row=row, batch=batch: np.frombuffer(batch.column(name)[row].as_py(), kind)
                ids, norms = get("ids", np.int64), get("norms", np.float64)
                q, v, d, _ = search_block(
                    get("vecs", np.float64).reshape(-1, dim), ids, get("codes", np.uint8).reshape(len(ids), -1), norms,
                    get("agree", np.float64), get("q_vecs", np.float64).reshape(-1, dim), get("q_ids", np.int64), centre, turn, k,
                )
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": q, "vec_id": v, "score": d}), preserve_index=False)

    found = met.select("ids", "vecs", "codes", "norms", "agree", "q_ids", "q_vecs").mapInArrow(visit, "query_id long, vec_id long, score double")
    # at most k rows per data block and query; the rank limit is applied before the shuffle as well
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op7_nearest_vectors": nearest_vectors}
