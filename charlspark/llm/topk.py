"""Operator 4: exact top-k inner products with block-at-a-time pruning.

Vectors play documents and components play terms. Candidates are sorted by nearest pivot (a bounded sample of PIVOTS
vectors, which only decides the order) and cut into blocks; a block keeps its forward index (ids and the matrix of its
components) and the largest and smallest component of each dimension. A query's bound for a block is the sum over
dimensions of its component times the largest (or, for negative ones, smallest) component. In each tile, a batch of queries
against a group of blocks, every query takes its blocks by descending bound, scores them whole through the forward
index, and stops once its bound falls below its k-th score. The tiles' lists merge by query.

Queries and blocks are dealt to tiles by (batch, group), so a task holds one batch and one group, both of bounded
size; a stated query set against all rows is met in blocks. No query or candidate is skipped unless its bound proves it.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; of
vectors of different length the shorter counts as filled with zeros; ties go to the smaller id; rows that repeat an id are
candidates each, but never for a query of that id; fewer than k candidates give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlspark.llm.common import cut, parts_for

PIVOTS = 128
BLOCK_ROWS = 256
GROUP_BLOCKS = 64
BATCH = 512


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """key and floor(scale * x) of each component, for vectors that take part."""
    sound = F.forall(f"`{vector}`", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    used = vectors.filter(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & sound)
    return used.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(f"`{vector}`", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column, filled with zeros to one width."""
    lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
    width = max(width, int(lengths.max(initial=0)))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def blocks_of(rows: DataFrame, pivots: np.ndarray, n_rows: int) -> DataFrame:
    """id, q -> part, n, width, ids, rows (int64 bytes): runs of at most n_rows vectors with the same or a near pivot."""
    schema = "part long, n int, width int, ids binary, rows binary"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1))
            w = min(m.shape[1], pivots.shape[1])
            p = m[:, :w].astype(float) @ pivots[:, :w].T.astype(float) if len(pivots) else np.zeros((len(m), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p.argmax(1).astype(np.int32)) if len(m) else pa.array([], pa.int32())], names=["id", "q", "pivot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, n_rows):
                run = b.slice(at, n_rows)
                m = matrix(run.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), pa.array([len(m)], pa.int32()), pa.array([m.shape[1]], pa.int32()), pa.array([np.asarray(run.column(0), np.int64).tobytes()]), pa.array([m.tobytes()])], names=["part", "n", "width", "ids", "rows"])
                k += 1

    placed = rows.mapInArrow(assign, "id long, q array<long>, pivot int")
    n_parts = parts_for(rows, 16, least=4)
    return placed.repartitionByRange(n_parts, "pivot", "id").sortWithinPartitions("pivot", "id").select("id", "q").mapInArrow(pack, schema)


def unpack(table: pa.Table, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of each row, filled to width."""
    out = []
    for n, w, ids, rows in zip(*(table.column(c).to_pylist() for c in ("n", "width", "ids", "rows"))):
        m = np.zeros((n, width), np.int64)
        m[:, :w] = np.frombuffer(rows, np.int64).reshape(n, w)
        out.append((np.frombuffer(ids, np.int64), m))
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where every sum fits 2**53, else by integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if top < 2**53 else a @ b.T


def search(queries: list, blocks: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k best of these blocks: query ids, ids, scores."""
    q_ids = np.concatenate([ids for ids, _ in queries])
    q = np.concatenate([m for _, m in queries])
    high, low = np.stack([m.max(0) for _, m in blocks]), np.stack([m.min(0) for _, m in blocks])
    bound = scores(np.maximum(q, 0), high) + scores(np.minimum(q, 0), low)
    order = np.argsort(-bound, axis=1, kind="stable")
    low_score, no_id = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max
    best = np.full((len(q), k), low_score)
    best_id = np.full((len(q), k), no_id)
    live = np.arange(len(q))
    for turn in range(len(blocks)):
        block = order[live, turn]
        going = bound[live, block] >= best[live, -1]  # an equal bound may still hold a smaller id
        live, block = live[going], block[going]
        if not len(live):
            break
        for one in np.unique(block):
            mine = live[block == one]
            ids, m = blocks[one]
            s = scores(q[mine], m)
            s[q_ids[mine][:, None] == ids[None, :]] = low_score
            all_s = np.concatenate([best[mine], s], 1)
            all_id = np.concatenate([best_id[mine], np.broadcast_to(ids, s.shape)], 1)
            all_id[all_s == low_score] = no_id
            top = np.lexsort((all_id, -all_s), axis=1)[:, :k]
            best[mine], best_id[mine] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_id, top, 1)
    found = best_id != no_id
    return np.repeat(q_ids, found.sum(1)), best_id[found], best[found]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """vectors, queries: id, q (as of integers()). Returns query_id, rank (from 1), vec_id, score."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    width = max((len(r.q) for r in sample), default=0)
    pivots = np.array([[*r.q, *[0] * (width - len(r.q))] for r in sample], np.int64).reshape(len(sample), width)
    blocks, batches = cut(blocks_of(vectors, pivots, BLOCK_ROWS)), cut(blocks_of(queries, pivots, BATCH))
    n_blocks, n_queries = blocks.count(), batches.agg(F.sum("n")).first()[0] or 0
    groups, turns = max(1, math.ceil(n_blocks / GROUP_BLOCKS)), max(1, math.ceil(n_queries / BATCH))
    right = blocks.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    left = batches.withColumn("t", F.pmod(F.xxhash64("part"), F.lit(turns)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        w = max(*a.column("width").to_pylist(), *b.column("width").to_pylist())
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, search(unpack(a, w), unpack(b, w), k)))))

    hits = left.groupBy("t", "g").cogroup(right.groupBy("t", "g")).applyInArrow(tile, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
