"""Exact top-k search by columnar branch and bound.

Vectors lie in blocks in vertical layout: a row a dimension. For each query, inner products with a block of
candidates accumulate dimension block by dimension block, those with most of the query's mass first. What the
remaining dimensions can still add is bounded by the product of both sides' remaining mass (norms); after each
step candidates that can't reach the query's k-th best lower bound any more are compacted away, for that query
alone. The k-th best of the candidate blocks before is the bound that a query begins the next one with. The
rest get exact scores.

The stated queries meet all candidates in a grid of blocks whose cells grow with the number of pairs of blocks;
each pair gives at most k candidates a query, and these are merged in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import materialize

#: Results of a query; queries are rows whose id is divisible by EVERY; components become floor(SCALE * x).
TOP, EVERY, SCALE = 20, 20, 64
#: Vectors of a candidate block, and of a query block.
CANDIDATES, QUERIES = 4096, 1024
#: Least rows and columns of the grid of pairs of blocks, and blocks that a cell has of either side beyond that.
GRID, CELL = 24, 8
#: Dimensions accumulated between two compactions.
STEP = 16
#: Queries whose steps are one product, while this share of their candidates is left.
TOGETHER, MANY = 64, 0.2
#: Scores up to these are exact as float64 and float32, with room for the rounding of bounds beside them.
EXACT, EXACT_SINGLE = 1 << 51, 1 << 22


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def put(dims: int, rows: list) -> pa.RecordBatch:
            ids, keys = (np.array([r[k] for r in rows], np.int64) for k in (0, 2))
            data = np.stack([r[1] for r in rows], axis=1)  # vertical: a row a dimension
            if np.abs(data).max(initial=0) < 1 << 15:
                data = data.astype(np.int16)
            columns = [pa.array([dims], pa.int32()), pa.array([len(rows)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, keys, data))]
            return pa.RecordBatch.from_arrays(columns, ["dims", "n", "ids", "keys", "data"])

        for batch in batches:
            for vec_id, vector, key in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), batch.column("key").to_pylist(), strict=True):
                value = np.floor(SCALE * np.asarray(vector.values.to_numpy(zero_copy_only=False), np.float64))
                rows = held.setdefault(len(value), [])
                rows.append((vec_id, value, key))
                if len(rows) == size:
                    yield put(len(value), held.pop(len(value)))
        for dims, rows in held.items():
            yield put(dims, rows)

    return run


def best(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, top: int = TOP, step: int = STEP, floors: np.ndarray | None = None, reached: list[int] | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the best top candidates of each query (vertical q and c): all of its winners, ties to smaller ids.

    floors: scores that the queries' winners reach at least; they are raised to what is found. reached gets how
    many candidates of each query are left at the last block of dimensions.
    """
    dims = len(q)
    limit = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dims)
    if limit >= EXACT:  # beyond exact floats: integers of any size
        wide = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape), np.array([[int(x) for x in row] for row in c], object).reshape(c.shape)
        full = wide[0].T.dot(wide[1]) if dims else np.zeros((q.shape[1], c.shape[1]), object)
        for i, query in enumerate(q_ids):
            order = sorted((j for j in range(len(c_ids)) if c_ids[j] != query), key=lambda j: (-full[i, j], c_ids[j]))[:top]
            yield int(query), c_ids[order], full[i, order]
        return
    # Sums of squares decide too, so single precision serves where all of these are exact.
    largest = max(float(np.abs(x).max(initial=0)) for x in (q, c))
    kind, loose = (np.float32, 1e-5) if largest * largest * max(1, dims) < EXACT_SINGLE else (np.float64, 1e-9)
    q, c = q.astype(kind), c.astype(kind)
    square = np.square(c)
    for first in range(0, len(q_ids), TOGETHER):
        ids, own = q_ids[first : first + TOGETHER], q[:, first : first + TOGETHER].T
        order = np.argsort(-np.abs(own), axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        bound = np.full(len(ids), -np.inf) if floors is None else floors[first : first + TOGETHER].astype(np.float64)
        fresh = np.flatnonzero(bound == -np.inf)
        alive, partial, at = c_ids != ids[:, None], np.zeros((len(ids), c.shape[1]), kind), 0
        # While many are left, each step is a product for all queries of the group, in which each has its own dimensions.
        while at < dims and (not at or np.count_nonzero(alive) >= alive.size * MANY):
            if at + step >= dims and reached is not None:
                reached.extend(np.count_nonzero(alive, axis=1).tolist())
            partial += np.where((place >= at) & (place < at + step), own, 0) @ c
            at += step
            if at >= dims:
                break
            later = place >= at
            slack = np.sqrt(later.astype(kind) @ square)
            slack *= (np.sqrt((np.square(own, dtype=np.float64) * later).sum(axis=1)) * (1 + loose)).astype(kind)[:, None]
            slack += kind(0.01)
            if alive.shape[1] > top and len(fresh):
                low = np.where(alive[fresh], partial[fresh] - slack[fresh], -np.inf)
                bound[fresh] = np.maximum(bound[fresh], np.partition(low, low.shape[1] - top, axis=1)[:, low.shape[1] - top])
            slack += partial
            alive &= slack >= (bound - 1).astype(kind)[:, None]
        for i in range(len(ids)):
            left = np.flatnonzero(alive[i])
            found = _finish(own[i], order[i], at, left, partial[i, left], c, square, top, step, bound[i], loose, reached)
            near, scores = c_ids[found[0]], found[1].astype(np.int64)
            if len(scores) > top:
                # All that tie with the last place compete by id.
                kept = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
                near, scores = near[kept], scores[kept]
            rank = np.lexsort((near, -scores))[:top]
            if floors is not None and len(rank) == top:
                floors[first + i] = max(floors[first + i], scores[rank[-1]])
            yield int(ids[i]), near[rank], scores[rank]


def _finish(
    own: np.ndarray, order: np.ndarray, at: int, alive: np.ndarray, partial: np.ndarray, c: np.ndarray, square: np.ndarray, top: int, step: int, bound: float, loose: float, reached: list[int] | None
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of one query's candidates that no bound excludes, from dimension at of its order on."""
    dims = len(order)
    while at < dims:
        if at + step >= dims and reached is not None:
            reached.append(len(alive))
        block, later = order[at : at + step], order[at + step :]
        partial = partial + own[block] @ c[np.ix_(block, alive)]
        at += step
        if at >= dims:
            break
        slack = np.sqrt(square[np.ix_(later, alive)].sum(axis=0)) * own.dtype.type(np.sqrt(np.square(own[later], dtype=np.float64).sum()) * (1 + loose)) + own.dtype.type(0.01)
        if len(alive) > top:
            bound = max(bound, np.partition(partial - slack, len(alive) - top)[len(alive) - top])
        kept = np.flatnonzero(partial + slack >= bound - 1)
        alive, partial = alive[kept], partial[kept]
    return alive, partial


def _unpack(data: bytes, dims: int, n: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * dims * n else np.float64
    return np.frombuffer(data, kind).reshape(dims, n).astype(np.float64)


def _search(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}  # of the cells' blocks of queries, what their winners reach at least
        for batch in batches:
            for pair in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                dims = pair["dims"]
                q, c = (_unpack(pair[f"{x}_data"], dims, pair[f"{x}_n"]) for x in "qc")
                q_ids, c_ids = (np.frombuffer(pair[f"{x}_ids"], np.int64) for x in "qc")
                keys = np.frombuffer(pair["q_keys"], np.int64).tolist()
                known = floors.setdefault(pair["q_keys"], np.full(len(q_ids), -np.inf))
                found = list(best(q_ids, q, c_ids, c, top, floors=known))
                if found:
                    sizes = [len(f[1]) for f in found]
                    columns = [
                        pa.array(np.repeat(keys, sizes), pa.int64()),
                        pa.array(np.repeat([f[0] for f in found], sizes), pa.int64()),
                        pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)),
                        pa.array(np.concatenate([f[2] for f in found]), pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, top: int = TOP, candidate_block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the top candidates of each query by inner product of floor(64 x), ties to smaller ids.

    A candidate of the query's id isn't its candidate. Rows with null ids, null vectors, or vectors with null or
    non-finite components take no part; a query meets candidates of its own length only. Repeated rows compete
    each for itself, and each row of a repeated query id has a ranking of its own, top results a row. Scores beyond a
    long raise. Other columns are ignored.
    """
    def clean(df: DataFrame) -> DataFrame:
        vector = F.col("embedding").cast("array<double>")
        fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.where("vec_id is not null and embedding is not null").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"), F.monotonically_increasing_id().alias("key"))

    packed = "dims int, n int, ids binary, keys binary, data binary"
    blocks = materialize(clean(vectors).mapInArrow(_pack(candidate_block), packed), "candidates")
    wanted = materialize(clean(queries).mapInArrow(_pack(query_block), packed), "queries")
    wanted = wanted.select("dims", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("data").alias("q_data"))
    # A grid: each block of queries lies in one row of cells and each block of candidates in one column, so each pair meets once.
    rows, columns = (min(n, max(GRID, n // CELL)) for n in (max(1, wanted.count()), max(1, blocks.count())))
    side = lambda own, n: (F.pmod(F.xxhash64(own, "dims"), F.lit(n))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wanted = wanted.withColumn("row", side("q_keys", rows)).withColumn("column", every(columns))
    blocks = blocks.select("dims", F.col("n").alias("c_n"), F.col("ids").alias("c_ids"), F.col("data").alias("c_data"))
    blocks = blocks.withColumn("column", side("c_ids", columns)).withColumn("row", every(rows))
    pairs = wanted.join(blocks, ["dims", "row", "column"])
    return _merge(pairs.mapInArrow(_search(top), "key long, query_id long, vec_id long, score long"), top)


def _merge(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_OP8 = """
WITH v AS (SELECT row_number() OVER () AS key, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.key, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
