"""Exact top-k by inner product over a pivot-distance index.

Components become integers floor(1024 * x). Every vector is keyed by its nearest pivot and its distance to it;
the vectors of one pivot whose distances fall in one ring are stored in blocks of bounded size that know the
ring's inner and outer radius and the longest vector. For a query q at distance d from the pivot, every x of a
block obeys |q - x| >= gap, the distance from d to the ring (triangle inequality), so its score is at most
(|q|^2 + max|x|^2 - gap^2) / 2. Queries first search the rings of their own pivot, which gives a k-th best
score; after that every block whose bound falls below it is left unread for that query, and blocks are taken
best bound first so that the k-th best score rises quickly.

Pivots are at most `pivots` vectors, those with the smallest hashes of vec_id: a bounded sample that only sets
how well blocks are told apart. All vectors are indexed, and results are exact for any pivots. Queries go in
waves of about `wave` queries, which bounds what a task holds of them; the index is built once, in the shared
folder.

Vectors that are null or empty, hold a null or non-finite component, or have a null vec_id take no part.
Vectors of different lengths have no score with each other. Rows with the query's own vec_id are its own;
otherwise repeated rows all count, ties going to the smaller vec_id. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from kickstand.llm import common

SCALE = 1024
PIVOTS = 128
RINGS = 32
BLOCK_ROWS = 2048
WAVE = 4096
KEYED = "vec_id long, dim int, pivot int, distance double, vector binary"
BLOCK = "dim int, pivot int, n int, inner_radius double, outer_radius double, norm2 double, ids binary, vectors binary"
FOUND = "query int, vec_id long, score long"
#: Largest score times block size that doubles hold exactly.
EXACT = 1 << 53


def integer_vectors(vectors, vec_id="vec_id", embedding="embedding"):
    """vec_id and v (array<long>) of the rows that take part."""
    x = F.col(embedding)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    held = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    return held.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def choose_pivots(integers, pivots=PIVOTS):
    """Pivots by vector length, as matrices; a length without any has the origin."""
    sample = integers.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    by_dim = {}
    for row in sample:
        by_dim.setdefault(len(row["v"]), set()).add(tuple(row["v"]))
    return {dim: np.array(sorted(held), np.float64) for dim, held in by_dim.items()}


def _pivots_of(pivots, dim):
    return pivots.get(dim, np.zeros((1, dim)))


def _distances(x, centres):
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def _keyed(pivots):
    def run(batches):
        for batch in batches:
            column = batch["v"]
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            ids = batch["vec_id"].to_numpy()
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = flat[ends[at][:, None] + np.arange(dim)].astype("<i8")
                far = _distances(x.astype(np.float64), _pivots_of(pivots, int(dim)))
                near = far.argmin(1)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": pa.array(ids[at], pa.int64()),
                        "dim": pa.array(np.full(len(at), dim), pa.int32()),
                        "pivot": pa.array(near, pa.int32()),
                        "distance": pa.array(far[np.arange(len(at)), near], pa.float64()),
                        "vector": pa.array([row.tobytes() for row in x], pa.binary()),
                    }
                )

    return run


def _to_block(key, table):
    dim, pivot = key[0].as_py(), key[1].as_py()
    ids = table["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x = np.frombuffer(b"".join(table["vector"].to_pylist()), "<i8").reshape(-1, dim)[order]
    far = table["distance"].to_numpy()
    norm2 = (x.astype(np.float64) ** 2).sum(1).max()
    row = [dim, pivot, len(ids), far.min(), far.max(), norm2, ids[order].astype("<i8").tobytes(), x.tobytes()]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
    names = ("dim", "pivot", "n", "inner_radius", "outer_radius", "norm2", "ids", "vectors")
    return pa.table({n: pa.array([v], t) for n, v, t in zip(names, row, kinds, strict=True)})


def build_index(integers, pivots, rings=RINGS, block_rows=BLOCK_ROWS):
    """Blocks of all vectors, written to the shared folder."""
    keyed = common.written(integers.mapInArrow(_keyed(pivots), KEYED), "pivot-keys")
    # ring limits divide each pivot's range of distances evenly
    limits = keyed.groupBy("dim", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    # one row per pivot and length: bounded by the number of pivots
    ringed = keyed.join(F.broadcast(limits), ["dim", "pivot"])
    part = (F.col("distance") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    ringed = ringed.withColumn("ring", F.least(F.floor(F.coalesce(part, F.lit(0.0)) * rings), F.lit(rings - 1)).cast("int"))
    sizes = ringed.groupBy("dim", "pivot", "ring").agg(F.count(F.lit(1)).alias("rows"))
    # a ring of many equal distances is dealt out by vec_id; sizes has at most `rings` rows per pivot
    dealt = ringed.join(F.broadcast(sizes), ["dim", "pivot", "ring"]).withColumn("deal", F.pmod(F.xxhash64("vec_id", "vector"), F.ceil(F.col("rows") / block_rows)))
    blocks = dealt.groupBy("dim", "pivot", "ring", "deal").applyInArrow(_to_block, BLOCK)
    return common.written(blocks, "pivot-index")


class Best:
    """The k best (score, vec_id) seen per query."""

    def __init__(self, n, k):
        self.k, self.found = k, [[] for _ in range(n)]

    def add(self, query, ids, scores):
        held = self.found[query] + list(zip((-scores).tolist(), ids.tolist(), strict=True))
        held.sort()
        self.found[query] = held[: self.k]
        return -held[self.k - 1][0] if len(held) >= self.k else None


def _best_of_block(scores, own, k):
    """Columns of the k best scores of one query in a block whose rows ascend by vec_id; own: rows to leave out."""
    at = np.flatnonzero(~own)
    if len(at) > k:
        s = scores[at]
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = at[s > least]
        at = np.concatenate([above, at[s == least][: k - len(above)]])
    return at


def _scores(queries, x, large):
    if large:
        return queries.astype(np.int64) @ x
    return (queries.astype(np.float64) @ x.astype(np.float64)).astype(np.int64)


def _search(wave, pivots, k, floor):
    """Search blocks for a wave of queries. floor: k-th best score known per query, or None to search only the
    blocks of each query's own pivot."""

    def run(batches):
        vectors = {dim: np.array([v for v in wave["v"] if len(v) == dim], np.int64).reshape(-1, dim) for dim in {len(v) for v in wave["v"]}}
        numbers = {dim: np.array([i for i, v in enumerate(wave["v"]) if len(v) == dim]) for dim in vectors}
        far = {dim: _distances(q.astype(np.float64), _pivots_of(pivots, dim)) for dim, q in vectors.items()}
        square = {dim: (q.astype(np.float64) ** 2).sum(1) for dim, q in vectors.items()}
        ids = np.array(wave["vec_id"], np.int64)
        tau = np.full(len(ids), -np.inf) if floor is None else np.array(floor, np.float64)
        best = Best(len(ids), k)
        for batch in batches:
            for block in _by_promise(batch.to_pylist(), far):
                dim = block["dim"]
                if dim not in vectors:
                    continue
                d = far[dim][:, block["pivot"]]
                gap = np.maximum(0, np.maximum(d - block["outer_radius"], block["inner_radius"] - d))
                bound = (square[dim] + block["norm2"] - gap**2) / 2
                # distances are rounded: a hair above the bound is no proof
                at = np.flatnonzero(bound + 1 + 1e-9 * (square[dim] + block["norm2"]) >= tau[numbers[dim]])
                if floor is None:
                    at = at[far[dim][at].argmin(1) == block["pivot"]]
                if not len(at):
                    continue
                x = np.frombuffer(block["vectors"], "<i8").reshape(-1, dim)
                block_ids = np.frombuffer(block["ids"], "<i8")
                large = float(np.abs(vectors[dim][at]).max()) * float(np.abs(x).max()) * dim >= EXACT
                scores = _scores(vectors[dim][at], x.T, large)
                for q, s in zip(numbers[dim][at], scores, strict=True):
                    held = _best_of_block(s, block_ids == ids[q], k)
                    held = held[s[held] >= tau[q]]
                    if len(held):
                        kth = best.add(q, block_ids[held], s[held])
                        if kth is not None and kth > tau[q]:
                            tau[q] = kth
        rows = [(q, i, -s) for q, held in enumerate(best.found) for s, i in held]
        if rows:
            yield pa.RecordBatch.from_pydict({"query": pa.array([r[0] for r in rows], pa.int32()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


def _by_promise(blocks, far):
    """Blocks by how near their ring comes to the nearest query."""

    def gap(block):
        if block["dim"] not in far:
            return 0.0
        d = far[block["dim"]][:, block["pivot"]]
        return float(np.maximum(0, np.maximum(d - block["outer_radius"], block["inner_radius"] - d)).min())

    return sorted(blocks, key=gap)


def _top(found, k):
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors, is_query, k=10, pivots=PIVOTS, wave=WAVE, rings=RINGS, block_rows=BLOCK_ROWS):
    """query_id, rank, vec_id and score of the k best of each row that `is_query` (a condition on vec_id) picks."""
    spark = vectors.sparkSession
    integers = integer_vectors(vectors)
    centres = choose_pivots(integers, pivots)
    index = build_index(integers, centres, rings, block_rows)
    # few large rows: one task per block would be all overhead, one task for many would hold too much
    asked = common.written(integers.where(is_query), "pivot-queries")
    n_waves = common.pieces_for(asked.count(), wave)
    path = common.new_path(spark, "pivot-results")
    for number in range(n_waves):
        part = asked.where(F.pmod(F.xxhash64(F.lit(8), "vec_id"), F.lit(n_waves)) == number).orderBy("vec_id", "v").toPandas()
        held = {"vec_id": part["vec_id"].tolist(), "v": [np.asarray(v) for v in part["v"]]}
        near = _top(index.mapInArrow(_search(held, centres, k, None), FOUND), k)
        floors = [-np.inf] * len(held["v"])
        for row in near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).collect():
            if row["n"] >= k:
                floors[row["query"]] = row["least"]
        # at most one wave of pairs of numbers
        names = spark.createDataFrame(list(enumerate(held["vec_id"])), "number int, query_id long")
        best = _top(index.mapInArrow(_search(held, centres, k, floors), FOUND), k)
        best = best.join(F.broadcast(names), F.col("query") == F.col("number"))
        best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


#: The query's rows in DuckDB SQL: all pairs.
SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
