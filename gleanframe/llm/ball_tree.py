"""Exact top-k by inner product: a ball tree for each shard, searched by branch and bound.

Components are scaled and rounded down, so scores are integers and exact. A node is a ball (centre
and radius) around its rows: no row's product with a query q exceeds ``q . centre + |q| * radius``.
A query goes to the child of the larger bound first and leaves out every node whose bound is below
its current k-th score. Queries are handled many at a time: at a node they part into those that
prefer the one child and those that prefer the other, until few are left together. The k-th score
is shared between shards: what a query has after its first shards goes with it to all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gleanframe.llm.sharded import shards_for, two_rounds, written

#: Rows in a leaf; queries that are no longer parted; queries searched at a time.
LEAF, TOGETHER, CHUNK = 256, 32, 1024
#: A shard holds at most so many components, and no fewer rows than this if there are enough for all cores.
SHARD_CELLS, SHARD_ROWS = 1 << 22, 1024
LONG = np.iinfo(np.int64)


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The cheapest number type in which all products of rows of ``a`` with rows of ``b`` are exact.

    Every partial sum of a product is at most |a| |b|.
    """
    longest = [float(np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)).max(initial=0)) for x in (a, b)]
    reach = longest[0] * longest[1] * 1.001
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object


def products(a: np.ndarray, b: np.ndarray, kind: type) -> np.ndarray:
    """Integer inner products of rows; beyond the range of a long they stay at its ends."""
    if kind is object:
        exact = a.astype(object) @ b.astype(object).T
        return np.clip(exact, LONG.min, LONG.max).astype(np.int64) if exact.size else np.zeros(exact.shape, np.int64)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class BallTree:
    """Balls over the rows of an integer matrix; ``rows`` lists them leaf by leaf."""

    def __init__(self, matrix: np.ndarray, leaf: int = LEAF):
        self.matrix = matrix
        points = matrix.astype(np.float64)
        self.rows = np.arange(len(matrix))
        self.spans, self.left, self.right, centres, radii = [], [], [], [], []

        def ball(a: int, b: int) -> int:
            own = points[self.rows[a:b]]
            centre = own.mean(axis=0)
            self.spans.append((a, b))
            self.left.append(-1)
            self.right.append(-1)
            centres.append(centre)
            radii.append(float(np.sqrt(np.square(own - centre).sum(axis=1)).max()))
            return len(radii) - 1

        waiting = [ball(0, len(matrix))]
        while waiting:
            node = waiting.pop()
            a, b = self.spans[node]
            if b - a <= leaf:
                continue
            own = points[self.rows[a:b]]
            # along the line between two far rows, cut in the middle
            far = own[np.square(own - centres[node]).sum(axis=1).argmax()]
            other = own[np.square(own - far).sum(axis=1).argmax()]
            half = (b - a) // 2
            self.rows[a:b] = self.rows[a:b][np.argpartition(own @ (far - other), half)]
            self.left[node] = ball(a, a + half)
            self.right[node] = ball(a + half, b)
            waiting += [self.left[node], self.right[node]]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.leaves = {i: (self.rows[a:b], matrix[self.rows[a:b]]) for i, (a, b) in enumerate(self.spans) if self.left[i] < 0}

    def search(self, queries: np.ndarray, skip: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, score) of each query's ``k`` best rows that reach its floor, ties to the smaller row.

        ``skip`` has the row each query must not meet (-1: none). Also gives the number of scores taken.
        """
        kind = exact_kind(queries, self.matrix)
        asked = queries.astype(np.float64)
        lengths = np.sqrt(np.square(asked).sum(axis=1))
        reach = lengths[:, None] * (self.radii + np.sqrt(np.square(self.centres).sum(axis=1)))[None, :]
        bounds = asked @ self.centres.T + lengths[:, None] * self.radii[None, :] + 1e-9 * reach + 1e-6
        scores = np.full((len(queries), k), LONG.min)
        rows = np.full((len(queries), k), -1)
        kth = floors.copy()
        taken = 0

        def look(node: int, who: np.ndarray) -> None:
            nonlocal taken
            own, vectors = self.leaves[node]
            got = products(queries[who], vectors, kind)
            taken += got.size
            least = kth[who]
            if got.shape[1] > 4 * k:
                # the row to skip may be among the first k
                least = np.maximum(least, np.partition(got, -(k + 1), axis=1)[:, -(k + 1)])
            q, r = np.nonzero(got >= least[:, None])
            fine = own[r] != skip[who[q]]
            q, r = q[fine], r[fine]
            if not len(q):
                return
            touched = np.unique(q)
            old = rows[who[touched]] >= 0
            all_q = np.concatenate([q, np.repeat(touched, k).reshape(-1, k)[old]])
            all_s = np.concatenate([got[q, r], scores[who[touched]][old]])
            all_r = np.concatenate([own[r], rows[who[touched]][old]])
            order = np.lexsort((all_r, ~all_s, all_q))
            all_q, all_s, all_r = all_q[order], all_s[order], all_r[order]
            place = np.arange(len(all_q)) - np.searchsorted(all_q, all_q)
            first = place < k
            at, place = who[all_q[first]], place[first]
            scores[at, place], rows[at, place] = all_s[first], all_r[first]
            full = who[touched][rows[who[touched], k - 1] >= 0]
            kth[full] = np.maximum(kth[full], scores[full, k - 1])

        def visit(node: int, who: np.ndarray) -> None:
            who = who[bounds[who, node] >= kth[who]]
            if not len(who):
                return
            if self.left[node] < 0:
                look(node, who)
                return
            one, two = self.left[node], self.right[node]
            likes_one = bounds[who, one] >= bounds[who, two]
            groups = [who[likes_one], who[~likes_one]]
            if len(who) < TOGETHER:
                groups = [who, who[:0]] if bounds[who, one].max() >= bounds[who, two].max() else [who[:0], who]
            for group, children in zip(groups, ((one, two), (two, one))):
                for child in children:
                    visit(child, group)

        if k > 0 and len(self.matrix):
            visit(0, np.arange(len(queries)))
        q, place = np.nonzero(rows >= 0)
        return q, rows[q, place], scores[q, place], taken


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows, in the smallest integers that hold them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = flat.reshape(len(column), len(flat) // max(1, len(column)))
    for kind in (np.int16, np.int32):
        if not flat.size or (flat.min() >= np.iinfo(kind).min and flat.max() <= np.iinfo(kind).max):
            return flat.astype(kind)
    return flat


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """No null vector, no null or non-finite component."""
    fine = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, ``id``, score): the ``k`` rows of the highest inner product with each query row.

    ``is_query`` says of each row whether it asks; a row never finds itself, but a repeated row finds
    its copies, as each row counts for itself. Ties go to the smaller id (nulls last). Rows whose
    vector is null or holds a null or non-finite component neither ask nor are found. Vectors meet
    only those of their own length; empty ones score 0. Scores beyond a long stay at its ends. An
    empty table, or one without queries, gives no rows; other columns of ``vectors`` play no part.
    """
    spark = vectors.sparkSession
    plain = vectors.filter(usable(F.col(vector))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), quantised(F.col(vector), scale).alias("v"),
    )
    rows = written(plain.withColumn("width", F.size("v")), "vectors")
    wanted = 2 * spark.sparkContext.defaultParallelism
    cells = F.greatest(F.col("width"), F.lit(1))
    sizes = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).select(
        "width", shards_for(F.col("n") * cells, SHARD_CELLS, SHARD_ROWS * cells, wanted).alias("shards")
    )
    # shards are numbered one after the other; a window over one row for each length of vectors
    sizes = sizes.withColumn("first", (F.sum("shards").over(W.orderBy("width")) - F.col("shards")).cast("int"))
    n_parts = sizes.agg(F.sum("shards")).first()[0] or 1
    placed = rows.join(sizes, "width")
    shards = placed.select((F.col("first") + F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")).alias("part"), "row", "id", "v")
    queries = placed.filter("asks").select("row", "id", "v", "first", (F.col("first") + F.col("shards") - 1).alias("last"), F.col("row").alias("query"))
    schema = T.StructType([
        T.StructField("query", T.LongType()), T.StructField("query_id", vectors.schema[id].dataType),
        T.StructField("row", T.LongType()), T.StructField("id", vectors.schema[id].dataType), T.StructField("score", T.LongType()),
    ])

    def build(table: pa.Table):
        # rows in the order in which ties are settled
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        numbers = table.column("row").to_numpy()
        return table.column("id").combine_chunks(), numbers, np.argsort(numbers), BallTree(matrix_of(table.column("v")))

    def search(index, batch):
        ids, numbers, by_number, tree = index
        for at in range(0, batch.num_rows, CHUNK):
            some = batch.slice(at, CHUNK)
            asking = some.column("query").to_numpy()
            place = np.minimum(np.searchsorted(numbers, asking, sorter=by_number), len(numbers) - 1)
            own = np.where(numbers[by_number[place]] == asking, by_number[place], -1)
            floors = pc.fill_null(some.column("floor"), LONG.min).to_numpy()
            q, r, score, _ = tree.search(matrix_of(some.column("v")), own, floors, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(asking[q]), some.column("id").take(pa.array(q)), pa.array(numbers[r]), ids.take(pa.array(r)), pa.array(score)],
                names=["query", "query_id", "row", "id", "score"],
            )

    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    found = two_rounds(shards, queries, n_parts, build, search, schema, "query", order, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")


#: The query in SQL: every pair of a query with another row.
SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""
