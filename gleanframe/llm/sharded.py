"""Searches over shards: a shard's rows come first, then the queries sent to it, in batches.

Rows are dealt to shards of bounded size by a hash of a written row number, so no key makes a shard
large. A search runs in two rounds. First each query meets ``seeds`` shards; the k-th score it has
then is sent with it to all others, where whatever cannot reach that score is left out. A task holds
one shard and a batch of queries, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gleanframe.session import materialise, scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its rows stay as they are."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shards_for(n: Column, largest: int, least: int, wanted: int) -> Column:
    """Shards of ``n`` rows: ``wanted`` if they hold ``least`` rows each, more if one held over ``largest``."""
    by_size = F.ceil(n / F.lit(largest))
    return F.greatest(F.lit(1), by_size, F.least(F.lit(wanted), F.ceil(n / F.lit(least)))).cast("int")


def meet(rows: DataFrame, queries: DataFrame, n_parts: int, build: Callable, search: Callable, schema: T.StructType) -> DataFrame:
    """``search(build(rows of a part), a batch of the part's queries)`` for every part.

    ``rows`` and ``queries`` have a column ``part`` from 0 to ``n_parts - 1``; columns of one that
    the other lacks are null there. ``build`` takes a ``pa.Table``, ``search`` gives record batches.
    """
    both = rows.withColumn("is_query", F.lit(False)).unionByName(queries.withColumn("is_query", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "is_query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, index = None, [], None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(parts)]):
                if a == b:
                    continue
                if parts[a] != part:
                    part, held, index = parts[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                elif held or index is not None:
                    if index is None:
                        index, held = build(pa.Table.from_batches(held)), []
                    yield from search(index, batch.slice(a, b - a))

    return dealt.mapInArrow(run, schema)


def best(found: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each query, with their ``rank``. A query has at most ``k`` rows for each shard here."""
    by_query = W.partitionBy(query).orderBy(*order)
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def two_rounds(
    rows: DataFrame, queries: DataFrame, n_parts: int, build: Callable, search: Callable, schema: T.StructType,
    query: str, order: list[Column], k: int, fixed_seeds: bool = False,
) -> DataFrame:
    """The ``k`` best rows of each query over all parts, with their ``rank``.

    ``queries`` have columns ``first`` and ``last`` (the parts they ask, ends included) and a row
    number ``query``; they reach ``search`` with ``floor``, the k-th score they had after the first
    round (null before it, or with fewer rows). The seeds are about the square root of the parts;
    with ``fixed_seeds`` all queries have the same ones, so that the other parts are built once only.
    """
    span = F.col("last") - F.col("first") + 1
    seeds = F.ceil(F.sqrt(span)).cast("int")
    home = F.lit(0) if fixed_seeds else F.pmod(F.xxhash64(query), span).cast("int")
    asked = queries.withColumn("part", F.explode(F.sequence("first", "last")))
    place = F.pmod(F.col("part") - F.col("first") - home, span)
    early = rows.filter(F.col("part") < F.lit(max(1, int(np.ceil(np.sqrt(n_parts)))))) if fixed_seeds else rows
    late = rows.filter(F.col("part") >= F.lit(max(1, int(np.ceil(np.sqrt(n_parts)))))) if fixed_seeds else rows
    unknown = F.lit(None).cast("long").alias("floor")
    met = meet(early, asked.filter(place < seeds).select("*", unknown).drop("first", "last"), n_parts, build, search, schema)
    so_far = materialise(best(met, query, order, k).drop("rank"))
    floors = so_far.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).drop("n")
    told = asked.filter(place >= seeds).join(floors, query, "left").drop("first", "last")
    return best(so_far.unionByName(meet(late, told, n_parts, build, search, schema)), query, order, k)
