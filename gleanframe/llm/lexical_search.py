"""Ranked lexical search with geometric blocking of each term's posting list.

Documents become sparse vectors of impacts over the terms that the queries use. They are dealt to
shards of bounded size. In a shard every posting list is cut into blocks of like documents: some of
its documents, evenly spaced, become centres, and each document joins the centre that its sketch (a
random projection) agrees with most. A block's summary is the coordinatewise maximum of its vectors,
so no document in it scores more for a query than the summary does.

A query takes its lists by falling greatest contribution. Documents that only later lists hold can
have no more than the later terms give, so a list's summaries are taken over its own and the later
terms. A block is skipped only if its exact bound is below the k-th score so far, lists end when the
sum of what is left is; all other blocks are scored in full. Sketches steer what lies together, never
the result. Lists are blocked when a query first asks for them. The k-th score that a query has after
its first shards goes with it to all others.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.llm.common import pieces, raw_bytes, worker_cache
from gleanframe.llm.decontaminate import words_of
from gleanframe.llm.sharded import two_rounds, written

#: Documents in a block, about; dimensions of a sketch.
BLOCK, SKETCH = 64, 32
#: A shard holds at most so many documents and, about, postings, and no fewer documents than the last if there are enough for all cores.
SHARD_ROWS, SHARD_POSTINGS, LEAST_ROWS = 4096, 1 << 20, 512
#: Distinct (query, term) pairs searched in one pass; their terms are what is broadcast.
BLOCK_TERMS = 200_000
IMPACT_BITS = 20


class Blocks:
    """One posting list: documents by block, and the blocks' summaries one after the other."""

    def __init__(self, docs, starts, terms, values, summary_starts):
        self.docs, self.starts = docs, starts
        self.terms, self.values, self.summary_starts = terms, values, summary_starts

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * weights[self.terms], self.summary_starts)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Shard:
    """Documents as rows of (term, impact), and their posting lists in blocks."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, block: int = BLOCK):
        self.block, self.n = block, len(sizes)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.known, self.terms = np.unique(terms, return_inverse=True)
        self.impacts = impacts
        holder = np.repeat(np.arange(self.n), sizes)
        by_term = np.argsort(self.terms, kind="stable")
        self.holders = holder[by_term]
        self.lists = np.searchsorted(self.terms[by_term], np.arange(len(self.known) + 1))
        self.largest = np.zeros(len(self.known), np.int64)
        np.maximum.at(self.largest, self.terms, impacts)
        # sums of random directions, one for each term, at unit length
        sketch = np.random.default_rng(0).choice([-1.0, 1.0], size=(len(self.known), SKETCH)).astype(np.float32)
        self.sketches = np.stack(
            [np.bincount(holder, weights=impacts * sketch[self.terms, i], minlength=self.n) for i in range(SKETCH)], axis=1
        ) if len(self.known) else np.zeros((self.n, SKETCH))
        self.sketches /= np.maximum(np.sqrt(np.square(self.sketches).sum(axis=1, keepdims=True)), 1e-9)
        self.blocked: dict[int, Blocks] = {}

    def blocks(self, term: int) -> Blocks:
        """The posting list of a term in blocks of like documents, each with its summary."""
        found = self.blocked.get(term)
        if found is None:
            docs = self.holders[self.lists[term] : self.lists[term + 1]]
            n = -(-len(docs) // self.block)
            label = np.zeros(len(docs), np.int64)
            if n > 1:
                centres = docs[(np.arange(n) * len(docs)) // n]
                label = (self.sketches[docs] @ self.sketches[centres].T).argmax(axis=1)
            order = np.argsort(label, kind="stable")
            docs, label = docs[order], np.unique(label[order], return_inverse=True)[1]
            sizes = self.sizes[docs]
            at = gather(self.starts[docs], sizes)
            place = np.repeat(label, sizes) * len(self.known) + self.terms[at]
            # an impact is below 10**6, so place and impact fit into one number, and a place's last one is its maximum
            both = np.sort(place << IMPACT_BITS | self.impacts[at])
            place = both >> IMPACT_BITS
            last = np.flatnonzero(np.concatenate([place[1:] != place[:-1], [True]]))
            place, highest = place[last], both[last] & ((1 << IMPACT_BITS) - 1)
            summary = np.searchsorted(place // len(self.known), np.arange(label[-1] + 1))
            starts = np.searchsorted(label, np.arange(label[-1] + 2))
            found = self.blocked[term] = Blocks(docs, starts, place % len(self.known), highest, summary)
        return found

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores; every document here has a term at least."""
        sizes = self.sizes[docs]
        at = gather(self.starts[docs], sizes)
        return np.add.reduceat(self.impacts[at] * weights[self.terms[at]], np.cumsum(sizes) - sizes)

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The ``k`` best documents of score ``floor`` or more, at least 1, and their scores; ties to the earlier document.

        Also gives the number of documents scored.
        """
        place = np.minimum(np.searchsorted(self.known, terms), max(0, len(self.known) - 1))
        here = self.known[place] == terms if len(self.known) else np.zeros(len(terms), bool)
        own, weights = place[here], weights[here]
        whole = np.zeros(len(self.known), np.int64)
        whole[own] = weights
        rest = whole.copy()
        gives = self.largest[own] * weights
        order = np.argsort(-gives, kind="stable")
        left = np.cumsum(gives[order][::-1])[::-1]
        least, seen, taken = max(1, floor), np.zeros(self.n, bool), 0
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j, term in enumerate(own[order].tolist()):
            if left[j] < least:
                break
            blocks = self.blocks(term)
            bounds = blocks.bounds(rest)
            by_bound = np.argsort(-bounds, kind="stable")
            at, step = 0, 1
            while at < len(by_bound):
                some = by_bound[at : at + step]
                some = some[bounds[some] >= least]
                if not len(some):
                    break
                new = blocks.docs[gather(blocks.starts[some], blocks.starts[some + 1] - blocks.starts[some])]
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    got = self.scores(new, whole)
                    taken += len(new)
                    fine = got >= least
                    docs, scores = np.concatenate([docs, new[fine]]), np.concatenate([scores, got[fine]])
                    if len(docs) >= k:
                        best = np.lexsort((docs, -scores))[:k]
                        docs, scores = docs[best], scores[best]
                        least = max(least, int(scores[-1]))
                at, step = at + step, step * 2
            rest[term] = 0
        best = np.lexsort((docs, -scores))[:k]
        return docs[best], scores[best], taken


def queries_of(items: DataFrame, id: str, text: str) -> DataFrame:
    """(query, item, word, times): each item's row number, and its distinct words."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                counts = [Counter(words_of(x)) for x in raw_bytes(piece, "text")]
                row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("query").take(pa.array(row)), piece.column("item").take(pa.array(row)),
                        pa.array([w.decode() for c in counts for w in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64()),
                    ],
                    names=["query", "item", "word", "times"],
                )

    plain = items.select(F.monotonically_increasing_id().alias("query"), F.col(id).alias("item"), F.col(text).alias("text"))
    schema = T.StructType([plain.schema["query"], plain.schema["item"], T.StructField("word", T.StringType()), T.StructField("times", T.LongType())])
    return written(plain.mapInArrow(run, schema), "queries")


def postings(docs: DataFrame, id: str, text: str, words: list[str]) -> DataFrame:
    """(id, n, terms, counts): number of words in each whole text, and those of ``words`` in it by number."""
    shared, name = docs.sparkSession.sparkContext.broadcast(words), uuid.uuid4().hex

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *values]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def run(batches):
        number = worker_cache(("terms", name), lambda: {w.encode(): i for i, w in enumerate(shared.value)}).get
        for batch in batches:
            for piece in pieces(batch):
                sizes, terms, counts = [], [], []
                for x in raw_bytes(piece, "text"):
                    found = words_of(x)
                    sizes.append(len(found))
                    own, times = np.unique(np.fromiter((i for i in map(number, found) if i is not None), np.int64), return_counts=True)
                    terms.append(own)
                    counts.append(times)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), pa.array(sizes, pa.int64()), lists(terms), lists(counts)], names=["id", "n", "terms", "counts"]
                )

    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    fields = [plain.schema["id"], T.StructField("n", T.LongType())]
    fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "counts")]
    return written(plain.mapInArrow(run, T.StructType(fields)).withColumn("row", F.monotonically_increasing_id()), "postings")


def search_block(docs: DataFrame, pairs: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """The search for one block of queries."""
    spark = docs.sparkSession
    # at most BLOCK_TERMS words, or those of one query
    words = sorted(r[0] for r in pairs.select("word").distinct().collect())
    rows = postings(docs, id, text, words)
    stats = rows.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"),
        F.count(F.when(F.size("terms") > 0, 1)).alias("rows"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings"),
    ).first()
    n_docs, n_words = F.lit(stats["docs"]).cast("long"), F.lit(max(1, stats["words"])).cast("long")
    wanted = 2 * spark.sparkContext.defaultParallelism
    n_parts = max(
        1, math.ceil(stats["rows"] / SHARD_ROWS), math.ceil(stats["postings"] / SHARD_POSTINGS), min(wanted, math.ceil(stats["rows"] / LEAST_ROWS))
    )
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    numbers = spark.createDataFrame(list(enumerate(words)), "term int, word string")
    weights = held.join(numbers, "term").select("word", "term", weight.alias("weight"))
    queries = pairs.join(weights, "word").groupBy("query", "item").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("value")))).alias("own"))
    queries = queries.select(
        "query", "item", F.col("own.term").alias("terms"), F.col("own.value").alias("values"), F.lit(0).alias("first"), F.lit(n_parts - 1).alias("last")
    )
    scaled = rows.withColumns({"d": n_docs, "l": n_words}).withColumn("m", F.expr("75L + (25L * n * d) div l"))
    vectors = scaled.filter(F.size("terms") > 0).select(
        F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int").alias("part"), "row", "id", "terms",
        F.expr("transform(counts, t -> (1000000000L * t) div (1000L * t + 12L * m))").alias("values"),
    )
    schema = T.StructType([
        T.StructField("query", T.LongType()), T.StructField("item", queries.schema["item"].dataType),
        T.StructField("row", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.LongType()),
    ])

    def flat(table, column: str) -> np.ndarray:
        return table.column(column).combine_chunks().flatten().to_numpy()

    def build(table: pa.Table):
        # documents in the order in which ties are settled
        table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        sizes = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
        return table.column("id").combine_chunks(), table.column("row").to_numpy(), Shard(sizes, flat(table, "terms"), flat(table, "values"))

    def search(index, batch):
        ids, numbers, shard = index
        floors = pc.fill_null(batch.column("floor"), 0).to_pylist()
        for i, floor in enumerate(floors):
            terms, values = (batch.column(c)[i].values.to_numpy() for c in ("terms", "values"))
            docs, scores, _ = shard.search(terms, values, floor, k)
            asked = batch.slice(i, 1).take(pa.array(np.zeros(len(docs), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [asked.column("query"), asked.column("item"), pa.array(numbers[docs]), ids.take(pa.array(docs)), pa.array(scores)],
                names=["query", "item", "row", "id", "score"],
            )

    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    return two_rounds(vectors, queries, n_parts, build, search, schema, "query", order, k, fixed_seeds=True)


def rank(
    docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(``item_id``, rank, ``id``, score): each item's ``k`` best documents with a score above 0, ties to the smaller id.

    Terms are runs of digits, letters and all that is not ASCII, A-Z in lower case, in whole texts.
    Null and empty texts have none, and an item without terms that occur finds nothing. Items that
    repeat are answered each, documents that repeat are found each; null ids rank after all others.
    Items are searched in blocks of ``block_terms`` (item, term) pairs; each block is a pass over the
    documents. Empty tables give no rows; other columns play no part.
    """
    pairs = queries_of(items, item_id, item_text)
    n_blocks = max(1, math.ceil(pairs.count() / block_terms))
    n_items = pairs.select("query").distinct().count()
    while n_blocks < n_items:
        dealt = pairs.groupBy(F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block")).count()
        if not dealt.filter(F.col("count") > block_terms).head(1):
            break
        n_blocks *= 2
    out = None
    for b in range(n_blocks):
        found = search_block(docs, pairs.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b), k, id, text)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")


#: The query in SQL: every item's terms against every document.
SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
term AS (SELECT q, item_id, t, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS t FROM item) GROUP BY q, item_id, t),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM doc WHERE len(w) > 0),
held AS (
  SELECT r, doc_id, t, count(*) AS tf, any_value(100 - 25 + (25 * size * n) // l) AS m
  FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS size, unnest(w) AS t FROM doc), total
  WHERE t IN (SELECT t FROM term) GROUP BY r, doc_id, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM held, total GROUP BY t, n),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM term JOIN weight USING (t) JOIN held USING (t) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20"""
