"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The benchmark is reduced to its distinct windows of ``SIZE`` words (an item of fewer words is one
window). The set travels to the executors in blocks of at most ``BLOCK_WINDOWS`` windows, so that
what is broadcast has a fixed size however large the benchmark is; each block is a narrow pass over
the documents, and between passes the documents are written to the shared folder. A document's
words become numbers (place in the block's vocabulary, or none), windows of known words are hashed
with NumPy, looked up in the sorted hash set, and every hit is verified word by word.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.llm.common import append, aside, pieces, raw_bytes, replacing, with_columns, worker_cache
from gleanframe.session import materialise

#: Words in a window.
SIZE = 10
#: (window, item) pairs that one broadcast holds; about 300 bytes each in a worker.
BLOCK_WINDOWS = 50_000

#: Byte by byte: A-Z to lower case, other word bytes as they are, all else a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
ARROW_HITS = pa.struct(
    [
        ("n_words", pa.int64()), ("n_hit", pa.int64()),
        ("hit_words", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("items", pa.list_(pa.string())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, letters and all that is not ASCII."""
    return text.translate(WORD_BYTES).split()


def windows(benchmark: DataFrame, id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Distinct (window, item) pairs of a benchmark; items without words have none.

    A null item id is kept: its windows count as hits but name no item.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                found = []
                for item, x in zip(piece.column("item").to_pylist(), raw_bytes(piece, "text")):
                    words = words_of(x)
                    found += [(b" ".join(words[i : i + size]).decode("utf-8"), item) for i in range(max(1, len(words) - size + 1)) if words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.string())], names=["window", "item"]
                )

    return (
        benchmark.select(F.col(id).cast("string").alias("item"), F.col(text).alias("text"))
        .mapInArrow(run, "window string, item string").distinct()
    )


class HashSet:
    """One block of windows, ready for scanning."""

    #: Odd multiplier of the rolling hash, a fixed value without meaning.
    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pairs: list[tuple[str, str | None]]):
        by_size: dict[int, dict[tuple, list]] = {}
        self.numbers: dict[bytes, int] = {}
        for window, item in pairs:
            words = window.encode().split(b" ")
            key = tuple(self.numbers.setdefault(w, len(self.numbers)) for w in words)
            by_size.setdefault(len(key), {}).setdefault(key, []).append(item)
        self.tables = []
        for size, items in by_size.items():
            keys = np.array(list(items), np.int64).reshape(-1, size)
            self.tables.append((size, items, np.unique(self.hashes(keys.T))))

    def hashes(self, columns) -> np.ndarray:
        total = np.zeros(len(columns[0]), np.uint64)
        with np.errstate(over="ignore"):
            for c in columns:
                total = (total + c.astype(np.uint64) + np.uint64(1)) * self.MIX
                total ^= total >> np.uint64(29)
        return total

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges (first, last) that some window covers, merged, and the items that hit."""
        number = self.numbers.get
        ids = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
        covered, items = [], set()
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, table, hashes in self.tables:
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            found = self.hashes([ids[at + k] for k in range(size)])
            place = np.searchsorted(hashes, found)
            place[place == len(hashes)] = 0
            for i in at[hashes[place] == found].tolist():
                hit = table.get(tuple(ids[i : i + size].tolist()))
                if hit is not None:
                    covered.append((i, i + size - 1))
                    items.update(hit)
        return merged(covered), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that meet or overlap joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, item_id: str = "item_id",
    item_text: str = "text", hits: str = "hits", block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Add ``hits``: number of words, number of hit words, their ranges, and the items that occur.

    ``hits.hit_words`` has merged ranges of word places (from 0, last included). ``hits.items`` are
    the distinct item ids as strings, in string order. Null and empty texts have no words.
    Repeated rows and ties are scanned each; extra columns stay, one named ``hits`` is replaced.
    An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    grams = materialise(windows(benchmark, item_id, item_text, size))
    n_blocks = max(1, -(-grams.count() // (block_windows * 4 // 5)))
    out = replacing(docs, [hits])
    for k in range(n_blocks):
        # blocks are dealt by hash to four fifths of their size; should one overflow, deal again with larger ones
        block = grams.filter(F.pmod(F.xxhash64("window", "item"), F.lit(n_blocks)) == k)
        pairs = [tuple(r) for r in block.limit(block_windows + 1).collect()]
        if len(pairs) > block_windows:
            return find(docs, benchmark, text, size, item_id, item_text, hits, block_windows * 2)
        out = scan_block(out, spark.sparkContext.broadcast(pairs), text, hits)
        if k + 1 < n_blocks:
            out = materialise(out)
    return out


def scan_block(docs: DataFrame, shared, text: str, hits: str) -> DataFrame:
    """One pass with one block; ranges and items of earlier passes are kept."""
    again, name = hits in docs.columns, uuid.uuid4().hex
    schema = docs.schema if again else with_columns(docs, [(hits, HITS)])

    def run(batches):
        grams = worker_cache(("grams", name), lambda: HashSet(shared.value))
        for batch in batches:
            for piece in pieces(batch):
                old = piece.column(hits).to_pylist() if again else [None] * piece.num_rows
                rows = []
                for x, before in zip(raw_bytes(piece, text), old):
                    words = words_of(x)
                    covered, items = grams.scan(words)
                    if before:
                        covered = merged(covered + [(r["first"], r["last"]) for r in before["hit_words"]])
                        items |= set(before["items"])
                    rows.append(
                        {
                            "n_words": len(words), "n_hit": sum(b - a + 1 for a, b in covered),
                            "hit_words": [{"first": a, "last": b} for a, b in covered], "items": sorted(items - {None}),
                        }
                    )
                column = pa.array(rows, ARROW_HITS)
                if again:
                    at = piece.schema.get_field_index(hits)
                    yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(piece.columns)], names=piece.schema.names)
                else:
                    yield append(piece, {hits: column})

    return docs.mapInArrow(run, schema)


def drop_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without any hit; columns as before, whatever their names."""
    plain, back = aside(docs, text)
    return back(find(plain, benchmark, text=text, **options).filter("hits.n_hit = 0"))


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", least_words: int = 1, **options) -> DataFrame:
    """Documents with every hit range of at least ``least_words`` words cut from ``text``.

    A cut goes from the first byte of the range's first word to the first byte of the word after the
    range (or the end of the text). Texts without a hit, null ones too, stay as they are, and so do
    all other columns, whatever their names.
    """
    plain, back = aside(docs, text)
    found = find(plain, benchmark, text=text, **options)
    place = found.columns.index(text)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                values = piece.column(text).to_pylist()
                for i, h in enumerate(piece.column("hits").to_pylist()):
                    ranges = [r for r in h["hit_words"] if r["last"] - r["first"] + 1 >= least_words]
                    if not ranges:
                        continue
                    data = values[i].encode()
                    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
                    out, at = [], 0
                    for r in ranges:
                        out.append(data[at : starts[r["first"]]])
                        at = starts[r["last"] + 1]
                    values[i] = b"".join([*out, data[at:]]).decode("utf-8")
                column = pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays([column if k == place else c for k, c in enumerate(piece.columns)], names=piece.schema.names)

    return back(found.mapInArrow(run, found.schema))


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: words, hit words, items that occur and their digest."""
    found = find(docs.select(F.col(id), F.col(text)), benchmark, text=text, **options)
    return found.select(
        F.col(id),
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


#: The same in SQL; windows are joined on their text.
SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
gram AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
seen AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM gram))),
hit AS (SELECT r, i, seen.n, item_id FROM seen JOIN gram ON seen.g = gram.g AND seen.n = gram.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (r) LEFT JOIN named USING (r)"""
