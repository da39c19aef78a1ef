"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level BPE over a space and the text, side B a piece model that puts the space there
itself. Both sides' tokens have byte ranges in the document. For each batch of documents,
``merge_asof`` keyed by document finds for each start of an A token the B token that covers it, and
the other way round; two tokens overlap just when one covers the other's start, so the union of both
directions is all overlaps. Offsets where tokens of both sides end cut the document into groups.

How common a link is, is counted over the corpus. A batch writes its documents' links as numbers in
the batch's own list of id pairs, and that list once with the number of its documents that hold each
pair. Pairs are summed over batches, and each batch's list, not each document's, is joined with the
sums: a pair that all documents hold is a row for each batch.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from gleanframe.llm.bpe import PATTERN, byte_letters, default_vocabulary
from gleanframe.llm.common import append, replacing, strings, with_columns, worker_cache
from gleanframe.llm.sharded import written

#: Documents and characters handled together; a longer text is alone.
DOCS, CHARACTERS = 1024, 1_500_000


def default_pieces() -> str:
    """Place of the piece model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Sides:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, vocabulary: str | None, piece_model: str | None):
        import sentencepiece
        import tiktoken

        with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
            spec = json.load(f)
        letters, added = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in added}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model or default_pieces())
        a_bytes = [b""] * (1 + max(ranks.values()))
        for word, i in ranks.items():
            a_bytes[i] = word
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.IsByte(i) else piece.replace("▁", " ").encode())
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        # decimal ids followed by each sign that may come next
        self.n = max(len(a_bytes), len(b_bytes))
        self.decimals = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(self.n)], pa.large_string())

    def align(self, texts: list[str]) -> "Aligned":
        spaced = [f" {x}" if x else "" for x in texts]
        a = [self.a.encode_ordinary(x) if x else [] for x in spaced]
        b = self.b.encode([x for x in texts], num_threads=1) if texts else []
        return Aligned(self, [x.encode() for x in spaced], a, b)


def cells(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a large binary column, end to end, and where each cell begins and the last ends."""
    _, offsets, data = column.buffers()
    return memoryview(data or b"").cast("B"), np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers, and where each list begins and the last ends."""
    edges = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int32, edges[-1]), edges


class Aligned:
    """Tokens, links and groups of a batch of documents, as flat arrays with the documents' edges.

    ``a_ids`` and ``b_ids`` are the ids, ``a_ends`` and ``b_ends`` the tokens' ends in the joined
    bytes of all documents that align; ``a_edges`` and so on part them by document. ``link_a`` and
    ``link_b`` are places in these arrays, by A, then B; ``cuts`` are the ends that both sides share.
    """

    def __init__(self, sides: Sides, spaced: list[bytes], a: list[list[int]], b: list[list[int]]):
        self.sides = sides
        both = [(*flat(ids), table) for ids, table in ((a, sides.a_bytes), (b, sides.b_bytes))]
        fine = np.array([bool(x) for x in spaced], bool)
        for ids, edges, table in both:
            data, starts = cells(table.take(pa.array(ids)))
            bounds = starts[edges].tolist()
            fine &= np.array([data[x:y] == want for x, y, want in zip(bounds, bounds[1:], spaced)], bool)
        self.base = np.concatenate([[0], np.cumsum([len(x) * ok for x, ok in zip(spaced, fine.tolist())])]).astype(np.int64)
        found = []
        for ids, edges, table in both:
            sizes = np.diff(edges)
            ids, edges = ids[np.repeat(fine, sizes)], np.concatenate([[0], np.cumsum(sizes * fine)]).astype(np.int64)
            ends = cells(table.take(pa.array(ids)))[1]
            doc = np.repeat(np.arange(len(fine)), np.diff(edges))
            found.append((ids, edges, ends[1:], pd.DataFrame({"start": ends[:-1], "doc": doc, "token": np.arange(len(ids))})))
        (self.a_ids, self.a_edges, self.a_ends, left), (self.b_ids, self.b_edges, self.b_ends, right) = found
        # starts grow over the batch, as each document begins where the one before it ends
        over_a = pd.merge_asof(left, right, on="start", by="doc", suffixes=("_a", "_b"))
        over_b = pd.merge_asof(right, left, on="start", by="doc", suffixes=("_b", "_a"))
        # equal starts are found from both sides; each link is taken once
        later = over_b[over_b["start"].to_numpy() != left["start"].to_numpy()[over_b["token_a"].to_numpy()]] if len(over_b) else over_b
        link_a = np.concatenate([over_a["token_a"].to_numpy(), later["token_a"].to_numpy()]).astype(np.int64)
        link_b = np.concatenate([over_a["token_b"].to_numpy(), later["token_b"].to_numpy()]).astype(np.int64)
        order = np.argsort(link_a * (len(self.b_ids) + 1) + link_b)
        self.link_a, self.link_b = link_a[order], link_b[order]
        self.link_edges = np.searchsorted(self.link_a, self.a_edges)
        self.a_last = np.isin(self.a_ends, self.b_ends, assume_unique=True)
        self.b_last = np.isin(self.b_ends, self.a_ends, assume_unique=True)
        self.cuts = self.a_ends[self.a_last]
        self.cut_edges = np.searchsorted(self.cuts, self.base, side="right")

    def group_texts(self) -> list[str]:
        """Per document ``a1,a2|b1;a3|b2,b3``."""
        group_a = np.searchsorted(self.cuts, self.a_ends)
        group_b = np.searchsorted(self.cuts, self.b_ends)
        a_in, b_in = (np.concatenate([[0], np.cumsum(np.bincount(g, minlength=len(self.cuts)))]).astype(np.int64) for g in (group_a, group_b))
        place = np.empty(len(self.a_ids) + len(self.b_ids), np.int64)
        place[np.arange(len(self.a_ids)) + b_in[group_a]] = self.a_ids + self.sides.n * self.a_last
        place[np.arange(len(self.b_ids)) + a_in[group_b + 1]] = self.b_ids + 2 * self.sides.n * self.b_last
        data, starts = cells(self.sides.decimals.take(pa.array(place)))
        edges = starts[self.a_edges + self.b_edges]
        return [str(data[x : y - 1], "ascii") if y > x else "" for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]


def sides(vocabulary: str | None, piece_model: str | None) -> Sides:
    return worker_cache(("sides", vocabulary, piece_model), lambda: Sides(vocabulary, piece_model))


def portions(batch: pa.RecordBatch, column: str):
    """Slices of a batch with at most ``DOCS`` rows and about ``CHARACTERS`` characters, and their texts."""
    values = strings(batch, column)
    at, size = 0, 0
    for i, x in enumerate(values):
        if i > at and (i - at >= DOCS or size + len(x) > CHARACTERS):
            yield batch.slice(at, i - at), values[at:i]
            at, size = i, 0
        size += len(x)
    if at < len(values):
        yield batch.slice(at), values[at:]


def lists_of(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values).cast(kind))


LINK = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
TOKENS = ["a_ids", "a_ends", "b_ids", "b_ends", "cuts"]


def align(docs: DataFrame, text: str = "text", vocabulary: str | None = None, piece_model: str | None = None) -> DataFrame:
    """Add the alignment of every whole text.

    ``a_ids`` and ``b_ids``: token ids; ``a_ends`` and ``b_ends``: the byte after each token, counted
    in the space and the text; ``links``: places (from 0) of an A and a B token that overlap, in
    order; ``cuts``: the bytes after the groups. Null and empty texts, and those that either side
    does not give back byte for byte, have empty lists. Rows stay as they are, repeated ones too;
    columns of these names are replaced; an empty table gives an empty table.
    """
    kept = replacing(docs, [*TOKENS, "links"])
    schema = with_columns(kept, [*((c, T.ArrayType(T.IntegerType())) for c in TOKENS), ("links", LINK)])

    def run(batches):
        both = sides(vocabulary, piece_model)
        for batch in batches:
            for piece, texts in portions(batch, text):
                x = both.align(texts)
                own = lambda ends, edges: ends - np.repeat(x.base[:-1], np.diff(edges))
                pairs = [x.link_a - np.repeat(x.a_edges[:-1], np.diff(x.link_edges)), x.link_b - np.repeat(x.b_edges[:-1], np.diff(x.link_edges))]
                links = pa.StructArray.from_arrays([pa.array(p).cast(pa.int32()) for p in pairs], names=["a", "b"])
                yield append(piece, {
                    "a_ids": lists_of(x.a_ids, x.a_edges, pa.int32()), "a_ends": lists_of(own(x.a_ends, x.a_edges), x.a_edges, pa.int32()),
                    "b_ids": lists_of(x.b_ids, x.b_edges, pa.int32()), "b_ends": lists_of(own(x.b_ends, x.b_edges), x.b_edges, pa.int32()),
                    "cuts": lists_of(own(x.cuts, x.cut_edges), x.cut_edges, pa.int32()),
                    "links": pa.ListArray.from_arrays(pa.array(x.link_edges.astype(np.int32)), links),
                })

    return kept.mapInArrow(run, schema)


BOOK = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("docs", T.LongType())]))
ARROW_BOOK = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int64())]))
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def scan(docs: DataFrame, vocabulary: str | None, piece_model: str | None) -> DataFrame:
    """Per row of (id, text): its counts, digest, and links as numbers in the list of its ``batch``.

    The batch's first row has the list (``book``). ``batch`` numbers are good in what is written only.
    """
    fields = [T.StructField("id", docs.schema["id"].dataType), T.StructField("batch", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType()), T.StructField("book", BOOK)]

    def run(batches):
        both, pack = sides(vocabulary, piece_model), zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece, texts in portions(batch, "text"):
                x = both.align(texts)
                pairs, local = np.unique(x.a_ids[x.link_a].astype(np.int64) << 32 | x.b_ids[x.link_b], return_inverse=True)
                doc = np.repeat(np.arange(len(texts)), np.diff(x.link_edges))
                held, times = np.unique(doc * max(1, len(pairs)) + local, return_counts=True)
                doc, local = held // max(1, len(pairs)), held % max(1, len(pairs))
                edges = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                kinds = [np.min_scalar_type(int(v.max(initial=0))) for v in (local, times)]
                body = [pack(local[p:q].astype(kinds[0]).tobytes() + times[p:q].astype(kinds[1]).tobytes()) for p, q in zip(edges, edges[1:])]
                head = bytes(k.itemsize for k in kinds)
                book = [None] * len(texts)
                book[0] = [
                    {"a": a, "b": b, "docs": n} for a, b, n in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), np.bincount(local, minlength=len(pairs)).tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"), pa.array([number] * len(texts), pa.int64()),
                        *(pa.array(np.diff(e)) for e in (x.a_edges, x.b_edges, x.cut_edges, x.link_edges)),
                        pa.array(x.group_texts(), pa.string()), pa.array([head + p for p in body], pa.binary()), pa.array(book, ARROW_BOOK),
                    ],
                    names=[f.name for f in fields],
                )
                number += 1

    found = docs.mapInArrow(run, T.StructType(fields))
    return found.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None, piece_model: str | None = None) -> DataFrame:
    """Per row: id, numbers of tokens, groups and links, how common its links are, and the groups' digest.

    A pair of ids counts the documents that hold it linked. ``n_best`` counts a document's links whose
    pair is the most common of its A id (ties included), ``count_sum`` sums the counts over its links.
    Rows without tokens (see ``align``) have zeros and an empty digest. Repeated rows count each and
    stay; null ids stay; an empty table gives none; other columns play no part.
    """
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = written(scan(plain, vocabulary, piece_model), "aligned")
    books = rows.filter("book IS NOT NULL").select("batch", F.posexplode("book").alias("place", "pair")).select("batch", "place", "pair.*")
    counts = books.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # an A id has no more partners than the B side has pieces
    best = counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a")))
    told = books.drop("docs").join(best, ["a", "b"]).select(F.col("batch").alias("of"), "place", "count", "best")
    fields = [T.StructField(id, plain.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in [*COUNTS, "n_best", "count_sum"])]
    schema = T.StructType([*fields, T.StructField("groups_sha256", T.StringType())])

    def total(table: pa.Table, list_: pa.Table) -> pa.Table:
        place = list_.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = list_.column("count").to_numpy(), list_.column("best").to_numpy()
        unpack = zstandard.ZstdDecompressor().decompress
        sums = []
        for links in table.column("links").to_pylist():
            body, (wide, high) = unpack(links[2:]), links[:2]
            n = len(body) // (wide + high)
            local = np.frombuffer(body, f"<u{wide}", n)
            times = np.frombuffer(body, f"<u{high}", n, n * wide).astype(np.int64)
            sums.append((int((times * best[local]).sum()), int((times * count[local]).sum())))
        columns = [table.column("id"), *(table.column(c) for c in COUNTS), *(pa.chunked_array([pa.array([s[i] for s in sums], pa.int64())]) for i in (0, 1))]
        return pa.table([*columns, table.column("groups")], names=[f.name for f in schema])

    return rows.drop("book").groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(total, schema)
