"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of whole documents, one after the other, each closed by an end id:

    header   magic ``GPFR``, format 1, ids in a block
    blocks   for each block of ids: its minimum (u32), width (u8), number of exceptions (u16),
             the offsets from the minimum packed at that width, lowest bits first, then for each
             exception its place in the block (u16) and the bits above the width (u32)
    index    where each block starts in the file (u64)
    table    per document: doc_id (i64), 1 if the id is there (u8), number of ids (u32)
    tail     places of index and table (u64 each), numbers of ids, documents and blocks (u64 each)

All numbers are little-endian. The width is that of the ``PERCENTILE`` of a block's offsets; larger
offsets are the exceptions. The last block is filled up with its own minimum.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from gleanframe.llm.bpe import UnitEncoder, byte_letters, default_vocabulary, packed
from gleanframe.llm.common import pieces, strings, worker_cache
from gleanframe.session import scratch_path

BLOCK = 256
PERCENTILE = 90
#: Ids after which a task begins its next file.
FILE_IDS = 4_000_000
#: Blocks packed together.
GROUP = 1024
HEAD, BLOCK_HEAD, TAIL = struct.Struct("<4sHH"), struct.Struct("<IBH"), struct.Struct("<QQQQQ")
MAGIC = b"GPFR"
TABLE = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u4")])
EXCEPTION = np.dtype([("at", "<u2"), ("high", "<u4")])

#: Units and pre-tokens in the newer half of a worker's memo.
UNITS = WORDS = 350_000

MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of numbers as rows of bytes, ``width`` bits each."""
    kind = "<u2" if width <= 16 else "<u4"
    wide = values.astype(kind).view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(wide, axis=1, bitorder="little").reshape(len(values), values.shape[1], -1)[:, :, :width]
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpacked_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``packed_bits`` for rows of ``BLOCK`` numbers."""
    n, size = len(rows), 16 if width <= 16 else 32
    bits = np.unpackbits(rows, axis=1, bitorder="little", count=BLOCK * width).reshape(n, BLOCK, width)
    wide = np.zeros((n, BLOCK, size), np.uint8)
    wide[:, :, :width] = bits
    return np.packbits(wide.reshape(n, -1), axis=1, bitorder="little").view("<u2" if size == 16 else "<u4").astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ids whose number is a multiple of ``BLOCK``."""
    blocks = ids.reshape(-1, BLOCK)
    low = blocks.min(axis=1)
    offset = blocks - low[:, None]
    at = -(-BLOCK * PERCENTILE // 100) - 1
    chosen = np.partition(offset, at, axis=1)[:, at]
    width = np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1))).astype(int) + 1, 0)
    out: list[bytes] = [b""] * len(blocks)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        part = offset[rows]
        body = packed_bits(part & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(rows), 0), np.uint8)
        high = part >> np.uint32(w) if w < 32 else np.zeros_like(part)
        for i, row in enumerate(rows):
            places = np.flatnonzero(high[i])
            patch = np.empty(len(places), EXCEPTION)
            patch["at"], patch["high"] = places, high[i][places]
            out[row] = BLOCK_HEAD.pack(int(low[row]), int(w), len(places)) + body[i].tobytes() + patch.tobytes()
    return out


def decode_blocks(data: memoryview, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts``."""
    heads = [BLOCK_HEAD.unpack_from(data, s) for s in starts.tolist()]
    low, width, n_patches = (np.array(x) for x in zip(*heads)) if heads else (np.zeros(0, int),) * 3
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        size = BLOCK * int(w) // 8
        if w:
            body = np.stack([np.frombuffer(data, np.uint8, size, starts[r] + BLOCK_HEAD.size) for r in rows])
            out[rows] = unpacked_bits(body, int(w))
        for r in rows[n_patches[rows] > 0]:
            patch = np.frombuffer(data, EXCEPTION, n_patches[r], starts[r] + BLOCK_HEAD.size + size)
            out[r, patch["at"]] |= patch["high"] << np.uint32(w)
    return (out + low[:, None].astype(np.uint32)).reshape(-1)


class Writer:
    """Writes one file; ids wait until a group of blocks is full."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.write(HEAD.pack(MAGIC, 1, BLOCK))

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BLOCK * GROUP:
            self.flush(self.n_waiting // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for at in range(0, n, BLOCK * GROUP):
            for block in encode_blocks(ids[at : min(n, at + BLOCK * GROUP)]):
                self.starts.append(self.at)
                self.write(block)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        if self.n_waiting:
            rest = np.concatenate(self.waiting)
            self.waiting.append(np.full(-len(rest) % BLOCK, rest[-(len(rest) % BLOCK) :].min(), np.uint32))
            self.flush(len(rest) + -len(rest) % BLOCK)
        index = self.at
        self.write(np.array(self.starts, "<u8").tobytes())
        table = self.at
        self.write(np.array(self.docs, TABLE).tobytes())
        self.write(TAIL.pack(index, table, self.n_ids, len(self.docs), len(self.starts)))


def read_documents(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a file's documents in their order; blocks are decoded a group at a time."""
    magic, version, size = HEAD.unpack_from(data, 0)
    if magic != MAGIC or version != 1 or size != BLOCK:
        raise ValueError("not a token file of this format")
    index, table, n_ids, n_docs, n_blocks = TAIL.unpack_from(data, len(data) - TAIL.size)
    starts = np.frombuffer(data, "<u8", n_blocks, index).astype(np.int64)
    view, at, have, rest = memoryview(data), 0, 0, np.zeros(0, np.uint32)
    for doc_id, known, n in np.frombuffer(data, TABLE, n_docs, table).tolist():
        while have < n:
            more = decode_blocks(view, starts[at : at + GROUP])
            at += GROUP
            rest = np.concatenate([rest, more])
            have = len(rest)
        yield doc_id if known else None, rest[:n]
        rest = rest[n:]
        have = len(rest)


def library_encoder(path: str | None) -> UnitEncoder:
    """The tokenizers library's BPE model over one vocabulary file; a worker has it encode a pre-token once."""
    return worker_cache(("library", path), lambda: new_library_encoder(path or default_vocabulary()))


def new_library_encoder(path: str) -> UnitEncoder:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    added = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    letters = {b: c for c, b in byte_letters().items()}
    tokens_of, space = library.model.tokenize, letters[32]

    def word_ids(word: str) -> bytes:
        rest = word[1:]
        if rest.isalpha() and word[0] == " " and word.isascii():
            written = space + rest
        else:
            written = word.encode().decode("latin-1").translate(letters)
        return packed([t.id for t in tokens_of(written)])

    return UnitEncoder(word_ids, added, UNITS, WORDS)


def write(
    docs: DataFrame, folder: str, id: str = "doc_id", text: str = "text", end_id: int = 2,
    vocabulary: str | None = None, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the token ids of whole texts in ascending order of ``id``; returns the manifest.

    Texts are range partitioned and sorted by ``id`` (equal ids by a hash of the text, so that no
    single id fills one task), encoded, and written to files of about ``file_ids`` ids under
    ``folder``, a place all executors can write to by Arrow's file systems. Every attempt of a task
    writes under names of its own and only files in the manifest count, so a lost executor's
    attempt leaves unused files, never wrong ones. The manifest is stored beside the files and
    has one row per file: partition, number in it, path, and its documents, ids and bytes.

    ``id`` is an integer; null ids come first. Null and empty texts hold just the end id. Repeated
    rows are written each. An empty table gives an empty manifest. Other columns are not read.
    """
    ordered = (
        docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    place = folder.rstrip("/") + "/files"

    def run(batches):
        encode, part, seq = library_encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        store, root = pafs.FileSystem.from_uri(place)
        store.create_dir(root, recursive=True)
        writer = sink = path = None

        def closed():
            writer.close()
            sink.close()
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "path": path, "n_docs": len(writer.docs), "n_ids": writer.n_ids, "n_bytes": writer.at}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]),
            )

        for batch in batches:
            for piece in pieces(batch):
                for doc_id, x in zip(piece.column("doc_id").to_pylist(), strings(piece, "text")):
                    if writer is None:
                        name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.gpfr"
                        path = f"{place}/{name}"
                        sink = store.open_output_stream(f"{root}/{name}")
                        writer = Writer(sink)
                    writer.add(doc_id, np.frombuffer(encode(x) + end, "<u4"))
                    if writer.n_ids >= file_ids:
                        yield closed()
                        writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read files back: per document its id, start in the whole stream, number of ids and their crc32.

    The window runs over the manifest, one row per file of millions of ids. Each file is read whole
    by one task; its size is bounded by ``file_ids`` of ``write`` and one document.
    """
    before = W.partitionBy(F.lit(0)).orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.select(
        "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first")
    )

    def run(batches):
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                store, root = pafs.FileSystem.from_uri(path)
                with store.open_input_stream(root) as f:
                    data = f.read()
                rows: list[tuple] = []
                for doc_id, ids in read_documents(data):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield to_batch(rows)
                        rows = []
                yield to_batch(rows)

    # a number that is asked for is kept, so that few small rows still go to as many tasks
    return placed.repartition(max(1, manifest.count())).mapInArrow(run, READ_BACK)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new folder of the cluster's shared place and read the files back."""
    return read(write(docs, scratch_path(docs.sparkSession, "token-files"), **options))
