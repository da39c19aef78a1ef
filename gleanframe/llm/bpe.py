"""Byte-level BPE: a queue of merge ranks over a doubly linked symbol list.

A text is cut at added tokens, then by the pre-token pattern, and each pre-token's bytes are
merged. The queue holds (rank, position); an entry whose left symbol is gone, or whose pair has
changed since it was queued, is stale and skipped. Decoding joins the vocabulary's byte strings.

Cutting is sped up by one fact about the pattern: a single space between two characters that are
not white space always starts a new pre-token. A text is therefore cut there into units that can
be encoded on their own. Each Python worker remembers the ids of the units and pre-tokens met lately, a
stated number of them, so memory is bounded whatever the vocabulary of the corpus.
"""

from __future__ import annotations

import json
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.llm.common import append, pieces, replacing, strings, with_columns, worker_cache

#: Units and pre-tokens in the newer half of a worker's memo; about 220 bytes each. Longer ones are not kept.
UNITS, WORDS, LONGEST = 120_000, 150_000, 100
#: Fixed value: the pattern that cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that some Unicode version or library takes for white space.
BLANK = "\\s\x1c-\x1f\x85\u180e\u200b"
EDGE = re.compile(f"(?<=[^{BLANK}]) (?=[^{BLANK}])")
SOFT = re.compile(f"[{BLANK}]")
#: The usual units: a word with signs after it, and perhaps a line break and the same again.
SIGNS = "[!-&(-/:-@\\[-`{-~]*"
USUAL = re.compile(f"([^\\W\\d_]+)({SIGNS})(?:\n([^\\W\\d_]+)({SIGNS}))?").fullmatch


def default_vocabulary() -> str:
    """Place of the vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte.

    Bytes that print in Latin-1 stand for themselves; the others take the letters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ragged(Exception):
    """A unit that touches white space: its text must be cut with more care."""


#: What packs so many ids, ready made for nearly all pre-tokens.
PACKS = [struct.Struct(f"<{n}I").pack for n in range(33)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    n = len(ids)
    return PACKS[n](*ids) if n < 33 else struct.pack(f"<{n}I", *ids)


class Memo(dict):
    """Ids of texts met lately, in a newer and an older half of ``size`` texts at most.

    When the newer half is full it becomes the older one; what is asked for again moves back.
    """

    def __init__(self, make, size: int):
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, text: str) -> bytes:
        out = self.older.pop(text, None)
        if out is None:
            out = self.make(text)
        # two words about a line break seldom come again
        if len(text) <= LONGEST and ("\n" not in text or "\n" not in text[1:-1]):
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out


class UnitEncoder:
    """Encodes a text unit by unit and a unit pre-token by pre-token.

    ``word`` gives the ids of one pre-token, ``added`` those of the tokens that are cut out first.
    """

    def __init__(self, word, added: dict[str, int], units: int = UNITS, words: int = WORDS):
        self.added = {k: packed([i]) for k, i in added.items()}
        self.has_added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        # a token cut out of letters is letters itself
        self.has_lettered = any(k.isalpha() for k in added)
        self.words = Memo(word, words)
        self.cut = regex.compile(PATTERN).findall
        self.later = Memo(self.later_unit, units)

    def later_unit(self, unit: str) -> bytes:
        """Ids of a unit that a space comes before; the usual ones are cut without the full pattern."""
        if unit.isalpha() and not (self.has_lettered and self.has_added.search(unit)):
            return self.words[" " + unit]
        shape = USUAL(unit)
        if shape:
            word, signs, next_word, next_signs = shape.groups()
            if word.isalpha() and (next_word is None or next_word.isalpha()) and not self.has_added.search(unit):
                ids = self.words
                if next_word is not None:
                    return ids[" " + word] + ids[signs] + ids["\n"] + ids[next_word] + ids[next_signs]
                return ids[" " + word] + ids[signs] if signs else ids[" " + word]
        elif not unit or SOFT.match(unit[0]) or SOFT.match(unit[-1]):
            raise Ragged
        return self.unit(" " + unit)

    def unit(self, text: str) -> bytes:
        if not self.has_added.search(text):
            return b"".join(map(self.words.__getitem__, self.cut(text)))
        out, at = [], 0
        for found in self.has_added.finditer(text):
            out += [*map(self.words.__getitem__, self.cut(text[at : found.start()])), self.added[found[0]]]
            at = found.end()
        return b"".join([*out, *map(self.words.__getitem__, self.cut(text[at:]))])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        try:
            if head and not SOFT.match(head[-1]):
                return b"".join([self.unit(head), *map(self.later.__getitem__, rest)])
        except Ragged:
            pass
        head, *rest = EDGE.split(text)
        out = [self.unit(head)]
        for piece in rest:
            try:
                out.append(self.later[piece])
            except Ragged:
                out.append(self.unit(" " + piece))
        return b"".join(out)


class BytePairs:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
        for word, i in vocabulary.items():
            self.strings[i] = bytes(letters[c] for c in word) if word not in added else word.encode()
        for word, i in added.items():
            self.strings[i] = word.encode()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocabulary[letter]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        self.encode = UnitEncoder(self.encode_word, added).encode

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbouring symbols, lowest rank first and leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, made = self.ranks.get, self.made
        queue = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << 32 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 40 | i)
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 40, entry & 0xFFFFFFFFFF
            left, j = symbols[i], after[i]
            if left < 0 or j >= n:
                continue
            now = rank_of(left << 32 | symbols[j])
            if now is None or made[now] != made[rank]:
                continue
            new, k = made[rank], after[j]
            symbols[i], symbols[j], after[i] = new, -1, k
            if k < n:
                before[k] = i
                found = rank_of(new << 32 | symbols[k])
                if found is not None:
                    heappush(queue, found << 40 | i)
            p = before[i]
            if p >= 0:
                found = rank_of(symbols[p] << 32 | new)
                if found is not None:
                    heappush(queue, found << 40 | p)
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> bytes:
        byte_id = self.byte_id
        return packed(self.merge([byte_id[b] for b in word.encode()]))

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def byte_pairs(path: str | None) -> BytePairs:
    """One encoder for each worker and vocabulary."""
    return worker_cache(("bpe", path), lambda: BytePairs(path or default_vocabulary()))


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, packed: bool = False
) -> DataFrame:
    """Add the token ids of every whole text.

    ``ids`` is an array of integers, or with ``packed`` a binary of little-endian unsigned 32-bit
    integers. Null and empty texts have no ids. Rows stay as they are, repeated ones and ties too;
    a column named ``ids`` is replaced; an empty table gives an empty table. ``vocabulary`` is a
    file that every executor has at the same place; by default the one of the installed package.
    """
    kept = replacing(docs, [ids])
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())

    def run(batches):
        pairs = byte_pairs(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                found = [pairs.encode(x) for x in strings(piece, text)]
                if packed:
                    column = pa.array(found, pa.binary())
                else:
                    column = pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))
                yield append(piece, {ids: column})

    return kept.mapInArrow(run, with_columns(kept, [(ids, kind)]))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Add the text of token ids (array or packed binary). Null ids give an empty text."""
    kept = replacing(df, [text])

    def run(batches):
        pairs = byte_pairs(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                values = piece.column(ids).to_pylist()
                found = [
                    pairs.decode(x if isinstance(x, bytes) else np.array(x, "<u4").tobytes()) if x else "" for x in values
                ]
                yield append(piece, {text: pa.array(found, pa.string())})

    return kept.mapInArrow(run, with_columns(kept, [(text, T.StringType())]))


def round_trip(docs: DataFrame, id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per document: its id, number of tokens, and digests of the ids and of the decoded text."""
    # encoded and decoded by one worker; as two steps each would be a worker of its own
    def run(batches):
        pairs = byte_pairs(vocabulary)
        for batch in batches:
            for piece in pieces(batch):
                ids = [pairs.encode(x) for x in strings(piece, text)]
                yield append(
                    piece.select([id]), {"__ids": pa.array(ids, pa.binary()), "__decoded": pa.array([pairs.decode(x) for x in ids], pa.string())}
                )

    plain = docs.select(F.col(id), F.col(text))
    both = plain.mapInArrow(run, with_columns(plain.select(id), [("__ids", T.BinaryType()), ("__decoded", T.StringType())]))
    return both.select(
        F.col(id),
        F.floor(F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2("__decoded", 256).alias("decoded_sha256"),
    )
