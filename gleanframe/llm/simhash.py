"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are cut into a ring of five segments. If two fingerprints differ in at most two bits,
then by the pigeonring principle there is a segment from which the differences of the chains of
one, two, three, four and five consecutive segments stay within the proportional budgets
``floor(2 * length / 5)``: 0, 0, 1, 1 and 2. So the first two segments of that chain agree, and
of the next two at most one differs. A fingerprint is a candidate only if, for some start, another
one agrees with it on the two and on one of the next two: about 38 of 64 bits. All others, which
are nearly all fingerprints of unrelated texts, go no further.

Candidates get the full Hamming check without pairs within a group: two fingerprints differ in at
most two bits just when some value is at most one bit from both. Each candidate is sent to itself
and its 64 neighbours; at a value there are at most 65 fingerprints, whatever the size of a group of
copies. They are all linked there through the smallest, and each such link is checked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.llm.common import append, fresh, pieces, raw_bytes, replacing, with_columns
from gleanframe.llm.components import connected_components
from gleanframe.session import materialise

#: Words in a shingle, seed of its hash, and bits that may differ.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Lengths of the ring's segments.
SEGMENTS = (13, 13, 13, 13, 12)
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint_of(text: bytes) -> int:
    """Signed 64-bit fingerprint of a text's word shingles; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """Add the fingerprint (a long) of every whole text; ``keep`` names the columns to pass on.

    A-Z count as a-z, words are parted by ASCII white space. Null and empty texts, and those
    without words, have fingerprint zero. A column of that name is replaced.
    """
    kept = replacing(docs, [fingerprint])
    names = kept.columns if keep is None else keep
    schema = with_columns(kept.select(*names), [(fingerprint, T.LongType())])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                column = pa.array([fingerprint_of(x) for x in raw_bytes(piece, text)], pa.int64())
                yield append(piece.select(names), {fingerprint: column})

    return kept.mapInArrow(run, schema)


def chain_keys(fp: Column) -> Column:
    """The ten keys of a fingerprint: from each start, two segments and one of the next two."""
    ends = np.cumsum(SEGMENTS)
    masks = [((1 << s) - 1) << int(e - s) for s, e in zip(SEGMENTS, ends)]
    keys = []
    for start in range(5):
        for third in (2, 3):
            mask = masks[start] | masks[(start + 1) % 5] | masks[(start + third) % 5]
            signed = mask - (1 << 64) if mask >> 63 else mask
            keys.append(F.xxhash64(F.lit(len(keys)), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def candidates(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` that share a chain key with another one."""
    keys = prints.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keys.join(shared, "key", "left_semi").select("fp").distinct()


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within two bits of each other."""
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << k) if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    near = candidates(prints).select("fp", F.explode(F.array(*flips)).alias("value"))
    # at most 65 fingerprints lie within one bit of a value
    met = near.groupBy("value").agg(F.collect_set("fp").alias("group")).filter(F.size("group") > 1)
    pairs = met.select(F.explode("group").alias("a"), F.array_min("group").alias("b")).filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)


def groups(rows: DataFrame, id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Per distinct fingerprint: its group's root, and the group's first row (id, fingerprint).

    The first row of a group has the smallest id (null ids last), then the smallest fingerprint.
    """
    prints = rows.groupBy(F.col(fingerprint).alias("fp")).agg(F.min(F.struct(F.col(id).isNull().alias("no"), F.col(id).alias("id"), F.col(fingerprint).alias("fp"))).alias("first"))
    prints = materialise(prints)
    roots = connected_components(links(prints.select("fp")))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.select("fp", "root").join(firsts, "root")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits) and the smallest id its fingerprint reaches.

    Repeated rows give a row each, in one component. A null id is larger than any other, so a
    component's id is null only if all its ids are. An empty table gives none.
    """
    rows = materialise(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "fp", keep=["id"]))
    found = groups(rows, "id", "fp")
    return rows.join(found, "fp").select(
        F.col("id").alias(id),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest (id, fingerprint).

    Of rows that repeat both, one stays. Columns are those of ``docs``, whatever their names. Null and
    empty texts, and those without words, are alike, so one of them stays; a null id ranks last. An
    empty table gives none.
    """
    own = fresh(docs, "fp")
    marked = fingerprints(docs, text, own)
    rows = materialise(marked.select(F.col(id).alias("id"), F.col(own).alias("fp")))
    # one (id, fingerprint) for each group, so both joins below are on keys of few rows
    firsts = groups(rows, "id", "fp").select("first.*").distinct()
    same = marked[id].eqNullSafe(firsts["id"]) & (marked[own] == firsts["fp"])
    return marked.join(firsts, same, "left_semi").dropDuplicates([id, own]).drop(own)
