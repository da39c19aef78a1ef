"""Repeated passages: lines or paragraphs hashed after normalising, only the first occurrence kept.

Units get a 128-bit digest of their normalised text. Per digest the occurrence of the least rank
(document id, place in the document) stays, all later ones are removed. Digests are grouped with
map-side minima, so a line that a third of all documents hold costs one row per task; the join back
goes over narrow rows (no text), and Spark splits a digest's partition if it is large. Original
places of removed and kept text stay known.

Neighbouring units that all occur more than once, the first occurrence included, make a passage, so
that a long text shared by documents is told apart from single lines that repeat by themselves.

Passages that begin or end within a line have an operator of their own (``shared``), which looks at windows
of words. Texts first meet by a few of their pieces: every window names the one of least hash in it, so
equal windows name the same. Only windows whose piece another text holds too get a digest and are grouped.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from gleanframe.llm.common import append, pieces, replacing, strings, with_columns
from gleanframe.session import materialise, written

#: Units of fewer words are left out; raise it to spare short lines.
LEAST_WORDS = 1
#: Runs of neighbouring repeated units with more words than this are told one by one.
LONG_WORDS = 50
#: Words in a piece by which texts with a common window meet; shorter ones meet more often by chance.
PIECE = 20
#: Windows that a Python worker holds at a time, besides those of one text.
STEP_WINDOWS = 20_000
WHITE = " \t\n\v\f\r"
WORD = re.compile(f"[^{WHITE}]+")
BREAKS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[ \t\r\f\v]*\n\s*")}

UNIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("digest", T.BinaryType())])
ARROW_UNITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]))


def normalised(unit: str) -> bytes:
    """A-Z in lower case, white space as single spaces, none at the ends."""
    return b" ".join(unit.encode().lower().split())


def units_of(text: str, unit: str, least_words: int) -> list[dict]:
    """Places and digests of a text's units of ``least_words`` words or more."""
    out, at = [], 0
    for end, after in [*(m.span() for m in BREAKS[unit].finditer(text)), (len(text), len(text))]:
        plain = normalised(text[at:end])
        words = plain.count(b" ") + 1
        if plain and words >= least_words:
            out.append({"start": at, "end": end, "words": words, "digest": hashlib.blake2b(plain, digest_size=16).digest()})
        at = after
    return out


def scan(docs: DataFrame, text: str, keep: list[str], unit: str, least_words: int) -> DataFrame:
    """Add the digest of every whole text and its units; null counts as empty."""
    schema = with_columns(docs.select(*keep), [("__text", T.BinaryType()), ("__units", T.ArrayType(UNIT))])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                values = strings(piece, text)
                digests = [hashlib.blake2b(x.encode(), digest_size=16).digest() for x in values]
                found = [units_of(x, unit, least_words) for x in values]
                yield append(piece.select(keep), {"__text": pa.array(digests, pa.binary()), "__units": pa.array(found, ARROW_UNITS)})

    return docs.mapInArrow(run, schema)


def repeated(scanned: DataFrame) -> DataFrame:
    """(id, __text, no, start, end, words, stays): every unit that occurs at two places or more.

    ``no`` is its number in the text, ``stays`` says that it is the first occurrence.
    """
    units = scanned.select("id", "__text", F.posexplode("__units").alias("no", "u")).select("id", "__text", "no", "u.*")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "start")
    firsts = units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    return units.join(firsts.select("digest", "first"), "digest").select(
        "id", "__text", "no", "start", "end", "words", rank.eqNullSafe(F.col("first")).alias("stays")
    )


def repeats(found: DataFrame) -> DataFrame:
    """(id, __text, spans): the units that repeat an earlier one, in order, per text that has any."""
    # the list is as long as the text's units at most
    later = found.filter(~F.col("stays"))
    return later.groupBy("id", "__text").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def passages(found: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(id, __text, spans, runs, longest): removed units; runs of repeated units over ``long_words`` words; words of the longest run.

    A run has its place, its number of units and how many of them stay.
    """
    keys = ["id", "__text"]
    # rows that repeat an id and a text have each unit once here; a window is one text
    units = found.dropDuplicates([*keys, "no"])
    run = F.col("no") - F.row_number().over(W.partitionBy(*keys).orderBy("no"))
    spans = F.collect_list(F.when(~F.col("stays"), F.struct("start", "end")))
    runs = units.withColumn("run", run).groupBy(*keys, "run").agg(
        spans.alias("spans"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"),
        F.count(F.lit(1)).alias("units"), F.count_if("stays").alias("kept"),
    )
    long_run = F.when(F.col("words") > long_words, F.struct("start", "end", "units", "kept"))
    return runs.groupBy(*keys).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.collect_list(long_run)).alias("runs"), F.max("words").alias("longest")
    )


def attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    same = rows["id"].eqNullSafe(found["id"]) & (rows["__text"] == found["__text"])
    return rows.join(found, same, "left").select(*[rows[c] for c in rows.columns], *[found[c] for c in found.columns[2:]])


def report(
    docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS
) -> DataFrame:
    """Per row: id, numbers of units and of removed ones, the removed places ``start:end``, and its passages.

    ``n_long_passages`` counts the runs of neighbouring units, all of which occur at two places or more, with
    over ``long_words`` words; ``long_passages`` tells them as ``start:end:units:kept units``, and
    ``longest_passage`` has the words of the longest run (0: none). Places are code points, ends exclusive. A null id
    ranks after all others. Rows that repeat an id and a text hold the same ranks: what is first in one is first in
    all, and they stay alike. Null, empty and blank texts have no units; an empty table gives none; other columns
    play no part.
    """
    scanned = materialise(scan(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", ["id"], unit, least_words))
    found = passages(repeated(scanned), long_words)
    out = attach(scanned.select("id", "__text", F.size("__units").cast("long").alias("n_units")), found)
    spans, runs = F.coalesce("spans", F.array()), F.coalesce("runs", F.array())
    told = lambda s, *names: F.concat_ws(":", *(s[n].cast("string") for n in names))
    return out.select(
        F.col("id").alias(id), "n_units", F.size(spans).cast("long").alias("n_removed"),
        F.concat_ws(",", F.transform(spans, lambda s: told(s, "start", "end"))).alias("removed"),
        F.size(runs).cast("long").alias("n_long_passages"),
        F.concat_ws(",", F.transform(runs, lambda s: told(s, "start", "end", "units", "kept"))).alias("long_passages"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_passage"),
    )


def remove(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with repeated units cut from ``text``, and ``kept_spans``: the original places of what stays.

    A unit goes with the break after it (the last one with the break before it). Null texts stay.
    """
    kept = replacing(docs, ["kept_spans"])
    plain = kept.select(F.col(id).alias("id"), F.col(text).alias("text"))
    found = repeats(repeated(materialise(scan(plain, "text", ["id"], unit, least_words))))
    marked = scan(kept, text, kept.columns, unit, least_words).drop("__units")
    same = marked[id].eqNullSafe(found["id"]) & (marked["__text"] == found["__text"])
    joined = marked.join(found, same, "left").select(*[marked[c] for c in kept.columns], found["spans"].alias("__spans"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = with_columns(kept, [("kept_spans", joined.schema["__spans"].dataType)])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                values, places = piece.column(text).to_pylist(), []
                for i, spans in enumerate(piece.column("__spans").to_pylist()):
                    x = values[i] or ""
                    stays, at = [], 0
                    for s in spans or ():
                        after = BREAKS[unit].match(x, s["end"])
                        stays.append((at, s["start"]))
                        at = after.end() if after else s["end"]
                    stays = [(a, b) for a, b in [*stays, (at, len(x))] if a < b]
                    if spans:
                        values[i] = "".join(x[a:b] for a, b in stays)
                    places.append([{"start": a, "end": b} for a, b in stays])
                columns = {n: c for n, c in zip(piece.schema.names, piece.columns) if n != "__spans"}
                columns |= {text: pa.array(values, pa.string()), "kept_spans": pa.array(places, span)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, schema)


#: Odd multiplier of the hashes of pieces, a fixed value without meaning.
MIX = np.uint64(0x9E3779B97F4A7C15)


def anchors(words: list[bytes], size: int) -> np.ndarray:
    """Per window of ``size`` words the least hash of its pieces; equal windows have the same, others may."""
    piece = min(PIECE, size)
    n = len(words) - piece + 1
    if len(words) < size:
        return np.zeros(0, np.int64)
    values = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    least = np.zeros(n, np.uint64)
    for k in range(piece):
        least = (least + values[k : k + n] + np.uint64(1)) * MIX
        least ^= least >> np.uint64(29)
    wide = 1
    while wide < size - piece + 1:
        step = min(wide, size - piece + 1 - wide)
        least = np.minimum(least[:-step], least[step:])
        wide += step
    return least.view(np.int64)


def scan_windows(docs: DataFrame, size: int) -> DataFrame:
    """(id, __text, n_words, first, last, anchors): where a text's words begin and end, and the distinct anchors of its windows."""
    kept = docs.select("id", "__text")
    schema = with_columns(kept, [("n_words", T.LongType()), ("first", T.IntegerType()), ("last", T.IntegerType()), ("anchors", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                values = strings(piece, "text")
                words = [x.encode().lower().split() for x in values]
                yield append(piece.select(["id", "__text"]), {
                    "n_words": pa.array([len(w) for w in words], pa.int64()),
                    "first": pa.array([len(x) - len(x.lstrip(WHITE)) for x in values], pa.int32()),
                    "last": pa.array([len(x.rstrip(WHITE)) for x in values], pa.int32()),
                    "anchors": pa.array([np.unique(anchors(w, size)) for w in words], pa.list_(pa.int64())),
                })

    return docs.mapInArrow(run, schema)


def windows(docs: DataFrame, size: int) -> DataFrame:
    """(__text, no, start, end, digest): the windows of ``size`` words whose anchor is in ``wanted``."""
    fields = [pa.field("__text", pa.binary()), pa.field("no", pa.int32()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("digest", pa.binary())]

    def run(batches):
        rows = []

        def told():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(fields)], schema=pa.schema(fields))

        for batch in batches:
            for piece in pieces(batch):
                for key, x, wanted in zip(piece.column("__text").to_pylist(), strings(piece, "text"), piece.column("wanted").to_pylist()):
                    words = x.encode().lower().split()
                    spans = [m.span() for m in WORD.finditer(x)]
                    plain, at = b" ".join(words), np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).tolist()
                    for i in np.flatnonzero(np.isin(anchors(words, size), wanted)).tolist():
                        digest = hashlib.blake2b(plain[at[i] : at[i + size] - 1], digest_size=16).digest()
                        rows.append((key, i, spans[i][0], spans[i + size - 1][1], digest))
                    if len(rows) >= STEP_WINDOWS:
                        yield told()
                        rows.clear()
        yield told()

    return docs.mapInArrow(run, "__text binary, no int, start int, end int, digest binary")


def in_two_texts(rows: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` that rows of two texts or more have."""
    return rows.groupBy(key).agg(F.min("__text").alias("a"), F.max("__text").alias("b")).filter(F.col("a") != F.col("b")).select(key)


def shared(docs: DataFrame, id: str = "doc_id", text: str = "text", long_words: int = LONG_WORDS) -> DataFrame:
    """Per row: id, number of words, and the passages of over ``long_words`` words that another document has too.

    They may begin and end within a line. Words are parted by white space, A-Z in lower case. A window of
    ``long_words + 1`` words is shared if two documents hold it; windows that overlap or meet make one
    passage, though other documents may hold only parts of it. ``passages`` tells them as ``start:end:words``
    (code points, ends exclusive), first holders included; ``longest_passage`` has the words of the longest (0: none).
    A null id is one id; rows that repeat an id are one document if their texts are alike, else two. Null, empty
    and blank texts have no words; an empty table gives none; other columns play no part.
    """
    size = long_words + 1
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(body.cast("binary"), 256), 1, 32))
    plain = docs.select(F.col(id).alias("id"), body.alias("text"), digest.alias("__text"))
    scanned = written(scan_windows(plain, size), "anchors")

    holder = F.struct(F.col("id").isNull().alias("no_id"), "id")
    texts = scanned.groupBy("__text").agg(F.min(holder).alias("a"), F.max(holder).alias("b"))
    copied = texts.filter(~F.col("a").eqNullSafe(F.col("b"))).select("__text", F.lit(True).alias("copied"))
    named = scanned.dropDuplicates(["__text"]).select("__text", F.explode("anchors").alias("anchor"))
    wanted = named.join(in_two_texts(named, "anchor"), "anchor").groupBy("__text").agg(F.collect_list("anchor").alias("wanted"))

    # one row per text is enough: that of the least id
    once = wanted.join(texts.select("__text", F.col("a.id").alias("id")), "__text")
    same = plain["id"].eqNullSafe(once["id"]) & (plain["__text"] == once["__text"])
    cut = written(windows(plain.join(once, same).select(plain["__text"], plain["text"], once["wanted"]), size), "windows")
    # written, so that the join meets nothing but shuffled rows and Spark can split those of a hot window
    met = written(in_two_texts(cut, "digest"), "digests")
    held = cut.join(met, "digest").select("__text", "no", "start", "end")

    by_text = W.partitionBy("__text").orderBy("no")
    parted = (F.col("no") - F.lag("no").over(by_text) > size).cast("int")
    runs = held.withColumn("parted", F.coalesce(parted, F.lit(0))).withColumn("run", F.sum("parted").over(by_text)).groupBy("__text", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("no") - F.min("no") + size).cast("long").alias("words")
    )
    # the list is as long as the text's passages
    parts = runs.groupBy("__text").agg(F.array_sort(F.collect_list(F.struct("start", "end", "words"))).alias("parts"))
    whole = F.array(F.struct(F.col("first").alias("start"), F.col("last").alias("end"), F.col("n_words").alias("words")))
    out = scanned.drop("anchors").join(parts, "__text", "left").join(copied, "__text", "left").withColumn(
        "parts", F.when(F.col("copied") & (F.col("n_words") >= size), whole).otherwise(F.coalesce("parts", F.array()))
    )
    told = F.transform("parts", lambda s: F.concat_ws(":", *(s[n].cast("string") for n in ("start", "end", "words"))))
    return out.select(
        F.col("id").alias(id), "n_words", F.size("parts").cast("long").alias("n_passages"), F.concat_ws(",", told).alias("passages"),
        F.coalesce(F.array_max(F.transform("parts", lambda s: s["words"])), F.lit(0)).cast("long").alias("longest_passage"),
    )


#: The report in SQL, for lines.
SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS no FROM doc),
placed AS (
  SELECT *, coalesce(sum(len(line) + 1) OVER (PARTITION BY r ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         string_split(trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w
  FROM line),
unit AS (
  SELECT r, doc_id, start, start + len(line) AS stop, len(w) AS words, array_to_string(w, ' ') AS g, row_number() OVER (PARTITION BY r ORDER BY no) AS no
  FROM placed WHERE w[1] <> ''),
ranked AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, start) AS k FROM unit),
held AS (SELECT *, max(k) OVER (PARTITION BY g) > 1 AS again FROM ranked),
run AS (
  SELECT r, min(start) AS a, max(stop) AS b, sum(words) AS words, count(*) AS n, count(*) FILTER (k = 1) AS kept
  FROM (SELECT *, no - row_number() OVER (PARTITION BY r ORDER BY no) AS run FROM held WHERE again) GROUP BY r, run),
long AS (
  SELECT r, max(words) AS longest, count(*) FILTER (words > 50) AS n_long,
         string_agg(CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT) || ':' || n || ':' || kept, ',' ORDER BY a) FILTER (words > 50) AS told
  FROM run GROUP BY r),
per_doc AS (
  SELECT r, count(*) AS n_units, count(*) FILTER (k > 1) AS n_removed,
         string_agg(CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start) FILTER (k > 1) AS removed
  FROM ranked GROUP BY r)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed,
       coalesce(n_long, 0) AS n_long_passages, coalesce(told, '') AS long_passages, CAST(coalesce(longest, 0) AS BIGINT) AS longest_passage
FROM doc LEFT JOIN per_doc USING (r) LEFT JOIN long USING (r)"""
