"""Personal data, and terms that give it away, removed by what the corpus says about them.

Base spans are e-mail and IP addresses, card and phone numbers, found by fixed patterns with checks.
Each found value is a protected entity c, each word of a document that holds it, however far away, a
term t. How strongly t reveals c is estimated from document counts over the whole corpus:

    information of the entity      IC(c)     = -ln p(c),   p(c) share of documents that hold c
    information the term gives     PMI(c; t) = ln p(c | t) / p(c),
                                   p(c | t)  = (documents with both + a p(c)) / (documents with t + a)

``a`` (``SMOOTHING``) stands for documents with t that hold c no more often than others do, so that one
document is weak evidence, not none and not proof. A term discloses the share PMI / IC. From
``GENERALISE`` on, all its mentions in documents with the entity are replaced by their kind of word, from
``REMOVE`` on they are taken out.

Two things keep the pairs few without losing any. Entities that stand in the same texts are told apart
by no term and count as one class. And as a pair is at most as frequent as its entity, a term in too many
documents cannot reach the share: such terms go before pairs are made. Copies of a text count as
documents, but are worked on once.

Document counts of terms are needed only for terms of documents with an entity. These go round as a
bitmap sized by their number (false hits only cost work: the counts are joined exactly afterwards).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.llm.common import append, aside, pieces, strings, with_columns
from gleanframe.session import materialise

KINDS = ("email", "ip", "card", "phone", "term")
SMOOTHING, GENERALISE, REMOVE = 1.0, 0.8, 0.95
#: Least and most bits of the bitmap of terms (1 and 32 megabytes); between them eight a term.
BITS, MOST_BITS = 1 << 23, 1 << 28

# The patterns of the base spans.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses, each looked for from its @, so that long runs of letters are read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        domain, start = DOMAIN.match(text, at + 1), at
        if domain:
            while start > end and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Dotted quadruples; of a longer chain of numbers the first four, the next four and so on."""
    out = []
    for m in NUMBERS.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    found = ((m.span(), digits_of(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 12)
    return [span for span, d in found if 12 <= len(d) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else []


FINDERS = (emails, addresses, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of all base spans, in order."""
    return sorted((a, k, b) for k, find in enumerate(FINDERS) for a, b in find(text))


def entity_of(kind: int, value: str) -> str:
    """Kind and value of an entity, written forms of one value brought together."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else digits_of(value)}"


def mentions(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that touch none of the (start, end) ``spans``, which are in order."""
    at, until = 0, 0
    for m in TERM.finditer(text):
        start, end = m.span()
        while at < len(spans) and spans[at][0] < end:
            until = max(until, spans[at][1])
            at += 1
        if until <= start:
            yield m[0].lower(), start, end


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
MARK = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("remove", T.BooleanType())])
ARROW_MARKS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())]))
#: ``__digest`` is null for texts without base spans.
FOUND = [("__digest", T.BinaryType()), ("__base", T.ArrayType(SPAN)), ("__entities", T.ArrayType(T.StringType())), ("__words", T.ArrayType(T.StringType()))]


def scan(docs: DataFrame, text: str, keep: list[str], words: bool = True) -> DataFrame:
    """Base spans of every whole text, and with ``words`` the entities and terms of texts that have some."""
    schema = with_columns(docs.select(*keep), FOUND)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                digests, bases, entities, terms = [], [], [], []
                for x in strings(piece, text):
                    spans = base_spans(x)
                    bases.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
                    digests.append(hashlib.blake2b(x.encode(), digest_size=16).digest() if spans else None)
                    listed = words and spans
                    entities.append(sorted({entity_of(k, x[a:b]) for a, k, b in spans}) if listed else None)
                    terms.append(sorted({t for t, _, _ in mentions(x, [(a, b) for a, _, b in spans])}) if listed else None)
                lists = pa.list_(pa.string())
                yield append(
                    piece.select(keep),
                    {"__digest": pa.array(digests, pa.binary()), "__base": pa.array(bases, ARROW_SPANS), "__entities": pa.array(entities, lists), "__words": pa.array(terms, lists)},
                )

    return docs.mapInArrow(run, schema)


def document_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, n_docs) of the given distinct ``terms`` over every whole text."""
    n_terms = terms.agg(F.approx_count_distinct("term")).first()[0]
    n_bits = min(MOST_BITS, max(BITS, 1 << (8 * n_terms).bit_length()))
    bit = F.crc32("term").bitwiseAND(F.lit(n_bits - 1))
    pages = (
        terms.select(F.shiftright(bit, 15).alias("page"), bit.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
        .groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    bits = bytearray(n_bits // 8)
    for r in pages:  # at most MOST_BITS / 32768 rows of 4 KB
        bits[r.page * 4096 : (r.page + 1) * 4096] = bytes(r.bits)
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def run(batches):
        wanted, counts, crc, mask = shared.value, {}, zlib.crc32, n_bits - 1
        for batch in batches:
            for piece in pieces(batch):
                for x in strings(piece, "text"):
                    for term in set(map(str.lower, set(TERM.findall(x)))):
                        h = crc(term.encode()) & mask
                        if wanted[h >> 3] >> (h & 7) & 1:
                            counts[term] = counts.get(term, 0) + 1
                if len(counts) > 200_000:
                    yield sent(counts)
                    counts = {}
        yield sent(counts)

    def sent(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(run, "term string, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("n_docs")).join(terms, "term", "left_semi")


def entity_classes(found: DataFrame) -> DataFrame:
    """(__digest, n, class, n_entity): each text with an entity, its copies, and the classes of its entities.

    Entities of the same texts are one class, known by two sums of the texts' hashes and their number;
    ``n_entity`` documents hold them.
    """
    held = materialise(found.filter("__digest is not null").select("__digest", F.explode("__entities").alias("entity")).groupBy("__digest", "entity").agg(F.count(F.lit(1)).alias("n")))
    mark = lambda seed: F.bit_xor(F.xxhash64("__digest", F.lit(seed)))
    each = held.groupBy("entity").agg(F.concat_ws(":", mark(1), mark(2), F.count(F.lit(1))).alias("class"), F.sum("n").alias("n_entity"))
    return held.join(each, "entity").select("__digest", "n", "class", "n_entity").distinct()


def disclosing_words(docs: DataFrame, text: str, found: DataFrame, smoothing: float, generalise: float, remove: float) -> DataFrame:
    """(__digest, __told): the terms of each distinct text to change, each with whether it goes altogether."""
    total = found.count()
    rate = F.col("n_entity") / F.lit(float(max(total, 1)))
    # an entity that every document holds has no information to disclose
    classes = entity_classes(found).filter(F.col("n_entity") < total)
    most = (F.col("n_entity") + smoothing * rate) / F.pow(rate, F.lit(1 - generalise)) - smoothing
    # a hair above, as the share itself is held against the level below
    classes = materialise(classes.withColumn("most", most * (1 + 1e-9) + 1e-9))
    words = found.filter("__digest is not null").select("__digest", F.explode("__words").alias("term"))
    counts = materialise(document_counts(docs, text, words.select("term").distinct()))
    rarest = classes.agg(F.max("most")).first()[0] or 0.0
    rare = words.join(counts.filter(F.col("n_docs") <= rarest), "term").distinct()
    pairs = materialise(classes.join(rare, "__digest").filter(F.col("n_docs") <= F.col("most")).drop("most"))
    joint = pairs.groupBy("class", "term").agg(F.sum("n").alias("joint"), F.max("n_docs").alias("n_docs"), F.max("n_entity").alias("n_entity"))
    given = (F.col("joint") + smoothing * rate) / (F.col("n_docs") + smoothing)
    told = joint.withColumn("share", F.round(F.ln(given / rate) / -F.ln(rate), 9)).filter(F.col("share") >= generalise)
    hits = pairs.select("__digest", "class", "term").join(told.select("class", "term", "share"), ["class", "term"])
    each = hits.groupBy("__digest", "term").agg((F.max("share") >= remove).alias("remove"))
    # a list of words of one text, as long as the text at most
    return each.groupBy("__digest").agg(F.array_sort(F.collect_list(F.struct("term", "remove"))).alias("__told"))


def attach(found: DataFrame, told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` with ``__told``: texts without base spans, which take no part in the join, and the others."""
    none = F.lit(None).cast(told.schema["__told"].dataType).alias("__told")
    plain = found.filter("__digest is null").select(*found.columns, none)
    held = found.filter("__digest is not null").join(told, "__digest", "left").select(*found.columns, "__told")
    return plain, held


def judged(docs: DataFrame, text: str, smoothing: float, generalise: float, remove: float) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__base`` spans and ``__told``, the terms to change: rows without base spans, and the others."""
    found = materialise(scan(docs.select(F.col(text).alias("text")), "text", []))
    told = disclosing_words(docs, text, found, smoothing, generalise, remove)
    return attach(scan(docs, text, docs.columns, words=False), told)


def marks(text: str, base: list[dict], told: list[dict] | None) -> list[dict]:
    """The mentions of the terms ``told`` in a text, in order."""
    if not told:
        return []
    gone = {t["term"]: t["remove"] for t in told}
    return [{"start": s, "end": e, "remove": gone[t]} for t, s, e in mentions(text, [(b["start"], b["end"]) for b in base]) if t in gone]


def find(
    docs: DataFrame, id: str = "doc_id", text: str = "text", smoothing: float = SMOOTHING, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """Per row: id, ``__base`` spans and ``__terms`` to generalise or remove (none: an empty list).

    Null counts as empty and has no spans. Repeated rows count as documents of the corpus, and each
    gets the same spans. Places are code points, ends exclusive. An empty table gives none; other
    columns play no part.
    """
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    without, held = judged(plain, "text", smoothing, generalise, remove)
    ready = without.unionByName(held)
    schema = T.StructType([plain.schema["id"], T.StructField("__base", T.ArrayType(SPAN)), T.StructField("__terms", T.ArrayType(MARK))])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                rows = zip(strings(piece, "text"), piece.column("__base").to_pylist(), piece.column("__told").to_pylist())
                terms = pa.array([marks(*row) for row in rows], ARROW_MARKS)
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("__base"), terms], names=schema.names)

    return ready.mapInArrow(run, schema).withColumnRenamed("id", id)


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: numbers of base spans, their digest, and all spans as ``kind:start:end``."""
    found = find(docs, id, text, **options)
    kind_at = F.array(*[F.lit(k) for k in KINDS])
    terms = F.transform("__terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    ordered = F.transform(
        F.array_sort(F.transform(F.concat("__base", terms), lambda s: F.struct(s["start"].alias("a"), F.array_position(kind_at, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("kind")))),
        lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["e"].cast("string")),
    )
    base = F.transform("__base", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col(id),
        *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", ordered).alias("spans"),
        F.size("__terms").cast("long").alias("n_terms"),
    )


def rewritten(text: str, base: list[dict], terms: list[dict] | None) -> str:
    """Text with base spans as ``[KIND]``, generalised terms as ``[NAME]`` or ``[WORD]``, removed ones gone."""
    marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base]
    for s in terms or ():
        kind = "" if s["remove"] else "[NAME]" if text[s["start"]].isupper() else "[WORD]"
        marks.append((s["start"], s["end"], kind))
    out, at = [], 0
    for a, b, mark in sorted(marks):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)  # of base spans that overlap, the first names the whole
    return "".join([*out, text[at:]])


def sanitise(
    docs: DataFrame, text: str = "text", smoothing: float = SMOOTHING, generalise: float = GENERALISE, remove: float = REMOVE
) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``; other columns as before, whatever their names.

    Texts without base spans, null and empty ones too, stay as they are and are not shuffled. Repeated
    rows count as documents each and are changed alike. An empty table gives an empty table.
    """
    plain, back = aside(docs, text)
    without, marked = judged(plain, text, smoothing, generalise, remove)
    place = marked.columns.index(text)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                values = piece.column(text).to_pylist()
                for i, (base, told) in enumerate(zip(piece.column("__base").to_pylist(), piece.column("__told").to_pylist())):
                    if base:
                        values[i] = rewritten(values[i], base, marks(values[i], base, told))
                column = pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays([column if k == place else c for k, c in enumerate(piece.columns)], names=piece.schema.names)

    # rows without base spans go by this step: a task with two Python steps has two workers, which stay and fill their memos in turn
    return back(without.unionByName(marked.mapInArrow(run, marked.schema)))
