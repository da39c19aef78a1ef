"""Quality by importance resampling: hashed n-gram models of good and raw text, Gumbel top-k.

Words and pairs of neighbouring words are hashed into ``buckets`` each. The raw model counts every
document; the target model counts a bounded sample of documents labelled good (``LABELLED`` of them,
the documented bound on what is fitted). A document's weight is the ratio of the two models over its
n-grams. When a document is scored its own counts are taken out of both models, so labelled and
unlabelled documents are judged alike. The log ratio of a long document is brought down to
``LENGTH`` n-grams, so that documents are compared at one length.

``k`` documents are drawn without replacement, with chances in proportion to their weights, by adding
Gumbel noise to the log weights and keeping the k largest sums. ``k`` is the number of documents whose
log weight reaches the level that all but ``FALSE_REJECTS`` of the labelled good documents outside
the target model reach. The k-th largest sum is found by counting in ever narrower ranges.

Toxic documents are not drawn. A few toxic words vanish in an average over the text, so a document's
toxic evidence is that of its strongest word: the lower bound (``SIGMAS`` standard errors) of the log
ratio of the shares of toxic and of other labelled documents that hold the word. The level above which
a document counts as toxic is the one that all but ``TOXIC_FALSE_REJECTS`` of the labelled non-toxic
documents outside that model stay under.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gleanframe.llm.common import append, aside, pieces, raw_bytes, with_columns, worker_cache
from gleanframe.session import materialise

BUCKETS = 1 << 16
#: Labelled good documents that are used: half make the target model, half set the level.
LABELLED = 40_000
FALSE_REJECTS = 0.002
LENGTH = 200
#: Counts a bucket has beforehand: raw, and target (spread like the raw model).
RAW_PRIOR, TARGET_PRIOR = 1.0, 3.0
#: Words whose hashes a worker remembers.
MEMO = 200_000
SEED = 17
#: Held-out non-toxic documents that may count as toxic, standard errors, and words of the toxic model (the strongest).
TOXIC_FALSE_REJECTS, SIGMAS, TOXIC_TERMS = 0.005, 2.0, 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def n_grams(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each word, then of each pair (numbered after the words' buckets)."""
    words, hashes = text.lower().split(), worker_cache("word hashes", WordHashes)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        pair ^= pair >> np.uint64(32)
    size = np.uint64(buckets)
    return np.concatenate([h % size, pair % size + size]).astype(np.int64)


class Models:
    """The two models as counts; row 0 raw, row 1 target."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.buckets = counts, counts.shape[1] // 2
        self.totals = np.stack([counts[:, : self.buckets].sum(axis=1), counts[:, self.buckets :].sum(axis=1)], axis=1)

    def log_ratio(self, text: bytes, in_target: bool, length: int) -> float:
        grams = n_grams(text, self.buckets)
        if not len(grams):
            return 0.0
        at, own = np.unique(grams, return_counts=True)
        pairs = (at >= self.buckets).astype(int)
        mine = np.array([own[pairs == 0].sum(), own[pairs == 1].sum()])
        raw = (self.counts[0, at] - own + RAW_PRIOR) / (self.totals[0] - mine + RAW_PRIOR * self.buckets)[pairs]
        prior = TARGET_PRIOR * self.buckets
        target = (self.counts[1, at] - own * in_target + prior * raw) / (self.totals[1] - mine * in_target + prior)[pairs]
        return float((own * np.log(target / raw)).sum() * min(1.0, length / len(grams)))


class ToxicModel:
    """Hashes of words with the numbers of toxic and of other labelled documents that hold them."""

    def __init__(self, words: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int):
        order = np.argsort(words)
        self.words, self.toxic, self.clean = words[order], toxic[order], clean[order]
        self.n_toxic, self.n_clean = n_toxic, n_clean

    def evidence(self, text: bytes, label: int | None) -> float:
        """That of the strongest word, 0 without any; ``label`` is a document's own one in the model, taken out of it."""
        hashes = worker_cache("word hashes", WordHashes)
        own = np.unique(np.fromiter(map(hashes.__getitem__, set(text.lower().split())), np.uint64)).view(np.int64)
        at = np.minimum(np.searchsorted(self.words, own), max(0, len(self.words) - 1))
        at = at[self.words[at] == own] if len(self.words) else at[:0]
        if not len(at):
            return 0.0
        t, c = self.toxic[at] - (label == 1), self.clean[at] - (label == 0)
        return max(0.0, float(lower_bound(t, c, self.n_toxic - (label == 1), self.n_clean - (label == 0)).max()))


def lower_bound(toxic, clean, n_toxic: int, n_clean: int):
    """Of the log ratio of the two shares of documents that hold a word."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return ratio - SIGMAS * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def toxic_sample(labels: DataFrame, id: str, toxic: Column, limit: int) -> tuple[dict, dict]:
    """Two dicts of id to label (1 toxic, 0 never said to be): for the model and for the level; ``limit`` of each label."""
    rows = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(
        F.max(F.coalesce(toxic.cast("int"), F.lit(-1))).alias("label"), F.min(F.coalesce(toxic.cast("int"), F.lit(-1))).alias("least")
    )
    fitted, held = {}, {}
    for label, least in ((1, F.lit(True)), (0, F.col("least") == 0)):
        known = rows.filter((F.col("label") == label) & least).select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(limit).collect()
        fitted |= {r.id: label for r in known[::2]}
        held |= {r.id: label for r in known[1::2]}
    return fitted, held


def fit_toxic(docs: DataFrame, fitted: dict, id: str, text: str, limit: int = TOXIC_TERMS) -> ToxicModel | None:
    """Count the words of the ``fitted`` documents; None if either label has none."""
    if set(fitted.values()) != {0, 1}:
        return None
    chosen = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches):
        labels, counts = chosen.value, {}
        for batch in batches:
            batch = batch.filter(pa.array([i in labels for i in batch.column("id").to_pylist()], pa.bool_()))
            for piece in pieces(batch):
                for i, x in zip(piece.column("id").to_pylist(), raw_bytes(piece, "text")):
                    # the null word counts the documents
                    for word in (None, *{xxhash.xxh64_intdigest(w) for w in set(x.lower().split())}):
                        counts.setdefault(word, [0, 0])[labels[i]] += 1
            if len(counts) > 200_000:
                yield sent(counts)
                counts = {}
        yield sent(counts)

    def sent(counts):
        words = [w if w is None or w < 1 << 63 else w - (1 << 64) for w in counts]
        clean, toxic = zip(*counts.values()) if counts else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["word", "toxic", "clean"])

    parts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, "word long, toxic long, clean long")
    words = materialise(parts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = words.filter("word is null").first()
    if total is None or not total.toxic or not total.clean:
        return None
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    bound = F.ln(t / (total.toxic + 1)) - F.ln(c / (total.clean + 1)) - SIGMAS * F.sqrt(1 / t + 1 / c)
    strong = words.filter("word is not null").withColumn("bound", bound).filter("bound > 0").orderBy(F.desc("bound"), "word").limit(limit).toArrow()
    return ToxicModel(*[strong.column(n).to_numpy() for n in ("word", "toxic", "clean")], total.toxic, total.clean)


def good_sample(labels: DataFrame, id: str, good: Column, limit: int) -> tuple[frozenset, frozenset]:
    """Two sets of ids labelled good and never otherwise: for the target model and for the level."""
    rows = (
        labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id"))
        .agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good")
        .select("id", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(limit).collect()
    )
    return frozenset(r.id for r in rows[::2]), frozenset(r.id for r in rows[1::2])


def fit(docs: DataFrame, target: frozenset, id: str, text: str, buckets: int = BUCKETS) -> Models:
    """Count both models in one pass; a task sends its sums, not its documents."""
    chosen = docs.sparkSession.sparkContext.broadcast(target)

    def run(batches):
        counts, ids = np.zeros((2, 2 * buckets), np.int64), chosen.value
        for batch in batches:
            for piece in pieces(batch):
                for i, x in zip(piece.column("id").to_pylist(), raw_bytes(piece, "text")):
                    own = np.bincount(n_grams(x, buckets), minlength=2 * buckets) if len(x) > 1 << 18 else None
                    if own is None:
                        at, n = np.unique(n_grams(x, buckets), return_counts=True)
                        counts[0, at] += n
                        if i in ids:
                            counts[1, at] += n
                    else:
                        counts[0] += own
                        if i in ids:
                            counts[1] += own
        at = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "raw", "target"])

    parts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, "bucket long, raw long, target long")
    # a row for each bucket at most
    rows = parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, 2 * buckets))
    for k, name in enumerate(("raw", "target")):
        counts[k, rows.column("bucket").to_numpy()] = rows.column(name).to_numpy()
    return Models(counts)


def log_ratios(
    docs: DataFrame, models: Models, target: frozenset, id: str, text: str, column: str, length: int = LENGTH,
    keep: list[str] | None = None, toxic: tuple[ToxicModel | None, dict] | None = None,
) -> DataFrame:
    """Add the log weight of every whole text, 0 for texts without words; with ``toxic`` also ``__toxic``, its toxic evidence."""
    names = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((models, target, toxic))

    def run(batches):
        fitted, ids, judged = shared.value
        for batch in batches:
            for piece in pieces(batch):
                rows = list(zip(piece.column(id).to_pylist(), raw_bytes(piece, text)))
                columns = {column: pa.array([fitted.log_ratio(x, i in ids, length) for i, x in rows], pa.float64())}
                if judged is not None:
                    model, known = judged
                    columns["__toxic"] = pa.array([model.evidence(x, known.get(i)) if model else 0.0 for i, x in rows], pa.float64())
                yield append(piece.select(names), columns)

    added = [(column, T.DoubleType())] + ([] if toxic is None else [("__toxic", T.DoubleType())])
    return docs.mapInArrow(run, with_columns(docs.select(*names), added))


def gumbel(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that depends on the id alone, so that lost tasks draw it again alike."""
    u = (F.shiftrightunsigned(F.xxhash64(id, F.lit(seed)), 12).cast("double") + 0.5) * F.lit(2.0**-52)
    return -F.ln(-F.ln(u))


def kth_largest(values: DataFrame, column: str, k: int, width: int = 1024) -> float:
    """The k-th largest value, by counts over ``width`` ranges, narrowed until one value is left.

    Only counts reach the driver. ``values`` should be stored, as it is read some five times.
    """
    low, high, above = *values.agg(F.min(column), F.max(column)).first(), 0
    while low < high:
        step = (high - low) / width
        if low + step <= low or not math.isfinite(step):
            break
        place = F.least(F.lit(width - 1), F.floor((F.col(column) - low) / F.lit(step)))
        inside = values.filter((F.col(column) >= low) & (F.col(column) <= high))
        found = inside.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(found.collect(), key=lambda r: -r.p):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
    return high


def values_of(scored: DataFrame, id: str, ids: frozenset, value: Column) -> list[float]:
    """Sorted ``value`` of the chosen ids, an aggregate over the rows that repeat an id."""
    shared = scored.sparkSession.sparkContext.broadcast(ids)

    def chosen(batches):
        for batch in batches:
            yield batch.filter(pa.array([i in shared.value for i in batch.column(id).to_pylist()], pa.bool_()))

    # one value per labelled document of the bounded sample
    return sorted(r.v for r in scored.mapInArrow(chosen, scored.schema).groupBy(id).agg(value.alias("v")).collect())


def draw(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", good: Column | None = None, k: int | None = None,
    labelled: int = LABELLED, buckets: int = BUCKETS, length: int = LENGTH, false_rejects: float = FALSE_REJECTS,
    toxic: Column | None = None, toxic_false_rejects: float = TOXIC_FALSE_REJECTS,
) -> tuple[DataFrame, tuple, Models, frozenset, tuple]:
    """Log weights ``log_ratio``, sums ``draw_key`` and toxic evidence ``__toxic`` of all rows; the least sum
    and the most evidence of a row that is drawn; and what was fitted."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0) if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    target, level_ids = good_sample(labels, id, good, labelled)
    models = fit(docs, target, id, text, buckets)
    fitted, held = toxic_sample(labels, id, toxic, labelled)
    judged = (fit_toxic(docs, fitted, id, text), fitted)
    plain = docs.select(F.col(id), F.col(text))
    scored = log_ratios(plain, models, target, id, text, "log_ratio", length, keep=[id], toxic=judged)
    scored = materialise(scored.withColumn("draw_key", F.col("log_ratio") + gumbel(F.col(id))))
    clean = values_of(scored.select(id, "__toxic"), id, frozenset(i for i, t in held.items() if not t), F.max("__toxic")) if judged[0] else []
    most = clean[len(clean) - 1 - int(len(clean) * toxic_false_rejects)] if clean else math.inf
    allowed = scored.filter(F.col("__toxic") <= F.lit(most))
    n = allowed.count()
    if k is None and n:
        # a repeated id gives its lowest
        level = values_of(scored.select(id, "log_ratio"), id, level_ids, F.min("log_ratio"))
        least = level[int(len(level) * false_rejects)] if level else -math.inf
        k = allowed.filter(F.col("log_ratio") >= least).count()
    bound = kth_largest(allowed, "draw_key", k) if n and k else math.inf
    return scored, (bound, most), models, target, judged


def resample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: its id, log weight, sum with noise, and whether it is drawn (``kept``).

    Null and empty texts weigh 1 (log 0). Rows with an equal sum, such as repeated rows of an id, are
    drawn together, so more than k may be. Toxic documents are not drawn, and not counted in k. Null ids share their noise and are never labelled. Without
    labels the two models agree and every document is drawn. An empty table gives none.
    """
    scored, (least, most), *_ = draw(docs, labels, id, text, **options)
    return scored.withColumn("kept", (F.col("draw_key") >= F.lit(least)) & (F.col("__toxic") <= F.lit(most))).drop("__toxic")


def keep_drawn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs`` with their columns, whatever their names: weights are computed again, no text is shuffled.

    Rules for nulls, empty texts, ties, repeated rows and empty tables are those of ``resample``.
    """
    _, (least, most), models, target, judged = draw(docs, labels, id, text, **options)
    plain, back = aside(docs, id, text)
    marked = log_ratios(plain, models, target, id, text, "__log_ratio", options.get("length", LENGTH), toxic=judged)
    marked = marked.withColumn("__draw_key", F.col("__log_ratio") + gumbel(F.col(id)))
    return back(marked.filter((F.col("__draw_key") >= F.lit(least)) & (F.col("__toxic") <= F.lit(most))))
