"""Quality rules whose cutoffs are chosen under a bound on falsely rejected documents.

A rule rejects a document whose signal is over a cutoff. Labelled documents are the holdout, parted by
a digest of their id. Within each stratum (a language, say) the tuning half makes a sequence of cutoff
vectors, from the mildest on: at each of ``LEVELS``, every rule has its tightest cutoff of a fixed grid
that rejects at most that share of the half's good documents. The other half tests the vectors in
this order: a test asks whether so few good documents are rejected *by any rule* that a true rate above
the limit is ruled out, by the exact binomial tail

    P(Binomial(n, limit) <= k) <= level,        n good documents, k of them rejected.

The first vector that fails ends the sequence (fixed-sequence testing, so it needs no further
correction); the last that passed is used. The level is divided by the number of strata (Bonferroni), so
with probability ``1 - DELTA`` no stratum's rules together reject more than ``ALPHA`` of its good
documents. As rules are tested together, some 90 good documents in the testing half are enough for four
strata. A stratum without enough labels rejects nothing.

Everything is DataFrame and SQL functions. Signals are computed once per document and stored (a few
numbers each); texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import materialise

ALPHA, DELTA = 0.05, 0.05
#: Base rule: fewest words, and the largest share of repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20

#: Shares of the tuning half's good documents, per thousand, that one rule may reject.
LEVELS = (0, 2, 5, 10, 15, 20, 30)

#: Characters that count as symbols, and the ASCII white space that parts words.
SPACE = r"\x20\x09-\x0D"

#: Rule: (signal, cutoffs from the mildest on).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / word_chars", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02)),
    "capitals": ("n_capitals / word_chars", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "shouts": ("n_shouts / n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeated_lines": ("n_dup_lines / n_words", (0.3, 0.2, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "repeated_words": ("n_repeat_words / n_words", (0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05)),
    "long_words": ("word_chars / n_words", (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0)),
}


def signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add counts of every whole text: words, their code points, symbols, capitals, exclamation marks,
    repeated lines, and words in five-word windows that come twice or more.

    Null counts as empty. ``docs`` may have other columns, not those named here.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    cut = docs.withColumns(
        {
            # white space to single spaces first, so that parting is a plain split
            "__words": F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != ""),
            "__lines": F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_capitals": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long"),
            "n_shouts": F.length(F.regexp_replace(t, "[^!]+", "")).cast("long"),
        }
    )
    w = "__words"
    # one hash per window tells whether any comes twice; only then are the windows themselves compared
    window = "xxhash64(w, __words[i + 1], __words[i + 2], __words[i + 3], __words[i + 4])"
    hashed = cut.withColumn("__hashes", F.expr(f"transform(slice({w}, 1, greatest(size({w}) - 4, 0)), (w, i) -> {window})"))
    return hashed.select(
        *docs.columns,
        F.size(w).cast("long").alias("n_words"),
        F.expr(f"aggregate({w}, 0L, (n, w) -> n + length(w))").alias("word_chars"),
        "n_symbols", "n_capitals", "n_shouts",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__hashes")) == F.size("__hashes"), 0).otherwise(F.expr(REPEATED_WORDS)).cast("long").alias("n_repeat_words"),
    )


#: Windows sorted with their places; those equal to a neighbour are repeated; the places they cover are
#: counted once, five from each. ``transform(array(x), s -> ...)[0]`` gives x a name.
REPEATED_WORDS = """
transform(array(array_sort(transform(sequence(0, size(__words) - 5),
    i -> struct(concat_ws(' ', slice(__words, i + 1, 5)) AS g, i AS p)))),
  s -> aggregate(
    array_sort(transform(
      filter(s, (x, i) -> (i > 0 AND s[greatest(i - 1, 0)].g = x.g) OR (i < size(s) - 1 AND s[least(i + 1, size(s) - 1)].g = x.g)),
      x -> x.p)),
    named_struct('n', 0, 'till', 0),
    (a, p) -> named_struct('n', a.n + p + 5 - greatest(p, a.till), 'till', p + 5)).n)[0]"""


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def signal(rule: str) -> Column:
    """A rule's signal; 0 where its divisor is."""
    over, under = RULES[rule][0].split(" / ")
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(under).cast("double")), F.lit(0.0))


#: P(Binomial(n, limit) <= k): each term from the one before it, in logarithms.
TAIL = """
CASE WHEN k >= n * {limit} + 1 THEN 1.0D
ELSE aggregate(sequence(0, CAST(k AS INT)), named_struct('sum', 0.0D, 'term', n * ln(1.0D - {limit})),
  (a, i) -> named_struct('sum', a.sum + exp(a.term),
                         'term', a.term + ln((n - i) / (i + 1.0D)) + ln({limit} / (1.0D - {limit}))),
  a -> a.sum) END"""


def thresholds(
    signalled: DataFrame, labels: DataFrame, id: str = "doc_id", stratum: str = "lang", good: str = "quality",
    alpha: float = ALPHA, delta: float = DELTA,
) -> DataFrame:
    """(stratum, level, cutoffs, n, k, tail, used): every test, and the chosen vector of each stratum.

    ``cutoffs`` maps the rules of a level to their cutoffs. A document counts as good if all its labels
    say so. Documents that fail the base rule are not judged, and so neither tune nor test. A null
    stratum is one of its own.
    """
    known = labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(good).alias("good")).filter("good = 1")
    held = signalled.filter(~base_failed()).join(known.select("id"), signalled[id] == known["id"], "left_semi").select(
        F.col(stratum).alias("stratum"), (F.md5(F.col(id).cast("string")) < "8").alias("tunes"), *[signal(r).alias(f"signal_{r}") for r in RULES]
    )
    grid = F.array(
        *[
            F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.col(f"signal_{r}") > c).alias("rejected"))
            for r, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs)
        ]
    )
    counts = (
        held.filter("tunes").select("stratum", F.inline(grid)).groupBy("stratum", "rule", "step", "cutoff")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("k"))
    )
    levels = F.array(*[F.struct(F.lit(t).alias("level"), F.lit(s).alias("share")) for t, s in enumerate(LEVELS)])
    allowed = counts.select("*", F.inline(levels)).filter(1000 * F.col("k") <= F.col("share") * F.col("n"))
    tightest = allowed.groupBy("stratum", "level", "rule").agg(F.max_by("cutoff", "step").alias("cutoff"))
    # at most a row per stratum and level, and a cutoff in it per rule
    vectors = materialise(tightest.groupBy("stratum", "level").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")))
    tried = vectors.groupBy(F.col("stratum").alias("s")).agg(F.collect_list(F.struct("level", "cutoffs")).alias("vectors"))
    over = [F.coalesce(F.col(f"signal_{r}") > F.try_element_at("cutoffs", F.lit(r)), F.lit(False)) for r in RULES]
    tests = (
        held.filter("not tunes").join(tried, F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", *[f"signal_{r}" for r in RULES], F.inline("vectors"))
        .groupBy("stratum", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains(F.array(*over), True)).alias("k"))
    )
    tests = materialise(tests)
    strata = tests.select("stratum").distinct().agg(F.count(F.lit(1))).scalar()
    tested = tests.withColumn("tail", F.expr(TAIL.format(limit=f"{alpha!r}D"))).withColumn("passed", F.col("tail") <= F.lit(delta) / strata)
    fails = tested.filter(~F.col("passed")).groupBy("stratum").agg(F.min("level").alias("fail"))
    ahead = tested.join(fails.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s")), "left").filter("fail IS NULL OR level < fail")
    last = ahead.groupBy(F.col("stratum").alias("s")).agg(F.max("level").alias("last"))
    v = vectors.select(F.col("stratum").alias("vs"), F.col("level").alias("vl"), "cutoffs")
    placed = tested.join(last, F.col("stratum").eqNullSafe(F.col("s")), "left").join(v, F.col("stratum").eqNullSafe(F.col("vs")) & (F.col("level") == F.col("vl")))
    return placed.select("stratum", "level", "cutoffs", "n", "k", "tail", F.coalesce(F.col("level") == F.col("last"), F.lit(False)).alias("used"))


def judge(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang", **options
) -> DataFrame:
    """Per row: id, the base counts, ``base_failed``, ``failed_rules`` and ``kept``.

    Null texts have no words and fail the base rule, as empty ones do. Repeated rows are judged
    alike and weigh as often as they occur. Labels of unknown ids are not used; without labels only
    the base rule rejects. An empty table gives none.
    """
    plain = docs.select(F.col(id).alias("id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    rows = materialise(signals(plain).drop("text"))
    tested = thresholds(rows, labels.select(F.col(id).alias("id"), *[c for c in labels.columns if c.lower() not in ("id", id.lower())]), "id", "stratum", **options)
    chosen = tested.filter("used").select(F.col("stratum").alias("s"), "cutoffs")
    joined = rows.join(chosen, F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = F.array_compact(F.array(*[F.when(signal(r) > F.try_element_at("cutoffs", F.lit(r)), F.lit(r)) for r in RULES]))
    return joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.concat_ws(",", "failed_rules").alias("failed_rules"), (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
    )


def sql() -> str:
    """The same for DuckDB."""
    grid = ",\n".join(
        f"    {{'rule': '{r}', 'step': {step}, 'cutoff': CAST({c} AS DOUBLE), 'value': {s.split(' / ')[0]} / CAST(nullif({s.split(' / ')[1]}, 0) AS DOUBLE)}}"
        for r, (s, cutoffs) in RULES.items() for step, c in enumerate(cutoffs)
    )
    return rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM doc)),
twice AS (SELECT r, g FROM gram GROUP BY r, g HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM gram JOIN twice USING (r, g)) GROUP BY r),
counts AS (
  SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(length(regexp_replace(t, '[^!]+', '', 'g')) AS BIGINT) AS n_shouts,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc) LEFT JOIN cover USING (r)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counts),
tried AS (
  SELECT r, doc_id, lang, base_failed, x.rule, x.step, x.cutoff, coalesce(x.value, 0) > x.cutoff AS rejected
  FROM (SELECT *, unnest([
{grid}]) AS x FROM judged)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
half AS (SELECT *, md5(CAST(doc_id AS VARCHAR)) < '8' AS tunes FROM tried WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
tuned AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (rejected) AS k FROM half WHERE tunes GROUP BY ALL),
vector AS (
  SELECT lang, level, rule, arg_max(cutoff, step) AS cutoff
  FROM tuned, (SELECT unnest({list(LEVELS)}) AS share, unnest(range({len(LEVELS)})) AS level) WHERE 1000 * k <= share * n GROUP BY ALL),
hit AS (
  SELECT half.lang, level, r, bool_or(rejected) AS rejected FROM half
  JOIN vector ON half.lang IS NOT DISTINCT FROM vector.lang AND half.rule = vector.rule AND half.cutoff = vector.cutoff WHERE NOT tunes GROUP BY ALL),
held AS (SELECT lang, level, count(*) AS n, count(*) FILTER (rejected) AS k FROM hit GROUP BY ALL),
tested AS (
  SELECT lang, level, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA!r}) + (n - i) * ln(1 - {ALPHA!r})))
         <= {DELTA!r} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM held)) AS passed
  FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM held) GROUP BY ALL),
chosen AS (
  SELECT lang, max(level) AS level FROM (SELECT *, min(level) FILTER (NOT passed) OVER (PARTITION BY lang) AS fail FROM tested)
  WHERE fail IS NULL OR level < fail GROUP BY lang),
failing AS (
  SELECT DISTINCT r, tried.rule FROM tried JOIN vector ON tried.rule = vector.rule AND tried.lang IS NOT DISTINCT FROM vector.lang AND tried.cutoff = vector.cutoff
  JOIN chosen ON chosen.lang IS NOT DISTINCT FROM vector.lang AND chosen.level = vector.level WHERE rejected),
named AS (SELECT r, string_agg(rule, ',' ORDER BY list_position([{", ".join(repr(r) for r in RULES)}], rule)) AS failed_rules FROM failing GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed_rules, '') AS failed_rules,
       NOT base_failed AND failed_rules IS NULL AS kept
FROM judged LEFT JOIN named USING (r)"""
