"""Secret scans: candidates by pattern, false positives taken out by a random forest.

A candidate is a value after a credential word, be it assigned (``password: x``) or quoted
(``password "x y"``), of any length and alphabet; or else a run of 16 or more letters, digits and
``_ - + / = . ~`` with a digit in it. Its features are its length, how often its characters change
class and how varied they are, how much of it the corpus's own vocabulary covers, whether it looks like
a path, host or plain number, and the words beside it. A forest trained on labelled findings (at most
``LABELLED`` of them, by lowest hash: the documented bound) gives the chance that a candidate is a secret.

All is DataFrame functions and Spark's own forest: the dictionary counts every document, and texts and
features are never shuffled together; what is shuffled are words with their counts and the candidates.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import materialise

# Runs begin where no run character stands before, and the look-ahead never gives back, so that a long
# run is read a fixed number of times.
RUN = r"[A-Za-z0-9_\-+/=.~]"
CANDIDATE = rf"(?<!{RUN})(?=[A-Za-z_\-+/=.~]*+[0-9]){RUN}{{16,}}+"
#: Characters kept to either side.
BESIDE = 32
#: Labelled findings that are trained on, trees, depth, and seed.
LABELLED, TREES, DEPTH, SEED = 20_000, 40, 6, 29
#: Documents that must hold a word of the dictionary, and its least length.
DICTIONARY_DOCS, DICTIONARY_LETTERS = 5, 3

#: Words that name a credential, and words that name other codes.
CREDENTIAL_WORD = r"secret|token|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer"
CREDENTIAL = rf"(?i)({CREDENTIAL_WORD})"
# What stands between a credential word and its value, and the value: to the closing quote on the line, or
# without quotes to white space, less punctuation at the end. The first look-behind is short and fails fast.
CLOSE = r"(?<=[:=][ \t]{0,3}|[\"'`])"
NAMED = rf"(?<=(?i:{CREDENTIAL_WORD})[\w\-]{{0,16}}[\"'`]?(?:[ \t]{{0,3}}[:=][ \t]{{0,3}}|[ \t]{{1,3}}(?:is[ \t]{{1,3}})?(?=[\"'`]))[\"'`]?)"
VALUE = "|".join(rf"(?<={q})(?=[ \t]*+[^\s{q}])[^{q}\n]++(?={q})" for q in "\"'`") + r"|(?<=[:= \t])[^\s\"'`](?:\S*[^\s.,;:!?)\]}>\"'`])?"
NAMED_VALUE = f"{CLOSE}{NAMED}(?:{VALUE})"
OTHER_CODE = r"(?i)(commit|sha|md5|checksum|digest|uuid|guid|etag|version|build|isbn|order|invoice|phone|card|http|www)"
ASSIGNED = r"[:=]\s*[\"'`]?$"

FEATURES = (
    "length", "runs", "digits", "capitals", "distinct", "entropy", "coverage", "slashes", "dots", "number", "hex", "url",
    "credential_before", "other_before", "assigned", "quoted", "credential_after",
)


def cut_by(text: Column, pattern: str) -> tuple[Column, Column]:
    """What matches ``pattern``, and the gaps around it: one more."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)


def beside(found: Column, gaps: Column) -> Column:
    """Between two candidates stands the gap after the one and before the other."""
    return F.transform(
        found, lambda v, i: F.struct(v.alias("value"), F.right(F.element_at(gaps, i + 1), F.lit(BESIDE)).alias("before"), F.left(F.element_at(gaps, i + 2), F.lit(BESIDE)).alias("after"))
    )


def candidates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place, value, before, after): every candidate of every whole text, numbered within it.

    Values after a credential word come first, then the runs between them. Null and empty texts have
    none. Repeated rows are searched each. Other columns play no part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    named, gaps = cut_by(F.col("t"), NAMED_VALUE)
    cut = docs.select(F.col(id).alias("id"), t.alias("t")).select("id", named.alias("named"), gaps.alias("gaps"))
    runs = F.flatten(F.transform("gaps", lambda g: beside(*cut_by(g, CANDIDATE))))
    both = cut.select("id", F.concat(beside(F.col("named"), F.col("gaps")), runs).alias("found"))
    return both.select("id", F.posexplode("found").alias("place", "x")).select("id", "place", "x.*")


def dictionary(docs: DataFrame, text: str = "text", least_docs: int = DICTIONARY_DOCS) -> DataFrame:
    """Words of ASCII letters that ``least_docs`` documents hold, over all documents."""
    words = F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z]+"))
    each = docs.select(F.explode(F.filter(words, lambda w: F.length(w) >= DICTIONARY_LETTERS)).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_docs).select("word")


def coverage(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, coverage): share of each distinct value's characters in letter runs that are words."""
    parts = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{%d,}" % DICTIONARY_LETTERS), F.lit(0))).alias("word"))
    known = parts.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("letters"))
    return known.select("value", (F.col("letters") / F.length("value")).alias("coverage"))


def features(found: DataFrame, covered: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES`` to candidates."""
    v, n = F.col("value"), F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^a-zA-Z0-9]+", ".")
    left = lambda pattern: n - F.length(F.regexp_replace(v, pattern, ""))
    chars = F.array_distinct(F.split(v, ""))
    share = lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.join(covered, "value", "left").select(
        *found.columns,
        n.cast("double").alias("length"),
        (F.length(classes) / n).alias("runs"),
        (left("[0-9]") / n).alias("digits"),
        (left("[A-Z]") / n).alias("capitals"),
        (F.size(chars) / n).alias("distinct"),
        F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.ln(share(c))).alias("entropy"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        left("/").cast("double").alias("slashes"),
        left("[.]").cast("double").alias("dots"),
        flag(v.rlike(r"^[0-9.+\-=/]+$")).alias("number"),
        flag(v.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        flag(v.rlike(r"^(www\.|//|[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,6}(/|$))") | F.col("before").rlike(r"(://|@)$")).alias("url"),
        flag(F.col("before").rlike(CREDENTIAL)).alias("credential_before"),
        flag(F.col("before").rlike(OTHER_CODE)).alias("other_before"),
        flag(F.col("before").rlike(ASSIGNED)).alias("assigned"),
        flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
        flag(F.col("after").rlike(CREDENTIAL)).alias("credential_after"),
    )


def train(labelled: DataFrame, limit: int = LABELLED) -> RandomForestClassificationModel | None:
    """A forest on findings with ``FEATURES`` and a ``label`` of 0 or 1; None without both labels.

    Labels that are null are not used. Only ``limit`` findings are, in an order that depends on
    nothing but their values, so that training again gives the same trees.
    """
    known = labelled.filter("label is not null").select(*FEATURES, F.col("label").cast("double").alias("label"))
    order = [F.xxhash64(*FEATURES, "label"), *FEATURES, "label"]
    sample = materialise(known.orderBy(*order).limit(limit).coalesce(1).sortWithinPartitions(*order))
    if sample.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(vectors.select("features", "label"))


def classify(found: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Add ``chance`` of a secret and ``secret`` (a half or more); without a model both are null: undecided."""
    if model is None:
        return found.withColumn("chance", F.lit(None).cast("double")).withColumn("secret", F.lit(None).cast("boolean"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found)
    out = model.setFeaturesCol("__features").setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__c").transform(vectors)
    return out.withColumn("chance", vector_to_array("__p")[1]).withColumn("secret", F.col("chance") >= 0.5).drop("__features", "__p", "__r", "__c")


def scan(docs: DataFrame, labelled: DataFrame | None = None, rule: Column | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every candidate with its features, ``chance`` and ``secret``.

    The forest learns from ``labelled`` (id, place, label: findings somebody has judged, of these
    documents), or, where nobody has, from ``rule``: a column over the features that gives 1, 0 or
    null. Where they do not hold both labels nothing can be learnt, and the verdict is null. An empty
    table, or one without candidates, gives none; equal findings with equal neighbours get equal verdicts.
    """
    found = materialise(candidates(docs, id, text))
    covered = coverage(found.select("value").distinct(), dictionary(docs, text))
    ready = materialise(features(found, covered))
    if labelled is not None:
        known = labelled.groupBy(F.col(id).alias("i"), F.col("place").alias("p")).agg(F.max("label").alias("label"))
        taught = ready.join(known, (F.col("id") == F.col("i")) & (F.col("place") == F.col("p")))
    else:
        taught = ready.withColumn("label", F.lit(None).cast("int") if rule is None else rule)
    return classify(ready, train(taught)).withColumnRenamed("id", id)


def weak_label() -> Column:
    """Findings that leave no doubt: 1 if named, assigned and quoted as a credential, 0 if plainly a number, host, path or words of prose."""
    plain = (F.col("number") == 1) | (F.col("url") == 1) | (F.col("slashes") >= 2)
    named = (F.col("credential_before") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1)
    prose = (F.col("coverage") >= 0.99) & (F.col("quoted") == 0)
    return F.when(named & ~plain, 1).when((plain | prose) & ~named, 0)


def report(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """Findings without the values themselves."""
    return scanned.select(
        id, "place", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"),
        F.round("coverage", 6).alias("coverage"), F.round("chance", 6).alias("chance"), "secret",
    )
