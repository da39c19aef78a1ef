"""Conversations from quoted replies: quote levels, linked passages, reply order.

A line's quote level is the number of ``>`` before it. Each quoted line is a passage; its normalised
text is hashed and joined to the first message of the conversation that wrote it (level 0), if that
is an earlier one. A message answers the message most of whose lines it quotes at its lowest linked
level (the later one of two). Short lines ("Yes.") decide only where no longer one links. Threads, and the depth in them, come from doubling parent links.

Everything is DataFrame functions. Passages meet by (conversation, hash) with one original each, so a
phrase that everybody quotes makes no pairs; a conversation that holds most messages spreads over
all partitions, also in the final order, which uses prefix sums instead of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.operators.ordering import prefix_sums
from gleanframe.session import materialise

#: Passages of fewer words are common phrases: they link, but vote only where no longer one does.
LEAST_WORDS = 3
QUOTE = "^(?:[ ]{0,3}>)+ ?"
#: ASCII white space.
SPACE = r"[\x20\x09-\x0D]"


def normalised(line: Column) -> Column:
    """A-Z in lower case, white space as single spaces, none at the ends."""
    low = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(low, f"{SPACE}+", " "), "^ | $", "")


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__lines`` (level, body) of every whole text and ``body``, the text without quotes.

    Blank lines at the ends of the body go. A null text has no lines and a null body.
    """
    marked = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE, "").alias("body")
        ),
    )
    own = F.array_join(F.transform(F.filter("__lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return messages.withColumn("__lines", marked).withColumn("body", F.regexp_replace(own, rf"^(?:{SPACE}*\n)+|(?:\n{SPACE}*)+$", ""))


def passages(lines: DataFrame) -> DataFrame:
    """(conv, turn, level, long, hash) of all lines with a word; ``long`` from ``LEAST_WORDS`` words on."""
    plain = lines.select("conv", "turn", F.explode("__lines").alias("x")).select("conv", "turn", "x.level", normalised(F.col("x.body")).alias("plain"))
    long = (F.size(F.split("plain", " ")) >= LEAST_WORDS).alias("long")
    return plain.filter("plain <> ''").select("conv", "turn", "level", long, F.md5("plain").alias("hash"))


def linked(found: DataFrame) -> DataFrame:
    """(conv, turn, level, long, origin): quoted passages with the earlier turn that first wrote them."""
    origin = found.filter("level = 0 and turn is not null").groupBy(F.col("conv").alias("c"), F.col("hash").alias("h")).agg(F.min("turn").alias("origin"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h"))
    return found.filter("level > 0").join(origin, same).filter("origin < turn").select("conv", "turn", "level", "long", "origin")


def parents(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked): the message each linked message answers."""
    votes = links.groupBy("conv", "turn", "level", "long", "origin").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct("long", (-F.col("level")).alias("near"), "n", "origin"))
    return votes.groupBy("conv", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select("conv", "turn", F.col("best.origin").alias("parent"), "n_linked")


def threads(answers: DataFrame) -> DataFrame:
    """(conv, turn, top, depth) of messages that have a parent: their thread's first turn, and steps to it.

    Every link is doubled in each round until it ends at a message without a parent.
    """
    now = materialise(answers.select("conv", "turn", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("top").alias("higher"), F.col("depth").alias("more"))
        joined = now.join(up, F.col("conv").eqNullSafe(F.col("c")) & (F.col("top") == F.col("t")), "left")
        now = materialise(
            joined.select("conv", "turn", F.coalesce("higher", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("more").isNotNull().alias("moved"))
        )
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def build(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conversation, turn, role, ``parent_turn``, ``thread_turn``, ``depth``,
    ``position`` in its conversation's reply order, ``body``, and numbers of quoted and linked passages.

    Reply order is by thread, then turn, so an answer follows what it answers. A message that quotes
    nothing known opens a thread. Turns are integers; a message without turn is linked to none and
    comes first. Repeated rows of a turn share links and thread and take neighbouring positions; a null
    conversation is one of its own. An empty table gives none. Other columns are not carried.
    """
    plain = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = materialise(parsed(plain).withColumn("n_quoted", F.coalesce(F.size(F.filter("__lines", lambda x: x["level"] > 0)), F.lit(0)).cast("long")))
    # a repeated row says the same twice
    answers = materialise(parents(linked(passages(rows.select("conv", "turn", "__lines").distinct()))))
    tops = threads(answers)
    both = answers.join(
        tops.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "top", "depth"), F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))
    ).select("c", "t", "parent", "n_linked", "top", "depth")
    placed = rows.join(both, F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").select(
        "conv", "turn", "role", "parent", F.coalesce("top", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        "body", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.lit(1).cast("long").alias("one"),
    )
    ordered = prefix_sums(placed, ["conv"], ["thread", "turn"], ["one"])
    return ordered.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("parent").alias("parent_turn"),
        F.col("thread").alias("thread_turn"), "depth", F.col("cum_one").alias("position"), "body", "n_quoted", "n_linked",
    )


def as_mail(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: every turn quotes the turn before it, and that one's own before it.

    The test tables hold no quotes, so the query writes them the way mail programs do.
    """
    first = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    one = first.select(F.col("conv_id").alias("c1"), (F.col("turn") + 1).alias("t1"), F.col("said").alias("said1"))
    two = first.select(F.col("conv_id").alias("c2"), (F.col("turn") + 2).alias("t2"), F.col("said").alias("said2"))
    quoted = lambda c, mark: F.concat(F.lit("\n" + mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)))
    return (
        conversations.join(one, (F.col("conv_id") == F.col("c1")) & (F.col("turn") == F.col("t1")), "left")
        .join(two, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")), "left")
        .select(
            "conv_id", "turn", "role",
            F.concat("text", F.coalesce(quoted("said1", "> "), F.lit("")), F.coalesce(quoted("said2", "> > "), F.lit(""))).alias("text"),
        )
    )


def report(built: DataFrame) -> DataFrame:
    """Without the bodies, but with their digests."""
    return built.select(*[c for c in built.columns if c != "body"], F.sha2("body", 256).alias("body_sha256"))


#: The query in SQL. Bodies are the texts without blank lines at the ends.
SQL = r"""
WITH RECURSIVE first AS (SELECT conv_id, turn, min(text) AS said FROM conversations GROUP BY ALL),
line AS (
  SELECT c.conv_id, c.turn, unnest(string_split(c.text, chr(10))) AS body, 0 AS level FROM conversations c
  UNION ALL SELECT c.conv_id, c.turn, unnest(string_split(f.said, chr(10))), 1 FROM conversations c JOIN first f ON f.conv_id = c.conv_id AND f.turn = c.turn - 1
  UNION ALL SELECT c.conv_id, c.turn, unnest(string_split(f.said, chr(10))), 2 FROM conversations c JOIN first f ON f.conv_id = c.conv_id AND f.turn = c.turn - 2),
passage AS (
  SELECT *, len(string_split(g, ' ')) >= 3 AS long FROM (SELECT conv_id, turn, level, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS g FROM line)
  WHERE g <> ''),
origin AS (SELECT conv_id, g, min(turn) AS origin FROM passage WHERE level = 0 GROUP BY ALL),
votes AS (SELECT p.conv_id, turn, level, p.long, origin, count(*) AS n FROM passage p JOIN origin o ON o.conv_id = p.conv_id AND o.g = p.g AND origin < turn WHERE level > 0 GROUP BY ALL),
answer AS (
  SELECT conv_id, turn, origin AS parent, n_linked FROM (
    SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked, row_number() OVER (PARTITION BY conv_id, turn ORDER BY long DESC, level, n DESC, origin DESC) AS k FROM votes) WHERE k = 1),
climb AS (
  SELECT conv_id, turn, parent AS top, 1 AS depth FROM answer
  UNION ALL SELECT c.conv_id, c.turn, a.parent, c.depth + 1 FROM climb c JOIN answer a ON a.conv_id = c.conv_id AND a.turn = c.top),
thread AS (SELECT conv_id, turn, min(top) AS top, max(depth) AS depth FROM climb GROUP BY ALL)
SELECT m.conv_id, m.turn, role, parent AS parent_turn, coalesce(top, m.turn) AS thread_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(top, m.turn), m.turn) AS position,
       CAST((SELECT count(*) FROM line l WHERE l.conv_id = m.conv_id AND l.turn = m.turn AND level > 0) AS BIGINT) AS n_quoted,
       CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
       sha256(regexp_replace(text, '^([\x20\x09-\x0D]*\n)+|(\n[\x20\x09-\x0D]*)+$', '', 'g')) AS body_sha256
FROM conversations m LEFT JOIN answer a ON a.conv_id = m.conv_id AND a.turn = m.turn LEFT JOIN thread t ON t.conv_id = m.conv_id AND t.turn = m.turn"""
