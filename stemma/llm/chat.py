r"""Chat formatting by quotation linking, with DataFrame functions only.

A line that begins with ``>`` signs (spaces between them allowed) is quoted; their number
is its level. Quoted lines are normalised (ASCII case folded, spaces collapsed), hashed and
joined to the lines that messages write themselves: first to the nearest earlier message
of the same conversation that has the line, else to the earliest message anywhere. A
message replies to the message that most of its level-1 lines come from, the nearest of
equals, and without such lines to the message before it. Quoted lines, and a line that
introduces a quotation (``... wrote:``), are cut from its content.

Rows come out one per message, in reply order within a conversation: ``position`` counts
from 0, a reply stands after what it replies to, and ``depth`` is its distance from the
conversation's first message along replies. No conversation is ever collected.

Defined cases: a null text is empty; rows equal in conv_id, turn, role and text are one
message; messages with one turn follow one another by role and text hash; null turns come
first; rows without a conv_id form one conversation, which ``quotes_conv`` names by null; an empty table gives an empty result;
other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.common import drop_folders, materialize, table

#: Fixed patterns: the quote mark at a line's start, and the end of a line that introduces a quotation.
QUOTE = r"^[ \t]*(>[ \t]*)+"
INTRODUCES = r"(wrote|writes|said|schrieb|écrit|escribió)[ \t]*:[ \t\r]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quote_level(line: Column) -> Column:
    """Number of quote marks before the line's own text."""
    mark = F.regexp_extract(line, QUOTE, 0)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def normalised(line: Column) -> Column:
    bare = F.regexp_replace(line, QUOTE, "")
    return F.trim(F.regexp_replace(F.translate(bare, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def own_text(text: Column) -> Column:
    """A text without its quoted lines and what introduces them."""
    lines = F.split(text, "\n", -1)
    introduces = lambda x, i: x.rlike(INTRODUCES) & (quote_level(F.coalesce(F.get(lines, i + 1), F.lit(""))) > 0)
    kept = F.filter(lines, lambda x, i: (quote_level(x) == 0) & ~introduces(x, i))
    return F.trim(F.array_join(kept, "\n"))


def messages(conversations: DataFrame) -> DataFrame:
    """Distinct messages with a key of their conversation and their position in it."""
    m = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    m = m.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    # ranges of the order are numbered apart, so that a long conversation is dealt over many tasks
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc()]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(m.repartitionByRange(n, "conv", *order).withColumn("range", F.spark_partition_id()), "dealt-messages")
    before = dealt.groupBy("conv", "range").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = dealt.withColumn("number", F.row_number().over(Window.partitionBy("conv", "range").orderBy(*order)) - 1)
    return numbered.join(before.select("conv", "range", "before"), ["conv", "range"]).withColumn("position", (F.col("number") + F.coalesce("before", F.lit(0))).cast("long")).drop("range", "number", "before")


def quotations(m: DataFrame) -> DataFrame:
    """Quoted lines with their source: (conv, position, level, source_conv, source_position)."""
    each = m.select("conv", "position", F.explode(F.split("text", "\n", -1)).alias("line"))
    each = each.select("conv", "position", quote_level(F.col("line")).alias("level"), normalised(F.col("line")).alias("norm")).where("norm != ''")
    each = each.select("conv", "position", "level", F.xxhash64("norm").alias("hash"))
    own, quoted = each.where("level = 0").drop("level"), each.where("level > 0")
    # only lines that are quoted somewhere matter as sources
    asked = quoted.select("hash").distinct()
    own = own.distinct().join(asked, "hash", "left_semi")
    both = quoted.select("conv", "hash", "position", "level").union(own.select("conv", "hash", "position", F.lit(0).alias("level")))
    before = Window.partitionBy("conv", "hash").orderBy("position", F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last(F.when(F.col("level") == 0, F.col("position")), ignorenulls=True).over(before)).where("level > 0")
    first = own.groupBy("hash").agg(F.min(F.struct("conv", "position")).alias("first"))
    far = near.join(first, "hash", "left")
    here = F.col("near").isNotNull()
    elsewhere = F.col("first.conv") != F.col("conv")
    return far.select(
        "conv", "position", "level", F.when(here, F.col("conv")).when(elsewhere, F.col("first.conv")).alias("source_conv"),
        F.when(here, F.col("near")).when(elsewhere, F.col("first.position")).alias("source_position"),
    )


def reply_links(m: DataFrame, q: DataFrame) -> DataFrame:
    """Messages with reply_to (a position), and what they quote from other conversations."""
    votes = q.where("source_conv = conv AND level = 1").groupBy("conv", "position", "source_position").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("conv", "position").agg(F.max(F.struct("n", "source_position")).alias("v"))
    counts = q.groupBy("conv", "position").agg(
        F.count("*").alias("n_quoted"), F.count("source_conv").alias("n_linked"), F.min(F.when(F.col("source_conv") != F.col("conv"), F.struct("source_conv", "source_position"))).alias("other")
    )
    joined = m.join(chosen, ["conv", "position"], "left").join(counts, ["conv", "position"], "left")
    previous = F.when(F.col("position") > 0, F.col("position") - 1)
    return joined.select(
        "conv", "position", "conv_id", "turn", "role", own_text(F.col("text")).alias("content"), F.coalesce("v.source_position", previous).alias("reply_to"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.when(F.col("other.source_conv") != "", F.substring("other.source_conv", 2, 1 << 20)).alias("quotes_conv"), F.col("other.source_position").alias("quotes_position"),
    )


def reply_depths(links: DataFrame) -> DataFrame:
    """(conv, position, depth) by doubling the reply links; rows that have arrived rest."""
    state = materialize(links.select("conv", "position", F.col("reply_to").alias("to"), F.when(F.col("reply_to").isNull(), 0).otherwise(1).cast("long").alias("depth")), "depths")
    while not state.where("to IS NOT NULL").isEmpty():
        ahead = state.select(F.col("conv").alias("_conv"), F.col("position").alias("_at"), F.col("to").alias("_to"), F.col("depth").alias("_depth"))
        moving = state.where("to IS NOT NULL").join(ahead, (F.col("conv") == F.col("_conv")) & (F.col("to") == F.col("_at")))
        moved = moving.select("conv", "position", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"))
        old, state = state, materialize(state.where("to IS NULL").union(moved), "depths")
        drop_folders(state.sparkSession, [old.shared_path])
    return state.select("conv", "position", "depth")


def link_replies(conversations: DataFrame) -> DataFrame:
    """One row per message, without quotes: the reply-ordered conversations."""
    m = materialize(messages(conversations), "messages")
    links = materialize(reply_links(m, quotations(m)), "replies")
    return links.join(reply_depths(links), ["conv", "position"]).drop("conv")


def chat_format(linked: DataFrame) -> DataFrame:
    """Messages as (conv_id, position, formatted), in one common chat markup."""
    return linked.select("conv_id", "position", F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>\n")).alias("formatted"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return link_replies(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", "position", "role", "content", "reply_to", "depth", "n_quoted", "n_linked", "quotes_conv", "quotes_position"
    )


ORACLE = r"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position
           FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)),
l AS (SELECT conv_id, position, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
e AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(translate(regexp_replace(line, '^[ \t]*(>[ \t]*)+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l),
k AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, position ORDER BY i), 0) AS next_level FROM e),
c AS (SELECT conv_id, position, trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT (regexp_matches(line, '(wrote|writes|said|schrieb|écrit|escribió)[ \t]*:[ \t\r]*$') AND next_level > 0)), ''), ' ') AS content FROM k GROUP BY conv_id, position),
q AS (SELECT conv_id, position, level, norm, i FROM e WHERE level > 0 AND norm <> ''),
o AS (SELECT DISTINCT conv_id, position, norm FROM e WHERE level = 0 AND norm <> ''),
s AS (SELECT q.conv_id, q.position, q.level, q.i, (SELECT max(o.position) FROM o WHERE o.conv_id = q.conv_id AND o.norm = q.norm AND o.position < q.position) AS near,
             (SELECT min({'c': o.conv_id, 'p': o.position}) FROM o WHERE o.norm = q.norm) AS far FROM q),
v AS (SELECT conv_id, position, max({'n': n, 'p': near}) AS best FROM (SELECT conv_id, position, near, count(*) AS n FROM s WHERE near IS NOT NULL AND level = 1 GROUP BY ALL) GROUP BY ALL),
n AS (SELECT conv_id, position, count(*) AS n_quoted, count(*) FILTER (WHERE near IS NOT NULL OR far.c <> conv_id) AS n_linked,
             min(CASE WHEN near IS NULL AND far.c <> conv_id THEN far END) AS other FROM s GROUP BY ALL),
r AS (SELECT m.conv_id, m.turn, m.position, m.role, c.content, coalesce(v.best.p, CASE WHEN m.position > 0 THEN m.position - 1 END) AS reply_to,
             coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, other.c::VARCHAR AS quotes_conv, other.p AS quotes_position
      FROM m JOIN c USING (conv_id, position) LEFT JOIN v USING (conv_id, position) LEFT JOIN n USING (conv_id, position)),
d AS (SELECT conv_id, position, 0::BIGINT AS depth FROM r WHERE reply_to IS NULL
      UNION ALL SELECT r.conv_id, r.position, d.depth + 1 FROM r JOIN d ON r.conv_id = d.conv_id AND r.reply_to = d.position)
SELECT conv_id, turn, position, role, content, reply_to, depth, n_quoted, n_linked, quotes_conv, quotes_position FROM r JOIN d USING (conv_id, position)
"""
