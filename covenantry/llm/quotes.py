"""Chat formatting by quotation linking, in DataFrame functions only.

Lines that begin with ``>`` are quotes; their number of marks is the level. The lines and sentences
of a quoted passage, normalised, are hashed and joined to the messages of the same conversation; a
passage belongs to the first message that has it as text of its own. A message replies to the one
from which its shallowest linked level quotes most. Replies chain to threads, which are trees. A
conversation in reply order is thread by thread and, within one, depth first: after each message come
its replies by turn, each followed by its own. The messages come out without quotes, one row each, in
chat markup; sorted by conversation, thread and place they are the conversations.

A conversation is never collected: originals are found by a minimum per (conversation, hash), threads by
pointer jumping over the links alone, and places by ranking the list of a walk around each tree, again
by pointer jumping. The rounds grow with the logarithm of the longest thread.

Defined cases: null text = empty text; a null conv_id or turn has no links; rows that repeat a turn
share its links; a quote of nothing in the conversation, or of a later turn, links nothing; a null
role is "unknown"; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let, text_of
from .storage import materialise

_MARKS = r"^[ \t]*>(?:[ \t]*>)*"
_ATTRIBUTION = r"(?iu)^[ \t]*(?:on|am|le|el)\b.*?\b(?:wrote|schrieb|écrit|escribió)\b"
_COLON = r":[ \t]*$"
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def lines_of(text: Column) -> Column:
    """array<struct<level, line>>: how deep each line is quoted, and the line without its marks."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.when(level > 0, F.trim(F.substring(line, F.length(marks) + 1, F.length(line)))).otherwise(line).alias("line"))

    return F.transform(F.split(text, r"\r?\n"), one)


def own_text(lines: Column) -> Column:
    """The text without quotes, and without the line that introduces a quote."""
    introduces = lambda x, i: x["line"].rlike(_COLON) & x["line"].rlike(_ATTRIBUTION) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0)
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~introduces(x, i))
    return F.regexp_replace(F.trim(F.array_join(F.transform(kept, lambda x: x["line"]), "\n")), r"^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def units_of(text: Column) -> Column:
    """array<struct<hash, size>>: the distinct normalised lines and sentences of a passage."""
    joined = F.regexp_replace(text, r"\s+", " ")
    parts = F.concat(F.split(text, "\n"), F.split(joined, r"(?<=[.!?]) "))
    normal = F.filter(F.array_distinct(F.transform(parts, normalised)), lambda x: x != "")
    return F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("size")))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to: a row for each turn that quotes an earlier one."""
    rows = messages.select("conv_id", "turn", lines_of(text_of()).alias("lines")).filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    levels = F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"]))
    at = lambda k: F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == k), lambda x: x["line"]), "\n")
    passages = rows.select("conv_id", "turn", F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), at(k).alias("text")))).alias("p"))
    quoted = materialise(passages.select("conv_id", "turn", "p.level", F.inline(units_of(F.col("p.text")))).distinct(), "quoted-units")
    own = rows.select("conv_id", "turn", F.inline(units_of(own_text(F.col("lines"))))).join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"])
    first = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    found = quoted.join(first, ["conv_id", "hash"]).filter("original < turn")
    weights = found.groupBy("conv_id", "turn", "level", "original").agg(F.sum("size").alias("size"))
    best = weights.groupBy("conv_id", "turn").agg(F.min(F.struct(F.col("level"), (-F.col("size")).alias("size"), (-F.col("original")).alias("original"))).alias("best"))
    return best.select("conv_id", "turn", (-F.col("best.original")).alias("reply_to"))


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (the turn a chain of replies begins with), depth (links to it)."""
    state = materialise(links.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        up = state.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("higher"), F.col("depth").alias("more"))
        if state.join(up, ["conv_id", "thread"], "left_semi").isEmpty():
            return state
        state = materialise(
            state.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", "reply_to", F.coalesce("higher", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")),
            "threads",
        )


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``: the place of each in the order, from 0. Nothing but counts per partition is summed up."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "numbered")  # partition and place in it
    part = F.shiftright("at", 33)
    sizes = stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("part", before.alias("begin"))  # a row per partition
    placed = stored.withColumn("part", part).join(F.broadcast(begins), "part")
    return placed.select(*rows.columns, (F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("at"))


def places(chains: DataFrame) -> DataFrame:
    """conv_id, turn, place: each message of a thread with replies by its place, depth first, from 0 (the thread's first).

    A walk around a tree goes down to each message and up again after its last reply; the place of a
    message is how often the walk went down before it."""
    kin = materialise(_numbered(chains.select("conv_id", "turn", F.col("reply_to").alias("above")), "conv_id", "above", "turn"), "replies")
    following = kin.select("conv_id", "above", F.col("turn").alias("sister"), (F.col("at") - 1).alias("at"))  # of the same message
    eldest = kin.groupBy("conv_id", F.col("above").alias("turn")).agg(F.min("turn").alias("child"))
    roots = chains.select("conv_id", F.col("thread").alias("turn")).distinct()
    nodes = kin.join(following, ["conv_id", "above", "at"], "left").select("conv_id", "turn", "above", "sister")
    nodes = nodes.unionByName(roots.select("conv_id", "turn", F.lit(None).cast("long").alias("above"), F.lit(None).cast("long").alias("sister")))
    nodes = nodes.join(eldest, ["conv_id", "turn"], "left")
    step = lambda turn, up: F.struct(turn.alias("turn"), F.lit(up).alias("up"))
    down = F.struct(F.lit(0).alias("up"), F.coalesce(F.when(F.col("child").isNotNull(), step(F.col("child"), 0)), step(F.col("turn"), 1)).alias("next"), F.lit(1).cast("long").alias("n"))
    back = F.when(F.col("sister").isNotNull(), step(F.col("sister"), 0)).when(F.col("above").isNotNull(), step(F.col("above"), 1))
    up = F.struct(F.lit(1).alias("up"), back.alias("next"), F.lit(0).cast("long").alias("n"))
    walk = materialise(nodes.select("conv_id", "turn", F.inline(F.array(down, up))), "walk")
    while not walk.filter("next IS NOT NULL").isEmpty():
        ahead = walk.select("conv_id", F.col("turn").alias("t"), F.col("up").alias("u"), F.col("next").alias("further"), F.col("n").alias("more"))
        met = walk.select("conv_id", "turn", "up", "n", F.col("next.turn").alias("t"), F.col("next.up").alias("u")).join(ahead, ["conv_id", "t", "u"], "left")
        walk = materialise(met.select("conv_id", "turn", "up", F.col("further").alias("next"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "walk")
    left = walk.filter("up = 0").select("conv_id", "turn", "n")  # how often the walk goes down from here on
    threads_of = chains.select("conv_id", "turn", "thread").unionByName(roots.withColumn("thread", F.col("turn")))
    sizes = left.join(roots, ["conv_id", "turn"], "left_semi").select("conv_id", F.col("turn").alias("thread"), F.col("n").alias("all"))
    return left.join(threads_of, ["conv_id", "turn"]).join(sizes, ["conv_id", "thread"]).select("conv_id", "turn", (F.col("all") - F.col("n")).alias("place"))


def format_chat(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), n_quoted_lines, reply_to, thread, depth, place, formatted of every message.

    Sort by (conv_id, thread, place) for the conversations in reply order."""
    links = threads(link_quotes(messages))
    found = materialise(places(links), "places") if not links.isEmpty() else links.select("conv_id", "turn", "depth").toDF("conv_id", "turn", "place")
    chains = found.join(links, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("of_conv"), F.col("turn").alias("of_turn"), "reply_to", "thread", "depth", "place")
    rows = messages.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        let(lines_of(text_of()), lambda x: F.struct(own_text(x).alias("text"), F.size(F.filter(x, lambda y: y["level"] > 0)).cast("long").alias("n"))).alias("m"),
    )
    joined = rows.join(chains, (F.col("conv_id") == F.col("of_conv")) & (F.col("turn") == F.col("of_turn")), "left")
    safe = lambda x: F.replace(x, F.lit(OPEN), F.lit("< |"))  # noqa: E731  no text can pass for markup
    return joined.select(
        "conv_id",
        "turn",
        "role",
        F.col("m.text").alias("text"),
        F.col("m.n").alias("n_quoted_lines"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("place", F.lit(0)).cast("long").alias("place"),
        F.concat(F.lit(OPEN), safe(F.col("role")), F.lit(CLOSE + "\n"), safe(F.col("m.text")), F.lit("\n" + END + "\n")).alias("formatted"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """The rows of ``format_chat`` in the order of conversations, each in reply order."""
    return format_chat(messages).orderBy("conv_id", "thread", "place", "turn", "role", "text")


def oracle_sql() -> str:
    """The rows of ``conversations`` in DuckDB SQL; threads are followed by recursion, and places are by the path of turns."""
    attribution = _ATTRIBUTION.replace("(?iu)", "(?i)")
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"
    units = lambda x: (
        f"list_distinct(list_filter(list_transform(list_concat(string_split({x}, chr(10)), string_split(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '([.!?]) ', '\\1' || chr(30), 'g'), chr(30))), lambda u: {normal('u')}), lambda u: u <> ''))"
    )
    safe = lambda x: f"replace({x}, '{OPEN}', '< |')"
    return f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role::VARCHAR, 'unknown') AS role, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS raw FROM conversations),
l AS (SELECT conv_id, turn, role, list_transform(raw, lambda x: {{'level': length(regexp_extract(x, '{_MARKS}', 0)) - length(replace(regexp_extract(x, '{_MARKS}', 0), '>', '')),
    'line': CASE WHEN regexp_extract(x, '{_MARKS}', 0) <> '' THEN trim(substr(x, length(regexp_extract(x, '{_MARKS}', 0)) + 1)) ELSE x END}}) AS ls FROM m),
o AS (SELECT *, regexp_replace(trim(array_to_string(list_transform(list_filter(ls, lambda x, i: x.level = 0 AND NOT (regexp_matches(x.line, '{_COLON}') AND regexp_matches(x.line, '{attribution}') AND i < len(ls) AND coalesce(ls[i + 1].level, 0) > 0)), lambda x: x.line), chr(10))), '^\\s+|\\s+$', '', 'g') AS own FROM l),
k AS (SELECT * FROM o WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
v AS (SELECT conv_id, turn, ls, unnest(list_distinct(list_transform(list_filter(ls, lambda x: x.level > 0), lambda x: x.level))) AS level FROM k),
p AS (SELECT conv_id, turn, level, array_to_string(list_transform(list_filter(ls, lambda x: x.level = level), lambda x: x.line), chr(10)) AS said FROM v),
q AS (SELECT DISTINCT conv_id, turn, level, unnest({units("said")}) AS unit FROM p), h AS (SELECT conv_id, turn, unnest({units("own")}) AS unit FROM k), f AS (SELECT conv_id, unit, min(turn) AS original FROM h GROUP BY 1, 2),
w AS (SELECT conv_id, turn, level, original, sum(length(unit)) AS size FROM q JOIN f USING (conv_id, unit) WHERE original < turn GROUP BY 1, 2, 3, 4),
r AS (SELECT conv_id, turn, original AS reply_to FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, original DESC) = 1),
t(conv_id, turn, thread, depth, path) AS (SELECT DISTINCT conv_id, reply_to, reply_to, 0, [reply_to] FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.conv_id = x.conv_id AND y.turn = x.reply_to)
  UNION ALL SELECT r.conv_id, r.turn, t.thread, t.depth + 1, list_append(t.path, r.turn) FROM t JOIN r ON r.conv_id = t.conv_id AND r.reply_to = t.turn),
s AS (SELECT conv_id, turn, thread, depth, row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) - 1 AS place FROM t)
SELECT o.conv_id, o.turn, role, own AS text, len(list_filter(ls, lambda x: x.level > 0))::BIGINT AS n_quoted_lines, reply_to, coalesce(thread, o.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth, coalesce(place, 0)::BIGINT AS place,
  '{OPEN}' || {safe("role")} || '{CLOSE}' || chr(10) || {safe("own")} || chr(10) || '{END}' || chr(10) AS formatted
FROM o LEFT JOIN r ON r.conv_id = o.conv_id AND r.turn = o.turn LEFT JOIN s ON s.conv_id = o.conv_id AND s.turn = o.turn
"""
