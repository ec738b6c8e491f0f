"""Chat formatting: branches of reply trees as conversations, with a loss mask.

Messages point to what they reply to. Self-joins follow those pointers by doubling:
after n of them every message knows its ancestor 2^n replies above and the scores
summed on the way, so the deepest tree takes as many joins as its depth has binary
digits. Each leaf then has the score of its branch; branches are ranked in their tree
and the best chosen. The messages of the chosen branches alone are enumerated, by the
same tables: a set of messages 0 to 2^n - 1 above a leaf, joined once more, gives those
2^n to 2^(n+1) - 1 above. All this moves ids, never texts; a message that many answer
is a hot key on the side that Spark splits, and ranks are cut to the wanted number in
each task before the shuffle. Texts are joined last and put together branch by branch.
A conversation is one row, as large as its texts.

Template of a turn: ``### <Role>: <text></turn>`` and a line feed, the role's first
letter in upper case. Inside texts and roles a backslash is doubled, ``</turn>`` becomes
``<\\/turn>`` and ``##`` becomes ``#\\#``; in a role a colon is escaped too, and a first
letter that is in upper case by itself. So neither control string occurs but as one, and
taking away the backslashes gives the text back. ``loss_spans`` are the places (code
points, end exclusive) of the assistant's escaped texts.

Cases: a null text or role is empty; a null node id is the id ''; a null tree is a tree
of its own; a parent that is null, or not there, makes a root; all rows of one node are
said at its place, by role and text, and share its least parent and greatest score; a
null score is 0; rings of replies have no root, so their messages are in no conversation
(``unrooted`` returns them); equal branches rank by the leaf's id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize
from textloom.shipping import ship

HEAD, BETWEEN, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("##"), F.lit("#\\#"))


def role_title(role: Column) -> Column:
    out = F.replace(escape(role), F.lit(":"), F.lit("\\:"))
    return F.when(out.rlike("^[A-Z]"), F.concat(F.lit("\\"), out)).when(out.rlike("^[a-z]"), F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 2**31 - 1))).otherwise(out)


def nodes(messages: DataFrame) -> DataFrame:
    """One row (tree, node, up, total, steps) a message: ``up`` is its parent if that is there."""
    slim = messages.select(F.struct("tree").alias("tree"), F.coalesce(F.col("node").cast("string"), F.lit("")).alias("node"), F.col("parent").cast("string").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    slim = slim.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("total"))
    there = slim.select("tree", F.col("node").alias("parent"), F.col("node").alias("up"))
    return slim.join(there, ["tree", "parent"], "left").select("tree", "node", "up", "total", F.lit(1).cast("long").alias("steps"))


def climb(start: DataFrame) -> list[DataFrame]:
    """Tables of (tree, node, up, total, steps), where ``up`` is 1, 2, 4, ... replies above; in the last no root's descendant has one."""
    levels = [materialize(start, "replies")]
    most = None
    while True:
        at = levels[-1]
        if at.filter(F.col("up").isNotNull()).isEmpty():
            return levels
        if most is None:
            most = at.count()
        if 1 << (len(levels) - 1) > most:  # what is still open goes round in rings
            return levels
        above = at.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("t"), F.col("steps").alias("s"))
        open_ = at.filter(F.col("up").isNotNull()).join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("t")).alias("total"), (F.col("steps") + F.col("s")).alias("steps"))
        levels.append(materialize(at.filter(F.col("up").isNull()).unionByName(open_), "replies"))


def choose(levels: list[DataFrame], branches: int, mean: bool) -> DataFrame:
    """(tree, leaf, rank, score, steps) of the best branches of each tree."""
    has_reply = levels[0].filter(F.col("up").isNotNull()).select("tree", F.col("up").alias("node")).distinct()
    leaves = levels[-1].filter(F.col("up").isNull()).join(has_reply, ["tree", "node"], "left_anti")
    score = F.col("total") / F.col("steps") if mean else F.col("total")
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), score.alias("score"), "steps")
    return leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)


def enumerate_paths(levels: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """(tree, leaf, rank, score, node, place): all messages of the chosen branches, place 0 at the root."""
    paths = materialize(chosen.select("tree", "leaf", "rank", "score", F.col("leaf").alias("node"), (F.col("steps") - 1).alias("place")), "paths")
    for n, level in enumerate(levels[:-1]):
        # of what stands 0 to 2^n - 1 above the leaf: its ancestors 2^n above
        step = level.filter(F.col("up").isNotNull()).select("tree", "node", "up")
        more = paths.filter(F.col("place") >= 1 << n).join(step, ["tree", "node"]).select("tree", "leaf", "rank", "score", F.col("up").alias("node"), (F.col("place") - (1 << n)).alias("place"))
        old, paths = paths, materialize(paths.unionAll(more), "paths")
        discard(old)
    return paths


def format_branches(messages: DataFrame, branches: int = 1, mean: bool = True, links: DataFrame | None = None) -> DataFrame:
    """Per chosen branch: tree, leaf, rank, score, n_turns, formatted, loss_spans.

    ``messages``: tree, node, role, text, and parent and score unless ``links`` has them
    (tree, node, parent, score). ``branches``: how many of a tree, best first, by the
    mean (or sum) of their messages' scores.
    """
    ship(messages.sparkSession)
    levels = climb(nodes(messages if links is None else links))
    paths = enumerate_paths(levels, choose(levels, branches, mean))
    discard(*levels)
    said = messages.select(F.struct("tree").alias("tree"), F.coalesce(F.col("node").cast("string"), F.lit("")).alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = said.join(paths, ["tree", "node"])
    head = F.concat(F.lit(HEAD), role_title(F.col("role")), F.lit(BETWEEN))
    rows = rows.select("tree", "leaf", "rank", "score", "place", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("turn", F.concat("head", "body", F.lit(END)))
    so_far = Window.partitionBy("tree", "leaf").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.row_number().over(so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.sum(F.char_length("turn").cast("long")).over(so_far) - len(END)
    span = F.struct((F.col("end") - F.char_length("body")).alias("start"), F.col("end"))
    rows = rows.withColumn("n", n).withColumn("end", end).select("tree", "leaf", "rank", "score", "n", "turn", F.when(F.col("role") == "assistant", span).alias("span"))
    out = rows.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(F.struct("n", "turn", "span"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: t["turn"]), "")
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return out.select("tree.tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), spans.alias("loss_spans"))


def unrooted(messages: DataFrame) -> DataFrame:
    """(tree, node) of the messages whose replies lead into a ring: they are in no conversation."""
    return climb(nodes(messages))[-1].filter(F.col("up").isNotNull()).select("tree.tree", "node")


# --- reading back ---------------------------------------------------------------------

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): (.*?)</turn>\n", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = m[1]
        out.append((unescape(role[:1].lower() + role[1:] if "A" <= role[:1] <= "Z" else role), unescape(m[2])))
        at = m.end()
    return out


def _read_back(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, digest = text.as_py(), hashlib.sha256()
            turns = parse(text)
            for role, said in turns:
                digest.update(f"{role}\n{said}\n".encode())
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans.as_py())
            out.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations say, read back from them: digests of turns and of the text under the loss mask."""
    rows = formatted.select(F.col("tree").cast("long").alias("conv_id"), "formatted", "loss_spans")
    return rows.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chain(rows: DataFrame, tree: str, turn: str) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as reply trees: (messages, links). Each turn answers the one before it, null turns come first, all scores are alike."""
    messages = rows.select(F.col(tree).alias("tree"), F.coalesce(F.col(turn).cast("string"), F.lit("")).alias("node"), F.col(turn).alias("turn"), "role", "text")
    turns = messages.select(F.struct("tree").alias("key"), "node", "turn").distinct()
    links = turns.select("key.tree", "node", F.lag("node").over(Window.partitionBy("key").orderBy("turn")).alias("parent"), F.lit(0.0).alias("score"))
    return messages.drop("turn"), links


def format_conversations(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``format_branches`` for conversations whose rows are numbered by turn."""
    messages, links = chain(rows, tree, turn)
    return format_branches(messages, links=links)


#: A conversation whose texts hold the template's own control strings.
PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

_ESC = r"replace(replace(replace({}, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')"
ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED[0][3]}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED[1][3]}'),
parts AS (
  SELECT *, {_ESC.format("text")} AS body, replace({_ESC.format("role")}, ':', '\\:') AS title FROM said),
turns AS (
  SELECT *, '### ' || CASE WHEN regexp_matches(title, '^[A-Z]') THEN '\\' || title WHEN regexp_matches(title, '^[a-z]') THEN upper(title[1]) || title[2:] ELSE title END || ': ' || body || '</turn>' || chr(10) AS shown FROM parts)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown)) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
