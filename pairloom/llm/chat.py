"""Chat formatting of reply trees.

Messages name their parent; a message without one starts a tree. Self-joins double the reach of each
message's link to its ancestors, round by round, until every link has met its root; a message with a
parent that does not exist, or on a cycle, belongs to no path. Root-to-leaf paths are then spelled out
from the leaves by halving: a stretch of 2^k messages becomes two of 2^(k-1). Paths of a tree are ranked
by the mean score of their messages (null: 0), ties by the leaf's id, and the first ``top`` are formatted.

The template sets each turn as ``<|role|>\\n`` text ``<|end|>\\n``. In roles and texts a backslash becomes
two, and one is put into every control string behind its first character: ``<|``, ``[INST]``, ``[/INST]``,
``<s>``, ``</s>``, and ``|>`` in roles. So no text holds a control string, turns are told apart by their
marks alone, and unescaping is exact: a backslash stands for the next character. The loss mask covers
the texts of ``assistant`` turns.
Null texts and roles are empty. Turns that share a number go by role and text; equal rows are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END, ASSISTANT = "<|end|>", "assistant"
#: First characters of control strings of this template and others: fixed values.
CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def escape_role(role: Column) -> Column:
    """As escape, and the ``|>`` that ends a role."""
    return F.replace(escape(role), F.lit("|>"), F.lit("|\\>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, top: int | None = None) -> DataFrame:
    """(leaf, id, place, rank) for every message of every chosen path. messages: id, parent, tree, score."""
    m = C.materialize(messages.select("id", "parent", "tree", "score"))
    up = C.materialize(m.select("id", F.col("parent").alias("to")))  # 2^k steps up
    reach, levels = up, [up]
    most = m.count().bit_length()  # no path is longer than all messages; what goes on after that is a cycle
    while len(levels) <= most and not reach.filter("to IS NOT NULL").isEmpty():
        far = reach.select(F.col("id").alias("to"), F.col("to").alias("further"))
        on = reach.join(far, "to").select("id", F.col("further").alias("to"))  # missing parents fall away
        reach = C.materialize(on.unionByName(reach.filter("to IS NULL")))
        levels.append(reach)
    rooted = reach.filter("to IS NULL").select("id")  # all ancestors exist, and end at a root
    inner = m.select(F.col("parent").alias("id")).filter("id IS NOT NULL").distinct()
    at = C.materialize(m.join(rooted, "id", "left_semi").join(inner, "id", "left_anti").select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("back")))
    for k in range(len(levels) - 2, -1, -1):
        above = at.join(levels[k], "id").filter("to IS NOT NULL").select("leaf", F.col("to").alias("id"), (F.col("back") + (1 << k)).alias("back"))
        at = C.materialize(at.unionByName(above))
    if top is None:
        return at.withColumn("rank", F.lit(1))
    scores = at.join(m.select("id", "tree", "score"), "id").groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    order = F.expr("row_number() OVER (PARTITION BY tree ORDER BY mean DESC, leaf)")
    chosen = scores.withColumn("rank", order).filter(F.col("rank") <= top).select("leaf", "rank")
    return at.join(chosen, "leaf")


def formatted(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """A row per chosen path: tree, leaf, rank, text (the formatted conversation), loss_mask (start and end of each span under loss, in code points).

    messages: id, parent, tree, role, text, score (other columns are not looked at).
    """
    at = paths(messages, top)
    turn = F.struct((-F.col("back")).alias("o"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.coalesce("role", F.lit("")) == ASSISTANT).alias("loss"))
    told = at.join(messages.select("id", "tree", "role", "text"), "id").groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))
    tail = F.lit(f"{END}\n")
    text = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], tail)), "")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(head(t))
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(t["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return told.select("tree", "leaf", "rank", text.alias("text"), F.aggregate("turns", state, add)["spans"].alias("loss_mask"))


def turns_of(text: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation."""
    parts = F.split(text, r"<\|end\|>\n", -1)
    mark = lambda p: F.instr(p, F.lit("|>\n"))
    turn = lambda p: F.struct(unescape(F.substring(p, F.lit(3), mark(p) - 3)).alias("role"), unescape(F.substring(p, mark(p) + 3, F.length(p))).alias("text"))
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, ASSISTANT, probe)], "conv_id long, turn long, role string, text string")
    nth = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)")
    rows = rows.unionByName(more).withColumn("nth", nth)
    name = lambda n: F.struct("conv_id", F.lit(n).alias("nth") if isinstance(n, int) else n.alias("nth"))
    messages = C.materialize(rows.select(name(F.col("nth")).alias("id"), F.when(F.col("nth") > 1, name(F.col("nth") - 1)).alias("parent"), F.col("conv_id").alias("tree"), "role", "text", F.lit(0.0).alias("score")))
    out = formatted(messages).select("tree", "text", turns_of(F.col("text")).alias("turns"), "loss_mask")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        sha(whole).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


SQL = {
    "op6_chat_formatting": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '\\<\1', 'g'), '\[(/?INST\])', '\\[\1', 'g')) AS n FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + 5 + n + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
}
