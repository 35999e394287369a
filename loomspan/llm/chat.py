"""Chat formatting from reply trees, in DataFrame operations only.

Nodes are messages with a parent. Paths come from iterated self-joins that double their reach:
round k joins every node to its ancestor 2^k steps up, so a chain of n messages takes log2(n)
rounds, and unrolling those steps from each leaf meets every ancestor once. A branch is a
root-to-leaf path; branches of a tree are ranked by the sum of their messages' scores, and each
becomes one conversation.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>\\n`` per message. Control strings inside
roles and texts get a backslash behind their first character and backslashes are doubled, which
:func:`unescape` undoes exactly. The loss mask lists the spans of assistant texts, in code
points of the formatted conversation.

Rows: a null text or role is empty; a null score counts 0. Messages that share conversation and
turn are kept and ordered by role and text; a null turn comes first; rows with a null
conversation id form one conversation. A node whose parent does not exist is a root; nodes on a
cycle have no root and belong to no path. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.session import materialize

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
ASSISTANT = "assistant"
PROBE = -7
PROBE_TEXT = "</s>[INST] ok [/INST]"


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(text: Column) -> Column:
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(_broken(s))), CONTROL, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.replace(reduce(lambda c, s: F.replace(c, F.lit(_broken(s)), F.lit(s)), reversed(CONTROL), text), F.lit("\\\\"), F.lit("\\"))


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Of (node, parent): tables (node, up) for 1, 2, 4, ... steps, and the distinct nodes."""
    ids = nodes.select("node")
    up = nodes.join(ids.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("up"))
    tables: list[DataFrame] = []
    before = 0
    while len(tables) < 62:
        up, _ = materialize(up, "ancestors")
        rows = up.count()
        if not rows or tables and rows == before:
            break  # no node reaches as far, or none but those at cycles
        tables.append(up)
        before = rows
        far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
        up = up.join(far, "up").select("node", F.col("far").alias("up"))
    return tables, ids


def paths(nodes: DataFrame) -> DataFrame:
    """Of (node, parent): (leaf, node, up) for every leaf and each node on its path to the root,
    ``up`` steps above the leaf. Grows with the total length of all paths, nothing more."""
    tables, ids = ancestors(nodes)
    found = ids.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for k in reversed(range(len(tables))):
        step = tables[k].select("node", F.col("up").alias("ancestor"))
        found, _ = materialize(found, "paths")  # else the plan doubles with each round
        found = found.unionByName(found.join(step, "node").select("leaf", F.col("ancestor").alias("node"), (F.col("up") + (1 << k)).alias("up")))
    if not tables:
        return found
    found, _ = materialize(found, "paths")
    # a leaf below a cycle never meets a root
    roots = ids.join(tables[0].select("node"), "node", "left_anti")
    rooted = found.join(roots, "node", "left_semi").select("leaf")
    return found.join(rooted, "leaf", "left_semi")


def formatted(messages: Column) -> Column:
    """One string of an array of (role, text)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), escape(m["role"]), F.lit(SEP), escape(m["text"]), F.lit(END + "\n"))), "")


def loss_spans(messages: Column) -> Column:
    """(start, end) of each assistant text within the formatted string, end exclusive; of an
    array of (role, text, at), ``at`` being the characters before the message."""
    head = len(START) + len(SEP)
    mine = F.filter(messages, lambda m: m["role"] == ASSISTANT)
    return F.transform(mine, lambda m: F.struct((m["at"] + head + F.length(escape(m["role"]))).alias("start"), (m["at"] + head + F.length(escape(m["role"])) + F.length(escape(m["text"]))).alias("end")))


def _ranked(branches: DataFrame) -> DataFrame:
    """``rank`` of (tree, leaf, score) within each tree by falling score, then leaf. The order is
    dealt by range, so a tree of any size is numbered by many tasks: a place within the task's
    range plus what the ranges before it hold of the same tree."""
    dealt = branches.repartitionByRange("tree", F.desc("score"), "leaf").withColumn("part", F.spark_partition_id())
    dealt, _ = materialize(dealt, "branch-ranges")  # the ranges are fixed from here on
    held = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("tree", "part", before.alias("before"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(F.desc("score"), "leaf"))
    d, h = dealt.withColumn("place", place), held
    return d.join(h, d["tree"].eqNullSafe(h["tree"]) & (d["part"] == h["part"])).select(d["leaf"], (d["place"] + h["before"]).cast("bigint").alias("rank"))


def format_trees(nodes: DataFrame) -> DataFrame:
    """Of (tree, node, parent, role, text, score): per branch (tree, leaf, rank, score, n_turns,
    formatted, loss). ``node`` is unique; rank 1 has the highest score, ties by leaf."""
    n = nodes.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    n, _ = materialize(n, "nodes")
    steps, _ = materialize(paths(n.select("node", "parent")), "paths")
    size = (F.length(escape(F.col("role"))) + F.length(escape(F.col("text"))) + len(START) + len(SEP) + len(END) + 1).cast("bigint")
    on_path = steps.join(n.select("node", "tree", "role", "text", "score", size.alias("size")), "node")
    # from the root down: -up rises; the sum of sizes gives where a message starts
    down = Window.partitionBy("leaf").orderBy(F.desc("up"))
    at = F.coalesce(F.sum("size").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    turn = F.struct((-F.col("up")).alias("place"), "role", "text", "at")
    branch = on_path.withColumn("at", at).groupBy("leaf").agg(F.max("tree").alias("tree"), F.sum("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    scores = steps.join(n.select("node", "tree", "score"), "node").groupBy("leaf").agg(F.max("tree").alias("tree"), F.sum("score").alias("score"))
    ranks = _ranked(scores).withColumnRenamed("leaf", "__leaf")
    branch = branch.join(ranks, branch["leaf"] == ranks["__leaf"])
    return branch.select("tree", "leaf", "rank", "score", F.size("turns").cast("bigint").alias("n_turns"), formatted(F.col("turns")).alias("formatted"), loss_spans(F.col("turns")).alias("loss"))


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as nodes of reply trees: a message answers the one before it."""
    r = rows.select(rows[conv_col].alias("conv"), rows[turn_col].alias("turn"), rows[role_col].cast("string").alias("role"), rows[text_col].cast("string").alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    r = r.withColumn("place", place)
    key = lambda p: F.concat_ws(":", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("n")), p)
    return r.select(F.col("conv").alias("tree"), key(F.col("place")).alias("node"), F.when(F.col("place") > 1, key(F.col("place") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(out: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the
    formatted string and its loss mask."""
    parts = F.split("formatted", "\\Q" + START + "\\E", -1)
    turns = F.transform(F.slice(parts, 2, F.size(parts)), lambda t: F.struct(F.substring_index(t, SEP, 1).alias("role"), F.substring_index(F.substring_index(t, SEP, -1), END, 1).alias("text")))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["text"]), F.lit("\n"))), "")
    back = out.select("tree", "formatted", turns.alias("turns"), masked.alias("masked"))
    return back.select("tree", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("masked").cast("bigint").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are made of control strings."""
    row = spark.range(2).select(F.lit(PROBE).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return row


def digest(rows: DataFrame) -> DataFrame:
    """Every conversation formatted and read back."""
    return read_back(format_trees(conversations(rows))).withColumnRenamed("tree", "conv_id")


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{_broken(s)}')"
    return out


#: DuckDB SQL for the rows of the registered query.
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE}, 1, 'assistant', '{PROBE_TEXT}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{ASSISTANT}'), '')) AS loss_sha256,
       sum({len(START) + len(SEP) + len(END) + 1} + length({_sql_escape("role")}) + length({_sql_escape("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
