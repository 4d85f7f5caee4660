"""Chat formatting of reply trees.

Root-to-leaf paths are enumerated by self-joins that double the known part of every path: a chain of n replies takes
log2(n) rounds, and finished paths take no part in later ones. Branches of a conversation are ranked by the sum of their nodes' scores, and each chosen path becomes
one conversation: every turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.

Control strings of common templates inside a role or text are broken up by a backslash after their first character, and
backslashes are doubled, so that no text can open or close a turn and every text can be read back. ``loss`` holds the
spans (code points, end exclusive) of the assistant texts in the output.

Nulls: a null text or role is empty; a null score counts 0; a node whose parent is missing is a root; nodes on a cycle
have no root and are on no path. Null and repeated ids are ids like others and stay exact; branches of equal score rank by
their leaf. Rows that repeat a turn follow each other in order of role and text. Empty in, empty out. Columns of any other
name are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, discard

# Control strings of published chat templates.
CONTROL = ["<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]
START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(START) + r"((?:[^\n\\]|\\[\s\S])*)\n((?:(?!<\|im_end\|>)(?:[^\\]|\\[\s\S]))*+)" + re.escape(END))


def escape(text: str) -> str:
    out = _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)
    while (again := _overlap(out)) != out:
        out = again
    return out


def _overlap(text: str) -> str:
    """Breaks control strings that overlapped an earlier one; a backslash that escape() wrote is never doubled again."""
    return re.sub("|".join(map(re.escape, CONTROL)), lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the loss spans in it."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text)
        parts += [head, body, END]
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), loss


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of what ``format_turns`` wrote."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, back) of all root-to-leaf paths of (conv, node, parent) rows, back counting from the leaf.

    Round k joins every known (leaf, node) to the node 2^k above it, which doubles each path, and the jumps of 2^k to
    themselves; only jumps that have not passed the root go on. Node ids are unique in a conversation.
    """
    ids = nodes.select("conv", "node", "parent")
    known = ids.select(F.col("conv").alias("c"), F.col("node").alias("n"))
    same = F.col("conv").eqNullSafe(F.col("c"))
    jumps = [cut(ids.join(known, same & (F.col("parent") == F.col("n"))).select("conv", "node", F.col("parent").alias("up")), "chat-jumps")]
    n = ids.count()
    while not jumps[-1].isEmpty() and 1 << len(jumps) <= 2 * n:
        over = jumps[-1].select(F.col("conv").alias("c"), F.col("node").alias("n"), F.col("up").alias("up2"))
        twice = jumps[-1].join(over, same & (F.col("up") == F.col("n"))).select("conv", "node", F.col("up2").alias("up"))
        jumps.append(cut(twice, "chat-jumps"))
    inner = jumps[0].select(F.col("conv").alias("c"), F.col("up").alias("n"))
    endless = jumps[-1].select(F.col("conv").alias("c"), F.col("node").alias("n"))  # below a cycle
    at = same & (F.col("node") == F.col("n"))
    leaves = ids.select("conv", "node").join(inner, at, "left_anti").join(endless, at, "left_anti")
    pairs = leaves.select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for k, jump in enumerate(jumps[:-1]):
        step = jump.select(F.col("conv").alias("c"), F.col("node").alias("n"), "up")
        above = pairs.join(step, at).select("conv", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        longer = cut(pairs.unionByName(above), "chat-paths")
        if k:
            discard(pairs)
        pairs = longer
    return pairs


def conversations(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """(conv, leaf, branch, turns) of (conv, node, parent, role, text, score): the ``best`` branches, all by default."""
    said = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    rows = paths(nodes).join(said, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    turn = F.struct((-F.col("back")).alias("place"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score"))
    whole = whole.withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")))
    return whole if best is None else whole.where(F.col("branch") <= best)


def formatted(chosen: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss`` to (conv, leaf, branch, turns)."""

    def run(batches):  # Arrow batches: ids of any kind stay as they are, nulls among them too
        for b in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
            loss = pa.array([[{"start": x, "end": y} for x, y in m[1]] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "leaf", "branch")), pa.array([m[0] for m in made], pa.string()), loss], names=["conv", "leaf", "branch", "formatted", "loss"])

    rows = chosen.select("conv", "leaf", "branch", "turns")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"conv {kinds['conv']}, leaf {kinds['leaf']}, branch int, formatted string, loss array<struct<start:long,end:long>>")


def as_tree(rows: DataFrame) -> DataFrame:
    """Turns of linear conversations as nodes: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("conv"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    rows = rows.unionByName(extra.select(*(F.col(c).cast(t) for c, t in rows.dtypes)))
    nodes = cut(as_tree(rows), "chat-nodes")

    def digest(batches):
        for b in batches:
            out = []
            for whole, loss in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = read_turns(whole)
                said = "".join(unescape(whole[s["start"] : s["end"]]) for s in loss)
                out.append((len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), _sha(said), len(whole)))
            made = zip(*out, strict=True) if out else [()] * 5
            arrays = [pa.array(x, kind) for x, kind in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv"), *arrays], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = formatted(conversations(nodes, best=1)).select("conv", "formatted", "loss")
    return made.mapInArrow(digest, f"conv_id {dict(rows.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
  {len(START) + 1 + len(END)} + length({_sql_escape("role")}) + length({_sql_escape("text")}) AS n FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(said)) AS BIGINT) AS loss_chars,
  sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
