r"""Chat formatting: reply trees, one chosen root-to-leaf path per conversation, a reversible template.

Messages form trees by parent id. Self-joins by pointer doubling give every message its ancestors
1, 2, 4, ... replies up, with the score summed on the way to the root; the number of joins is the
logarithm of the deepest path. Leaves are ranked by mean score along their path (ties: the deeper,
then the smaller key) and the best leaf of a tree is expanded to its path by the same jumps, taken
in falling order. No join carries texts; they meet the chosen path at the end.

The template writes a turn as ``### Role: text </turn>`` and a line feed. Inside roles and texts a
backslash goes before ``\``, ``###`` and ``</turn>`` (and before ``:`` in roles), so the output can
be cut and unescaped again without loss. Spans of assistant texts form the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import read_table, staged

_ESCAPE = re.compile(r"\\|###|</turn>")
_ROLE_ESCAPE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\])*?) </turn>\n", re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the code point spans of its assistant texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = "### " + _ROLE_ESCAPE.sub(lambda m: "\\" + m[0], role) + ": "
        body = _ESCAPE.sub(lambda m: "\\" + m[0], text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + " </turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``format_turns`` has written; an error if the text isn't of that form."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((_UNESCAPE.sub(r"\1", m[1]), _UNESCAPE.sub(r"\1", m[2])))
        at = m.end()
    return turns


def best_paths(messages: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(tree, message, place) of the best path of each tree; ``messages``: tree, message, parent, score.

    A parent that isn't in the same tree counts as none. A null score counts as 0. Several roots in
    one tree compete as branches do. Messages with a null tree or message are left out, repeated
    (tree, message) rows count once. A cycle of parents is an error.
    """
    nodes = messages.where("tree is not null and message is not null").groupBy("tree", "message").agg(
        F.min("parent").alias("parent"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    own = nodes.select(F.col("tree").alias("o_tree"), F.col("message").alias("o_message"))
    nodes = nodes.join(own, (F.col("tree") == F.col("o_tree")) & (F.col("parent") == F.col("o_message")), "left").select(
        "tree", "message", F.col("o_message").alias("parent"), "score")
    nodes = staged(nodes, "reply-nodes")
    jump = nodes.select("tree", "message", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    jumps = [staged(jump, "reply-jump")]
    while jumps[-1].where("up is not null").limit(1).count():
        if len(jumps) > max_doublings:
            raise ValueError("parents form a cycle")
        low = jumps[-1]
        high = low.select(F.col("tree").alias("h_tree"), F.col("message").alias("h_message"), F.col("up").alias("h_up"), F.col("depth").alias("h_depth"), F.col("total").alias("h_total"))
        open_, done = low.where("up is not null"), low.where("up is null")
        further = open_.join(high, (F.col("tree") == F.col("h_tree")) & (F.col("up") == F.col("h_message"))).select(
            "tree", "message", F.col("h_up").alias("up"), (F.col("depth") + F.col("h_depth")).alias("depth"), (F.col("total") + F.col("h_total")).alias("total"))
        jumps.append(staged(done.unionByName(further), "reply-jump"))
    parents = nodes.where("parent is not null").select(F.col("tree").alias("p_tree"), F.col("parent").alias("p_message")).distinct()
    leaves = jumps[-1].join(parents, (F.col("tree") == F.col("p_tree")) & (F.col("message") == F.col("p_message")), "left_anti")
    best = leaves.groupBy("tree").agg(F.min(F.struct((-F.col("total") / F.col("depth")).alias("rank"), (-F.col("depth")).alias("deep"), "message")).alias("best"))
    path = best.select("tree", "best.message", (-F.col("best.deep")).alias("place"))
    for k in reversed(range(len(jumps) - 1)):
        up = jumps[k].where("up is not null").select(F.col("tree").alias("u_tree"), F.col("message").alias("u_message"), "up")
        climbed = path.join(up, (F.col("tree") == F.col("u_tree")) & (F.col("message") == F.col("u_message"))).select(
            "tree", F.col("up").alias("message"), (F.col("place") - 2 ** k).alias("place"))
        path = staged(path.unionByName(climbed), "reply-path")
    return path


def _formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
        yield pd.DataFrame({"tree": batch["tree"], "formatted": [x for x, _ in out], "loss_spans": [[{"start": a, "end": b} for a, b in spans] for _, spans in out]})


def format_paths(messages: DataFrame) -> DataFrame:
    """(tree, formatted, loss_spans) of each tree's best path.

    ``messages``: tree, message, parent, score, role, text. Null roles and texts are empty strings.
    Repeated (tree, message) rows count once, with the least role and text. A conversation is one
    row by nature, so all its turns meet in one task; nothing else does.
    """
    texts = messages.groupBy(F.col("tree").alias("t_tree"), F.col("message").alias("t_message")).agg(
        F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"))
    turns = best_paths(messages).join(texts, (F.col("tree") == F.col("t_tree")) & (F.col("message") == F.col("t_message"))).groupBy("tree").agg(
        F.expr("transform(sort_array(collect_list(struct(place, said))), x -> x.said)").alias("turns"))
    return turns.mapInPandas(_formatted, "tree string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Conversations kept as rows by turn, as reply trees without branches.

    Rows with the same turn follow each other by role and text; a null turn comes first. Rows with a
    null conversation id belong to one conversation of that id, whose tree is the empty string.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("message"))
    return seq.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "message",
                      F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def _read_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for formatted, spans in zip(batch["formatted"], batch["loss_spans"]):
            turns = parse_turns(formatted)
            loss = "".join(_UNESCAPE.sub(r"\1", formatted[s["start"]:s["end"]]) for s in spans)
            out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        cols = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pd.concat([batch[["tree"]].reset_index(drop=True), pd.DataFrame(out, columns=cols)], axis=1)


def op3_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation and of conversation -7, read back from the formatted text."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(r"select -7L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role), r'\### Assistant: </turn> ok' as text")
    out = format_paths(linear_messages(rows.unionByName(extra)))
    done = out.mapInPandas(_read_back, "tree string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return done.select(F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: The same from the rows by turn; the template's length and digests need no read-back here.
OP3_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e as (
  select *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '###', ''))) // 3
    + (length(text) - length(replace(text, '</turn>', ''))) // 7 + length(role) + 4 + 2 + 9 as chars from r
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""
