"""Chat formatting by quotation linking: conversations are rebuilt from the passages messages quote.

A message body is parsed line by line: leading ">" signs give the quote level, a line ending in
"wrote:" before a quote is an attribution, the rest is the message's own text. Passages are the
maximal runs of lines of one level, and each of their lines of five words or more; normalised (lower
case, single spaces, no punctuation) they are hashed. Quoted passages are joined with messages' own
passages of the same scope (a mailbox, a list, a channel; one for all if none is named); the original
is the earliest message that has the passage itself, and must be earlier than the quoting one. A
message's parent is the original of its quoted passage of the lowest level, of these the one of most
words. Following parents gives each message its conversation (the first message) and depth.

Result, one row for each message: its conversation, parent, depth and own text without quotes;
ordered by depth and time within a conversation it is the reply order (`in_reply_order` writes it so,
range-partitioned, whatever a conversation's size). Originals are aggregated before the join, so a
passage that a third of all messages have is one row on that side. Null and empty bodies have no
passage and begin conversations. An id is a number or a struct; repeated ids are reduced to one row
(the least time, then body), null ids too: who may have such rows gives them ids of their own, as
`as_mail` does. Messages of unknown time are no originals and have no parent. An empty table gives an
empty result. Columns other than the four named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docplan.llm.common import settled

LINE_WORDS = 5
_QUOTE = re.compile(r"(?:[ \t]*>)+")
_WORD = re.compile(r"[^\W_]+")


def _normal(text: str) -> tuple[int, int]:
    """Hash and number of the words of a passage."""
    words = _WORD.findall(text.lower())
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63), len(words)


def parsed(body: str) -> tuple[str, list[tuple[int, int, int]]]:
    """Own text, and (level, hash, words) of every passage with a word."""
    runs: list[tuple[int, list[str]]] = []
    lines = body.split("\n")
    levels, contents = [], []
    for line in lines:
        signs = _QUOTE.match(line)
        levels.append(signs.group().count(">") if signs else 0)
        contents.append(line[signs.end() :].removeprefix(" ") if signs else line)
    for k, (level, content) in enumerate(zip(levels, contents)):
        if k + 1 < len(lines) and levels[k + 1] > level and content.rstrip().endswith("wrote:"):
            continue
        if runs and runs[-1][0] == level:
            runs[-1][1].append(content)
        else:
            runs.append((level, [content]))
    passages = []
    for level, own in runs:
        for part in ["\n".join(own), *(own if len(own) > 1 else [])]:
            key, count = _normal(part)
            if count and (count >= LINE_WORDS or part == "\n".join(own)):
                passages.append((level, key, count))
    return "\n".join(line for level, own in runs if level == 0 for line in own).strip("\n"), list(dict.fromkeys(passages))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [parsed(body or "") for body in batch.column(3).to_pylist()]
        counts = [len(p) for _, p in found]
        flat = [q for _, p in found for q in p]
        ends = pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(counts)]).astype(np.int32))
        passages = pa.StructArray.from_arrays(
            [pa.array([q[0] for q in flat], pa.int32()), pa.array([q[1] for q in flat], pa.int64()), pa.array([q[2] for q in flat], pa.int32())],
            ["level", "passage", "n_words"])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([own for own, _ in found], pa.string()), pa.ListArray.from_arrays(ends, passages)],
            ["message", "scope", "sent", "own_text", "passages"])


def linked(messages: DataFrame, id_col: str = "message", sent_col: str = "sent", body_col: str = "body", scope_col: str | None = None) -> DataFrame:
    """message, scope, sent, own_text, parent, conversation and depth of every message."""
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    kind = messages.schema[id_col].dataType
    kind = kind.simpleString() if isinstance(kind, StructType) else "bigint"
    taken = messages.select(F.col(id_col).cast(kind).alias("message"), F.coalesce(scope, F.lit("")).alias("scope"),
                            F.col(sent_col).cast("bigint").alias("sent"), F.col(body_col).cast("string").alias("body"))
    first = F.min(F.struct("sent", "scope", "body")).alias("one")
    single = taken.groupBy("message").agg(first).select("message", "one.scope", "one.sent", "one.body")
    told = settled(single.mapInArrow(
        _parse, f"message {kind}, scope string, sent bigint, own_text string, passages array<struct<level:int,passage:bigint,n_words:int>>"))
    passages = told.select("message", "scope", "sent", F.explode("passages").alias("p")).select("message", "scope", "sent", "p.*")
    originals = passages.where("level = 0 and sent is not null").groupBy("scope", "passage").agg(F.min(F.struct("sent", "message")).alias("original"))
    quotes = passages.where("level > 0")
    parents = quotes.join(originals, ["scope", "passage"]).where("original.sent < sent").groupBy("message").agg(
        F.min(F.struct("level", -F.col("n_words"), -F.col("original.sent"), "original.message")).alias("best")).select(
        "message", F.col("best.message").alias("parent"))
    placed = settled(told.drop("passages").join(parents, "message", "left").select(
        "*", F.coalesce("parent", "message").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth")))
    # doubling: each round the links of messages that have not met a finished one go twice as far up
    done, climbing = placed.where("parent is null").select("message", "up", "depth"), placed.where("parent is not null").select("message", "up", "depth")
    over = lambda rows: rows.toDF("up", "next", "further")
    step = ("message", F.col("next").alias("up"), (F.col("depth") + F.col("further")).alias("depth"))
    while True:
        finished = settled(climbing.join(over(done), "up").select(*step))
        climbing = settled(climbing.join(over(climbing), "up").select(*step))
        done = done.unionByName(finished)
        if not climbing.limit(1).count():
            break
    ways = done.toDF("own", "conversation", "far")
    return placed.join(ways, placed["message"].eqNullSafe(ways["own"])).select(
        "message", "scope", "sent", "own_text", "parent", "conversation", F.col("far").alias("depth"))


def in_reply_order(found: DataFrame) -> DataFrame:
    """The messages of `linked`, each conversation's together and in reply order."""
    keys = ("conversation", "depth", "sent", "message")
    return found.repartitionByRange(*keys).sortWithinPartitions(*keys)


def as_mail(conversations: DataFrame) -> DataFrame:
    """Turns as messages that quote the turn before at level 1 and the one before that at level 2.

    A message's id is its conversation, turn, and number in the conversation. Rows without a
    conversation belong to none: each is alone in its scope. Rows without a turn quote nothing and
    are not quoted.
    """
    order = "order by turn, role, text"
    before = lambda k: f"lag(struct(role, text), {k}) over (partition by conv_id, lost {order})"
    quoted = lambda text, sign: rf"concat('{sign} ', regexp_replace({text}, '\n', '\n{sign} '), '\n')"
    # a row that lacks conversation or turn is a partition of its own
    alone = conversations.withColumn("lost", F.expr("if(conv_id is null or turn is null, monotonically_increasing_id(), null)"))
    return alone.selectExpr("conv_id", "turn", "text", f"{before(1)} as one", f"{before(2)} as two",
                            f"coalesce(lost, row_number() over (partition by conv_id, lost {order})) as copy").selectExpr(
        "struct(conv_id, turn, copy) as message", "turn as sent",
        "if(conv_id is null, concat('lost ', copy), cast(conv_id as string)) as scope",
        rf"concat(case when one.text is null then '' else concat(coalesce(one.role, 'someone'), ' wrote:\n', "
        rf"case when two.text is null then '' else concat('> ', coalesce(two.role, 'someone'), ' wrote:\n', {quoted('two.text', '>>')}) end, "
        rf"{quoted('one.text', '>')}) end, coalesce(text, '')) as body")


def threads(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, parent, conversation (turns of the same conversation), depth and own_text of every row."""
    return linked(as_mail(conversations), scope_col="scope").selectExpr(
        "message.conv_id as conv_id", "message.turn as turn", "parent.turn as parent", "conversation.turn as conversation",
        "cast(depth as int) as depth", "own_text")
