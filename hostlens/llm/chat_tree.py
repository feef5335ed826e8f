"""Conversations as one stream of tokens in which shared initial turns stand once (prefix tree).

A turn is formatted as ``<|im_start|>role``, line end, text, ``<|im_end|>``, line end;
``\\`` and ``<|`` in roles and texts (and line ends in roles) are escaped, so that control
strings occur only as marks.  Tokens are code points of the formatted text.

Conversations whose first turns agree share the nodes of a prefix tree.  A node belongs
to the least conversation that passes it, so every conversation owns a suffix of its
turns, its *branch* (nothing, if all its turns are another's).  Branches are laid out
depth-first: after a branch come those that leave it, deepest first, then by id.  So
each node's tokens are emitted once, and a conversation is a list of intervals of the
stream: parts of its ancestors' branches and its own.

1. Turns without texts (id, digest, length) are sorted by conversation; a chained digest
   names each prefix.  Prefixes are grouped (pre-aggregated) for their least conversation.
2. A branch's path, ``(-depth, owner)`` from the root, orders the stream: range partitions,
   running sums within them, and one offset for each partition.
3. Texts meet their conversation's layout in one shuffle and are streamed in order.

``layout`` gives paths, ``emit`` the rows of the stream, ``read_back`` the conversations from
those rows: a conversation that is one row on its own is read where it lies, the others
by joining their intervals to the rows of the owners.

Defined results: a null text or role is empty; rows of a conversation come by turn (null
first), then role and text; repeated rows are repeated turns; rows with a null
conversation id are one conversation, whose id stays null; an empty table gives no
rows; only ``conv_id, turn, role, text`` are read.  A conversation of any length is
streamed through one task, in rows of about ``piece_chars``; a single text is held whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

START, END = "<|im_start|>", "<|im_end|>"
NO_ID = -(2**63)  # stands for a null conversation id inside the operator
PIECE_CHARS = 1 << 20

CHAINED = "conv bigint, k bigint, node binary, length bigint, position bigint"
STREAM = ("conv_id bigint, tree bigint, start bigint, n_tokens bigint, position bigint, n_turns bigint, tokens string, "
          "loss array<struct<first:bigint,end:bigint>>, attends array<struct<start:bigint,end:bigint>>, whole boolean, shared boolean")
READ = ("conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


# ---- the template -------------------------------------------------------------------------------------------------------

def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends in it."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def parse_turns(tokens: str):
    """(role, text, first, end) of each turn of whole formatted turns; ``first, end`` as ``format_turn``, from the beginning."""
    at = 0
    while at < len(tokens):
        line = tokens.index("\n", at)
        end = tokens.index(END, line + 1)
        yield unescape(tokens[at + len(START):line]), unescape(tokens[line + 1:end]), line + 1, end
        at = end + len(END) + 1


def _formatted_length(role, text):
    """Code points of the formatted turn, as a Column."""
    def escaped(c):
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))

    marks = len(START) + len(END) + 2
    return (F.char_length(F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))) + F.char_length(escaped(text)) + marks).cast("bigint")


# ---- layout --------------------------------------------------------------------------------------------------------------

def _turns(df: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return df.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_ID)).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
                     role.alias("role"), text.alias("text"))


def _chained(turns: DataFrame) -> DataFrame:
    """Each turn's number, the digest of all turns up to it, its formatted length and the length before it."""
    small = turns.select("conv", "turn", F.unhex(F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"))).alias("digest"),
                         "role", F.md5("text").alias("tie"), _formatted_length(F.col("role"), F.col("text")).alias("length"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie")]
    small = small.repartition("conv").sortWithinPartitions(*order).select("conv", "digest", "length")

    def run(batches):
        conv, k, chain, before = None, 0, b"", 0
        for batch in batches:
            out = []
            for c, digest, length in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    conv, k, chain, before = c, 0, b"", 0
                chain = hashlib.blake2b(chain + digest, digest_size=16).digest()
                out.append((c, k, chain, length, before))
                k, before = k + 1, before + length
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["conv", "k", "node", "length", "position"])

    return small.mapInArrow(run, CHAINED)


def _starts(branches: DataFrame) -> DataFrame:
    """(conv, start): the tokens of all branches before, by path."""
    n = int(branches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = branches.select("conv", "path", "tokens").repartitionByRange(n, "path").sortWithinPartitions("path")

    def run(batches):
        total = 0
        for batch in batches:
            size = batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total + np.cumsum(size) - size), batch.column(1), batch.column(2)],
                                             ["conv", "within", "tokens", "part"])
            total += int(size.sum())

    placed = saved(ordered.select("conv", "tokens", F.spark_partition_id().alias("part")).mapInArrow(
        run, "conv bigint, within bigint, tokens bigint, part int"), "chat-starts")
    bases, base = [], 0
    for part, size in placed.groupBy("part").agg(F.sum("tokens")).orderBy("part").collect():  # a row for each partition
        bases.append((part, base))
        base += size
    bases = placed.sparkSession.createDataFrame(bases, "part int, base bigint")
    return placed.join(F.broadcast(bases), "part").select("conv", (F.col("base") + F.col("within")).alias("start"))


def layout(df: DataFrame) -> DataFrame:
    """One row per conversation: ``conv``, ``n_turns``, ``tokens`` (its formatted length), ``path`` (its intervals of the
    stream in order: owner, start, end), ``own_turn`` and ``own_position`` (its branch begins there; null without one),
    ``start`` (of the branch) and ``shared`` (others pass through its branch)."""
    turns = saved(_chained(_turns(df)), "chat-turns")
    common = turns.groupBy("node").agg(F.min("conv").alias("owner"), F.count("*").alias("many")).where("many > 1").select("node", "owner")
    common = saved(common, "chat-nodes")
    owned = turns.join(common, "node", "left").withColumn("owner", F.coalesce("owner", "conv"))
    # the stretch of a conversation's path in each owner's branch; owners follow each other, each once
    part = owned.groupBy("conv", "owner").agg(F.min("k").alias("depth"), F.count("*").alias("turns"), F.sum("length").alias("tokens"),
                                              F.min("position").alias("position"))
    part = saved(part, "chat-parts")
    paths = part.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "owner", "turns", "tokens", "position"))).alias("parts"))
    paths = saved(paths.withColumn("last", F.element_at("parts", -1)), "chat-paths")
    branches = paths.where("last.owner = conv").select(
        "conv", F.transform("parts", lambda x: F.struct((-x["depth"]).alias("d"), x["owner"].alias("owner"))).alias("path"), F.col("last.tokens").alias("tokens"))
    starts = saved(_starts(branches), "chat-stream")
    through = part.where("conv <> owner").select(F.col("owner").alias("conv")).distinct().withColumn("shared", F.lit(True))
    # a conversation on its own needs no join: its one part is its branch
    placed = part.join(starts.select(F.col("conv").alias("owner"), "start"), "owner")
    placed = placed.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("depth", "owner", "start", (F.col("start") + F.col("tokens")).alias("end")))).alias("path"),
        F.sum("turns").alias("n_turns"), F.sum("tokens").alias("tokens"),
        *[F.max(F.when(F.col("owner") == F.col("conv"), F.col(c))).alias(n) for c, n in (("depth", "own_turn"), ("position", "own_position"), ("start", "start"))])
    placed = placed.join(through, "conv", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    return saved(placed.withColumn("path", F.transform("path", lambda x: F.struct(x["owner"].alias("owner"), x["start"].alias("start"), x["end"].alias("end")))),
                 "chat-layout")


# ---- the stream ------------------------------------------------------------------------------------------------------------

def emit(df: DataFrame, places: DataFrame, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """The stream's rows (``STREAM``): whole turns of one branch, about ``piece_chars`` at most, with the place of the first
    token (``start``) and its position id, spans of ``tokens`` under the loss mask, and the intervals of the stream that
    all tokens of the row attend to besides the tokens before them in the row: those of its ancestors and of earlier rows
    of the branch.  ``whole``: the row is a conversation by itself; ``shared``: other conversations pass its branch.

    Conversations lie one after the other in their tasks; sorted by ``start`` the rows are the stream, depth-first."""
    turns = _turns(df)
    own = places.where("own_turn is not null").select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("tie"),
        F.lit("").alias("text"), F.struct("own_turn", "own_position", "start", "shared", "path").alias("place"))
    rows = turns.select("conv", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("tie"), "text",
                        F.lit(None).cast(own.schema["place"].dataType).alias("place"))
    rows = own.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", F.col("turn").asc_nulls_first(), "role", "tie")
    names = [f.split()[0] for f in STREAM.split(", ")]
    struct = pa.struct([("first", pa.int64()), ("end", pa.int64())])
    between = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(struct), pa.list_(between), pa.bool_(), pa.bool_()]

    def run(batches):
        done: list[tuple] = []
        size = 0
        conv = place = None
        k, at, position, parts, held, loss = 0, 0, 0, [], 0, []

        def finish(last: bool):
            nonlocal parts, held, loss, at, position
            if parts:
                first = place["start"]
                attends = [{"start": p["start"], "end": p["end"]} for p in place["path"][:-1]]
                attends += [{"start": first, "end": at}] if at > first else []
                done.append((None if conv == NO_ID else conv, place["path"][0]["owner"], at, held, position, len(parts), "".join(parts), loss, attends,
                             last and at == first and place["own_turn"] == 0, place["shared"]))
                at, position = at + held, position + held
                parts, held, loss = [], 0, []

        def batch_out():
            cols = list(zip(*done)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            for c, kind, role, text, info in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("conv", "kind", "role", "text", "place"))):
                if c != conv:
                    finish(True)
                    conv, place, k = c, None, 0
                if kind == 0:
                    place, at, position = info, info["start"], info["own_position"]
                    continue
                if place is not None and k >= place["own_turn"]:
                    tokens, first, end = format_turn(role, text)
                    if parts and held + len(tokens) > piece_chars:
                        finish(False)
                    if role == "assistant":
                        loss.append({"first": held + first, "end": held + end})
                    parts.append(tokens)
                    held += len(tokens)
                    size += len(tokens)
                k += 1
                if size > 4 << 20:
                    yield batch_out()
                    size = 0
        finish(True)
        yield batch_out()

    return rows.select("conv", "kind", "role", "text", "place").mapInArrow(run, STREAM)


# ---- reading ------------------------------------------------------------------------------------------------------------------

class _Reader:
    """Digests of one conversation, fed with the rows of its turns in order."""

    def __init__(self):
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def feed(self, tokens: str, loss: list[dict]):
        masked = {(x["first"], x["end"]) for x in loss}
        for role, text, first, end in parse_turns(tokens):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
            if (first, end) in masked:
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.chars += len(tokens)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split()[0] for f in READ.split(", ")])


def read_back(stream: DataFrame, places: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation of ``layout``, parsed
    from rows of the stream."""

    def alone(batches):
        for batch in batches:
            out = []
            for c, tokens, loss in zip(*(col.to_pylist() for col in batch.columns)):
                reader = _Reader()
                reader.feed(tokens, loss)
                out.append((NO_ID if c is None else c, *reader.row()))
            yield _read_batch(out)

    single = stream.where("whole").select("conv_id", "tokens", "loss").mapInArrow(alone, READ)

    owner = F.coalesce("conv_id", F.lit(NO_ID))
    rows = stream.where("shared or not whole").select(owner.alias("owner"), "start", "n_tokens", "tokens", "loss", "whole")
    # conversations of several parts, or of a part of another's branch, or of several rows
    wanted = places.select("conv", F.posexplode("path").alias("nr", "x")).select("conv", "nr", "x.*")
    parts = wanted.join(rows.withColumnRenamed("start", "at"), "owner").where("at < end and at + n_tokens > start")
    parts = parts.where("not (whole and conv = owner)")  # read where it lies
    parts = parts.select("conv", "at", (F.col("start") - F.col("at")).alias("from"), (F.col("end") - F.col("at")).alias("to"), "nr", "tokens", "loss")
    parts = parts.repartition("conv").sortWithinPartitions("conv", "nr", "at").select("conv", "from", "to", "tokens", "loss")

    def joined(batches):
        conv, reader = None, None
        for batch in batches:
            out = []
            for c, first, end, tokens, loss in zip(*(col.to_pylist() for col in batch.columns)):
                if c != conv:
                    if reader is not None:
                        out.append((conv, *reader.row()))
                    conv, reader = c, _Reader()
                first, end = max(first, 0), min(end, len(tokens))
                reader.feed(tokens[first:end], [{"first": x["first"] - first, "end": x["end"] - first} for x in loss])
            yield _read_batch(out)
        yield _read_batch([(conv, *reader.row())] if reader is not None else [])

    several = parts.mapInArrow(joined, READ)
    return single.unionByName(several).select(F.when(F.col("conv") != NO_ID, F.col("conv")).alias("conv_id"), *[f.split()[0] for f in READ.split(", ")][1:])


def format_conversations(df: DataFrame, piece_chars: int = PIECE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rows of the stream, layout) of all conversations."""
    places = layout(df)
    return emit(df, places, piece_chars), places


def write_stream(stream: DataFrame, folder: str) -> None:
    """The rows in the order of the stream, a range of places a file."""
    n = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream.repartitionByRange(n, "start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(folder)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(STREAM).parquet(folder)
