"""Chat formatting with shared prefixes: conversations as a prefix forest.

Each turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can close or open a
turn, and the change can be undone.

A turn's node is the hash of its parent's node, role and text: conversations that
begin alike have the same first nodes. Conversations are ranked by their path of nodes,
which is depth-first order; a node belongs to the first conversation that has it, and
is emitted there, once in the whole corpus. The nodes' tokens follow each other in this
order; each has its token ids, the place where it begins, the position of its first token in its
conversation, and the intervals of places that hold its ancestors and may be attended
to. Nodes that conversations share move once; conversations only name them.

Every conversation streams through one task in the order of its turns, so neither a
common first turn nor many equal conversations make a large group, and places are sums
over ranges of the order, of which only one number for each partition is gathered.

Defined cases: null roles and texts are empty, turns with the same number are
ordered by role and text and all kept, a null conversation id is a conversation of
its own, and an empty table gives no rows. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from fabula.llm import words as W
from fabula.llm.cluster import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "conv string, conv_id bigint, turn_no int, node binary, parent binary, text string, loss_begin int, loss_end int, path string"
SPANS = "conv string, conv_id bigint, node binary, depth int, position bigint, attends array<struct<begin:bigint,end:bigint>>"
_INTERVALS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_ROWS, _CHARS = 2000, 4 << 20
#: Digits of a path for each turn, how many of them deal conversations to tasks at a time, and how many
#: conversations with different paths may be dealt together because they are alike in these.
_STEP, _DEALT, _TIED = 16, 2048, 1000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = f"{OPEN}{escape(role)}".replace("\n", "\\n") + "\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = turn.removeprefix(OPEN).partition("\n")
    return unescape(head), unescape(rest.removesuffix(f"{CLOSE}\n"))


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in re.sub("<.*?>", "", schema).split(", ")]


def characters(texts: list[str]) -> list[list[int]]:
    """Code points as tokens."""
    return [list(map(ord, t)) for t in texts]


def pieces(vocabulary) -> Callable[[list[str]], list[list[int]]]:
    """The token ids of a SentencePiece vocabulary."""
    from fabula.llm.pieces import encode_texts

    return lambda texts: encode_texts(vocabulary, texts)


def turn_nodes(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formatted turns with their nodes, and after each conversation a row with its path
    (conv_id, number of turns, last node). Turns stream; of a conversation only its path is held."""
    types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, conv_id, node, number, path, size = None, None, b"", 0, bytearray(), 0
        for batch in batches:
            for conv, key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "role", "text")), strict=True):
                if conv != current:
                    if number:
                        out.append((current, conv_id, number, node, None, None, None, None, path.hex()))
                    current, conv_id, node, number, path = conv, key, b"", 0, bytearray()
                piece, begin, end = render(role, text)
                mark = hashlib.blake2b(node, digest_size=16)
                mark.update(piece.encode())
                parent, node = node, mark.digest()
                loss = (begin, end) if role in loss_roles else (None, None)
                out.append((conv, key, number, node, parent, piece, *loss, None))
                path += node[: _STEP // 2]
                number, size = number + 1, size + len(piece)
                if len(out) >= _ROWS or size >= _CHARS:
                    yield _batch(out, types, _names(TURNS))
                    out, size = [], 0
        if number:
            out.append((current, conv_id, number, node, None, None, None, None, path.hex()))
            yield _batch(out, types, _names(TURNS))

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    key = F.col("conv_id").cast("long")
    rows = conversations.select(F.coalesce(key.cast("string"), F.lit("null")).alias("conv"), key.alias("conv_id"), "turn", blank("role"), blank("text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn").mapInArrow(chain, TURNS)


def running_sum(rows: DataFrame, deal: list, order: list[str], value: str, out: str) -> DataFrame:
    """The rows with ``out``: the sum of ``value`` over all rows before. Tasks get ranges of
    ``deal`` and sort by ``order``; of each range one number is gathered."""
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_before", LongType())])
    at = rows.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            before = []
            for n in batch.column(at).to_pylist():
                before.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(before, pa.int64())], names=schema.names)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(rows.repartitionByRange(parts, *deal).sortWithinPartitions(*order).mapInArrow(run, schema), "ranges")
    sums = {r["_part"]: r["n"] for r in local.groupBy("_part").agg(F.sum(value).alias("n")).collect()}
    starts = [(p, sum(n for q, n in sums.items() if q < p)) for p in sums]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _offset bigint")
    return local.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_offset")).drop("_part", "_before", "_offset")


@dataclass
class PrefixForest:
    """nodes: each shared turn once (node, parent, depth, begin, n_tokens, ids, position, attends, text,
    loss_begin, loss_end). members: (conv, conv_id, turn_no, node). conversations: (conv_id,
    n_turns, n_tokens, attends)."""

    nodes: DataFrame
    members: DataFrame
    conversations: DataFrame


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and intervals of the nodes that a conversation owns, and of its end."""
    types = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), _INTERVALS]
    out: list[tuple] = []
    current, conv_id, number, position = None, None, 0, 0
    intervals: list[list[int]] = []
    listed = lambda: [{"begin": b, "end": e} for b, e in intervals]
    for batch in batches:
        for conv, key, node, own, begin, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "node", "own", "begin", "n_tokens")), strict=True):
            if conv != current:
                if number:
                    out.append((current, conv_id, None, number, position, listed()))
                current, conv_id, number, position, intervals = conv, key, 0, 0, []
            if own:
                out.append((None, None, node, number, position, listed()))
            if intervals and intervals[-1][1] == begin:
                intervals[-1][1] += n
            else:
                intervals.append([begin, begin + n])
            number, position = number + 1, position + n
            if len(out) >= _ROWS:
                yield _batch(out, types, _names(SPANS))
                out = []
    if number:
        out.append((current, conv_id, None, number, position, listed()))
    if out:
        yield _batch(out, types, _names(SPANS))


def _dealing(paths: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows (conv, path) with columns that deal them by ranges in the order of paths, and these columns.

    The first digits of a path deal most. Conversations that are alike in them have a common
    beginning, however long; what follows it deals them further, until few different paths are left
    together. Equal paths are dealt by conversation."""
    rows, keys = paths.withColumn("_k0", F.substring("path", 1, _DEALT)), ["_k0"]

    @F.arrow_udf("int")
    def shared(low: pa.Array, high: pa.Array) -> pa.Array:
        return pa.array([len(os.path.commonprefix(x)) for x in zip(low.to_pylist(), high.to_pylist(), strict=True)], pa.int32())

    while True:
        alike = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("path").alias("_low"), F.max("path").alias("_high")).where("_n > 1")
        alike = materialize(alike.withColumn("_same", F.col("_low") == F.col("_high")), "alike-paths")
        tied = alike.where((F.col("_n") > _TIED) & ~F.col("_same"))
        if not tied.head(1):
            break
        starts = tied.select(*keys, (shared("_low", "_high") + 1).alias("_start"))
        key = f"_k{len(keys)}"
        rows = rows.join(starts, keys, "left").withColumn(key, F.coalesce(F.substring(F.col("path"), F.col("_start"), F.lit(_DEALT)), F.lit(""))).drop("_start")
        rows, keys = materialize(rows, "dealt-paths"), [*keys, key]
    equal = alike.where("_same").select(*keys, "_same")
    rows = rows.join(equal, keys, "left").withColumn("_own", F.when(F.col("_same"), F.col("conv")).otherwise(F.lit(""))).drop("_same")
    return rows, [*keys, "_own"]


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), tokens: Callable[[list[str]], list[list[int]]] = characters, count: Callable[[list[str]], list[list[int]]] | None = None) -> PrefixForest:
    """The prefix forest of all conversations. ``tokens`` gives the token ids of formatted turns (``count`` is its
    older name); turns are encoded one by one, so those of a conversation follow each other."""
    tokens = count or tokens
    made = materialize(turn_nodes(conversations, loss_roles), "turns")
    turns, ends = made.where("path is null"), made.where("path is not null")
    one, deal = _dealing(ends.select("conv", "path", F.lit(1).alias("one")))
    ranks = running_sum(one, deal, ["path", "conv"], "one", "rank").select("conv", "rank")
    ranked = turns.select("conv", "conv_id", "turn_no", "node").join(ranks, "conv")
    owner = ranked.groupBy("node", (F.xxhash64("node") % 2).alias("half")).agg(F.min("rank").alias("owner")).drop("half")
    members = materialize(ranked.join(owner, "node"), "members")

    kept = StructType([StructField(f.name, f.dataType) for f in turns.select("node", "parent", "text", "loss_begin", "loss_end", "turn_no").schema] + [StructField("owner", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text", 1 << 20):
                ids = tokens(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64())], names=kept.names)
            W.release()

    own = members.where("rank = owner").select("conv", "turn_no", "owner")
    texts = turns.join(own, ["conv", "turn_no"]).select(*kept.names[:-2])
    nodes = running_sum(texts.mapInArrow(counted, kept), ["owner", "turn_no"], ["owner", "turn_no"], "n_tokens", "begin")
    nodes = materialize(nodes, "nodes")
    placed = members.select("conv", "conv_id", "turn_no", "node", (F.col("rank") == F.col("owner")).alias("own")).join(nodes.select("node", "begin", "n_tokens"), "node")
    spans = placed.repartition("conv").sortWithinPartitions("conv", "turn_no").drop("turn_no").mapInArrow(_spans, SPANS)
    spans = materialize(spans, "spans")
    whole = nodes.drop("turn_no", "owner").join(spans.where("node is not null").select("node", "depth", "position", "attends"), "node")
    of = spans.where("node is null").select("conv_id", F.col("depth").alias("n_turns"), F.col("position").alias("n_tokens"), "attends")
    return PrefixForest(whole, members.select("conv", "conv_id", "turn_no", "node"), of)


def read_conversations(forest: PrefixForest) -> DataFrame:
    """Every conversation's digests, read from the forest alone, turn by turn."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, conv_id, n, loss_chars, chars, turns, loss = None, None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            for conv, key, text, begin, end in zip(*(batch.column(c).to_pylist() for c in ("conv", "conv_id", "text", "loss_begin", "loss_end")), strict=True):
                if conv != current:
                    if n:
                        out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    current, conv_id, n, loss_chars, chars, turns, loss = conv, key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, said = parse(text)
                turns.update(f"{role}\n{said}\n".encode())
                if begin is not None:
                    masked = unescape(text[begin:end])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
                n, chars = n + 1, chars + len(text)
                if len(out) >= _ROWS:
                    yield _batch(out, types, _names(schema))
                    out = []
        if n:
            out.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield _batch(out, types, _names(schema))

    said = forest.members.join(forest.nodes.select("node", "text", "loss_begin", "loss_end"), "node")
    return said.drop("node").repartition("conv").sortWithinPartitions("conv", "turn_no").drop("turn_no").mapInArrow(read, schema)
