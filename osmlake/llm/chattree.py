"""Chat formatting with a prefix tree.

Conversations that share initial turns share the nodes of those turns.  Sorted
by their chain of turn digests, conversations lie in depth-first order of the
tree, so each partition of a range partitioning walks its part of the tree
with one stack and emits each shared node once.  The output is cut into packs
of a bounded size; a pack repeats only the nodes on the path at its beginning,
so neither a common first turn nor a third of all rows ends up in one task.

A pack holds one text (its tokens are the code points), and for each node its
interval in it, its first position id and the intervals of its ancestors: a
token attends to those and to what is before it in its own node.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm.runtime import partitions

#: The control strings of the template.
BOS, EOS, OPEN, CLOSE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]", "[/ROLE]"
ROLE = "[ROLE]"
CONTROLS = (BOS, EOS, OPEN, CLOSE, ROLE, ROLE_END)
#: The role whose text is learned.
LEARNED = "assistant"
#: Code points, beyond the shared part of the path it begins in, after which a pack is closed.
PACK = 1 << 16

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Double every backslash and put one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\")) if "\\" in text or "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, begin and end of the learned text in it)."""
    body = escape(text)
    if role == "user":
        return f"{BOS}{OPEN}{body}{CLOSE}", 0, 0
    if role == LEARNED:
        return f"{body}{EOS}", 0, len(body)
    return f"{ROLE}{escape(role)}{ROLE_END}{body}{EOS}", 0, 0


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if formatted.startswith(BOS + OPEN) and formatted.endswith(CLOSE):
        return "user", unescape(formatted[len(BOS + OPEN) : -len(CLOSE)])
    if not formatted.endswith(EOS):
        raise ValueError("a turn doesn't end")
    if formatted.startswith(ROLE):
        role, found, body = formatted[len(ROLE) : -len(EOS)].partition(ROLE_END)
        if not found:
            raise ValueError("a role doesn't end")
        return unescape(role), unescape(body)
    return LEARNED, unescape(formatted[: -len(EOS)])


PACKS = (
    "text string, nodes array<struct<begin:long,end:long,position:long,parent:int,learn_begin:long,learn_end:long,ancestors:array<struct<begin:long,end:long>>>>, "
    "leaves array<struct<conv_id:long,node:int>>"
)


def path_of(turns: list[dict]) -> list[str]:
    """The chain of digests of a conversation's turns; role and text go in with their lengths, so no two turns read alike."""
    path, seen = [], b""
    for turn in turns:
        role, text = turn["role"].encode(), turn["text"].encode()
        seen = hashlib.sha256(b"%s%d,%d:%s%s" % (seen, len(role), len(text), role, text)).digest()[:16]
        path.append(seen.hex())
    return path


def with_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, path): the turns in order and the chain of their digests.

    Turns are ordered by turn, role and text, nulls first; a null role or text
    counts as empty.  Equal rows are turns of their own.  Rows with a null
    conv_id are one conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = pa.array(map(path_of, batch.column("turns").to_pylist()), pa.list_(pa.string()), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, paths], [*batch.schema.names, "path"])

    return grouped.mapInArrow(run, "conv_id long, turns array<struct<turn:long,role:string,text:string>>, path array<string>")


def pack(conversations: DataFrame, limit: int = PACK) -> DataFrame:
    """Packs of all conversations: (text, nodes, leaves), in depth-first order of the prefix tree.

    What the next conversation shares with the path a pack begins in doesn't
    count towards ``limit``, and one that adds nothing joins the open pack, so
    prefixes longer than a pack are shared too.  An empty table gives no packs.
    Extra columns are ignored.
    """
    turns = with_turns(conversations)
    sort_key = F.concat_ws("", F.col("path"))
    dealt = turns.withColumn("key", sort_key).repartitionByRange(partitions(conversations, 8 << 20), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    kinds = pa.schema(
        [
            ("text", pa.string()),
            ("nodes", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("parent", pa.int32()), ("learn_begin", pa.int64()), ("learn_end", pa.int64()), ("ancestors", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]))),
            ("leaves", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        nodes: list[dict] = []
        leaves: list[dict] = []
        stack: list[tuple[str, int]] = []  # (digest of the path so far, node)
        size = first = 0  # code points of the pack, nodes of the path it begins in

        def close() -> pa.RecordBatch:
            nonlocal texts, nodes, leaves, stack, size
            out = pa.RecordBatch.from_pylist([{"text": "".join(texts), "nodes": nodes, "leaves": leaves}], schema=kinds)
            texts, nodes, leaves, stack, size = [], [], [], [], 0
            return out

        for batch in batches:
            for conv_id, own, path in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turns", "path"))):
                common = 0
                while common < min(len(stack), len(path)) and stack[common][0] == path[common]:
                    common += 1
                del stack[common:]
                repeated = max((nodes[n]["end"] for _, n in stack if n < first), default=0)
                if leaves and common < len(path) and size - repeated >= limit:
                    yield close()
                    common = 0
                for digest, turn in zip(path[common:], own[common:]):
                    text, a, b = format_turn(turn["role"], turn["text"])
                    parent = stack[-1][1] if stack else -1
                    up = nodes[parent]["ancestors"] + [{"begin": nodes[parent]["begin"], "end": nodes[parent]["end"]}] if stack else []
                    at = nodes[parent]["position"] + nodes[parent]["end"] - nodes[parent]["begin"] if stack else 0
                    nodes.append({"begin": size, "end": size + len(text), "position": at, "parent": parent, "learn_begin": size + a, "learn_end": size + b, "ancestors": up})
                    texts.append(text)
                    size += len(text)
                    stack.append((digest, len(nodes) - 1))
                first = first if leaves else len(nodes)
                leaves.append({"conv_id": conv_id, "node": stack[-1][1]})
        if leaves:
            yield close()

    return dealt.select("conv_id", "turns", "path").mapInArrow(run, PACKS)


def position_ids(pack_row) -> list[int]:
    """The position id of every token of a pack: the place in its own conversation."""
    out: list[int] = []
    for n in pack_row["nodes"]:
        out += range(n["position"], n["position"] + n["end"] - n["begin"])
    return out


def read_packs(packs: DataFrame) -> DataFrame:
    """What the packs say of each conversation, read from their texts through the attention intervals.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    """
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, nodes, leaves = (batch.column(c)[k].as_py() for c in ("text", "nodes", "leaves"))
                parsed = [parse_turn(text[n["begin"] : n["end"]]) for n in nodes]
                learned = [unescape(text[n["learn_begin"] : n["learn_end"]]) for n in nodes]
                at = {n["begin"]: i for i, n in enumerate(nodes)}
                out = []
                for leaf in leaves:
                    n = nodes[leaf["node"]]
                    path = [at[x["begin"]] for x in n["ancestors"]] + [leaf["node"]]
                    if [nodes[i]["position"] for i in path] != [sum(nodes[j]["end"] - nodes[j]["begin"] for j in path[:m]) for m in range(len(path))]:
                        raise ValueError("position ids don't follow the path")
                    turns = "".join(f"{parsed[i][0]}\n{parsed[i][1]}\n" for i in path)
                    loss = "".join(learned[i] for i in path)
                    out.append((leaf["conv_id"], len(path), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), n["position"] + n["end"] - n["begin"]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds.types)], schema=kinds)

    return packs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def round_trip(conversations: DataFrame) -> DataFrame:
    """Pack all conversations and read the packs back."""
    return read_packs(pack(conversations))
