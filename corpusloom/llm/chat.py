"""Chat formatting as prefix trees: conversations that share first turns are merged, shared tokens are emitted once, depth first."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._base import bounded_batches, scratch
from corpusloom.llm.tokens import encoder, share_tokenizer

#: Code points after which a tree is closed where the next conversation shares no turn with it; a tree of ``TREE_MAX`` times as many is closed
#: anyway, as it is one row, and the next begins with its own copy of the turns that they share.
TREE_CHARS, TREE_MAX = 200_000, 16
_TREE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("position_ids", T.ArrayType(T.IntegerType())),
    T.StructField("node_token", T.ArrayType(T.IntegerType())), T.StructField("node_char", T.ArrayType(T.IntegerType())), T.StructField("node_parent", T.ArrayType(T.IntegerType())),
    T.StructField("attends", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("loss", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("conv_ids", T.ArrayType(T.LongType())), T.StructField("leaves", T.ArrayType(T.IntegerType())),
])


def escape(text: str) -> str:
    """Backslashes and bars get a backslash before them: ``<|`` and ``|>`` then never stand in an escaped text."""
    return re.sub(r"([\\|])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def open_turn(role: str) -> str:
    return f"<|{escape(role)}|>\n"


CLOSE = "<|end|>\n"


_HEAD = re.compile(r"<\|((?:\\.|[^\\|])*)\|>\n", flags=re.S)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    head = _HEAD.match(formatted)
    return unescape(head[1]), unescape(formatted[head.end() :].removesuffix(CLOSE))


class _Tree:
    def __init__(self):
        self.text: list[str] = []
        self.chars, self.tokens, self.positions = 0, [], []
        self.node_token, self.node_char, self.parent = [0], [0], []
        self.depth_end: list[int] = []  # tokens of a path up to and with the node
        self.attends, self.loss, self.conv_ids, self.leaves = [], [], [], []
        self.path: list[tuple[str, str]] = []
        self.nodes: list[int] = []

    def add(self, conv, turns, enc):
        same = 0
        while same < min(len(turns), len(self.path)) and turns[same] == self.path[same]:
            same += 1
        self.path, self.nodes = self.path[:same], self.nodes[:same]
        for role, text in turns[same:]:
            above = self.nodes[-1] if self.nodes else -1
            head, body = open_turn(role), escape(text)
            whole = head + body + CLOSE
            # Head, body and end are encoded by themselves, so that the loss begins and ends between tokens.
            parts = [np.frombuffer(enc.encode(x), "<u4").astype(np.int32) for x in (head, body, CLOSE)]
            ids = np.concatenate(parts)
            base = self.depth_end[above] if above >= 0 else 0
            if role == "assistant":
                at, token = self.chars + len(head), self.node_token[-1] + len(parts[0])
                self.loss.append([len(self.parent), at, at + len(body), token, token + len(parts[1])])
            self.text.append(whole)
            self.chars += len(whole)
            self.tokens.append(ids)
            self.positions.append(np.arange(base, base + len(ids), dtype=np.int32))
            span = [self.node_token[-1], self.node_token[-1] + len(ids)]
            seen = self.attends[above] if above >= 0 else []
            self.attends.append([*seen[:-1], span[1]] if seen and seen[-1] == span[0] else [*seen, *span])
            self.node_token.append(span[1])
            self.node_char.append(self.chars)
            self.parent.append(above)
            self.depth_end.append(base + len(ids))
            self.nodes.append(len(self.parent) - 1)
            self.path.append((role, text))
        self.conv_ids.append(conv)
        self.leaves.append(self.nodes[-1] if self.nodes else -1)

    def batch(self) -> pa.RecordBatch:
        row = ["".join(self.text), np.concatenate(self.tokens) if self.tokens else np.empty(0, np.int32), np.concatenate(self.positions) if self.positions else np.empty(0, np.int32), self.node_token, self.node_char, self.parent, self.attends, self.loss, self.conv_ids, self.leaves]
        ints = pa.list_(pa.int32())
        kinds = [pa.string(), ints, ints, ints, ints, ints, pa.list_(ints), pa.list_(ints), pa.list_(pa.int64()), ints]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], _TREE.names)


def format_trees(conversations: DataFrame, tokenizer: str, *, tree_chars: int = TREE_CHARS) -> DataFrame:
    """Trees of conversations (rows conv_id, turn, role, text), in the order of their first turns.

    A tree has the formatted text, its token ids and their position ids (which count along a path, not along the tree), nodes (a turn each:
    ends in tokens and code points, parent), for each node the token intervals it attends to (its ancestors' and, causally, its own; intervals
    that meet are one), the loss spans [node, begin, end, first token, token after the last], and for each conversation its last node.
    Conversations are range-partitioned by the hashes of their turns, so that shared first turns lie side by side whatever their number;
    where a partition or the size of a tree ends it, the next begins with its own copy of them.

    Null roles and texts are empty; turns are ordered by turn (null first), role, text; repeated rows are turns of their own; each row without
    conv_id is a conversation of its own. A conversation, however long, is in one tree. Other columns are not read. An empty table gives no
    trees.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    json = share_tokenizer(spark, tokenizer)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    convs = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).unionByName(alone)
    order = F.array_join(F.transform("turns", lambda t: F.substring(F.md5(F.concat(t["role"], F.lit("\n"), t["text"])), 1, 16)), "")
    placed = convs.withColumn("path", order).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches):
        enc, tree = encoder(json.value, plain=True), None
        for b in batches:
            for conv, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                turns = [(t["role"], t["text"]) for t in said]
                if tree is not None and tree.chars >= tree_chars * (TREE_MAX if tree.path[:1] == turns[:1] else 1):
                    yield tree.batch()
                    tree = None
                tree = tree or _Tree()
                tree.add(conv, turns, enc)
        if tree is not None:
            yield tree.batch()

    return placed.select("conv_id", "turns").mapInArrow(run, _TREE)


def write_trees(trees: DataFrame, path: str | None = None) -> str:
    path = path or scratch(trees.sparkSession, "chat")
    trees.write.parquet(path)
    return path


def read_conversations(spark, path: str) -> DataFrame:
    """From written trees, a row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, position_end."""

    def run(batches):
        for b in batches:
            for t in b.to_pylist():
                spans: dict[int, list] = {}
                for node, i, j, _, _ in t["loss"]:
                    spans.setdefault(node, []).append((i, j))
                out = []
                for conv, leaf in zip(t["conv_ids"], t["leaves"], strict=True):
                    path = []
                    while leaf >= 0:
                        path.append(leaf)
                        leaf = t["node_parent"][leaf]
                    path.reverse()
                    turns, loss = hashlib.sha256(), []
                    chars = tokens = 0
                    for k in path:
                        i, j = t["node_char"][k], t["node_char"][k + 1]
                        role, text = read_turn(t["text"][i:j])
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        loss += [unescape(t["text"][x:y]) for x, y in spans.get(k, [])]
                        chars += j - i
                        tokens += t["node_token"][k + 1] - t["node_token"][k]
                    said = "".join(loss)
                    last = t["position_ids"][t["node_token"][path[-1] + 1] - 1] if path else -1
                    out.append((conv, len(path), turns.hexdigest(), len(said), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), chars, tokens, last))
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "position_end"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if "sha" in n else pa.int64()) for i, n in enumerate(names)], names)

    bounded_batches(spark)
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, position_end long"
    return spark.read.schema(_TREE).parquet(path).mapInArrow(run, kinds)
