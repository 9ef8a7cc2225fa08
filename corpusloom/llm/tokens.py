"""Token ids: exact word-wise encoding with the tokenizers library, and Parquet token files with selective reads."""

from __future__ import annotations

import re
import zlib
from json import loads
from struct import pack
from typing import Any
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm._base import bounded_batches, scratch, text_or_empty

#: Words whose ids a worker keeps; further words are encoded each time. Bounds a worker's memory, not what is encoded.
CACHED_WORDS = 600_000
_ENCODERS: dict[tuple[int, int, bool], Any] = {}
#: Characters that Python and the library's patterns may treat differently as white space.
_ODD_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a letter: printable bytes as themselves, the others from U+0100 on, in order."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(others)}


_LETTERS = _byte_letters()
_TAIL = ".,;:!?"


class Encoder:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, control strings of the tokenizer in a text included;
    with ``plain`` those are ordinary text.

    Both kinds of tokenizer cut a text at white space before anything else: no token reaches from one word into the next, nor from letters
    into the stops after them. So texts are cut there, the library's model encodes each distinct word of letters, the library's whole chain
    any other piece, and the ids are put together again. ``spaced`` says that a piece includes the blank before it (byte-level BPE); there,
    runs of blanks or of empty lines and tabs, and in either kind odd white space and control strings, send the whole text through the library.
    """

    def __init__(self, json: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.raw = Tokenizer.from_str(json)
        self.raw.encode_special_tokens = plain
        control = [] if plain else [t["content"] for t in loads(json).get("added_tokens") or [] if t["content"]]
        self.control = re.compile("|".join(map(re.escape, control)), re.I) if control else None
        self.openings = {c for t in control for c in (t[0].lower(), t[0].upper())}
        self.model = self.raw.model
        self.spaced = not loads(json)["model"].get("end_of_word_suffix")
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.raw.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None where it has to go through the library whole."""
        if _ODD_SPACE.search(text):
            return None
        if not self.spaced:
            return text.split()
        out: list[str] = []
        blank = False
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append("\n")
            if not line:
                if blank:  # a longer run of line ends is cut elsewhere
                    return None
                blank = True
                continue
            blank = False
            first, *rest = line.split(" ")
            if not first or "" in rest or "\t" in line or "\r" in line:
                return None
            out.append(first)
            out += [" " + w for w in rest]
        return out

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(self.words) < CACHED_WORDS and len(piece) < 40:
            self.words[piece] = ids
        return ids

    def _word(self, piece: str) -> bytes:
        """A piece without stops at its end."""
        found = self.words.get(piece)
        if found is not None:
            return found
        if not (piece[1:] if self.spaced and piece[0] == " " else piece).isalpha():
            return self._keep(piece, self._whole(piece))
        flat = piece
        if not self.spaced:  # this kind lower-cases and composes
            flat = piece.lower()
            if not piece.isascii() and (flat != piece or not is_normalized("NFC", piece)):
                return self._keep(piece, self._whole(piece))
            if flat != piece:
                return self._word(flat)
        ids = [t.id for t in self.model.tokenize(flat.encode().decode("latin-1").translate(_LETTERS))]
        return self._keep(piece, pack(f"<{len(ids)}I", *ids))

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(_TAIL)
        if len(core) == len(piece) or not core:
            return self._word(piece)
        if not core[-1].isalnum():
            return self._keep(piece, self._whole(piece))
        return self._keep(piece, self._word(core) + self._word(piece[len(core) :]))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.control and any(c in text for c in self.openings) and self.control.search(text):
            return self._whole(text)
        pieces = self._cut(text)
        if pieces is None:
            return self._whole(text)
        get, new = self.words.get, self._piece
        return b"".join([get(w) or new(w) for w in pieces])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


def encoder(json: str, plain: bool = False) -> Encoder:
    """One per worker process and tokenizer."""
    key = (len(json), hash(json), plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json, plain)
    return _ENCODERS[key]


def share_tokenizer(spark: SparkSession, path: str):
    """Reads a tokenizer file (a few MB, whatever the input) on the driver and sends it to the executors, which need no file of their own."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int, path: str | None = None, delta: bool = False, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, parts: int | None = None) -> str:
    """Writes token files and returns their folder: Parquet, columns doc_id, n_tokens and tokens (a list of 32-bit ids ended by ``end_id``).

    Rows lie in ascending doc_id order within and across files, so that row-group statistics and page indexes let a reader of some ids skip
    the rest, and a reader of metadata never touches the token pages. Ids are dictionary-encoded (``delta``: format-2 pages, delta binary
    packing). Null texts are empty and have the end id alone; null ids come first; repeated ids lie side by side. An empty table gives files
    without rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    json = share_tokenizer(spark, tokenizer)
    path = path or scratch(spark, "tokens")

    def run(batches):
        enc, end = encoder(json.value), np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode_many(b.column(1).to_pylist())]
            lens = np.array([len(x) // 4 for x in ids], np.int64)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lens.cumsum()]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens), tokens], ["doc_id", "n_tokens", "tokens"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    placed = (body.repartitionByRange(parts, "doc_id") if parts else body.repartitionByRange("doc_id")).sortWithinPartitions("doc_id")
    writer = placed.mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>").write
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", not delta)
    if delta:
        writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(path)
    return path


_FORMAT = "doc_id long, n_tokens long, tokens array<int>"


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Selective read: the filter on doc_id reaches row groups and pages, and only the named columns are read."""
    df = spark.read.schema(_FORMAT).parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def crc_of_tokens(df: DataFrame) -> DataFrame:
    """Adds ids_crc32: the unsigned crc32 of the ids as little-endian unsigned 32-bit integers, in place of ``tokens`` (the last column)."""

    def run(batches):
        for b in batches:
            lists = b.column(b.num_columns - 1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], crc], [*b.schema.names[:-1], "ids_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{kinds}, ids_crc32 long")


def token_starts(df: DataFrame, group: str = "file", order: tuple[str, ...] = ("doc_id",), size: str = "n_tokens", out: str = "start", narrow: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the tokens of all rows before, in the order of ``group`` (a file of a sorted set, by its least doc_id) and ``order``.

    Sums over files (a row each) are accumulated in one small window, those within a file in a window by file: no task sees all rows.
    ``narrow``: the same rows by a cheaper plan, for the sums.
    """
    sums = (df if narrow is None else narrow).groupBy(group).agg(F.sum(size).alias("__sum"), F.min(F.struct(*order)).alias("__low"))
    before = Window.orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(group, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__in", F.coalesce(F.sum(size).over(within), F.lit(0))).join(bases, group).withColumn(out, F.col("__base") + F.col("__in")).drop("__in", "__base")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. ``start`` counts the ids of all documents before it."""
    bounded_batches(spark)
    raw = spark.read.schema(_FORMAT).parquet(path).select("doc_id", "n_tokens", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"), "tokens")
    return token_starts(crc_of_tokens(raw), order=("doc_id", "row"), narrow=raw.drop("tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
