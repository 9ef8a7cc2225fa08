"""WARC archives with a two-level capture index: compressed blocks of sorted URL keys under a sparse block directory."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._base import bounded_batches, hot_split, scratch, written

#: Captures of a block, and bytes of an archive file, at most.
BLOCK_LINES, FILE_BYTES = 500, 1 << 30
#: Segments of the block directory at most: what a lookup shares with the executors has a row per segment, whatever the input's size.
SEGMENTS = 4096
_INDEX = "id long, first string, last string, n long, block binary"
_NIL = -(1 << 63)


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed and joined by commas, a closing bracket, path and query. Null or odd URLs sort under ``)``."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.coalesce(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit("")), F.lit(")"), F.coalesce(rest, F.lit("")))


def _member(head: list[str], block: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _head(kind: str, place: str, date: str) -> list[str]:
    """A record's id is made from its file and place there, so no two records share one, whatever repeats."""
    return ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>", f"WARC-Date: {date}"]


def _record(place: str, page: int | None, url: str, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = _head("response" if refers is None else "revisit", place, date)
    head += [f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode('utf-8', 'surrogatepass')), url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers}"]
    head += [f"X-Page: {'' if page is None else page}", "Content-Type: application/http; msgtype=response"]
    return _member(head, http if refers is not None else http + payload)


def _write(folder: str, date: str):
    def run(batches):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at, lines, decided, blocks = None, "", 0, [], (), 0
        part = TaskContext.get().partitionId()  # of a range partitioning: ids are in the order of the keys

        def block():
            packed = zlib.compress(json.dumps(lines, ensure_ascii=False).encode("utf-8", "surrogatepass"), 6)
            cols = [pa.array([part << 32 | blocks], pa.int64()), pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([len(lines)], pa.int64()), pa.array([packed], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["id", "first", "last", "n", "block"])

        for b in batches:
            for key, page, digest, first, url, payload in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if first is not None:  # a decision row comes before the rows that it is about
                    decided = (key, page, digest, first)
                    continue
                refers = decided[3] if decided[:3] == (key, page, digest) else None
                page = None if page == _NIL else page
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    # A new name for each attempt: the index names only files of attempts that ended.
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    info = _member([*_head("warcinfo", f"{name}:0", date), f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                data = _record(f"{name}:{at}", page, url or "", payload, digest, refers, date)
                out.write(data)
                lines.append([key, page, name, at, len(data), digest])
                at += len(data)
                if len(lines) >= BLOCK_LINES:
                    yield block()
                    blocks += 1
                    lines.clear()
        if out is not None:
            out.close()
        if lines:
            yield block()

    return run


def write_archives(pages: DataFrame, *, min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z", folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns (folder of the archives, capture index).

    Of rows with equal payloads (html as UTF-8, null: empty) of at least ``min_bytes`` bytes, those with the smallest page_id are responses
    and the others revisits of it; smaller payloads are all responses. Rows are range-partitioned by URL key and page, so each task writes its
    own files in key order, a gzip member per record, and the index blocks that go with them. A null page_id never is the smallest; null URLs
    are empty. Repeated rows each give a record of its own id. An empty table gives an index without blocks. Archives go through
    ``pyarrow.fs``, so the folder needs a scheme that it knows (file, hdfs, s3, gs, abfs).
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    folder = folder or scratch(spark, "warc")
    body = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(_NIL)).alias("page"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    body = body.withColumn("digest", F.sha2("payload", 256)).withColumn("key", url_key(F.col("url")))
    narrow = written(body.select("key", "page", "digest", F.octet_length("payload").alias("size")), "digests")
    large = narrow.where(F.col("size") >= min_bytes)
    known = F.when(F.col("page") != _NIL, F.col("page"))
    firsts = large.groupBy("digest").agg(F.count("*").alias("n"), F.min(known).alias("refers")).where("n > 1 and refers is not null")
    hot, rest, cold = hot_split(large.select("key", "page", "digest"), firsts, ["digest"], narrow.count())
    none = lambda kind: F.lit(None).cast(kind)
    decisions = hot.unionByName(rest.join(cold, "digest")).where("page <> refers").select("key", "page", "digest", "refers").distinct()
    # Decisions travel to the tasks that write as rows of their own, so payloads are shuffled once.
    rows = body.select("key", "page", "digest", none("long").alias("refers"), "url", "payload").unionByName(decisions.select("*", none("string").alias("url"), none("binary").alias("payload")))
    placed = rows.repartitionByRange("key", "page").sortWithinPartitions("key", "page", "digest", F.col("refers").desc_nulls_last())
    return folder, written(placed.mapInArrow(_write(folder, date), _INDEX), "capture-index")


def _parse(member: bytes) -> dict:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    refers = fields.get("X-Refers-To-Page")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    whole = fields["WARC-Type"] == "response"
    return {
        "page_id": int(fields["X-Page"]) if fields["X-Page"] else None, "url": fields["WARC-Target-URI"], "payload_bytes": len(payload) if whole else length,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None, "payload": payload if whole else None,
    }


_FIELDS = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _records(fs, base: str, lines: list, columns: list[str], files: dict):
    """The records of index lines, neighbouring ones in one range read."""
    i = 0
    while i < len(lines):
        j = i + 1
        while j < len(lines) and lines[j][2] == lines[i][2] and lines[j][3] == lines[j - 1][3] + lines[j - 1][4] and lines[j][3] - lines[i][3] < 8 << 20:
            j += 1
        name, low, high = lines[i][2], lines[i][3], lines[j - 1][3] + lines[j - 1][4]
        if name not in files:
            files.clear()
            files[name] = fs.open_input_file(f"{base}/{name}")
        files[name].seek(low)
        data = files[name].read(high - low)
        for k in range(i, j, 200):
            rows = [_parse(data[x[3] - low : x[3] - low + x[4]]) for x in lines[k : min(k + 200, j)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _FIELDS[c]) for c in columns], columns)
        i = j


def _fetch(folder: str, columns: list[str]):
    """Rows (id, key, block) sorted by id and key, a block before the keys that are looked for in it, to records."""

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        files: dict[str, object] = {}
        own, lines, names = None, [], []
        for b in batches:
            wanted: list = []
            for i, key, packed in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if packed is not None:
                    own, lines = i, json.loads(zlib.decompress(packed))
                    names = [x[0] for x in lines]
                elif i == own:
                    k = bisect_left(names, key)
                    while k < len(names) and names[k] == key:
                        wanted.append(lines[k])
                        k += 1
            yield from _records(fs, base, wanted, columns, files)

    return run


def _numbered(index: DataFrame) -> tuple[DataFrame, list]:
    """The block directory (id, first, last, segment), of at most ``SEGMENTS`` even segments in key order, and (first, last) of each segment."""
    directory = index.select("id", "first", "last", F.shiftright("id", 32).alias("part"))
    sizes = directory.groupBy("part").agg(F.count("*").alias("size"))  # a row per task that wrote
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = directory.join(sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")), "part").withColumn("rank", F.col("base") + F.col("id").bitwiseAND((1 << 32) - 1))
    each = max(1, -(-index.select("id").count() // SEGMENTS))
    numbered = written(ranked.select("id", "first", "last", F.floor(F.col("rank") / each).alias("segment")), "block-directory")
    rows = numbered.groupBy("segment").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("segment").collect()
    return numbered, [(r["first"], r["last"], r["segment"]) for r in rows]


def _covering(firsts: list, lasts: list, key: str):
    """Places whose range from first to last, in order, holds the key: binary search, then back over those that begin with it."""
    i = bisect_right(firsts, key)
    while i and lasts[i - 1] >= key:
        i -= 1
        yield i


def _segment_of(batches, top: list):
    firsts, lasts = [r[0] for r in top], [r[1] for r in top]
    for b in batches:
        out = [(top[i][2], key) for key in b.column(0).to_pylist() for i in _covering(firsts, lasts, key)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["segment", "key"])


def _blocks_of(batches):
    """Rows (segment, id, key, last) sorted by segment, the directory's (with ``last``) before the keys, to (id, key) of blocks to look into."""
    own, ids, firsts, lasts = None, [], [], []
    for b in batches:
        out = []
        for segment, i, key, last in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if segment != own:
                own, ids, firsts, lasts = segment, [], [], []
            if last is not None:
                ids.append(i), firsts.append(key), lasts.append(last)
            else:
                out += [(ids[k], key) for k in _covering(firsts, lasts, key)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.string())], ["id", "key"])


def find_keys(index: DataFrame, folder: str, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records whose ``url_key`` is among ``keys`` (column key; repeated and null ones count once and not at all).

    A key is searched by halves in the segments of the block directory, in its segment, then in the block, whose lines name the ranges that are
    read. The plan is the same at every size: segments are at most ``SEGMENTS`` rows, a segment's directory and a block come to the task
    that gets their keys, as rows before them. Digest and size are taken from the payload that was read. Unknown keys give no rows.
    """
    columns = columns or list(_FIELDS)
    bounded_batches(index.sparkSession)
    numbered, top = _numbered(index)
    share = index.sparkSession.sparkContext.broadcast(top)
    asked = keys.where("key is not null").select("key").distinct()
    placed = asked.mapInArrow(lambda batches: _segment_of(batches, share.value), "segment long, key string")
    none = lambda kind: F.lit(None).cast(kind)
    rows = numbered.select("segment", "id", F.col("first").alias("key"), "last").unionByName(placed.select("segment", none("long").alias("id"), "key", none("string").alias("last")))
    hits = rows.repartition("segment").sortWithinPartitions("segment", F.col("id").asc_nulls_last(), "key").mapInArrow(_blocks_of, "id long, key string")
    both = index.select("id", none("string").alias("key"), "block").unionByName(hits.select("id", "key", none("binary").alias("block")))
    ready = both.repartition("id").sortWithinPartitions("id", F.col("key").asc_nulls_first())
    return ready.mapInArrow(_fetch(folder, columns), ", ".join(f"{c} {_KINDS[_FIELDS[c]]}" for c in columns))


def lookup(index: DataFrame, folder: str, urls: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records of the URLs in ``urls`` (column url). Unknown and null URLs give no rows."""
    return find_keys(index, folder, urls.where("url is not null").select(url_key(F.col("url").cast("string")).alias("key")), columns)


def read_archives(index: DataFrame, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Every record, block by block in the index's order, without a search."""
    columns = columns or list(_FIELDS)

    def run(batches):
        from pyarrow.fs import FileSystem

        fs, base = FileSystem.from_uri(folder)
        files: dict[str, object] = {}
        for b in batches:
            for packed in b.column(0).to_pylist():
                yield from _records(fs, base, json.loads(zlib.decompress(packed)), columns, files)

    return index.select("block").mapInArrow(run, ", ".join(f"{c} {_KINDS[_FIELDS[c]]}" for c in columns))
