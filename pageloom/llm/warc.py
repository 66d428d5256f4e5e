"""WARC archives and their capture index, merged from sorted runs by a loser tree.

``write_archives`` lays pages out as WARC/1.1 records (response or revisit) in gzip members, `archive_mb` to an archive, and
stores the archives in the shared folder as rows (archive, warc binary): each value is a whole .warc.gz file.
``read_archives`` parses the stored archives again, by Content-Length, and gives a record per row.
``merge_index`` is an external merge: what a task reads is cut into sorted runs, runs beyond a bound go to the task's own
temporary files, and a loser tree merges them by (URL key, timestamp, id) within ranges of that key, so that the partitions
together are one globally ordered capture history.

Defined results. Null html is an empty payload, a null URL an empty target. Payloads below `least` bytes are always responses.
Of equal payloads of `least` bytes or more the smallest id is the response; rows that repeat this id are responses, too. A page
of null id is written and indexed under an empty record id, read back as null, and never is what another refers to. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import pickle
import re
import struct
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

PIECE = 16_384
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
RECORD = "record_id long, urlkey string, ts string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def url_key(url: str) -> str:
    """SURT-like: host labels reversed, scheme, www, default ports and fragment dropped, lower case."""
    try:
        u = urlsplit(url.strip().lower())
        host, port = u.hostname or "", u.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    tail = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(labels)) + tail + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def record(rid: int | None, url: str, date: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit bears no payload; its length is kept in a header of ours."""
    revisit = refers_to is not None
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, length, headers, http headers, payload) of each gzip member of an archive. A member is fed piece by piece, so that no more than a piece of what follows it is looked at."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:
            piece = view[end : end + PIECE]
            if not piece:
                raise ValueError(f"the WARC member at {at} is cut short")
            parts.append(z.decompress(piece))
            end += len(piece)
        length, raw = end - at - len(z.unused_data), b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield at, length, headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        at += length


def with_roles(pages: DataFrame, *, rid: str = "page_id", url: str = "url", body: str = "html", least: int = 100, salts: int = 16) -> DataFrame:
    """rid, url, payload, digest, refers_to. The first of each group of equal payloads is found by an aggregation; its rows get it by a join whose hot keys are salted."""
    payload = F.coalesce(F.col(body), F.lit("")).cast("string").cast("binary")
    rows = pages.select(F.col(rid).cast("long").alias("rid"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    first = rows.where(long).groupBy("digest").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    # Short payloads have no first; many are equal (empty), and a salt below 0 deals them out.
    salted = rows.withColumn("salt", F.when(long, F.pmod(F.xxhash64("rid"), F.lit(salts))).otherwise(-1 - F.pmod(F.xxhash64("rid"), F.lit(1 << 20))).cast("int"))
    out = salted.join(first, ["digest", "salt"], "left")
    return out.select("rid", "url", "payload", "digest", F.when(F.col("rid").isNull() | (F.col("first") < F.col("rid")), F.col("first")).alias("refers_to"))


def write_archives(roles: DataFrame, *, archive_mb: int = 4) -> DataFrame:
    """The stored archives: archive string, warc binary."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k, members, size = TaskContext.get().partitionId(), 0, [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{k:05d}.warc.gz"]), pa.array([b"".join(members)], pa.binary())], names=["archive", "warc"])
        for batch in batches:
            for rid, url, payload, digest, ref in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                date = (EPOCH + timedelta(seconds=(rid or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                members.append(gzip.compress(record(rid, url, date, digest, payload, ref), 1, mtime=0))
                size += len(members[-1])
                if size >= archive_mb << 20:
                    yield made()
                    k, members, size = k + 1, [], 0
        if members:
            yield made()

    return written(roles.select("rid", "url", "payload", "digest", "refers_to").mapInArrow(pack, "archive string, warc binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the stored archives. `intact`: what is stored has the length and digest that its headers state."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, name = [], batch.column(0)[i].as_py()
                for at, length, h, http, payload in parse(batch.column(1)[i].as_py()):
                    num = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v)) else None
                    n, digest = int(http["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
                    whole = h["WARC-Type"] == "revisit" or (len(payload) == n and hashlib.sha256(payload).hexdigest() == digest)
                    rows.append((num(h["WARC-Record-ID"]), url_key(h["WARC-Target-URI"]), re.sub(r"\D", "", h["WARC-Date"]), name, at, length, n, digest, h["WARC-Type"], num(h.get("WARC-Refers-To", "")), whole))
                yield _batch(rows)

    # An archive is some MB: few in an Arrow batch.
    return archives.select("archive", "warc").mapInArrow(index, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RECORD.split(", ")])


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merges sorted runs. Inner nodes hold the losers; a step replays one path of log2(k) comparisons."""
    k = len(runs)
    if k == 0:
        return
    heads = [next(r, None) for r in runs]
    keys = [None if h is None else key(h) for h in heads]
    beats = lambda a, b: keys[b] is None or keys[a] is not None and (keys[a], a) <= (keys[b], b)
    tree = [0] * k  # tree[0] is the winner, tree[1:] the losers; leaf i stands at k + i
    win = [0] * (2 * k)
    win[k:] = range(k)
    for node in range(k - 1, 0, -1):
        a, b = win[2 * node], win[2 * node + 1]
        win[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    top = win[1] if k > 1 else 0
    while keys[top] is not None:
        yield heads[top]
        heads[top] = next(runs[top], None)
        keys[top] = None if heads[top] is None else key(heads[top])
        node, cur = (k + top) // 2, top
        while node:
            if not beats(cur, tree[node]):
                cur, tree[node] = tree[node], cur
            node //= 2
        top = cur


def _spill(rows: Iterable[tuple], chunk: int = 2000) -> Iterator[tuple]:
    """Writes a run to an unnamed temporary file of this task and gives its rows again."""
    f, it = tempfile.TemporaryFile(), iter(rows)  # noqa: SIM115
    while part := list(islice(it, chunk)):
        raw = pickle.dumps(part, protocol=5)
        f.write(struct.pack("<I", len(raw)) + raw)
    f.seek(0)

    def read() -> Iterator[tuple]:
        with f:
            while head := f.read(4):
                yield from pickle.loads(f.read(struct.unpack("<I", head)[0]))

    return read()


def index_key(r: tuple) -> tuple:
    return (r[1], r[2], r[0] is not None, r[0] or 0, r[3], r[4])


def merge_index(index: DataFrame, *, ranges: int | None = None, run_rows: int = 50_000, held_runs: int = 8, fan_in: int = 64) -> DataFrame:
    """The index in global order. `ranges` partitions (by default the session's shuffle partitions) take ranges of (urlkey, ts, record_id), so a hot URL is cut by time and id."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[Iterator[tuple]] = []
        rows: list[tuple] = []

        def close() -> None:
            rows.sort(key=index_key)
            runs.append(_spill(rows) if len(runs) >= held_runs else iter(list(rows)))
            rows.clear()
            if len(runs) >= fan_in:  # so that open files stay few
                runs[:] = [_spill(loser_tree(list(runs), index_key))]

        for batch in batches:
            rows.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(rows) >= run_rows:
                close()
        if rows:
            close()
        out: list[tuple] = []
        for r in loser_tree(runs, index_key):
            out.append(r)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    n = ranges or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.repartitionByRange(n, "urlkey", "ts", "record_id").mapInArrow(merge, RECORD)
