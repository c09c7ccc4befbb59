"""Dump files: a Spark data source ("dump") for the length-prefixed binary frame records.

A record is a 15-byte little-endian header followed by the frame.  The two-byte payload length sits on top of the two
high bytes of the timestamp, so a record keeps only the low 48 bits of ``ts_ns`` (3.258 days).  The writer therefore
puts frames of different 48-bit epochs into different files and names the epoch in the file name, from which the reader
restores full timestamps; for files from elsewhere it uses a time hint.

The writer's tasks write files under names of their own, and a commit is one small manifest that lists them; readers of
a folder with manifests see the listed files only, so an attempt that was stopped leaves nothing that is read, and nothing
is ever moved or listed.  Records have no sync marker, but a manifest also says where in a file records begin every so
many bytes, and those parts are read by different tasks.  Files from elsewhere (a folder without manifests) are read
whole, a task each, in chunks.  Work inside a task is numpy and Arrow over whole chunks; only the hop from length to
length is a Python loop.
"""

from __future__ import annotations

import json
import re
import sys
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The record format.
MAGIC = 0x4846
VERSION = 1
HEADER = np.dtype([("magic", "<u2"), ("version", "u1"), ("filter_id", "<u4"), ("ts48", "u1", (6,)), ("length", "<u2")])
HEADER_LEN = 15
MAX_PAYLOAD = 65535
TS_BITS = 48

CHUNK = 8 << 20
ROLL_BYTES = 256 << 20
PACK_BYTES = 128 << 20
SUFFIX = ".dump"
_EPOCH = re.compile(r"-e(-?\d+)\.dump$")
PART_BYTES = 64 << 20  #: a file is split at the first batch of records after so many bytes
READERS = 32  #: manifests read at a time
MANIFESTS = "manifests"

DUMP_DDL = ("filter_id bigint, ts48 bigint, ts_ns bigint, wire_len bigint, payload binary, src_file string, "
            "src_offset bigint, corrupt string")
_ARROW = pa.schema([
    ("filter_id", pa.int64()), ("ts48", pa.int64()), ("ts_ns", pa.int64()), ("wire_len", pa.int64()),
    ("payload", pa.binary()), ("src_file", pa.string()), ("src_offset", pa.int64()), ("corrupt", pa.string()),
])


def open_fs(path: str):
    """(file system, path inside it) for a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith(("s3a://", "s3n://")):
        path = "s3" + path[3:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# ---- reading --------------------------------------------------------------------------------------------------------

def record_starts(data: bytes) -> tuple[list[int], int]:
    """Start of every complete record in ``data``, and the number of bytes they cover."""
    starts, at, size = [], 0, len(data)
    while at + HEADER_LEN <= size:
        end = at + HEADER_LEN + (data[at + 13] | data[at + 14] << 8)
        if end > size:
            break
        starts.append(at)
        at = end
    return starts, at


def header_problem(header: bytes) -> str | None:
    """Why a record header is unacceptable, judged on the bytes that are there."""
    if len(header) >= 2 and header[:2] != MAGIC.to_bytes(2, "little"):
        return f"bad magic 0x{int.from_bytes(header[:2], 'little'):04x}"
    if len(header) >= 3 and header[2] != VERSION:
        return f"unsupported version {header[2]}"
    return None


def to_batch(data: bytes, starts: list[int], end: int, offset: int, path: str, hint_ns: int) -> pa.RecordBatch:
    """Decode complete, valid records of one chunk."""
    at = np.array([*starts, end], dtype=np.int32)
    content = np.frombuffer(data, dtype=np.uint8)[:end]
    spots = (at[:-1, None] + np.arange(HEADER_LEN)).reshape(-1)
    fields = content[spots].view(HEADER)
    ts48 = np.zeros(len(starts), dtype=np.int64)
    for i in range(6):
        ts48 |= fields["ts48"][:, i].astype(np.int64) << (8 * i)
    span = 1 << TS_BITS
    n = len(starts)
    is_payload = np.ones(end, dtype=bool)
    is_payload[spots] = False
    bounds = np.concatenate([[0], np.cumsum(fields["length"], dtype=np.int64)]).astype(np.int32)
    payload = pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(content[is_payload])])
    return pa.RecordBatch.from_arrays([
        pa.array(fields["filter_id"].astype(np.int64)),
        pa.array(ts48),
        pa.array(hint_ns - np.mod(hint_ns - ts48, span)),
        pa.array(fields["length"].astype(np.int64)),
        payload,
        pa.repeat(pa.scalar(path, pa.string()), n),
        pa.array(offset + at[:-1].astype(np.int64)),
        pa.nulls(n, pa.string()),
    ], schema=_ARROW)


def corrupt_batch(path: str, offset: int, lost: int, why: str) -> pa.RecordBatch:
    """One row standing for the unreadable rest of a file; ``wire_len`` holds its size in bytes."""
    row = {"wire_len": lost, "src_file": path, "src_offset": offset, "corrupt": why}
    return pa.RecordBatch.from_pylist([row], schema=_ARROW)


def file_hint(path: str, mtime_ns: int, option_ns: int | None) -> int:
    """A time not before any frame of the file and less than 2^48 ns after each of them."""
    if option_ns is not None:
        return option_ns
    named = _EPOCH.search(path)
    return ((int(named.group(1)) + 1) << TS_BITS) - 1 if named else mtime_ns


def read_file(path: str, hint_ns: int, permissive: bool, start: int = 0, end: int | None = None, chunk: int = CHUNK):
    """Arrow batches of a dump file, or of its part from ``start`` to ``end``, both where records begin; memory use does
    not depend on the size."""
    files, inner = open_fs(path)
    with files.open_input_file(inner) if start or end is not None else files.open_input_stream(inner) as stream:
        if start:
            stream.seek(start)
        carry, offset, left = b"", start, None if end is None else end - start
        while True:
            piece = stream.read(chunk if left is None else min(chunk, left))
            left = None if left is None else left - len(piece)
            data = carry + piece
            starts, used = record_starts(data)
            bad = None
            if starts:
                view = np.frombuffer(data, dtype=np.uint8)
                at = np.array(starts)
                wrong = (view[at] != MAGIC & 255) | (view[at + 1] != MAGIC >> 8) | (view[at + 2] != VERSION)
                if wrong.any():
                    bad = int(np.argmax(wrong))
                    used = starts[bad]
                    starts = starts[:bad]
            why = header_problem(data[used:used + HEADER_LEN])
            if starts:
                yield to_batch(data, starts, used, offset, path, hint_ns)
            if why is None and not piece and used < len(data):
                why = f"short record of {len(data) - used} bytes"
            if why is not None:
                if not permissive:
                    raise ValueError(f"{path} at byte {offset + used}: {why}")
                lost = len(data) - used
                while piece:
                    piece = stream.read(chunk if left is None else min(chunk, left))
                    left = None if left is None else left - len(piece)
                    lost += len(piece)
                yield corrupt_batch(path, offset + used, lost, why)
                return
            if not piece:
                return
            carry, offset = data[used:], offset + used


def parts_of(entry: dict) -> list[tuple[int, int]]:
    """The parts of a file that a manifest lists, as (start, end)."""
    bounds = [*entry["offsets"], entry["size"]]
    return list(zip(bounds[:-1], bounds[1:]))


def manifest_entries(path: str) -> list[dict] | None:
    """The files that the manifests of a folder list; None if the folder has none."""
    files, inner = open_fs(path)
    folder = f"{inner.rstrip('/')}/{MANIFESTS}"
    if not files.get_file_info(folder).type == pafs.FileType.Directory:
        return None
    names = sorted(f.path for f in files.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".json"))

    def entries(name: str) -> list[dict]:
        with files.open_input_stream(name) as stream:
            return [json.loads(line) for line in stream.read().splitlines()]

    with ThreadPoolExecutor(READERS) as pool:
        return [e for found in pool.map(entries, names) for e in found]


def prepare(path: str) -> None:
    """Make a folder one that is read by its manifests."""
    files, inner = open_fs(path)
    files.create_dir(f"{inner.rstrip('/')}/{MANIFESTS}", recursive=True)


def is_foreign(path: str) -> bool:
    """Whether a folder has dump files but no manifests."""
    files, inner = open_fs(path)
    if files.get_file_info(f"{inner.rstrip('/')}/{MANIFESTS}").type == pafs.FileType.Directory:
        return False
    return any(f.path.endswith(SUFFIX) for f in files.get_file_info(pafs.FileSelector(inner, allow_not_found=True, recursive=True)))


@dataclass
class DumpFiles(InputPartition):
    """(path, modification time, start, end) of what one task reads."""

    files: list


class DumpReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        mode = options.get("mode", "FAILFAST").upper()
        if mode not in ("FAILFAST", "PERMISSIVE"):
            raise ValueError(f"unknown mode {mode!r}")
        self.permissive = mode == "PERMISSIVE"
        hint = options.get("timehintns") or options.get("timeHintNs")
        self.hint = int(hint) if hint else None

    def _found(self):
        """(path, modification time, start, end, size) of all parts; files of a folder without manifests are whole."""
        listed = manifest_entries(self.path)
        if listed is not None:
            return [(f"{self.path.rstrip('/')}/{e['file']}", 0, start, end, end - start)
                    for e in listed for start, end in parts_of(e)]
        files, inner = open_fs(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        info = files.get_file_info(inner)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(inner, recursive=True))
        return sorted((prefix + f.path, f.mtime_ns, 0, None, f.size) for f in found
                      if f.is_file and (f.path.endswith(SUFFIX) or info.is_file) and "/_" not in f.path[len(inner):])

    def partitions(self):
        """Parts packed into tasks up to a size target; large ones are alone."""
        packs, room = [], 0
        for *part, size in self._found():
            if not packs or size > room:
                packs.append([])
                room = PACK_BYTES
            packs[-1].append(tuple(part))
            room -= size
        return [DumpFiles(p) for p in packs] or [DumpFiles([])]

    def read(self, partition):
        for path, mtime, start, end in partition.files:
            yield from read_file(path, file_hint(path, mtime, self.hint), self.permissive, start, end)


def read_listed(batches, hint: int | None, permissive: bool):
    """Body of a map over (path, mtime_ns, start, stop) rows, for streams that find files with Spark's own file source."""
    for batch in batches:
        for row in batch.to_pylist():
            yield from read_file(row["path"], file_hint(row["path"], row["mtime_ns"], hint), permissive, row["start"],
                                 row["stop"])


# ---- writing --------------------------------------------------------------------------------------------------------

def encode(filter_id: np.ndarray, ts_ns: np.ndarray, payload: pa.Array) -> np.ndarray:
    """Bytes of consecutive records."""
    n = len(payload)
    ends = np.frombuffer(payload.buffers()[1], dtype=np.int32)[payload.offset:payload.offset + n + 1].astype(np.int64)
    lengths = np.diff(ends)
    if n and lengths.max() > MAX_PAYLOAD:
        raise ValueError(f"payload of {lengths.max()} bytes does not fit a record (at most {MAX_PAYLOAD})")
    if n and (filter_id.min() < 0 or filter_id.max() >= 1 << 32):
        raise ValueError("filter_id does not fit a record (32 bits, not negative)")
    head = np.zeros(n, dtype=HEADER)
    head["magic"], head["version"], head["filter_id"], head["length"] = MAGIC, VERSION, filter_id, lengths
    for i in range(6):
        head["ts48"][:, i] = (ts_ns >> (8 * i)) & 255
    out = np.empty(n * HEADER_LEN + int(ends[-1] - ends[0]), dtype=np.uint8)
    spots = ((ends[:-1] - ends[0] + np.arange(n) * HEADER_LEN)[:, None] + np.arange(HEADER_LEN)).reshape(-1)
    is_head = np.zeros(len(out), dtype=bool)
    is_head[spots] = True
    out[spots] = head.view(np.uint8)
    if n and ends[-1] > ends[0]:
        out[~is_head] = np.frombuffer(payload.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    return out


@dataclass
class Written(WriterCommitMessage):
    """What the manifest says of every file that a task closed."""

    files: list


class DumpWriter(DataSourceArrowWriter):
    """Tasks write files of their own; the commit is a manifest of them, which appears at once or not at all.

    With a ``batchId`` option the manifest is named after the batch, and a second commit of a batch is discarded: stream
    replays are harmless however they are partitioned.  Files of attempts that were not committed are in no manifest
    (``remove_unlisted`` deletes them).  NULLs are refused: a record has no way to say them.
    """

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.roll = int(options.get("rollbytes") or options.get("rollBytes") or ROLL_BYTES)
        self.part = int(options.get("partbytes") or options.get("partBytes") or PART_BYTES)
        self.batch = options.get("batchid") or options.get("batchId")
        self.job = f"b{int(self.batch):012d}" if self.batch is not None else f"j{time.time_ns():020d}"

    def write(self, iterator):
        files, root = open_fs(self.path)
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)  # from now on only manifests count here
        attempt, open_files, closed = uuid.uuid4().hex, {}, []

        def close(epoch):
            stream, entry = open_files.pop(epoch)
            stream.close()
            closed.append(entry)

        for batch in iterator:
            for name in ("filter_id", "ts_ns", "payload"):
                if batch.column(name).null_count:
                    raise ValueError(f"{name} is NULL in {batch.column(name).null_count} rows; a dump record cannot hold that")
            ids = batch.column("filter_id").cast(pa.int64()).to_numpy()
            times = batch.column("ts_ns").cast(pa.int64()).to_numpy()
            payload = batch.column("payload").cast(pa.binary())
            epochs = times >> TS_BITS
            for epoch in np.unique(epochs).tolist():
                rows = np.flatnonzero(epochs == epoch)
                data = encode(ids[rows], times[rows], payload.take(pa.array(rows)))
                if epoch not in open_files:
                    name = f"{self.job}-{attempt}-{len(closed) + len(open_files):05d}-e{epoch}{SUFFIX}"
                    open_files[epoch] = (files.open_output_stream(f"{root}/{name}"), {"file": name, "size": 0, "offsets": [0]})
                stream, entry = open_files[epoch]
                if entry["size"] - entry["offsets"][-1] >= self.part:
                    entry["offsets"].append(entry["size"])
                stream.write(data.tobytes())
                entry["size"] += len(data)
                if entry["size"] >= self.roll:
                    close(epoch)
        for epoch in list(open_files):
            close(epoch)
        return Written(closed)

    def _discard(self, files, root, messages):
        for message in messages:
            for entry in message.files if message is not None else ():
                files.delete_file(f"{root}/{entry['file']}")

    def commit(self, messages):
        files, root = open_fs(self.path)
        folder = f"{root}/{MANIFESTS}"
        final = f"{folder}/{self.job}.json"
        if self.batch is not None and files.get_file_info(final).is_file:
            self._discard(files, root, messages)
            return
        files.create_dir(folder, recursive=True)
        draft = f"{folder}/_{self.job}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as stream:
            for message in messages:
                for entry in message.files:
                    stream.write(json.dumps(entry).encode() + b"\n")
        files.move(draft, final)

    def abort(self, messages):
        files, root = open_fs(self.path)
        self._discard(files, root, messages)


def remove_unlisted(path: str, older_than_seconds: float = 86_400) -> int:
    """Delete dump files that no manifest of the folder lists and that are older than any running write; gives how many."""
    entries = manifest_entries(path)
    if entries is None:
        raise ValueError(f"{path} has no manifests")
    listed = {e["file"] for e in entries}
    files, root = open_fs(path)
    gone = 0
    for found in files.get_file_info(pafs.FileSelector(root)):
        old = found.mtime_ns is not None and time.time_ns() - found.mtime_ns > older_than_seconds * 1e9
        if found.is_file and found.base_name.endswith(SUFFIX) and found.base_name not in listed and old:
            files.delete_file(found.path)
            gone += 1
    return gone


class DumpDataSource(DataSource):
    """``spark.read.format("dump")`` / ``df.write.format("dump").mode("append")``."""

    @classmethod
    def name(cls):
        return "dump"

    def schema(self):
        return DUMP_DDL

    def reader(self, schema):
        return DumpReader(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("dump files are only ever added; use append mode")
        return DumpWriter(self.options)
