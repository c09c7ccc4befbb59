import os
import struct
import time

import pytest
from packet_bytes import frame
from pyspark.sql import functions as F

from framelake.functions.clock import recover_ns
from framelake.sources import dump, records

DDL = "filter_id long, ts_ns long, payload binary"
T0 = 1_704_067_200_000_000_000


def record(filter_id, ts_ns, payload, magic=0x4846, version=1):
    head = bytearray(struct.pack("<HBIQ", magic, version, filter_id, ts_ns))
    head[13:15] = struct.pack("<H", len(payload))
    return bytes(head) + payload


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "wb") as file:
        file.write(data)


def test_header_overlap(spark):
    """The length overwrites the top of the timestamp; the low 48 bits and a hint restore it."""
    data = record(7, T0, b"x" * 1000)
    assert int.from_bytes(data[7:15], "little") == 281492667704344576
    row = spark.range(1).select(recover_ns(F.lit(17690993688576), F.lit(T0 + 10**14)).alias("t")).first()
    assert row.t == T0


def test_round_trip_over_many_days(spark, work):
    path = work()
    rows = [(i % 5, T0 + i * 777_777_777_777, bytearray(frame(size=42 + i % 50))) for i in range(2000)] + [(1, T0, bytearray())]
    df = spark.createDataFrame(rows, DDL).repartition(3)
    dump.write_dump(df, path, roll_bytes=20_000)
    back = dump.read_dump(spark, path)
    assert sorted((r.filter_id, r.ts_ns, bytes(r.payload)) for r in back.collect()) == sorted((a, b, bytes(c)) for a, b, c in rows)
    r = back.filter("filter_id = 1 AND wire_len = 0").first()
    assert (r.ts48, r.corrupt) == (T0 % 2**48, None)
    assert len([f for f in os.listdir(path) if f.endswith(".dump")]) > 3


def test_foreign_files_use_a_time_hint(spark, work):
    path = work()
    put(path, "capture.dump", record(1, T0, b"abc"))
    assert dump.read_dump(spark, path, time_hint_ns=T0 + 2**47).first().ts_ns == T0
    now = time.time_ns() - 10**9
    put(path + "2", "capture.dump", record(1, now, b"abc"))
    assert dump.read_dump(spark, path + "2").first().ts_ns == now


@pytest.mark.parametrize("tail,why,offset", [
    (record(1, 2, b"zz", magic=0x1234), "bad magic 0x1234", 36), (record(1, 2, b"zz", version=9), "unsupported version 9", 36),
    (record(1, 2, b"zz")[:9], "short record of 9 bytes", 36), (record(1, 2, b"zzz")[:17], "short record of 17 bytes", 36),
    (b"\x99", "short record of 1 bytes", 36),
])
def test_damaged_files(spark, work, tail, why, offset):
    path = work()
    put(path, "a.dump", record(1, 5, b"abc") + record(2, 6, b"def") + tail)
    put(path, "b.dump", record(3, 7, b"ghi"))
    rows = dump.read_dump(spark, path, mode="PERMISSIVE", time_hint_ns=100).collect()
    assert sorted(r.filter_id for r in rows if r.corrupt is None) == [1, 2, 3]
    bad, = [r for r in rows if r.corrupt is not None]
    assert (bad.corrupt, bad.src_offset, bad.wire_len) == (why, offset, len(tail))
    with pytest.raises(Exception, match=why.split(" 0x")[0]):
        dump.read_dump(spark, path).collect()


def test_chunks_smaller_than_records(tmp_path):
    put(tmp_path, "a.dump", b"".join(record(i, i, b"p" * (i % 40)) for i in range(100)))
    for chunk in (1, 7, 64, 1 << 20):
        batches = list(records.read_file(f"{tmp_path}/a.dump", 100, False, chunk=chunk))
        ids = [i for b in batches for i in b.column("filter_id").to_pylist()]
        offsets = [i for b in batches for i in b.column("src_offset").to_pylist()]
        assert ids == list(range(100))
        assert offsets == [sum(15 + j % 40 for j in range(i)) for i in range(100)]


def test_oversized_payload_is_refused(spark, work):
    df = spark.createDataFrame([(1, 1, bytearray(65536))], DDL)
    with pytest.raises(Exception, match="does not fit"):
        dump.write_dump(df, work())
    path = work()
    dump.write_dump(spark.createDataFrame([(1, 1, bytearray(65535))], DDL), path)
    assert dump.read_dump(spark, path).first().wire_len == 65535


def test_replayed_batch_is_written_once(spark, work):
    path = work()
    df = spark.createDataFrame([(1, 1, bytearray(b"a"))], DDL)
    for batch in (0, 0, 1):
        dump.write_dump(df, path, batch_id=batch)
    assert dump.read_dump(spark, path).count() == 2


def test_reading_nothing_and_bad_options(spark, work):
    path = work()
    os.makedirs(path)
    assert dump.read_dump(spark, path).count() == 0
    with pytest.raises(Exception, match="unknown mode"):
        dump.read_dump(spark, path, mode="LENIENT").count()


def test_stream_picks_up_files_whatever_their_names(spark, work):
    path, out, checkpoint = work(), work(), work()

    def drain():
        query = (dump.stream_dump(spark, path, mode="PERMISSIVE").writeStream.format("parquet")
                 .option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())
        query.awaitTermination()
        return sorted(r.filter_id for r in spark.read.parquet(out).filter("corrupt IS NULL").collect())

    put(path, "m.dump", record(1, 5, b"abc"))
    assert drain() == [1]
    put(path, "a.dump", record(2, 5, b"abc") + b"\x00\x00\x00")
    assert drain() == [1, 2]
    assert spark.read.parquet(out).filter("corrupt LIKE 'bad magic%'").count() == 1


def _rows(spark, rows):
    return spark.createDataFrame(rows, "filter_id long, ts_ns long, payload binary")


def test_nulls_are_refused_and_times_stay_exact(spark, work):
    path, exact = work(), 1704067200123456789
    with pytest.raises(Exception, match="is NULL in 1 rows"):
        dump.write_dump(_rows(spark, [(1, exact, b"a"), (1, None, b"b")]).coalesce(1), path)
    dump.write_dump(_rows(spark, [(1, exact, b"a"), (2, -5, b""), (3, -(1 << 48) - 7, b"c")]), path)
    got = {r.filter_id: (r.ts_ns, bytes(r.payload)) for r in dump.read_dump(spark, path).collect()}
    assert got == {1: (exact, b"a"), 2: (-5, b""), 3: (-(1 << 48) - 7, b"c")}


def test_replay_after_half_a_commit(spark, work):
    path = work()
    rows = _rows(spark, [(1, i, b"x") for i in range(10)])
    dump.write_dump(rows.repartition(4), path, batch_id=3)
    os.remove(f"{path}/manifests/b000000000003.json")  # as if it had stopped before the commit
    assert dump.read_dump(spark, path).count() == 0
    for parts in (2, 3):
        dump.write_dump(rows.repartition(parts), path, batch_id=3)
        assert dump.read_dump(spark, path).count() == 10
    files = [f for f in os.listdir(path) if f.endswith(".dump")]
    assert len(files) == 4 + 2 and records.remove_unlisted(path, older_than_seconds=0) == 4
    assert dump.read_dump(spark, path).count() == 10


def test_a_large_file_is_read_in_parts(spark, work):
    path = work()
    rows = spark.range(40_000).selectExpr("id % 3 as filter_id", "id as ts_ns", "cast(repeat('p', cast(id % 90 as int)) as binary) as payload")
    dump.write_dump(rows.coalesce(1), path, part_bytes=100_000)
    file, = [f for f in os.listdir(path) if f.endswith(".dump")]
    entry, = records.manifest_entries(path)
    parts = records.parts_of(entry)
    assert len(parts) >= 4 and parts[0][0] == 0 and parts[-1][1] == os.path.getsize(f"{path}/{file}")
    back = dump.read_dump(spark, path)
    want = sorted(map(tuple, rows.select("filter_id", "ts_ns").collect()))
    assert sorted(map(tuple, back.select("filter_id", "ts_ns").collect())) == want
    out = work()
    query = (dump.stream_dump(spark, path).select("filter_id", "ts_ns").writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", work()).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want
    with open(f"{path}/{file}", "r+b") as stream:  # one damaged part does not take the others with it
        stream.seek(parts[1][0])
        stream.write(b"\0\0")
    rest = dump.read_dump(spark, path, mode="PERMISSIVE")
    bad = rest.filter("corrupt IS NOT NULL").first()
    assert (bad.src_offset, bad.wire_len) == (parts[1][0], parts[1][1] - parts[1][0])
    assert rest.filter("corrupt IS NULL AND src_offset >= %d" % parts[2][0]).count() > 0


def test_files_from_elsewhere_beside_manifests_are_not_read(spark, work):
    path = work()
    dump.write_dump(_rows(spark, [(1, 5, b"x")]), path)
    put(path, "other.dump", record(9, 5, b"abc"))
    assert [r.filter_id for r in dump.read_dump(spark, path).collect()] == [1]
