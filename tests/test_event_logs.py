import struct

import pytest
from pyspark.errors import PySparkException

from lavra.sources import event_logs as logs


def test_checksums():
    # Check values of the public definitions of CRC-32C.
    assert logs.crc32c(b"123456789") == 0xE3069283
    assert logs.crc32c(bytes(32)) == 0x8A9136AA and logs.crc32c(b"") == 0


def test_message_round_trip():
    for step in (0, 1, 127, 128, 10**12, -1, -(2**63)):
        got = list(logs.scalars(logs.event(1.25, step=step, tag="loss/é", value=0.5)))
        assert got == [(1.25, step, "loss/é", 0.5)]
    assert list(logs.scalars(logs.event(3.0))) == []
    # Several scalars in one event; a value without a scalar, and fields that are not known.
    two = logs._field(1, logs._field(1, b"a") + b"\x15" + struct.pack("<f", 2.0)) + logs._field(1, logs._field(1, b"image") + logs._field(4, b"..."))
    two += logs._field(1, logs._field(7, b"node") + b"\x15" + struct.pack("<f", 4.0))
    assert list(logs.scalars(b"\x10\x05" + logs._field(5, two) + b"\x58\x01")) == [(0.0, 5, "a", 2.0), (0.0, 5, "", 4.0)]


def _file(path, *events, tail=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"".join(logs.record(e) for e in events) + tail)


def _read(spark, path, **options):
    return sorted((r.parent, r.run_id, r.tag, r.step, r.value) for r in logs.scan_event_logs(spark, str(path), **options).collect())


def test_folders_and_damaged_tails(spark, tmp_path):
    one = [logs.event(1.0), *(logs.event(float(i), step=i, tag="t", value=i) for i in range(3))]
    whole = logs.record(logs.event(9.0, step=9, tag="t", value=9.0))
    _file(tmp_path / "runs/a/events.out.tfevents.1", *one)
    _file(tmp_path / "runs/b/events.out.tfevents.1", *one[:2], tail=whole[:-1])
    _file(tmp_path / "runs/c/events.out.tfevents.1", *one[:2], tail=whole[:5])
    _file(tmp_path / "runs/d/events.out.tfevents.1", one[0], one[1], tail=whole[:20] + b"?" + whole[21:] + logs.record(one[3]))
    _file(tmp_path / "runs/e/events.out.tfevents.1")
    _file(tmp_path / "runs/e/notes.txt", *one)
    want = [("runs", run, "t", i, float(i)) for run, n in (("a", 3), ("b", 1), ("c", 1), ("d", 1)) for i in range(n)]
    assert _read(spark, tmp_path) == want
    assert _read(spark, f"file://{tmp_path}/runs/a") == want[:3]
    assert _read(spark, tmp_path / "runs/b/events.out.tfevents.1") == want[3:4]
    assert _read(spark, tmp_path / "runs/a", strict=True) == want[:3]
    with pytest.raises(PySparkException, match="Damaged"):
        _read(spark, tmp_path / "runs/d", strict=True)
    (tmp_path / "none").mkdir()
    assert _read(spark, tmp_path / "none") == []


def test_long_record_and_block_edges(monkeypatch):
    import io

    monkeypatch.setattr(logs, "READ_BYTES", 7)
    events = [logs.event(1.0, step=i, tag="x" * (i * 40), value=i) for i in range(12)]
    stream = io.BytesIO(b"".join(map(logs.record, events)))
    assert list(logs.records(stream)) == events


def test_written_logs_come_back(spark, tmp_path):
    rows = [("p", "r1", 5, "t", 2, 0.1), ("p", "r1", 6, "u", -1, 0.25), ("q", "r1", 7, "t", 0, 1e30), ("q", "r2", 8, None, 1, 1.0), ("q", "r2", 8, "t", None, 1.0), ("q", "r2", 8, "t", 1, None)]
    frame = spark.createDataFrame(rows, "parent string, run_id string, run_ts long, tag string, step long, value double")
    frame = frame.selectExpr("parent", "run_id", "timestamp_seconds(run_ts) AS run_ts", "tag", "step", "value")
    for times in (1, 2):  # a second write adds files
        logs.write_event_logs(frame, str(tmp_path / "logs"))
        want = [(p, r, t, s, struct.unpack("<f", struct.pack("<f", v))[0]) for p, r, _, t, s, v in rows[:3]] * times
        assert _read(spark, tmp_path / "logs", strict=True) == sorted(want)
    logs.write_event_logs(frame.limit(0), str(tmp_path / "logs"))
