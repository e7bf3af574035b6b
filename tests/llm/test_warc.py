import base64
import gzip
import hashlib
import random

import pytest

from textquarry.llm import warc as W
from textquarry.llm.common import scratch_path

PAGES = "page_id long, url string, html string"


def brute(rows):
    body = {}
    for p, _, h in rows:
        body.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        last = max(body[raw])
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((p, len(raw), digest, "response" if p == last else "revisit", None if p == last else last))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(7)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("<p>abcé \n") for _ in range(rng.randrange(0, 3000)))) for i in range(80)]
    noise = "".join(chr(rng.randrange(32, 0x24F)) for _ in range(40000))
    rows += [(100 + i, "u u", rows[3][2]) for i in range(30)] + [(200, None, None), (201, "x", ""), (202, "y", noise), (203, "z", "\x1f\u008b\x08" * 50), (204, "z", "\r\n\r\nWARC/1.1\r\n")]
    return rows


def test_query(spark, table):
    rows = _rows()
    out = W.op10_warc(spark, table("pages", rows, PAGES)).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute(rows)
    assert W.op10_warc(spark, table("pages", [], PAGES)).count() == 0


def test_any_range_size_reads_each_record_once(spark):
    rows = _rows()
    archives = W.write(spark.createDataFrame(rows, PAGES).coalesce(2), scratch_path(spark, "warc"), archive_bytes=30_000)
    assert archives.count() > 2
    for size in (97, 1000, 10**7):
        got = W.read(archives, size).collect()
        assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    text = {r[0]: r[2] or "" for r in rows}
    assert all(r.payload == text[r.page_id] for r in got if r.record_type == "response")


def test_archives_are_plain_gzip(spark):
    archives = W.write(spark.createDataFrame(_rows()[:5], PAGES).coalesce(1), scratch_path(spark, "warc"))
    with gzip.open(archives.first().path.removeprefix("file:")) as f:
        assert f.read().count(b"WARC/1.1\r\n") == 5


def test_least_bytes_and_false_magic(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "longer same"), (4, "u", "longer same")]
    got = W.read(W.write(spark.createDataFrame(rows, PAGES), scratch_path(spark, "warc"), least_bytes=5)).collect()
    assert {r.page_id: r.refers_to for r in got} == {1: None, 2: None, 3: 4, 4: None}
    # Magic in stored (uncompressed) bytes of a member is no record.
    inner = W.record(9, "u", b"inside", None)
    outer = gzip.compress(b"WARC/1.1\r\nX: y\r\n\r\n" + inner + inner, compresslevel=0)
    data = outer + inner
    more = lambda at, n: data[at : at + n]
    assert [at for at, _ in W.members(data, 0, len(data), more, len(data))] == [0, len(outer)]


def test_large_and_null_ids(spark, table):
    big = 2**60
    rows = [(big + 1, "u", "same"), (big + 3, "v", "same"), (None, "w", "same"), (None, "x", "alone"), (None, "y", "alone"), (-5, "z", "other")]
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in W.op10_warc(spark, table("pages", [(*r, 1) for r in rows], PAGES + ", digest int")).collect()), key=str)
    want = [(big + 1, "revisit", big + 3), (big + 3, "response", None), (None, "revisit", big + 3), (None, "response", None), (None, "response", None), (-5, "response", None)]
    assert got == sorted(want, key=str)


def test_repeated_rows(spark, table):
    """Rows that repeat an id are records of their own; all of the largest id are responses."""
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "v", "same"), (2, "v", "same"), (3, "w", "alone"), (3, "w", "alone")]
    assert sorted([tuple(r) for r in W.op10_warc(spark, table("pages", rows, PAGES)).collect()], key=str) == brute(rows)


def test_files_of_failed_tasks_go(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    (tmp_path / "w").mkdir()
    for name in ("pages-dead.warc.gz.open", "pages-twice.warc.gz", "other.txt"):
        (tmp_path / "w" / name).write_bytes(b"x")
    archives = W.write(spark.createDataFrame(_rows()[:9], PAGES).coalesce(2), root).collect()
    assert {p.name for p in (tmp_path / "w").iterdir()} == {r.path.rpartition("/")[2] for r in archives} | {"other.txt"}


def test_shuffled_digests_give_the_same(spark, table, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    out = W.op10_warc(spark, table("pages", _rows(), PAGES)).collect()
    assert sorted([tuple(r) for r in out], key=str) == brute(_rows())


def test_damage_is_an_error_for_some_range():
    rng = random.Random(3)
    parts = [W.record(i, "u", rng.randbytes(300).hex().encode(), None) for i in range(12)]
    data = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]

    def all_ranges(data: bytes, size: int) -> list[int]:
        more = lambda at, n: data[at : at + n]
        return [at for lo in range(0, len(data), size) for at, _ in W.members(data[lo : lo + size + 2], lo, min(lo + size, len(data)), more, len(data))]

    for size in (50, 333, 1000, 10**6):
        assert all_ranges(data, size) == starts
        for i in range(12):
            # The magic, the first block's head, the middle, the checksum at the end of a record.
            for at in (starts[i], starts[i] + 10, starts[i] + len(parts[i]) // 2, starts[i] + len(parts[i]) - 6):
                with pytest.raises(W.WarcError):
                    all_ranges(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :], size)
        for cut in (1, 9, len(parts[-1]) // 2, len(parts[-1]) - 3):
            with pytest.raises(W.WarcError):
                all_ranges(data[:-cut], size)
