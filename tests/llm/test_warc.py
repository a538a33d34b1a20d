import gzip
import os
from glob import glob

from stockloom.llm import warc

TRAP = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb\r\n\r\n"
ROWS = [
    (1, "http://a.example.org/x y", "<p>one</p>"), (2, "http://b.example.org/", "<p>one</p>"), (3, None, None), (4, "ä", ""), (5, "u", TRAP),
    (None, "n", "<p>one</p>"), (None, "m", "alone"), (6, "v", "x" * 300_000), (7, "w", "äöü🙂"), (8, "w", "twice"), (8, "w", "twice"), (9, "z", TRAP),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "kept") for r in rows], "page_id long, url string, html string, digest string")


def assembled(spark, rows, folder, **more):
    warc.write_archive(table(spark, rows), folder, **more)
    return warc.captures(warc.read_records(spark, folder)).collect()


def test_round_trip(spark, tmp_path):
    got = assembled(spark, ROWS, str(tmp_path / "a"), records_per_file=6)
    assert len(got) == len(ROWS)
    last = {html or "": max((i for i, _, h in ROWS if (h or "") == (html or "") and i is not None), default=None) for _, _, html in ROWS}
    want = []
    for i, url, html in ROWS:
        body = html or ""
        revisit = last[body] is not None and i != last[body]
        want.append((
            "revisit" if revisit else "response", warc.uri(url), warc.base32_sha1(body.encode()), None if revisit else body.encode(),
        ))
    have = [(r.response.record_type, r.response.target_uri, r.response.payload_digest, None if r.response.payload is None else bytes(r.response.payload)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert all(r.request.concurrent_to == r.metadata.concurrent_to == r.response.record_id for r in got)


def test_small_payloads_are_not_revisited(spark, tmp_path):
    got = assembled(spark, ROWS[:2] + ROWS[5:6], str(tmp_path / "a"), min_revisit_bytes=11)
    assert [r.response.record_type for r in got] == ["response"] * 3


def test_files_are_warc(spark, tmp_path):
    warc.write_archive(table(spark, ROWS[:2]), str(tmp_path / "a"))
    text = b"".join(gzip.open(f).read() for f in glob(os.path.join(tmp_path, "a", "*.gz")))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC-Concurrent-To: ") == 4


def test_missing_records_leave_nulls(spark, tmp_path):
    os.mkdir(tmp_path / "a")
    with gzip.open(tmp_path / "a" / "x.warc.gz", "wb") as out:
        out.write(b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <r>\r\nWARC-Concurrent-To: <h>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n")
    with gzip.open(tmp_path / "a" / "x.warc.gz", "ab") as out:  # a second gzip member
        out.write(b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <h>\r\nContent-Length: 2\r\n\r\na:\r\n\r\n")
    got = warc.captures(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert len(got) == 1 and got[0].response is None and got[0].request.record_id == "<r>" and got[0].metadata.record_id == "<m>"


def test_empty_table(spark, tmp_path):
    assert assembled(spark, [], str(tmp_path / "a")) == []
