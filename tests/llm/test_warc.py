"""ARC to WARC: round trips, both versions, revisits."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from firespark.llm import warc


def test_round_trip_and_revisits(spark):
    same = "<html>same é\r\n\r\nWARC/1.1\r\n</html>"
    rows = [(1, "http://a/x y", same), (5, "http://a/é", same), (3, None, same), (7, "http://b", "<p>other</p>"), (8, "u", None), (9, "", ""),
            (None, "u", "<p>other</p>"), (10, "big", "z" * 300_000), (7, "http://b", "<p>other</p>"), (11, "ARC\nline", "filedesc://x 1 2\n\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("digest", F.lit("clash"))
    got = warc.convert_pages(pages).collect()
    assert len(got) == len(rows)
    payload = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        assert (r.payload_bytes, r.payload_digest) == (len(payload[r.page_id]), warc.payload_digest(payload[r.page_id]))
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
    assert kinds == sorted([("1", "revisit", 5), ("3", "revisit", 5), ("5", "response", None), ("7", "response", None), ("7", "revisit", 7),
                            ("None", "revisit", 7), ("8", "revisit", 9), ("9", "response", None), ("10", "response", None), ("11", "response", None)])
    assert len({r.record_id for r in got}) == len(rows)


def test_small_payloads_stay_responses(spark):
    pages = spark.createDataFrame([(i, "u", "abc") for i in range(4)], "page_id long, url string, html string")
    assert {r.record_type for r in warc.convert_pages(pages, least_bytes=4).collect()} == {"response"}


def test_empty_table(spark):
    assert warc.convert_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_versions_by_declared_lengths(version, packed):
    blocks = [b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nhttp://fake 1 2 3 4\n", b"no head \x80\xff", b""]
    parts = [warc.arc_head(version, "old.arc", "19960923142103") + b"\n"]
    for i, b in enumerate(blocks):
        parts.append(warc.arc_line(version, f"http://h/{i}" + " a" * (i == 1), "19960923142103", "text/html", len(b), "old.arc", "D") + b + b"\n")
    data = b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts)
    records = list(warc.arc_records(data))
    assert [r[3] for r in records] == blocks and [r[1] for r in records] == [0, 1, 2]
    assert records[1][2]["URL"] == "http://h/1%20a" and records[0][2]["Archive-date"] == "19960923142103"
    made = b"\r\n\r\n".join(warc.warc_record(n, i, f, b, None) for n, i, f, b in records) + b"\r\n\r\n"
    read = list(warc.warc_records(made))
    assert [b for _, b in read] == blocks
    assert [warc.header_value(h, "WARC-Type") for h, _ in read] == ["response", "resource", "resource"]
    assert warc.header_value(read[0][0], "WARC-Date") == "1996-09-23T14:21:03Z"


def test_truncated_and_foreign_files_are_refused():
    whole = warc.arc_head(1, "a", "2024") + b"\n" + warc.arc_line(1, "u", "2024", "t", 10, "a", "-") + b"short"
    with pytest.raises(ValueError, match="declared"):
        list(warc.arc_records(whole))
    with pytest.raises(ValueError, match="filedesc"):
        list(warc.arc_records(b"WARC/1.0\r\n"))
    assert list(warc.arc_records(b"")) == [] and warc.iso("1996") == "1996-01-01T00:00:00Z"
