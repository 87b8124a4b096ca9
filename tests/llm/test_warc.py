import gzip
import random

import pytest

from lumenfold.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def read_back(spark, df, path):
    warc.write(warc.revisits(df), path)
    return warc.scan(spark, path).collect()


def test_round_trip_and_revisits(spark, tmp_path):
    long, other = "<p>é" + "x" * 1200, "y" * 999
    rows = [(1, "http://a/", long), (5, "http://b/\r\nX: y", long), (3, None, long), (2, "u", None), (4, "u", ""), (6, "u", other), (7, "u", other), (None, "u", long), (8, "u", "z" * 20_000_000), (5, "http://b/", long)]
    got = read_back(spark, pages(spark, rows), str(tmp_path / "w"))
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(warc.page_of(r.id), []).append((r.type, warc.page_of(r.refers_to), r.payload_bytes, None if r.payload is None else bytes(r.payload)))
    n = len(long.encode())
    assert by[5] == [("response", None, n, long.encode())] * 2
    assert by[1] == by[3] == by[None] == [("revisit", 5, n, None)]
    assert by[2] == by[4] == [("response", None, 0, b"")]
    assert by[6] == by[7] == [("response", None, 999, other.encode())]
    assert by[8][0][2] == 20_000_000
    assert len({r.payload_digest for r in got if warc.page_of(r.id) in (1, 3, 5, None)}) == 1


def test_files_are_plain_gzip_members(spark, tmp_path):
    path = tmp_path / "w"
    warc.write(warc.revisits(pages(spark, [(k, "u", f"page {k}" * 300) for k in range(9)])), str(path), file_records=4)
    files = sorted(path.glob("part-*"))
    assert len(files) >= 3
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 9


def test_a_long_page_makes_no_small_files_of_others(spark, tmp_path):
    path = tmp_path / "w"
    rows = [(k, "u", f"page {k}") for k in range(100)] + [(k, "u", str(k) * 700_000) for k in range(1000, 1003)]
    warc.write(pages(spark, rows).selectExpr("*", "cast(null as bigint) as refers_to").coalesce(1), str(path), file_bytes=4 << 20)
    assert len(list(path.glob("part-*"))) == 4  # one of all short pages, one for each long one
    assert sorted(warc.page_of(r.id) for r in warc.scan(spark, str(path)).collect()) == sorted(k for k, _, _ in rows)


def test_extra_columns_of_clashing_names(spark, tmp_path):
    rows = [(1, "u", "x" * 1200, "a", 7), (2, "u", "x" * 1200, "b", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string, value long")
    assert {(warc.page_of(r.id), r.type) for r in read_back(spark, df, str(tmp_path / "w"))} == {(1, "revisit"), (2, "response")}


def test_empty_table(spark, tmp_path):
    assert read_back(spark, pages(spark, [(1, "u", "x")]).limit(0), str(tmp_path / "w")) == []


def record_bytes():
    return [warc.member(warc.page_record(k, "http://x/", b"payload %d" % k * 50, None, "2024-01-01T00:00:00Z")) for k in range(4)]


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_reader_takes_any_pieces(size):
    data = b"".join(record_bytes())
    got = list(warc.read(data[i : i + size] for i in range(0, len(data), size)))
    assert [r.http()[1] for r in got] == [b"payload %d" % k * 50 for k in range(4)]


def test_reader_refuses_broken_archives():
    data = b"".join(record_bytes())
    rng = random.Random(1)
    for cut in rng.sample(range(1, len(data)), 40):
        if cut not in {len(b"".join(record_bytes()[:k])) for k in range(5)}:
            with pytest.raises(warc.WarcError):
                list(warc.read([data[:cut]]))
    raw = warc.page_record(1, "u", b"abc" * 100, None, "d")
    for bad in (raw.replace(b"abcabc", b"abcabd", 1), raw.replace(b"Content-Length: ", b"Content-Length: 1", 1), raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw[:-2], b"no headers"):
        with pytest.raises(warc.WarcError):
            list(warc.read([warc.member(bad)]))
    assert list(warc.read([])) == [] and list(warc.read([warc._EMPTY_MEMBER])) == []
