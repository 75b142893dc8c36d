import random

from braidwell.llm import warc

PAGES = [
    (1, "https://a.example/x?y=1&z=%20", "<html>é</html>"),
    (2, None, None),
    (None, "", ""),
    (4, "bad\r\nurl + tab\t", "WARC/1.0\r\n\r\n" * 50),
    (5, "http://b.example", None),
    (5, "http://b.example", "twice"),
    (5, "http://b.example", "twice"),
    (6, "http://c.example", "long " * 400_000),
]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_round_trip_of_awkward_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, path string").repartition(2)
    files = warc.write_pages(pages, str(tmp_path)).cache()
    files.count()
    for size in (700, 64 << 10, 1 << 30):
        got = [tuple(r) for r in warc.pages_of(warc.read_files(files, size)).collect()]
        assert sorted(got, key=key) == sorted(PAGES, key=key)
    listed = warc.pages_of(warc.read_warc(spark, str(tmp_path), 5000))
    assert listed.count() == len(PAGES)


def test_every_split_gives_each_record_once(tmp_path):
    r = random.Random(2)
    bodies = [bytes(r.randrange(256) for _ in range(r.randrange(0, 900))) + b"\x1f\x8b\x08\x00junk" for _ in range(60)]
    path = str(tmp_path / "a.warc.gz")
    starts = []
    with open(path, "wb") as f:
        for i, b in enumerate(bodies):
            starts.append(f.tell())
            head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode()
            f.write(warc.member(head + b + b"\r\n\r\n", r.choice([0, 1, 9])))
        end = f.tell()
    for size in (1, 2, 3, 97, 1000, end):
        got = [(a, h["WARC-Record-ID"], p) for s in range(0, end, size) for a, _, h, p in warc.scan(path, s, min(end, s + size))]
        assert got == [(starts[i], f"<{i}>", b) for i, b in enumerate(bodies)]


def test_damaged_members_are_passed_over(tmp_path):
    path = str(tmp_path / "b.warc.gz")
    good = [warc.member(warc.record(i, f"http://x/{i}", "body" * 100)) for i in range(3)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0xFF
    data = b"\x1f\x8b\x08\xff" + good[0] + bytes(broken) + good[2] + good[0][:40]
    open(path, "wb").write(data)
    assert [h["Page-ID"] for _, _, h, _ in warc.scan(path, 0, len(data))] == ["0", "2"]


def test_empty_table(spark):
    from braidwell.llm.common import Scratch

    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_pages(none, Scratch(spark).path("w"))
    assert files.count() == 0 and warc.read_files(files).count() == 0
