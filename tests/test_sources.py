import json
import os

import pytest
from pyspark.sql import functions as F

from braidwell.sources import connectors as C
from braidwell.sources import corpus as S
from braidwell.streaming import appends
from braidwell.streaming import events as W


def rows_for_test(part, parts):
    yield (part, f"row {part} of {parts}")


def test_scan_read_and_watermark(spark, tmp_path):
    for name, data in {"a/x.md": b"# One\n", "a/.hidden/y.md": b"no", "node_modules/z.md": b"no", "b.markdown": "Ünï".encode(), "c.txt": b"no", "bad.md": b"\xff\xfe", "nul.md": b"a\0b", "big.md": b"x" * (S.MOST_BYTES + 1)}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    files = S.scan(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["a/x.md", "b.markdown", "bad.md", "big.md", "nul.md"]
    docs, failures = S.read(files)
    assert {r.path: (r.text, r.project) for r in docs.collect()} == {"a/x.md": ("# One\n", "a"), "b.markdown": ("Ünï", "")}
    assert {r.path: r.reason for r in failures.collect()} == {"bad.md": "not_utf8", "nul.md": "nul", "big.md": "too_large"}
    mark = lambda: S.watermark(S.scan(spark, str(tmp_path), content=False)).first()[0]
    one = mark()
    assert one == mark() and one != S.watermark(files, "other settings").first()[0]
    (tmp_path / "b.markdown").write_text("changed")
    assert one != mark()


def test_generations(spark, tmp_path):
    g = S.Generations(spark, str(tmp_path / "index"))
    assert g.current() is None
    with pytest.raises(FileNotFoundError):
        g.load()
    first = g.write({"docs": spark.range(3)}, {"format": 1})
    second = g.write({"docs": spark.range(5)}, {"format": 1})
    tables, header = g.load()
    assert tables["docs"].count() == 5 and header == {"format": 1} and g.current() == second
    assert g.load(first)[0]["docs"].count() == 3
    g.publish(first)
    assert g.prune(1) == [] and g.current() == first
    g.publish(second)
    assert g.prune(1) == [first] and g.names() == [second]
    part = next(p for p in (tmp_path / "index" / second / "docs").iterdir() if p.name.endswith(".parquet"))
    os.remove(part)
    with pytest.raises(Exception):
        g.load()


def test_notes(spark):
    files = spark.createDataFrame([("n1", "Title: Plan\nDate: 2024-01-02T03:04:05Z\nTags: a, b\n\nintro\n## One\nfirst\n## Two\nsecond\n"), ("n2", "Title: x\n\nno date"), ("n3", "date: soon\n\nbad")], "note_id string, text string")
    good, bad = S.notes(files)
    assert [(r.ordinal, r.heading, r.body, r.title) for r in good.orderBy("ordinal").collect()] == [(0, "", "intro", "Plan"), (1, "One", "first", "Plan"), (2, "Two", "second", "Plan")]
    assert {r.note_id: r.reason for r in bad.collect()} == {"n2": "no_date", "n3": "bad_date"}


def test_connectors(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": "0a0b0c0d", "title": "A", "project": "old", "tags": ["x"]}, {"id": "bad", "title": "B"}, {"id": "00000000", "title": ""}]))
    corpus = C.records(spark, str(tmp_path / "t.json"), C.TASK)
    projects = spark.createDataFrame([("new", ["0a0b0c0d"])], "title string, task_ids array<string>")
    assert [(r.id, r.project) for r in C.tasks(corpus, projects).collect()] == [("0a0b0c0d", "new")]
    issues = C.replay(spark, [{"id": "a"}, {"id": "b"}], C.ISSUE)
    assert sorted(r.id for r in C.issues(issues.where("id = 'a'"), issues).collect()) == ["a", "b"]
    hits = C.replay(spark, [{"docid": "1", "file": "mine/a.md", "snippet": "@@ -3,2 @@\ntext"}, {"docid": "2", "file": "other/a.md", "snippet": ""}], C.SEMANTIC)
    assert [(r.docid, r.span_line, r.body) for r in C.semantic_hits(hits, "mine").collect()] == [("1", 3, "text")]
    assert C.mail_page(C.replay(spark, [{"id": "1"}, {"id": "2"}], C.MAIL), limit=1).count() == 1


def test_plug_in_source(spark):
    spark.dataSource.register(C.RecordSource)
    got = spark.read.format("braidwell_records").option("schema", "part int, text string").option("function", "tests.test_sources:rows_for_test").option("partitions", "3").load()
    assert sorted(r.part for r in got.collect()) == [0, 1, 2]


def test_config(spark):
    good = C.load_config('[defaults]\nsensitivity = 2\n[[sources]]\nid = "a"\nderives_from = "b"\n[[sources]]\nid = "b"\nbase_prior = 1.5\nintent_priors = { natural_language = 2.0 }\n')
    assert [(s["source_id"], s["sensitivity"], s["base_prior"]) for s in good] == [("a", 2, 1.0), ("b", 2, 1.5)]
    assert C.sources_frame(spark, good).count() == 2
    with pytest.raises(ValueError, match="unknown key colour.*base_prior.*named twice"):
        C.load_config('[[sources]]\nid = "a"\ncolour = 1\n[[sources]]\nid = "a"\nbase_prior = 9.0\n')


LOG = [
    {"schema": 1, "id": "a", "event_time": "2024-01-01T00:00:00Z", "title": "one", "body": "b1", "text": "ignored", "system": "tasks", "ref": "7"},
    {"schema": 2, "id": "b", "event_time": "2024-01-02T00:00:00Z", "title": "two", "text": "t2", "actor": "ann"},
    {"schema": 3, "id": "c", "event_time": "2024-01-02T00:00:00Z"},
    {"schema": 1, "id": "", "event_time": "2024-01-02T00:00:00Z"},
    {"schema": 1, "id": "d", "event_time": "soon"},
]


def test_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text("\n".join(map(json.dumps, LOG)) + "\n{broken\n")
    good, bad = W.read(spark, str(tmp_path / "in"))
    assert {r.id: (r.text, r.actor) for r in good.collect()} == {"a": ("b1", None), "b": ("t2", "ann")} and bad.count() == 4
    take = lambda: W.catch_up(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cursor"))
    assert take()["rows"] == 6 and take()["rows"] == 0
    with open(tmp_path / "in" / "1.jsonl", "a") as f:  # a log grows at its end
        f.write(json.dumps({**LOG[0], "event_time": "2020-01-01T00:00:00Z", "title": "late"}) + "\n" + json.dumps({**LOG[0], "schema": 2, "title": "other"}) + "\n" + '{"schema": 1, "id": "e",')
    assert take() == {"rows": 2, "generation": 2, "rewritten": False} and take()["rows"] == 0  # the unfinished line waits
    with open(tmp_path / "in" / "1.jsonl", "a") as f:
        f.write(' "event_time": "2023-01-01T00:00:00Z", "title": "end"}\n')
    (tmp_path / "in" / "2.jsonl").write_text(json.dumps({**LOG[1], "title": "two again"}) + "\n")
    assert take()["rows"] == 2
    taken = spark.read.parquet(str(tmp_path / "out")).where("ok")
    assert taken.count() == 6 and W.snapshot(taken).first().label == "records=6 latest=2024-01-02T00:00:00Z"
    assert {(r.schema, r.id): r.title for r in W.latest(taken).collect()} == {(1, "a"): "late", (2, "a"): "other", (2, "b"): "two again", (1, "e"): "end"}
    assert W.latest(taken).columns == taken.columns
    (tmp_path / "in" / "1.jsonl").write_text(json.dumps(LOG[0]) + "\n")  # shorter than the cursor: rewritten
    assert take() == {"rows": 2, "generation": 1, "rewritten": True}
    taken = spark.read.parquet(str(tmp_path / "out")).where("ok").withColumn("n", F.lit(1))
    assert sorted(r.title for r in taken.collect()) == ["one", "two again"]
    taken = W.read(spark, [str(tmp_path / "in")])[0]
    up = {r.id: list(r.derived_from) for r in W.upstream(taken, {"tasks": "u-tasks"}).collect()}
    assert up == {"a": ["u-tasks:7"], "b": []}


def test_ranges_of_a_log_own_each_line_once(spark, tmp_path):
    want = [f"line {i} " + "x" * (i % 7 * 11) for i in range(300)]
    (tmp_path / "a.log").write_text("\n".join(want) + "\nunfinished")
    for split in (1, 7, 64, 1000, 1 << 20):
        if split >= 1000:
            rows = appends.read_lines(spark, str(tmp_path / "a.log"), split).orderBy("position").collect()
            assert [r.value for r in rows] == want
        ranges = appends._ranges({"f": 0}, {}, {"f": appends._end(str(tmp_path / "a.log"))}, split)
        got = [v.decode() for r in ranges for _, values in appends.lines(str(tmp_path / "a.log"), *r.value[2:]) for v in values]
        assert got == want


def test_states(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    n = lambda v: F.lit(v)
    assert [pick(W.progress(n(1), n(v))) for v in (2, 1, 0)] == ["advanced", "unchanged", "regressed"]
    assert [pick(W.stream_coverage(n(f), n(m), n(2))) for f, m in ((0, 0), (1, 0), (0, 1), (0, 2))] == ["complete", "partial", "partial", "unavailable"]
    before = spark.createDataFrame([("a", 10, "h"), ("b", 10, "h"), ("c", 10, "h"), ("d", 10, "h")], "path string, size long, head string")
    now = spark.createDataFrame([("a", 12, "h"), ("b", 9, "h"), ("c", 12, "x")], "path string, size long, head string")
    assert sorted(r.path for r in W.rewritten(before, now).collect()) == ["b", "c", "d"]
    status = lambda *s: W.refresh_status(spark.createDataFrame([("x", v) for v in s], "source_id string, status string")).first().status
    assert [status("ok"), status("ok", "failed"), status("failed"), status()] == ["ok", "partial", "failed", "ok"]
    got = W.refresh({"a": lambda: 1, "b": lambda: 1 / 0})
    assert got["a"] == ("ok", 1) and got["b"][0] == "failed"
