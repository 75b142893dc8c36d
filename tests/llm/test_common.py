import numpy as np
import pyarrow as pa
import pytest

from braidwell.llm import common as C


def test_buffers_of_sliced_and_null_columns():
    a = pa.array(["é", None, "", "abc", "d"])
    for part, want in ((a, ["é", "", "", "abc", "d"]), (a.slice(1, 3), ["", "", "abc"]), (a.slice(3), ["abc", "d"]), (a.slice(5), []), (a.cast(pa.large_string()), ["é", "", "", "abc", "d"]), (pa.chunked_array([a.slice(0, 2), a.slice(2)]), ["é", "", "", "abc", "d"])):
        raw, offsets, valid = C.text_buffers(part)
        assert [bytes(raw[i:j]).decode() for i, j in zip(offsets, offsets[1:])] == want
        assert list(valid) == [x is not None for x in part.to_pylist()]
    assert len(C.text_buffers(pa.nulls(3, pa.string()))[1]) == 4


def test_slices_cover_rows_once_and_bound_text():
    texts = ["x" * n for n in (5, 50, 1, 1, 1, 200, 3)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"])
    parts = list(C.slices(batch, "text", 60))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 60 for p in parts)
    assert list(C.slices(batch.slice(0, 0), "text")) == []


def test_mixing_is_a_bijection_and_spreads_bits():
    h = C.mix(np.arange(100_000, dtype=np.uint64))
    assert len(np.unique(h)) == len(h)
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).mean(0)
    assert (abs(bits - 0.5) < 0.02).all()


@pytest.mark.parametrize("text,want", [("ÀÉÎ", "àéî"), ("Ã×", "ã×"), ("ß", "ß"), ("", "")])
def test_folded(text, want):
    assert bytes(C.folded(np.frombuffer(text.encode(), np.uint8))).decode() == want


def test_joins_by_id_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "c", "z"), (2, "d", "w")], "doc_id long, `__id` string, `__ID_` string")
    ids = spark.createDataFrame([(2,), (7,)], "doc_id long")
    assert C.fresh(docs, "__id") not in ("__id", "__ID_", "__id_")
    gone, kept = C.drop_ids(docs, ids), C.keep_ids(docs, ids)
    assert gone.columns == kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in gone.collect()) == [(False, 1), (True, 0)]
    assert [r.doc_id for r in kept.collect()] == [2, 2]


def test_scratch(spark):
    s = C.Scratch(spark)
    t = s.table(spark.range(5), "t")
    assert t.count() == 5 and s.root in _roots()
    s.drop("t")
    with pytest.raises(Exception):
        spark.read.parquet(s.path("t")).count()


def _roots():
    return C._roots


def words(*texts):
    w = C.Words(*C.text_buffers(pa.array(texts))[:2], by_class=True)
    return [bytes(w.raw[a:b]).decode() for a, b in zip(w.starts, w.ends)], w


def test_words_by_unicode_class():
    assert words("春眠，不覺。Tokyo東京3x", "é", "日")[0] == ["春", "眠", "不", "覺", "Tokyo", "東", "京", "3x", "é", "日"]
    assert words("«Où?» — привет… don’t hi！")[0] == ["Où", "привет", "don", "t", "hi"]
    assert words("ที่นี่ดี abc", "ก\u0301x")[0] == ["ที่", "นี่", "ดี", "abc", "ก\u0301", "x"]
    assert words("हिन्दी भाषा। 한국어 말")[0] == ["हिन्दी", "भाषा", "한국어", "말"]
    assert list(words("ab 東 ก")[1].kind) == [1, C.HAN, C.THAI]
    w = words("東，京。", "京！東", "東京")[1]
    h = w.hashes()
    assert h[0] == h[3] == h[4] and h[1] == h[2] == h[5]
