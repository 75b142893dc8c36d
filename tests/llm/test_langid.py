import re
from collections import Counter

import numpy as np
import pyarrow as pa

from braidwell.llm import langid as L
from braidwell.llm.common import text_buffers
from braidwell.llm.langid import Features
from tests.llm.cases import AWKWARD, awkward_documents


def brute(scores, penalty):
    v, back = np.zeros(scores.shape[1]), []
    for row in scores:
        b = v.argmax()
        stay = v >= v[b] - penalty
        back.append(np.where(stay, np.arange(len(v)), b))
        v = np.where(stay, v, v[b] - penalty) + row
    return v.max()


def test_viterbi_equals_one_pass():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(0, 60, rng.integers(1, 6))
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = rng.integers(-6, 1, (first[-1], 3)).astype(np.float32)
        state = L.viterbi(scores, first, 4.0, block=7)
        for a, b in zip(first, first[1:]):
            s = state[a:b]
            assert b == a or abs(scores[np.arange(a, b), s].sum() - 4 * (s[1:] != s[:-1]).sum() - brute(scores[a:b], 4.0)) < 1e-3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs.where("doc_id % 2 = 0")
    model = L.train(half)
    rows = docs.where("doc_id % 2 = 1").toPandas()
    got = L.label(*text_buffers(pa.array(rows.text.tolist()))[:2], model)
    assert np.mean([g[0] == t for g, t in zip(got, rows.lang)]) > 0.98
    assert all(g[2] for g in got)


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    pick = lambda lang: docs.where(f"lang = '{lang}' AND n_chars BETWEEN 900 AND 2000").orderBy("doc_id").first().text
    en, de = pick("en")[:700], pick("de")[:700]
    text = en + " " + de + " Привет мир, как дела сегодня? 你好 " + en
    ((lang, _, ok, spans),) = L.label(*text_buffers(pa.array([text]))[:2], model)
    langs = [s[2] for s in spans]
    assert lang == "en" and ok and langs[0] == "en" and "de" in langs and "ru" in langs and langs[-1] == "en"
    start = next(s[0] for s in spans if s[2] == "de")
    assert abs(start - len(en)) < 40
    assert all(text[a:b].strip() for a, b, _ in spans)


def test_a_word_of_another_script_is_a_span_of_its_own(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    en = docs.where("lang = 'en' AND n_chars BETWEEN 300 AND 900").orderBy("doc_id").first().text
    for words in ("Москва", "Москва большая", "Москва большая столица"):
        text = f"{en} {words} {en}"
        ((lang, _, ok, spans),) = L.label(*text_buffers(pa.array([text]))[:2], model)
        assert lang == "en" and ok and [text[a:b] for a, b, x in spans if x == "ru"] == [words]
    japanese = "私は東京に住んでいます 毎日 電車で 会社に行きます"
    assert {x for _, _, x in L.label(*text_buffers(pa.array([japanese]))[:2], model)[0][3]} == {"ja"}
    assert {x for _, _, x in L.label(*text_buffers(pa.array(["你好 世界 北京"]))[:2], model)[0][3]} == {"zh"}


def test_short_noise_is_rejected_and_short_prose_is_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.train(docs)
    words = docs.where("lang = 'en'").orderBy("doc_id").first().text.split()
    short = [" ".join(words[i : i + n]) for n in range(1, 8) for i in range(0, 60, n)]
    noise = ["qzxjkvwq", "xqzkjvbb wqxzjkvf", "zzxqjkvw qpxzkjwv vvqxzjk", "хжщъ"]
    got = [x[2] for x in L.label(*text_buffers(pa.array([*short, *noise]))[:2], model)]
    assert all(got[: len(short)]) and got[len(short) :] == [False, False, False, True]  # no language is trained in the last one's script


def brute_label(text, model, penalty=L.PENALTY):
    """One word and one trigram at a time."""
    raw = text.encode()
    words = [m for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    hashes = Features(*text_buffers(pa.array([text]))[:2]).word
    low = [b + 32 if 65 <= b <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97) else b for i, b in enumerate(raw)]
    script = [int(L._SCRIPT[raw[m.start()], raw[min(m.start() + 1, len(raw) - 1)]]) for m in words]
    names = model.languages + [L.SCRIPT_LANGUAGE[L.SCRIPTS[s]] for s in sorted({s for s in script if s < 255} - set(model.scripts))]
    scripts = model.scripts + sorted({s for s in script if s < 255} - set(model.scripts))
    rows, means = [], []
    for m, s, h in zip(words, script, hashes):
        mean, full = [], []
        for weights in model.weights:
            total = 0.0
            for i in range(m.start(), m.end()):
                before, after = (low[i - 1] if i > m.start() else 32), (low[i + 1] if i + 1 < m.end() else 32)
                slot = ((low[i] << 16 | after << 8 | before) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
                total += float(weights[slot + 1])
            mean.append(total / (m.end() - m.start()))
            full.append(total + float(weights[h]))
        fits = [t == s for t in scripts]
        like = max([x for x, ok in zip(full, fits) if ok], default=None)
        rows.append([0 if s == 255 else L.NEVER if not ok else max(full[i] - like, -L.CLIP) if i < len(full) else 0 for i, ok in enumerate(fits)])
        means.append(mean)
    best, back = np.zeros(len(names)), []
    for row in rows:
        top = int(best.argmax())
        back.append([i if best[i] >= best[top] - penalty else top for i in range(len(names))])
        best = np.maximum(best, best[top] - penalty) + row
    state, path = int(best.argmax()), []
    for b in reversed(back):
        path.insert(0, state)
        state = b[state]
    count = Counter(p for p, s in zip(path, script) if s < 255)
    lang = min(count, key=lambda p: (-count[p], p))
    own = [m[p] for p, s, m in zip(path, script, means) if s < 255 and p < len(model.languages)]
    score = sum(own) / len(own)
    spans = []
    for m, p in zip(words, path):
        a, b = len(raw[: m.start()].decode()), len(raw[: m.end()].decode())
        if spans and spans[-1][2] == names[p]:
            spans[-1] = (spans[-1][0], b, names[p])
        else:
            spans.append((a, b, names[p]))
    return names[lang], score, score >= L.FLOOR - L.SURE / len(own) ** 0.5, spans


def test_labels_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs)
    rows = docs.where("n_chars < 1500").orderBy("doc_id").limit(40).collect()
    texts = [r.text for r in rows] + [a.text[:300] + " Привет " + b.text[:300] + " 42 Athens Αθήνα" for a, b in zip(rows, rows[20:])] + ["qzxjkvwq xqzkjv"]
    for text, (lang, score, ok, spans) in zip(texts, L.label(*text_buffers(pa.array(texts))[:2], model)):
        want = brute_label(text, model)
        assert (lang, ok, spans) == (want[0], want[2], want[3]) and abs(score - want[1]) < 1e-3


def test_noise_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = np.random.default_rng(1)
    noise = " ".join("".join(rng.choice(list("qxzjkvwbfp"), 9)) for _ in range(60))
    mixed = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, noise, None)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in L.keep_identified(mixed).select("doc_id").collect()}
    assert -1 not in kept and len(kept) == docs.count()


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    rows = L.identify(docs).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang is None and not by[i].accepted and by[i].spans == [] for i in (1, 2, 3, 4))
    assert by[6].accepted and by[None].lang == "en"
    assert {s.lang for s in by[11].spans} >= {"de"}
    out = L.keep_identified(docs)
    assert out.columns == docs.columns and out.count() == len(AWKWARD) - 4
    assert L.identify(docs.limit(0)).count() == 0
    unlabelled = L.identify(docs.where("lang IS NULL AND text IS NOT NULL"))
    assert {r.lang for r in unlabelled.collect()} == {None, "und"}
