import random
import re

import numpy as np
import pyarrow as pa

from braidwell.llm import substring as S
from braidwell.llm.common import Words, mix, text_buffers
from tests.conftest import MEDIUM, SMALL
from tests.llm.cases import awkward_documents, passage, sentence

WORD = re.compile(r"[0-9A-Za-z\u00aa-\u02ff\u0300-\u1fff\u3040-\U0010ffff]+")


def brute_units(text, min_words=S.MIN_WORDS, line_words=S.LINE_WORDS):
    """(start, stop, words) of the passages and of the lines of a text, one word after another."""
    words = [m for m in WORD.finditer(text) if m.group() not in "«»"]
    if not words:
        return []
    gaps = [text[a.end() : b.start()] for a, b in zip(words, words[1:])]
    line = [True] + ["\n" in g for g in gaps]
    border = [a or (len(g.encode()) > 1 and bool(re.search(r"[.!?]", g))) for a, g in zip(line, ["", *gaps])]
    plain = [w.group().lower() for w in words]
    h = Words(*text_buffers(pa.array([" ".join(plain)]))[:2]).hashes()
    n = len(words)
    after = np.array([h[k + 1] if k + 1 < n and not line[k + 1] else 0 for k in range(n)], np.uint64)
    key = mix(h * np.uint64(0xD6E8FEB86659FD93) + after, 3) >> np.uint64(1)

    def chosen(forced, gap, rank):
        out = {k for k in range(n) if forced[k]}
        for i in range(n - gap + 1):
            if not any(forced[i : i + gap]):
                low = min(rank(k) for k in range(i, i + gap))
                out |= {k for k in range(i, i + gap) if rank(k) == low}
        return sorted(out)

    at = chosen(line, S.GAP, lambda k: (not border[k], key[k] | np.uint64(1)))
    ways = chosen(border, S.GAP // 2, lambda k: key[k] | np.uint64(1))
    out = []
    for i in at:
        j = next((j for j in [*ways, n] if j - i >= min_words), None)
        if j is not None:
            out.append((words[i].start(), words[j].start() if j < n else len(text), ("passage", *plain[i:j])))
    first = [i for i in range(n) if line[i]]
    for j in [*first[1:], n]:
        begin = [i for i in at if j - i >= min_words]
        if begin and (new := (words[begin[-1]].start(), words[j].start() if j < n else len(text), ("passage", *plain[begin[-1] : j]))) not in out:
            out.append(new)
    for i, j in zip(first, [*first[1:], n]):
        if j - i >= line_words:
            stop = text.find("\n", words[j - 1].end())
            out.append((text.rfind("\n", 0, words[i].start()) + 1, len(text) if stop < 0 else stop + 1, ("line", *plain[i:j])))
    return sorted(out, key=lambda u: u[0])


def brute(docs, min_words=S.MIN_WORDS, line_words=S.LINE_WORDS):
    """(start, stop, keeper) of what goes, by document."""
    cut, first, out = {i: brute_units(t, min_words, line_words) for i, t in docs.items()}, {}, {}
    for i in sorted(docs):
        for _, _, u in cut[i]:
            first.setdefault(u, i)
    for i in docs:
        seen, gone, spans = {}, [], []
        for start, stop, u in cut[i]:
            if first[u] < i or start >= seen.setdefault(u, stop):
                gone.append((start, -stop, first[u]))
        end = 0
        for start, stop, keeper in sorted(gone):
            if -stop > end:
                start = max(start, end)
                if spans and spans[-1][1] == start and spans[-1][2] == keeper:
                    spans[-1] = (spans[-1][0], -stop, keeper)
                else:
                    spans.append((start, -stop, keeper))
                end = -stop
        if spans:
            out[i] = spans
    return out


def planted():
    r = random.Random(5)
    docs = {i: "\n".join(" ".join(sentence(r, r.randint(4, 14)) for _ in range(4)) for _ in range(4)) for i in range(40)}
    shared = [passage(100 + k) for k in range(4)]
    for k, p in enumerate(shared):
        for i in range(k, 40, 5):
            at = [m.start() + 1 for m in re.finditer(" (?=[a-z])", docs[i])]
            cut = at[len(at) * (k + 1) // 6]
            docs[i] = docs[i][:cut] + p + " " + docs[i][cut:]
    return docs, shared


def test_equals_brute_force(spark):
    docs, shared = planted()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.stop, s.kept_doc_id) for s in r.removed] for r in S.repeats(spark, df).collect()}
    assert got == brute(docs)
    clean = {r.doc_id: r.text for r in S.cleaned(spark, df).collect()}
    for p in shared:
        core = " ".join(p.split()[24:-24])
        assert sum(core in t for t in clean.values()) == 1
    assert all(clean[i] == t for i, t in docs.items() if i not in got)


def test_equals_brute_force_on_the_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: [(s.start, s.stop, s.kept_doc_id) for s in r.removed] for r in S.repeats(spark, df).collect()}
    assert got == brute({r.doc_id: r.text for r in df.collect()})


def test_no_passage_of_over_50_words_is_left_in_two_documents(spark):
    df = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")

    def shared(rows, n=51):
        seen, found = {}, 0
        for r in sorted(rows, key=lambda r: r.doc_id):
            words = [m.group().lower() for m in WORD.finditer(r.text)]
            grams = {hash(tuple(words[i : i + n])) for i in range(len(words) - n + 1)}
            found += sum(g in seen for g in grams)
            seen |= dict.fromkeys(grams, r.doc_id)
        return found

    assert shared(df.collect()) > 1000 and shared(S.cleaned(spark, df).collect()) == 0


def test_every_long_repeat_is_found_wherever_it_begins():
    """Passages without any stop or line end, in the middle of other words."""
    r = random.Random(12)
    word = lambda: r.choice("abcdefg") + str(r.randrange(10**6))
    for n in range(S.MIN_WORDS + 2 * S.GAP, S.MIN_WORDS + 2 * S.GAP + 20):
        p = " ".join(word() for _ in range(n))
        texts = [" ".join(word() for _ in range(r.randrange(1, 40))) + " " + p + " " + " ".join(word() for _ in range(20)) for _ in range(2)]
        u = S.units(*text_buffers(pa.array(texts))[:2])
        both = {x for x, d in zip(u["h1"], u["doc"]) if d == 0} & {x for x, d in zip(u["h1"], u["doc"]) if d == 1}
        assert both


def test_units_do_not_depend_on_the_texts_beside():
    r = random.Random(21)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(r.randrange(1, 120))) for _ in range(300)]
    one = S.units(*text_buffers(pa.array(texts))[:2])
    got = {i: sorted(zip(one["start"][one["doc"] == i], one["h1"][one["doc"] == i])) for i in range(len(texts))}
    for i, t in enumerate(texts):
        u = S.units(*text_buffers(pa.array([t]))[:2])
        assert sorted(zip(u["start"], u["h1"])) == got[i]


def removed(spark, docs, **how):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r.doc_id: (r.text, [(s.start, s.stop, s.kept_doc_id) for s in r.removed]) for r in S.repeats(spark, df, **how).collect()}


def test_a_repeated_line_goes_from_all_but_the_first(spark):
    r = random.Random(2)
    footer = "Please visit the harbour office to renew this permit before the last day of every second month"
    bodies = {i: sentence(r, 20) for i in range(200)}
    got = removed(spark, {i: f"{b}\n{footer}\n{sentence(r, 20)}" for i, b in bodies.items()})
    assert set(got) == set(range(1, 200)) and all(footer not in t and t.startswith(bodies[i] + "\n") and spans[0][2] == 0 for i, (t, spans) in got.items())
    assert removed(spark, {i: f"{b}\nYours truly.\n{sentence(r, 20)}" for i, b in bodies.items()}) == {}


def test_sentences_of_different_documents_are_no_repeat(spark):
    r = random.Random(6)
    parts = [sentence(r, 14) for _ in range(3)]
    docs = {i: f"{sentence(r, 12)} {p} {sentence(r, 12)}" for i, p in enumerate(parts)} | {9: " ".join(parts)}
    assert removed(spark, docs) == {}


def test_each_span_names_the_document_that_keeps_it(spark):
    r = random.Random(7)
    one, two = passage(70), passage(71)
    docs = {1: two, 2: one, 3: f"{sentence(r, 12)} {one} {two} {sentence(r, 12)}"}
    text, spans = removed(spark, docs)[3]
    assert [k for _, _, k in spans] == [2, 1] and spans[0][1] == spans[1][0] == docs[3].index(two)
    assert docs[3][spans[0][0] : spans[0][1]].startswith(one[:200]) and len(text.split()) <= 24 + 3 * S.GAP


def test_capitals_inside_sentences_do_not_cut(spark):
    text = "das Haus an der Straße nach Norden hat einen Garten mit vielen alten Bäumen " * 1
    u = S.units(*text_buffers(pa.array([text, text.lower()]))[:2])
    assert sorted(u["h1"][u["doc"] == 0]) == sorted(u["h1"][u["doc"] == 1])


def test_offsets_are_characters_of_the_original(spark):
    p = "Ærø ñandú élan. " + passage(9)
    df = spark.createDataFrame([(1, "ß α 你\n" + p), (2, "émile и\n" + p + " tail ü")], "doc_id long, text string")
    (row,) = S.repeats(spark, df).collect()
    text = "émile и\n" + p + " tail ü"
    s = row.removed[0]
    assert row.doc_id == 2 and s.kept_doc_id == 1 and text[s.start : s.stop].startswith("Ærø") and row.text == text[: s.start] + text[s.stop :]


def test_units_of_awkward_texts():
    for texts in ([], ["", None], ["..."], ["a"], ["A b. C\nd"], ["a " * 100], ["\n\n" + "b c " * 20 + "\n"]):
        u = S.units(*text_buffers(pa.array(texts, pa.string()))[:2])
        assert sorted(zip(u["start"], u["stop"])) == sorted((a, b) for t in texts if t for a, b, _ in brute_units(t))


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    out = S.cleaned(spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    assert [i for n, i in ids if not n] == [1, 2, 3, 4, 5, 6, 9, 9, 10, 11] and sum(n for n, _ in ids) == 1
    by = {r.doc_id: r.text for r in rows}
    assert by[1] is None and by[2] == "" and by[9] == passage(4)
    assert by[5].startswith(passage(2)) and len(by[5].split()) <= len(passage(2).split()) + 1.5 * S.GAP  # no line or sentence ends where its copies meet
    assert S.cleaned(spark, docs.limit(0)).count() == 0 and S.repeats(spark, docs.limit(0)).count() == 0


def test_repeats_in_scripts_without_spaces(spark):
    r = random.Random(4)
    draw = lambda low, n, k, stop: "".join("".join(chr(low + r.randrange(n)) for _ in range(20)) + stop for _ in range(k))
    for low, n, stop in ((0x4E00, 2000, "。"), (0x4E00, 2000, "！"), (0x0E01, 46, " ")):
        shared = draw(low, n, 10, stop)
        texts = [(1, draw(low, n, 3, stop) + shared), (2, draw(low, n, 3, stop) + shared + draw(low, n, 3, stop))]
        (row,) = S.repeats(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()
        (s,) = row.removed
        assert row.doc_id == 2 and s.kept_doc_id == 1 and texts[1][1][s.start : s.stop] in shared and s.stop - s.start >= len(shared) - 3 * S.GAP
    short = "".join(chr(0x4E00 + i) for i in range(28)) + "。"
    assert S.repeats(spark, spark.createDataFrame([(1, short), (2, short)], "doc_id long, text string")).count() == 0
