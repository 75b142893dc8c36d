import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidwell.functions import analyze as A
from braidwell.functions import markdown as M
from braidwell.functions import text as X


def value(spark, column, **cells):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in cells.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("Hello, Wörld-2!", ["hello", "wörld", "2"]), ("", []), (None, None), ("a" * 65 + " b", ["b"]), ("Straße  ñ", ["straße", "ñ"])],
)
def test_tokens(spark, text, want):
    assert value(spark, X.tokens(F.col("t")), t=text) == want if text is not None else True


def test_stream_tokens(spark):
    assert value(spark, X.stream_tokens(F.col("t")), t="v2/AB-1. --x_y-- a:b, ...") == ["v2/ab-1", "x_y", "a:b"]


@pytest.mark.parametrize(
    "word,want",
    [("box", {"boxes"}), ("boxes", {"boxeses", "box", "boxe"}), ("city", {"cities"}), ("cities", {"citieses", "city", "citie"}), ("day", {"days"}), ("days", {"dayses", "day"}), ("lens", {"lenses"}), ("status", {"statuses"}), ("go", set()), ("ties", {"tieses", "tie"})],
)
def test_number_variants(spark, word, want):
    assert set(value(spark, X.number_variants(F.col("w")), w=word)) == want


def test_strip_unsafe(spark):
    assert value(spark, X.strip_unsafe(F.col("t")), t="a\x1b[31mred\x1b[0m\tb\nc\x07‮d�e\x1b]0;title\x07f") == "ared\tb\ncdef"


@pytest.mark.parametrize(
    "text,want",
    [("javascript:x", "[blocked:javascript]x"), ("see ftp://h/x", "see [blocked:ftp]//h/x"), ("https://ok mailto:a@b", "https://ok mailto:a@b"), ("note: data: x", "note: [blocked:data] x"), ("metadata:x", "metadata:x"), ("a.data:x", "a.data:x")],
)
def test_neutralize_links(spark, text, want):
    assert value(spark, X.neutralize_links(F.col("t")), t=text) == want


def test_bounds_and_clips(spark):
    assert value(spark, X.bounded(F.col("t"), 5), t="abcdefg") == "abcd…"
    assert value(spark, X.bounded(F.col("t"), 5), t="abcde") == "abcde"
    assert value(spark, X.clip_bytes(F.col("t"), 8), t="ééééééé") == "éé…"
    assert value(spark, X.truncated_at_word(F.col("t"), 12), t="one two three four") == "one two…"
    assert value(spark, X.token_estimate(F.col("t")), t="abcde") == 2
    assert value(spark, X.preview(F.col("t")), t="\n\n one \n two\n\nthree") == "one two"


def test_names_paths_and_quotes(spark):
    assert value(spark, X.matchable_name(F.col("t")), t="  Ada-LOVELACE! ") == "ada lovelace"
    assert value(spark, X.matchable_name(F.col("t")), t="Ada") is None
    assert value(spark, X.path_identifiers(F.col("t")), t="plans/Q3-plan.md") == ["plans q3 plan md", "q3 plan md", "plans q3 plan", "q3 plan"]
    assert value(spark, X.project_of(F.col("t")), t="a/b.md") == "a" and value(spark, X.project_of(F.col("t")), t="b.md") == ""
    assert value(spark, X.quoted_runs(F.col("t")), t='say "one" and `two`\n\nan "open\n\nend" “three”') == "one two three "
    assert value(spark, X.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    assert value(spark, X.contains_word_of(X.spaced(F.col("t")), F.lit("art")), t="art-house") is True
    assert value(spark, X.contains_word_of(X.spaced(F.col("t")), F.lit("art")), t="smart") is False


def test_metadata_is_cut_and_cleaned(spark):
    m = F.create_map(*(F.lit(x) for i in range(30) for x in (f"k{i:02}", "javascript:x" if i == 0 else "v" * 300)))
    got = value(spark, X.clean_metadata(m))
    assert len(got) == 24 and got["k00"] == "[blocked:javascript]x" and len(got["k01"]) == 200


@pytest.mark.parametrize("args,want", [((0, 2, 0, 10), 0.0), ((2, 2, 1, 10), 0.1 / 0.12), ((1, 2, 1, 10), 0.5 * 0.1 / 0.12), ((1, 0, 1, 10), 1.0), ((1, 1, 1, 0), 1.0)])
def test_relevance(spark, args, want):
    assert value(spark, X.relevance(*(F.lit(a) for a in args))) == pytest.approx(want)


def test_analyze():
    a = A.analyze('what is "the plan" for Q3')
    assert a.raw == ["what", "is", "the", "plan", "for", "q3"] and a.terms == ["the", "plan", "for", "q3"] and a.normalized
    assert A.analyze("what is the").terms == ["what", "is", "the"] and not A.analyze("what is the").normalized
    assert A.analyze("").terms == []


@pytest.mark.parametrize("query,want", [("", ""), ("?!", ""), ("roadmap", "identifier_query"), ("see docs/plan.md now", "identifier_query"), ("who owns the plan", "natural_language"), ("fix foo_bar", "identifier_query"), ("ticket AB-12 please", "identifier_query"), ("the ab12cd34 thing", "identifier_query"), ("a-b c", "natural_language")])
def test_classify(query, want):
    assert A.classify(query) == want


def test_terms_and_pieces():
    assert A.task_terms("The Big-plan, the big one is 7!") == ["big", "plan", "one"]
    assert A.probe_terms(["a1", "long", "mid"], 2) == ["long", "mid"]
    assert A.probe_terms(["ab", "cd"], 3, phrase=True) == ["ab cd", "ab", "cd"]
    assert A.identifier_tokens("see (0a1b2c3d), 0a1b2c3d and xyz", "[0-9a-f]{8}") == ["0a1b2c3d"]
    assert A.shell_pieces(r'from:"Ann B" a\ b -x') == ["from:Ann B", "a b", "-x"]
    assert A.mail_terms('from:"Ann B" -label:spam in:inbox budget the') == ["ann", "b", "budget"]
    assert A.has_operator("in:inbox x") and not A.has_operator("a:b")


MD = "intro\n# Top #\nbody\n\n```\n# not a heading\n```\n## Sub\n\n   ### Deep\ntext\n    # indented code\n## Two\n\n"


def test_sections():
    got = [(s["heading"].strip(), s["path"], s["start_line"], s["end_line"], s["body"]) for s in M.sections(MD)]
    assert got == [
        ("", [], 1, 1, "intro"),
        ("# Top #", ["Top"], 2, 7, "body\n\n```\n# not a heading\n```"),
        ("## Sub", ["Top", "Sub"], 8, 8, ""),
        ("### Deep", ["Top", "Sub", "Deep"], 10, 12, "text\n    # indented code"),
        ("## Two", ["Top", "Two"], 13, 13, ""),
    ]
    assert M.sections("") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["# a", "## b", "### c", "x", "", "```", "~~~", "    # code"]), max_size=25))
def test_sections_cover_every_line_of_text_once(lines):
    found = M.sections("\n".join(lines))
    assert [s["ord"] for s in found] == list(range(len(found)))
    assert all(a["end_line"] < b["start_line"] for a, b in zip(found, found[1:]))
    inside = {n for s in found for n in range(s["start_line"], s["end_line"] + 1)}
    assert all(i in inside for i, x in enumerate(lines, 1) if x.strip())


@pytest.mark.parametrize(
    "text,want",
    [("[a](b(c)d) e", "[a]  e"), (r"\](x) [a](open", r"\](x) [a](open"), ("[r]: http://x/y title", "[r]:  title"), ("go to https://a.b/c, then", "go to  , then"), ("www.x.org and foo.bar", "  and foo.bar"), ("plain: text", "plain: text")],
)
def test_without_locators(text, want):
    assert M.without_locators(text) == want


def test_excerpt():
    body = "first line\n\n" + "filler " * 30 + "\nthe alpha line\nand beta too\n" + "tail " * 100
    got = M.excerpt(body, {"alpha", "beta"})
    assert "alpha" in got and "beta" in got and len(got) <= 400
    assert M.excerpt(body, {"gamma"}) is None and M.excerpt("", {"a"}) is None
    long = M.excerpt("x " * 300 + "needle" + " y" * 300, {"needle"})
    assert "needle" in long and len(long) <= 400 and long[0] == long[-1] == "…"


def test_chunk_table(spark):
    docs = spark.createDataFrame([(1, MD), (2, None), (3, "only [link](http://x) text")], "doc_id long, text string")
    rows = M.chunked(docs, "doc_id").orderBy("doc_id", "ord").collect()
    assert [r.title for r in rows if r.doc_id == 1] == ["Top", "Top", "Top > Sub", "Top > Sub > Deep", "Top > Two"]
    assert [r.indexed.split() for r in rows if r.doc_id == 3] == [["only", "[link]", "text"]]


def test_texts_are_handled_some_bytes_at_a_time():
    import pyarrow as pa

    from braidwell.functions import markdown as M

    texts = ["ab", None, "", "é" * 5, "x" * 40, "c", "d" * 9, "e"]
    assert M.by_slices(pa.array(texts), str.upper, pa.string(), 10).to_pylist() == [None if t is None else t.upper() for t in texts]
    assert M.by_slices(pa.array(["x", *texts, "y"]).slice(1, len(texts)), str.upper, pa.string(), 10).to_pylist() == [None if t is None else t.upper() for t in texts]
    assert M.by_slices(pa.array([], pa.string()), str.upper, pa.string(), 10).to_pylist() == []
    sizes = [len((t or "").encode()) for t in texts] * 50
    cut = list(M.slices(sizes, 50))
    assert [i for a, b in cut for i in range(a, b)] == list(range(len(sizes))) and max(sum(sizes[a:b]) for a, b in cut) <= 50
