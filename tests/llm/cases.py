"""Tables with the rows that break operators: nulls, empty and long texts, repeats, clashing names."""

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll larch marsh north ocean prairie quarry ridge shore tundra upland valley willow yonder zephyr".split()


def sentence(r, n):
    """A sentence of invented words, unlikely to come twice."""
    words = [r.choice(WORDS) + r.choice(WORDS)[:3] + str(r.randrange(50)) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def passage(seed, sentences=6, words=10):
    import random

    r = random.Random(seed)
    return " ".join(sentence(r, words) for _ in range(sentences))


AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, "   \n\t", None, "a", 5),
    (4, "?!... &&&", "en", None, 9),
    (None, passage(1), "en", "a", 1),
    (5, passage(2) * 40, "en", "b", 1),
    (6, passage(3), "en", "b", 1),
    (7, passage(3), "en", "b", 1),
    (8, passage(3).upper(), "en", "c", 1),
    (9, passage(4), None, "c", 1),
    (9, passage(4), None, "c", 1),
    (10, "x" * 300_000, "de", "c", 300_000),
    (11, "Ünïcödé ßtraße 你好 привет", "de", "c", 3),
]
CLASH = ["key", "version", "removed", "kept_doc_id", "__id", "__ID_", "rank", "n_tokens", "shard", "i", "__text", "__version", "__removed", "ids", "accepted"]


def awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*row, *CLASH) for row in AWKWARD], schema)
