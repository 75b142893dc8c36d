"""Text operators as column expressions. All run inside the JVM; nulls stay null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that carry a question but no content.
FUNCTION_WORDS = tuple(sorted("whose who whom which where when what why how were was is does do did being been be are am the an a".split()))
#: Words that task and issue queries drop.
TASK_STOP_WORDS = tuple(
    sorted(
        """your you with will why who which where when what we were was to this there their the that our or on of my me
        it is in i how have has from for does do did by but be at as are any and an am about a""".split()
    )
)
MAX_TOKEN = 64
_NOT_WORD = r"[^\p{L}\p{Nd}]+"


def tokens(text: Column) -> Column:
    """Small-letter runs of letters and digits, at most 64 characters long."""
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda t: (t != "") & (F.length(t) <= MAX_TOKEN))


def stream_tokens(text: Column) -> Column:
    """Like ``tokens``, but runs may hold ``- _ . / :`` inside."""
    runs = F.transform(F.split(F.lower(text), r"[^\p{L}\p{Nd}\-_./:]+"), lambda t: F.regexp_replace(t, "^[-_./:]+|[-_./:]+$", ""))
    return F.filter(runs, lambda t: t != "")


def ascii_terms(text: Column, least: int = 2, most: int = 128, count: int = 12) -> Column:
    """Distinct ASCII words of a task or issue query without stop words, the first ``count`` of them."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= least) & (F.length(t) <= most) & ~t.isin(*TASK_STOP_WORDS))
    return F.slice(F.array_distinct(words), 1, count)


def content_terms(text: Column) -> Column:
    """Distinct tokens without function words; all of them where nothing else is left."""
    raw = F.array_distinct(tokens(text))
    kept = F.filter(raw, lambda t: ~t.isin(*FUNCTION_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(raw)


def stable_identifiers(text: Column) -> Column:
    """Words that name something: paths, addresses, joined_names, ticket-numbers and long words with digits, in small letters."""
    edge = r"[\"'()\[\]{}<>,;!?:]+"
    words = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, f"^{edge}|{edge}$", ""), r"\.+$", ""))
    count = lambda w, kind: F.length(F.regexp_replace(w, kind, ""))
    stable = lambda w: (
        w.rlike(r"[/\\:@#.]") | w.rlike(r"^[\p{L}\p{Nd}-]+(?:_[\p{L}\p{Nd}-]+)+$") | (w.contains("-") & w.rlike(r"\p{L}") & w.rlike(r"\p{Nd}"))
        | ((F.length(w) >= 8) & (count(w, r"[^\p{L}]") >= 2) & (count(w, r"[^\p{Nd}]") >= 2))
    )
    return F.transform(F.filter(words, lambda w: (w != "") & stable(w)), F.lower)


def count_terms(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r]+"), lambda t: t != ""))


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the tokens: equal for texts that differ in case and punctuation only."""
    return F.substring(F.sha2(F.array_join(tokens(text), " "), 256), 1, 16)


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def bounded(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def preview(text: Column, most: int = 400, heading: Column | None = None) -> Column:
    """The first paragraph with its lines trimmed and joined by spaces; the heading where there is none."""
    lines = F.transform(F.split(F.regexp_replace(text, r"^(\s*\n)+", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    blank = F.array_position(lines, "")
    first = F.when(blank > 0, F.slice(lines, F.lit(1), (blank - 1).cast("int"))).otherwise(lines)
    joined = F.array_join(first, " ")
    joined = joined if heading is None else F.when(joined == "", F.trim(heading)).otherwise(joined)
    return bounded(joined, most)


def chunk_title(title: Column, path: Column) -> Column:
    """``Document > Section > Part``, the document's own heading said once."""
    rest = F.when(F.get(path, F.lit(0)) == title, F.slice(path, 2, 1000)).otherwise(path)
    return F.concat_ws(" > ", F.array(title), rest)


def project_of(path: Column) -> Column:
    """First segment of a path that has more than one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def path_identifiers(path: Column) -> Column:
    """The path, its last segment and both without extension, as token sequences of at least two tokens."""
    base = F.element_at(F.split(path, "/"), -1)
    forms = F.array(path, base, F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_replace(base, r"\.[^./]*$", ""))
    sequences = F.array_distinct(F.transform(forms, lambda p: F.array_join(tokens(p), " ")))
    return F.filter(sequences, lambda s: s.contains(" "))


def contains_word(text: Column, word: str) -> Column:
    """Whether ``word`` stands in ``text`` with no ASCII letter or digit beside it."""
    import re

    return text.rlike(f"(?<![A-Za-z0-9]){re.escape(word)}(?![A-Za-z0-9])")


def spaced(text: Column) -> Column:
    """The text with spaces for all but ASCII letters and digits, and around it: made once per text, searched per word."""
    return F.concat(F.lit(" "), F.regexp_replace(text, "[^A-Za-z0-9]", " "), F.lit(" "))


def contains_word_of(spaced_text: Column, word: Column) -> Column:
    """``contains_word`` with a word (of letters and digits) from a column, in a text that is ``spaced``."""
    return (word != "") & spaced_text.contains(F.concat(F.lit(" "), word, F.lit(" ")))


def contains_sequence(haystack: Column, needle: Column) -> Column:
    """Whether a token array holds another as consecutive elements."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & pad(haystack).contains(pad(needle))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs without overlap."""
    return F.when(F.length(part) > 0, F.floor((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def strip_unsafe(text: Column) -> Column:
    """Without terminal escapes, control characters (tabs and line ends stay), direction marks and replacement characters."""
    out = F.regexp_replace(text, r"\x1b\[[\x20-\x3f]*[\x40-\x7e]?", "")
    out = F.regexp_replace(out, r"\x1b\][^\x07\x1b]*(?:\x07|\x1b\\)?", "")
    out = F.regexp_replace(out, r"(?s)\x1b.?", "")
    return F.regexp_replace(out, r"[\x00-\x08\x0b-\x1f\x7f-\x9f‎‏‪-‮⁦-⁩�]|[\p{Cf}\p{Co}\p{Cn}]", "")


DANGEROUS_SCHEMES = ("about", "blob", "chrome", "data", "file", "jar", "javascript", "resource", "vbscript")
_BEFORE = r"(?<![\p{L}\p{Nd}.+-])"


def neutralize_links(text: Column) -> Column:
    """Dangerous schemes, and unknown ones before ``//``, become ``[blocked:scheme]``."""
    named = rf"(?i){_BEFORE}({'|'.join(DANGEROUS_SCHEMES)}):"
    other = rf"(?i){_BEFORE}(?!(?:https?|mailto):)(?!blocked:)([a-z][a-z0-9+.-]*):(?=//)"
    return F.regexp_replace(F.regexp_replace(text, named, "[blocked:$1]"), other, "[blocked:$1]")


FIELD_LIMITS = {"title": 200, "excerpt": 1000, "local": 512, "source_record_id": 256, "candidate_id": 256, "source_revision": 256, "content_fingerprint": 256}


def clean_field(text: Column, most: int) -> Column:
    return bounded(neutralize_links(strip_unsafe(text)), most)


def clean_metadata(metadata: Column, fields: int = 24, most: int = 200) -> Column:
    """The first ``fields`` keys in order, keys and values cleaned and bounded."""
    keys = F.slice(F.array_sort(F.map_keys(metadata)), 1, fields)
    return F.map_from_arrays(F.transform(keys, lambda k: bounded(strip_unsafe(k), most)), F.transform(keys, lambda k: clean_field(F.element_at(metadata, k), most)))


def normalized_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " "))


def matchable_name(text: Column) -> Column:
    """The normalised name where it has at least two words, else null."""
    name = normalized_name(text)
    return F.when(name.contains(" "), name)


CREDENTIAL = r"(?i)\b(password|passwd|secret|api[ _-]?key|access[ _-]?token|private[ _-]?key|verification code|one[- ]time (?:code|password)|2fa|mfa|otp)\b"
URL = r"(?i)\b(?:www\.|https?://)\S+"


def sensitivity_of(text: Column, plain: int = 1) -> Column:
    """3 (restricted) for texts that speak of credentials."""
    return F.when(text.rlike(CREDENTIAL), F.lit(3)).otherwise(F.lit(plain))


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, "")


def contains_url(text: Column) -> Column:
    return text.rlike(URL)


def quoted_runs(text: Column) -> Column:
    """What stands in straight, curly or back quotes, paragraph by paragraph, each run followed by a space."""
    runs = F.flatten(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_extract_all(p, F.lit("\"([^\"]*)\"|`([^`]*)`|“([^”]*)”"), F.lit(0))))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, F.lit(2), F.length(r) - 2), F.lit(" "))), "")


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def clip_bytes(text: Column, budget: int, marker: str = "…") -> Column:
    """The longest prefix of whole characters within ``budget`` bytes, with a marker where something was cut."""
    room = budget - len(marker.encode())
    head = F.substring(F.encode(text, "UTF-8"), 1, room)
    whole = F.decode(F.unhex(F.regexp_replace(F.hex(head), "(?:[C-F][0-9A-F](?:[89AB][0-9A-F]){0,2})$", F.lit(""))), "UTF-8")
    sound = F.when(F.is_valid_utf8(head.cast("string")), F.decode(head, "UTF-8")).otherwise(whole)
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.concat(sound, F.lit(marker)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_paragraph(text: Column) -> Column:
    return stripped(F.split(stripped(text), "\n\n")[0])


def truncated_at_word(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space where there is one, with an ellipsis."""
    head = F.substring(text, 1, most - 1)
    at_word = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(at_word == "", head).otherwise(at_word), F.lit("…")))


def headline(text: Column, most: int = 120) -> Column:
    return truncated_at_word(stripped(F.split(stripped(text), "\n")[0]), most)


def searchable(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def number_variants(term: Column) -> Column:
    """Singular and plural spellings of a word of at least three characters, without the word itself."""
    sibilant = lambda w: w.rlike("(?:s|x|z|ch|sh)$")
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    plural = (
        F.when(sibilant(term), F.concat(term, F.lit("es")))
        .when(term.endswith("y") & ~term.rlike("[aeiou]y$"), F.concat(cut(1), F.lit("ies")))
        .otherwise(F.concat(term, F.lit("s")))
    )
    none = F.array().cast("array<string>")
    singular = (
        F.when(term.endswith("ies") & (F.length(term) >= 6), F.array(F.concat(cut(3), F.lit("y")), cut(1)))
        .when(term.endswith("es") & sibilant(cut(2)), F.array(cut(2), cut(1)))
        .when(term.endswith("s") & ~term.rlike("(?:ss|is|us)$") & ~term.isin("lens", "news"), F.array(cut(1)))
        .otherwise(none)
    )
    forms = F.array_distinct(F.concat(F.array(plural), singular))
    return F.when(F.length(term) >= 3, F.filter(forms, lambda v: (F.length(v) >= 3) & (v != term))).otherwise(none)


def relevance(covered: Column, retained: Column, hits: Column, length: Column) -> Column:
    """Share of the query's terms covered, damped where they are a small part of the text."""
    density = hits / length
    damped = F.least(F.lit(1.0), covered / retained) * density / (density + F.lit(0.02))
    return F.when((retained <= 0) | (length <= 0), F.lit(1.0)).when((covered <= 0) | (hits <= 0), F.lit(0.0)).otherwise(damped)
