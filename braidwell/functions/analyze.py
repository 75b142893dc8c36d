"""Analysis of single queries on the driver: a query is a line of text, however large the corpus."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from braidwell.functions.text import FUNCTION_WORDS, MAX_TOKEN, TASK_STOP_WORDS
from braidwell.schema import CLASS_IDENTIFIER, CLASS_NATURAL


def _alnum(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind == "Nd"


def query_tokens(query: str) -> list[tuple[str, bool]]:
    """(token, stands in double quotes) of a query."""
    out, run, quoted = [], "", False
    for c in query + " ":
        if _alnum(c):
            run += c.lower()
            continue
        if run and len(run) <= MAX_TOKEN:
            out.append((run, quoted))
        run = ""
        if c == '"':
            quoted = not quoted
    return out


@dataclass
class Analysis:
    raw: list[str] = field(default_factory=list)
    terms: list[str] = field(default_factory=list)
    removed: int = 0

    @property
    def normalized(self) -> bool:
        return self.removed > 0


def analyze(query: str) -> Analysis:
    """Content terms: without unquoted function words, unless nothing would be left."""
    found = query_tokens(query)
    raw = [t for t, _ in found]
    terms = [t for t, quoted in found if quoted or t not in FUNCTION_WORDS]
    if not terms:
        return Analysis(raw, list(raw), 0)
    return Analysis(raw, terms, len(raw) - len(terms))


def _stable(token: str) -> bool:
    if re.search(r"[/\\:@#.]", token):
        return True
    parts = token.split("_")
    if len(parts) > 1 and all(p and all(_alnum(c) or c == "-" for c in p) for p in parts):
        return True
    letters = sum(unicodedata.category(c)[0] == "L" for c in token)
    digits = sum(unicodedata.category(c) == "Nd" for c in token)
    return ("-" in token and letters > 0 and digits > 0) or (len(token) >= 8 and letters >= 2 and digits >= 2)


def stable_identifiers(query: str) -> list[str]:
    """Paths, addresses, ticket numbers and the like, in small letters."""
    found = (w.strip("\"'()[]{}<>,;!?:").rstrip(".") for w in query.split())
    return [w.lower() for w in found if w and _stable(w)]


def classify(query: str) -> str:
    """'' for a query without words, else identifier or natural language."""
    n = len(re.findall(r"[^\W_]+", query))
    if n == 0:
        return ""
    return CLASS_IDENTIFIER if n == 1 or stable_identifiers(query) else CLASS_NATURAL


def task_terms(query: str, least: int = 2, most: int = 128, count: int = 12) -> list[str]:
    words = (w for w in re.split("[^a-z0-9]+", query.lower()) if least <= len(w) <= most and w not in TASK_STOP_WORDS)
    return list(dict.fromkeys(words))[:count]


def probe_terms(terms: list[str], most: int = 4, phrase_bytes: int = 60, phrase: bool = False) -> list[str]:
    """What to ask a store for: the longest terms, after the whole phrase where it is short enough."""
    longest = sorted(terms, key=len, reverse=True)[: max(most, 0)]
    whole = " ".join(terms)
    return [whole, *longest][: max(most, 0)] if phrase and len(terms) >= 2 and len(whole.encode()) <= phrase_bytes else longest


def identifier_tokens(query: str, pattern: str) -> list[str]:
    """Words of a query that are record ids, e.g. ``[0-9a-f]{8}`` or ``xy-[0-9a-f]{6}``."""
    words = (w.strip("\"'`<>{}[]()!?:;,.") for w in query.split())
    return list(dict.fromkeys(w for w in words if re.fullmatch(pattern, w)))


def shell_pieces(query: str) -> list[str]:
    """Pieces of a mail query: split at spaces outside double quotes; a backslash takes the next character as it is."""
    out, piece, quoted, some, i = [], "", False, False, 0
    while i < len(query):
        c = query[i]
        if c == "\\" and i + 1 < len(query):
            piece, some, i = piece + query[i + 1], True, i + 1
        elif c == '"':
            quoted, some = not quoted, True
        elif c.isspace() and not quoted:
            if some:
                out.append(piece)
            piece, some = "", False
        else:
            piece, some = piece + c, True
        i += 1
    return [*out, piece] if some else out


OPERATORS = ("after", "before", "bcc", "category", "cc", "filename", "from", "has", "in", "is", "label", "larger", "list", "newer", "newer_than", "older", "older_than", "rfc822msgid", "size", "smaller", "subject", "to")


def has_operator(query: str) -> bool:
    return any(p.lstrip("-").partition(":")[0].lower() in OPERATORS and ":" in p for p in shell_pieces(query))


def mail_terms(query: str) -> list[str]:
    """Words a thread should hold: operands of from, to and subject and free words; negated pieces don't count."""
    out = []
    for piece in shell_pieces(query):
        name, colon, rest = piece.partition(":")
        if piece.startswith("-"):
            continue
        if colon and name.lower() in OPERATORS:
            piece = rest if name.lower() in ("from", "to", "subject") else ""
        out += [t for t, _ in query_tokens(piece)]
    return list(dict.fromkeys(t for t in out if t not in FUNCTION_WORDS)) or list(dict.fromkeys(out))


def mail_query(text: str, since=None, until=None, exclude_labels=()) -> str:
    """The operator query for a mail store: the user's text, date bounds widened to whole days, excluded labels."""
    parts = [text.strip()] if text.strip() else []
    if since is not None:
        parts.append(f"after:{since:%Y/%m/%d}")
    if until is not None:
        from datetime import timedelta

        parts.append(f"before:{until + timedelta(days=1):%Y/%m/%d}")
    parts += [f"-label:{x}" for x in exclude_labels]
    return " ".join(parts)
