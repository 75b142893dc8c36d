"""Language spans of mixed-language text: script ranges, per-word scores, Viterbi with a switching penalty.

A word's script (by the range of its first letter; Kana where Han is followed by it) narrows its candidates before anything is scored: the trained
languages written in that script or, where none is, the one label of the script; a word in Han may also be Japanese. It
can't be in any other language, so one word of another script ends a span. Candidates are scored by hashed character
trigrams and whole words of a naive Bayes model, trained here on a bounded sample of labelled rows
(``TRAIN_ROWS``, chosen by a hash of doc_id over the whole table). Viterbi over the words of a text, with
``PENALTY`` per change of language, gives the spans. Texts are cut into blocks that are solved side by side
and joined by their max-plus transfer matrices, so a text of any length costs the same per word and the
result is that of one pass.

A document's label is the language of most of its words; of equally many, the first in the order of trained
languages by name, then scripts. It is rejected where no word has a letter, or where its language surely explains it worse
than random letters would: the log-probability of a trigram, averaged in each word and then over the n words, is below
log(1/26^3) by more than ``SURE`` / sqrt(n), so the fewer words, the clearer it has to be. A text whose label is that of a
script without a trained language can't be tested so and is kept.

Defined cases: a null, empty or wordless text has lang NULL, no spans and is rejected. Words without letters
take the language around them. Null labels aren't trained on; without any labelled row, scripts alone decide
and Latin text has lang 'und' and is kept. Rows with a null doc_id are labelled like others. Repeated rows
are labelled each. Texts of any length are labelled whole. Other columns, whatever their names, are carried by
``keep_identified`` and don't matter to ``identify``. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwell.llm.common import _WORD, Words, char_positions, folded, read_table, slices, text_buffers

TRAIN_ROWS = 20_000
PENALTY = 14.0
FLOOR = -3 * math.log(26)
SURE = 4.0  # twice the deviation of one word
CLIP = 9.0
NEVER = -1e6
BLOCK = 512
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "hangul", "kana", "han", "other")
_HAN, _KANA = SCRIPTS.index("han"), SCRIPTS.index("kana")
SCRIPT_LANGUAGE = {"latin": "und", "greek": "el", "cyrillic": "ru", "hebrew": "he", "arabic": "ar", "devanagari": "hi", "thai": "th", "hangul": "ko", "kana": "ja", "han": "zh", "other": "und"}
_U = np.uint64
_SPANS = "array<struct<start:int,stop:int,lang:string>>"


def _script_table() -> np.ndarray:
    """Script number by the first two bytes of a UTF-8 word; 255: no letter (a digit)."""
    t = np.full((256, 256), SCRIPTS.index("other"), np.uint8)
    t[48:58] = 255
    for lead, name in (((65, 91), "latin"), ((97, 123), "latin"), ((0xC2, 0xCA), "latin"), ((0xCD, 0xD0), "greek"), ((0xD0, 0xD5), "cyrillic"), ((0xD6, 0xD8), "hebrew"), ((0xD8, 0xDC), "arabic"), ((0xE4, 0xEA), "han"), ((0xEA, 0xEE), "hangul")):
        t[lead[0] : lead[1]] = SCRIPTS.index(name)
    for a, b0, b1, name in ((0xE0, 0xA4, 0xA6, "devanagari"), (0xE0, 0xB8, 0xBA, "thai"), (0xE1, 0xB8, 0xBC, "latin"), (0xE1, 0xBC, 0xC0, "greek"), (0xE3, 0x81, 0x84, "kana"), (0xE3, 0x90, 0xC0, "han"), (0xE1, 0x84, 0x88, "hangul"), (0xD6, 0x80, 0x90, "other")):
        t[a, b0:b1] = SCRIPTS.index(name)
    t[0xE2] = 255  # punctuation and symbols
    t[0xC2] = 255
    t[0xEF] = 255
    return t


_SCRIPT = _script_table()
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[~_WORD] = 32


class Features:
    """Words of a batch with their script and the hash slots of their trigrams and of the words themselves."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.words = Words(raw, offsets)
        low = _FOLD[folded(raw)]
        at = self.words.starts
        gram = low * np.uint32(65536)
        if len(raw):
            gram[1:] += low[:-1]
            gram[:-1] += low[1:] * np.uint32(256)
            gram[at] += np.uint32(32) - np.where(at > 0, low[at - 1], np.uint32(0))
            end = self.words.ends - 1
            inner = end < len(raw) - 1
            gram[end] += np.uint32(256) * (np.uint32(32) - np.where(inner, low[np.minimum(end + 1, len(raw) - 1)], np.uint32(0)))
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - 16)
        self.gram = np.where(_WORD[raw], slot.astype(np.int32) + 1, 0)  # 0: no feature
        self.word = ((self.words.hashes() >> _U(48)).astype(np.int32)) + 65537
        nxt = np.minimum(at + 1, max(len(raw) - 1, 0))
        self.script = _SCRIPT[raw[at], raw[nxt]] if len(at) else np.zeros(0, np.uint8)
        kana = (raw[:-1] == 0xE3) & (raw[1:] >= 0x81) & (raw[1:] <= 0x83)
        if kana.any():  # a run of letters that begins in Han may go on in Kana
            self.script[(self.script == _HAN) & np.logical_or.reduceat(np.append(kana, False), at)] = _KANA

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the trigrams of some words, and where each word's begin."""
        starts, length = self.words.starts[words], self.words.ends[words] - self.words.starts[words]
        begin = np.cumsum(length) - length
        return self.gram[np.arange(int(length.sum())) - np.repeat(begin, length) + np.repeat(starts, length)], begin


class Model:
    """languages with a script each, and log-probabilities by slot (slot 0 weighs nothing)."""

    def __init__(self, languages: list[str], scripts: list[int], weights: np.ndarray):
        self.languages, self.scripts, self.weights = languages, scripts, weights.astype(np.float32)


def _counts(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets, _ = text_buffers(part.column(1))
            f = Features(raw, offsets)
            langs = np.array(part.column(0).to_pylist(), dtype=object)
            size = 131074
            for lang in sorted(set(langs)):
                mine = langs == lang
                of_word = mine[f.words.doc]
                bytes_of = np.repeat(mine, np.diff(offsets))
                n = np.bincount(f.gram[bytes_of], minlength=size) + np.bincount(f.word[of_word], minlength=size)
                n[0] = 0
                scripts = np.bincount(f.script[of_word & (f.script < 255)], minlength=len(SCRIPTS))
                for base, values in ((0, n), (1 << 20, scripts)):
                    at = np.flatnonzero(values)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at + base).astype(np.int32)), pa.array(values[at].astype(np.int64))], names=["lang", "slot", "n"])


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows of the whole table. What reaches the driver is bounded by the slots."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    total = labelled.select("doc_id").count()
    share = min(1.0, rows / max(total, 1))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).select("lang", "text")
    found = sample.mapInArrow(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found.lang.unique())
    weights, scripts = np.zeros((len(languages), 131074)), []
    for i, lang in enumerate(languages):
        mine = found[found.lang == lang]
        scr = mine[mine.slot >= 1 << 20]
        scripts.append(int(scr.slot.iloc[scr.n.argmax()]) - (1 << 20) if len(scr) else 0)
        own = mine[mine.slot < 1 << 20]
        n = np.zeros(131074)
        n[own.slot.to_numpy()] = own.n.to_numpy()
        for a, b in ((1, 65537), (65537, 131074)):  # trigrams and words are two distributions
            part = n[a:b]
            weights[i, a:b] = np.log((part + 0.05) / (part.sum() + 0.05 * (b - a)))
    return Model(languages, scripts, weights)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, block: int = BLOCK) -> np.ndarray:
    """Best state of each word. scores: (words, states); first: n+1 word offsets of the texts."""
    n, k = scores.shape
    out = np.zeros(n, np.int8)
    if not n or k == 1:
        return out
    length = np.diff(first)
    per = -(-length // block)
    text = np.repeat(np.arange(len(length)), per)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[text] + rank * block
    size = np.minimum(block, first[text + 1] - begin)
    last = rank == per[text] - 1
    enter = np.zeros((len(text), k), np.float32)
    if (~last).any():
        inner = np.flatnonzero(~last)  # all of full length
        v = np.full((len(inner), k, k), -1e9, np.float32)
        v[:, np.arange(k), np.arange(k)] = 0
        for t in range(block):
            np.maximum(v, v.max(2, keepdims=True) - np.float32(penalty), out=v)
            v += scores[begin[inner] + t][:, None, :]
            if t % 64 == 63:  # only differences matter: keep float32 exact enough
                v -= v.max((1, 2), keepdims=True)
        for r in range(int(rank.max())):
            now = np.flatnonzero((rank[inner] == r))
            e = (enter[inner[now]][:, :, None] + v[now]).max(1)
            enter[inner[now] + 1] = e - e.max(1, keepdims=True)
    order = np.argsort(-size, kind="stable")
    begin, size, v = begin[order], size[order], enter[order]
    active = np.searchsorted(-size, -np.arange(int(size.max())), side="left")  # blocks longer than t
    back = np.empty((n, k), np.int8)
    for t, a in enumerate(active):
        best = v[:a].argmax(1)
        top = v[np.arange(a), best] - np.float32(penalty)
        stay = v[:a] >= top[:, None]
        at = begin[:a] + t
        back[at] = np.where(stay, np.arange(k), best[:, None])
        v[:a] = np.where(stay, v[:a], top[:, None]) + scores[at]
    # all exit states at once, then the one that the next block was entered from
    end = v.argmax(1)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.arange(len(order))
    path = np.empty((n, k), np.int8)
    state = np.tile(np.arange(k, dtype=np.int8), (len(order), 1))
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        path[at] = state[:a]
        state[:a] = np.take_along_axis(back[at], state[:a].astype(np.int64), 1)
    entry = state[inverse]  # state before the block, by exit state
    leave = end[inverse].astype(np.int64)
    for r in range(int(rank.max()), 0, -1):
        now = np.flatnonzero(rank == r)
        leave[now - 1] = entry[now, leave[now]]
    chosen = np.repeat(leave, np.minimum(block, first[text + 1] - (first[text] + rank * block)))
    return np.take_along_axis(path, chosen[:, None], 1)[:, 0]


class Labels:
    """What a batch of texts is written in: ``best`` (-1: no letter), ``score``, ``accepted``, and the spans' ends as characters."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, model: Model, penalty: float = PENALTY, spans: bool = True):
        f = Features(raw, offsets)
        w, n = f.words, len(offsets) - 1
        lettered = f.script < 255
        alone = [int(s) for s in np.unique(f.script[lettered]) if s not in model.scripts]
        self.names = model.languages + [SCRIPT_LANGUAGE[SCRIPTS[s]] for s in alone]
        self.trained, self.best = len(model.languages), np.full(n, -1)
        self.score, self.known, self.accepted = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
        self.cut, self.start, self.stop, self.state = np.zeros(n + 1, np.int32), *(np.zeros(0, np.int32) for _ in range(3))
        if not len(w) or not self.names:
            return
        scripts = np.array(model.scripts + alone)
        rel = np.full((len(w), len(scripts)), NEVER, np.float32)
        mean = np.zeros((len(w), self.trained), np.float32)  # of a word's trigrams
        rel[~lettered] = 0
        for s in np.unique(f.script[lettered]):
            words = np.flatnonzero(f.script == s)
            may = [i for i, t in enumerate(scripts) if t == s or (s == _HAN and t == _KANA)]
            gram, begin = f.grams_of(words)
            count = np.maximum(np.add.reduceat((gram > 0).astype(np.int64), begin), 1)
            scores = np.zeros((len(words), len(may)), np.float32)
            for j, i in enumerate(may):
                if i < self.trained:
                    part = np.add.reduceat(model.weights[i][gram], begin)
                    mean[words, i] = part / count
                    scores[:, j] = part + model.weights[i][f.word[words]]
            like = [j for j, i in enumerate(may) if i < self.trained]
            if like:
                scores[:, like] -= scores[:, like].max(1, keepdims=True)
            for j, i in enumerate(may):
                if i >= self.trained:  # a script's label beside trained languages, and Japanese beside Chinese
                    scores[:, j] = -CLIP if like else -float(scripts[i] != s)
            rel[words[:, None], may] = np.maximum(scores, -CLIP)
        state = viterbi(rel, w.first, penalty).astype(np.int64)
        count = np.zeros((n, len(self.names)))
        np.add.at(count, (w.doc[lettered], state[lettered]), 1)
        some = count.any(1)
        self.best[some] = count[some].argmax(1)
        own = np.flatnonzero(lettered & (state < self.trained))  # how well the path's language explains the trigrams
        total, many = np.bincount(w.doc[own], mean[own, state[own]], n), np.bincount(w.doc[own], minlength=n)
        self.score = total / np.maximum(many, 1)
        self.known = some & (self.best < self.trained)
        self.accepted = some & (~self.known | (many == 0) | (self.score >= FLOOR - SURE / np.sqrt(np.maximum(many, 1))))
        if not spans:
            return
        change = np.ones(len(w), bool)
        change[1:] = (state[1:] != state[:-1]) | (w.doc[1:] != w.doc[:-1])
        at = np.flatnonzero(change)
        at = at[some[w.doc[at]]]
        ends = np.append(np.flatnonzero(change)[1:], len(w)) - 1
        ends = ends[some[w.doc[np.flatnonzero(change)]]]
        chars = char_positions(raw)
        base = chars[offsets[:-1]][w.doc[at]]
        self.start, self.stop, self.state = (chars[w.starts[at]] - base).astype(np.int32), (chars[w.ends[ends]] - base).astype(np.int32), state[at]
        self.cut = np.searchsorted(w.doc[at], np.arange(n + 1)).astype(np.int32)

    def columns(self) -> list[pa.Array]:
        """lang, score, accepted and spans."""
        names = pa.array([*self.names, None], pa.string())
        spans = pa.StructArray.from_arrays([pa.array(self.start), pa.array(self.stop), names.take(pa.array(self.state.astype(np.int64)))], names=["start", "stop", "lang"])
        lang = names.take(pa.array(np.where(self.best < 0, len(self.names), self.best).astype(np.int64)))
        return [lang, pa.array(self.score, pa.float64(), mask=~self.known), pa.array(self.accepted), pa.ListArray.from_arrays(pa.array(self.cut), spans)]


def label(raw: np.ndarray, offsets: np.ndarray, model: Model, penalty: float = PENALTY):
    """For each text: (lang or None, score, accepted, spans as (start, stop, lang) in characters)."""
    lang, score, accepted, spans = (c.to_pylist() for c in Labels(raw, offsets, model, penalty).columns())
    return [(a, b, c, [(x["start"], x["stop"], x["lang"]) for x in d]) for a, b, c, d in zip(lang, score, accepted, spans)]


def identify(docs: DataFrame, rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> DataFrame:
    """doc_id, lang, score, accepted and spans of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows))  # bounded by the slots: about 2 MB

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets, _ = text_buffers(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *Labels(raw, offsets, model.value, penalty).columns()], names=["doc_id", "lang", "score", "accepted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, lang string, score double, accepted boolean, spans {_SPANS}")


def keep_identified(docs: DataFrame, rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> DataFrame:
    """``docs`` without the rejected rows. Rows stream through; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets, _ = text_buffers(part.column(place))
                yield part.filter(pa.array(Labels(raw, offsets, model.value, penalty, spans=False).accepted))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
