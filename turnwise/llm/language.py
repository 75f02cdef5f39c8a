"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import mix, slices, text_bytes

BUCKETS = 1 << 15
#: First and last code point of each script told apart; letters elsewhere count as script 0.
SCRIPTS = [(0x41, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x530, 0x58F), (0x590, 0x5FF), (0x600, 0x77F), (0x900, 0x97F), (0xE00, 0xE7F), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


@lru_cache(1)
def categories() -> np.ndarray:
    """1 for each code point that is a letter, 2 for marks, which go on a word, 0 for others; by Unicode category."""
    return np.array([{"L": 1, "M": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, bytes) of the UTF-8 characters that start at these places."""
    b = [data[np.minimum(at + k, max(0, len(data) - 1))].astype(np.int64) for k in range(4)]
    size = 1 + (b[0] >= 0xC0).astype(np.int64) + (b[0] >= 0xE0) + (b[0] >= 0xF0)
    two, three = ((b[0] & 31) << 6) | (b[1] & 63), ((b[0] & 15) << 12) | ((b[1] & 63) << 6) | (b[2] & 63)
    four = ((b[0] & 7) << 18) | ((b[1] & 63) << 12) | ((b[2] & 63) << 6) | (b[3] & 63)
    return np.minimum(np.choose(size - 1, [b[0], two, three, four]), 0x10FFFF), size


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters, and to the marks that follow a letter."""
    kind = (((data | 32) >= 97) & ((data | 32) <= 122)).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    code, size = code_points(data, lead)
    own = categories()[code]
    for k in range(4):
        kind[lead[size > k] + k] = own[size > k]
    if not (own == 2).any():
        return kind == 1
    # marks before the first letter of a run belong to none
    any_ = kind > 0
    begins = np.flatnonzero(any_ & np.append(True, ~any_[:-1]))
    seen = np.cumsum(kind == 1)
    run = np.searchsorted(begins, np.arange(len(data)), "right") - 1
    return any_ & (seen > np.append(0, seen)[begins[np.maximum(run, 0)]])


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document, lookups): runs of letters, and the hashed trigram at each byte, over word edges."""
    inside = letters(data)
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64), z
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | cut[:n]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | cut[1:])) + 1
    shown = np.where(inside, data, 32).astype(np.uint64)
    wide = np.concatenate([[np.uint64(32)], shown, [np.uint64(32)]])
    before, after = wide[:-2].copy(), wide[2:].copy()
    before[offsets[:-1][offsets[:-1] < n]] = 32
    after[offsets[1:][offsets[1:] > 0] - 1] = 32
    grams = (mix((before << np.uint64(16)) | (shown << np.uint64(8)) | after) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return starts, ends, np.searchsorted(starts, offsets), grams


def word_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The script of the first letter of each word."""
    code, _ = code_points(data, starts)
    out = np.zeros(len(starts), np.int64)
    for k, (lo, hi) in enumerate(SCRIPTS):
        out[(code >= lo) & (code <= hi)] = k + 1
    return out


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))


class Model:
    """Log-probabilities of trigram buckets for each language, and the scripts it is written in."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.logp = np.log((grams + 0.3) / (grams.sum(1, keepdims=True) + 0.3 * BUCKETS)).T.astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
        allowed = (share >= 0.01).T
        allowed[~allowed.any(1)] = True
        self.bar = np.where(allowed, 0, -1e6).astype(np.float32)

    def word_scores(self, data, starts, ends, grams) -> np.ndarray:
        sums = np.zeros((len(starts), len(self.langs)), np.float32)
        if len(starts):
            # letters of one word lie side by side, so each even cut is a word
            edges = np.stack([starts, ends], 1).reshape(-1)
            edges = edges[:-1] if edges[-1] == len(grams) else edges
            for k in range(len(self.langs)):
                sums[:, k] = np.add.reduceat(self.logp[grams, k], edges)[::2]
        return sums + self.bar[word_scripts(data, starts)]


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, a change costing `switch`; documents advance side by side."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    states = np.arange(scores.shape[1])
    back = np.zeros(scores.shape, np.int16)
    value = np.zeros((len(order), len(states)), np.float64)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    for t in range(longest):
        a = active[t]
        v = value[:a]
        top = v.argmax(1)
        change = v[np.arange(a), top][:, None] - switch
        stay = v >= change
        back[begin[:a] + t] = np.where(stay, states, top[:, None])
        value[:a] = np.where(stay, v, change) + scores[begin[:a] + t]
    labels = np.zeros(len(scores), np.int64)
    state = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        labels[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return labels


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int) -> Model | None:
    """Trigram and script counts of a sample, about `sample_docs` labelled documents chosen by a hash of the id."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(F.col(id_col)), F.lit(True)))
    tally = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(tally)
    if not langs:
        return None
    # each language keeps about the same number of documents
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample_docs / len(langs) / tally[lang]))])
    chosen = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000)
    index = {lang: k for k, lang in enumerate(langs)}

    def count(batches):
        grams, scripts = np.zeros((len(langs), BUCKETS), np.int64), np.zeros((len(langs), len(SCRIPTS) + 1), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = lowered(part.column("text"))
                starts, ends, first, at = letter_words(data, offsets)
                of_doc = np.array([index[x] for x in part.column("lang").to_pylist()])
                inside = letters(data)
                of_byte = np.repeat(of_doc, np.diff(offsets))
                of_word = np.repeat(of_doc, np.diff(first))
                kind = word_scripts(data, starts)
                grams += np.bincount(of_byte[inside] * BUCKETS + at[inside], minlength=grams.size).reshape(grams.shape)
                scripts += np.bincount(of_word * scripts.shape[1] + kind, minlength=scripts.size).reshape(scripts.shape)
        both = np.concatenate([grams, scripts], 1)
        k, b = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(both[k, b])], ["k", "b", "n"])

    counted = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((len(langs), BUCKETS + len(SCRIPTS) + 1), np.int64)
    both[counted["k"].to_numpy(), counted["b"].to_numpy()] = counted["n"].to_numpy()
    return Model(langs, both[:, :BUCKETS], both[:, BUCKETS:])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 20_000, switch: float = 12.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans) for each document.

    Learns from at most about `sample_docs` documents that have a language and are not held out (crc32 of the id as text, modulo
    4, is not 2; rows with a null id are never learned from, and not held out). spans lists the runs of words of one language as (first word, word after the last, lang); words are runs of
    letters (Unicode category L) and the marks after them. lang_pred is the language of most letters, ties going to the first by name, and score their share times how far it
    leads the second language per word. `und` with score 0 where the text is null or has no letter, or nothing could be learned.
    The model takes 128 KB for each language learned. Texts of one id are judged each on its own. Other columns are ignored.
    """
    model = learn(docs, id_col, text_col, lang_col, sample_docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages times 32768 floats

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                data, offsets = lowered(part.column("text"))
                starts, ends, first, grams = letter_words(data, offsets)
                n, pred, score, spans = part.num_rows, [], [], []
                if model is None:
                    pred, score, spans = ["und"] * n, [0.0] * n, [[]] * n
                else:
                    scores = model.word_scores(data, starts, ends, grams)
                    labels = viterbi(scores, first, switch)
                    k = len(model.langs)
                    of_word = np.repeat(np.arange(n), np.diff(first))
                    size = np.bincount(of_word * k + labels, ends - starts, n * k).reshape(n, k)
                    totals = np.stack([np.bincount(of_word, scores[:, j], n) for j in range(k)], 1)
                    best = size.argmax(1)
                    lead = totals[np.arange(n), best] - np.where(np.arange(k) == best[:, None], -np.inf, totals).max(1) if k > 1 else np.full(n, 10.0)
                    words = np.diff(first)
                    sure = size.max(1) / np.maximum(1, size.sum(1)) / (1 + np.exp(-np.clip(lead, -30, 30)))
                    pred = [model.langs[b] if w else "und" for b, w in zip(best.tolist(), words.tolist(), strict=True)]
                    score = np.where(words > 0, sure, 0.0).tolist()
                    turn = np.ones(len(labels), bool)
                    turn[1:] = labels[1:] != labels[:-1]
                    turn[first[:-1][words > 0]] = True
                    cuts = np.flatnonzero(turn)
                    stops = np.append(cuts[1:], len(labels))[: len(cuts)]
                    spans = [[] for _ in range(n)]
                    for s, e in zip(cuts.tolist(), stops.tolist(), strict=True):
                        d = int(of_word[s])
                        spans[d].append({"begin": s - int(first[d]), "end": e - int(first[d]), "lang": model.langs[labels[s]]})
                kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<begin: int, end: int, lang: string>>")
