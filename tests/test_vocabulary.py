import random
import re
from difflib import SequenceMatcher

import pytest

from turnwise.operators.vocabulary import WORD, domain_correct, likely_terms
from turnwise.plans import workflows

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def plain(text, terms, canonical=None):
    """One text, all pairs of a word and a term."""
    own = [t for t, _, custom in terms if custom and " " not in t.strip()]

    def best(word, listed, least):
        found = max(listed, key=lambda t: ratio(word, t), default=None)  # the first of those as like
        return found if found is not None and ratio(word, found) >= least else None

    def put(m):
        word, low = m.group(0), m.group(0).lower()
        to = (canonical or {}).get(low)
        if to is None and len(low) >= 4:
            to = best(low, own, 0.80)
        if to is None and len(low) >= 7:
            to = best(low, [t for t, _, _ in terms], 0.93)
        return word if to is None else (to[:1].upper() + to[1:] if word[0].isupper() else to)

    return re.sub(WORD, put, text)


def spoiled(word, rng):
    w = list(word)
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(w) + 1)
        kind = rng.random()
        if kind < 0.35:
            w.insert(at, rng.choice("abcdeğşiı"))
        elif kind < 0.7 and len(w) > 1:
            w.pop(at % len(w))
        elif w:
            w[at % len(w)] = rng.choice("abcdeğşiı")
    return "".join(w)


TERMS = [(t, i, i % 3 == 0) for i, t in enumerate("Vodafone taahhüt fatura faturalama sigorta poliçe eksper teminat mevduat kredi bankacılık telefon tarife teslimat kargo siparişler sipariş kampanya abonelik abonelikler modem internet müşteri temsilci yönlendirme yönlendirmek onaylama iade".split())] + [("kredi kartı", 90, False), ("son ödeme", 91, True)]


@pytest.mark.parametrize("least", [0.7, 0.8, 0.93])
def test_all_pairs_that_are_alike_enough(spark, least):
    rng = random.Random(7)
    words = sorted({spoiled(rng.choice(TERMS)[0], rng) for _ in range(400)} - {""})
    got = {(r.token, r.term) for r in likely_terms(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame(TERMS, "term string, place int, custom boolean"), least).collect()}
    assert got == {(w, t) for w in words for t, _, _ in TERMS if ratio(w, t) >= least} and len(got) > 50


def test_texts(spark):
    rng = random.Random(9)
    texts = [" ".join(w if rng.random() < 0.7 else w.capitalize() for w in (spoiled(rng.choice(TERMS)[0], rng) for _ in range(12))) + rng.choice(["", "!", " ...", "'e 12-3"]) for _ in range(60)]
    texts += ["", "  ", "123", "Kmh hesabı, KMH!", texts[0]]
    canonical = {"kmh": "kredili mevduat", "fatura": "hesap"}
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (900, texts[1], "x")], "doc_id int, text string, token string")
    got = domain_correct(rows, spark.createDataFrame(TERMS, "term string, place int, custom boolean"), spark.createDataFrame(list(canonical.items()), "token string, term string"))
    assert got.columns == rows.columns
    want = [(i, plain(t, TERMS, canonical)) for i, t in enumerate(texts)] + [(900, None), (900, plain(texts[1], TERMS, canonical))]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert sum(a != b for a, (_, b) in zip(texts, want, strict=False)) > 40
    assert domain_correct(rows.limit(0), spark.createDataFrame(TERMS, "term string, place int, custom boolean")).count() == 0
    assert sorted(r.text or "" for r in domain_correct(rows, spark.createDataFrame([], "term string, place int, custom boolean")).collect()) == sorted(r.text or "" for r in rows.collect())


def test_query(spark):
    """Every text of the table; the vocabulary and what is expected are worked out from the same tables by loops."""
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    close = sorted({w for t in benchmark for w in re.findall(WORD, t.lower()) if len(w) >= 7})
    custom = sorted({r.n_name.lower() for r in spark.read.parquet(f"{SF}/nation.parquet").collect()})
    place = {t: i for i, t in enumerate(custom + [t for t in close if t not in custom])}
    terms = [(t, i, t in custom) for t, i in place.items()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_changed, r.text) for r in workflows.domain_snap(spark, SF).collect()}
    assert got.keys() == docs.keys()
    known = {}
    for i in sorted(docs)[:25]:
        def put(m):
            w = m.group(0)
            if w not in known:
                known[w] = plain(w, terms)
            return known[w]

        assert got[i][2] == re.sub(WORD, put, docs[i] or "")
    assert sum(n for _, n, _ in got.values()) > 0
