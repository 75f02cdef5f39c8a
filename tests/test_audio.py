"""Turns from energies and likeness of phrases against plain loops."""

import random
from difflib import SequenceMatcher

from turnwise.operators import audio
from turnwise.operators import keywords as kw

def test_turns_from_energy(spark):
    draw, rows, want = random.Random(1), [], []
    for c in range(20):
        now, since, waiting, n = 0, 0, 0, 0
        for f in range(60):
            pair = [draw.choice([0.0, 2e-6, 0.01, 0.0125, 0.02, 0.5]) for _ in range(2)]
            rows += [(c, k, f, pair[k]) for k in (0, 1)]
            w = 0 if pair[0] > pair[1] * 1.3 and pair[0] > 1e-5 else 1 if pair[1] > pair[0] * 1.3 and pair[1] > 1e-5 else now
            n = n + 1 if w == waiting else 1
            waiting = w
            if waiting != now and n >= 2:
                if f * 250 > since:
                    want.append((c, since, f * 250, now))
                since, now = f * 250, waiting
        want.append((c, since, 60 * 250, now))
    df = spark.createDataFrame(rows, "recording_id int, channel int, frame long, energy double")
    assert sorted(map(tuple, audio.turns_from_energy(df).collect())) == sorted(want)


def test_phrases_are_found_by_likeness(spark):
    draw = random.Random(2)
    words = "please cancle cancel my contract contrakt subscription now thank you very much indeed".split()
    texts = [" ".join(draw.choice(words) for _ in range(draw.randrange(1, 12))) for _ in range(80)] + ["", None, "cancel"]
    phrases = ["cancel my contract", "thank you", "subscription"]
    rows = [(1, k, t) for k, t in enumerate(texts)]
    got = {(r.segment_index, r.phrase) for r in kw.fuzzy_phrases(spark.createDataFrame(rows, "conversation_id long, segment_index long, text string"), phrases).collect()}
    want = set()
    for k, t in enumerate(texts):
        for p in phrases:
            w, n = (t or "").split(), len(p.split())
            runs = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [t or ""]
            if t is not None and (p in t or any(SequenceMatcher(None, r, p).ratio() > 0.85 for r in runs)):
                want.add((k, p))
    assert got == want and len(want) > 20
