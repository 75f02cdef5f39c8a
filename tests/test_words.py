"""Words in turns and echoes of prompts, against plain loops."""

import random
import re

from turnwise.operators import calls as ca
from turnwise.operators import segments as seg


def test_words_in_turns(spark):
    draw = random.Random(4)
    turns, words = [], []
    for c in range(25):
        turns += [(c, i, a, a + draw.choice([0, 50, 900, 4000, 70_000]), draw.choice("abc")) for i, a in enumerate(sorted(draw.randrange(0, 60_000, 50) for _ in range(draw.randrange(0, 14))))]
        words += [(c, k // 5, k, draw.choice("abc"), a, a + draw.choice([0, 1, 50, 333, 2500])) for k, a in enumerate(draw.randrange(0, 60_000, 50) for _ in range(40))]

    def plain(c, s, k, own, a, b):
        mine = [t for t in turns if t[0] == c and t[3] > t[2]]
        active = [t[4] for t in mine if t[2] <= (a + b) / 2 < t[3]]
        who = active[0] if active else own
        return c, s, k, active[0] if active else None, len(active) > 1 or any(min(b, t[3]) - max(a, t[2]) > 0 for t in mine if t[4] != who)

    got = seg.words_in_turns(spark.createDataFrame(words, "conversation_id long, segment_index long, word long, speaker string, w_start long, w_end long"), spark.createDataFrame(turns, "conversation_id long, turn_index long, t_start long, t_end long, turn_speaker string"), 5000)
    rows = [(r.conversation_id, r.segment_index, r.word, r.turn_speaker, r.crosstalk) for r in got.collect()]
    assert sorted(rows, key=str) == sorted((plain(*w) for w in words), key=str)
    # a word that only touches another speaker's turn is cross-talk
    one = seg.words_in_turns(spark.createDataFrame([(1, 0, 0, "a", 100, 500), (1, 0, 1, "a", 500, 900)], "conversation_id long, segment_index long, word long, speaker string, w_start long, w_end long"), spark.createDataFrame([(1, 0, 0, 480, "a"), (1, 1, 480, 500, "b")], "conversation_id long, turn_index long, t_start long, t_end long, turn_speaker string"))
    assert {r.word: (r.turn_speaker, r.crosstalk) for r in one.collect()} == {0: ("a", True), 1: (None, False)}


def test_prompt_overlap(spark):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    prompts = [(i, " ".join(draw.choices(words, k=draw.randrange(0, 25)))) for i in range(30)]
    docs = [(i, " ".join(draw.choice(prompts)[1].split()[: draw.randrange(3, 12)] + draw.choices([*words, "x", "y", "z", "stop"], k=draw.randrange(0, 9)))) for i in range(300)]
    docs += [(900, None), (901, ""), docs[0], (902, "x y z x y"), (903, "w1 w1 w1 w1 w1")]
    stop = {"stop", "w3"}
    tokens = lambda t: [w for w in re.findall(r"\w+", t.lower()) if w not in stop]
    want = set()
    for i, text in docs:
        mine = tokens(text or "")
        for p, prompt in prompts:
            have = set(tokens(prompt))
            matched = sum(w in have for w in mine)
            if len(mine) >= 5 and matched >= 5 and matched / len(mine) >= 0.6:
                want.add((i, p, len(mine), matched))
    got = [tuple(r) for r in ca.prompt_overlap(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(prompts, "prompt_id long, text string"), sorted(stop)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    runs = {i for i, t in docs if t and any(" ".join(tokens(t)[k : k + 5]) in " ".join(tokens(p)) for _, p in prompts for k in range(len(tokens(t)) - 4))}
    both = {r.doc_id for r in ca.echoes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(prompts, "prompt_id long, text string"), sorted(stop)).collect()}
    assert {i for i, *_ in want} <= both and both <= {i for i, *_ in want} | runs
