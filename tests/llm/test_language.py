import itertools

import numpy as np

from turnwise.llm.language import identify, letters, viterbi


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97


def test_edges_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    texts = {r.lang: r.text for r in docs.where("length(text) > 2000 and lang in ('de', 'fr')").collect()}
    more = [(100001, None, "en"), (100002, "", "de"), (100003, " 12 -- «» × 5 …", "en"), (None, "the of and", None), (100004, texts["de"] + " " + texts["fr"], None), (100005, "привет мир", None), (100001, None, "en")]
    both = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string")).selectExpr("*", "1 as spans", "2 as held_out")
    got = {r.doc_id: r for r in identify(both).where("doc_id is null or doc_id > 100000").collect()}
    assert [got[i].lang_pred for i in (100001, 100002, 100003)] == ["und"] * 3
    assert {s.lang for s in got[100004].spans} >= {"de", "fr"} and len(got[100004].spans) < 12
    assert got[100005].lang_pred != "und" and 0 <= got[100005].score <= 1
    assert identify(docs.limit(0)).count() == 0


def test_letters_are_those_of_unicode():
    none = ["、。", "❤\ufe0f", "٠١٢", "！？", "१२३", "\ufffd", "\ufeff", "\u0301", "²", "±", "😀", "١ - \u0301!", ""]
    some = {"ℂ": 3, "é": 2, "e\u0301x": 4, "\u0301e": 1, "हिन्दी": 18, "ß²": 2, "日、本": 6, "aªº": 5}
    for text in none:
        assert not letters(np.frombuffer(text.encode(), np.uint8)).any(), text
    for text, n in some.items():
        assert letters(np.frombuffer(text.encode(), np.uint8)).sum() == n, text


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(["、。", "❤\ufe0f", "٠١٢", "！？", "\u0301"])], "doc_id long, text string, lang string")
    got = identify(docs.unionByName(more)).where("doc_id >= 1000000").collect()
    assert len(got) == 5 and all(r.lang_pred == "und" and r.score == 0.0 for r in got)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 4, 6, 5]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(0, 3, (first[-1], 3))
    for switch in (0.0, 1.0, 2.5, 100.0):
        labels = viterbi(scores, first, switch)
        for b, e in zip(first, first[1:]):
            worth = lambda path: sum(scores[b + t, k] for t, k in enumerate(path)) - switch * sum(x != y for x, y in zip(path, path[1:]))  # noqa: E731, B023
            best = max((worth(p) for p in itertools.product(range(3), repeat=int(e - b))), default=0)
            assert abs(worth(labels[b:e].tolist()) - best) < 1e-9


def test_more_languages_than_a_byte_of_bits(spark):
    rng = np.random.default_rng(2)
    words = {k: ["".join(chr(97 + x) for x in rng.integers(0, 26, 7)) for _ in range(12)] for k in range(70)}
    rows = [(k * 100 + i, " ".join(rng.choice(words[k], 30)), f"l{k:02d}") for k in range(70) for i in range(12)]
    got = identify(spark.createDataFrame(rows + [(99999, rows[0][1] + " x" * 200_000, None)], "doc_id long, text string, lang string")).collect()
    told = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == 841 and sum(told[i] == lang for i, _, lang in rows) > 800


def test_null_ids_are_not_held_out(spark):
    rows = [(i, "the cat and the dog " * 3, "en") for i in range(8)] + [(None, "the dog", "en"), (None, None, None)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id is null").collect()
    assert [r.held_out for r in got] == [False, False] and sorted(r.lang_pred for r in got) == ["en", "und"]
