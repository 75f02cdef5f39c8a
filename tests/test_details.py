"""Edges of what is shown, split and written; tests/test_queries.py holds the operators against SQL."""

import json

import pytest
from pyspark.sql import functions as F

from turnwise.operators import transcripts as tr

SEGMENTS = "conversation_id long, segment_index long, start_ms long, end_ms long, speaker string, text string"


def test_exact_split(spark):
    ids = spark.createDataFrame([(f"u{i}",) for i in range(5)] * 2 + [(None,)], "uri string")
    for share, held in ((0.0, 1), (0.5, 2), (0.3, 2), (0.7, 4)):  # half of five rounds to even
        rows = tr.exact_split(ids, "uri", 3, share).collect()
        assert len(rows) == 5 and sum(r.split == "development" for r in rows) == held
    assert sorted(map(tuple, tr.exact_split(ids, "uri", 3, 0.4).collect())) == sorted(map(tuple, tr.exact_split(ids.repartition(7), "uri", 3, 0.4).collect()))
    for few, share in ((ids.limit(1), 0.5), (ids.where("false"), 0.5), (ids, 1.0)):
        with pytest.raises(ValueError, match="cannot be split"):
            tr.exact_split(few, "uri", 3, share)


def test_files_of_a_protocol_and_of_a_report(spark, tmp_path):
    lines = spark.createDataFrame([("train", "lst", "b", 0.0, "b"), ("train", "lst", "a", 0.0, "a"), ("train", "rttm", "a", 10.5, "late"), ("train", "rttm", "a", 9.5, "early"), ("development", "uem", "c", 0.0, "c 1 0.000 2.000")], "split string, kind string, uri string, at double, value string")
    tr.write_protocol(lines, f"file://{tmp_path}/p")
    read = lambda where: "".join(f.read_text() for f in sorted((tmp_path / "p").glob(f"{where}/*.txt")))
    assert read("split=train/kind=lst") == "a\nb\n" and read("split=train/kind=rttm") == "early\nlate\n" and read("split=development/kind=uem") == "c 1 0.000 2.000\n"
    scores = spark.createDataFrame([("r1", 1, 10, 0.1), ("r2", 3, 10, 0.3)], "recording string, errors long, total long, wer double")
    assert tr.write_report(scores, f"file://{tmp_path}/r", "wer", 0.2) and not tr.write_report(scores, f"file://{tmp_path}/r", "wer", 0.19)
    summary = [json.loads(x) for f in (tmp_path / "r" / "summary").glob("*.json") for x in f.read_text().splitlines()]
    assert summary == [{"recordings": 2, "overall": 0.2, "mean": 0.2, "passes": False}]
    assert sorted(x for f in (tmp_path / "r/markdown/rows").glob("*.txt") for x in f.read_text().splitlines()) == ["| r1 | 1 | 10 | 0.1000 |", "| r2 | 3 | 10 | 0.3000 |"]


def test_turns_of_odd_lines(spark):
    rows = [(1, 0, 0, 1000, None, "gelir misin?"), (1, 1, 1400, 2000, "", "x"), (1, 2, 2401, 3000, None, None), (1, 3, 3360, 4000, "KEEP", "Evet"), (1, 4, 4350, 5000, None, "evet"), (1, 5, 6501, 7000, None, "")]
    got = [(r.turn_group, r.speaker) for r in tr.text_turns(spark.createDataFrame(rows, SEGMENTS), ["misin"], ["evet"]).orderBy("segment_index").collect()]
    assert got == [(0, "SPEAKER_00"), (0, "SPEAKER_00"), (0, "SPEAKER_00"), (1, "KEEP"), (1, "SPEAKER_01"), (2, "SPEAKER_00")]


def test_paragraphs_of_odd_texts(spark):
    rows = [(1, None), (2, " \n "), (3, "one two"), (4, " ".join(f"w{i}" for i in range(141))), (5, "A. B! C? D. E."), (6, "no end. ")]
    got = sorted((r.doc_id, r.paragraph, r.text) for r in tr.paragraphs(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id").collect())
    assert [g[:2] for g in got] == [(3, 0), (4, 0), (4, 1), (4, 2), (5, 0), (5, 1), (6, 0)]
    assert got[3][2] == "w140" and got[4][2] == "A. B! C? D." and got[6][2] == "no end."


def test_regions_supervisors_names(spark):
    calls = spark.createDataFrame([(1, 5000, 0.5), (2, 5000, 0.0059), (3, 5000, 0.006), (4, 9000, 0.0)], "conversation_id long, length_ms long, rms double")
    spans = spark.createDataFrame([(1, 100, 4900), (4, 0, 1000), (4, 4600, 5000), (4, 8601, 8700)], "conversation_id long, start_ms long, end_ms long")
    assert sorted(map(tuple, tr.speech_regions(calls, spans).collect())) == [(1, 1, 0, 5000), (3, 1, 0, 5000), (4, 1, 0, 5300), (4, 2, 8301, 9000)]
    rows = [(1, 0, 0, 1, "SPEAKER_01", "a"), (1, 1, 0, 1, "SPEAKER_00", "b"), (1, 2, 0, 1, "z", "c"), (1, 3, 0, 1, "boss", "c"), (2, 0, 0, 1, None, "c"), (2, 1, 0, 1, "x", "c")]
    assert {r.conversation_id: (r.speakers, r.supervisor) for r in tr.supervisors(spark.createDataFrame(rows, SEGMENTS), "SPEAKER_00", "SPEAKER_01").collect()} == {1: (4, "boss"), 2: (1, None)}
    names = spark.createDataFrame([("SPEAKER_02",), ("MENU_IVR",), (None,), ("",), ("Ada",)], "s string").select(tr.shown_name(F.col("s")).alias("n")).collect()
    assert [r.n for r in names] == ["Uzman", "IVR", "Konuşmacı", "Konuşmacı", "Ada"]


def test_corrections_leave_a_log(spark):
    lines = spark.createDataFrame([(1, 0, 0, 1, "a", "x"), (1, 1, 0, 1, "b", "y")], SEGMENTS)
    words = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "c"), (1, 1, 0, "a")], "conversation_id long, segment_index long, word long, speaker string")
    fixes = spark.createDataFrame([(1, 0, "b", 5, "eve", "r1"), (1, 0, "d", 9, "eve", "r2"), (7, 0, "d", 9, "eve", "lost")], "conversation_id long, segment_index long, new_speaker string, corrected_at long, corrected_by string, reason string")
    fixed, spoken, log = tr.correct_speakers(lines, words, fixes)
    assert sorted((r.segment_index, r.speaker) for r in fixed.collect()) == [(0, "d"), (1, "b")]
    assert sorted((r.segment_index, r.word, r.speaker) for r in spoken.collect()) == [(0, 0, "d"), (0, 1, "c"), (1, 0, "a")]
    assert sorted((r.n, r.old_speaker, r.new_speaker, r.reason) for r in log.collect()) == [(1, "a", "b", "r1"), (2, "b", "d", "r2")]
