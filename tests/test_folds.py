"""Folds against plain loops, on drawn calls."""

import random
import re

import pytest

from turnwise.operators import folds
from turnwise.operators import segments as seg
from turnwise.streaming import sessions

SCHEMA = "conversation_id long, segment_index long, start_ms long, end_ms long, speaker string, n_words long, text string"
SAID = ["yes", "Yes.", "no", "well then", "we will see", "we will see about that", "will see", "right", "", "?!", "one two three four five"]


@pytest.fixture(scope="module")
def calls():
    draw, rows = random.Random(7), []
    for c in range(120):
        at = 0
        for k in range(draw.randrange(1, 30)):
            at += draw.choice([-2500, -1100, 0, 300, 700, 1500, 4000, 9000, 26000])
            at = max(0, at)
            text = draw.choice(SAID)
            size = draw.choice([400, 900, 2000, 6000, 20000, 45000])
            rows.append((c, k, at, at + size, draw.choice("ab"), len(text.split()), text))
            at += size
    return rows


def by_call(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in ("conversation_id", "segment_index", *columns)) for r in df.collect())


def test_dedup_loops(spark, calls):
    want = []
    for c, rows in by_call(calls).items():
        kept = []
        for _, k, s, e, spk, n, t in rows:
            t = t.strip().lower()
            mine = [x for x in kept if x[3] == spk][-4:]
            same = any(x[4] == t and s - x[2] < 25_000 for x in mine)
            held = any(n <= 4 and s - x[2] < 15_000 and (t in x[4] or x[4] in t) for x in mine)
            if not (same or held):
                kept.append((k, s, e, spk, t))
        want += [(c, x[0]) for x in kept]
    assert pairs(seg.dedup_loops(spark.createDataFrame(calls, SCHEMA))) == sorted(want)


def test_smooth_speakers(spark, calls):
    want = []
    for c, rows in by_call(calls).items():
        speakers = [r[4] for r in rows]
        for i in range(1, len(rows) - 1):
            if rows[i][5] <= 3 and speakers[i - 1] == speakers[i + 1] != speakers[i] and rows[i][2] - rows[i - 1][3] < 1500 and rows[i + 1][2] - rows[i][3] < 1500:
                speakers[i] = speakers[i - 1]
        want += [(c, r[1], s) for r, s in zip(rows, speakers, strict=True)]
    assert pairs(seg.smooth_speakers(spark.createDataFrame(calls, SCHEMA)), "speaker") == sorted(want)


def test_verify_short_turns(spark, calls):
    want = []
    for c, rows in by_call(calls).items():
        speakers, changed = [r[4] for r in rows], [False] * len(rows)
        for i in range(1, len(rows) - 1):
            if rows[i][6].lower().strip().rstrip(".?!,") in ("yes", "right") and speakers[i - 1] == speakers[i + 1] == speakers[i]:
                speakers[i], changed[i] = ("b" if speakers[i] == "a" else "a"), True
        want += [(c, r[1], s, f) for r, s, f in zip(rows, speakers, changed, strict=True)]
    assert pairs(folds.verify_short_turns(spark.createDataFrame(calls, SCHEMA), ["yes", "right"], "a", "b"), "speaker", "corrected") == sorted(want)


def test_dedup_asr(spark, calls):
    want, listed = [], {"yes", "well then"}
    for c, rows in by_call(calls).items():
        last, streak = {}, {}
        for _, k, s, e, spk, _, t in rows:
            norm = re.sub(r"[^\w\s]", "", t.lower()).strip()
            if not norm:
                continue
            n, back, drop = len(norm.split()), norm in listed or len(norm.split()) <= 1, False
            if spk in last:
                end, before = last[spk]
                gap = s - end
                if norm == before:
                    streak[spk] = streak.get(spk, 0) + 1
                    drop = (gap < 1200 or (streak[spk] >= 3 and gap < 6000)) if back else (gap < 3000 or (streak[spk] >= 2 and gap < 10_000))
                else:
                    streak[spk] = 0
                    drop = not back and n <= 4 and (norm in before or before in norm) and gap < 800
            if not drop:
                last[spk] = (e, norm)
                want.append((c, k))
    assert pairs(folds.dedup_asr(spark.createDataFrame(calls, SCHEMA), list(listed))) == sorted(want)


def test_drop_overlaps(spark, calls):
    want = []
    longer = lambda a, b: a[3] - a[2] > max(12_000, 3 * (b[3] - b[2]))
    for c, rows in by_call(calls).items():
        held = None
        for r in rows:
            if held is None:
                held = r
                continue
            met = min(held[3], r[3]) - max(held[2], r[2]) >= 1000
            if met and longer(held, r):
                held = r
            elif not (met and longer(r, held)):
                want.append((c, held[1]))
                held = r
        want.append((c, held[1]))
    assert pairs(folds.drop_overlaps(spark.createDataFrame(calls, SCHEMA))) == sorted(want)


def test_split_sentences(spark):
    rows = [(1, 0, 0, 10_000, "a", 0, "One. Two is longer! Three?"), (1, 1, 0, 2000, "a", 0, "Short. Line."), (1, 2, 5, 9005, "a", 0, "no end; then more of it"), (1, 3, 0, 5000, "a", 0, "  ")]
    got = [(r.segment_index, r.part, r.start_ms, r.end_ms, r.text) for r in folds.split_sentences(spark.createDataFrame(rows, SCHEMA)).orderBy("segment_index", "part").collect()]
    assert got == [(0, 0, 0, 1670, "One."), (0, 1, 1670, 7500, "Two is longer!"), (0, 2, 7500, 10_000, "Three?"), (1, 0, 0, 2000, "Short. Line."), (2, 0, 5, 2870, "no end;"), (2, 1, 2870, 9005, "then more of it")]


def chunks(seed=2):
    draw, rows = random.Random(seed), []
    for s in range(30):
        for k in range(12):
            rows.append((f"s{s}", k, draw.choice(["I want to Cancel", "this call is recorded", "hello", "lawyer or cancel", ""]), 2.0 * k, draw.random() < 0.3))
    return rows


def coached(rows):
    states, want = {}, []
    for s, k, text, at, cut in rows:
        state = states.setdefault(s, {"seen": [], "cuts": 0, "consent": False})
        alert = sessions.coach(state, k, text, at, cut, ["lawyer", "cancel"], ["recorded"], 15.0) if text else None
        if alert:
            want.append((s, k, alert))
    return sorted(want)


def test_live_coaching(spark):
    rows = chunks()
    df = spark.createDataFrame(rows, "session_id string, chunk long, text string, elapsed_s double, is_interruption boolean")
    got = sorted(map(tuple, folds.live_coaching(df, ["lawyer", "cancel"], ["recorded"]).collect()))
    assert got == coached(rows) and {x[2] for x in got} == {"escalation:lawyer", "escalation:cancel", "interruption", "consent"}


def test_a_coaching_stream_gives_the_same_alerts(spark, tmp_path):
    df = spark.createDataFrame(chunks(), "session_id string, chunk long, text string, elapsed_s double, is_interruption boolean").selectExpr("*", "timestamp_seconds(1700000000 + elapsed_s) as ts")
    for k, some in enumerate(("chunk < 5", "chunk between 5 and 8", "chunk > 8")):
        df.where(some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = sessions.coaching_stream(stream, ["lawyer", "cancel"], ["recorded"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, k
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == coached(chunks())


def test_utterances_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    draw, rows = random.Random(4), []
    for s in range(12):
        at = 0.0
        for k in range(60):
            at += draw.choice([0.05, 0.1, 0.3, 0.59, 0.61, 2.0])
            size = draw.choice([0.2, 0.4, 7.0])
            rows.append((f"s{s}", round(at, 3), round(at + size, 3), f"w{k}", k))
            at += size
    df = spark.createDataFrame(rows, "session_id string, start double, end double, text string, k int").selectExpr("*", "timestamp_seconds(1700000000 + end) as ts")
    want = []
    for s in range(12):
        done, open_ = sessions.cut_utterances(None, [r[1:4] for r in rows if r[0] == f"s{s}"], 0.6, 30.0)
        want += [(f"s{s}", *u) for u in [*done, open_]]
    assert sorted(map(tuple, sessions.utterances(df).collect())) == sorted(want)
    later = df.limit(1).selectExpr("'late' as session_id", "9e5D as start", "9e5D as end", "'x' as text", "0 as k", "timestamp_seconds(1700900000) as ts")
    for part in (df.where("end < 40"), df.where("end >= 40 and end < 90"), df.where("end >= 90"), later, later.selectExpr("session_id", "start + 1 as start", "end + 1 as end", "text", "k", "ts + interval 1 day as ts")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        query = sessions.persist_finals(sessions.endpoint_utterances(stream), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    finals = spark.read.parquet(str(tmp_path / "out")).where("session_id <> 'late'").select("session_id", "start", "end", "text")
    assert sorted(map(tuple, finals.collect())) == sorted(want)
    assert sessions.transcripts(spark, str(tmp_path / "out")).where("session_id = 's3'").first().text.split() == [f"w{k}" for k in range(60)]
