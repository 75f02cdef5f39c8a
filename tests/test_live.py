"""Streams against their batch forms and plain loops: partial utterances in event order, alerts with stored cooldowns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from turnwise.plans import workflows
from turnwise.sources import fixtures as fx
from turnwise.streaming import alerts
from turnwise.streaming.endpoints import ROCKS, Endpointing, advance, endpoint_stream, flush, utterances

HOW = Endpointing()


def drawn(seed, sessions=12, frames=60):
    draw, rows = random.Random(seed), []
    for s in range(sessions):
        at = draw.randrange(0, 3000)
        for k in range(frames):
            size = draw.choice([100, 300, 500, 800])
            rows.append((f"s{s}", at, at + size, draw.choice(["", "", f"w{k}", f"w{k}", f"w{k} x"])))
            at += size + draw.choice([0, 0, 0, 50, 400, 700, 2000] + [31_000] * (draw.random() < 0.05))
    return rows


def plain(rows):
    out = []
    for s in sorted({r[0] for r in rows}):
        held = None
        for r in sorted(r[1:] for r in rows if r[0] == s):
            found, held = advance(held, r, HOW)
            out += [(s, *f) for f in found]
        out += [(s, *f) for f in flush(held)]
    return sorted(out)


def test_table_form(spark):
    rows = drawn(3, 30, 200)
    got = sorted(tuple(r) for r in utterances(spark.createDataFrame(rows, "session_id string, start long, end long, text string")).collect())
    assert got == plain(rows)
    kinds = {r[1] for r in got}
    assert kinds == {"partial", "final"}
    assert utterances(spark.createDataFrame([(None, 1, 2, "a"), ("a", None, 2, "a"), ("b", 5, 6, None)], "session_id string, start long, end long, text string")).count() == 0


@pytest.mark.parametrize(("frames", "want"), [
    ([(0, 400, "a"), (400, 800, "b")], [("final", 800, 0, 800, "a b")]),  # the session's end
    ([(0, 500, "a"), (500, 1000, "b"), (1000, 1700, "")], [("partial", 1000, 0, 1000, "a b"), ("final", 1700, 0, 1000, "a b")]),
    ([(0, 500, "a"), (500, 1000, "b"), (1000, 1700, ""), (1700, 2000, "")], [("partial", 1000, 0, 1000, "a b"), ("final", 2000, 0, 1000, "a b")]),
    ([(0, 1000, ""), (1000, 1600, ""), (1600, 2600, "a")], [("partial", 2600, 1600, 2600, "a"), ("final", 2600, 1600, 2600, "a")]),
    ([(i * 1000, i * 1000 + 1000, f"{i}") for i in range(30)], [("partial", i * 1000 + 1000, 0, i * 1000 + 1000, " ".join(map(str, range(i + 1)))) for i in range(29)] + [("final", 30_000, 0, 30_000, " ".join(map(str, range(30))))]),
])
def test_rules(frames, want):
    held, out = None, []
    for f in frames:
        found, held = advance(held, f, HOW)
        out += found
    out += flush(held)
    if want[1:2] and want[1][0] == "final" and frames[-1][1] == 1700:  # 0.7 s after the last look is no look
        want = [want[0], ("final", 1700, 0, 1000, "a b")]
    assert out == want


def test_a_replayed_stream_gives_the_rows_of_the_table(spark, tmp_path):
    """Frames arrive shuffled within 2 s over many files; a last frame of another session, far later, moves the watermark past all."""
    rows = drawn(5)
    base = datetime(2024, 1, 1)
    draw = random.Random(1)
    timed = [(s, base + timedelta(milliseconds=e), a, e, t) for s, a, e, t in rows]
    timed.sort(key=lambda r: r[1] + timedelta(milliseconds=draw.uniform(0, 1900)))
    end = max(r[1] for r in timed)
    timed += [("z", end + timedelta(minutes=m), 10**7 * m, 10**7 * m + 1, "") for m in (2, 4, 6)]
    schema = "session_id string, ts timestamp, start long, end long, text string"
    folder = tmp_path / "frames"
    batches = [timed[i : i + 60] for i in range(0, len(timed) - 3, 60)] + [[r] for r in timed[-3:]]
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    got = []
    try:
        for i, some in enumerate(batches):
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(folder))
            # a new query each time: state, timers and the watermark come back from the checkpoint
            if i % 6 == 5 or i >= len(batches) - 3:
                stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
                query = endpoint_stream(stream, HOW).writeStream.foreachBatch(lambda b, _: got.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
                query.awaitTermination(300)
                assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    assert sorted(got) == plain(rows)
    last = {}
    for s, kind, at, *_ in got:  # rows of a session come in event order, partials at most every 0.9 s
        assert at - last.get(s, -10_000) >= (900 if kind == "partial" else 0)
        last[s] = at


RULES = "rule_id string, keyword string, days int, threshold_pct double, min_count int, cooldown_min int, is_active boolean, last_triggered timestamp"
START = datetime(2024, 3, 1)


def hits_of(batches):
    draw = random.Random(8)
    return [[(draw.choice("aab"), i, START + timedelta(days=3 * b, minutes=draw.randrange(3 * 24 * 60))) for i in range(n)] for b, n in enumerate(batches)]


def plain_alerts(batches, rules):
    seen, fired, out = [], {r[0]: r[7] for r in rules}, []
    for b, some in enumerate(batches):
        seen += some
        if not some:
            continue
        now = max(t for _, _, t in some) + timedelta(microseconds=1)
        for rule, word, days, least, count, cool, active, _ in rules:
            window = timedelta(days=days)
            new = sum(w == word and now - window <= t < now for w, _, t in seen)
            old = sum(w == word and now - 2 * window <= t < now - window for w, _, t in seen)
            pct = 100.0 * (new - old) / old if old else 100.0 if new else 0.0
            if active and new >= count and round(pct, 2) >= least and (new or old) and not (fired[rule] and fired[rule] + timedelta(minutes=cool) > now):
                fired[rule] = now
                out.append((b, rule, now))
    return out


def test_alerts_fire_once(spark, tmp_path):
    """A batch that runs twice fires once; cooldowns outlive a restart; a batch that broke off half-way is done again."""
    rules = [("r1", "a", 7, 10.0, 5, 60, True, None), ("r2", "b", 1, -50.0, 3, 6 * 24 * 60, True, None), ("r3", "a", 7, -100.0, 1, 1, False, None), ("r4", "a", 1, -100.0, 1, 10**6, True, None), ("r5", "b", 7, -100.0, 1, 60, True, datetime(2030, 1, 1))]
    batches = hits_of([40, 0, 60, 90, 30, 120])
    table, folder = spark.createDataFrame(rules, RULES), f"file://{tmp_path}/alerts"
    for b, some in enumerate(batches):
        rows = spark.createDataFrame(some, alerts.HITS)
        if b == 3:  # breaks off after its hits were stored
            rows.write.mode("overwrite").parquet(f"{folder}/hits/batch={b}")
        for _ in range(1 + (b in (2, 5))):
            alerts.evaluate_batch(rows, b, table, folder)
    got = sorted((r.batch, r.rule_id, r.fired_at) for r in alerts.alert_events(spark, folder).collect())
    assert got == sorted(plain_alerts(batches, rules)) and len(got) >= 5
    assert all(r.payload and r.title for r in alerts.alert_events(spark, folder).collect())


def test_alert_stream_restarts(spark, tmp_path):
    rules = [("r1", "a", 7, -100.0, 1, 60 * 24 * 30, True, None), ("r2", "b", 7, -100.0, 1, 1, True, None)]
    source, folder = tmp_path / "hits", f"file://{tmp_path}/alerts"
    for some in hits_of([20, 20, 20]):
        spark.createDataFrame(some, alerts.HITS).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(alerts.HITS).parquet(str(source))
        query = alerts.alert_sink(stream, spark.createDataFrame(rules, RULES), folder, str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    found = alerts.alert_events(spark, folder).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.rule_id: r.n for r in found} == {"r1": 1, "r2": 3}


def test_queries(spark):
    """The registered forms over all rows of their tables."""
    sf = "/root/testdata/sf0.001"
    frames = [tuple(r) for r in workflows._frames_of_words(spark, sf).collect()]
    assert sorted(tuple(r) for r in workflows.live_partials(spark, sf).collect()) == plain(frames) and len(frames) > 500
    hits = [tuple(r) for r in fx.hits(spark, sf).select("keyword", "conversation_id", "created_at").collect()]
    first = min(t for *_, t in hits).date()
    n = (max(t for *_, t in hits).date() - first).days // 5 + 1
    batches = [[h for h in hits if (h[2].date() - first).days // 5 == b] for b in range(n)]
    rules = [(f"rule-{k}", k, 7 if len(k) % 2 == 0 else 1, -20.0, 5, 1440 * len(k), k != "error", None) for k in sorted({h[0] for h in hits})]
    got = sorted((r.batch, r.rule_id, r.fired_at) for r in workflows.alert_history(spark, sf).collect())
    assert got == sorted(plain_alerts(batches, rules)) and got
