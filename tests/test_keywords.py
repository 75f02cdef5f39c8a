from collections import defaultdict
from difflib import SequenceMatcher
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import pii
from turnwise.functions import text as tx
from turnwise.operators import evaluation as ev
from turnwise.operators import governance as gov
from turnwise.operators import keywords as kw
from turnwise.operators import segments as seg
from turnwise.operators import trends as tr

RULES = "rule_id string, keywords array<string>, match_mode string, fuzzy_threshold double, sector_scope array<string>, is_active boolean"
SEGMENTS = "conversation_id long, segment_index long, sector string, text string"


def hits(spark, texts, rules, **more):
    rows = [(1, k, "telecom", t) for k, t in enumerate(texts)]
    found = kw.keyword_engine(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([(*r, None, True) for r in rules], RULES), **more)
    return sorted((r.segment_index, r.rule_id, r.matched_text, r.match_type, round(r.confidence, 4)) for r in found.collect())


def test_modes_of_the_keyword_engine(spark):
    synonyms = spark.createDataFrame([("zam", ["fiyat artışı", "zamlı"])], "keyword string, synonyms array<string>")
    rules = [("exact", ["iptal", "hat iptali"], "exact", None), ("fuzzy", ["fatura"], "fuzzy", 0.8), ("regex", [r"\b\d{3}\b"], "regex", None), ("sem", ["zam"], "semantic", None)]
    texts = ["IPT@L et, 1ptal!", "hat iptali istiyorum iptal", "faturam ve fatuura", "kod 123 ve 456, 123", "Fiyat artışı çok, zam zaman", None, "", "şikâyet"]
    got = hits(spark, texts, rules, synonyms=synonyms, excluded={"zam": ["zaman"]})
    ratio = lambda a: round(SequenceMatcher(None, a, "fatura").ratio(), 4)
    assert got == sorted([
        (0, "exact", "iptal", "exact", 1.0), (1, "exact", "hat iptali", "phrase", 1.0), (1, "exact", "iptal", "exact", 1.0),
        (2, "fuzzy", "faturam", "fuzzy", ratio("faturam")), (2, "fuzzy", "fatuura", "fuzzy", ratio("fatuura")),
        (3, "regex", "123", "regex", 1.0), (3, "regex", "456", "regex", 1.0),
        (4, "sem", "fiyat artışı", "phrase", 1.0), (4, "sem", "zam", "semantic", 1.0),
    ])


def test_likeness_is_that_of_a_plain_loop(spark):
    words = "there three these their them theirs thirst hatred other weather threat heather".split()
    got = {(s, m): c for s, _, m, _, c in hits(spark, words, [("f", ["there"], "fuzzy", 0.7)])}
    want = {(k, w): round(SequenceMatcher(None, w, "there").ratio(), 4) for k, w in enumerate(words) if SequenceMatcher(None, w, "there").ratio() >= 0.7}
    assert got == want and len(want) > 4


def test_context_shows_the_hit(spark):
    text = "x" * 300 + " the word " + "y" * 300
    found = kw.keyword_engine(spark.createDataFrame([(1, 0, "a", text)], SEGMENTS), spark.createDataFrame([("r", ["word"], "exact", None, None, True)], RULES)).first()
    assert "word" in found.context and len(found.context) <= 84


def test_words_of_other_scripts_are_whole(spark):
    got = spark.range(1).select(tx.tokens(F.lit("Şikayet için iptal, für Größe"), "tr").alias("w")).first().w
    assert got == ["şikayet", "için", "iptal", "für", "größe"]


def test_highlights(spark):
    df = spark.createDataFrame([(1, 0, "aaa the cat sat, The Cat and cat"), (1, 1, None), (1, 2, "")], "conversation_id long, segment_index long, text string")
    got = sorted((r.begin, r.end) for r in kw.highlight_spans(df, ["cat", "the cat", "aa"]).collect())
    assert got == [(0, 2), (4, 11), (17, 24), (29, 32)]


def test_personal_numbers(spark):
    texts = ["kart 4111 1111 1111 1111 ve tc 10000000146.", "TR33 0006 1005 1978 6457 8413 26 hesabı", "tel 0532 123 45 67, no 12345678901", "TR000006100519786457841326", None, "", "1" * 40]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", pii.redact(F.col("text"))[0].alias("t"), pii.redact(F.col("text"))[1].alias("n")).orderBy("i").collect()
    assert rows[0].t == "kart [KART NO GİZLENDİ] **** 1111 ve tc [TCKN GİZLENDİ] *********46." and tuple(rows[0].n) == (0, 1, 1, 0)
    assert rows[1].t == "TR** **** [IBAN GİZLENDİ] 1326 hesabı" and tuple(rows[1].n) == (1, 0, 0, 0)
    assert rows[2].t == "tel [TELEFON GİZLENDİ] *** 4567, no 12345678901" and tuple(rows[2].n) == (0, 0, 0, 1)
    assert [tuple(r.n) for r in rows[4:]] == [(0, 0, 0, 0)] * 3 and rows[4].t is None and rows[5].t == "" and rows[6].t == "1" * 40


def der_by_steps(ref, hyp, half):
    """The same rate, a millisecond at a time."""
    end = max(t for _, _, t, _ in [*ref, *hyp])
    near = {t for _, s, e, _ in ref for b in (s, e) for t in range(b - half, b + half)}
    total = miss = false = both = 0
    agree = defaultdict(int)
    for t in range(end):
        if t in near:
            continue
        r, h = {x[3] for x in ref if x[1] <= t < x[2]}, {x[3] for x in hyp if x[1] <= t < x[2]}
        total, miss, false, both = total + len(r), miss + max(0, len(r) - len(h)), false + max(0, len(h) - len(r)), both + min(len(r), len(h))
        for a in r:
            for b in h:
                agree[a, b] += 1
    names, others = sorted({x[3] for x in ref}), sorted({x[3] for x in hyp})
    others += [None] * max(0, len(names) - len(others))
    best = max(sum(agree[a, b] for a, b in zip(names, p)) for p in permutations(others, len(names)))
    return total, miss, false, both - best


def test_speaker_error(spark):
    ref = [("u", 0, 2000, "A"), ("u", 1800, 3500, "B"), ("u", 4000, 5000, "A"), ("u", 5200, 6100, "C")]
    hyp = [("u", 100, 1900, "x"), ("u", 1900, 3600, "y"), ("u", 3900, 4800, "y"), ("u", 5000, 6000, "x"), ("u", 6500, 7000, "z")]
    schema = "uri string, t_start long, t_end long, speaker string"
    for bucket in (30_000, 700):
        got = ev.corpus_der(spark.createDataFrame(ref, schema), spark.createDataFrame(hyp, schema), 250, bucket).first()
        assert (got.total, got.missed, got.false_alarm, got.confusion) == der_by_steps(ref, hyp, 125)
    crowd = [("b", 1000 * i, 1000 * i + 900, f"s{i % 14}") for i in range(70)]
    renamed = [(u, a, b, f"h{(int(x[1:]) * 5) % 14}") for u, a, b, x in crowd]
    many = ev.corpus_der(spark.createDataFrame(crowd, schema), spark.createDataFrame(renamed, schema)).first()  # 14 speakers under other names
    assert many["total"] > 0 and many["der"] == 0
    same = ev.corpus_der(spark.createDataFrame(ref, schema), spark.createDataFrame(ref, schema)).first()
    assert (same.der, same.missed) == (0.0, 0)
    assert ev.best_pairing([[3, 5], [5, 6], [4, 1]]) == 10
    assert ev.best_pairing([]) == 0
    rng = np.random.default_rng(1)
    for _ in range(60):
        x = rng.integers(0, 9, rng.integers(1, 7, 2))
        y = x if x.shape[0] <= x.shape[1] else x.T
        assert ev.best_pairing(x) == max(sum(y[i][c] for i, c in enumerate(p)) for p in permutations(range(y.shape[1]), len(y)))
    order = rng.permutation(40)
    table = rng.uniform(0, 1, (40, 40))
    table[np.arange(40), order] += 2  # no pairing is better than the one that has all of these
    assert ev.best_pairing(table) == pytest.approx(table[np.arange(40), order].sum())


def test_more_rule_windows_than_ever(spark):
    hits = spark.range(400).selectExpr("concat('k', id % 2) as keyword", "timestamp'2024-01-30 00:00:00' - make_dt_interval(cast(id % 200 as int)) as created_at", "id as conversation_id")
    rules = spark.range(1, 91).selectExpr("concat('r', id) as rule_id", "'k0' as keyword", "cast(id as int) as days", "-100.0D as threshold_pct", "1 as min_count", "60 as cooldown_min", "true as is_active", "cast(null as timestamp) as last_triggered")
    assert tr.evaluate_alerts(hits, rules, "2024-01-31 00:00:00")[0].count() == 90


def test_upper_median_and_scope(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 9, 7, 3, 3)] + [(None,)], "v double")
    assert gov.operational_stats(df, ["v"]).first().median == 5.0
    assert [gov.nth_smallest(df, "v", k) for k in range(7)] == [1, 3, 3, 5, 7, 9, None]
    inf, nan = float("inf"), float("nan")
    ends = spark.createDataFrame([(v,) for v in (inf, 4.0, -inf, nan, inf, 2.0, None)], "v double")
    assert [gov.nth_smallest(ends, "v", k) for k in range(5)] == [-inf, 2.0, 4.0, inf, inf] and np.isnan(gov.nth_smallest(ends, "v", 5)) and gov.nth_smallest(ends, "v", 6) is None
    calls = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cyd")], "conversation_id int, agent_id string")
    users = spark.createDataFrame([("ann", "agent", "t"), ("bob", "agent", "t"), ("cyd", "intern", "u"), ("lee", "team_lead", "t"), ("qa1", "qa", None)], "username string, role string, team string")
    seen = lambda name: sorted(r.conversation_id for r in gov.scope_conversations(calls, users, name).collect())
    assert [seen(n) for n in ("ann", "cyd", "lee", "qa1", "stranger")] == [[1], [3], [1, 2], [1, 2, 3], []]


def test_the_shield_of_a_negator(spark):
    schema = "conversation_id long, segment_index long, n_words long, text string"
    rows = [(1, 0, 4, "you are an idiot"), (1, 1, 6, "you are not at all an idiot"), (2, 0, 9, "not a word, then a long way further an idiot, idiot")]
    got = {r.conversation_id: (r.terms, r.flagged) for r in seg.toxicity_rate(spark.createDataFrame(rows, schema), ["idiot"], ["not "]).collect()}
    assert got == {1: (1, 1), 2: (1, 1)}
    assert seg.toxicity_rate(spark.createDataFrame(rows[1:2], schema), ["idiot"], ["not "]).first().terms == 0
    many = [(3, 0, 1, "not idiot " * 20_000)]  # every place is looked at
    assert seg.toxicity_rate(spark.createDataFrame(many, schema), ["idiot"], ["not "]).first().terms == 0


def test_inactive_prints_match_nothing(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0], "m"), (2, [0.0, 0.0], "m"), (3, [1.0, 0.0, 0.0], "m")], "query_id long, embedding array<double>, model string")
    prints = spark.createDataFrame([(7, [1.0, 0.1], "m", False), (8, [1.0, 1.0], "m", True), (9, [1.0, 0.0], "n", True)], "agent long, print array<double>, model string, active boolean")
    got = {r.query_id: (r.agent, round(r.score, 3)) for r in gov.match_voiceprints(queries, prints, 0.7).collect()}
    assert got == {1: (8, 0.707), 2: (None, 0.0), 3: (None, 0.0)}
    named = spark.createDataFrame([("agent_y", [1.0, 0.1], "m"), ("agent_x", [2.0, 0.2], "m"), ("agent_z", [0.0, 1.0], "m")], "agent string, print array<double>, model string")
    assert {r.query_id: r.agent for r in gov.match_voiceprints(queries, named, 0.7).collect()} == {1: "agent_x", 2: None, 3: None}  # as like: the smaller name


def test_text_rules(spark):
    one = spark.range(1).select(
        tx.sanitize_repetitions(F.lit("ok...... 7.7.7.7. Good. good. we go we go now")).alias("a"),
        tx.restore_punctuation(F.lit("gelir misin. ne var  tamam"), r"\b(?:misin|ne)\b").alias("b"),
        tx.canonical_sector(F.lit(" Bank "), {"bank": "banking"}).alias("c"),
        tx.word_edits(F.array(*[F.lit(f"w{i}") for i in range(5)]), F.array(F.lit("w0"), F.lit("x"), F.lit("w4"))).alias("d"),
    ).first()
    assert one.b == "Gelir misin. Ne var  tamam?" and one.c == "banking" and one.d == 3
    assert "......" not in one.a and one.a.endswith("we go now")


def test_more_words_than_two_bytes(spark):
    words = [f"w{i}" for i in range(70_000)]
    df = spark.createDataFrame([(words[:40_000:400] + ["x"], words[:40_000:400])], "r array<string>, h array<string>")
    assert df.select(tx.word_edits(F.col("r"), F.col("h"))).first()[0] == 1
    codes = spark.createDataFrame([(k,) for k in (1, 0x4FFF, 0x5000, 40_000, 66_000, 0xEFFFF)], "k long").select(tx._sign(F.col("k"))).collect()
    assert len({r[0] for r in codes}) == 6 and all(len(r[0]) == 1 for r in codes)
    with pytest.raises(Exception, match="983"):
        spark.range(1).select(tx._sign(F.lit(0xF0000))).collect()


def test_prints_meet_queries_in_blocks(spark):
    """Copies, the smallest of equal ones, and no join that Spark could broadcast prints for."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 8)), rng.normal(size=(90, 8))
    y[60:] = y[:30] * 2
    queries = spark.createDataFrame([(i, v.tolist(), None if i == 299 else "m") for i, v in enumerate(x)], "query_id long, embedding array<double>, model string")
    prints = spark.createDataFrame([(f"a{i:02d}", v.tolist(), "m") for i, v in enumerate(y)] + [("b", [float("nan")] * 8, "m"), ("c", y[0].tolist(), None)], "agent string, print array<double>, model string")
    cosine = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)
    want = {i: (f"a{c[:60].argmax():02d}" if c.max() >= 0.5 else None, round(c.max(), 6)) for i, c in enumerate(cosine[:299])} | {299: (None, 0.0)}
    for values in (1 << 20, 200):
        found = gov.match_voiceprints(queries, prints, 0.5, values)
        assert {r.query_id: (r.agent, round(r.score, 6)) for r in found.collect()} == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and plan.count("Join ") == 1  # that of the results
