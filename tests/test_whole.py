"""Whole analyses against the single operators, and what is stored of them."""

import time

import pytest
from pyspark.sql import functions as F

from turnwise.operators import calls as ca
from turnwise.operators import evaluation as ev
from turnwise.operators import keywords as kw
from turnwise.operators import segments as seg
from turnwise.operators import whole
from turnwise.plans import workflows
from turnwise.sources.store import TABLES, AnalysisStore

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def analysed(spark, tmp_path_factory):
    """Results over all calls, and of each step the files that it reads and the seconds that its plan takes."""
    seen, table = [], whole.Buckets.table

    def noted(self, df):
        begun = time.time()
        df._jdf.queryExecution().executedPlan()
        seen.append((time.time() - begun, df.inputFiles()))
        return table(self, df)

    whole.Buckets.table = noted
    try:
        found = whole.analyze_calls(workflows._calls(spark, SF), workflows._call_rules(spark), f"file://{tmp_path_factory.mktemp('calls')}", (*whole.OUTPUTS,))
    finally:
        whole.Buckets.table = table
    return found, seen


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_outputs_are_those_of_the_single_operators(spark, analysed):
    found, rules, lines = analysed[0], workflows._call_rules(spark), analysed[0]["lines"]
    assert rows(found["hits"], *sorted(found["hits"].columns)) == rows(kw.keyword_engine(lines, rules.rules, rules.synonyms), *sorted(found["hits"].columns))
    assert rows(found["events"], *whole.KEYS, "overlap_ms") == rows(seg.crosstalk_adjacent(lines), *whole.KEYS, "overlap_ms")
    assert rows(found["violations"], *whole.KEYS, "violation") == rows(ca.compliance_violations(lines, rules.agent, rules.patterns, rules.negators), *whole.KEYS, "violation")
    one = found["call_analysis"]
    assert one.count() == lines.select("conversation_id").distinct().count() > 5
    same = [
        (seg.quality_gate(seg.asr_confidence(lines)), {"confidence": "asr_confidence", "passes": "quality_gate"}),
        (ev.soft_skills(lines, rules.agent, rules.skills, None, rules.fast), {"score": "empathy", "wpm": "agent_wpm", "interruptions": "customer_cuts"}),
        (seg.toxicity_rate(lines, rules.toxic, rules.shields), {"rate": "toxicity_rate", "terms": "toxic_terms", "is_clean": "is_clean"}),
        (ca.discourse_metrics(lines, seg.interruptions(lines, rules.customer), rules.discourse), {"fcr": "fcr", "ces": "ces", "adherence": "adherence", "status": "resolution"}),
    ]
    for other, names in same:
        assert rows(other.withColumnsRenamed(names), "conversation_id", *names.values()) == rows(one, "conversation_id", *names.values())
    assert not [r for r in one.collect() if r.churn_confidence != "low" and not r.reliable]


def test_masked_before_anything_else(spark, analysed):
    lines = analysed[0]["lines"]
    assert not lines.where(F.col("text").rlike(r"\d{9}") & (F.col("masked.pan") + F.col("masked.tckn") + F.col("masked.phone") > 0)).count()
    assert analysed[0]["call_analysis"].agg(F.sum(F.col("pan") + F.col("tckn") + F.col("phone"))).first()[0] == lines.agg(F.sum(F.col("masked.pan") + F.col("masked.tckn") + F.col("masked.phone"))).first()[0]


def test_one_scan_and_small_plans(analysed):
    """Only the first step reads the source; every other one reads the tables before it; no plan takes 5 s."""
    source = [any(f.endswith(("conversations.parquet", "documents.parquet")) for f in files) for _, files in analysed[1]]
    assert source == [True] + [False] * (len(source) - 1) and len(source) == 13
    assert max(seconds for seconds, _ in analysed[1]) < 5


def test_buckets_are_not_shuffled_again(spark, tmp_path):
    tmp = whole.Buckets(workflows._calls(spark, SF), f"file://{tmp_path}", 8)
    lines = tmp.table(workflows._calls(spark, SF))
    plan = seg.asr_confidence(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    names = list(tmp.names)
    tmp.drop()
    assert not [n for n in names if spark.catalog.tableExists(n)]


def test_no_calls(spark, tmp_path):
    found = whole.analyze_calls(workflows._calls(spark, SF).limit(0), workflows._call_rules(spark), f"file://{tmp_path}")
    assert {name: df.count() for name, df in found.items()} == dict.fromkeys((*whole.OUTPUTS, "lines"), 0)


@pytest.fixture
def store(spark, tmp_path):
    return AnalysisStore(spark, f"file://{tmp_path}/store")


def some(analysed, where):
    return whole.stored_rows({name: df.where(where) for name, df in analysed[0].items()})


def counts(store):
    return {name: store.read(name).count() for name in TABLES}


def test_stored_analysis(spark, analysed, store):
    assert counts(store) == dict.fromkeys(TABLES, 0)
    both = some(analysed, "true")
    assert store.write("one", both) and not store.write("one", both)
    want = {"conversations": analysed[0]["call_analysis"].count(), "segments": analysed[0]["lines"].count(), "hits": analysed[0]["hits"].count()}
    assert counts(store) == want
    lines = store.read("segments").select("segment_id", "conversation_id", "segment_index", "speaker")
    assert store.read("hits").join(lines, "segment_id").count() == want["hits"]  # every hit has its line
    assert lines.select("segment_id").distinct().count() == want["segments"]
    assert store.write("two", some(analysed, "conversation_id = 1"))  # a call again: its rows replace the others
    assert counts(store) == want


def test_placeholders_are_filled_in(spark, analysed, store):
    ids = analysed[0]["call_analysis"].select(F.col("conversation_id").cast("string").alias("conversation_id"))
    assert store.open_calls("open", ids.where("conversation_id < 3"))
    assert {r.status for r in store.read("conversations").collect()} == {"processing"}
    with pytest.raises(ValueError, match="not stored"):
        store.write("early", some(analysed, "conversation_id = 3"), update=True)
    assert store.write("done", some(analysed, "conversation_id = 1"), update=True)
    assert sorted((r.conversation_id, r.status) for r in store.read("conversations").collect()) == [("0", "processing"), ("1", "completed"), ("2", "processing")]


def test_a_commit_that_breaks_off_changes_nothing(spark, analysed, store):
    store.write("one", some(analysed, "conversation_id < 4"))
    before, rows_ = counts(store), some(analysed, "true")
    broken = dict(rows_, hits=rows_["hits"].withColumn("keyword", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        store.write("two", broken)
    assert counts(store) == before and store.commits() == ["one"]
    assert AnalysisStore(spark, store.root).write("two", rows_)  # tried again, by another process
    assert counts(store)["conversations"] == analysed[0]["call_analysis"].count()


def test_compacted(spark, analysed, store):
    for i in range(3):
        store.write(f"c{i}", some(analysed, f"conversation_id >= {2 * i}"))
    before = {name: sorted(map(str, store.read(name).collect())) for name in TABLES}
    store.compact("all")
    assert store.commits() == ["all"]
    assert {name: sorted(map(str, store.read(name).collect())) for name in TABLES} == before
    assert not store.write("all", some(analysed, "true"))
