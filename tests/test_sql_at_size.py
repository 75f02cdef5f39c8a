"""Queries held against their SQL on rows that only larger tables have."""

import duckdb
import pytest

from turnwise.operators import audio, calls, whole
from turnwise.plans import registry, workflows

from .conftest import SF
from .test_queries import TABLES, rows


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a query and its SQL over the given tables and, for the others, those of sf0.01; both sides' rows."""

    def run(name, **tables):
        con = duckdb.connect()
        for t in TABLES:
            path = tmp_path / f"{t}.parquet"
            if t in tables:
                tables[t].write.mode("overwrite").parquet(str(path))
            elif not path.exists():
                path.symlink_to(f"{SF}/{t}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if t in tables else ''}'")
        return rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(con.execute(registry.ORACLES[name]).df())

    return run


def test_rule_changes_beyond_the_renamed_ones(spark, against_sql):
    got, want = against_sql("acknowledge", part=spark.range(149_995, 150_010).selectExpr("id AS p_partkey"))
    assert got == want and len(got) == 10


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["compliance_violations", "call_violations"])
def test_line_break_before_a_phrase_counts_as_a_sign(spark, against_sql, name):
    far = "no " + "a " * 24 + "a\nque b"
    lines = [(3, 0, "assistant", far), (3, 1, "assistant", far[:3] + far[5:]), (3, 2, "assistant", far[:3] + "a " + far[3:]), (3, 3, "assistant", "\nque \nno")]
    got, want = against_sql(name, conversations=spark.createDataFrame(lines, CONVERSATION))
    assert got == want and len(got) == 2


CARD = "4111111111111111"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["pii_counts", "redact_pii"])
def test_runs_of_more_digits_than_one_match_holds(spark, against_sql, name):
    texts = [f"555-0199 {CARD} {CARD}", f"10.200.100.200 {CARD} {CARD}", f"{CARD} {CARD} {CARD}", "1" * 40, f"{CARD}{CARD}5321234567", f"a {CARD}. 0532 123 45 67", "", None]
    got, want = against_sql(name, documents=spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENT))
    assert got == want and len(got) == 3


def test_summaries_of_texts_of_many_sentences_shuffle_nothing(spark, against_sql):
    words = "alpha beta gamma delta of the epsilon zeta".split()
    texts = [". ".join(" ".join(words[(i * j) % (3 + i) % 8] for j in range(k % 9)) for k in range(40)) for i in range(150)]
    texts += ["one. two words. three long words? short", "just alpha. and alpha", "...", "", None, "Alpha  beta!gamma", "a. b. c. d"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENT)
    got, want = against_sql("executive_summary", documents=docs)
    assert got == want and len(got) == 154
    assert "Exchange" not in calls.executive_summary(docs)._jdf.queryExecution().executedPlan().toString()


def test_frames_of_long_lines_pass_their_lines_where_they_lie(spark, against_sql):
    lines = [(c, t, ("assistant", "user")[t % 2], "word " * ((7 * c + 5 * t) % 12 * 25)) for c in range(6) for t in range(9)]
    calls = spark.createDataFrame(lines, CONVERSATION)
    got, want = against_sql("bleed_filter", conversations=calls)
    assert got == want and 0 < len(got) < len(lines)
    frames = spark.range(400).selectExpr("id % 4 AS recording_id", "id div 8 AS frame", "id % 2 AS channel", "0.1D AS energy", "4L AS n_samples").repartition(8, "recording_id")
    spoken = spark.range(9).selectExpr("id % 4 AS recording_id", "id AS segment_index", "id % 2 AS channel", "1000 * id AS start_ms", "1000 * id + 700 AS end_ms")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables of size
    try:
        plan = audio.bleed_filter(spoken, frames)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and not [row for row in plan.splitlines() if "Exchange" in row and "frame" in row]


def test_texts_that_cannot_overlap_a_prompt_are_not_kept(spark):
    docs = spark.createDataFrame([(i, f"one two three x{i} y{i} z{i}") for i in range(500)] + [(7, "one two three four five, five"), (7, "one two three four five, five"), (8, None)], "doc_id long, text string")
    prompts = spark.createDataFrame([(1, "five four three two one"), (2, "six one")], "prompt_id long, text string")
    found = calls.prompt_overlap(docs, prompts, [])
    assert [tuple(r) for r in found.collect()] == [(7, 1, 6, 6)]
    stored = {f.rsplit("/", 1)[0] for f in found.inputFiles() if f.endswith(".parquet")}
    assert sum(spark.read.parquet(p).count() for p in stored) == 1


def test_calls_are_stored_once(spark, tmp_path, monkeypatch):
    """Results are the files that the steps have written, and nothing else is left."""
    written, table = [], whole.Buckets.table

    def noted(self, df):
        out = table(self, df)
        written.extend(f.rsplit("/", 1)[1] for f in out.inputFiles())
        return out

    monkeypatch.setattr(whole.Buckets, "table", noted)
    for _ in range(2):  # a second time over what is there
        found = whole.analyze_calls(workflows._calls(spark, SF), workflows._call_rules(spark), f"file://{tmp_path}", ("violations",))
        assert all({f.rsplit("/", 1)[1] for f in df.inputFiles()} <= set(written) and df.count() > 0 for df in found.values())
        assert {p.name for p in tmp_path.iterdir()} == {"lines", "violations"}
