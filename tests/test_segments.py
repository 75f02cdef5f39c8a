from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.operators import governance as gov
from turnwise.operators import segments as seg

SCHEMA = "conversation_id long, segment_index long, start_ms long, end_ms long, speaker string, n_words long, text string"


def test_dedup_loops_looks_at_kept_lines(spark):
    rows = [(1, 0, 0, 1000, "a", 2, "Hello there"), (1, 1, 2000, 3000, "a", 2, "hello there"), (1, 2, 4000, 5000, "b", 2, "hello there"), (1, 3, 40000, 41000, "a", 2, "hello there"), (1, 4, 42000, 43000, "a", 1, "hello"), (1, 5, 44000, 45000, "a", 5, "a line of five words")]
    kept = [r.segment_index for r in seg.dedup_loops(spark.createDataFrame(rows, SCHEMA)).orderBy("segment_index").collect()]
    assert kept == [0, 2, 3, 5]


def test_smooth_speakers_sees_its_own_changes(spark):
    rows = [(1, 0, 0, 1000, "a", 5, "x"), (1, 1, 1100, 1500, "b", 1, "x"), (1, 2, 1600, 2600, "a", 9, "x"), (1, 3, 9000, 9500, "b", 1, "x"), (1, 4, 9600, 9900, "a", 5, "x")]
    got = [r.speaker for r in seg.smooth_speakers(spark.createDataFrame(rows, SCHEMA)).orderBy("segment_index").collect()]
    assert got == ["a", "a", "a", "b", "a"]


def test_text_functions(spark):
    df = spark.createDataFrame([("4111 1111-1111 1111", "loool h3y", "we we go go home", "price 250 TL, 20 tl")], "card string, t string, loop string, p string")
    r = df.select(tx.card_numbers(F.col("card")).alias("c"), tx.normalize_token(F.lit("S1!llly*")).alias("n"), tx.repeated_runs_cut(F.col("loop")).alias("l"), tx.price_signals(F.col("p")).alias("p"), tx.fold(F.lit("İPTAL"), "tr").alias("f"), tx.ascii_fold(F.lit("çağrı")).alias("a"), tx.srt_timestamp(F.lit(3723004)).alias("s")).first()
    assert (r.c, r.n, r.l, r.p, r.f, r.a, r.s) == (["4111111111111111"], "siilly", "we go home", [250], "iptal", "cagri", "01:02:03,004")


def test_word_edits(spark):
    df = spark.createDataFrame([("a b c d".split(), "a x c".split()), ([], ["q"]), (["a"], ["a"])], "r array<string>, h array<string>")
    assert [x[0] for x in df.select(tx.word_edits(F.col("r"), F.col("h"))).collect()] == [2, 1, 0]


def test_upsert_and_terms(spark):
    old = spark.createDataFrame([(1, [1.0], False), (2, [2.0], True)], "agent int, print array<double>, active boolean")
    new = spark.createDataFrame([(1, [3.0]), (2, [0.0]), (3, [4.0])], "agent int, embedding array<double>")
    assert sorted((r.agent, r.print, r.active) for r in gov.upsert_voiceprints(old, new).collect()) == [(1, [3.0], True), (2, [2.0], True), (3, [4.0], True)]
    lists = spark.createDataFrame([(1, 0, "Net"), (2, 0, "net"), (2, 1, "Fiber"), (1, 1, "Modem")], "source int, pos int, term string")
    assert [r.term for r in gov.combine_terms(lists, 2).orderBy("place").collect()] == ["Net", "Modem"]
    long = spark.range(10_001).selectExpr("1 AS call", "0 AS source", "id AS pos", "if(id = 10000, 'last', 'word') AS term").union(spark.sql("SELECT 1, 1, 0, 'next'"))
    assert [r.term for r in gov.combine_terms(long, by=["call"]).orderBy("place").collect()] == ["word", "last", "next"]


def test_long_word_edits(spark):
    """Whole texts, however many different words they have."""
    words = [f"w{i}" for i in range(3000)]
    df = spark.createDataFrame([(words, [*words[:10], "x", *words[11:2000], *words[2001:]])], "r array<string>, h array<string>")
    assert df.select(tx.word_edits(F.col("r"), F.col("h"))).first()[0] == 2
