from turnwise.operators import trends


def test_every_anomalous_topic_is_flagged(spark):
    calls = spark.range(12_000).selectExpr("id AS conversation_id", "concat('t', id) AS topic")
    anomalies = calls.selectExpr("topic", "'WARNING' AS severity", "60L AS pct_increase")
    assert trends.flag_anomalous_topics(calls, anomalies).count() == 12_000


def test_a_topic_may_hold_any_sign(spark):
    rows = [("a|b", "c", 1), ("a", "b|c", 2), ("a", "b|c", 3)]
    hits = spark.createDataFrame(rows, "topic string, keyword string, conversation_id int").selectExpr("*", "timestamp'2024-01-30 12:00:00' AS created_at")
    got = sorted((r.topic, r.keyword, r.hit_count) for r in trends.trend_snapshot(hits, "2024-01-31 00:00:00", 7).collect())
    assert got == [("a", "b|c", 2), ("a|b", "c", 1)]
