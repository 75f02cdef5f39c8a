"""Trends, anomalies, forecasts, alerts and dashboards over keyword hits. Every window counts back from an explicit as_of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ts(as_of: str):
    return F.lit(as_of).cast("timestamp")


def _back(as_of: str, days: float):
    return _ts(as_of) - F.expr(f"make_dt_interval(0, {int(days * 24)})")


def top_keywords(hits: DataFrame, as_of: str, days: float, k: int) -> DataFrame:
    recent = hits.where((F.col("created_at") >= _back(as_of, days)) & (F.col("created_at") < _ts(as_of)))
    return recent.groupBy("keyword").agg(F.count(F.lit(1)).alias("hit_count")).orderBy(F.desc("hit_count"), "keyword").limit(k)


def percent_change(now, before):
    """100 * (now - before) / before to two places; 100 where only `now` has hits."""
    return F.when(before > 0, F.round(100.0 * (now - before) / before, 2)).when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def compute_trend(hits: DataFrame, by: str, as_of: str, days: float) -> DataFrame:
    """Each key's hits in the window and the one before, its distinct conversations, change and rise flag (40 % or more)."""
    created, edge = F.col("created_at"), _back(as_of, days)
    now, before = (created >= edge) & (created < _ts(as_of)), (created >= _back(as_of, 2 * days)) & (created < edge)
    both = hits.where(now | before).groupBy(by).agg(F.count_if(now).alias("current_count"), F.count_if(before).alias("previous_count"), F.count_distinct(F.when(now, F.col("conversation_id"))).alias("conversation_count"))
    both = both.withColumn("pct_change", percent_change(F.col("current_count"), F.col("previous_count")))
    return both.withColumn("is_rising", F.col("pct_change") >= 40)


def trend_matrix(hits: DataFrame, as_of: str, days: int) -> DataFrame:
    """A row for each of the last `days` dates and each topic ever seen, zero where it has no hits."""
    calendar = hits.sparkSession.range(days).select(F.date_sub(F.to_date(_ts(as_of)), F.col("id").cast("int") + 1).alias("day"))
    topics = hits.select("topic").distinct()
    counts = hits.where((F.col("created_at") >= _back(as_of, days)) & (F.col("created_at") < _ts(as_of))).groupBy(F.to_date("created_at").alias("day"), "topic").agg(F.count(F.lit(1)).alias("n"))
    return topics.crossJoin(F.broadcast(calendar)).join(counts, ["day", "topic"], "left").select("day", "topic", F.coalesce("n", F.lit(0)).alias("hit_count"))


def detect_anomalies(matrix: DataFrame) -> DataFrame:
    """Topics whose mean of the last two days is half or more above the mean of the earlier ones (taken as five at least)."""
    latest = F.dense_rank().over(Window.partitionBy("topic").orderBy(F.desc("day")))
    means = matrix.withColumn("age", latest).groupBy("topic").agg(F.count(F.lit(1)).alias("days"), F.avg(F.when(F.col("age") <= 2, F.col("hit_count"))).alias("recent"), F.avg(F.when(F.col("age") > 2, F.col("hit_count"))).alias("base")).where("days >= 3")
    rise = means.withColumn("base", F.greatest(F.lit(5.0), "base")).withColumn("pct", 100.0 * (F.col("recent") - F.col("base")) / F.col("base"))
    return rise.where("pct >= 50").select("topic", F.when(F.col("pct") >= 100, "CRITICAL").otherwise("WARNING").alias("severity"), F.col("pct").cast("long").alias("pct_increase"), F.col("recent").cast("long").alias("recent_avg"), F.col("base").cast("long").alias("baseline_avg"))


def forecast_next_day(matrix: DataFrame, n: int = 7) -> DataFrame:
    """A least-squares line over the last n days of each topic, by exact integer sums, read off at the next day."""
    x = (F.lit(n) - F.dense_rank().over(Window.partitionBy("topic").orderBy(F.desc("day")))).alias("x")
    sums = matrix.select("topic", x, F.col("hit_count").alias("y")).where("x >= 0").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.expr("x * y")).alias("sxy"), F.sum(F.expr("x * x")).alias("sxx"))
    line = sums.where(f"n = {n}").withColumn("slope", F.expr("(n * sxy - sx * sy) / cast(n * sxx - sx * sx AS double)")).withColumn("predicted", F.expr(f"(sy - slope * sx) / n + slope * {n}"))
    return line.where("slope > 0.5 AND predicted > 5").select("topic", F.round("slope", 4).alias("slope"), F.round("predicted", 4).alias("predicted"), F.when(F.col("slope") > 2, "HIGH").otherwise("MEDIUM").alias("risk"))


def trend_snapshot(hits: DataFrame, as_of: str, days: int) -> DataFrame:
    """The trend of each (topic, keyword), as a table to store."""
    found = compute_trend(hits.withColumn("key", F.struct("topic", "keyword")), "key", as_of, days)
    return found.select("key.topic", "key.keyword", F.col("current_count").alias("hit_count"), "conversation_count", F.lit(f"{days}d").alias("window"), "pct_change")


def evaluate_alerts(hits: DataFrame, rules: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(events, rules with last_triggered): active rules outside their cooldown whose trend meets the threshold.

    rules(rule_id, keyword, days, threshold_pct, min_count, cooldown_min, is_active, last_triggered). Each keyword is
    counted once for each different window of its rules.
    """
    due = rules.where(F.col("is_active") & (F.col("last_triggered").isNull() | (F.col("last_triggered") + F.make_dt_interval(mins=F.col("cooldown_min")) <= _ts(as_of))))
    back = lambda times: _ts(as_of) - F.make_dt_interval(days=(times * F.col("days")).cast("int"))
    met = hits.where(F.col("created_at") < _ts(as_of)).join(due.select("keyword", "days").distinct(), "keyword").where(F.col("created_at") >= back(2))
    counts = met.groupBy("keyword", "days").agg(F.count_if(F.col("created_at") >= back(1)).alias("current_count"), F.count_if(F.col("created_at") < back(1)).alias("previous_count"))
    trends = counts.withColumn("pct_change", percent_change(F.col("current_count"), F.col("previous_count")))
    fired = trends.join(due, ["keyword", "days"]).where("pct_change >= threshold_pct AND current_count >= min_count")
    events = fired.select("rule_id", "keyword", F.concat(F.lit("Rising: "), "keyword").alias("title"), F.format_string("%d hits in %d days, %d before", "current_count", F.col("days").cast("long"), "previous_count").alias("summary"), F.when(F.col("pct_change") >= 40, "warning").otherwise("info").alias("severity"), "pct_change")
    marked = events.select("rule_id").withColumn("_fired", F.lit(True))
    return events, rules.join(marked, "rule_id", "left").withColumn("last_triggered", F.when(F.col("_fired"), _ts(as_of)).otherwise(F.col("last_triggered"))).drop("_fired")


def alert_payloads(events: DataFrame, as_of: str) -> DataFrame:
    """The webhook body of each alert event as JSON."""
    body = F.struct("title", "summary", "severity", F.struct("keyword", "pct_change").alias("details"), F.lit(as_of).alias("timestamp"))
    return events.select("rule_id", F.to_json(body).alias("payload"))


def score_histogram(scores: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """How many scores lie at or below each bound; one pass."""
    counts = scores.agg(*[F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(F.inline(rows))


def ops_ratios(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """Share of server errors and the 95th percentile latency in each window, with flags at 5 % and 1.5."""
    found = requests.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("requests"), (F.count_if(F.col("status") >= 500) / F.count(F.lit(1))).alias("error_share"), F.percentile("latency", 0.95).alias("p95"))
    return found.select(F.col("w.start").alias("window_start"), "requests", F.round("error_share", 6).alias("error_share"), F.round("p95", 6).alias("p95"), (F.col("error_share") > 0.05).alias("too_many_errors"))


def daily_series(hits: DataFrame, keyword: str) -> DataFrame:
    return hits.where(F.col("keyword") == keyword).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("hit_count"))


def dashboard_summary(calls: DataFrame, hits: DataFrame, alerts: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """One row: the calls of the last days and their mean churn risk (missing is 0), open alerts, hits since midnight UTC, the topic that rises most in 7 days."""
    recent = calls.where((F.col("created_at") >= _back(as_of, days)) & (F.col("created_at") < _ts(as_of)))
    one = recent.agg(F.count_distinct("conversation_id").alias("total_calls"), F.round(F.avg(F.coalesce("churn_risk", F.lit(0.0))), 6).alias("avg_churn_risk"))
    two = alerts.agg(F.count_if(~F.col("acknowledged")).alias("open_alerts"))
    three = hits.where((F.col("created_at") >= F.date_trunc("day", _ts(as_of))) & (F.col("created_at") < _ts(as_of))).agg(F.count(F.lit(1)).alias("hits_today"))
    four = compute_trend(hits, "topic", as_of, 7).agg(F.max_by("topic", F.struct("pct_change", "topic")).alias("top_rising_topic"))
    return one.crossJoin(two).crossJoin(three).crossJoin(four)


def flag_anomalous_topics(calls: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(conversation_id, topic, severity, pct_increase) of the topics of a call that are anomalous now."""
    return calls.select("conversation_id", "topic").distinct().join(anomalies.select("topic", "severity", "pct_increase"), "topic")


def token_frequency(texts: DataFrame, column: str, k: int, min_chars: int = 4) -> DataFrame:
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"\p{L}+"), F.lit(0))).alias("token")).where(F.length("token") >= min_chars)
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(k)
