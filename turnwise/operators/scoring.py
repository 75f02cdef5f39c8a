"""Scores of a model for texts, and the rules that stand on them: compliance, churn, negativity, toxicity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import text as tx
from turnwise.operators import calls as ca

KEYS = ["conversation_id", "segment_index"]
#: Labels of the compliance and churn questions, least scores, and how much of a long text is scored.
PROMISE, PASSWORD = ("misleading promise", 0.80), ("asking for password", 0.85)
LEAVING = ["canceling service", "switching to competitor"]
CANDIDATE_CHARS, EXCERPT_CHARS = 400, 512


class Model(Protocol):
    """What scores texts: one row of scores, a column for each of `labels`, for each text."""

    labels: list[str]

    def predict(self, texts: list[str]): ...


def score_with(df: DataFrame, keys: list[str], load: Callable[[], Model], text_col: str = "text", batch: int = 256) -> DataFrame:
    """(keys, label, score) of each row whose text is not null, by the model that load() gives.

    A task loads the model once (from a shared path, or a broadcast value that `load` holds) and scores `batch` texts at a time. Each
    different text is scored once, however many rows have it.
    """
    rows = df.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("_text"), F.sha2(F.col(text_col), 256).alias("_tw"))
    distinct = rows.groupBy("_tw").agg(F.first("_text").alias("_text"))

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                model = model or load()
                found = pd.DataFrame(model.predict(some["_text"].tolist()), columns=model.labels, dtype="float64")
                found.insert(0, "_tw", some["_tw"].to_numpy())
                yield found.melt("_tw", var_name="label", value_name="score")

    scored = distinct.mapInPandas(score, "_tw string, label string, score double")
    return rows.select(*keys, "_tw").join(scored, "_tw").select(*keys, "label", "score")


def wide(scores: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """A row for each key with a column for each label, 0 where it has no score; columns are named s0, s1, ..."""
    return scores.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("label") == name, F.col("score"))), F.lit(0.0)).alias(f"s{i}") for i, name in enumerate(labels)])


def compliance_candidates(segments: DataFrame, agent: str, patterns: list[tuple[str, str, str | None]], negators: list[str], risky: list[str]) -> DataFrame:
    """(keys, text): an agent's lines, of more than five words, that no pattern flags, that hold a risky word and no negator; the part that is scored."""
    flagged = ca.compliance_violations(segments, agent, patterns, negators).select(*KEYS)
    denied = F.arrays_overlap(tx.tokens(F.col("text")), F.array(*[F.lit(n) for n in negators]).cast("array<string>"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    lines = segments.where((F.col("speaker").isNull() | (F.col("speaker") == agent)) & (words > 5) & ca.holds_any(F.col("text"), risky) & ~denied)
    return lines.join(flagged, KEYS, "left_anti").select(*KEYS, F.substring("text", 1, CANDIDATE_CHARS).alias("text"))


def scored_violations(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(keys, violation, severity): a misleading promise above 0.80 is HIGH, else a request for a password above 0.85 CRITICAL. scores(keys, label, score)."""
    rows = candidates.select(*KEYS).join(wide(scores, KEYS, [PROMISE[0], PASSWORD[0]]), KEYS)
    kind = F.when(F.col("s0") > PROMISE[1], PROMISE[0]).when(F.col("s1") > PASSWORD[1], PASSWORD[0])
    return rows.select(*KEYS, kind.alias("violation")).where("violation is not null").withColumn("severity", F.when(F.col("violation") == PROMISE[0], "HIGH").otherwise("CRITICAL"))


def churn_blocks(segments: DataFrame, customer: str, agent_phrases: list[str], anchors: list[str], rivals: list[str], lines: int = 5) -> DataFrame:
    """(conversation_id, chunk, text, wpm, weight, anchored): a customer's lines in blocks, as churn_chunks takes them, with the text to score.

    anchored: the block holds an anchor, or a rival's name as a word.
    """
    found = ca.churn_chunks(segments, customer, agent_phrases, ["-"], anchors, lines)
    from pyspark.sql.window import Window

    kept = segments.where((F.col("speaker") == customer) & (F.length(F.trim("text")) >= 3) & ~ca.holds_any(F.col("text"), agent_phrases))
    chunk = F.floor((F.row_number().over(Window.partitionBy("conversation_id").orderBy("segment_index")) - 1) / lines)
    texts = kept.withColumn("chunk", chunk).groupBy("conversation_id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"]), " ").alias("text"))
    named = F.arrays_overlap(tx.tokens(F.col("text")), F.array(*[F.lit(r) for r in rivals]).cast("array<string>"))
    return found.select("conversation_id", "chunk", "wpm", "weight").join(texts, ["conversation_id", "chunk"]).withColumn("anchored", ca.holds_any(F.col("text"), anchors) | named)


def scored_churn(blocks: DataFrame, scores: DataFrame, fast: tuple[float, float] = (190, 1.4), brisk: tuple[float, float] = (160, 1.2)) -> DataFrame:
    """(conversation_id, chunk, weight, risk): the scores of leaving and of switching, raised by pace and place, cut to a tenth below 0.85 without an anchor. scores(conversation_id, chunk, label, score)."""
    keys = ["conversation_id", "chunk"]
    pace = F.when(F.col("wpm") > fast[0], fast[1]).when(F.col("wpm") > brisk[0], brisk[1]).otherwise(1.0)
    rows = blocks.join(wide(scores, keys, LEAVING), keys, "left").withColumn("raw", F.least(F.lit(1.0), (F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0))) * pace * F.col("weight")))
    return rows.select(*keys, "wpm", "weight", F.when(~F.col("anchored") & (F.col("raw") < 0.85), F.col("raw") * 0.1).otherwise(F.col("raw")).alias("risk"))


def weigh_defensive(segments: DataFrame, agent: str, phrases: list[str], load: Callable[[], Model], least: float = 0.6, words: int = 3) -> DataFrame:
    """segments with `weighed`: whether a line's defensive phrases count. An agent's lines of more than three words that hold one do where the model's score for `defensive` is above 0.6, others always."""
    asked = segments.where((F.col("speaker") == agent) & (F.col("n_words") > words) & ca.holds_any(F.col("text"), [p.lower() for p in phrases]))
    scores = wide(score_with(asked.select(*KEYS, "text"), KEYS, load), KEYS, ["defensive"])
    return segments.join(scores, KEYS, "left").withColumn("weighed", F.coalesce(F.col("s0") > least, F.lit(True))).drop("s0")


def model_excerpt(text: Column) -> Column:
    """A text of up to 1024 characters whole, else its first and last 512."""
    return F.when(F.char_length(text) > 2 * EXCERPT_CHARS, F.concat(F.substring(text, 1, EXCERPT_CHARS), F.lit(" [SEP] "), F.right(text, F.lit(EXCERPT_CHARS)))).otherwise(text)


def negativity(texts: DataFrame, key: str, load: Callable[[], Model]) -> DataFrame:
    """(key, negative, band) of each text by a model with the labels positive and negative; a blank text has no score and the band `unknown`."""
    blank = F.coalesce(F.trim("text") == "", F.lit(True))
    scores = wide(score_with(texts.where(~blank).select(key, model_excerpt(F.col("text")).alias("text")), [key], load), [key], ["positive", "negative"])
    rows = texts.select(key, blank.alias("blank")).join(scores, key, "left")
    return rows.select(key, F.coalesce("s1", F.lit(0.0)).alias("negative"), F.when(F.col("blank"), "unknown").otherwise(ca.negativity_band(F.col("s0"), F.col("s1"))).alias("band"))


def blended(score: Column, hits: Column, words: Column) -> Column:
    """A struct of toxicity and its band from a model's score (null: none) and matched words: with a score at least min(0.99, 0.45 + 0.05 * hits) where there are hits, else min(0.95, 0.12 * hits + 2 * hits / words)."""
    alone = F.when((hits > 0) & (words > 0), F.least(F.lit(0.95), 0.12 * hits + 2.0 * hits / words)).otherwise(0.0)
    value = F.when(score.isNull(), alone).when(hits > 0, F.greatest(score, F.least(F.lit(0.99), 0.45 + 0.05 * hits))).otherwise(score)
    return F.struct(value.alias("score"), F.when(value > 0.7, "high").when(value > 0.4, "medium").otherwise("low").alias("band"))
