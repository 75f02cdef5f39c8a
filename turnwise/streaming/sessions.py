"""Live sessions: utterances by silence, coaching alerts, and a sink of what was committed. Rules are those of the batch forms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTTERANCE = "session_id string, kind string, start double, end double, text string"
ALERT = "session_id string, chunk long, alert string"


def cut_utterances(pending: list | None, words: list[tuple[float, float, str]], silence: float, most: float) -> tuple[list, list | None]:
    """(finished utterances, the one still open) after these words in order; an utterance is [start, end, text]."""
    done = []
    for start, end, text in words:
        if pending is not None and (start - pending[1] >= silence or end - pending[0] > most):
            done.append(pending)
            pending = None
        pending = [start, end, text] if pending is None else [pending[0], max(pending[1], end), f"{pending[2]} {text}"]
    return done, pending


def utterances(words: DataFrame, silence: float = 0.6, most: float = 30.0) -> DataFrame:
    """(session_id, start, end, text) of words(session_id, start, end, text), seconds: cut at silences, and before one would be longer than `most`."""
    row = F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.col("text"))
    kind = "struct<start:double,end:double,text:string>"
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(kind).alias("held"))

    def step(acc, x):
        held = acc["held"]
        cut = held.isNotNull() & ((x["start"] - held["end"] >= silence) | (x["end"] - held["start"] > most))
        joined = F.struct(held["start"].alias("start"), F.greatest(held["end"], x["end"]).alias("end"), F.concat_ws(" ", held["text"], x["text"]).alias("text"))
        return F.struct(F.when(cut, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"), F.when(held.isNull() | cut, x).otherwise(joined).alias("held"))

    # a session is one row, as its transcript is
    folded = words.groupBy("session_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("session_id", F.aggregate("rows", begin, step).alias("x"))
    return folded.select("session_id", F.inline(F.array_compact(F.concat("x.out", F.array("x.held")))))


def endpoint_utterances(words: DataFrame, silence: float = 0.6, most: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """A stream of (session_id, kind, start, end, text) from a stream of words(session_id, ts, start, end, text), ts the event time.

    kind is `final` for an utterance that a silence or `most` seconds ended, and `partial` for what is open after a batch. A session
    without words until the watermark has passed its last one is over: what is open is then final. Only the open utterance is state.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = list(state.get) if state.exists else None
        if state.hasTimedOut:
            done, pending = [pending] if pending else [], None
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["start", "end"])
            done, pending = cut_utterances(pending, list(zip(rows["start"], rows["end"], rows["text"], strict=True)), silence, most)
            state.update(tuple(pending))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["ts"].max().timestamp() * 1000) + int(silence * 1000)))
        shown = [(key[0], "final", *u) for u in done] + ([(key[0], "partial", *pending)] if pending else [])
        yield pd.DataFrame(shown, columns=["session_id", "kind", "start", "end", "text"])

    return words.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(update, UTTERANCE, "start double, end double, text string", "append", "EventTimeTimeout")


def coach(state: dict, chunk: int, text: str, elapsed_s: float, cut: bool, escalation: list[str], consent: list[str], after_s: float) -> str | None:
    """The alert of one chunk, if any; state is changed."""
    text = (text or "").lower().strip()
    fresh = next((p for p in escalation if p in text and p not in state["seen"]), None)
    if fresh:
        state["seen"].append(fresh)
        return f"escalation:{fresh}"
    if cut:
        state["cuts"] += 1
        if state["cuts"] >= 2 and "interruption" not in state["seen"]:
            state["seen"].append("interruption")
            return "interruption"
    state["consent"] = state["consent"] or any(p in text for p in consent)
    if elapsed_s > after_s and not state["consent"] and "consent" not in state["seen"]:
        state["seen"].append("consent")
        return "consent"
    return None


def coaching_stream(chunks: DataFrame, escalation: list[str], consent: list[str], after_s: float = 15.0, late: str = "1 minute") -> DataFrame:
    """A stream of (session_id, chunk, alert) from a stream of chunks(session_id, chunk, ts, text, elapsed_s, is_interruption); a session's state goes once the watermark has left it behind."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"seen": [], "cuts": 0, "consent": False}
        rows = pd.concat(list(batches)).sort_values("chunk")
        found = [(key[0], int(r.chunk), coach(held, r.chunk, r.text, r.elapsed_s, bool(r.is_interruption), escalation, consent, after_s)) for r in rows.itertuples() if r.text]
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["ts"].max().timestamp() * 1000) + 60_000))
        yield pd.DataFrame([f for f in found if f[2]], columns=["session_id", "chunk", "alert"])

    return chunks.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(update, ALERT, "held string", "append", "EventTimeTimeout")


def persist_finals(found: DataFrame, folder: str, checkpoint: str):
    """Write the final utterances of a stream under `folder`, a folder for each batch, so that a batch that runs again replaces itself. Gives the writer, to be started."""
    def save(batch: DataFrame, number: int) -> None:
        batch.where("kind = 'final'").drop("kind").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return found.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, text, duration) of what persist_finals has written."""
    rows = spark.read.schema("session_id string, start double, end double, text string, batch int").parquet(folder)
    return rows.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ").alias("text"), F.max("end").alias("duration"))
