"""Live transcripts: partial and final utterances of a stream of timed frames, in event order whatever the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "session_id string, kind string, at long, start long, end long, text string"
FRAME = "ts timestamp, start long, end long, text string"
#: What a session carries from frame to frame: begin and end of what is pending, end of the last look, begin and end of its speech, its words.
STATE = "begin long, end long, since long, from_ long, spoken long, text string"
ORDER = ["start", "end", "text"]
#: A transcript is looked at in event order, so the state has to be kept by the provider that has lists and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Endpointing:
    """Times in milliseconds. A look: at most every `interval` of frames. Then pending frames without speech go once they are longer than
    `grace` or reach `most`; others are a final if `silence` follows the last speech or they reach `most`, else a partial. A gap of
    `idle` between frames, or none for so long, ends a session: what is pending with speech is a final."""

    interval: int = 900
    silence: int = 600
    most: int = 30_000
    grace: int = 1500
    idle: int = 30_000


def advance(held: tuple | None, frame: tuple, how: Endpointing) -> tuple[list[tuple], tuple | None]:
    """(rows (kind, at, start, end, text), what is held then) after a frame (start, end, text); an empty text is silence."""
    start, end, text = frame
    out = []
    if held is not None and start - held[1] >= how.idle:
        out, held = flush(held), None
    begin, last, since, from_, spoken, said = held or (start, end, start, None, None, "")
    last = max(last, end)
    if text:
        from_, spoken, said = start if from_ is None else from_, end if spoken is None else max(spoken, end), f"{said} {text}".strip()
    if last - since >= how.interval:
        forced = last - begin >= how.most
        if spoken is None:
            if forced or last - begin > how.grace:
                begin = since = last
        else:
            since = last
            final = forced or last - spoken >= how.silence
            out.append(("final" if final else "partial", last, from_, spoken, said))
            if final:
                begin, from_, spoken, said = spoken, None, None, ""
    return out, (begin, last, since, from_, spoken, said)


def flush(held: tuple | None) -> list[tuple]:
    """The row of what is pending when a session ends."""
    return [] if held is None or held[4] is None else [("final", held[1], held[3], held[4], held[5])]


def utterances(frames: DataFrame, how: Endpointing = Endpointing()) -> DataFrame:
    """OUT for a table of frames(session_id, start, end, text): the same rules as a fold in JVM functions, a session at a time.

    Frames are taken by start, end and text; a null text is silence, rows with a null time go. `at` is the end of the frame at which a row
    was known. A session is one row, as its transcript is.
    """
    fine = frames.where("session_id is not null and start is not null and end is not null")
    row = F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    kind = "struct<kind:string,at:bigint,start:bigint,end:bigint,text:string>"
    held_kind = "struct<begin:bigint,end:bigint,since:bigint,from_:bigint,spoken:bigint,text:string>"
    begin = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(None).cast(held_kind).alias("held"))
    none = F.lit(None).cast("long")

    def one(which, at, start, end, text) -> Column:
        return F.array(F.struct(which.alias("kind"), at.alias("at"), start.alias("start"), end.alias("end"), text.alias("text")))

    def ended(held: Column) -> Column:
        return F.when(held["spoken"].isNotNull(), one(F.lit("final"), held["end"], held["from_"], held["spoken"], held["text"])).otherwise(F.array().cast(f"array<{kind}>"))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), 0)

    def step(acc: Column, x: Column) -> Column:
        old, fresh = acc["held"], F.coalesce(acc["held"].isNull() | (x["start"] - acc["held"]["end"] >= how.idle), F.lit(True))
        take = lambda name, new: F.when(fresh, new).otherwise(old[name])
        spoke = x["text"] != ""
        now = F.struct(
            F.when(fresh & old.isNotNull(), F.concat(acc["out"], ended(old))).otherwise(acc["out"]).alias("out"),
            take("begin", x["start"]).alias("begin"),
            F.when(fresh, x["end"]).otherwise(F.greatest(old["end"], x["end"])).alias("end"),
            take("since", x["start"]).alias("since"),
            F.when(spoke, F.coalesce(take("from_", none), x["start"])).otherwise(take("from_", none)).alias("from_"),
            F.when(spoke, F.greatest(take("spoken", none), x["end"])).otherwise(take("spoken", none)).alias("spoken"),
            F.trim(F.concat(take("text", F.lit("")), F.lit(" "), x["text"])).alias("text"),
        )

        def looked(n: Column) -> Column:
            look, silent = n["end"] - n["since"] >= how.interval, n["spoken"].isNull()
            forced = n["end"] - n["begin"] >= how.most
            gone = look & silent & (forced | (n["end"] - n["begin"] > how.grace))
            shown = look & ~silent
            final = shown & (forced | (n["end"] - n["spoken"] >= how.silence))
            out = F.when(shown, F.concat(n["out"], one(F.when(final, "final").otherwise("partial"), n["end"], n["from_"], n["spoken"], n["text"]))).otherwise(n["out"])
            held = F.struct(
                F.when(gone, n["end"]).when(final, n["spoken"]).otherwise(n["begin"]).alias("begin"),
                n["end"].alias("end"),
                F.when(gone | shown, n["end"]).otherwise(n["since"]).alias("since"),
                F.when(final, none).otherwise(n["from_"]).alias("from_"),
                F.when(final, none).otherwise(n["spoken"]).alias("spoken"),
                F.when(final, F.lit("")).otherwise(n["text"]).alias("text"),
            )
            return F.struct(out.alias("out"), held.alias("held"))

        return let(now, looked)

    folded = fine.groupBy("session_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select("session_id", F.aggregate("rows", begin, step).alias("x"))
    return folded.select(F.col("session_id").cast("string").alias("session_id"), F.inline(F.concat("x.out", F.coalesce(F.when(F.col("x.held").isNotNull(), ended(F.col("x.held"))), F.array().cast(f"array<{kind}>")))))


class Endpoints(StatefulProcessor):
    """Frames wait in a list until the watermark has passed them, are then taken in order, and move what is held of the session."""

    def __init__(self, how: Endpointing):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", FRAME)
        self.held = handle.getValueState("held", STATE)

    def _timer(self, at: int) -> None:
        """One timer at a time: the earliest that is wanted."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _take(self, key: tuple, watermark: int, new: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        waiting = [tuple(r) for r in self.waiting.get()] + ([] if new is None else list(new[["ts", "start", "end", "text"]].itertuples(index=False, name=None)))
        stamp = lambda r: int(pd.Timestamp(r[0]).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(r[0]).tzinfo is None else int(pd.Timestamp(r[0]).timestamp() * 1000)
        ready = sorted((r for r in waiting if stamp(r) <= watermark), key=lambda r: (r[1], r[2], r[3] or ""))
        later = [r for r in waiting if stamp(r) > watermark]
        held = tuple(self.held.get()) if self.held.exists() else None
        held = None if held is None else tuple(None if pd.isna(v) else v for v in held)
        rows = []
        for _, start, end, text in ready:
            out, held = advance(held, (int(start), int(end), text or ""), self.how)
            rows += out
        if not later and held is not None and not ready and new is None:  # nothing came for as long as a session may be idle
            rows += flush(held)
            self.held.clear()
            held = None
        if later:
            self.waiting.put(later)
            self._timer(max(watermark + 1, min(map(stamp, later))))
        else:
            self.waiting.clear()
            if held is not None:
                last = max(map(stamp, ready), default=watermark)
                self._timer(max(watermark + 1, last + self.how.idle))
        if held is not None:
            self.held.update(held)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["session_id", "kind", "at", "start", "end", "text"])

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        new = pd.concat(list(rows))
        yield from self._take(key, watermark, new[new["start"].notna() & new["end"].notna()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._take(key, timerValues.getCurrentWatermarkInMs(), None)

    def close(self) -> None:
        pass


def endpoint_stream(frames: DataFrame, how: Endpointing = Endpointing(), late: str = "2 seconds") -> DataFrame:
    """OUT, a stream, from a stream of frames(session_id, ts, start, end, text); ts is the event time of the frame's end.

    A frame is taken once the watermark, `late` behind the latest event, has passed it, so frames that come late or out of order by less
    give the rows of the table's form; later ones are left out. A session's state is what waits and what is pending, and goes `idle`
    after its last frame. spark.sql.streaming.stateStore.providerClass has to be ROCKS.
    """
    rows = frames.select(F.col("session_id").cast("string").alias("session_id"), "ts", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withWatermark("ts", late).groupBy("session_id").transformWithStateInPandas(Endpoints(how), OUT, "append", "eventTime")
