"""Transcripts as they are shown, exported, corrected and prepared: details of calls, turns by pauses, paragraphs, regions, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnwise.operators import governance as gov

CALL = "conversation_id"
KEYS = ["conversation_id", "segment_index"]
#: Shown names of speakers, pauses in milliseconds that end a turn, words of a paragraph without sentences, the level of silence.
NAMES = {"SPEAKER_00": "Temsilci", "SPEAKER_01": "Müşteri", "SPEAKER_02": "Uzman"}
LONG_PAUSE, QUESTION_PAUSE, ANSWER_PAUSE = 1500, 400, 350
PARAGRAPH_WORDS, QUIET_RMS = 70, 0.006


def _ordered(*columns: Column) -> Column:
    """An array of a call's lines by start, then place."""
    lines = F.sort_array(F.collect_list(F.struct("start_ms", "segment_index", F.struct(*columns).alias("line"))))
    return F.transform(lines, lambda x: x["line"])


def shown_name(speaker: Column) -> Column:
    found = speaker
    for name, to in NAMES.items():
        found = F.when(speaker == name, to).otherwise(found)
    return F.when(F.coalesce(speaker, F.lit("")) == "", "Konuşmacı").when(F.contains(speaker, F.lit("IVR")), "IVR").otherwise(found)


def export_json(segments: DataFrame) -> DataFrame:
    """(conversation_id, json): the call's head and its lines by start, times in seconds; the file of a data request."""
    line = [(F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", "speaker"]
    calls = segments.groupBy(CALL).agg(F.max("created_at").alias("created_at"), F.max("sector").alias("sector"), (F.max("end_ms") / 1000.0).alias("duration_sec"), _ordered(*line).alias("segments"))
    head = F.struct(F.col(CALL).alias("id"), F.array_join(F.transform("segments", lambda x: x["text"]), " ").alias("full_transcript"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "sector", "duration_sec")
    return calls.select(CALL, F.to_json(F.struct(head.alias("conversation"), "segments"), {"ignoreNullFields": "false"}).alias("json"))


def export_text(segments: DataFrame) -> DataFrame:
    """(conversation_id, text): a head of two lines and a blank one, then `[mm:ss] name: text` for each line by start."""
    at = F.floor(F.col("start_ms") / 1000)
    line = F.concat(F.format_string("[%02d:%02d] ", F.floor(at / 60), at % 60), shown_name(F.col("speaker")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("l")
    calls = segments.groupBy(CALL).agg(F.max("created_at").alias("c"), F.max("sector").alias("s"), F.max("end_ms").alias("e"), _ordered(line).alias("lines"))
    head = F.format_string("# Görüşme %s\n# Tarih: %s | Sektör: %s | Süre: %.0fs\n\n", F.col(CALL).cast("string"), F.date_format("c", "yyyy-MM-dd'T'HH:mm:ss"), "s", F.round(F.col("e") / 1000.0, 0))
    return calls.select(CALL, F.concat(head, F.array_join(F.transform("lines", lambda x: x["l"]), "\n")).alias("text"))


def conversation_full(segments: DataFrame, hits: DataFrame) -> DataFrame:
    """Each call with its lines by start, its hits(conversation_id, hit_id, keyword, topic, created_at) by time, and its different topics in order."""
    lines = segments.groupBy(CALL).agg(F.max("sector").alias("sector"), F.max("agent_id").alias("agent_id"), F.max("end_ms").alias("duration_ms"), _ordered(F.col("segment_index"), F.col("speaker"), F.col("text")).alias("lines"))
    found = hits.groupBy(CALL).agg(F.sort_array(F.collect_list(F.struct("created_at", "hit_id", "keyword", "topic"))).alias("hits"), F.array_sort(F.collect_set("topic")).alias("topics"))
    none = F.array().cast(dict(found.dtypes)["hits"])
    return lines.join(found, CALL, "left").withColumn("hits", F.coalesce("hits", none)).withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))


def list_visible(segments: DataFrame, hits: DataFrame, users: DataFrame, username: str, sector: str, k: int = 200) -> DataFrame:
    """The newest calls of a sector among those that a user may see (governance.scope_conversations, governance.list_conversations)."""
    seen = gov.scope_conversations(segments.select(CALL, "agent_id").distinct(), users, username).select(CALL)
    return gov.list_conversations(segments.join(seen, CALL, "left_semi"), hits, sector, k)


def text_so_far(segments: DataFrame) -> DataFrame:
    """(keys, text): what a call's lines have said up to and with each; as many characters as that is."""
    upto = Window.partitionBy(CALL).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, 0)
    return segments.select(*KEYS, F.array_join(F.collect_list("text").over(upto), " ").alias("text"))


def text_turns(segments: DataFrame, question_endings: list[str], answer_starts: list[str]) -> DataFrame:
    """(keys, turn_group, speaker): turns by pauses, told apart without sound, the two speakers by turns; a line that has a speaker keeps it.

    A turn begins behind a pause of over 1.5 s, of over 0.4 s where the line before asks (a question mark anywhere, or an ending), or of over
    0.35 s where the line answers.
    """
    order = Window.partitionBy(CALL).orderBy("segment_index")
    low = F.lower(F.trim(F.coalesce("text", F.lit(""))))
    any_of = lambda listed, test: F.exists(F.array(*[F.lit(x) for x in listed]).cast("array<string>"), test)
    rows = segments.select(*KEYS, "start_ms", "end_ms", "speaker", low.alias("t"))
    rows = rows.withColumn("asks", F.contains("t", F.lit("?")) | any_of(question_endings, lambda q: F.endswith("t", q))).withColumn("answers", any_of(answer_starts, lambda a: F.startswith("t", a)))
    pause = F.col("start_ms") - F.lag("end_ms").over(order)
    new = (pause > LONG_PAUSE) | ((pause > QUESTION_PAUSE) & F.lag("asks").over(order)) | ((pause > ANSWER_PAUSE) & F.col("answers"))
    rows = rows.withColumn("new", F.coalesce(new, F.lit(False)).cast("long")).withColumn("turn_group", F.sum("new").over(order))
    speaker = F.when(F.coalesce("speaker", F.lit("")) != "", F.col("speaker")).when(F.col("turn_group") % 2 == 0, "SPEAKER_00").otherwise("SPEAKER_01")
    return rows.select(*KEYS, "turn_group", speaker.alias("speaker"))


def paragraphs(texts: DataFrame, key: str, sentences: int = 4) -> DataFrame:
    """(key, paragraph, text): four sentences each; a text of one sentence in runs of 70 words. Blanks count as one; blank and null texts have none."""
    whole = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    parts = F.filter(F.split(whole, r"(?<=[.!?])\s+", -1), lambda s: s != "")
    rows = texts.select(key, parts.alias("p"), F.filter(F.split(whole, " ", -1), lambda w: w != "").alias("w")).where(F.size("w") > 0)

    def cut(items: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(items, i * n + 1, F.lit(n)), " "))

    return rows.select(key, F.posexplode(F.when(F.size("p") <= 1, cut("w", PARAGRAPH_WORDS)).otherwise(cut("p", sentences))).alias("paragraph", "text"))


def sentence_words(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(keys, part, words): of each part(keys, part, start_ms, end_ms) of a line, the words(keys, word, w_start, w_end) of the line that its time touches, in order; a word on a cut is in both parts."""
    met = parts.join(words, KEYS).where("w_start < end_ms and w_end > start_ms").groupBy(*KEYS, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("w_start", "word"))), lambda x: x["word"]).alias("words"))
    return parts.select(*KEYS, "part").join(met, [*KEYS, "part"], "left").withColumn("words", F.coalesce("words", F.array().cast(dict(met.dtypes)["words"])))


def speech_regions(calls: DataFrame, spans: DataFrame, pad_ms: int = 300, gap_ms: int = 3000) -> DataFrame:
    """(conversation_id, region, start_ms, end_ms) to decode of calls(conversation_id, length_ms, rms), from detected speech spans(conversation_id, start_ms, end_ms).

    Spans are padded within the call and joined over pauses of `gap_ms`. A call without spans has none if it is quiet (RMS under 0.006),
    else one region, all of it: the detector may have failed.
    """
    padded = spans.join(calls.select(CALL, "length_ms"), CALL).select(CALL, F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("s"), F.least("length_ms", F.col("end_ms") + pad_ms).alias("e"))
    order = Window.partitionBy(CALL).orderBy("s", "e")
    fresh = padded.withColumn("till", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("new", F.coalesce(F.col("s") - F.col("till") > gap_ms, F.lit(True)).cast("long"))
    found = fresh.withColumn("region", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(CALL, "region").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"))
    bare = calls.join(spans.select(CALL).distinct(), CALL, "left_anti").where(F.col("rms") >= QUIET_RMS)
    return found.unionByName(bare.select(CALL, F.lit(1).cast("long").alias("region"), F.lit(0).cast("long").alias("start_ms"), F.col("length_ms").alias("end_ms")))


def supervisors(segments: DataFrame, agent: str, customer: str) -> DataFrame:
    """(conversation_id, speakers, supervisor): the first speaker by name that is neither role, where there are more than two; else null."""
    named = F.array_sort(F.array_compact(F.collect_set(F.when(F.col("speaker") != "", F.col("speaker")))))
    others = F.filter("names", lambda s: ~s.isin(agent, customer))
    return segments.groupBy(CALL).agg(named.alias("names")).select(CALL, F.size("names").alias("speakers"), F.when(F.size("names") > 2, F.get(others, 0)).alias("supervisor"))


def rescue_lines(segments: DataFrame, below: float = -0.5, most: int = 8, suspects: int = 2) -> DataFrame:
    """(keys, speaker, rank, suspects, context): a channel's first lines to decode again, 0.3 to 15 s long.

    A line is doubtful below a known likelihood, or with two suspect words in words(word, probability): of four letters or more, under 0.4.
    context is the latest earlier text of the call that is not doubtful by its likelihood, else empty.
    """
    before = Window.partitionBy(CALL).orderBy("segment_index").rowsBetween(Window.unboundedPreceding, -1)
    context = F.last(F.when((F.col("avg_logprob") >= below) & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(before)
    known = F.coalesce(F.col("avg_logprob"), F.lit(-1.0))
    low = (known != -1.0) & (known < below)
    odd = F.coalesce(F.size(F.filter("words", lambda w: (F.char_length(F.regexp_replace(w["word"], r"(?U)\W", "")) >= 4) & (F.coalesce(w["probability"], F.lit(1.0)) < 0.4))), F.lit(0))
    rows = segments.withColumn("context", F.coalesce(context, F.lit(""))).withColumn("suspects", F.when(low, 0).otherwise(odd).cast("long"))
    rows = rows.where((low | (F.col("suspects") >= suspects)) & F.col("dur_ms").between(300, 15_000))
    rank = F.row_number().over(Window.partitionBy(CALL, "speaker").orderBy("segment_index"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select(*KEYS, "speaker", "rank", "suspects", "context")


def second_pass(calls: DataFrame, gate: float = 0.45, audio_gate: float = 78.0) -> DataFrame:
    """(conversation_id, again): calls(conversation_id, confidence, audio_score, filtered) whose confidence or sound is poor, or that lost a line to a filter; what is null does not count."""
    poor = (F.col("confidence") < gate) | (F.col("audio_score") < audio_gate) | (F.col("filtered") > 0)
    parts = [F.coalesce(F.col("confidence") < gate, F.lit(False)), F.coalesce(F.col("audio_score") < audio_gate, F.lit(False)), F.coalesce(F.col("filtered") > 0, F.lit(False))]
    return calls.select(CALL, F.coalesce(poor, parts[0] | parts[1] | parts[2]).alias("again"))


def correct_speakers(segments: DataFrame, words: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, words, log) after corrections(keys, new_speaker, corrected_at, corrected_by, reason).

    The latest correction of a line (ties: the larger name) gives its speaker, and that of its words that had the old one. The log has a row
    for each correction, in order (`n`, from 1), with the speaker that it found; a correction of a line that is not there has none.
    """
    order = Window.partitionBy(*KEYS).orderBy("corrected_at", "new_speaker")
    log = corrections.join(segments.select(*KEYS, F.col("speaker").alias("_own")), KEYS).withColumn("n", F.row_number().over(order))
    log = log.withColumn("old_speaker", F.coalesce(F.lag("new_speaker").over(order), "_own"))
    last = log.groupBy(*KEYS).agg(F.max_by("new_speaker", "n").alias("_new"), F.max("_own").alias("_old"))
    fixed = segments.join(last.drop("_old"), KEYS, "left").withColumn("speaker", F.coalesce("_new", "speaker")).select(*segments.columns)
    spoken = words.join(last, KEYS, "left").withColumn("speaker", F.when(F.col("_new").isNotNull() & (F.col("speaker") == F.col("_old")), F.col("_new")).otherwise(F.col("speaker"))).select(*words.columns)
    return fixed, spoken, log.select(*KEYS, F.col("n").cast("long").alias("n"), "old_speaker", "new_speaker", "corrected_by", "reason")


def price_points(text: Column, units: list[str], cues: list[str], low: int = 50, high: int = 100_000) -> Column:
    """Different amounts of two to four digits before a unit or behind a cue, case-folded, largest first."""
    alone = lambda listed: "|".join(r"\Q" + x + r"\E" for x in listed)
    before = F.regexp_extract_all(text, F.lit(rf"(?i)\b(\d{{2,4}})\s*(?:{alone(units)})"), F.lit(1))
    behind = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{alone(cues)})\s*(\d{{2,4}})\b"), F.lit(1))
    amounts = F.transform(F.concat(before, behind), lambda x: x.cast("long"))
    return F.sort_array(F.array_distinct(F.filter(amounts, lambda x: x.between(low, high))), asc=False)


def exact_split(ids: DataFrame, key: str, seed: int, share: float) -> DataFrame:
    """(key, split): of all different keys, max(1, round(N * share)) by smallest keyed hash go to `development`, the others to `train`.

    Only the counts of 65,536 hash prefixes meet in one task; the exact cut is made inside the one prefix where it falls. Fewer than
    two keys, or none left to train on, is an error.
    """
    rows = ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_p", F.substring("_h", 1, 4))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    n = rows.count()
    held = max(1, round(n * share))
    if n < 2 or held >= n:
        raise ValueError(f"{n} recordings cannot be split with a share of {share}")
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    at = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)) + F.col("_before")
    return rows.join(before, "_p").select(key, F.when(at <= held, "development").otherwise("train").alias("split"))


def protocol_lines(split: DataFrame, recordings: DataFrame, turns: DataFrame) -> DataFrame:
    """(split, kind, uri, at, value): the lines of the lst, uem and rttm files of a protocol, for the recordings(uri, duration_sec) of split(uri, split) that are there and have turns(uri, value) lines."""
    known = split.join(recordings, "uri").join(turns.select("uri").distinct(), "uri", "left_semi")
    one = lambda kind, value: known.select("split", F.lit(kind).alias("kind"), "uri", F.lit(0.0).alias("at"), value.alias("value"))
    spoken = known.select("split", "uri").join(turns, "uri").select("split", F.lit("rttm").alias("kind"), "uri", F.split("value", " ")[3].cast("double").alias("at"), "value")
    return one("lst", F.col("uri")).unionByName(one("uem", F.format_string("%s 1 0.000 %.3f", "uri", "duration_sec"))).unionByName(spoken)


def write_protocol(lines: DataFrame, folder: str) -> None:
    """One folder for each split and kind, its lines by recording and start."""
    lines.repartition("split", "kind").sortWithinPartitions("split", "kind", "uri", "at", "value").select("split", "kind", "value").write.mode("overwrite").partitionBy("split", "kind").text(folder)


def write_report(scores: DataFrame, folder: str, rate: str, most: float) -> bool:
    """Write scores(recording, errors, total, rate) as `rows` and `summary` in JSON and as a Markdown table; whether the overall rate passes at `most`.

    Rows and tables are written by Spark in as many files as the scores have partitions, the summary as one row.
    """
    from turnwise.operators.evaluation import evaluation_report

    summary = evaluation_report(scores, rate, most)
    scores.write.mode("overwrite").json(f"{folder}/rows")
    summary.write.mode("overwrite").json(f"{folder}/summary")
    table = scores.select(F.format_string("| %s | %d | %d | %.4f |", F.col("recording").cast("string"), "errors", "total", rate).alias("value"))
    scores.sparkSession.createDataFrame([("| recording | errors | total | rate |",), ("|---|---|---|---|",)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown/head")
    table.write.mode("overwrite").text(f"{folder}/markdown/rows")
    return bool(summary.first()["passes"])
