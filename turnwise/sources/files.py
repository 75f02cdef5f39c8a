"""Files of annotations, speaker turns, evaluation sets and audio."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import calls as ca

REQUIRED = ["start_sec", "end_sec", "speaker"]
#: Columns of an annotation file that are looked at.
COLUMNS = 32
EXTENSIONS = ("wav", "mp3", "m4a", "aac", "ogg", "opus", "flac", "webm", "wma", "amr")


def _local(column: str):
    """A path that does not depend on how many slashes follow the scheme."""
    return F.regexp_replace(column, "^file:/+", "file:/")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(file) of all files under a path, those without a byte too, which Spark's sources pass over; the driver has this list anyway."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).inputFiles()
    return spark.createDataFrame([(n,) for n in names], "file string").select(_local("file").alias("file"))


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(turns, rejects) of CSV files with the columns start_sec, end_sec and speaker in any order among others, one file for each recording.

    turns(uri, line, t_start, t_end, speaker) in seconds, the uri is the file's name without its ending; rejects(uri, line, value, reason): a
    header without one of the columns (line 1, and then no other row of the file counts), no rows, times that are no numbers, an empty
    speaker, an end that is not after the start. Quoted fields may hold commas, not line breaks; blank lines do not count.
    """
    texts = spark.read.text(path, wholetext=True).select(_local("_metadata.file_path").alias("file"), "value")
    files = _listed(spark, path).join(texts, "file", "left").select(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1).alias("uri"), F.split(F.regexp_replace(F.coalesce("value", F.lit("")), "^\ufeff", ""), r"\r?\n", -1).alias("lines"))
    fields = lambda line: F.array(*[F.trim(F.from_csv(line, ", ".join(f"c{i} string" for i in range(COLUMNS)))[f"c{i}"]) for i in range(COLUMNS)])
    headed = files.withColumn("header", F.transform(fields(F.get("lines", 0)), F.lower))
    lacking = F.array_except(F.array(*[F.lit(c) for c in REQUIRED]), "header")
    rows = headed.withColumn("lacking", lacking).select("uri", "header", "lacking", F.posexplode("lines").alias("at", "value")).where("at > 0 and trim(value) <> '' and size(lacking) = 0")
    rows = rows.withColumn("f", fields(F.col("value")))
    part = lambda name: F.get("f", F.array_position("header", name) - 1)
    rows = rows.select("uri", (F.col("at") + 1).alias("line"), "value", part("start_sec").try_cast("double").alias("t_start"), part("end_sec").try_cast("double").alias("t_end"), F.coalesce(part("speaker"), F.lit("")).alias("speaker"))
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    reason = F.when(~number("t_start") | ~number("t_end"), "times are no numbers").when(F.col("speaker") == "", "no speaker").when(F.col("t_end") <= F.col("t_start"), "the end is not after the start")
    rows = rows.withColumn("reason", reason)
    bare = headed.withColumn("lacking", lacking).withColumn("n", F.size(F.filter(F.slice("lines", 2, F.size("lines")), lambda x: F.trim(x) != "")))
    heads = bare.select("uri", F.lit(1).alias("line"), F.get("lines", 0).alias("value"), F.when(F.size("lacking") > 0, F.concat(F.lit("the header lacks "), F.array_join("lacking", ", "))).when(F.col("n") == 0, "no rows").alias("reason")).where("reason is not null")
    return rows.where("reason is null").drop("reason", "value"), heads.unionByName(rows.where("reason is not null").select("uri", "line", "value", "reason"))


def write_rttm_files(turns: DataFrame, folder: str) -> None:
    """Speaker-turn files, one for each uri of turns(uri, t_start, t_end, speaker; seconds), ordered by start, in folders uri=...; a turn without length is left out."""
    millis = turns.withColumn("_s", F.col("t_start")).selectExpr("uri", "_s", "t_start * 1000 AS t_start", "t_end * 1000 AS t_end", "speaker")
    seconds = lambda ms: F.format_string("%.3f", ms / 1000.0)
    line = F.concat_ws(" ", F.lit("SPEAKER"), "uri", F.lit("1"), seconds(F.col("t_start")), seconds(F.col("t_end") - F.col("t_start")), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>"))
    rows = millis.where("t_end > t_start").select("uri", "_s", line.alias("value"))
    rows.repartition("uri").sortWithinPartitions("uri", "_s", "value").select("uri", "value").write.mode("overwrite").partitionBy("uri").text(folder)


def read_rttm_files(spark: SparkSession, path: str) -> DataFrame:
    """Turns (uri, start, duration, speaker; seconds) of speaker-turn files; a file without any is an error."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", _local("_metadata.file_path").alias("file"))
    full = lines.where(F.startswith("value", F.lit("SPEAKER "))).select("file").distinct()
    bare = _listed(spark, path).join(full, "file", "left_anti").limit(3).collect()
    if bare:
        raise ValueError(f"no speaker turns in {', '.join(r[0] for r in bare)}")
    return ca.read_rttm(lines.select("value"))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, domain, reference_text) of JSON arrays of objects; a file that is no such array, or an object without id or text, is an error."""
    rows = spark.read.schema("id string, domain string, reference_text string").option("multiLine", "true").option("mode", "FAILFAST").json(path)
    checked = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"an evaluation row without {c}")).cast("string")).alias(c)
    return rows.select(checked("id"), "domain", checked("reference_text"))


def _wav(f, size: int) -> dict:
    """Fields of a RIFF file; chunks are passed over unread."""
    at, found = 12, {}
    while at + 8 <= size:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            break
        kind, n = head[:4], struct.unpack("<I", head[4:])[0]
        if kind == b"fmt " and n >= 16:
            _, channels, rate, per_second, _, bits = struct.unpack("<HHIIHH", f.read(16))
            found |= {"channels": channels, "sample_rate": rate, "bits": bits, "_rate": per_second}
        elif kind == b"data":
            n = min(n, size - at - 8)  # a stream that was cut off, or never knew its length
            if found.get("_rate"):
                found["duration_s"] = n / found["_rate"]
            break
        at += 8 + n + n % 2
    return found


def _flac(f) -> dict:
    f.seek(4)
    head = f.read(4)
    info = f.read(34)
    if len(info) < 34 or head[0] & 127:
        return {}
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, bits, samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    return {"channels": channels, "sample_rate": rate, "bits": bits, "duration_s": samples / rate if rate and samples else None}


def audio_catalog(spark: SparkSession, path: str, most_mb: int = 300, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, name, extension, n_bytes, status, format, channels, sample_rate, bits, duration_s) of the files under a path.

    status is `accepted`, `too large` or `not an audio file` (by its ending). Of accepted WAV and FLAC files the header is read, some bytes
    of each whatever its size; other formats, and headers that say nothing, have null fields. Listing is Spark's, and no file is read whole.
    """
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_local("path").alias("file"), F.col("length").alias("n_bytes"))
    listed = _listed(spark, path).join(sizes, "file", "left").select(F.col("file").alias("path"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = listed.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).withColumn("extension", ending)
    files = files.withColumn("status", F.when(~F.col("extension").isin(list(extensions)), "not an audio file").when(F.col("n_bytes") > most_mb << 20, "too large").otherwise("accepted"))
    kinds = {"format": pa.string(), "channels": pa.int32(), "sample_rate": pa.int32(), "bits": pa.int32(), "duration_s": pa.float64()}

    def headers(batches):
        for batch in batches:
            rows = []
            for name, size, status in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "status")), strict=True):
                found = {}
                if status == "accepted" and size:
                    fs, where = FileSystem.from_uri(name.replace("file:/", "file:///", 1))
                    with fs.open_input_file(where) as f:
                        magic = f.read(12)
                        if magic[:4] == b"RIFF" and magic[8:] == b"WAVE":
                            found = {"format": "wav"} | _wav(f, size)
                        elif magic[:4] == b"fLaC":
                            found = {"format": "flac"} | _flac(f)
                rows.append(found)
            columns = [batch.column(c) for c in batch.schema.names] + [pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *kinds])

    schema = "path string, n_bytes long, name string, extension string, status string, format string, channels int, sample_rate int, bits int, duration_s double"
    return files.mapInArrow(headers, schema)


def batch_report(rows: DataFrame) -> DataFrame:
    """(sector, recording, kind, line): a report's lines, one for each recording, sector (`sector`) and all (`total`), in one pass.

    rows(sector, recording, elapsed_s, confidence, quality, passes, filtered, errors, words, toxicity, negative, profane, error): null errors
    and words are of a recording without a reference, a null error of one that went well. A recording's rows are added up; sums are over
    what went well.
    """
    fine = F.col("error").isNull()
    of_fine = lambda c: F.when(fine, F.col(c))
    found = rows.rollup("sector", "recording").agg(
        F.grouping_id().alias("g"), F.count_if(fine).alias("done"), F.count_if(~fine).alias("failed"), F.max("error").alias("error"), F.coalesce(F.sum(of_fine("elapsed_s")), F.lit(0.0)).alias("elapsed_s"),
        F.avg(of_fine("confidence")).alias("confidence"), F.avg(of_fine("quality")).alias("quality"), F.count_if(fine & F.col("passes")).alias("passed"), F.coalesce(F.sum(of_fine("filtered")), F.lit(0)).alias("filtered"),
        F.sum(of_fine("errors")).alias("errors"), F.sum(of_fine("words")).alias("words"), F.max(of_fine("negative")).alias("negative"), F.max_by("toxicity", F.struct(of_fine("negative"), "toxicity")).alias("toxicity"), F.coalesce(F.sum(of_fine("profane")), F.lit(0)).alias("profane"),
    )
    wer = F.when(F.col("words") > 0, F.format_string(" | WER %.1f %%", F.round(100.0 * F.col("errors") / F.col("words"), 1))).otherwise("")
    good = F.concat(F.format_string("%.1f s | confidence %.1f %% | quality %.0f %% | ", *[F.round(c, n) for c, n in (("elapsed_s", 1), ("confidence", 1), ("quality", 0))]), F.when(F.col("g") > 0, F.format_string("%d of %d passed", "passed", "done")).when(F.col("passed") > 0, "passed").otherwise("review"), F.format_string(" | filtered %d", "filtered"), wer, F.format_string(" | toxicity %s (%.1f %%) | profane %d", "toxicity", F.round(100.0 * F.col("negative"), 1), "profane"))
    name = F.when(F.col("g") == 0, F.concat_ws(" / ", "sector", "recording")).when(F.col("g") == 1, F.col("sector")).otherwise("all")
    body = F.when(F.col("done") > 0, F.concat(good, F.when((F.col("g") > 0) & (F.col("failed") > 0), F.format_string(" | %d failed", "failed")).otherwise(""))).when(F.col("g") == 0, F.concat(F.lit("error: "), "error")).otherwise(F.format_string("%d failed", "failed"))
    return found.select("sector", "recording", F.when(F.col("g") == 0, "recording").when(F.col("g") == 1, "sector").otherwise("total").alias("kind"), F.concat(F.lit("["), name, F.lit("] "), body).alias("line"))
