"""Stored analyses: three tables that change together, one folder for each commit, seen once its marker is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the three tables; ids are strings.
TABLES = {
    "conversations": "conversation_id string, agent_id string, sector string, duration_sec double, full_transcript string, asr_confidence double, quality_gate_passed boolean, status string, error_message string, metadata_json string",
    "segments": "segment_id string, conversation_id string, segment_index long, start double, end double, text string, speaker string, avg_logprob double, raw_text string",
    "hits": "hit_id string, conversation_id string, segment_id string, rule_id string, topic_id string, matched_text string, keyword string, match_type string, confidence double, timestamp_sec double, speaker string, context_before string",
}


def analysis_rows(calls: DataFrame, segments: DataFrame, hits: DataFrame) -> dict[str, DataFrame]:
    """The rows of the three tables for analysed calls.

    calls has the columns of `conversations` but for status and error_message; segments(conversation_id, segment_index, start_ms, end_ms,
    text, speaker, avg_logprob, raw_text) and hits(conversation_id, segment_index, rule_id, topic_id, keyword, matched_text, match_type,
    confidence, context) may lack topic_id and raw_text. Keys are hashes of what they stand for, so the same analysis gives the same keys;
    a hit has the key of its line, null where the line is not there. A missing speaker is SPEAKER_00, a missing likelihood -1.
    """
    optional = lambda df, c, default: F.coalesce(F.col(c), F.lit(default)).cast("string").alias(c) if c in df.columns else F.lit(default).cast("string").alias(c)
    key = F.sha2(F.concat_ws(":", F.col("conversation_id").cast("string"), "segment_index"), 256)
    lines = segments.select(key.alias("segment_id"), F.col("conversation_id").cast("string").alias("conversation_id"), "segment_index", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", F.coalesce("speaker", F.lit("SPEAKER_00")).alias("speaker"), F.coalesce("avg_logprob", F.lit(-1.0)).alias("avg_logprob"), optional(segments, "raw_text", ""))
    of_line = lines.select("segment_id", "conversation_id", "segment_index", F.col("start").alias("timestamp_sec"), "speaker")
    found = hits.select(F.col("conversation_id").cast("string").alias("conversation_id"), "segment_index", "rule_id", optional(hits, "topic_id", None), "keyword", "matched_text", "match_type", F.col("confidence").cast("double").alias("confidence"), F.substring("context", 1, 120).alias("context_before"))
    found = found.join(of_line, ["conversation_id", "segment_index"], "left").withColumn("hit_id", F.sha2(F.concat_ws(":", "conversation_id", "segment_index", "rule_id", "matched_text"), 256))
    done = calls.withColumn("conversation_id", F.col("conversation_id").cast("string")).withColumn("status", F.lit("completed")).withColumn("error_message", F.lit(None).cast("string"))
    rows = {"conversations": done, "segments": lines, "hits": found}
    return {name: rows[name].select(*[c.split()[0] for c in TABLES[name].split(", ")]) for name in TABLES}


class AnalysisStore:
    """Conversations, segments and hits under a folder that driver and executors share.

    A commit writes its rows of each table to a folder of its own and then a marker, whose name is the next free number; creating it
    either works or, where another writer was first, fails and takes the number after. Readers see the rows of commits with a marker, and
    of each call those of its last commit: a commit that broke off changes nothing, may be tried again under its name, and a name that
    is committed is not written twice. Rows of a null conversation_id are kept, never replaced.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marked(self) -> list[tuple[int, str]]:
        """(number, commit) of the markers; compact() keeps them few."""
        folder = self._path(f"{self.root}/_commits")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted((int(n[:12]), n[13:]) for n in names if n[:12].isdigit())

    def commits(self) -> list[str]:
        return [c for _, c in self._marked()]

    def _mark(self, commit: str) -> None:
        folder = f"{self.root}/_commits"
        self.fs.mkdirs(self._path(folder))
        number = max((n for n, _ in self._marked()), default=0) + 1
        while not self.fs.createNewFile(self._path(f"{folder}/.{number:012d}")):  # an empty hidden file claims the number
            number += 1
        self.fs.createNewFile(self._path(f"{folder}/{number:012d}.{commit}"))

    def write(self, commit: str, rows: dict[str, DataFrame], update: bool = False) -> bool:
        """Commit the rows of the three tables; False if the commit is there already. With `update`, every call has to be stored, if only as a placeholder."""
        if not commit or any(c in commit for c in "/=:%\n"):
            raise ValueError(f"not a name for a commit: {commit!r}")
        if commit in self.commits():
            return False
        if update:
            known = self.read("conversations").select("conversation_id")
            lost = [r[0] for r in rows["conversations"].select("conversation_id").distinct().join(known, "conversation_id", "left_anti").limit(3).collect()]
            if lost:
                raise ValueError(f"calls to update are not stored, such as {', '.join(map(str, lost))}")
        for name in TABLES:
            self._as_stored(rows[name], name).write.mode("overwrite").parquet(f"{self.root}/{name}/commit={commit}")
        self._mark(commit)
        return True

    def _as_stored(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in (part.split() for part in TABLES[name].split(", "))])

    def open_calls(self, commit: str, calls: DataFrame) -> bool:
        """Placeholders of calls(conversation_id, and what is known of the other columns) whose analysis is under way."""
        have = {c: F.col(c) if c in calls.columns else F.lit(None) for c, _ in (part.split() for part in TABLES["conversations"].split(", "))}
        rows = calls.select(*[(F.lit("processing") if c == "status" else v).alias(c) for c, v in have.items()])
        none = {name: self.spark.createDataFrame([], TABLES[name]) for name in ("segments", "hits")}
        return self.write(commit, {"conversations": rows, **none})

    def read(self, name: str) -> DataFrame:
        """The rows of a table that count."""
        marked = self._marked()
        if not marked:
            return self.spark.createDataFrame([], TABLES[name])
        numbers = F.broadcast(self.spark.createDataFrame(marked, "number long, commit string"))
        stored = lambda table: self.spark.read.schema(f"{TABLES[table]}, commit string").option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/commit={c}" for _, c in marked])
        latest = stored("conversations").select("conversation_id", "commit").join(numbers, "commit").where("conversation_id is not null").groupBy("conversation_id").agg(F.max_by("commit", "number").alias("last"))
        rows = stored(name)
        return rows.join(latest, "conversation_id", "left").where(F.col("last").isNull() | (F.col("last") == F.col("commit"))).select(*[c.split()[0] for c in TABLES[name].split(", ")])

    def compact(self, commit: str) -> None:
        """Write what counts as one commit and remove the commits before it. Readers that began earlier lose their files, so run it when there are none."""
        before = self._marked()
        self.write(commit, {name: self.read(name) for name in TABLES})
        for number, old in before:
            if old != commit:
                for marker in (f"{number:012d}.{old}", f".{number:012d}"):
                    self.fs.delete(self._path(f"{self.root}/_commits/{marker}"), False)
                for name in TABLES:
                    self.fs.delete(self._path(f"{self.root}/{name}/commit={old}"), True)
