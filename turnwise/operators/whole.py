"""Whole calls from segments to results: one scan, lines kept in buckets by call, each step a stored table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.functions import pii
from turnwise.operators import calls as ca
from turnwise.operators import evaluation as ev
from turnwise.operators import keywords as kw
from turnwise.operators import segments as seg

CALL = "conversation_id"
KEYS = ["conversation_id", "segment_index"]
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class CallRules:
    """What calls are held against: rule and topic tables, and short lists of phrases."""

    rules: DataFrame
    topics: DataFrame
    synonyms: DataFrame | None = None
    agent: str = "SPEAKER_00"
    customer: str = "SPEAKER_01"
    skills: dict[str, list[str]] = field(default_factory=dict)
    fast: int = 170
    patterns: list[tuple[str, str, str | None]] = field(default_factory=list)
    negators: list[str] = field(default_factory=list)
    toxic: list[str] = field(default_factory=list)
    shields: list[str] = field(default_factory=list)
    discourse: dict[str, list[str]] = field(default_factory=dict)
    agent_phrases: list[str] = field(default_factory=list)
    churn_words: list[str] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)
    block: int = 5
    rivals: list[str] = field(default_factory=list)
    own_names: list[str] = field(default_factory=list)
    #: Ways of telling speakers apart that scores may rest on; null of a call is none of them.
    trusted: tuple[str, ...] = ("neural", "stereo")


class Buckets:
    """Tables under a folder, in as many buckets of a call's id; what is grouped or joined by call afterwards is not shuffled again."""

    def __init__(self, df: DataFrame, folder: str, n: int | None = None):
        self.spark, self.folder, self.names = df.sparkSession, f"{folder}/turnwise-{uuid.uuid4().hex}", []
        self.paths: dict[int, str] = {}
        self.n = n or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _stored(self, write: Callable[[], None]) -> None:
        was = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")  # what is stored replaces the shuffle files
        try:
            write()
        finally:
            self.spark.conf.set(_CLEAN, was)

    def table(self, df: DataFrame) -> DataFrame:
        name = f"turnwise_{uuid.uuid4().hex}"
        rows = df.repartition(self.n, CALL).write.bucketBy(self.n, CALL).option("path", f"{self.folder}/{name}").option("compression", "zstd")
        self._stored(lambda: rows.saveAsTable(name))
        self.names.append(name)
        out = self.spark.table(name)
        self.paths[id(out)] = f"{self.folder}/{name}"
        return out

    def keep(self, df: DataFrame, path: str) -> None:
        """Put the rows to a path where drop() leaves them: the files of a table that nothing reads any more move, other rows are written."""
        if id(df) not in self.paths:
            self._stored(lambda: df.write.mode("overwrite").parquet(path))
            return
        old, new = (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in (self.paths[id(df)], path))
        files = new.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.delete(new, True)
        if not files.rename(old, new):
            raise OSError(f"could not move {self.paths[id(df)]} to {path}")

    def drop(self) -> None:
        """Remove the tables and their files."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def redacted_lines(segments: DataFrame) -> DataFrame:
    """segments with masked texts, and in `masked` how many numbers of each kind; no step after it sees them."""
    found = segments.withColumn("_tw", pii.redacted(F.col("text")))
    of = lambda column, kind: F.coalesce(F.size(F.filter(F.col(f"_tw.{column}"), lambda k: k == kind)), F.lit(0)).cast("long").alias(kind)
    counts = F.struct(of("accounts", "iban"), of("numbers", "pan"), of("numbers", "tckn"), of("numbers", "phone"))
    return found.withColumn("text", F.col("_tw.text")).withColumn("masked", counts).drop("_tw")


def steps(rules: CallRules) -> dict:
    """Each step's name and what it makes of the lines and of the tables before it."""

    def heads(t: dict) -> DataFrame:
        lines = t["lines"]
        said = F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"])
        is_there = lambda who: F.max(F.when(F.col("speaker") == who, who))
        sums = [F.sum(f"masked.{k}").alias(k) for k in ("iban", "pan", "tckn", "phone")]
        found = lines.groupBy(CALL).agg(F.max("sector").alias("sector"), F.max("agent_id").alias("agent_id"), F.max("end_ms").alias("duration_ms"), F.count(F.lit(1)).alias("n_lines"), F.array_join(said, " ").alias("transcript"), is_there(rules.agent).alias("agent"), is_there(rules.customer).alias("customer"), F.max("method").alias("method"), *sums)
        return found.join(ca.separation_reliable(found.select(CALL, "agent", "customer", "method"), list(rules.trusted)), CALL)

    def churn(t: dict) -> DataFrame:
        chunks = ca.churn_chunks(t["lines"], rules.customer, rules.agent_phrases, rules.churn_words, rules.anchors, rules.block)
        named = t["rivals"].groupBy(CALL).agg(F.count(F.lit(1)).alias("named"))
        return ca.churn_risk(chunks, named)

    def topics(t: dict) -> DataFrame:
        found = t["hits"].select(CALL, F.col("segment_index").alias("at"), "keyword", "matched_text", F.lit(None).cast("string").alias("topic_id"))
        return kw.classify_topics(found, rules.topics)

    def violations(t: dict) -> DataFrame:
        found = ca.compliance_violations(t["lines"], rules.agent, rules.patterns, rules.negators)
        return found.join(t["lines"].select(*KEYS, "start_ms", "end_ms", "text"), KEYS)

    def rivals(t: dict) -> DataFrame:
        found = ca.competitors(t["lines"].select(F.col(CALL).alias("doc_id"), "text"), rules.rivals, rules.own_names)
        return found.select(F.col("doc_id").alias(CALL), "name")

    return {
        "heads": heads,
        "hits": lambda t: kw.keyword_engine(t["lines"], rules.rules, rules.synonyms),
        "topics": topics,
        "rivals": rivals,
        "gate": lambda t: seg.quality_gate(seg.asr_confidence(t["lines"])),
        "skills": lambda t: ev.soft_skills(t["lines"], rules.agent, rules.skills, None, rules.fast),
        "churn": churn,
        "violations": violations,
        "toxicity": lambda t: seg.toxicity_rate(t["lines"], rules.toxic, rules.shields),
        "discourse": lambda t: ca.discourse_metrics(t["lines"], seg.interruptions(t["lines"], rules.customer), rules.discourse),
        "events": lambda t: seg.crosstalk_adjacent(t["lines"]),
        "summary": lambda t: ca.executive_summary(t["heads"].select(F.col(CALL).alias("doc_id"), F.col("transcript").alias("text"))).select(F.col("doc_id").alias(CALL), "summary"),
    }


def call_row(t: dict) -> DataFrame:
    """One row for each call: what its steps have found. A call whose speakers are not told apart for sure has low confidence in its churn risk."""
    per = lambda name, n: t[name].groupBy(CALL).agg(F.count(F.lit(1)).alias(n))
    joined = lambda name, column, out: t[name].groupBy(CALL).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias(out))
    rows = t["heads"].drop("agent", "customer", "method")
    for other in (
        t["gate"].select(CALL, F.col("confidence").alias("asr_confidence"), F.col("passes").alias("quality_gate")),
        t["skills"].select(CALL, F.col("score").alias("empathy"), F.col("wpm").alias("agent_wpm"), F.col("interruptions").alias("customer_cuts")),
        t["churn"].select(CALL, F.col("risk").alias("churn_risk"), F.col("alarm").alias("high_risk"), F.col("confidence").alias("churn_confidence")),
        t["toxicity"].select(CALL, F.col("rate").alias("toxicity_rate"), F.col("terms").alias("toxic_terms"), "is_clean"),
        t["discourse"].select(CALL, "fcr", "ces", "adherence", F.col("status").alias("resolution")),
        t["summary"],
        joined("topics", "topic_id", "topics"),
        joined("rivals", "name", "competitors"),
        per("hits", "n_hits"),
        per("violations", "n_violations"),
        per("events", "n_crosstalk"),
    ):
        rows = rows.join(other, CALL, "left")
    rows = rows.fillna(0, ["n_hits", "n_violations", "n_crosstalk"]).fillna("", ["topics", "competitors"])
    confidence = F.when(F.col("reliable"), F.col("churn_confidence")).otherwise("low")
    return rows.withColumn("churn_confidence", F.coalesce(confidence, F.lit("low"))).withColumn("churn_risk", F.coalesce("churn_risk", F.lit(0.0))).withColumn("high_risk", F.coalesce("high_risk", F.lit(False)))


#: What analyze_calls returns, and the steps that a step or an output reads.
OUTPUTS = ("call_analysis", "hits", "violations", "events")
READS = {"topics": ["hits"], "churn": ["rivals"], "summary": ["heads"], "call_analysis": ["heads", "gate", "skills", "churn", "toxicity", "discourse", "summary", "topics", "rivals", "hits", "violations", "events"]}


def _needed(outputs: tuple[str, ...]) -> set[str]:
    found, open_ = set(), list(outputs)
    while open_:
        name = open_.pop()
        if name not in found:
            found.add(name)
            open_ += READS.get(name, [])
    return found


def analyze_calls(segments: DataFrame, rules: CallRules, folder: str, outputs: tuple[str, ...] = OUTPUTS, buckets: int | None = None) -> dict[str, DataFrame]:
    """The outputs asked for and the redacted `lines` of segments, as tables stored under `folder`.

    segments(conversation_id, segment_index, start_ms, end_ms, dur_ms, n_words, text, speaker, avg_logprob, sector, agent_id, and maybe
    method, how its speakers were told apart) is read once; masked lines are stored in buckets by call, each step's rows too, once: the files of what is asked for are moved, not copied. So plans
    stay as small as their step, steps group and join calls where they lie, and a lost executor costs one step. Steps between are removed
    once the results are stored. A call without lines has no row; empty input gives empty tables.
    """
    tmp, needed = Buckets(segments, folder, buckets), _needed(outputs)
    try:
        lines = segments if "method" in segments.columns else segments.withColumn("method", F.lit(None).cast("string"))
        t = {"lines": tmp.table(redacted_lines(lines))}
        for name, step in steps(rules).items():
            if name in needed:
                t[name] = tmp.table(step(t))
        done = {name: call_row(t) if name == "call_analysis" else t[name] for name in (*outputs, "lines")}
        for name in sorted(done, key=lambda n: n != "call_analysis"):  # it reads the others
            tmp.keep(done[name], f"{folder}/{name}")
    finally:
        tmp.drop()
    return {name: segments.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}") for name, df in done.items()}


def stored_rows(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The rows that turnwise.sources.store keeps of what analyze_calls found."""
    from turnwise.sources.store import analysis_rows

    head = found["call_analysis"]
    rest = [c for c in head.columns if c not in (CALL, "agent_id", "sector", "duration_ms", "transcript", "asr_confidence", "quality_gate")]
    calls = head.select(CALL, "agent_id", "sector", (F.col("duration_ms") / 1000.0).alias("duration_sec"), F.col("transcript").alias("full_transcript"), "asr_confidence", F.col("quality_gate").alias("quality_gate_passed"), F.to_json(F.struct(*rest)).alias("metadata_json"))
    return analysis_rows(calls, found["lines"], found["hits"])
