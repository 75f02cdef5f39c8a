"""Lists, access scoping, audit, corrections, erasure, voiceprints, data splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def list_conversations(segments: DataFrame, hits: DataFrame, sector: str, k: int = 200, chars: int = 500) -> DataFrame:
    """The newest calls of a sector, 200 at most, with the start of their transcript and their number of hits. Only their lines are gathered."""
    calls = segments.where(F.col("sector") == sector)
    top = calls.groupBy("conversation_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "conversation_id").limit(min(k, 200))
    lines = calls.select("conversation_id", "segment_index", "text").join(F.broadcast(top), "conversation_id")  # 200 rows at most
    newest = lines.groupBy("conversation_id", "created_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "text"))), lambda x: x["text"]), " ").alias("t"))
    counts = hits.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return newest.join(counts, "conversation_id", "left").select("conversation_id", "created_at", F.substring("t", 1, chars).alias("transcript"), F.coalesce("n", F.lit(0)).alias("hit_count"))


def conversation_detail(segments: DataFrame, hits: DataFrame) -> DataFrame:
    """Each call's header with its numbers of segments and hits and its distinct topics in order."""
    head = segments.groupBy("conversation_id", "sector", "agent_id").agg(F.count(F.lit(1)).alias("segments"), F.max("end_ms").alias("duration_ms"))
    found = hits.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("hits"), F.array_join(F.sort_array(F.collect_set("topic")), ",").alias("topics"))
    return head.join(found, "conversation_id", "left").select(*head.columns, F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("topics", F.lit("")).alias("topics"))


def audit_search(log: DataFrame, action: str, since: str, until: str, offset: int, k: int) -> DataFrame:
    found = log.where((F.col("action") == action) & (F.col("created_at") >= F.lit(since).cast("timestamp")) & (F.col("created_at") < F.lit(until).cast("timestamp")))
    return found.orderBy(F.desc("created_at"), "audit_id").offset(offset).limit(k)


def list_alerts(alerts: DataFrame, acknowledged: bool, k: int = 100) -> DataFrame:
    return alerts.where(F.col("acknowledged") == acknowledged).orderBy(F.desc("created_at"), "alert_id").limit(k)


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(rule_id, op, name): create adds at version 1, update sets the given fields and raises the version, delete removes."""
    c = changes.select("rule_id", "op", F.col("name").alias("new_name"))
    both = rules.join(c, "rule_id", "full_outer").where("op IS NULL OR op <> 'delete'")
    return both.select("rule_id", F.coalesce("new_name", "name").alias("name"), F.when(F.col("version").isNull(), 1).otherwise(F.col("version") + (F.coalesce(F.col("op"), F.lit("")) == "update").cast("int")).cast("long").alias("version"))


def scope_conversations(calls: DataFrame, users: DataFrame, username: str, see_all: tuple[str, ...] = ("qa", "auditor", "admin")) -> DataFrame:
    """The calls a user may see: the listed roles all, a team lead those of their team, every other role and unknown users their own alone."""
    me = users.where(F.col("username") == username).select(F.col("role").alias("my_role"), F.col("team").alias("my_team")).limit(1)
    me = users.sparkSession.range(1).select(F.lit(username).alias("me")).join(me, F.lit(True), "left")  # one row, known or not
    team = users.select(F.col("username").alias("agent_id"), F.col("team").alias("agent_team"))
    scoped = calls.join(team, "agent_id", "left").crossJoin(F.broadcast(me))
    own = F.col("agent_id") == F.col("me")
    mine = F.when(F.col("my_role").isin(*see_all), F.lit(True)).when(F.col("my_role") == "team_lead", own | (F.col("agent_team") == F.col("my_team"))).otherwise(own)
    return scoped.where(mine).select(*calls.columns)


def forget(df: DataFrame, requests: DataFrame, key: str = "conversation_id") -> DataFrame:
    """df without the rows of the requested keys; apply to calls, segments and hits alike."""
    return df.join(requests.select(key).distinct(), key, "left_anti").select(*df.columns)


def append_new(done: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """done and those arriving rows whose key is not done yet, once each."""
    return done.unionByName(arriving.join(done.select(key), key, "left_anti").dropDuplicates([key]).select(*done.columns))


def apply_speaker_corrections(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """The latest correction of a segment overrides its speaker."""
    last = corrections.groupBy("conversation_id", "segment_index").agg(F.max_by("new_speaker", F.struct("corrected_at", "new_speaker")).alias("fixed"))
    return segments.join(last, ["conversation_id", "segment_index"], "left").select("conversation_id", "segment_index", F.coalesce("fixed", "speaker").alias("speaker"), F.col("fixed").isNotNull().alias("corrected"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when((dot(a, a) > 0) & (dot(b, b) > 0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def match_voiceprints(queries: DataFrame, prints: DataFrame, threshold: float, values: int = 1 << 20) -> DataFrame:
    """The enrolled print of the same model and size that is most like each query (of equal ones, to 12 digits, that of the smallest agent, a number or text), named only from `threshold` on; inactive prints match nothing.

    Vectors are normalised once; of equal prints one is compared. Queries and prints of a model and size are dealt to blocks of about
    `values` numbers, and each block of queries meets each of prints in a group of its own, which keeps the best print of each query:
    nothing is broadcast, and no group holds more, however many are enrolled. All pairs are compared.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda df, c: df.where("model is not null").withColumn("u", F.col(c).cast("array<double>")).withColumn("l", norm(F.col("u"))).where((F.col("l") > 0) & (F.col("l") < float("inf"))).select("model", F.size("u").alias("d"), F.transform("u", lambda x: x / F.col("l")).alias("u"), df.columns[0])
    live = (prints.where("coalesce(active, true)") if "active" in prints.columns else prints).select("agent", "model", "print")
    asked, held = unit(queries.select("query_id", "model", "embedding"), "embedding"), unit(live, "print")
    held = held.groupBy("model", "d", "u").agg(F.min("agent").alias("agent"))
    most = lambda df: -(-(df.groupBy("model", "d").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.col("n") * F.col("d"))).first()[0] or 1) // values)
    n_asked, n_held = most(asked), most(held)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    by = ["model", "d", "q", "p"]
    asked = asked.withColumn("q", part("query_id", n_asked)).withColumn("p", every(n_held))
    held = held.withColumn("p", part("agent", n_held)).withColumn("q", every(n_asked))
    one = T.StructType([asked.schema["query_id"], T.StructField("s", T.DoubleType()), held.schema["agent"], T.StructField("score", T.DoubleType())])
    met = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(_most_alike, one)
    best = met.groupBy("query_id").agg(F.min(F.struct("s", "agent", "score")).alias("m"))
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.when(F.col("m.score") >= threshold, F.col("m.agent")).alias("agent"), F.round(F.coalesce("m.score", F.lit(0.0)), 6).alias("score"))


def _most_alike(asked: pa.Table, held: pa.Table) -> pa.Table:
    """(query_id, s, agent, score) of the best print of each query that is at all like it; s is the negative score to 12 digits."""
    rows, found = [], []
    if asked.num_rows and held.num_rows:
        x, y = (t.column("u").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (asked, held))
        names = held.column("agent").to_pylist()
        for begin in range(0, len(x), 256):
            dots = x[begin : begin + 256] @ y.T
            top = dots.max(axis=1)
            # products of matrices may differ in their last digits between places, so those near the top are worked out one by one
            at, of = np.nonzero((dots >= top[:, None] - 1e-9) & (dots > -1e-9))
            for k in range(0, len(at), 4096):
                a, b = begin + at[k : k + 4096], of[k : k + 4096]
                for row, name, score in zip(a.tolist(), b.tolist(), np.cumsum(x[a] * y[b], axis=1)[:, -1].tolist(), strict=True):
                    one = (-round(score, 12), names[name], score)
                    if score <= 0:
                        continue
                    if not rows or rows[-1] != row:
                        rows.append(row)
                        found.append(one)
                    elif one[:2] < found[-1][:2]:
                        found[-1] = one
    s, agents, scores = zip(*found, strict=True) if found else ((), (), ())
    return pa.table([asked.column("query_id").take(pa.array(rows, pa.int64())), pa.array(s, pa.float64()), pa.array(agents, held.column("agent").type), pa.array(scores, pa.float64())], names=["query_id", "s", "agent", "score"])


def upsert_voiceprints(prints: DataFrame, new: DataFrame) -> DataFrame:
    """By agent: a new embedding replaces the old one and reactivates it; all-zero vectors are rejected."""
    fine = new.where(F.exists("embedding", lambda x: x != 0)).select("agent", F.col("embedding").alias("fresh"))
    both = prints.join(fine, "agent", "full_outer")
    return both.select("agent", F.coalesce("fresh", "print").alias("print"), (F.col("fresh").isNotNull() | F.coalesce("active", F.lit(False))).alias("active"))


def resolve_user(log: DataFrame, users: DataFrame) -> DataFrame:
    return log.join(users.select("username", "user_id"), "username", "left")


def combine_terms(lists: DataFrame, k: int | None = None, by: list[str] = ()) -> DataFrame:
    """lists(by, source, pos, term): each term of a group once, case-folded, in the order of its first place; the first k if given. A group's terms are ordered in one task; without `by` all are one group, which suits short lists."""
    first = lists.groupBy(*by, F.lower("term").alias("folded")).agg(F.min(F.struct("source", "pos", "term")).alias("m"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("m.source", "m.pos"))
    out = first.select(*by, F.col("m.term").alias("term"), place.cast("long").alias("place"))
    return out if k is None else out.where(F.col("place") <= k)


def split_pseudo_labels(segments: DataFrame, least: float = -0.35) -> DataFrame:
    """Usable lines (0.8 to 28 s, not IVR, not empty) as `auto` where surely decoded, else `review`."""
    fine = segments.where(F.col("dur_ms").between(800, 28_000) & (F.col("speaker") != "IVR") & (F.length(F.trim("text")) > 0))
    return fine.select("conversation_id", "segment_index", F.when(F.col("avg_logprob") >= least, "auto").otherwise("review").alias("queue"))


def protocol_split(ids: DataFrame, key: str, seed: int, dev_share: float) -> DataFrame:
    """A seeded split that no partitioning changes: rows whose keyed hash falls under the share go to dev."""
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return ids.select(key, F.when(part < dev_share, "dev").otherwise("train").alias("split"))


def nth_smallest(df: DataFrame, column: str, k: int, bins: int = 4096):
    """The k-th smallest value, from 0, exactly: histograms narrow to one value, so nothing is sorted or gathered. Null if there is none.

    Infinite values stand at both ends, those that are no number behind all others; they are counted and not binned.
    """
    number, infinite = F.col(column).cast("double"), float("inf")
    values = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < infinite))
    edge = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    ends = df.agg(F.count_if(number == -infinite).alias("low"), F.count_if(number == infinite).alias("high"), F.count_if(F.isnan(number)).alias("odd")).first()
    if k < 0:
        return None
    if k < ends["low"]:
        return -infinite
    k -= ends["low"]
    if k >= edge["n"]:
        k -= edge["n"]
        return infinite if k < ends["high"] else float("nan") if k < ends["high"] + ends["odd"] else None
    lo, hi = edge["lo"], edge["hi"]
    while lo < hi:
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / ((hi - lo) / bins)))
        found = values.where(F.col(column).between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy("bin").collect()  # `bins` rows at most
        for r in found:
            if k < r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def operational_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each metric: n, mean, low, high and the upper median (the value in place n div 2 from 0)."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    middle = {c: nth_smallest(df, c, counts[c] // 2) for c in columns}
    rows = [F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), F.round(F.avg(c), 2).alias("mean"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.lit(middle[c]).cast("double").alias("median")) for c in columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def list_voiceprints(prints: DataFrame) -> DataFrame:
    """Each enrolled print with the size of its embedding and, where prints have it, its model, newest first."""
    model = ["model"] if "model" in prints.columns else []
    return prints.select("agent", "enrolled_at", F.size("print").cast("long").alias("dimensions"), *model).orderBy(F.desc("enrolled_at"), "agent")
