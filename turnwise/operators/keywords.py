"""Keyword rules over segments: exact, phrase, fuzzy, regex and semantic matching, topics, highlights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from turnwise.functions import text as tx

KEYS = ["conversation_id", "segment_index"]
#: Where hits of a segment stand when equal texts are told apart: phrases, words, then synonyms.
PHRASE, WORD, SYNONYM = 0, 1, 2


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(left: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp likeness of two strings, 0 to 1. Give it distinct pairs that a cheap bound has let through."""
    from difflib import SequenceMatcher

    for a, b in left:
        yield pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def match_rules(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """(keys of a segment, sector, rule_id) for the active rules whose sectors are null, empty or hold the segment's; a null flag is active.

    A rule is joined by its sectors; rules without any go to every segment, so their number multiplies the rows.
    """
    live = rules.where(F.coalesce("is_active", F.lit(True))).select("rule_id", F.col("sector_scope").alias("s"))
    everywhere = F.col("s").isNull() | (F.size("s") == 0)
    by_sector = segments.select(*KEYS, "sector").join(live.where(~everywhere).select("rule_id", F.explode(F.array_distinct("s")).alias("sector")), "sector")
    listed = live.where(everywhere).agg(F.sort_array(F.collect_list("rule_id")).alias("all"))  # one row, the ids of a rule table
    general = segments.select(*KEYS, "sector").crossJoin(F.broadcast(listed)).select(*KEYS, "sector", F.explode("all").alias("rule_id"))
    return general.unionByName(by_sector.select(*KEYS, "sector", "rule_id"))


def terms_of(rules: DataFrame, synonyms: DataFrame | None) -> DataFrame:
    """(rule_id, mode, at, keyword, term, synonym): each rule's keywords in order, and in semantic rules what they also stand for."""
    live = rules.where(F.coalesce("is_active", F.lit(True)))
    own = live.select("rule_id", F.col("match_mode").alias("mode"), F.coalesce("fuzzy_threshold", F.lit(0.85)).alias("least"), "sector_scope", F.posexplode("keywords").alias("at", "keyword")).withColumn("term", F.col("keyword")).withColumn("synonym", F.lit(False))
    if synonyms is None:
        return own
    also = synonyms.select(tx.normalize_token(F.col("keyword")).alias("n"), F.explode("synonyms").alias("other"))
    return own.unionByName(own.where("mode = 'semantic'").withColumn("n", tx.normalize_token(F.col("keyword"))).join(also, "n").withColumn("term", F.col("other")).withColumn("synonym", F.lit(True)).select(*own.columns))


def keyword_engine(segments: DataFrame, rules: DataFrame, synonyms: DataFrame | None = None, excluded: dict[str, list[str]] | None = None, window: int = 40) -> DataFrame:
    """Hits of rules(rule_id, keywords, match_mode, fuzzy_threshold, sector_scope, is_active) in segments(keys, sector, text).

    (keys, rule_id, keyword, matched_text, match_type, confidence, context). Tokens are runs of letters, digits, @, ! and *, normalised;
    phrases match in a row and cover their tokens; a token else matches the first keyword of its rule, by equality (exact, semantic)
    or likeness (fuzzy, from three characters on); semantic rules also match synonyms of several words anywhere in the text, at 0.9;
    regex rules match the text itself. A rule hits a normalised text once a segment. context is the matched place and `window`
    characters on both sides. `excluded` lists prefixes of longer words that a keyword does not mean. Null texts have no hits.

    Rules are a dimension: tokens meet terms by equality of their first word, likeness is taken once for each pair of words.
    """
    terms = terms_of(rules, synonyms).withColumn("norm", tx.normalize_token(F.col("term"))).withColumn("parts", F.filter(F.split("norm", r"\s+"), lambda x: x != "")).where("size(parts) > 0")
    text = segments.where("text is not null").select(*KEYS, "sector", "text")
    tokens = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}@!*]+"), F.lit(0)), tx.normalize_token), lambda t: t != "")
    tokened = text.select(*KEYS, "sector", tokens.alias("w"))
    words = tokened.select(*KEYS, "sector", F.posexplode("w").alias("i", "token"))
    fits = F.col("sector_scope").isNull() | (F.size("sector_scope") == 0) | F.array_contains("sector_scope", F.col("sector"))

    # phrases: the words of a term in a row, found by as many joins as positions of its first word
    many = terms.where("size(parts) > 1 and mode <> 'regex'").withColumn("first", F.col("parts")[0])
    starts = words.join(many, F.col("token") == F.col("first")).where(fits).select(*KEYS, "rule_id", "at", "norm", "parts", "i")
    follows = starts.join(tokened.select(*KEYS, "w"), KEYS).where(F.slice("w", F.col("i") + 1, F.size("parts")) == F.col("parts"))
    phrases = follows.select(*KEYS, "rule_id", "i", F.size("parts").alias("n"), F.array_join("parts", " ").alias("matched_text"))
    covered = phrases.select(*KEYS, "rule_id", F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i")).distinct()

    kept = F.lit(True)
    for keyword, prefixes in (excluded or {}).items():
        kept = kept & ~((F.col("kw") == keyword) & F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col("token"), p)))
    single = terms.where("not synonym").withColumn("kw", F.col("norm"))
    same = words.join(single.where("mode in ('exact', 'semantic')"), F.col("token") == F.col("kw")).where(fits & kept).select(*KEYS, "rule_id", "i", "token", "at", "keyword", F.col("mode").alias("match_type"), F.lit(1.0).alias("confidence"))
    # likeness is at most 2 * shorter / (both lengths): only lengths within that meet
    long = single.where("mode = 'fuzzy' and length(kw) >= 3").withColumn("n", F.explode(F.sequence(F.ceil(F.length("kw") * F.col("least") / (2 - F.col("least"))).cast("int"), F.floor(F.length("kw") * (2 - F.col("least")) / F.greatest(F.lit(0.01), "least")).cast("int"))))
    likened = words.select("token").distinct().withColumn("n", F.length("token")).join(long.select("kw", "n", "least").distinct(), "n").select("token", "kw", fuzzy_ratio("token", "kw").alias("ratio"), "least").where("ratio >= least").select("token", "kw", "ratio").distinct()
    like = words.join(likened, "token").join(single.where("mode = 'fuzzy' and length(kw) >= 3"), "kw").where(fits & kept & (F.col("ratio") >= F.col("least"))).select(*KEYS, "rule_id", "i", "token", "at", "keyword", F.lit("fuzzy").alias("match_type"), F.col("ratio").alias("confidence"))
    free = same.unionByName(like).join(covered, [*KEYS, "rule_id", "i"], "left_anti")
    first = Window.partitionBy(*KEYS, "rule_id", "i").orderBy("at")
    free = free.withColumn("k", F.row_number().over(first)).where("k = 1")

    wide = terms.where("synonym and mode = 'semantic' and term like '% %'").select("rule_id", "at", "keyword", "term", "sector_scope").agg(F.collect_list(F.struct("rule_id", "at", "keyword", "term", "sector_scope")).alias("all"))
    anywhere = text.crossJoin(F.broadcast(wide)).select(*KEYS, "sector", F.inline(F.filter("all", lambda t: F.contains(F.lower("text"), F.lower(t["term"]))))).where(fits)

    patterns = rules.where(F.coalesce("is_active", F.lit(True)) & (F.col("match_mode") == "regex")).select("rule_id", "sector_scope", F.posexplode("keywords").alias("at", "pattern")).agg(F.collect_list(F.struct("rule_id", "sector_scope", "at", "pattern")).alias("all"))
    searched = text.crossJoin(F.broadcast(patterns)).select(*KEYS, "sector", "text", F.inline("all")).where(fits)
    found = searched.select(*KEYS, "rule_id", "at", F.posexplode(F.regexp_extract_all("text", F.concat(F.lit("(?iu)"), "pattern"), F.lit(0))).alias("i", "matched_text"))

    none = F.lit(None).cast("string")
    hits = phrases.select(*KEYS, "rule_id", F.lit(PHRASE).alias("kind"), (-F.col("n")).alias("at"), "i", F.col("matched_text").alias("keyword"), "matched_text", F.lit("phrase").alias("match_type"), F.lit(1.0).alias("confidence"))
    hits = hits.unionByName(free.select(*KEYS, "rule_id", F.lit(WORD).alias("kind"), F.lit(0).alias("at"), "i", "keyword", F.col("token").alias("matched_text"), "match_type", "confidence"))
    hits = hits.unionByName(anywhere.select(*KEYS, "rule_id", F.lit(SYNONYM).alias("kind"), "at", F.lit(0).alias("i"), "keyword", F.col("term").alias("matched_text"), F.lit("semantic").alias("match_type"), F.lit(0.9).alias("confidence")))
    hits = hits.unionByName(found.select(*KEYS, "rule_id", F.lit(WORD).alias("kind"), "at", "i", F.col("matched_text").alias("keyword"), "matched_text", F.lit("regex").alias("match_type"), F.lit(1.0).alias("confidence")))
    once = Window.partitionBy(*KEYS, "rule_id", tx.normalize_token(F.coalesce("matched_text", none))).orderBy("kind", "at", "i", "matched_text")
    hits = hits.withColumn("k", F.row_number().over(once)).where("k = 1").drop("k", "kind", "at", "i")
    return hits.join(text.select(*KEYS, "text"), KEYS).select(*KEYS, "rule_id", "keyword", "matched_text", "match_type", "confidence", tx.context_window(F.col("text"), F.col("matched_text"), window).alias("context"))


def classify_topics(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """(conversation_id, topic_id, matched_via) of hits(conversation_id, at, keyword, matched_text, topic_id), each topic of a call once, at its first hit.

    topics(topic_id, place, terms): a hit belongs to the topic that lists its keyword, else its matched text, else to the topic named in
    it; of topics that list one term the last counts. Terms are compared in normal form.
    """
    listed = topics.select("topic_id", "place", F.explode("terms").alias("term")).groupBy(tx.normalize_token(F.col("term")).alias("n")).agg(F.max_by("topic_id", F.struct("place", "topic_id")).alias("of_term"))
    by = lambda column, name: listed.withColumnsRenamed({"n": column, "of_term": name})
    rows = hits.withColumn("n1", tx.normalize_token(F.col("keyword"))).withColumn("n2", tx.normalize_token(F.col("matched_text")))
    rows = rows.join(by("n1", "t1"), "n1", "left").join(by("n2", "t2"), "n2", "left").withColumn("topic", F.coalesce("t1", "t2", "topic_id")).where("topic is not null")
    return rows.groupBy("conversation_id", F.col("topic").alias("topic_id")).agg(F.min_by("matched_text", F.struct("at", "matched_text")).alias("matched_via"))


def highlight_spans(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(keys, begin, end) of the terms in texts(keys, text), case-folded, in code points; longer terms first, none over another.

    A term's places are those found from left to right after one another, before others are looked at.
    """
    spans = F.array().cast("array<struct<begin:int,end:int>>")
    for term in sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t)):
        parts = F.split(F.lower("text"), r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E", -1)
        start = F.struct(F.lit(0).alias("at"), spans.alias("out"))

        def step(acc, part):
            size = len(term)  # noqa: B023
            begin = acc["at"] + F.char_length(part)
            free = ~F.exists(acc["out"], lambda s: (begin < s["end"]) & (begin + size > s["begin"]))
            return F.struct((begin + size).alias("at"), F.when(free, F.concat(acc["out"], F.array(F.struct(begin.alias("begin"), (begin + size).alias("end"))))).otherwise(acc["out"]).alias("out"))

        spans = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step)["out"]
    return texts.where("text is not null").select(*KEYS, F.inline(F.sort_array(spans)))


def profanity_tokens(text: Column, exact: list[str], stems: list[str], excluded: list[str]) -> Column:
    """The normalised words of a text that are listed or begin with a stem, but not with an excluded longer one."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}@!*]+"), F.lit(0)), tx.normalize_token)
    begins = lambda t, listed: F.exists(F.array(*[F.lit(x) for x in listed]).cast("array<string>"), lambda s: F.startswith(t, s))
    return F.filter(words, lambda t: (t.isin(exact) | begins(t, stems)) & ~begins(t, excluded))


def fuzzy_phrases(segments: DataFrame, phrases: list[str], least: float = 0.85) -> DataFrame:
    """(keys, phrase): the phrases that a segment holds, or that as many of its words in a row are like over `least`; shorter texts are taken whole.

    Likeness is taken once for each pair of a run and a phrase whose lengths allow it.
    """
    low = segments.where("text is not null").select(*KEYS, F.lower("text").alias("t"))
    words = F.filter(F.split("t", r"\s+"), lambda w: w != "")
    listed = F.array(*[F.lit(p.lower()) for p in phrases])
    held = low.select(*KEYS, F.explode(F.filter(listed, lambda p: F.contains("t", p))).alias("phrase"))
    sizes = sorted({len(p.split()) for p in phrases})
    runs = F.flatten(F.array(*[F.transform(F.when(F.size("w") >= n, tx.ngrams(F.col("w"), n)).otherwise(F.array("t")), lambda g: F.struct(F.lit(n).alias("n"), g.alias("run"))) for n in sizes]))
    spoken = low.select(*KEYS, "t", words.alias("w")).select(*KEYS, F.inline(F.array_distinct(runs)))
    table = segments.sparkSession.createDataFrame([(p.lower(), len(p.split()), len(p)) for p in phrases], "phrase string, n int, size int")
    fits = 2.0 * F.least(F.length("run"), F.col("size")) > least * (F.length("run") + F.col("size"))
    like = spoken.select("n", "run").distinct().join(F.broadcast(table), "n").where(fits).select("n", "run", "phrase", fuzzy_ratio("run", "phrase").alias("ratio")).where(F.col("ratio") > least)
    return held.union(spoken.join(like, ["n", "run"]).select(*KEYS, "phrase")).distinct()
