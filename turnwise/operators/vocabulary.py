"""Words of a decoder brought back to a vocabulary: canonical spellings, then the likest term of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.keywords import fuzzy_ratio

#: What counts as a word, the least likeness and the shortest word for terms of a user and of a sector.
WORD = "[A-Za-zÇĞİÖŞÜçğıöşü']+"
CUSTOM, CLOSE = (0.80, 4), (0.93, 7)
#: Keeps rounding from cutting off a bound that is met exactly.
EPS = 1e-9


def _lengths(n: Column, least: float) -> tuple[Column, Column]:
    """Lengths that a string can have whose likeness with one of length n is at least `least`: 2 * shorter / (both) bounds it."""
    return F.ceil(n * least / (2 - least) - EPS).cast("int"), F.floor(n * (2 - least) / least + EPS).cast("int")


def _edits(n: Column, m: Column, least: float) -> Column:
    """Insertions and deletions that can part two strings of lengths n and m whose likeness is at least `least`."""
    return F.floor((n + m) * (1 - least) + EPS).cast("int")


def likely_terms(tokens: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """(token, term, place, ratio) of tokens(token) and terms(term, place) whose likeness, case-folded, is at least `least`.

    Matching blocks are a common subsequence, so strings of lengths n and m that are alike enough differ by k = (n + m) * (1 - least)
    insertions and deletions at most. A token is cut into k + 1 pieces, of which one is untouched and stands in the term no more than k
    places away: pieces of tokens meet the term's substrings at those places by equality, pairs that the edit distance lets through
    are compared once. Terms, the small side, bear the shifts. `least` is above 2/3, so that no piece is empty. Nulls and empty
    strings match nothing.
    """
    if not 2 / 3 < least <= 1:
        raise ValueError("the least likeness has to be above 2/3")
    cut = lambda i, n, s: F.floor(i * n / s).cast("int")
    words = tokens.select("token", F.lower("token").alias("t")).where("t <> ''").distinct().withColumn("n", F.char_length("t"))
    low, high = _lengths(F.col("n"), least)
    words = words.withColumn("k", F.explode(F.array_distinct(F.transform(F.sequence(F.greatest(F.lit(1), low), high), lambda m: _edits(F.col("n"), m, least)))))
    words = words.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin, end = cut(F.col("i"), F.col("n"), F.col("k") + 1), cut(F.col("i") + 1, F.col("n"), F.col("k") + 1)
    pieces = words.select("token", "t", "n", "k", "i", F.substring("t", begin + 1, end - begin).alias("piece"))

    listed = terms.select("term", "place", F.lower("term").alias("u")).where("u <> ''").withColumn("m", F.char_length("u"))
    low, high = _lengths(F.col("m"), least)
    listed = listed.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), low), high))).withColumn("k", _edits(F.col("n"), F.col("m"), least))
    listed = listed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin, end = cut(F.col("i"), F.col("n"), F.col("k") + 1), cut(F.col("i") + 1, F.col("n"), F.col("k") + 1)
    size, most = end - begin, F.least(begin + F.col("k"), F.col("m") - (end - begin))
    first = F.greatest(F.lit(0), begin - F.col("k"))
    at = F.when(most >= first, F.sequence(first, most)).otherwise(F.array().cast("array<int>"))
    probes = listed.select("term", "place", "u", "m", "n", "k", "i", F.explode(F.array_distinct(F.transform(at, lambda p: F.substring("u", p + 1, size)))).alias("piece"))

    met = pieces.join(probes, ["n", "k", "i", "piece"]).where(F.levenshtein("t", "u", 1_000_000) <= F.col("k")).select("token", "t", "u", "term", "place").distinct()
    scored = met.select("t", "u").distinct().withColumn("ratio", fuzzy_ratio("t", "u")).where(F.col("ratio") >= least)
    return met.join(scored, ["t", "u"]).select("token", "term", "place", "ratio")


def corrections(tokens: DataFrame, terms: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """(token, term): what each of the lower-cased tokens(token) becomes, for those that become anything.

    canonical(token, term) goes first; then the likest custom term of one word from 0.80 on, for tokens of four letters or more; then
    the likest of all terms from 0.93 on, from seven letters on. terms(term, place, custom); of terms as like, that of the smallest
    place counts, then the smaller term.
    """
    distinct = tokens.select("token").distinct()
    best = lambda rows: rows.groupBy("token").agg(F.min_by("term", F.struct((-F.col("ratio")).alias("r"), "place", "term")).alias("term"))
    own = terms.where("custom and instr(trim(term), ' ') = 0")
    long = lambda n: distinct.where(F.char_length("token") >= n)
    found = best(likely_terms(long(CUSTOM[1]), own, CUSTOM[0])).withColumn("rank", F.lit(1))
    found = found.unionByName(best(likely_terms(long(CLOSE[1]), terms, CLOSE[0])).withColumn("rank", F.lit(2)))
    if canonical is not None:
        found = found.unionByName(distinct.join(canonical.select(F.lower("token").alias("token"), "term").where("term is not null"), "token").withColumn("rank", F.lit(0)))
    return found.groupBy("token").agg(F.min_by("term", F.struct("rank", "term")).alias("term"))


def with_first_case(original: Column, replacement: Column) -> Column:
    """The replacement, with a capital if the original has one."""
    return F.when(F.substring(original, 1, 1).rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, F.lit(2), F.char_length(replacement)))).otherwise(replacement)


def domain_correct(texts: DataFrame, terms: DataFrame, canonical: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """texts with their words corrected (`corrections`); what stands between words, and a capital first letter, stay.

    The vocabulary is compared once with each different word. What a text's words become meets it by a hash of the text: an entry
    says the same of a word wherever it stands, so texts that share a hash do no harm. Null texts stay null; rows and columns stay.
    """
    key = "_tw_text"
    hashed = texts.withColumn(key, F.xxhash64(F.col(text_col)))
    words = hashed.where(F.col(text_col).isNotNull()).select(key, F.explode(F.transform(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lower)).alias("token")).distinct()
    changed = words.join(corrections(words, terms, canonical), "token").groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct("token", "term"))).alias("_tw_map"))  # a text's different words
    parts = F.regexp_extract_all(text_col, F.lit(f"{WORD}|[^{WORD[1:-2]}]+"), F.lit(0))
    put = lambda w: F.coalesce(with_first_case(w, F.try_element_at("_tw_map", F.lower(w))), w)
    fixed = F.when(F.col("_tw_map").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(parts, put), ""))
    return hashed.join(changed, key, "left").withColumn(text_col, fixed).select(*texts.columns)
