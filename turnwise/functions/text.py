"""Text and number expressions; every function takes and gives Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turkish letters and what they fold to, and their dotted and dotless pairs.
TURKISH, PLAIN = "çğıöşüÇĞİÖŞÜ", "cgiosuCGIOSU"


#: Words: runs of letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column, locale: str = "root") -> Column:
    """Words of lower-cased text."""
    return F.regexp_extract_all(fold(text, locale), F.lit(WORD), F.lit(0))


def context_window(text: Column, part: Column, window: int = 40) -> Column:
    """The first place of a part, case-folded, with `window` characters on both sides, trimmed; the text's start where it is not there."""
    at = F.greatest(F.lit(1), F.instr(F.lower(text), F.lower(part)))
    begin = F.greatest(F.lit(1), at - window)
    return F.trim(F.substring(text, begin, at + F.char_length(part) + window - begin))


def fold(text: Column, locale: str = "root") -> Column:
    """Lower case; `tr` maps the dotted and dotless capitals first."""
    return F.lower(F.translate(text, "İI", "iı")) if locale == "tr" else F.lower(text)


def ascii_fold(text: Column) -> Column:
    return F.translate(text, TURKISH, PLAIN)


def normalize_token(token: Column) -> Column:
    """Lower case, look-alike signs read as letters, stars dropped, runs of three or more cut to two."""
    return F.regexp_replace(F.translate(F.lower(F.trim(token)), "1!@0*", "iiao"), r"(.)\1{2,}", "$1$1")


def wpm(words: Column, dur_ms: Column) -> Column:
    return F.floor(words / F.greatest(F.lit(0.5), dur_ms / 1000.0) * 60).cast("long")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none if there are fewer."""
    at = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    # the words are worked out once, not for every run
    return F.get(F.transform(F.array(words), lambda w: F.transform(at(w), lambda i: F.array_join(F.slice(w, i, n), " "))), 0)


def repeated_ngram_ratio(words: Column, n: int) -> Column:
    """1 - distinct / all runs of n words; 0 below 2n words."""
    runs = ngrams(words, n)
    return F.when(F.size(words) < 2 * n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(runs)) / F.size(runs))


def filler_ratio(words: Column, fillers: list[str]) -> Column:
    listed = F.array(*[F.lit(x) for x in fillers])
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.size(F.filter(words, lambda w: F.array_contains(listed, w))) / F.size(words), 1))


def analysis_excerpt(text: Column, most: int = 400, head: int = 120, middle: int = 80, tail: int = 200) -> Column:
    """Long texts as their first, middle and last words."""
    w = F.filter(F.split(text, "[ \t\r\n]+"), lambda x: x != "")
    n = F.size(w)
    mid = F.slice(w, F.greatest(F.lit(1), F.floor(n / 2).cast("int") - middle // 2 + 1), F.lit(middle))
    return F.when(n > most, F.array_join(F.concat(F.slice(w, 1, head), mid, F.slice(w, n - tail + 1, F.lit(tail))), " ")).otherwise(F.array_join(w, " "))


def srt_timestamp(ms: Column) -> Column:
    part = lambda d, m: F.floor(ms / d) % m
    return F.format_string("%02d:%02d:%02d,%03d", part(3600000, 100), part(60000, 60), part(1000, 60), ms % 1000)


def price_signals(text: Column, low: int = 50, high: int = 100_000) -> Column:
    """Distinct amounts next to a currency word or sign, largest first."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]{2,6}) ?(?:tl|lira|usd|eur|dollars|euros)"), F.lit(1))
    return F.sort_array(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("long")), lambda x: (x >= low) & (x <= high))), asc=False)


def luhn_ok(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.reverse(F.transform(F.split(digits, ""), lambda x: x.cast("int")))
    d = F.filter(d, lambda x: x.isNotNull())
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def card_numbers(text: Column) -> Column:
    """Card numbers in the text, digits only: runs of 15 to 19 digits with single blanks or dashes between, that pass the Luhn check."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9](?:[ -]?[0-9]){14,18}"), F.lit(0)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.filter(runs, luhn_ok)


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Word-level edit distance of two arrays: words become single characters, so the built-in distance applies."""
    coded = lambda a, words: F.array_join(F.transform(a, lambda w: _sign(F.array_position(words, w))), "")
    # the pair and its words are worked out once, not for every word
    pair = F.struct(reference.alias("r"), hypothesis.alias("h"), F.array_distinct(F.concat(reference, hypothesis)).alias("words"))
    return F.get(F.transform(F.array(pair), lambda p: F.levenshtein(coded(p["r"], p["words"]), coded(p["h"], p["words"]))), 0)


def _sign(k: Column) -> Column:
    """A character of its own for each number from 1 to 983,039, all of four bytes; more raise an error."""
    code = F.when(k <= 0xEFFFF, k + 0x10000).otherwise(F.raise_error(F.lit("more than 983,039 different words in a pair")).cast("long")).cast("long")
    part = lambda shift, mark: F.hex(F.shiftright(code, shift).bitwiseAND(63) + mark)
    return F.decode(F.unhex(F.concat(F.hex(F.shiftright(code, 18) + 0xF0), part(12, 0x80), part(6, 0x80), part(0, 0x80))), "UTF-8")


def repeated_runs_cut(text: Column) -> Column:
    """Runs of one to five words that follow themselves, cut to one; longer runs first."""
    for n in (5, 4, 3, 2, 1):
        run = r"\w+" + r"\s+\w+" * (n - 1)
        text = F.regexp_replace(text, rf"(?iU)\b({run})(?:\s+\1\b)+", "$1")
    return text


def sanitize_repetitions(text: Column) -> Column:
    """Text without decoder loops: runs of dots, glued loops as in 7.7.7.7., equal sentences in a row, repeated runs of words."""
    text = F.regexp_replace(text, r"\.{4,}", "...")
    text = F.regexp_replace(text, r"(?U)\b(\w{1,3})(?:\.\1){2,}\.?", "$1.")
    parts = F.split(text, r"(?<=[.?!])\s+", -1)
    text = F.array_join(F.filter(parts, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(parts, i - 1)))), " ")
    return repeated_runs_cut(text)


def canonical_sector(sector: Column, names: dict[str, str], default: str = "omni") -> Column:
    """The sector that a name stands for, case-folded and trimmed."""
    found = F.lit(default)
    for name, to in names.items():
        found = F.when(F.lower(F.trim(sector)) == name, to).otherwise(found)
    return F.coalesce(found, F.lit(default))


def restore_punctuation(text: Column, question: str) -> Column:
    """Sentences begin with a capital; one without an end gets a question mark where the pattern matches it, else a full stop."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+", -1), F.trim), lambda x: x != "")
    ended = lambda x: F.when(x.rlike(r"[.?!]$"), x).when(F.lower(x).rlike(question), F.concat(x, F.lit("?"))).otherwise(F.concat(x, F.lit(".")))
    fixed = F.transform(parts, lambda x: F.concat(F.upper(F.substring(ended(x), 1, 1)), F.substring(ended(x), F.lit(2), F.char_length(ended(x)))))
    return F.when(F.trim(text) == "", text).otherwise(F.array_join(fixed, " "))


def canonical_words(text: Column, names: dict[str, str]) -> Column:
    """Words between single spaces replaced by what they stand for, case-folded."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), " ")
