"""Personal numbers in transcripts: validated by their checksums, counted by kind and masked but for their last digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwise.functions.text import luhn_ok

#: Where bank accounts and runs of digits may be, and what stands in their place.
IBAN_RUN = r"(?i)\bTR[ .\-]?(?:\d[ .\-]?){23}\d\b"
DIGIT_RUN = r"(?<!\d)(?:\d[ .\-]?){9,31}\d(?!\d)"
#: The same without a look at what stands around: a run of more than 32 digits is cut there, within a number too.
CUT_RUN = "[0-9](?:[ .-]?[0-9]){9,31}"
MASKS = {"iban": ("TR** **** [IBAN GİZLENDİ] ", 4), "pan": ("[KART NO GİZLENDİ] **** ", 4), "tckn": ("[TCKN GİZLENDİ] *********", 2), "phone": ("[TELEFON GİZLENDİ] *** ", 4)}


def digits_of(run: Column) -> Column:
    return F.regexp_replace(run, r"\D", "")


def tckn_ok(digits: Column) -> Column:
    """Whether eleven digits pass the checks of a Turkish identity number."""
    d = lambda i: F.substring(digits, i + 1, 1).try_cast("int")
    odd, even = d(0) + d(2) + d(4) + d(6) + d(8), d(1) + d(3) + d(5) + d(7)
    fits = (F.pmod(odd * 7 - even, F.lit(10)) == d(9)) & ((odd + even + d(9)) % 10 == d(10))
    return F.when((F.length(digits) == 11) & ~F.startswith(digits, F.lit("0")), fits).otherwise(False)


def iban_ok(run: Column) -> Column:
    """Whether a Turkish account number passes the check modulo 97; TR stands for 2927 behind the account."""
    digits = digits_of(run)
    turned = F.concat(F.substring(digits, 3, 22), F.lit("2927"), F.substring(digits, 1, 2))
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return (F.length(digits) == 24) & (rest == 1)


def mobile_ok(digits: Column) -> Column:
    n = F.length(digits)
    return ((n == 12) & F.startswith(digits, F.lit("905"))) | ((n == 11) & F.startswith(digits, F.lit("05"))) | ((n == 10) & F.startswith(digits, F.lit("5")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def number_kind(run: Column) -> Column:
    """pan, tckn, phone or null for a run of digits."""
    return _let(digits_of(run), lambda digits: F.when(F.length(digits).between(15, 19) & luhn_ok(digits), "pan").when((F.length(digits) == 11) & tckn_ok(digits), "tckn").when(mobile_ok(digits), "phone"))


def _masked(text: Column, pattern: str, kind: Callable[[Column], Column]) -> Column:
    """A struct of the text with the matches that have a kind masked and of the kinds of all matches."""
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(runs, lambda run: F.struct(run.alias("run"), kind(run).alias("kind")))

    def shown(one: Column) -> Column:
        out = one["run"]
        for name, (sign, last) in MASKS.items():
            out = F.when(one["kind"] == name, F.concat(F.lit(sign), F.right(digits_of(one["run"]), F.lit(last)))).otherwise(out)
        return out

    def put(all_: Column) -> Column:
        masks = F.transform(all_, shown)
        whole = _let(masks, lambda m: F.array_join(F.transform(F.split(text, pattern, -1), lambda part, i: F.concat(part, F.coalesce(F.get(m, i), F.lit("")))), ""))
        kinds = F.transform(all_, lambda one: one["kind"])
        return F.struct(F.when(F.exists(kinds, lambda k: k.isNotNull()), whole).otherwise(text).alias("text"), kinds.alias("kinds"))

    return _let(found, put)


def redacted(text: Column, runs: str = DIGIT_RUN) -> Column:
    """A struct of the masked text and of the kinds of all account numbers and runs of digits that were looked at, in two arrays."""
    account = lambda run: F.when(iban_ok(run), "iban")
    return _let(_masked(text, IBAN_RUN, account), lambda once: _let(_masked(once["text"], runs, number_kind), lambda twice: F.struct(twice["text"].alias("text"), once["kinds"].alias("accounts"), twice["kinds"].alias("numbers"))))


def redact(text: Column, runs: str = DIGIT_RUN) -> tuple[Column, Column]:
    """(the masked text, a struct of how many account, card, identity and mobile numbers were masked); nulls stay null with counts of 0."""
    found = redacted(text, runs)
    counts = F.transform(F.array(found), lambda r: F.struct(*[F.size(F.filter(F.coalesce(r["accounts" if name == "iban" else "numbers"], F.array().cast("array<string>")), lambda k: k == name)).cast("long").alias(name) for name in MASKS]))  # noqa: B023
    return found["text"], F.get(counts, 0)
