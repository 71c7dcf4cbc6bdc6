"""Masks for private logs: matches are found once, as spans, and the text is cut once.

Secrets, addresses and card numbers are alternatives of one pattern, so their spans cannot
overlap: the one that begins first stands, and of two that begin together the kind named first.
Telephone numbers are then sought in what is left, marks excluded, so that digits that turned out to be no
card number can be part of one. Counts are of spans, not of marks that a text may hold by
itself.

No pattern bounds the length of a match, and none repeats a group without bound, which would
put a stack frame on the JVM per character. Runs are only entered at their first character
and never entered again from within, so the time is in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_TOKEN = "[A-Za-z0-9_-]"
_MAIL = r"[\p{L}\p{N}._%+-]"
_END = "(?![A-Za-z0-9_])"


def _alone(first: str) -> str:
    """``first`` where no word runs into it. The text is compared before the look back, as few
    places get past that."""
    return f"{first}(?<![A-Za-z0-9_]{first})"


#: Kinds as (name, pattern), in the order in which they win.
KINDS = (
    # Signed tokens, up to the next one in the same run; keys by their prefix; named values.
    ("secret",
     rf"{_alone('eyJ')}(?:(?!-eyJ){_TOKEN})++\.{_TOKEN}++(?:\.{_TOKEN}*+)?"
     rf"|{_alone('A[KS]IA')}[0-9A-Z]{{16}}{_END}"
     rf"|(?:{_alone('gh[pos]')}|{_alone('[sp]k')}|{_alone('xox[abp]')})[_-]{_TOKEN}++"
     rf"|{_alone('(?i:bearer)')} ++[A-Za-z0-9._~+/=-]++"
     r"|(?i:token|secret|passw(?:or)?d|a(?:pi|ccess)_?key)[\"']?[ \t]*+[=:][ \t]*+(?:\"[^\"]*+\"|'[^']*+'|[^ \t\n\"',;]++)"),
    ("email", rf"(?<!{_MAIL}){_MAIL}++@[\p{{L}}\p{{N}}.-]+\.\p{{L}}\p{{L}}++"),
    ("address",
     rf"(?=[0-9]{{1,3}}\.[0-9])(?<![A-Za-z0-9_]){_OCTET}(?:\.{_OCTET}){{3}}{_END}"
     rf"|(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f:])(?<![0-9A-Za-z:.])"
     rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::{_HEX}(?::{_HEX}){{0,6}})(?![0-9A-Za-z:])"),
    ("card", rf"{_alone('[0-9]')}(?:[ -]?[0-9]){{12,18}}{_END}"),
)
PHONE = (
    r"\+[0-9][0-9 ().-]*[0-9]|\((?:[0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|0[0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4})" + _END
    + rf"|{_alone('[0-9]')}(?:[0-9]{{2}}[ .-][0-9]{{3}}[ .-][0-9]{{4}}|(?<=0)[0-9]{{2,4}}[ .-][0-9]{{3,4}}[ .-][0-9]{{3,4}}){_END}"
)
_MARK = "\0"
_COUNTS = {"secret": "secrets", "email": "emails", "address": "addresses", "card": "cards"}
_KIND_NAMES = tuple(_COUNTS)
#: One of these is in every address, card and telephone number.
_NUMERIC = "[0-9]|:[0-9A-Fa-f:]"
#: One of these is in every secret, in lower case.
_SECRET_PARTS = (
    "eyj", "akia", "asia", "ghp", "gho", "ghs", "sk-", "sk_", "pk-", "pk_", "xox", "bearer ", "token", "secret", "passw",
    "apikey", "api_key", "accesskey", "access_key",
)


def _any(*names: str) -> str:
    return "|".join(f"(?:{pattern})" for name, pattern in KINDS if name in names)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _kind(span: Column) -> Column:
    """The first kind that is the whole span."""
    told = F
    for name, pattern in KINDS:
        told = told.when(span.rlike(rf"\A(?:{pattern})\z"), name)
    return told


def _cover(span: Column) -> Column:
    """A span with its kind and what stands for it; a run of digits that is no card stays.

    Runs of 13 to 19 digits are card numbers if their check digit is right.
    """
    def told(kind: Column) -> Column:
        stays = (kind == "card") & ~F.call_function("luhn_check", F.regexp_replace(span, "[ -]", ""))
        return F.struct(
            F.when(~stays, kind).alias("kind"),
            F.when(stays, span).otherwise(F.concat(F.lit("["), kind, F.lit("]"))).alias("mark"),
        )

    return _let(_kind(span), told)


def _pieces(text: Column) -> Column:
    """The text in parts: those at odd places are spans.

    Spans are set off by a character that the text does not hold; a text that holds it is cut at
    its spans instead, which takes a second search.
    """
    every = _any(*_KIND_NAMES)
    pairs = F.zip_with(F.split(text, every), F.regexp_extract_all(text, F.lit(every), F.lit(0)), lambda gap, span: F.array(gap, span))

    def marked(lower: Column) -> Column:
        """Kinds are only sought in texts that hold what all of that kind have."""
        found = F
        secret = reduce(or_, [lower.contains(part) for part in _SECRET_PARTS])
        for needed, left_out in ((secret & text.contains("@"), ()), (secret, ("email",)), (text.contains("@"), ("secret",))):
            found = found.when(needed, _set_off(text, left_out))
        return found.when(text.rlike(_NUMERIC), _set_off(text, ("secret", "email"))).otherwise(text)

    return F.when(text.contains(_MARK), F.filter(F.flatten(pairs), lambda x: x.isNotNull())).otherwise(
        F.split(_let(F.lower(text), marked), _MARK)
    )


def _set_off(text: Column, left_out: Sequence[str]) -> Column:
    return F.regexp_replace(text, _any(*(n for n in _KIND_NAMES if n not in left_out)), f"{_MARK}$0{_MARK}")


def _covered(text: Column) -> Column:
    plain = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x.alias("mark"))
    return F.transform(_pieces(text), lambda x, i: F.when(i % 2 == 1, _cover(x)).otherwise(plain(x)))


def _joined(covered: Column) -> Column:
    return F.array_join(F.transform(covered, lambda x: x["mark"]), "")


def masked(text: Column) -> Column:
    """Text with every secret, e-mail address, IP address, card and phone number replaced."""
    return _without_phones(_joined(_covered(text)))


def _without_phones(text: Column) -> Column:
    return F.when(text.rlike(_NUMERIC), F.regexp_replace(text, PHONE, "[phone]")).otherwise(text)


def masked_texts(texts: DataFrame, key: str) -> DataFrame:
    """Masked text per row and the number of spans of each kind."""
    found = texts.select(key, _covered(F.col("text")).alias("_covered"))
    n = lambda kind: F.coalesce(F.size(F.filter("_covered", lambda x: x["kind"] == kind)), F.lit(0)).cast("bigint")
    cut = found.select(key, _joined(F.col("_covered")).alias("_cut"), *[n(kind).alias(name) for kind, name in _COUNTS.items()])
    done = cut.withColumn("masked_text", _without_phones(F.col("_cut")))
    phones = F.when(F.col("masked_text") == F.col("_cut"), 0).otherwise(F.regexp_count("_cut", F.lit(PHONE)))
    return done.select(key, "masked_text", *_COUNTS.values(), F.coalesce(phones, F.lit(0)).cast("bigint").alias("phones"))
