"""Format-preserving pseudonyms for personal numbers, dates and addresses.

DataFrame functions only. Candidates are found by one pattern, validated (Luhn,
octets, calendar), and permuted inside their own format by a keyed Feistel network,
so that equal values get equal pseudonyms in every document and different values of
a format get different ones. ``inverse=True`` undoes the permutation.

| kind | found as | permuted |
| --- | --- | --- |
| card | 13 to 19 digits in one, in fours, or in 4-6-4 or 4-6-5, spaces or hyphens between, valid by Luhn | all digits but the first and the check digit, which is computed anew |
| phone | ``+cc`` or ``(ddd)`` with 7 to 10 digits more | the last ten digits at most |
| ssn | ddd-dd-dddd | nine digits |
| ip | four octets to 255 | all 32 bits |
| date | yyyy-mm-dd, a day of 0001-01-01 to 2099-08-04 | the day, before 1900 or from 1900 on |
| email | local@domain | the local part becomes a keyed alias (no inverse) |

Anything that fails its validation stays as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DAYS_ROOT = 270  # 270 * 270 days from 1900-01-01
EARLY_DAYS = (745, 931)  # their product is the days from 0001-01-01 to 1899-12-31
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_.+@-])", r"(?![\p{L}\p{N}_@]|[.-]\p{N})"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
_DATE = r"\d{4}-\d{2}-\d{2}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}"
_PHONE = r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}|\d{3}[.-]\d{3}[.-]\d{4}"
_CARD = r"\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{13,19}"
PATTERN = f"{_EMAIL}|{_LEFT}(?:{_DATE}|{_SSN}|{_IP}|{_PHONE}|{_CARD}){_RIGHT}"
KINDS = ["email", "date", "ssn", "ip", "phone", "card"]


def _draw(key: str, label: Column, side: str, i: Column, value: Column, mod: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256, below ``mod``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), label, F.lit(side), i.cast("string"), value.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), mod)


def feistel(value: Column, left: Column, right: Column, key: str, label: Column, inverse: bool = False) -> Column:
    """Permute ``value`` (long) within [0, left * right) under the key; the label separates formats."""

    def halves(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def forward(s: Column, i: Column) -> Column:
        a = F.pmod(s["a"] + _draw(key, label, "a", i, s["b"], left), left)
        return halves(a, s["b"])

    def forward_b(s: Column, i: Column) -> Column:
        return halves(s["a"], F.pmod(s["b"] + _draw(key, label, "b", i, s["a"], right), right))

    def back(s: Column, i: Column) -> Column:
        return halves(F.pmod(s["a"] - _draw(key, label, "a", i, s["b"], left), left), s["b"])

    def back_b(s: Column, i: Column) -> Column:
        return halves(s["a"], F.pmod(s["b"] - _draw(key, label, "b", i, s["a"], right), right))

    # Even steps change the left half, odd steps the right one.
    steps = F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1))
    if inverse:
        steps = F.reverse(steps)
        step = lambda s, i: F.when(i % 2 == 0, back(s, i)).otherwise(back_b(s, i))
    else:
        step = lambda s, i: F.when(i % 2 == 0, forward(s, i)).otherwise(forward_b(s, i))
    start = halves(_div(value, right), F.pmod(value, right))
    return F.aggregate(steps, start, step, lambda s: s["a"] * right + s["b"])


def _div(a: Column, b: Column) -> Column:
    # Exact for longs, unlike the division of doubles.
    return F.call_function("div", a, b)


def _power10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, label: Column, inverse: bool = False) -> Column:
    """Permute a string of 2 to 18 digits within the strings of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    out = feistel(digits.cast("long"), _power10(n - low), _power10(low), key, F.concat(label, n.cast("string")), inverse)
    return F.lpad(out.cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of all digits, the last one counted once."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: _luhn_digit(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _luhn_digit(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))


def _in_format(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits`` in order."""

    def put(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike(r"^\d$"), F.substring(digits, before + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), put), "")


def kind_of(m: Column) -> Column:
    """The kind of a match, null where it fails its validation."""
    digits = F.regexp_replace(m, r"\D", "")
    day = F.when(m.rlike(f"^{_DATE}$"), F.try_to_date(m, "yyyy-MM-dd"))
    offset = F.date_diff(day, F.lit("1900-01-01").cast("date"))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    is_ip = m.rlike(f"^{_IP}$")
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(f"^{_DATE}$"), F.when((offset >= -EARLY_DAYS[0] * EARLY_DAYS[1]) & (offset < DAYS_ROOT * DAYS_ROOT), "date"))
        .when(m.rlike(f"^{_SSN}$"), "ssn")
        .when(is_ip, F.when(F.forall(octets, lambda x: x <= 255), "ip"))
        .when(m.rlike(f"^(?:{_PHONE})$"), F.when(F.length(digits).between(7, 15), "phone"))
        .when(F.length(digits).between(13, 19), F.when(luhn_sum(digits) % 10 == 0, "card"))
    )


def pseudonym(m: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """What stands for a match of the kind; the match itself for a null kind."""
    digits = F.regexp_replace(m, r"\D", "")
    n = F.length(digits)

    tail = F.least(n, F.lit(10))
    phone = F.concat(F.substring(digits, F.lit(1), n - tail), permute_digits(F.substring(digits, n - tail + 1, tail), key, F.lit("phone"), inverse))

    body = F.concat(F.substring(digits, 1, 1), permute_digits(F.substring(digits, F.lit(2), n - 2), key, F.lit("card"), inverse))
    # The check digit that brings the sum to a multiple of ten.
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, check.cast("string"))

    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.expr("0L"), lambda a, x: a * 256 + x)
    ip = feistel(number, F.expr("65536L"), F.expr("65536L"), key, F.lit("ip"), inverse)
    dotted = F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])

    first = F.lit("1900-01-01").cast("date")
    offset = F.date_diff(F.try_to_date(m, "yyyy-MM-dd"), first).cast("long")
    root = F.lit(DAYS_ROOT).cast("long")
    left, right = (F.lit(n).cast("long") for n in EARLY_DAYS)
    late = feistel(offset, root, root, key, F.lit("date"), inverse)
    early = feistel(offset + left * right, left, right, key, F.lit("early date"), inverse) - left * right
    day = F.date_add(first, F.when(offset < 0, early).otherwise(late).cast("int"))

    local, at = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    alias = m if inverse else F.concat(F.lit("user."), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), local), 256), 1, 12), F.lit("@"), at)
    return (
        F.when(kind == "email", alias)
        .when(kind == "date", F.date_format(day, "yyyy-MM-dd"))
        .when(kind == "ssn", _in_format(m, permute_digits(digits, key, F.lit("ssn"), inverse)))
        .when(kind == "ip", dotted)
        .when(kind == "phone", _in_format(m, phone))
        .when(kind == "card", _in_format(m, card))
        .otherwise(m)
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """Every row of ``docs`` with the personal values of its text replaced.

    Added: ``n_pii`` and ``n_email`` to ``n_card`` (long), which replace columns of
    those names. A null text stays null with counts of 0; a text without candidates
    stays untouched. Texts of any length are scanned whole; equal rows stay equal.
    The same key gives the same pseudonyms in every run.
    """
    counts = ["n_pii", *[f"n_{k}" for k in KINDS]]
    kept = [c for c in docs.columns if c not in counts]
    text = F.col(text_col)
    may = text.rlike("[0-9@]")
    step = docs.select(*kept, F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), 0)).alias("_found"))
    step = step.withColumn("_kinds", F.transform(F.col("_found"), kind_of))
    hits = F.size(F.filter(F.col("_kinds"), lambda k: k.isNotNull())) > 0
    said = F.zip_with(F.col("_found"), F.col("_kinds"), lambda m, k: pseudonym(m, k, key, inverse))
    gaps = F.split(text, PATTERN, -1)
    new = F.array_join(F.zip_with(gaps, said, lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    columns = [F.when(hits, new).otherwise(text).alias(c) if c == text_col else F.col(c) for c in kept]
    n = lambda keep: F.when(F.col("_kinds").isNull(), 0).otherwise(F.size(F.filter(F.col("_kinds"), keep))).cast("long")
    total = reduce(lambda a, b: a + b, [F.col(f"n_{k}") for k in KINDS])
    is_kind = lambda k: lambda x: x == k
    out = step.select(*columns, *[n(is_kind(k)).alias(f"n_{k}") for k in KINDS])
    return out.select(*kept, total.alias("n_pii"), *counts[1:])
