"""Scalar functions on text, all inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# Fixed value: hyphens that normalisation folds, without the katakana middle dot and length mark.
HYPHENS = "‐‑‒–—―−－"

_SENTINEL = "\u0001"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once; inside lambdas Spark would compute it at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nfkc(col: Column) -> Column:
    """NFKC in the JVM, by the Unicode library that ships with Spark; null stays null.

    Spark treats calls by reflection as not deterministic, so the result may stand
    in a projection only, not in a lambda, a join condition or an aggregate.
    """
    call = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(col, F.lit("")), F.lit(True))
    return F.when(col.isNotNull(), call)


def normalize(col: Column) -> Column:
    """NFKC, line feeds for all line breaks, ASCII hyphens. Idempotent; offsets are counted on its result."""
    lines = F.regexp_replace(F.replace(nfkc(col), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    return F.translate(lines, HYPHENS, "-" * len(HYPHENS))


def digits(col: Column) -> Column:
    """Only the decimal digits of any script."""
    return F.regexp_replace(col, r"(?U)\D", "")


def luhn_ok(number: Column) -> Column:
    """Luhn check of a number with at least 12 digits after everything else is taken out; false for null."""
    d = F.regexp_replace(number, "[^0-9]", "")
    return F.coalesce((F.length(d) >= 12) & F.call_function("luhn_check", d), F.lit(False))


def mynumber_ok(number: Column) -> Column:
    """Check digit of a 12-digit individual number; false for other lengths and null."""
    d = F.regexp_replace(number, "[^0-9]", "")
    weights = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
    total = sum((F.try_to_number(F.substring(d, i, 1), F.lit("9")).cast("int") * w for i, w in enumerate(weights, 1)), F.lit(0))
    rest = total % 11
    check = F.when(rest <= 1, 0).otherwise(11 - rest)
    return F.coalesce((F.length(d) == 12) & (F.substring(d, 12, 1) == check.cast("string")), F.lit(False))


def jp_phone_ok(number: Column) -> Column:
    """Length and prefix of a Japanese phone number; the international form is not accepted. False for null."""
    d = digits(number)
    n = F.length(d)
    head = F.substring(d, 1, 3)
    eleven = head.isin("070", "080", "090", "050") | (F.substring(d, 1, 4) == "0800")
    return F.coalesce(d.startswith("0") & F.when(eleven, n == 11).otherwise(n == 10), F.lit(False))


def looks_like_date(text: Column) -> Column:
    return F.coalesce(
        F.trim(text).rlike(r"^(19|20)\d{2}[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])$"), F.lit(False)
    )


def slice_of(text: Column, start: Column, end: Column) -> Column:
    """Code points start..end of the text."""
    return F.substring(text, start + 1, end - start)


def context(text: Column, start: Column, end: Column, width: int) -> Column:
    """The text from `width` code points before start to `width` after end."""
    low = F.greatest(start - width, F.lit(0))
    return F.substring(text, low + 1, end + width - low)


def first_word(text: Column, words: tuple[str, ...]) -> Column:
    """The first of the words, in their order, that the text contains; null if none."""
    if not words:
        return F.lit(None).cast("string")
    return F.get(F.filter(word_list(words), lambda w: F.contains(text, w)), F.lit(0))


def word_list(words: tuple[str, ...]) -> Column:
    """The words as one constant array, which costs less to plan than a literal for each."""
    return F.split(F.lit(_SENTINEL.join(words)), _SENTINEL)


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(word_list(words), lambda w: F.contains(text, w))


def unicode_classes(pattern: str) -> str:
    """The pattern with digits and blanks of all scripts, which costs less than the engine's own Unicode mode."""
    blank = r"\s\x{85}\p{Z}"
    inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", blank).replace(r"\d", r"\p{Nd}"), pattern)
    return inside.replace(r"\d", r"\p{Nd}").replace(r"\s*", f"[{blank}]*").replace(r"\s+", f"[{blank}]+")


def pattern_matches(text: Column, pattern: str) -> Column:
    """array<struct<start_pos int, text string>> of the non-overlapping matches, offsets in code points."""
    marked = F.regexp_replace(F.translate(text, _SENTINEL, "\u0002"), unicode_classes(pattern), f"{_SENTINEL}$0{_SENTINEL}")
    parts = F.split(marked, _SENTINEL, -1)
    kind = "struct<pos:int,odd:boolean,out:array<struct<start_pos:int,text:string>>>"
    zero = F.struct(
        F.lit(0).alias("pos"), F.lit(False).alias("odd"),
        F.array().cast("array<struct<start_pos:int,text:string>>").alias("out"),
    ).cast(kind)

    def step(acc: Column, part: Column) -> Column:
        hit = F.array(F.struct(acc["pos"].alias("start_pos"), part.alias("text")))
        return F.struct(
            (acc["pos"] + F.length(part)).alias("pos"), (~acc["odd"]).alias("odd"),
            F.when(acc["odd"], F.concat(acc["out"], hit)).otherwise(acc["out"]).alias("out"),
        ).cast(kind)

    return F.aggregate(parts, zero, step)["out"]


def preview(value: Column) -> Column:
    """First and last character with dots between; two characters or fewer are all dots."""
    n = F.length(value)
    long = F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("●"), n - 2), F.right(value, F.lit(1)))
    return F.when(n <= 2, F.repeat(F.lit("●"), n)).otherwise(long)


def summary_preview(value: Column) -> Column:
    """First character and dots. A value of one character is shown whole."""
    return F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("●"), F.greatest(F.length(value) - 1, F.lit(0))))


def placeholder(label: Column, n: Column, style: str = "angle") -> Column:
    low, high = vocab.STYLES[style]
    return F.concat(F.lit(low), label, F.lit("_"), n.cast("string"), F.lit(high))


def hiragana(col: Column) -> Column:
    """Katakana to hiragana."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(col, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def fullwidth(col: Column) -> Column:
    """ASCII to full-width forms, blanks included."""
    narrow = "".join(map(chr, range(0x20, 0x7F)))
    return F.translate(col, narrow, "　" + "".join(map(chr, range(0xFF01, 0xFF5F))))


def kanji_number(n: Column) -> Column:
    """1..99 in kanji; null outside."""
    ones = "一二三四五六七八九"
    unit, ten = n % 10, F.floor(n / 10)
    digit = lambda k: F.when(k >= 1, F.substring(F.lit(ones), k.cast("int"), F.lit(1))).otherwise("")
    tens = F.when(ten == 0, "").when(ten == 1, "十").otherwise(F.concat(digit(ten), F.lit("十")))
    return F.when(n.between(1, 99), F.concat(tens, digit(unit)))


def wareki(day: Column) -> Column:
    """Japanese era date, such as 昭和元年12月25日; null before the first era."""
    chosen = F.lit(None).cast("string")
    for era, first in vocab.ERAS:
        year = F.year(day) - int(first[:4]) + 1
        label = F.when(year == 1, "元").otherwise(year.cast("string"))
        text = F.concat(F.lit(era), label, F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.day(day).cast("string"), F.lit("日"))
        chosen = F.when(day >= F.to_date(F.lit(first)), text).otherwise(chosen)
    return chosen
