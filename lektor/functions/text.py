"""Text scalars as Spark columns; everything here stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic-Indic and extended Arabic-Indic digits, in order.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
WESTERN_DIGITS = "01234567890123456789"
# Letters that are folded to their common form, and that form, in order.
FOLD_FROM = "\u064A\u0649\u0643\u0647\u06C2\u06C0"
FOLD_TO = "\u06CC\u06CC\u06A9\u06C1\u06C1\u06C1"
# Vowel marks and tatweel; invisible direction and join marks.
MARKS = r"[ً-ٰٟۖ-ۜ۟-۪ۨ-ۭـ]"
INVISIBLE = r"[​-‏‪-‮⁦-⁩﻿]"
# Blocks whose letters count as Arabic script.
ARABIC_LETTERS = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿&&\p{L}]"


# The vowel marks whose density tells vowelled scripture, and the least letters and density.
VOWEL_MARKS, SCRIPTURE_LETTERS, SCRIPTURE_DENSITY = r"[\u064B-\u0652\u0670\u06E1]", 6, 0.25
# Ornate brackets around a verse number, either way round.
VERSE_MARK = r"[\uFD3E\uFD3F][^\uFD3E\uFD3F]{0,12}[\uFD3E\uFD3F]"
EASTERN_DIGIT = "[\u0660-\u0669\u06F0-\u06F9]"


def squeeze(text: Column) -> Column:
    """White space of any kind collapsed to one space, and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def western_digits(text: Column) -> Column:
    return F.translate(text, ARABIC_DIGITS, WESTERN_DIGITS)


def fold(text: Column) -> Column:
    """The comparison form but for compatibility composition, which ``udf.nfkc`` does before it."""
    bare = F.regexp_replace(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), MARKS, ""), INVISIBLE, "")
    return squeeze(bare)


def latin_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def arabic_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ARABIC_LETTERS))


def dominant_script(text: Column) -> Column:
    """arabic where it has as many letters as Latin or more, null without letters."""
    ar, la = arabic_letters(text), latin_letters(text)
    return F.when(ar + la == 0, None).when(ar >= la, "arabic").otherwise("latin")


def is_scripture(text: Column) -> Column:
    """Fully vowelled Arabic: vowel marks on a quarter of the letters or more."""
    letters = arabic_letters(text)
    return F.coalesce((letters >= SCRIPTURE_LETTERS) & (F.regexp_count(text, F.lit(VOWEL_MARKS)) >= SCRIPTURE_DENSITY * letters), F.lit(False))


def outside_verse_marks(text: Column) -> Column:
    return F.regexp_replace(text, VERSE_MARK, " ")


def eastern_digits(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EASTERN_DIGIT))


TOKEN = r"\p{L}{2,}"


def loose(text: Column) -> Column:
    """Lower case, every run of other characters than letters, digits and underscores one space, trimmed; letters of any script."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def loose_digits(text: Column) -> Column:
    """``loose`` of the folded text with Western digits: what marks are found by."""
    return loose(western_digits(fold(text)))


def unnumbered(loose_text: Column) -> Column:
    return F.regexp_replace(loose_text, r"^(?:[0-9]+ )+", "")


ELLIPSIS = r"\.\.\.|\u2026|\[\.\.\.[^\]]*\]"


def fragments(quote: Column, shortest: int = 8) -> Column:
    """The parts of a quote between ellipses (bracketed ones with what they hold), in loose form, short ones left out."""
    return F.filter(F.transform(F.split(quote, ELLIPSIS), loose), lambda f: F.length(f) >= shortest)


def pieces(mark: Column, shortest: int = 6) -> Column:
    """The parts of a mark between ellipses and line ends."""
    return F.filter(F.transform(F.split(mark, ELLIPSIS + r"|\n"), loose_digits), lambda f: F.length(f) >= shortest)


def tokens(text: Column) -> Column:
    """Lower-case letter runs of two or more, of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def title_words(title: Column, stop: list[str] = ()) -> Column:
    """The set of a title's words without stop words."""
    words = F.array_distinct(F.filter(F.split(F.lower(western_digits(fold(title))), r"[^\p{L}]+"), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def any_of(labels: list[str]) -> str:
    """A pattern of any of the labels, in lower case."""
    return "(?:" + "|".join(re.escape(x.lower()) for x in labels) + ")"


def unlabelled(text: Column) -> Column:
    """A line as labels are looked for in it: folded, lower case, numbering and bullets stripped."""
    return F.regexp_replace(F.lower(fold(text)), "^[ 0-9.()\\-–—•*#]+", "")


def label_leads(bare: Column, labels: list[str], longest: int = 80) -> Column:
    """Whether a label begins the line and ends it, is followed by a separator, or the line is short."""
    leads = any_of(labels)
    return F.coalesce(bare.rlike(rf"^{leads}\s*(?:$|[:：—–\-|·])") | (bare.rlike("^" + leads) & (F.length(bare) <= longest)), F.lit(False))


def starts_with_label(text: Column, labels: list[str], longest: int = 80) -> Column:
    """``label_leads`` of a line as written."""
    return label_leads(unlabelled(text), labels, longest)


def contains_any(text: Column, labels: list[str]) -> Column:
    return F.coalesce(text.rlike(any_of(labels)), F.lit(False))


def begins_with_any(text: Column, labels: list[str]) -> Column:
    return F.coalesce(text.rlike("^" + any_of(labels)), F.lit(False))


def number_after(text: Column, keyword: str) -> Column:
    """The number of one or two digits behind a keyword."""
    return F.regexp_extract(F.lower(text), keyword + r"[^0-9a-z]*([0-9]{1,2})", 1).try_cast("int")


def roman(text: Column) -> Column:
    """Value of a roman numeral below 200, null for anything else."""
    low = F.lower(F.trim(text))
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
    at = F.transform(F.split(low, ""), lambda ch: F.coalesce(*[F.when(ch == k, v) for k, v in value.items()]))
    total = F.aggregate(
        F.reverse(at),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")),
        lambda acc, x: F.struct((acc["sum"] + F.when(x < acc["top"], -x).otherwise(x)).alias("sum"), F.greatest(acc["top"], x).alias("top")),
    )["sum"]
    return F.when(low.rlike("^(c)?(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (low != ""), total)


def question_number(text: Column) -> Column:
    digits = western_digits(F.trim(text))
    return F.coalesce(F.when(digits.rlike("^[0-9]{1,9}$"), digits.try_cast("int")), roman(text))


def version_key(text: Column) -> Column:
    """Parts of the first ``v1.2``-like version as an array of ints (empty without one); arrays order as tuples do."""
    found = F.regexp_extract(F.lower(text), r"v([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda p: p.try_cast("int"))).otherwise(F.array().cast("array<int>"))


def part_letter(number: Column) -> Column:
    """1 to 26 as A to Z, anything else the empty text."""
    return F.when(number.between(1, 26), F.char(number + 64)).otherwise("")


_VERSION = r"([0-9]{1,2}(?:\.[0-9]{1,3}){0,3})(?![0-9.]*[0-9])"  # fixed value: a year is no version


def last_version(text: Column) -> Column:
    """The last number behind a v that follows no letter, or behind the word version; null without one."""
    found = F.regexp_extract_all(western_digits(text), F.lit(r"(?i)(?:(?<![A-Za-z])v|\bversion\s*[:#]?\s*|\bver\.\s*|ورژن\s*[:#]?\s*)" + _VERSION), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def version_line(text: Column) -> Column:
    """The version that a line names, where it says nothing else."""
    return F.nullif(F.regexp_extract(western_digits(text), r"(?i)^\s*(?:version|ver\.|ورژن)\s*[:#]?\s*" + _VERSION + r"\s*$", 1), F.lit(""))


def find_version(stem: Column, footer: Column, stated: Column, lines: Column) -> Column:
    """A document's version from its name, footer, properties or first lines (an array), the first that has one."""
    own = F.nullif(F.regexp_extract(western_digits(stated), r"(?i)^\s*v?\s*" + _VERSION + r"\s*$", 1), F.lit(""))
    told = F.try_element_at(F.filter(F.transform(lines, version_line), lambda v: v.isNotNull()), F.lit(1))
    bare_footer = F.regexp_replace(footer, r"(?i)\|\s*v0\.1\s*\|\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*\|\s*(?:Page|$)", "|")
    return F.coalesce(last_version(stem), last_version(bare_footer), own, told)


def leading_number(text: Column) -> Column:
    """A decimal number of up to six parts in front of a text, as an array of ints; null without one."""
    found = F.regexp_extract(western_digits(text), r"^\s*([0-9]+(?:\.[0-9]+){0,5})[.)]?\s+\S", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda p: p.try_cast("int")))


def seconds(text: Column) -> Column:
    """The latest ``m:ss`` of a text, else ``N s`` or ``N min``, in seconds."""
    return seconds_span(text)["secs"]


def seconds_span(text: Column) -> Column:
    """struct (secs, is_end): whether the seconds are the end of a range of times."""
    low = F.lower(western_digits(fold(text)))
    times = F.transform(F.regexp_extract_all(low, F.lit(r"([0-9]+:[0-9]{2})"), F.lit(1)), lambda t: F.element_at(F.split(t, ":"), 1).try_cast("int") * 60 + F.element_at(F.split(t, ":"), 2).try_cast("int"))
    n, unit = F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?)\s*(s|m|منٹ|سیکنڈ)", 1).try_cast("double"), F.regexp_extract(low, r"([0-9]+(?:\.[0-9]+)?)\s*(s|m|منٹ|سیکنڈ)", 2)
    single = F.when(unit.isin("m", "منٹ"), n * 60).when(unit != "", n)
    return F.struct(F.coalesce(F.array_max(times).cast("double"), single).alias("secs"), (F.size(times) > 0).alias("is_end"))


def minutes_range(text: Column) -> Column:
    """``3 min`` or ``3-5 min`` as struct (lo, hi)."""
    low, pattern = F.lower(western_digits(fold(text))), r"([0-9]+)\s*(?:[-–—]\s*([0-9]+))?\s*(?:min|منٹ)"
    lo, hi = (F.regexp_extract(low, pattern, k).try_cast("int") for k in (1, 2))
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), F.coalesce(hi, lo).alias("hi")))


def chapter_number(text: Column, ordinals: dict[int, list[str]], words: tuple[str, ...] = ("chapter", "باب")) -> Column:
    """``chapter 3`` or ``chapter third``: the number behind a chapter word, in digits or as an ordinal."""
    low, word = F.lower(western_digits(fold(text))), "(?:" + "|".join(words) + ")"
    named = [F.when(low.rlike(rf"{word}\s*(?:{'|'.join(names)})(?![\p{{L}}\p{{N}}])"), n) for n, names in ordinals.items()]
    return F.coalesce(F.regexp_extract(low, word + r"\s*([0-9]+)", 1).try_cast("int"), *named)


def statement(text: Column) -> Column:
    """The comparison form of a learning outcome: folded, lower case, without punctuation at the end."""
    return F.lower(F.regexp_replace(fold(text), r"[\s.۔\-–—؛:,;]+$", ""))


def bullet_text(text: Column) -> Column:
    """Whether a line begins with a typed bullet."""
    return F.coalesce(text.rlike(r"^\s*(?:[•▪●◦]|[\-–—*]\s)"), F.lit(False))


def numbered_text(text: Column) -> Column:
    return F.coalesce(western_digits(text).rlike(r"^\s*\(?[0-9]+[.)]\s"), F.lit(False))


def run_in(text: Column, labels: list[str]) -> Column:
    """Length of the label of ``Label: long text``, where it is a known one or the text is long; else null."""
    pattern = r"(?s)^(.{2,60}?)\s*[:：]\s*(\S.{30,})$"
    head, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when((head != "") & (starts_with_label(head, labels) | (F.length(rest) > 60)), F.length(head))


def clean_title(label: Column) -> Column:
    """A folder's label without lesson, chapter and part numbers, in words."""
    bare = label
    for word in ("lesson", "(?:chapter|chpater)", "part"):
        bare = F.regexp_replace(bare, rf"(?i)^{word}[-_ ]*[0-9]+[-_ ]*", "")
    return F.trim(F.translate(bare, "-_", "  "))


def short_key(chapter: Column, lesson: Column, variant: Column) -> Column:
    head = F.concat(F.lit("Ch"), chapter.cast("string"))
    return F.when(lesson.isNull(), head).otherwise(F.concat(head, F.lit("-L"), lesson.cast("string"), F.coalesce(variant, F.lit(""))))


def lesson_label(chapter: Column, lesson: Column, variant: Column, folder: Column) -> Column:
    """What a lesson is called in reports."""
    base = F.concat(F.lit("Chapter "), chapter.cast("string"), F.lit(" - Lesson "), lesson.cast("string"), F.coalesce(variant, F.lit("")))
    title = clean_title(F.coalesce(folder, F.lit("")))
    whole = F.concat(F.lit("Chapter "), chapter.cast("string"), F.lit(" (no lesson folders)"))
    return F.when(lesson.isNull(), whole).when(title != "", F.concat(base, F.lit(" ("), title, F.lit(")"))).otherwise(base)


def outcome_label(chapter: Column, lesson: Column, index: Column) -> Column:
    return F.concat(F.lit("Ch"), chapter.cast("string"), F.lit(" L"), lesson.cast("string"), F.lit(" SLO "), index.cast("string"))


def without_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))


def file_stem(rel: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"\.[^.]+$", "")


def percent(share: Column) -> Column:
    """Whole percent, half to even."""
    return F.concat(F.format_number(F.bround(share * 100, 0), "0"), F.lit("%"))


def canonical_font(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[\s_-]", "")


def is_yellow(color: Column) -> Column:
    r, g, b = (F.conv(F.substring(color, 1 + 2 * k, 2), 16, 10).try_cast("int") for k in range(3))
    return color.rlike("^[0-9A-Fa-f]{6}$") & (r >= 200) & (g >= 190) & (b <= 170)


def is_grey(color: Column, tolerance: int = 14) -> Column:
    """Channels within the tolerance of each other; what isn't a colour counts as grey."""
    r, g, b = (F.conv(F.substring(color, 1 + 2 * k, 2), 16, 10).try_cast("int") for k in range(3))
    return ~color.rlike("^[0-9A-Fa-f]{6}$") | (F.greatest(r, g, b) - F.least(r, g, b) <= tolerance)


# Names of theme colours that are neutral.
NEUTRAL_THEME = ("text1", "background1", "dark1", "light1", "tx1", "bg1")


def is_neutral(color: Column, theme: Column, tolerance: int = 14) -> Column:
    return F.coalesce(F.lower(theme).isin(*NEUTRAL_THEME), F.lit(False)) | F.coalesce(is_grey(color, tolerance), F.lit(True))


def top_counts(counts: Column, n: int = 4) -> Column:
    """The n most frequent of an array of structs (k, n) as ``k: n, ...``; ties by key."""
    ordered = F.array_sort(F.transform(counts, lambda c: F.struct((-c["n"]).alias("m"), c["k"].alias("k"))))
    return F.array_join(F.transform(F.slice(ordered, 1, n), lambda c: F.concat(c["k"].cast("string"), F.lit(": "), (-c["m"]).cast("string"))), ", ")
