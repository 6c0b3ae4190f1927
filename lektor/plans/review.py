"""Every deterministic rule as a query over stand-in document tables, each with its SQL.

Lines of ``documents`` become paragraphs: about half keep their text, the others get a line that a rule looks for, and style, fonts, lists and
tables follow from the numbers of document and line. Turns of ``conversations`` become slides and storyboard rows. The expressions are plain
SQL that both engines read, so the tables are the same on both sides while rules and SQL are written apart.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektor.functions import profile as P
from lektor.functions import text as T
from lektor.operators import assessments, judgements, rules
from lektor.plans.catalogue import _lines, query
from lektor.sources.tables import table

V, SECTIONS = P.PROFILE["vocab"], P.PROFILE["lesson_plan_sections"]
SAMPLES = [
    "Introduction", "SLOs: by the end", "Learning Outcomes", "Warm-up", "Concept Building", "Key Takeaways", "1. What is a noun?", "A) first choice", "B) second choice", "C) third choice", "Question 2: Name the SLO 2 topic (higher order)",
    "Q3 Explain the word", "Lesson 4", "Answer Key", "Table 1: Prices", "Figure 2: A map", "(Smith, 2019) says so", "as shown in [3] and [4, 5]", "(Khan & Ali 2020) reports", "References", "Glossary Terms", "All of the above", "Book and SLO Coverage",
    "Book Heading", "By the end of this lesson you will know:", "Knowledge:", "• recall the main facts of it", "- describe the water cycle", "1) list three rivers here", "Note: for teachers only", "سبق ٣ کا عنوان", "قُلْ هُوَ اللَّهُ أَحَدٌ", "﴿١٥٣﴾ ایت", "1.1 Solids and liquids",
    "2 Gases", "Leaves / Roots / Branches", "Model answer: it is blue.", "This is the first sentence. This is the second one.", "تعارف", "Edited from: an older film", "New video", "Correct feedback: well done", "Lesson Plan Location: after 4.2", "Is it true or false?",
    "Fill in the ____ here", "Answer: because", "Match the pairs", "(4) Which one is right?", "Chapter 2: Matter", "Table 2: Costs", "Figure 1: A plan", "Remember to understand this",
]


def _case(key: str, values: list[str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


K = "CASE WHEN doc_id % 6 = 0 THEN (idx + doc_id % 7) % 60 ELSE (doc_id * 31 + idx * 17) % 97 END"
#: Paragraph columns by expressions over doc_id, idx, k and line.
COLUMNS = {
    "rel": "concat('d', doc_id)", "text": _case("k", SAMPLES, "line"), "style": "CASE WHEN (doc_id + idx) % 41 = 0 THEN 'Title' WHEN (doc_id + idx) % 37 = 0 THEN 'Caption' ELSE 'Normal' END",
    "heading_level": "CASE WHEN (doc_id + idx) % 7 = 0 THEN 1 WHEN (doc_id + idx) % 7 = 3 THEN 2 END", "in_table": "(doc_id + idx) % 10 >= 8", "table_idx": "CASE WHEN (doc_id + idx) % 10 >= 8 THEN 0 END", "row_idx": "CASE WHEN (doc_id + idx) % 10 >= 8 THEN idx % 2 END",
    "in_toc": "(doc_id + 3 * idx) % 29 = 0", "list_kind": "CASE WHEN (doc_id + idx) % 6 = 0 THEN 'decimal' WHEN (doc_id + idx) % 6 = 3 THEN 'bullet' END", "num_label": "CASE WHEN (doc_id + idx) % 6 = 0 AND doc_id % 2 = 0 THEN concat(idx % 4 + 1, '.') END",
    "line_kind": "CASE WHEN doc_id % 17 = 0 AND idx % 3 = 0 THEN 'points' ELSE 'multiple' END", "line_value": "CASE WHEN doc_id % 3 = 0 AND idx % 5 = 0 THEN 1.0 ELSE 1.15 END", "all_bold": "(doc_id + idx) % 4 = 0", "bidi": "(doc_id % 9 = 0 AND idx % 4 = 0)", "hanging": "CASE WHEN doc_id % 2 = 0 THEN 1 ELSE idx % 2 END",
    "space_after": "CASE WHEN doc_id % 4 = 0 AND idx % 7 = 1 THEN NULL WHEN doc_id % 4 = 1 THEN 6.0 ELSE 8.0 END", "shading": "CASE WHEN (doc_id + idx) % 31 = 0 THEN 'FFFF66' WHEN idx % 6 = 0 THEN 'auto' END", "script": "CASE WHEN k IN (30, 31, 32, 38) THEN 'arabic' ELSE 'latin' END",
    "font": "CASE WHEN k IN (30, 31, 32, 38) THEN CASE doc_id % 3 WHEN 0 THEN 'Noto Nastaliq Urdu' WHEN 1 THEN 'noto-nastaliq' ELSE 'Arial' END WHEN doc_id % 5 = 0 AND idx % 4 = 0 THEN NULL WHEN doc_id % 5 = 1 AND idx % 2 = 0 THEN 'Montserrat' WHEN doc_id % 5 = 2 THEN 'Calibri' ELSE 'Pop pins' END",
    "size": "CASE WHEN doc_id % 4 = 0 THEN 12.0 WHEN idx = 0 THEN 20.0 WHEN idx % 5 = 1 THEN 14.0 WHEN doc_id % 4 = 1 AND idx % 9 = 0 THEN NULL ELSE 12.0 END", "bold": "(doc_id % 4 = 2 OR idx % 3 = 0)", "italic": "idx % 2 = 0",
    "color": "CASE WHEN (doc_id + idx) % 23 = 0 THEN 'FF0000' WHEN idx % 4 = 0 THEN 'auto' WHEN idx % 4 = 1 THEN '333333' END", "highlight": "CASE WHEN (doc_id + idx) % 19 = 0 THEN 'yellow' END",
}
RUN = ("text", "script", "font", "size", "bold", "italic", "color", "highlight")
DOC = {
    "rel": "concat('d', doc_id)", "doc_type": "CASE doc_id % 6 WHEN 0 THEN 'lesson_plan' WHEN 1 THEN 'chapter_exam' WHEN 2 THEN 'worksheet' WHEN 3 THEN 'pop_quiz' WHEN 4 THEN 'data_bank' ELSE 'video_storyboard' END", "pages": "CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END", "lang": "lang",
    "width_in": "CASE WHEN doc_id % 7 = 0 THEN 11.0 ELSE 8.27 END", "height_in": "11.69", "margin": "CASE WHEN doc_id % 11 = 0 THEN 0.5 ELSE 1.01 END",
    "footer": "CASE doc_id % 6 WHEN 0 THEN 'Plan v1.2 2024-05-01 Page 1' WHEN 1 THEN 'Plan' WHEN 2 THEN 'v1' WHEN 3 THEN 'Guide v2' WHEN 4 THEN 'Guide V3 1 May 2024' ELSE '' END", "field": "CASE doc_id % 6 WHEN 3 THEN 'DATE' WHEN 4 THEN 'PAGE' END",
}
NAME = "concat(CASE doc_id % 9 WHEN 0 THEN concat('LessonPlan-G6-Topic', doc_id, '-v1.0') WHEN 1 THEN concat('Plan final ', doc_id) WHEN 2 THEN concat('سبق-چھ-موضوع', doc_id, '-v2') WHEN 3 THEN concat('Quiz-draft-x', doc_id, '-v1') WHEN 4 THEN concat('No-Version-', doc_id) WHEN 5 THEN concat('a-b-c', doc_id, '-V3') ELSE concat('Type-Id-Chapter-', doc_id, '-v0.', doc_id % 10) END, '.docx')"
TITLES = ["Introduction", "Session Overview", "Warm-up", "Concept Building", "Concept Building: more", "Recap", "Cover", "SLOs"]
SLIDE = {
    "rel": "concat('c', conv_id)", "slide": "turn + 1", "title": "CASE WHEN conv_id % 3 = 0 THEN " + _case("turn", ["Introduction", "SLOs", "Warm-up", "Concept Building", "Key Takeaways"], "'More'") + " ELSE " + _case("(conv_id * 13 + turn * 7) % 11", TITLES, "'Other'") + " END",
    "body": "CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN concat('Total duration: ', conv_id % 9 + 4, ' minutes') WHEN (conv_id + turn) % 7 = 0 THEN concat('Teacher note ', text) ELSE text END",
    "notes": "CASE WHEN (conv_id + turn) % 5 = 0 AND conv_id % 4 > 0 THEN '' WHEN (conv_id + turn) % 3 = 0 THEN concat('Time: ', turn % 5 + 1, '-', turn % 5 + 3, ' min. An example, a poll, a misconception, a video and a bridge') ELSE concat('2 min: ', text) END",
    "width": "CASE WHEN conv_id % 8 = 0 THEN 9144000 ELSE 12192000 END", "height": "6858000", "spacing": "CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 AND turn = 1 THEN 1.0 ELSE 1.5 END",
    "kinds": "CASE conv_id % 3 WHEN 0 THEN 'ftr,sldNum,dt' WHEN 1 THEN 'ftr,sldNum' ELSE 'dt' END", "foot": "CASE WHEN conv_id % 2 = 0 THEN 'Guide v2' ELSE 'Guide' END",
}
#: Storyboard columns by number: what the header says, and what the rows hold.
BOARD = [
    ("'Scene'", "concat('S', turn)"), ("CASE WHEN conv_id % 5 = 0 THEN 'Length' ELSE 'Duration' END", "CASE conv_id % 4 WHEN 0 THEN concat(turn, ':30') WHEN 1 THEN concat(turn * 20 + 5, ' s') WHEN 2 THEN '1 min' ELSE 'later' END"),
    ("CASE WHEN conv_id % 7 = 0 THEN 'Words' ELSE 'On-Screen Text' END", "CASE WHEN conv_id % 2 = 0 THEN 'short label' ELSE text END"), ("CASE WHEN conv_id % 3 = 0 THEN 'Voice' ELSE 'Narration' END", "text"), ("CASE WHEN conv_id % 2 = 0 THEN 'Animation / Visual' ELSE 'Picture' END", "'x'"),
]


def _spread(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


def paras(spark, d: str) -> DataFrame:
    rows = _lines(spark, d).selectExpr("doc_id", "idx", "line", f"{K} AS k").selectExpr("doc_id", "idx", "k", *_spread(COLUMNS))
    rows = rows.withColumn("heading_level", F.col("heading_level").cast("int")).withColumn("size", F.col("size").cast("double")).withColumn("line_value", F.col("line_value").cast("double"))
    return rows.withColumn("runs", F.array(F.struct(*RUN)))


def docs(spark, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", *_spread(DOC))


def slides(spark, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", "text", *_spread(SLIDE))
    kinds = F.transform(F.split("kinds", ","), lambda k: F.struct(k.alias("kind"), F.when(k == "ftr", F.col("foot")).otherwise("").alias("text")))
    run = F.struct(F.col("body").alias("text"), F.lit("Poppins").alias("font"), F.col("spacing").cast("double").alias("spacing"))
    return rows.select("rel", F.col("slide").cast("int").alias("slide"), "title", F.array("body").alias("texts"), "notes", "width", "height", kinds.alias("footers"), F.array(run).alias("runs"))


def boards(spark, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    head = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).selectExpr("conv_id", f"array({', '.join(h for h, _ in BOARD)}) AS texts", "0 AS row")
    body = rows.selectExpr("conv_id", f"array({', '.join(b for _, b in BOARD)}) AS texts", "cast(turn + 1 AS int) AS row")
    return head.unionByName(body).select(F.concat(F.lit("c"), F.col("conv_id")).alias("rel"), F.lit(0).alias("table_idx"), "row", F.posexplode("texts").alias("col", "text"))


def tables(spark, d: str) -> rules.Tables:
    p, o = paras(spark, d), docs(spark, d)
    pictures = p.where("k % 13 = 5").selectExpr("rel", "idx AS place", "CASE doc_id % 3 WHEN 0 THEN 'a.png' WHEN 1 THEN 'b.emf' ELSE 'c.jpg' END AS name", "CASE WHEN idx % 2 = 0 THEN '' ELSE 'x' END AS descr", "300 + (idx % 5) * 200 AS width_px", "914400 * (2 + doc_id % 3) AS width_emu")
    return {
        "paras": p, "docs": o, "pages": o.selectExpr("rel", "cast(width_in AS double) width_in", "cast(height_in AS double) height_in", "array(cast(1.0 AS double), cast(margin AS double)) AS margins"),
        "parts": o.selectExpr("rel", "'footer' AS kind", "footer AS text", "array_compact(array(field)) AS fields"), "images": pictures, "slides": slides(spark, d), "cells": boards(spark, d),
    }


# the same in SQL


def _marks(pattern: str) -> str:
    return pattern.replace("'", "''")


FOLDED = f"trim(regexp_replace(regexp_replace(regexp_replace(translate({{x}}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '{T.MARKS}', '', 'g'), '{T.INVISIBLE}', '', 'g'), '[\\s\\x{{{{00A0}}}}]+', ' ', 'g'))"


def fold(x: str) -> str:
    return FOLDED.replace("{x}", x).replace("{{{{", "{").replace("}}}}", "}").replace("{{", "{").replace("}}", "}")


def western(x: str) -> str:
    return f"translate({x}, '{T.ARABIC_DIGITS}', '{T.WESTERN_DIGITS}')"


def label(x: str, labels: list[str]) -> str:
    """Whether a line begins with a label, as ``starts_with_label``."""
    bare = f"regexp_replace(lower({fold(x)}), '^[ 0-9.()\\-–—•*#]+', '')"
    rest = lambda n: f"ltrim(substr({bare}, {n + 1}))"
    return "(" + " OR ".join(f"(starts_with({bare}, '{v.lower()}') AND ({rest(len(v))} = '' OR regexp_matches({rest(len(v))}, '^[:：—–\\-|·]') OR length({bare}) <= 80))" for v in labels) + ")"


def holds(x: str, labels: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{v.lower()}')" for v in labels) + ")"


def begins(x: str, labels: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{v.lower()}')" for v in labels) + ")"


def within(x: str, labels: list[str]) -> str:
    return f"{x} IN (" + ", ".join(f"'{v.lower()}'" for v in labels) + ")"


def pattern(p: str) -> str:
    """A pattern without what RE2 lacks: a look-ahead becomes the character or the end."""
    return re.sub(r"\(\?!\[([^\]]*)\]\)", lambda m: f"(?:[^{m[1]}]|$)", p).replace("'", "''")


_ARABIC = "len(list_filter(regexp_extract_all({x}, '\\p{L}'), lambda c: unicode(c) BETWEEN 1536 AND 1791 OR unicode(c) BETWEEN 1872 AND 1919 OR unicode(c) BETWEEN 2208 AND 2303 OR unicode(c) BETWEEN 64336 AND 65023 OR unicode(c) BETWEEN 65136 AND 65279))"
_HARAKAT = "len(regexp_extract_all({x}, '[\\x{064B}-\\x{0652}\\x{0670}\\x{06E1}]'))"
_QUOTED = f"({_ARABIC} >= 6 AND {_HARAKAT} >= 0.25 * {_ARABIC})".replace("{x}", "text")
_DIGITS = "len(regexp_extract_all({x}, '[\\x{0660}-\\x{0669}\\x{06F0}-\\x{06F9}]'))"
_ALL_LABELS = [x for v in SECTIONS.values() for x in v]
_TITLED = "(style = 'Title')"
_BARE = f"regexp_replace({western('trim(text)')}, '^\\s*[0-9]+(?:\\.[0-9]+)*[.)]?\\s*', '')"
_ENDS = f"len(regexp_extract_all({_BARE}, '[.!?؟۔](\\s|$)'))"
_SUB = "rtrim(regexp_replace(norm, '[:：]+$', ''))"
_MISSTYLED = f"(heading_level IS NOT NULL AND NOT in_table AND NOT {label(_BARE, _ALL_LABELS)} AND (length({_BARE}) > 90 OR {_ENDS} >= 2))"
_NEVER = f"(in_table OR in_toc OR {_TITLED} OR regexp_matches(west, '{pattern(P.question_pattern(P.PROFILE, True))}') OR regexp_matches(west, '{pattern(P.own_number_pattern(P.PROFILE))}') OR quoted OR {within(_SUB, V['slo_sublabels'])} OR {begins('norm', V['answer_line_labels'])} OR regexp_matches(trim(text), '\\S\\s*/\\s*\\S[^/]*\\s/\\s*\\S') OR regexp_matches(text, '^\\s*(?:[•▪●◦]|[\\-–—*]\\s)'))"
_HEAD = f"(NOT {_NEVER} AND CASE WHEN heading_level IS NOT NULL THEN NOT {_MISSTYLED} ELSE length(trim(text)) <= 90 AND list_kind IS NULL AND ({label('text', _ALL_LABELS)} OR (all_bold AND NOT regexp_matches(trim(text), '[.!?؟۔:：]$'))) END)"
_CAPTION = lambda kind: pattern(P.caption_pattern(P.PROFILE, kind))

BASE = f"""{{PARAS}}, p0 AS (SELECT doc_id, idx, line, {K} AS k FROM paras), p1 AS (SELECT doc_id, idx, k, {', '.join(_spread(COLUMNS))} FROM p0),
 p2 AS (SELECT *, lower({fold('text')}) AS norm, {_QUOTED} AS quoted FROM p1), p AS (SELECT *, {western('norm')} AS west FROM p2), o AS (SELECT doc_id, {', '.join(_spread(DOC))} FROM documents), every AS (SELECT DISTINCT rel FROM p)"""
HEADS = f"""{BASE}, h0 AS (SELECT *, {_HEAD} AS head0, idx IS NOT DISTINCT FROM min(idx) FILTER (NOT in_table) OVER (PARTITION BY rel) AS first FROM p), h AS (SELECT *, head0 AND NOT (first AND heading_level IS NULL) AS head FROM h0)"""
ROLES = f"""{HEADS}, r AS (SELECT *, CASE WHEN quoted THEN NULL WHEN {_TITLED} OR (first AND heading_level IS NULL) THEN 'title' WHEN heading_level = 1 OR (head AND heading_level IS NULL) THEN 'section_heading' WHEN heading_level IS NOT NULL THEN NULL WHEN in_toc THEN 'toc'
 WHEN style = 'Caption' OR regexp_matches(west, '{_CAPTION('table')}') OR regexp_matches(west, '{_CAPTION('figure')}') THEN 'caption' WHEN in_table AND row_idx = 0 THEN 'table_header' WHEN in_table THEN 'table_body' ELSE 'body' END AS role FROM h)"""
SECT = f"""{HEADS}, s AS ({' UNION ALL '.join(f"SELECT rel, '{k}' AS section, min(idx) AS start FROM p WHERE NOT in_table AND NOT in_toc AND {label('text', v)} GROUP BY rel" for k, v in SECTIONS.items())}),
 spans AS (SELECT *, lead(start) OVER (PARTITION BY rel ORDER BY start, section) AS stop FROM s)"""
SLIDES = f"sl AS (SELECT conv_id, turn, text, {', '.join(_spread(SLIDE))} FROM conversations), deck AS (SELECT DISTINCT rel FROM sl), sn AS (SELECT *, lower({fold('title')}) AS name, lower({fold('body')}) AS said FROM sl)"
_MINUTES = lambda x, k: f"try_cast(nullif(regexp_extract(lower({western(fold(x))}), '([0-9]+)\\s*(?:[-–—]\\s*([0-9]+))?\\s*(?:min|منٹ)', {k}), '') AS INT)"


def _out(code: str, source: str, verdict: str, message: str, partial: str = "false", doc: str = "rel") -> str:
    return f"SELECT '{code}' AS code, {doc} AS doc, {verdict} AS status, '{message.replace(chr(39), chr(39) * 2)}' AS message, coalesce({partial}, false) AS partial FROM {source}"


def _register(code: str, sql: str, f=None) -> None:
    """A query named after the code; by default the rule of that code over the stand-in tables."""

    def run(spark, d):
        return (f or (lambda t: rules.RULES[code][1](t)))(tables(spark, d))

    run.__name__ = "rule_" + code.lower()
    query(sql)(run)


def _named(code: str, verdict: str, message: str, partial: str = "false") -> None:
    def run(spark, d):
        return rules.RULES[code][1]({"docs": table(spark, d, "documents").selectExpr(f"{NAME} AS rel")})

    run.__name__ = "rule_" + code.lower()
    query(f"WITH n AS (SELECT {NAME} AS rel FROM documents) " + _out(code, "n", verdict, message, partial))(run)


_SHAPE = "regexp_matches(regexp_replace(rel, '\\.[^.]+$', ''), '^[^-]+-[^-]+-.+-v[0-9]+(\\.[0-9]+)*$')"
_named("WE1", f"CASE WHEN {_SHAPE} THEN 'pass' ELSE 'fail' END", "name: type, id, topic, version", _SHAPE)
_named("WE2", "CASE WHEN regexp_matches(lower(rel), 'draft|final') THEN 'fail' ELSE 'pass' END", "no draft or final in the name")
_named("WE3", "CASE WHEN regexp_matches(lower(rel), '-v[0-9]') THEN 'needs_review' ELSE 'fail' END", "version in the name")
_register("WE4", f"WITH {BASE}, l AS (SELECT rel, sum(CASE WHEN line_kind = 'points' OR abs(line_value - 1.15) > 0.01 THEN length(text) ELSE 0 END) / sum(length(text)) AS off FROM p GROUP BY rel) " + _out("WE4", "l JOIN o USING (rel)", "CASE WHEN NOT (abs(width_in - 8.27) <= 0.06 AND abs(margin - 1) <= 0.02) OR off > 0.02 THEN 'fail' ELSE 'pass' END", "A4 upright, margins of one inch, spacing 1.15"))
_register("WE5", f"WITH {SLIDES}, g AS (SELECT rel, max(abs(width::DOUBLE / height - 16.0 / 9)) AS shape, sum(CASE WHEN abs(coalesce(spacing, 1.0) - 1.5) > 0.01 THEN length(body) ELSE 0 END) / sum(length(body)) AS off, bool_or(spacing IS NULL) AS inh FROM sl GROUP BY rel) " + _out("WE5", "g", "CASE WHEN shape > 0.02 OR off > 0.02 THEN 'fail' ELSE 'pass' END", "slides of 16:9, spacing 1.5", "shape <= 0.02 AND off <= 0.02 AND inh"))
_FACE = "coalesce(regexp_replace(lower(font), '[\\s_-]', '', 'g'), '?')"
_register("WE6", f"WITH {BASE}, f AS (SELECT rel, count(DISTINCT {_FACE}) AS n, bool_and({_FACE} IN ('poppins', 'montserrat')) AS ok FROM p WHERE script = 'latin' GROUP BY rel) " + _out("WE6", "every LEFT JOIN f USING (rel)", "CASE WHEN n IS NULL THEN 'na' WHEN n = 1 AND ok THEN 'pass' ELSE 'fail' END", "one allowed Latin family"))
_register("WE7", f"WITH {BASE}, f AS (SELECT rel, bool_and({_FACE} IN ('notonastaliqurdu', 'notonastaliq')) AS ok FROM p WHERE script = 'arabic' AND NOT quoted GROUP BY rel) " + _out("WE7", "every LEFT JOIN f USING (rel)", "CASE WHEN ok IS NULL THEN 'na' WHEN ok THEN 'pass' ELSE 'fail' END", "allowed Urdu families"))
_WANT = "CASE role WHEN 'title' THEN 20 WHEN 'section_heading' THEN 14 WHEN 'body' THEN 12 WHEN 'table_body' THEN 12 WHEN 'table_header' THEN 14 WHEN 'caption' THEN 11 END"
_register("WE8", f"WITH {ROLES}, b AS (SELECT rel, role, length(text) AS n, (role <> 'toc' AND (size IS NULL OR abs(size - {_WANT}) > 0.01)) OR (role IN ('title', 'section_heading', 'table_header') AND NOT bold) OR (role = 'caption' AND NOT italic) OR (role = 'toc' AND coalesce(lower(font), '') <> 'arial') AS bad FROM r WHERE role IS NOT NULL), g AS (SELECT rel, max(off) AS off FROM (SELECT rel, role, sum(CASE WHEN bad THEN n ELSE 0 END) / sum(n) AS off FROM b GROUP BY rel, role) GROUP BY rel) " + _out("WE8", "every LEFT JOIN g USING (rel)", "CASE WHEN off IS NULL THEN 'na' WHEN off > 0.02 THEN 'fail' ELSE 'pass' END", "sizes and weights by role"))
_EAST, _OUT = _DIGITS.replace("{x}", "text"), _DIGITS.replace("{x}", "regexp_replace(text, '[\\x{FD3E}\\x{FD3F}][^\\x{FD3E}\\x{FD3F}]{0,12}[\\x{FD3E}\\x{FD3F}]', ' ', 'g')")
_register("WE10", f"WITH {BASE}, g AS (SELECT rel, sum(CASE WHEN quoted THEN 0 ELSE {_OUT} END) AS n, sum(CASE WHEN quoted THEN {_EAST} ELSE {_EAST} - {_OUT} END) AS q FROM p GROUP BY rel) " + _out("WE10", "g", "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END", "Western digits", "n = 0 AND q > 0"))
_register("WE11", f"WITH {BASE}, g AS (SELECT rel, count(*) FILTER (bidi <> (script = 'arabic')) AS n FROM p GROUP BY rel) " + _out("WE11", "g", "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END", "direction follows the script", "n = 0"))
_GREY = lambda c: f"({c} IS NULL OR lower({c}) IN ('auto', 'ffffff') OR {c} = '333333')"
_register("WE23", f"WITH {BASE}, g AS (SELECT p.rel, count(*) FILTER (NOT {_GREY('color')} OR (highlight IS NOT NULL AND doc_type NOT IN ('pop_quiz', 'data_bank')) OR NOT {_GREY('shading')}) AS n FROM p JOIN o USING (rel) GROUP BY p.rel) " + _out("WE23", "g", "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END", "neutral colours only"))
_NUMS = f"CASE WHEN coalesce(num_label, '') <> '' THEN CASE WHEN list_kind = 'decimal' THEN list_transform(regexp_extract_all(num_label, '[0-9]+'), lambda x: x::INT) END WHEN regexp_matches({western('text')}, '^\\s*[0-9]+(?:\\.[0-9]+){{0,5}}[.)]?\\s+\\S') THEN list_transform(string_split(regexp_extract({western('text')}, '^\\s*([0-9]+(?:\\.[0-9]+){{0,5}})[.)]?\\s+\\S', 1), '.'), lambda x: x::INT) END"


def _numbered(code: str) -> str:
    return f"""WITH {HEADS}, a AS (SELECT rel, idx, {_NUMS} AS p, {begins('norm', V['appendix_headings'])} AS app FROM h WHERE head), n AS (SELECT rel, count(*) AS n, count(*) FILTER (p IS NULL AND NOT app) AS bare FROM a GROUP BY rel),
 q AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY rel ORDER BY idx), []) AS q FROM a WHERE p IS NOT NULL),
 w AS (SELECT rel, count(*) FILTER (len(p) > 3 OR len(p) > len(q) + 1 OR (len(p) = len(q) + 1 AND p[len(p)] <> 1) OR (len(p) <= len(q) AND p[1:len(p) - 1] = q[1:len(p) - 1] AND p[len(p)] <> q[len(p)] + 1)) AS wrong FROM q GROUP BY rel) """ + _out(code, "every LEFT JOIN n USING (rel) LEFT JOIN w USING (rel)", "CASE WHEN n IS NULL THEN 'na' WHEN bare + coalesce(wrong, 0) > 0 THEN 'fail' ELSE 'pass' END", "decimal numbering of headings")


_register("WE12", _numbered("WE12"))
_register("LP4", _numbered("LP4"))
_register("WE13", f"WITH {HEADS}, g AS (SELECT rel, count(*) FILTER (head) AS n, count(*) FILTER (head AND heading_level IS NULL) AS bare, count(*) FILTER ({_MISSTYLED} AND NOT quoted) AS body FROM h GROUP BY rel) " + _out("WE13", "g", "CASE WHEN n + body = 0 THEN 'na' WHEN bare + body > 0 THEN 'fail' ELSE 'pass' END", "headings, and only those, in heading styles"))
_register("WE15", f"WITH {BASE}, g AS (SELECT rel, bool_or(in_toc) AS toc, sum(greatest(1, ceil(length(text) / greatest(1.0, 468.0 / (coalesce(size, 11.0) * 0.45)))) * coalesce(size, 11.0) * CASE WHEN script = 'arabic' THEN 1.8 ELSE 1.2 END) / 648.0 AS guess FROM p GROUP BY rel) " + _out("WE15", "g JOIN o USING (rel)", "CASE WHEN doc_type <> 'lesson_plan' THEN 'na' WHEN toc THEN 'pass' WHEN pages IS NULL THEN CASE WHEN guess >= 3 THEN 'fail' ELSE 'needs_review' END WHEN pages > 2 THEN 'fail' ELSE 'pass' END", "contents of long lesson plans"))
_NUMBER = lambda kind: f"try_cast(nullif(regexp_extract(west, '{_CAPTION(kind)}', 1), '') AS INT)"
_register("WE16", f"""WITH {BASE}, c AS (SELECT rel, idx, in_table, CASE WHEN NOT in_table THEN {_NUMBER('table')} END AS n FROM p), a AS (SELECT *, lag(n) OVER w AS above, in_table AND NOT coalesce(lag(in_table) OVER w, false) AS first FROM c WINDOW w AS (PARTITION BY rel ORDER BY idx)),
 t AS (SELECT *, coalesce(last_value(above IGNORE NULLS) OVER (PARTITION BY rel ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM a WHERE first), g AS (SELECT rel, count(*) FILTER (above IS NULL OR above <> seen + 1) AS bad FROM t GROUP BY rel) """ + _out("WE16", "every LEFT JOIN g USING (rel)", "CASE WHEN bad IS NULL THEN 'na' WHEN bad > 0 THEN 'fail' ELSE 'pass' END", "a numbered caption above each table"))
_register("WE17", f"""WITH {BASE}, c AS (SELECT *, {_NUMBER('figure')} AS n FROM p), f AS (SELECT i.rel, i.idx, (SELECT min(c.idx) FROM c WHERE c.rel = i.rel AND c.idx > i.idx) AS nxt FROM p i WHERE i.k % 13 = 5),
 j AS (SELECT f.rel, f.idx, c.n, c.size, c.italic, c.rel IS NOT NULL AS has FROM f LEFT JOIN c ON c.rel = f.rel AND c.idx = f.nxt), t AS (SELECT *, coalesce(last_value(n IGNORE NULLS) OVER (PARTITION BY rel ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM j),
 g AS (SELECT rel, count(*) FILTER (n IS NULL OR n <> seen + 1 OR (has AND (size IS NULL OR abs(size - 11) > 0.01 OR NOT italic))) AS bad FROM t GROUP BY rel) """ + _out("WE17", "every LEFT JOIN g USING (rel)", "CASE WHEN bad IS NULL THEN 'na' WHEN bad > 0 THEN 'fail' ELSE 'pass' END", "a numbered caption under each figure"))
_PICS = lambda m: f"WITH {BASE}, g AS (SELECT rel, count(*) AS k, {m} AS c FROM p WHERE k % 13 = 5 GROUP BY rel) "
_register("WE18", _PICS("0") + _out("WE18", "o LEFT JOIN g USING (rel)", "CASE WHEN k IS NULL THEN 'na' ELSE 'needs_review' END", "pictures without colour"))
_register("WE19", _PICS("count(*) FILTER (doc_id % 3 <> 1 AND (300 + (idx % 5) * 200) / (2 + doc_id % 3) < 150)") + _out("WE19", "o LEFT JOIN g USING (rel)", "CASE WHEN k IS NULL THEN 'na' WHEN c > 0 THEN 'fail' ELSE 'pass' END", "pictures of 150 dpi", "c = 0"))
_register("WE20", _PICS("count(*) FILTER (idx % 2 = 0)") + _out("WE20", "o LEFT JOIN g USING (rel)", "CASE WHEN k IS NULL THEN 'na' WHEN c > 0 THEN 'fail' ELSE 'pass' END", "alt text on every picture"))
_CITED = f"cited AS (SELECT rel, sum(len(regexp_extract_all(text, '{_marks(rules.CITED)}'))) AS good, sum(len(regexp_extract_all(text, '{_marks(rules.MISCITED[0])}')) + len(regexp_extract_all(text, '{_marks(rules.MISCITED[1])}'))) AS bad FROM p GROUP BY rel)"
_register("WE21", f"WITH {BASE}, {_CITED} " + _out("WE21", "cited", "CASE WHEN bad > 0 THEN 'fail' WHEN good > 0 THEN 'pass' ELSE 'na' END", "citations as author and year"))
_register("WE22", f"""WITH {BASE}, {_CITED}, e AS (SELECT *, min(idx) FILTER (NOT in_table AND length(trim(text)) <= 40 AND {within("trim(regexp_replace(norm, '^[ :]+|[ :]+$', '', 'g'))", V['reference_list_labels'])}) OVER (PARTITION BY rel) AS head FROM p),
 x AS (SELECT *, coalesce(norm >= lag(norm) OVER (PARTITION BY rel ORDER BY idx), true) AS up FROM e WHERE NOT in_table AND idx > head), g AS (SELECT rel, bool_and(up) AND bool_and(hanging > 0) AS ok FROM x GROUP BY rel), l AS (SELECT DISTINCT rel, true AS listed FROM e WHERE head IS NOT NULL) """ + _out("WE22", "cited LEFT JOIN l USING (rel) LEFT JOIN g USING (rel)", "CASE WHEN listed IS NULL THEN CASE WHEN good + bad > 0 THEN 'fail' ELSE 'na' END WHEN coalesce(ok, false) THEN 'pass' ELSE 'fail' END", "alphabetical references with hanging indent"))
_FOOT = "(regexp_matches(footer, '[0-9]') OR coalesce(field = 'PAGE', false)) AND regexp_matches(footer, '(?i)v\\s?[0-9]+') AND (coalesce(field = 'DATE', false) OR regexp_matches(footer, '[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}\\s+[A-Za-z]{3,9}\\s+[0-9]{4}')) AND length(trim(regexp_replace(footer, '(?i)v\\s?[0-9]+(?:\\.[0-9]+)*|[0-9][0-9\\-/.]*', '', 'g'))) >= 3"
_register("WE25", f"WITH o AS (SELECT {', '.join(_spread(DOC))} FROM documents) " + _out("WE25", "o", f"CASE WHEN {_FOOT} THEN 'pass' ELSE 'fail' END", "footer with page, version, date and name", _FOOT))
_register("WE25S", f"WITH {SLIDES}, g AS (SELECT rel, any_value(conv_id) AS c FROM sl GROUP BY rel) " + _out("WE25S", "g", "CASE WHEN c % 6 = 0 THEN 'pass' ELSE 'fail' END", "footer with page, version, date and name", "c % 6 = 0"), lambda t: rules.slide_footers(t, "WE25S"))
_IN_ORDER = f"WITH {SECT}, g AS (SELECT rel, count(*) AS n, " + ", ".join(f"max(start) FILTER (section = '{k}') AS s{i}" for i, k in enumerate(SECTIONS)) + " FROM s GROUP BY rel) "
for _code in ("LP3", "WE14"):
    _register(_code, _IN_ORDER + _out(_code, "every LEFT JOIN g USING (rel)", "CASE WHEN n = 5 AND s0 <= s1 AND s1 <= s2 AND s2 <= s3 AND s3 <= s4 THEN 'pass' ELSE 'fail' END", "all sections, in order"))
ITEMS = f"""{SECT}, op AS (SELECT rel, idx AS start FROM h WHERE NOT in_table AND NOT in_toc AND {label('text', SECTIONS['slos'])}), en AS (SELECT rel, idx FROM h WHERE NOT in_table AND ({label('text', _ALL_LABELS)} OR (head AND NOT {within(_SUB, V['slo_sublabels'])}))),
 bl AS (SELECT rel, start, (SELECT min(en.idx) FROM en WHERE en.rel = op.rel AND en.idx > op.start) AS stop FROM op),
 i0 AS (SELECT p.*, bl.start, {begins('left(norm, 40)', V['slo_lead_ins'])} AS lead, ({' OR '.join(f"starts_with(left(norm, 40), '{x.lower()}') OR (contains(left(norm, 40), '{x.lower()}') AND contains(left(trim(text), 45), ':'))" for x in V['slo_block_end_labels'])}) AS halt
 FROM p JOIN bl ON p.rel = bl.rel AND p.idx > bl.start AND (bl.stop IS NULL OR p.idx < bl.stop) WHERE NOT in_table AND NOT regexp_matches(trim(text), '[:：]$') AND NOT {within(_SUB, V['slo_sublabels'])}),
 i1 AS (SELECT *, max(CASE WHEN halt AND NOT lead THEN 1 ELSE 0 END) OVER (PARTITION BY rel, start ORDER BY idx ROWS UNBOUNDED PRECEDING) AS ended FROM i0), i2 AS (SELECT *, min(CASE WHEN NOT lead THEN start * 1000000 + idx END) OVER (PARTITION BY rel) AS f FROM i1 WHERE ended = 0), items AS (SELECT * FROM i2 WHERE NOT lead OR start * 1000000 + idx > f)"""
_IS_BULLET = "(coalesce(list_kind = 'bullet', false) OR regexp_matches(text, '^\\s*(?:[•▪●◦]|[\\-–—*]\\s)'))"
_register("LP5", f"WITH {ITEMS}, g AS (SELECT rel, bool_and(NOT (coalesce(list_kind = 'decimal', false) OR regexp_matches(west, '^\\s*[0-9]+[.)]\\s')) AND {_IS_BULLET}) AS good FROM items GROUP BY rel) " + _out("LP5", "every LEFT JOIN g USING (rel)", "CASE WHEN good IS NULL THEN 'needs_review' WHEN good THEN 'pass' ELSE 'fail' END", "outcomes as bullets"))
_INSIDE = lambda name: f"x AS (SELECT p.* FROM p JOIN spans ON p.rel = spans.rel AND section = '{name}' AND p.idx > start AND (stop IS NULL OR p.idx < stop))"
_register("LPG1", f"WITH {SECT}, {_INSIDE('warm_up')}, g AS (SELECT rel, count(*) FILTER (regexp_matches(text, '[?؟]') OR regexp_matches(west, '^\\s*[•\\-–—*]?\\s*(?:{'|'.join(P.lower(V['question_prefixes']))})\\s*[0-9]')) AS n FROM x GROUP BY rel) " + _out("LPG1", "every LEFT JOIN g USING (rel)", "CASE WHEN coalesce(n, 0) = 0 THEN 'needs_review' WHEN n > 3 THEN 'fail' ELSE 'pass' END", "one to three warm-up questions"))
_register("LPG2", f"WITH {SECT}, {_INSIDE('key_takeaways')}, g AS (SELECT rel, count(*) FILTER ({_IS_BULLET}) AS b, count(*) FILTER (coalesce(list_kind = 'decimal', false) OR regexp_matches({western('norm')}, '^\\s*\\(?[0-9]+[.)]\\s')) AS n FROM x WHERE NOT in_table GROUP BY rel), k AS (SELECT rel, true AS has FROM s WHERE section = 'key_takeaways') " + _out("LPG2", "every LEFT JOIN k USING (rel) LEFT JOIN g USING (rel)", "CASE WHEN has IS NULL THEN 'needs_review' WHEN coalesce(n, 0) > 0 OR coalesce(b, 0) = 0 THEN 'fail' ELSE 'pass' END", "takeaways as bullets"))
_register("LPG3", f"WITH {BASE}, t AS (SELECT rel, string_agg(norm, ' ') AS h FROM p WHERE in_table AND row_idx = 0 GROUP BY rel), g AS (SELECT rel, bool_or({holds('norm', V['coverage_titles'])}) AS title FROM p GROUP BY rel), n AS (SELECT rel, title, coalesce({' + '.join(f'contains(h, {chr(39)}{x.lower()}{chr(39)})::INT' for x in V['coverage_headers'])}, 0) >= 2 AS found FROM g LEFT JOIN t USING (rel)) " + _out("LPG3", "n", "CASE WHEN found THEN 'pass' WHEN title THEN 'needs_review' ELSE 'fail' END", "a coverage table", "found"))
_register("LPG4", f"WITH {BASE}, g AS (SELECT rel, bool_or(length(text) < 60 AND {begins('norm', V['glossary_labels'])}) AS g FROM p GROUP BY rel) " + _out("LPG4", "g", "CASE WHEN g THEN 'pass' ELSE 'needs_review' END", "a glossary"))
_register("WEG1", f"WITH {BASE}, g AS (SELECT rel, count(*) FILTER (space_after IS NULL OR abs(space_after - 8) > 0.5) / count(*) AS off FROM p WHERE NOT in_table GROUP BY rel) " + _out("WEG1", "every LEFT JOIN g USING (rel)", "CASE WHEN off IS NULL THEN 'na' WHEN off > 0.02 THEN 'fail' ELSE 'pass' END", "8 points after each paragraph"))
_register("WEG2", f"WITH {HEADS}, g AS (SELECT rel, count(*) FILTER (NOT in_table AND NOT head AND list_kind = 'decimal') AS n FROM h GROUP BY rel) " + _out("WEG2", "g", "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END", "bullets, not numbers, inside sections"))
_register("ASG1", f"WITH {BASE}, g AS (SELECT rel, count(*) FILTER ({holds('norm', V['all_or_none'])}) AS n FROM p GROUP BY rel) " + _out("ASG1", "g", "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END", "no 'all of the above'"))
_register("FGG1", f"WITH {SLIDES}, g AS (SELECT rel, count(*) FILTER (trim(coalesce(notes, '')) = '') AS n FROM sl GROUP BY rel) " + _out("FGG1", "g", "CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END", "speaker notes on every slide"))
_register("FGG2", f"""WITH {SLIDES}, m AS (SELECT rel, slide, {_MINUTES('notes', 1)} AS lo, coalesce({_MINUTES('notes', 2)}, {_MINUTES('notes', 1)}) AS hi, CASE WHEN slide <= 3 AND {holds('said', V['duration_labels'])} THEN coalesce({_MINUTES('said', 2)}, {_MINUTES('said', 1)}) END AS stated FROM sn),
 g AS (SELECT rel, count(*) FILTER (lo IS NULL) AS none, sum(lo) AS lo, sum(hi) AS hi, arg_min(stated, slide) FILTER (stated IS NOT NULL) AS total FROM m GROUP BY rel) """ + _out("FGG2", "g", "CASE WHEN none > 0 OR coalesce(total > 0 AND NOT (lo * 0.9 <= total AND total <= hi * 1.1), false) THEN 'fail' ELSE 'pass' END", "every slide timed, the sum near the plan"))
_register("FGG3", f"WITH {SLIDES}, f AS (SELECT *, min(slide) OVER (PARTITION BY rel) AS first FROM sn), g AS (SELECT rel, bool_or({_MINUTES(chr(39) + chr(39) + ' || said || ' + chr(39) + ' ' + chr(39) + ' || notes', 1)} IS NOT NULL) AS c FROM f WHERE slide = first GROUP BY rel) " + _out("FGG3", "g", "CASE WHEN c THEN 'pass' ELSE 'fail' END", "the cover states the duration", "c"))
_NOTE_LABELS = [*V["facilitator_note_labels"], "سہولت کار کے لیے نوٹ", "تدریسی ہدایت"]
_GROUPS = " + ".join(f"({holds('n', words)})::INT" for words in V["note_items"].values())
_register("FG4", f"WITH {SLIDES}, c AS (SELECT rel, trim(lower({fold('notes')} || ' ' || CASE WHEN {holds('left(said, 80)', _NOTE_LABELS)} THEN said ELSE '' END)) AS n FROM sn WHERE {holds('name', SECTIONS['concept_building'])}), g AS (SELECT rel, count(*) FILTER (n = '') AS bare, count(*) FILTER ({_GROUPS} < 5) AS gaps FROM c GROUP BY rel) " + _out("FG4", "deck LEFT JOIN g USING (rel)", "CASE WHEN bare IS NULL THEN 'needs_review' WHEN bare > 0 THEN 'fail' WHEN gaps > 0 THEN 'needs_review' ELSE 'pass' END", "notes on concept slides", "bare = 0 AND gaps = 0"))
_ROLE = "CASE " + " ".join(f"WHEN {label('title', v + V['fg_section_labels'].get(k, []))} THEN '{k}'" for k, v in SECTIONS.items()) + " END"
_register("FG7", f"WITH {SLIDES}, c AS (SELECT rel, slide, {_ROLE} AS role FROM sn), g AS (SELECT rel, " + ", ".join(f"min(slide) FILTER (role = '{k}') AS s{i}" for i, k in enumerate(SECTIONS)) + " FROM c GROUP BY rel), z AS (SELECT rel, coalesce(s0 <= s2 AND s2 <= s3 AND s3 <= s4 AND s1 <= s3, false) AS good FROM g) " + _out("FG7", "z", "CASE WHEN good THEN 'pass' ELSE 'fail' END", "slides follow the plan's sections", "good"))
_register("FG2", f"WITH {SLIDES}, f AS (SELECT *, min(slide) OVER (PARTITION BY rel) AS first FROM sn), g AS (SELECT rel, count(*) FILTER (NOT (trim(notes) <> '' OR {holds('left(said, 60)', V['facilitator_note_labels'])})) AS bare FROM f WHERE slide > first GROUP BY rel) " + _out("FG2", "deck LEFT JOIN g USING (rel)", "CASE WHEN bare IS NULL THEN 'na' WHEN bare > 0 THEN 'needs_review' ELSE 'pass' END", "a facilitator's part, nothing copied", "bare = 0"))
_B = f"b AS (SELECT conv_id, 'c' || conv_id AS rel, turn, {', '.join(f'{e} AS b{i}' for i, (_, e) in enumerate(BOARD))} FROM conversations), d AS (SELECT conv_id, any_value(rel) AS rel, conv_id % 5 <> 0 AS has1, conv_id % 7 <> 0 AS has2, conv_id % 3 <> 0 AS has3, conv_id % 2 = 0 AS has4 FROM b GROUP BY conv_id), good AS (SELECT *, 1 + has1::INT + has2::INT + has3::INT + has4::INT AS n FROM d)"
_register("SB1", f"WITH {_B} " + _out("SB1", "good", "CASE WHEN n = 5 THEN 'pass' ELSE 'fail' END", "scene, duration, text, narration and visual columns"))
_register("SB2", f"WITH {_B}, m AS (SELECT rel, CASE any_value(b.conv_id) % 4 WHEN 0 THEN max(turn * 60 + 30) WHEN 1 THEN sum(turn * 20 + 5) WHEN 2 THEN count(*) * 60 END AS m FROM b JOIN good USING (rel) WHERE n >= 3 AND has1 GROUP BY rel) " + _out("SB2", "m", "CASE WHEN m IS NULL THEN 'needs_review' WHEN m > 120 THEN 'fail' ELSE 'pass' END", "two minutes at most"))
_COUNT = lambda x: f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
_register("SB3", f"WITH {_B}, m AS (SELECT rel, coalesce(sum({_COUNT('b3')}), 0) AS m FROM b JOIN good USING (rel) WHERE n >= 3 AND has3 GROUP BY rel) " + _out("SB3", "m", "CASE WHEN m > 300 THEN 'fail' ELSE 'pass' END", "300 words of narration at most"))
_register("SB5", f"WITH {_B}, m AS (SELECT rel, count(*) FILTER ({_COUNT('b2')} > 12) AS m FROM b JOIN good USING (rel) WHERE n >= 3 AND has2 GROUP BY rel) " + _out("SB5", "m", "CASE WHEN m > 0 THEN 'fail' ELSE 'pass' END", "short labels on screen"))
_register("SB4", f"WITH {BASE}, t AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY idx) AS r FROM p), g AS (SELECT rel, bool_or({holds('norm', V['storyboard_origin'])} OR regexp_matches(norm, '(^|[^a-z])new([^a-z]|$)')) AS h FROM t WHERE r <= 12 GROUP BY rel) " + _out("SB4", "g", "CASE WHEN h THEN 'pass' ELSE 'fail' END", "new, or edited from a source"))


# questions


QUESTIONS = f"""{BASE}, q0 AS (SELECT *, regexp_matches(norm, '{_marks(assessments.OPTION)}') AS option, coalesce(nullif(regexp_extract(west, '{pattern(P.question_pattern(P.PROFILE, True))}', 1), ''), CASE WHEN in_table THEN nullif(regexp_extract(west, '{pattern(P.cell_question_pattern(P.PROFILE))}', 1), '') END) AS lab,
 CASE WHEN NOT in_table THEN coalesce(nullif(regexp_extract(west, '{pattern(P.question_pattern(P.PROFILE))}', 1), ''), nullif(regexp_extract(west, '{assessments.BRACKETED}', 1), ''), nullif(regexp_extract(west, '{pattern(assessments.SHORT)}', 1), '')) END AS plain FROM p),
 q1 AS (SELECT *, (NOT in_table AND regexp_matches(west, '{P.lesson_pattern(P.PROFILE)}') AND NOT option) OR (NOT in_table AND coalesce(heading_level = 1, false)) AS stop0 FROM q0),
 q2 AS (SELECT *, CASE WHEN NOT stop0 AND NOT option THEN try_cast(coalesce(lab, plain) AS INT) END AS typed FROM q1), q3 AS (SELECT *, typed IS NOT NULL AND lab IS NOT NULL AS labelled FROM q2),
 q4 AS (SELECT *, min(idx) FILTER (typed IS NOT NULL) OVER w AS first_q, min(idx) FILTER (labelled) OVER w AS first_label FROM q3 WINDOW w AS (PARTITION BY rel)),
 q5 AS (SELECT *, min(idx) FILTER (NOT in_table AND length(west) <= 90 AND {begins('norm', V['question_region_end_labels'])} AND idx > first_q) OVER (PARTITION BY rel) AS stop_at FROM q4),
 q6 AS (SELECT *, CASE WHEN first_label IS NULL OR labelled OR idx > first_label THEN typed END AS kept FROM q5 WHERE stop_at IS NULL OR idx < stop_at), q7 AS (SELECT *, max((kept IS NOT NULL)::INT) OVER (PARTITION BY rel) AS numbered FROM q6),
 q8 AS (SELECT *, CASE WHEN numbered = 1 THEN kept WHEN NOT in_table AND list_kind = 'decimal' THEN try_cast(nullif(regexp_extract(num_label, '^\\s*([0-9]+)', 1), '') AS INT) END AS num FROM q7), q9 AS (SELECT *, sum((num IS NOT NULL OR stop0)::INT) OVER (PARTITION BY rel ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM q8),
 qa AS (SELECT *, min(idx) OVER (PARTITION BY rel, island) AS start FROM q9 WHERE island > 0), qb AS (SELECT rel, start, max(num) FILTER (idx = start) AS num, string_agg(text, chr(10) ORDER BY idx) AS block, trim(arg_min(text, idx)) AS head,
 count(*) FILTER (idx > start AND NOT in_table AND regexp_matches(trim(text), '{_marks(assessments.OPTION)}')) AS listed, coalesce(bool_or(idx > start AND NOT in_table AND regexp_matches(trim(text), '{_marks(assessments.OPTION)}') AND (highlight IS NOT NULL OR shading = 'FFFF66')), false) AS lit, bool_or(highlight IS NOT NULL OR coalesce(shading = 'FFFF66', false)) AS any_lit FROM qa GROUP BY rel, start),
 qc AS (SELECT *, CASE WHEN listed > 0 THEN 0 ELSE len(regexp_extract_all(block, '{_marks(assessments.INLINE_OPTION)}')) END AS inline, lower({fold('block')}) AS low FROM qb WHERE num IS NOT NULL),
 qs AS (SELECT *, CASE WHEN listed > 0 THEN listed ELSE inline END AS options, CASE WHEN listed >= 3 OR inline >= 3 THEN 'mcq' WHEN regexp_matches(low, 'درست\\s*(?:یا|/)\\s*غلط|true\\s*/?\\s*(?:or)?\\s*false') THEN 'true_false' WHEN contains(block, '____') OR contains(low, 'خالی جگہ') OR contains(low, 'fill in') THEN 'fill_blank'
 WHEN contains(low, 'جوڑ') OR contains(low, 'match') THEN 'matching' ELSE 'open' END AS kind, lit OR (inline >= 3 AND any_lit) AS highlighted FROM qc),
 lv AS (SELECT *, CASE WHEN {holds(f"lower({fold('head')})", V['higher_order_words'])} THEN CASE WHEN {holds(f"lower({fold('head')})", V['lower_order_words'])} THEN NULL ELSE 1.0 END WHEN {holds(f"lower({fold('head')})", V['lower_order_words'])} THEN 0.0 END AS higher FROM qs),
 reg AS (SELECT rel, count(*) AS n, bool_and(k = num) AS regular, count(higher) AS known, avg(higher) AS share FROM (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY start) AS k FROM lv) GROUP BY rel)"""


@query(f"WITH {QUESTIONS} SELECT rel, num, start::INT AS start, head AS text, md5(block) AS block, options::INT AS options, kind, highlighted, regexp_matches(block, '{assessments.CHECKS}') AS checked FROM qs")
def questions_parsed(spark, d):
    return assessments.questions(paras(spark, d)).withColumn("block", F.md5("block"))


def _of(kind: str) -> str:
    return f"(SELECT e.rel FROM every e JOIN o ON e.rel = o.rel AND doc_type = '{kind}') e LEFT JOIN reg USING (rel)"


def _counted(code: str, kind: str, lo: int, hi: int, higher: float) -> str:
    verdict = f"CASE WHEN coalesce(n, 0) = 0 OR NOT regular THEN 'needs_review' WHEN NOT n BETWEEN {lo} AND {hi} OR coalesce(known >= greatest(2.0, n / 2) AND abs(share - {higher}) > 0.2, false) THEN 'fail' ELSE 'pass' END"
    return f"WITH {QUESTIONS} " + _out(code, _of(kind), verdict, f"{lo} to {hi} questions", f"{verdict} = 'pass'")


_register("CE1", _counted("CE1", "chapter_exam", 6, 8, 0.3), assessments.exam_count)
_register("WS1", _counted("WS1", "worksheet", 8, 10, 0.6), assessments.worksheet_count)
_TAG = lambda x: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in V["slo_tag_patterns"]) + ")"
for _code, _kind in (("CE4", "chapter_exam"), ("WS3", "worksheet")):
    _register(_code, f"WITH {QUESTIONS}, tg AS (SELECT rel, bool_or({_TAG('text')}) AS has_tag FROM p GROUP BY rel), br AS (SELECT rel, count(*) FILTER (NOT {_TAG('block')}) AS bare FROM qs GROUP BY rel) " + _out(_code, _of(_kind) + " LEFT JOIN tg USING (rel) LEFT JOIN br USING (rel)", "CASE WHEN NOT coalesce(has_tag, false) THEN 'fail' WHEN NOT coalesce(regular, false) THEN 'needs_review' WHEN bare > 0 THEN 'fail' ELSE 'pass' END", "every question tagged"), lambda t, c=_code, k=_kind: assessments.tagged(t, c, k))
_KEY = f"NOT in_table AND length(trim(text)) BETWEEN 1 AND 40 AND {holds('norm', V['answer_key_labels'])}"
_register("CE5", f"WITH {QUESTIONS}, ky AS (SELECT rel, bool_or({_KEY}) AS key FROM p GROUP BY rel), un AS (SELECT rel, bool_or({holds('low', [x for x in V['answer_key_labels'] + V['answer_line_labels'] if len(x) > 3])}) AS under FROM qs GROUP BY rel) " + _out("CE5", _of("chapter_exam") + " LEFT JOIN ky USING (rel) LEFT JOIN un USING (rel)", "CASE WHEN coalesce(key, false) OR coalesce(under, false) THEN 'pass' ELSE 'na' END", "an answer key", "coalesce(key, false) OR coalesce(under, false)"), assessments.answer_key)
_register("WS6", f"WITH {QUESTIONS}, ky AS (SELECT rel, max(idx) AS key FROM p WHERE {_KEY} GROUP BY rel), ls AS (SELECT rel, max(start) AS last FROM qs GROUP BY rel) " + _out("WS6", _of("worksheet") + " LEFT JOIN ky USING (rel) LEFT JOIN ls USING (rel)", "CASE WHEN coalesce(key >= coalesce(last, 0), false) THEN 'pass' ELSE 'fail' END", "the answer key at the end", "coalesce(key >= coalesce(last, 0), false)"), assessments.key_at_end)
_register("WS2", f"WITH {QUESTIONS}, mx AS (SELECT rel, string_agg(kind || ': ' || c, ', ' ORDER BY c DESC, kind) AS m FROM (SELECT rel, kind, count(*) AS c FROM qs GROUP BY rel, kind) GROUP BY rel) SELECT 'WS2' AS code, rel AS doc, 'needs_review' AS status, 'formats: ' || coalesce(m, '') AS message, false AS partial FROM {_of('worksheet')} LEFT JOIN mx USING (rel)", assessments.formats)


def _quiz(t: rules.Tables) -> DataFrame:
    lessons = t["paras"].select("rel").distinct().join(t["docs"].where("doc_type = 'pop_quiz'").select("rel"), "rel").select(F.col("rel").alias("doc"))
    return assessments.quiz(lessons, assessments.questions(t["paras"]).withColumnRenamed("rel", "doc"))


_EACH = lambda x: f"CASE WHEN n IS NULL THEN 'na' WHEN {x} THEN 'pass' ELSE 'fail' END"
_QUIZ = f"WITH {QUESTIONS}, pq AS (SELECT rel, count(*) AS n, bool_and(kind = 'mcq') AS mcq, bool_and({holds('low', V['lesson_plan_location_labels'])}) AS place, bool_and({holds('low', V['feedback_labels'])}) AS feedback, bool_and(highlighted) AS yellow FROM qs GROUP BY rel), z AS (SELECT e.rel, pq.* EXCLUDE (rel) FROM every e JOIN o ON e.rel = o.rel AND doc_type = 'pop_quiz' LEFT JOIN pq ON pq.rel = e.rel) "
_register("PQ", _QUIZ + " UNION ALL ".join([_out("PQ1", "z", "CASE WHEN n BETWEEN 2 AND 3 AND mcq THEN 'pass' ELSE 'fail' END", "2 to 3 multiple-choice questions"), _out("PQ2", "z", _EACH("place"), "the place in the plan", "n IS NOT NULL AND place"), _out("PQ3", "z", _EACH("feedback"), "feedback", "n IS NOT NULL AND feedback"), _out("PQ4", "z", _EACH("yellow"), "the answer in yellow")]), _quiz)


# banks


BANK_HEAD = ["Chapter / Lesson", "Question", "Options", "SLO", "Subject", "Question type", "Level", "Correct feedback", "Incorrect feedback"]
BANK = ["concat('Chapter ', conv_id + 1, ' / ', turn div 2 + 1)", "text", "concat('A) a B) b ', turn)", "'SLO 1'", "'Maths'", "CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN 'Open' ELSE 'MCQ' END", "CASE WHEN conv_id % 5 = 0 THEN 'Analyse' ELSE 'Remember' END", "'Well done'", "CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'Try again' END"]


def bank_cells(spark, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    head = rows.select("conv_id").distinct().select("conv_id", F.array(*map(F.lit, BANK_HEAD)).alias("texts"), F.lit(0).alias("row"), F.lit(False).alias("highlighted"))
    body = rows.selectExpr("conv_id", f"array({', '.join(BANK)}) AS texts", "cast(turn + 1 AS int) AS row", "conv_id % 2 = 0 AS highlighted")
    return head.unionByName(body).select(F.concat(F.lit("c"), F.col("conv_id")).alias("rel"), F.lit(0).alias("table_idx"), "row", "highlighted", F.posexplode("texts").alias("col", "text"))


_ITEMS = "it AS (SELECT 'c' || conv_id AS rel, conv_id, turn + 1 AS place, trim(text) AS question, (conv_id + 1)::INT AS chapter, (turn // 2 + 1)::INT AS lesson, conv_id % 2 = 0 AS highlighted, turn FROM conversations WHERE trim(text) <> '')"


@query(f"WITH {_ITEMS} SELECT rel, place::INT AS place, question, chapter, lesson, highlighted FROM it")
def bank_items(spark, d):
    return assessments.bank_items(bank_cells(spark, d)).select("rel", F.col("place").cast("int").alias("place"), F.col("fields")["question"].alias("question"), "chapter", "lesson", "highlighted")


@query(f"WITH {_ITEMS} " + _out("DBS1", "(SELECT DISTINCT rel FROM it)", "'pass'", "items in order of chapter and lesson", "true"))
def rule_dbs1(spark, d):
    return assessments.bank_order(assessments.bank_items(bank_cells(spark, d)))


_DB = f"""WITH {_ITEMS}, g AS (SELECT chapter, lesson, conv_id, count(*) AS n, bool_and(NOT (conv_id % 4 = 0 AND turn = 1)) AS mcq, highlighted FROM it GROUP BY ALL), gr AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY lesson) AS place, count(*) OVER (PARTITION BY chapter) AS have FROM g),
 hv AS (SELECT DISTINCT chapter, have FROM gr), le AS (SELECT conv_id, (conv_id + 1)::INT AS chapter, unnest(range(1, conv_id % 3 + 2)) AS place, conv_id % 3 + 1 AS want FROM (SELECT DISTINCT conv_id FROM conversations)),
 z AS (SELECT 'l' || le.conv_id || '-' || le.place AS rel, le.conv_id AS c, want, hv.have, gr.n, gr.mcq, gr.highlighted FROM le LEFT JOIN hv USING (chapter) LEFT JOIN gr USING (chapter, place)) """
_ODD = "have IS NOT NULL AND have <> want"
_N = "CASE WHEN have = want THEN n END"
_BANKED = lambda good: f"CASE WHEN {_ODD} THEN 'needs_review' WHEN {_N} IS NULL THEN 'na' WHEN {good} THEN 'pass' ELSE 'fail' END"


@query(_DB + " UNION ALL ".join([_out("DB1", "z", f"CASE WHEN {_ODD} THEN 'needs_review' WHEN coalesce({_N}, 0) BETWEEN 4 AND 6 AND mcq AND c % 5 <> 0 THEN 'pass' ELSE 'fail' END", "4 to 6 lower-order multiple-choice items"), _out("DB2", "z", _BANKED("true"), "subject, chapter, lesson and outcome tags"), _out("DB3", "z", _BANKED("c % 3 <> 0"), "feedback", f"NOT ({_ODD}) AND {_N} IS NOT NULL AND c % 3 <> 0"), _out("DB4", "z", _BANKED("highlighted"), "the answer in yellow")]))
def rule_db(spark, d):
    lessons = table(spark, d, "conversations").select("conv_id").distinct().selectExpr("conv_id", "cast(conv_id + 1 AS int) AS chapter", "explode(sequence(1, cast(conv_id % 3 + 1 AS int))) AS place")
    lessons = lessons.selectExpr("concat('l', conv_id, '-', place) AS doc", "chapter", "place")
    return assessments.bank(lessons, assessments.bank_groups(assessments.bank_items(bank_cells(spark, d))))


# coverage of outcomes


OUTCOMES = "oc AS (SELECT (n_regionkey + 1)::INT AS chapter, (n_nationkey % 3 + 1)::INT AS lesson, row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey)::INT AS index, n_name || ' is a place on the map.' AS text FROM nation)"
BLOCK = "CASE turn % 4 WHEN 0 THEN concat('SLO ', conv_id % 3 + 1, ' ', text) WHEN 1 THEN concat('L', turn % 3 + 1, ' SLO 1: ', text) WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN 'Say why france is a place on the map' ELSE 'Is PERU is a place on the map true?' END ELSE text END"
_ASKED = f"ak AS (SELECT 'c' || conv_id AS doc, turn AS q, (conv_id % 5 + 1)::INT AS chapter, CASE WHEN conv_id % 2 = 0 THEN (conv_id % 3 + 1)::INT END AS lesson, lower({BLOCK}) AS low FROM conversations)"
_TIES = f"""{OUTCOMES}, {_ASKED}, ti AS (SELECT doc, q, lesson, index FROM (SELECT doc, q, chapter, lesson, unnest(list_transform(regexp_extract_all(low, '(?:\\bslo\\b|حاصلات?\\s*تعلیم)[\\s\\-:#]*([0-9]{{1,2}})', 1), lambda x: x::INT)) AS index FROM ak WHERE lesson IS NOT NULL) SEMI JOIN oc USING (chapter, lesson, index)
 UNION SELECT doc, q, regexp_extract(m, '([0-9]+)', 1)::INT, regexp_extract(m, '[0-9]+[^0-9]+([0-9]+)', 1)::INT FROM (SELECT doc, q, unnest(regexp_extract_all(low, '\\bl(?:esson)?\\s*[0-9]{{1,2}}[\\s,\\-:]*slo[\\s\\-:#]*[0-9]{{1,2}}')) AS m FROM ak WHERE lesson IS NULL)
 UNION SELECT doc, q, oc.lesson, index FROM ak JOIN oc ON ak.chapter = oc.chapter AND (ak.lesson IS NULL OR ak.lesson = oc.lesson) AND contains(low, rtrim(lower(oc.text), '.')))"""


def outcomes(spark, d: str) -> DataFrame:
    rows = table(spark, d, "nation").selectExpr("cast(n_regionkey + 1 AS int) AS chapter", "cast(n_nationkey % 3 + 1 AS int) AS lesson", "cast(row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) AS int) AS index", "concat(n_name, ' is a place on the map.') AS text")
    return rows


def asked(spark, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("concat('c', conv_id) AS doc", "turn AS q", "cast(conv_id % 5 + 1 AS int) AS chapter", "CASE WHEN conv_id % 2 = 0 THEN cast(conv_id % 3 + 1 AS int) END AS lesson", f"{BLOCK} AS block")


@query(f"WITH {_TIES} SELECT doc, q, lesson, index FROM ti")
def outcome_tags(spark, d):
    return assessments.tags(asked(spark, d), outcomes(spark, d))


_COVER = f"{_TIES}, ht AS (SELECT ak.chapter, ti.lesson, ti.index, CASE WHEN ak.lesson IS NULL THEN 'worksheet' ELSE 'exam' END AS kind FROM ti JOIN ak USING (doc, q)), cv AS (SELECT oc.*, count(*) FILTER (kind = 'exam') AS exam, count(*) FILTER (kind = 'worksheet') AS worksheet, count(kind) AS total FROM oc LEFT JOIN ht USING (chapter, lesson, index) GROUP BY ALL)"


def _covered(spark, d: str) -> DataFrame:
    ties = assessments.tags(asked(spark, d), outcomes(spark, d))
    hits = ties.join(asked(spark, d).select("doc", "q", "chapter", F.when(F.col("lesson").isNull(), "worksheet").otherwise("exam").alias("kind")), ["doc", "q"]).select("chapter", "lesson", "index", "kind")
    return assessments.coverage(outcomes(spark, d), hits, ["exam", "worksheet"])


@query(f"WITH {_COVER} SELECT chapter, lesson, index, text, exam, worksheet, total FROM cv")
def outcome_coverage(spark, d):
    return _covered(spark, d).select("chapter", "lesson", "index", "text", "exam", "worksheet", "total")


@query(f"WITH {_COVER}, z AS (SELECT 'subject' AS rel, count(*) AS n, count(*) FILTER (total = 0) AS gaps FROM cv) " + _out("ST1", "z", "CASE WHEN n > 0 THEN 'pass' ELSE 'needs_review' END", "a coverage map") + " UNION ALL " + _out("ST2", "z", "CASE WHEN n = 0 THEN 'needs_review' WHEN gaps > 0 THEN 'fail' ELSE 'pass' END", "every outcome is asked about"))
def rule_st(spark, d):
    return assessments.coverage_findings(_covered(spark, d))


_MEASURED = "qn AS (SELECT doc, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM ti WHERE ti.doc = ak.doc AND ti.q = ak.q)) AS tagged FROM ak GROUP BY doc)"


@query(f"WITH {_TIES}, {_MEASURED}, le AS (SELECT DISTINCT doc, chapter, lesson FROM ak WHERE lesson IS NOT NULL), w AS (SELECT le.doc, count(*) AS slos, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ti WHERE ti.doc = le.doc AND ti.index = oc.index)) AS missing FROM le JOIN oc USING (chapter, lesson) GROUP BY le.doc) " + _out("PQ5", "le LEFT JOIN qn USING (doc) LEFT JOIN w USING (doc)", "CASE WHEN slos IS NULL THEN 'needs_review' WHEN n IS NULL THEN 'na' WHEN tagged = 0 THEN 'needs_review' WHEN missing > 0 THEN CASE WHEN tagged = n THEN 'fail' ELSE 'needs_review' END ELSE 'pass' END", "a question on every outcome", doc="doc"))
def rule_pq5(spark, d):
    rows = asked(spark, d).where("lesson is not null")
    return assessments.lesson_coverage(rows.select("doc", "chapter", "lesson").distinct(), outcomes(spark, d), rows, assessments.tags(rows, outcomes(spark, d)))


_GAP = lambda g: f"CASE WHEN coalesce(tagged, 0) = 0 THEN 'needs_review' WHEN {g} > 0 THEN CASE WHEN tagged = n THEN 'fail' ELSE 'needs_review' END ELSE 'pass' END"


@query(f"WITH {_TIES}, {_MEASURED}, ch AS (SELECT DISTINCT doc, chapter FROM ak WHERE lesson IS NULL), w AS (SELECT ch.doc, count(DISTINCT oc.lesson) FILTER (NOT EXISTS (SELECT 1 FROM ti WHERE ti.doc = ch.doc AND ti.lesson = oc.lesson)) AS skipped, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ti WHERE ti.doc = ch.doc AND ti.lesson = oc.lesson AND ti.index = oc.index)) AS missing FROM ch JOIN oc USING (chapter) GROUP BY ch.doc) " + _out("WS4", "ch LEFT JOIN qn USING (doc) LEFT JOIN w USING (doc)", _GAP("skipped"), "a question on every lesson", f"{_GAP('skipped')} = 'pass'", "doc") + " UNION ALL " + _out("WS5", "ch LEFT JOIN qn USING (doc) LEFT JOIN w USING (doc)", _GAP("missing"), "a question on every outcome", doc="doc"))
def rule_ws45(spark, d):
    rows = asked(spark, d).where("lesson is null")
    return assessments.chapter_coverage(rows.select("doc", "chapter").distinct(), outcomes(spark, d), rows, assessments.tags(rows, outcomes(spark, d)))


# derived rules, scalars, wording


_PARTS = ["WE4", "WE6", "WE7", "WE8", "WE23"]


def _whole(sql: str, n: int) -> str:
    """A rule's SQL as a subquery; every rule's table names stay its own."""
    return f"(SELECT * FROM ({sql}) t{n})"


def _derived_sql() -> str:
    from lektor.plans.catalogue import _ORACLES

    union = " UNION ALL ".join(_whole(_ORACLES[f"rule_{c.lower()}"], i) for i, c in enumerate(_PARTS))
    fold_ = "CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_and(status IN ('pass', 'na') AND NOT partial) THEN 'pass' ELSE 'needs_review' END"
    return f"WITH f AS (SELECT * FROM ({union})) " + " UNION ALL ".join(f"SELECT '{code}' AS code, doc, {fold_} AS status FROM f WHERE code IN ({', '.join(repr(c) for c in parts)}) GROUP BY doc" for code, parts in rules.DERIVED.items())


@query(_derived_sql())
def rule_lp10_fg8(spark, d):
    return rules.derived(rules.run({k: v for k, v in tables(spark, d).items() if k in ("paras", "docs", "pages")}, _PARTS))


@query(f"WITH {BASE} SELECT rel, idx::INT AS idx, lower(regexp_replace({fold('text')}, '[\\s.۔\\-–—؛:,;]+$', '')) AS statement, regexp_matches(text, '^\\s*(?:[•▪●◦]|[\\-–—*]\\s)') AS bullet, regexp_matches({western('text')}, '^\\s*\\(?[0-9]+[.)]\\s') AS numbered, quoted AS scripture, {_EAST}::INT AS eastern, {_OUT}::INT AS outside, try_cast(nullif(regexp_extract(west, '(?:chapter|باب)\\s*([0-9]+)', 1), '') AS INT) AS chapter, regexp_replace(trim(regexp_replace(lower({western(fold('text'))}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '^(?:[0-9]+ )+', '') AS bare, array_to_string({_NUMS.split(' WHEN regexp_matches')[0]} WHEN regexp_matches{_NUMS.split(' WHEN regexp_matches', 1)[1]}, '.') AS number FROM p")
def line_scalars(spark, d):
    text = F.col("text")
    rows = rules._paras({"paras": paras(spark, d)})
    return rows.select("rel", "idx", T.statement(text).alias("statement"), T.bullet_text(text).alias("bullet"), T.numbered_text(text).alias("numbered"), F.col("quoted").alias("scripture"), T.eastern_digits(text).alias("eastern"), T.eastern_digits(T.outside_verse_marks(text)).alias("outside"), T.chapter_number(text, V["chapter_ordinals"]).alias("chapter"), T.unnumbered(T.loose_digits(text)).alias("bare"), F.array_join(rules.numbers(), ".").alias("number"))


@query(f"WITH n AS (SELECT doc_id, {NAME} AS rel FROM documents), s AS (SELECT *, regexp_replace(rel, '\\.[^.]+$', '') AS stem FROM n) SELECT doc_id, stem, trim(translate(regexp_replace('lesson-' || doc_id || '_' || stem, '(?i)^lesson[-_ ]*[0-9]+[-_ ]*', ''), '-_', '  ')) AS title, CASE WHEN doc_id % 4 = 0 THEN 'Ch' || doc_id % 9 ELSE 'Ch' || doc_id % 9 || '-L' || doc_id % 4 || 'A' END AS short, 'Ch' || doc_id % 9 || ' L' || doc_id % 4 || ' SLO ' || doc_id % 5 AS outcome, CASE WHEN doc_id % 30 BETWEEN 1 AND 26 THEN chr((doc_id % 30 + 64)::INT) ELSE '' END AS letter, CASE doc_id % 9 WHEN 0 THEN '1.0' WHEN 2 THEN '2' WHEN 3 THEN '1' WHEN 5 THEN '3' WHEN 1 THEN NULL WHEN 4 THEN NULL ELSE '0.' || doc_id % 10 END AS version FROM s")
def name_scalars(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", f"{NAME} AS rel", "doc_id % 9 AS c", "CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS l")
    stem = T.file_stem(F.col("rel"))
    title = T.clean_title(F.concat(F.lit("lesson-"), F.col("doc_id").cast("string"), F.lit("_"), stem))
    return rows.select("doc_id", stem.alias("stem"), title.alias("title"), T.short_key(F.col("c"), F.col("l"), F.lit("A")).alias("short"), T.outcome_label(F.col("c"), F.coalesce("l", F.lit(0)), F.col("doc_id") % 5).alias("outcome"), T.part_letter((F.col("doc_id") % 30).cast("int")).alias("letter"), T.last_version(stem).alias("version"))


@query(f"SELECT doc_id, md5(lower({fold('text')})) AS digest FROM documents")
def folded_form(spark, d):
    """Digest of each whole text in the comparison form, but for compatibility composition."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower(T.fold(F.col("text")))).alias("digest"))


_TEXTS = f"""WITH {SECT}, tx AS (SELECT p.rel, section, string_agg(trim(text), chr(10) ORDER BY idx) AS t FROM p JOIN spans ON p.rel = spans.rel AND idx >= start AND (stop IS NULL OR idx < stop) GROUP BY p.rel, section)
 SELECT rel, {', '.join(f"max(t) FILTER (section = '{k}') AS {k}" for k in SECTIONS)} FROM tx GROUP BY rel"""


@query(_TEXTS)
def section_texts(spark, d):
    return judgements.section_texts({"paras": paras(spark, d)})


@query(f"""WITH {ITEMS} SELECT rel, string_agg(k || '. ' || s, chr(10) ORDER BY idx, start) AS outcomes FROM (SELECT rel, idx, start, trim(text) AS s, row_number() OVER (PARTITION BY rel ORDER BY idx, trim(text), start) AS k FROM items) GROUP BY rel""")
def lesson_outcomes(spark, d):
    return judgements.lesson_outcomes({"paras": paras(spark, d)})
