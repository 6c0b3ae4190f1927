"""Judgements on content by a model: which materials each rule needs, what is asked, and how an answer becomes a review note.

Every rule is a row of ``JUDGES``: a code, the materials by name, and the question. Materials are columns of one row a document, made by
``lesson_materials`` and ``guide_materials``; a rule whose materials are missing asks nothing. Long material is asked about part by part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektor.functions import text as T
from lektor.operators import assisted, rules

#: code: (materials, question)
JUDGES: dict[str, tuple[tuple[str, ...], str]] = {
    "LP1": (("outcomes", "concept_building"), "Is every outcome taught or practised in the concept part?"),
    "LP2": (("outcomes", "concept_building"), "Does the concept part go beyond what the outcomes cover? Fail only with a passage that does."),
    "LP6": (("warm_up",), "Is the warm-up short, and does it test what is known or preview what comes?"),
    "LP7": (("introduction", "concept_building", "key_takeaways"), "Does the opening story come back in each topic, and is it resolved at the end?"),
    "LP8": (("introduction", "book"), "Does the story agree with the passages of the book?"),
    "LP9": (("concept_building",), "Is each concept that is hard to say in words marked for a picture or a table?"),
    "FG1": (("outcomes", "overview"), "Do the slides have the outcomes said aloud in plain words?"),
    "FG3": (("warm_up_slides",), "Does the warm-up slide end with a discussion of the activity?"),
    "FG6": (("outcomes", "closing"), "Does the recap return to the outcomes, and does the end ask a question?"),
    "CE2": (("outcomes", "questions", "book"), "Do the questions follow the format and number of the book's test without its wording?"),
    "CE3": (("outcomes", "questions", "book"), "Do the harder questions go beyond the book's test within the outcomes?"),
}


def section_texts(t: rules.Tables) -> DataFrame:
    """(rel, one column a section): the text of each section, its first line included."""
    starts = rules.sections(t["paras"])
    w = Window.partitionBy("rel").orderBy("start", "section")
    spans = starts.withColumn("stop", F.lead("start").over(w))
    lines = t["paras"].where(F.trim("text") != "").select("rel", "idx", "text").join(spans, "rel").where((F.col("idx") >= F.col("start")) & (F.col("stop").isNull() | (F.col("idx") < F.col("stop"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.trim("text").alias("s")))), lambda x: x["s"]), "\n")
    return lines.groupBy("rel", "section").agg(text.alias("t")).groupBy("rel").pivot("section", list(rules.SECTIONS)).agg(F.first("t"))


def subtopics(t: rules.Tables) -> DataFrame:
    """(rel, start, heading, body): the parts of the concept section, by its headings."""
    inside = rules.section_lines(t, "concept_building").select("rel", "idx", "text").join(rules.headings(t).select("rel", "idx", F.lit(True).alias("h")), ["rel", "idx"], "left")
    w = Window.partitionBy("rel").orderBy("idx")
    rows = inside.withColumn("island", F.sum(F.coalesce(F.col("h").cast("int"), F.lit(0))).over(w)).where("island > 0")
    lines = F.array_sort(F.collect_list(F.struct("idx", F.trim("text").alias("s"))))
    return rows.groupBy("rel", "island").agg(lines.alias("l")).select("rel", F.element_at("l", 1)["idx"].alias("start"), F.element_at("l", 1)["s"].alias("heading"), F.array_join(F.transform(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), lambda x: x["s"]), "\n").alias("body"))


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def lesson_outcomes(t: rules.Tables) -> DataFrame:
    """(rel, outcomes): the statements of a plan, numbered."""
    return rules.outcomes(t).groupBy("rel").agg(numbered(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.trim("text").alias("s")))), lambda x: x["s"])).alias("outcomes"))


def lesson_materials(t: rules.Tables, book: DataFrame | None = None) -> DataFrame:
    """One row a plan: its sections, its outcomes, and passages (rel, book) where there are any."""
    rows = section_texts(t).join(lesson_outcomes(t), "rel", "left")
    return rows.join(book, "rel", "left") if book is not None else rows.withColumn("book", F.lit(None).cast("string"))


def guide_materials(t: rules.Tables, links: DataFrame | None = None, outcomes: DataFrame | None = None) -> DataFrame:
    """One row a deck: its overview, warm-up and closing slides; ``links`` (rel, plan) brings the plan's outcomes."""
    shown = F.concat(F.lit("[Slide "), F.col("slide").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("]\n"), F.array_join("texts", "\n"), F.when(F.trim("notes") != "", F.concat(F.lit("\n(notes) "), "notes")).otherwise(""))
    rows = rules._slides(t).withColumn("shown", shown).withColumn("last", F.max("slide").over(Window.partitionBy("rel")))
    kind = lambda key: T.contains_any(F.col("name"), rules.SECTIONS[key] + rules.VOCAB["fg_section_labels"].get(key, []))
    text = lambda cond: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("slide", "shown")))), lambda x: x["shown"]), "\n\n"), F.lit(""))
    got = rows.groupBy("rel").agg(F.coalesce(text(kind("slos")), text(F.col("slide") <= 3)).alias("overview"), text(kind("warm_up")).alias("warm_up_slides"), F.when(F.bool_or(kind("key_takeaways")), text(kind("key_takeaways") | (F.col("slide") > F.col("last") - 2))).alias("closing"))
    if links is None or outcomes is None:
        return got.withColumn("outcomes", F.lit(None).cast("string"))
    return got.join(links.join(outcomes.withColumnRenamed("rel", "plan"), "plan").select("rel", "outcomes"), "rel", "left")


def split_parts(text: Column, budget: int) -> Column:
    """A text as parts of at most ``budget`` characters, cut between lines; a longer line is cut hard."""
    lines = F.flatten(F.transform(F.split(text, "\n"), lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / budget).cast("int") - 1, F.lit(0))), lambda i: F.substring(x, i * budget + 1, F.lit(budget)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    step = lambda a, x: F.when(a["now"].isNull(), F.struct(a["done"].alias("done"), x.alias("now"))).when(F.length(a["now"]) + F.length(x) + 1 > budget, F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), x.alias("now"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], F.lit("\n"), x).alias("now")))
    return F.aggregate(lines, start, step, lambda a: F.concat(a["done"], F.array(a["now"])))


def prompts(materials: DataFrame, code: str, budget: int = 12000) -> DataFrame:
    """(rel, code, part, parts, prompt, material): what is asked about each document that has the rule's materials; the last long one goes part by part."""
    names, question = JUDGES[code]
    rows = materials.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(n), F.lit("")) != "" for n in names]))
    head = F.concat_ws("\n\n", *[F.concat(F.lit(f"{n}:\n"), F.left(n, F.lit(budget))) for n in names[:-1]]) if len(names) > 1 else F.lit("")
    parts = rows.select("rel", head.alias("head"), split_parts(F.col(names[-1]), budget).alias("p")).select("rel", "head", F.size("p").alias("parts"), F.posexplode("p").alias("part", "text"))
    text = F.concat_ws("\n\n", F.lit(f"Rule {code}. {question} Answer with verdict (pass, fail or unclear), reason and quote."), F.when(F.col("head") != "", F.col("head")), F.concat(F.lit(f"{names[-1]}:\n"), "text"))
    return parts.select("rel", F.lit(code).alias("code"), "part", "parts", text.alias("prompt"), F.concat_ws("\n", "head", "text").alias("material"))


def judged(asked: DataFrame, model: assisted.Model, known: DataFrame | None = None) -> DataFrame:
    """Review notes (code, doc, status, message, partial) from the answers. A verdict counts with a quote that stands in the material; a fail of any part is the document's, a pass needs all parts."""
    got = assisted.replies(asked, model, "verdict string, reason string, quote string", known).select("rel", "code", "part", "parts", "material", F.coalesce("reply.verdict", F.lit("")).alias("verdict"), F.coalesce("reply.reason", F.lit("")).alias("reason"), F.coalesce("reply.quote", F.lit("")).alias("quote"))
    checked = assisted.quoted(got, "quote", "material").withColumn("usable", F.col("verdict").isin("pass", "fail") & F.col("kept"))
    per = checked.groupBy("rel", "code").agg(F.bool_or(F.col("usable") & (F.col("verdict") == "fail")).alias("fail"), F.bool_and(F.col("usable") & (F.col("verdict") == "pass")).alias("pass"), F.min(F.when(F.col("usable"), F.struct(F.col("verdict") != "fail", "part", "reason"))).alias("r"))
    said = F.when(F.col("fail"), F.concat(F.lit("[model-assisted] Would be fail: "), F.col("r.reason"))).when(F.col("pass"), F.concat(F.lit("[model-assisted] Would be pass: "), F.col("r.reason"))).otherwise("[model-assisted] The model could not decide")
    return per.select("code", F.col("rel").alias("doc"), F.lit("needs_review").alias("status"), said.alias("message"), F.lit(False).alias("partial"))


def findings(t: rules.Tables, model: assisted.Model, codes: list[str] | None = None, book: DataFrame | None = None, links: DataFrame | None = None, decided: DataFrame | None = None) -> DataFrame:
    """All judgements for which there is material, but for (code, doc) that rules have ``decided``."""
    frames = []
    if "paras" in t:
        rows = lesson_materials(t, book)
        frames += [prompts(rows, c) for c in JUDGES if c.startswith("LP") and (codes is None or c in codes)]
    if "slides" in t:
        rows = guide_materials(t, links, lesson_outcomes(t) if "paras" in t else None)
        frames += [prompts(rows, c) for c in JUDGES if c.startswith("FG") and (codes is None or c in codes)]
    asked = reduce(DataFrame.unionByName, frames)
    if decided is not None:
        asked = asked.join(decided.select("code", F.col("doc").alias("rel")), ["code", "rel"], "left_anti")
    return judged(asked, model)


def named_in(text: Column, names: list[str], before: list[str] = (), after: list[str] = ()) -> Column:
    """Whether a text names one of the characters, as whole words and not as a person of history, who has an honorific before or after the name."""
    low = F.concat(F.lit(" "), T.loose(T.fold(text)), F.lit(" "))
    hit = F.lit(False)
    for name in names:
        tail = f"(?! (?:{'|'.join(a.lower() for a in after)}))(?= )" if after else "(?= )"
        hit = hit | low.rlike((f"(?<!{'|'.join(' ' + b.lower() for b in before)})" if before else "") + " " + name.lower() + tail)
    return hit


def story(t: rules.Tables, names: list[str]) -> DataFrame:
    """(rel, topics, told): in how many parts of the concept section the story's characters occur."""
    vocab = rules.VOCAB
    rows = subtopics(t).withColumn("hit", named_in(F.concat_ws(" ", "heading", "body"), names, vocab.get("honorifics", []), vocab.get("honorifics_after", [])))
    return rows.groupBy("rel").agg(F.count(F.lit(1)).alias("topics"), F.count_if("hit").alias("told"))
