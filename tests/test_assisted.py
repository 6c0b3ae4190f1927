"""Judgements, mappings and readings with a made-up model."""

import json

import pytest
from pyspark.sql import functions as F
from test_rules import paras
from test_sources import para

from lektor.operators import assisted, judgements, packing, rules


def replying(answers):
    """A model that answers by the first key that its prompt holds."""
    return lambda prompts: [next((json.dumps(v) if not isinstance(v, str) else v for k, v in answers.items() if k in p), "no json") for p in prompts]


PLAN = "".join(para(x) for x in ("Introduction", "Sara finds a river.", "SLOs", "• name the states of matter", "• describe how water boils", "Warm-up", "What is ice?", "Concept Building")) + para("1.1 Solids", "H1") + para("Sara holds a stone.") + para("1.2 Liquids", "H1") + para("Water flows down.") + "".join(para(x) for x in ("Key Takeaways", "• matter has states"))


def test_sections_and_subtopics(spark):
    t = {"paras": paras(spark, PLAN)}
    row = judgements.lesson_materials(t).first()
    assert row.introduction == "Introduction\nSara finds a river." and row.warm_up == "Warm-up\nWhat is ice?" and row.outcomes == "1. • name the states of matter\n2. • describe how water boils"
    assert [(r.heading, r.body) for r in judgements.subtopics(t).orderBy("start").collect()] == [("1.1 Solids", "Sara holds a stone."), ("1.2 Liquids", "Water flows down.")]
    assert tuple(judgements.story(t, ["Sara"]).select("topics", "told").first()) == (2, 1)


@pytest.mark.parametrize("text, budget", [("aaa\nbbb\nccc", 7), ("x" * 25 + "\nyy", 10), ("", 5), ("one", 100), ("a\n" * 50, 9)])
def test_parts_lose_nothing(spark, text, budget):
    got = spark.createDataFrame([(text,)], "s string").select(judgements.split_parts(F.col("s"), budget).alias("p")).first().p
    assert all(len(p) <= budget for p in got) and "".join(got).replace("\n", "") == text.replace("\n", "")


def test_judgements_need_quotes(spark):
    t = {"paras": paras(spark, PLAN)}
    model = replying({"Rule LP6": {"verdict": "pass", "reason": "short", "quote": "What is ice?"}, "Rule LP9": {"verdict": "fail", "reason": "none", "quote": "words that nobody wrote"}, "Rule LP1": '```json\n{"verdict": "fail", "reason": "no boiling", "quote": "Water flows down."}\n```'})
    got = {r.code: r.message for r in judgements.findings(t, model).collect()}
    assert got["LP6"] == "[model-assisted] Would be pass: short" and got["LP9"].endswith("could not decide") and got["LP1"] == "[model-assisted] Would be fail: no boiling"
    assert "LP8" not in got  # no book
    assert all(r.status == "needs_review" for r in judgements.findings(t, model, ["LP6"]).collect())
    decided = spark.createDataFrame([("LP6", "d0.docx")], "code string, doc string")
    assert "LP6" not in {r.code for r in judgements.findings(t, model, decided=decided).collect()}


def test_mapping_levels_feedback(spark):
    asked = spark.createDataFrame([("d", 1, "What is ice made of?"), ("d", 2, "Compare ice and steam.")], "doc string, q int, text string")
    slos = spark.createDataFrame([("d", 1, "name the states")], "doc string, index int, text string")
    model = replying({"Which outcomes": {"mapping": [{"question": 1, "slos": [1], "quote": "What is ice"}, {"question": 2, "slos": [7], "quote": "Compare ice"}]}, "level": {"levels": [{"question": 1, "level": "Remember", "quote": "What is ice"}, {"question": 2, "level": "analyse", "quote": "Compare ice"}]}, "feedback": {"items": [{"question": 1, "correct_ok": True, "incorrect_ok": False}, {"question": 9, "correct_ok": True, "incorrect_ok": True}]}})
    assert [tuple(r) for r in assisted.mapped(asked, slos, model).collect()] == [("d", 1, 1)]
    assert sorted(map(tuple, assisted.levels(asked, model).collect())) == [("d", 1, "remember", False), ("d", 2, "analyze", True)]
    items = asked.where("q = 1").withColumn("correct", F.lit("yes")).withColumn("incorrect", F.lit("no"))
    assert [(r.q, r.correct_ok, r.incorrect_ok) for r in assisted.feedback(items, model).collect()] == [(1, True, False)]
    block = "Which?\nCorrect feedback: Right, it is.\nIncorrect feedback:\nThink again"
    got = spark.createDataFrame([(block,)], "b string").select(assisted.feedback_of(F.col("b"), ["Correct feedback"], ["Incorrect feedback"]).alias("f")).first().f
    assert tuple(got) == ("Right, it is.", "Think again")


def test_proposals_are_verified(spark):
    table = paras(spark, "".join(para(x) for x in ("Question one", "What is ice?", "A) water", "And what is steam?")))
    lines = table.select("rel", "idx", F.col("text").alias("line"), F.lit(0).alias("chunk"))
    good = replying({"": {"questions": [{"para": 0, "quote": "What is ice"}, {"para": 3, "quote": "what is steam"}]}})
    assert [(r.idx, r.num) for r in assisted.proposals(table, lines, good).orderBy("idx").collect()] == [(0, 1), (3, 2)]
    bad = replying({"": {"questions": [{"para": 2, "quote": "water"}, {"para": 8, "quote": "x"}, {"para": 0, "quote": "Question one"}]}})
    assert assisted.proposals(table, lines, bad).count() == 0  # more than the cutoff fail


def test_readings_policy_and_absent_model(spark):
    lines = spark.createDataFrame([("r", 1, "Start"), ("r", 2, "Middle")], "rel string, idx int, line string")
    model = replying({"section": {"sections": {"introduction": 1, "slos": 99}}, "headings": {"headings": [2, 5]}, "slide": {"slides": {"1": "cover", "9": "close"}}})
    assert [tuple(r) for r in assisted.readings(lines, model, "sections").collect()] == [("r", "introduction", 1)]
    assert [tuple(r) for r in assisted.readings(lines, model, "headings").collect()] == [("r", "heading", 2)]
    assert [tuple(r) for r in assisted.readings(lines, model, "slides").collect()] == [("r", "cover", 1)]
    found = spark.createDataFrame([("A", "d", "fail", "m", False), ("B", "d", "pass", "m", False), ("C", "d", "na", "m", False)], "code string, doc string, status string, message string, partial boolean")
    assert {r.code: (r.status, r.message) for r in assisted.policy(found).collect()} == {"A": ("needs_review", "[model-assisted] Would be fail: m"), "B": ("needs_review", "[model-assisted] Would be pass: m"), "C": ("na", "m")}
    assert {r.code: (r.status, r.partial) for r in assisted.policy(found, "decide").collect()} == {"A": ("fail", False), "B": ("pass", True), "C": ("na", False)}
    assert assisted.http_model("http://127.0.0.1:9", "m", timeout=0.2)(["x"]) == [""] and not assisted.available("http://127.0.0.1:9", "m", 0.2)


def test_plan_rules_on_a_plan(spark):
    t = {"paras": paras(spark, PLAN, para("nothing here")), "docs": spark.createDataFrame([("d0.docx", "lesson_plan", None), ("d1.docx", "lesson_plan", 3)], "rel string, doc_type string, pages int")}
    got = {(r.code, r.doc[:2]): r.status for r in rules.run(t).collect()}
    assert [got[c, "d0"] for c in ("LP3", "LP5", "LPG1", "LPG2", "WE14")] == ["pass"] * 5 and got["LP3", "d1"] == "fail" and got["LP5", "d1"] == "needs_review" and got["WE15", "d1"] == "fail"
    assert packing is not None


def test_copies_and_pasted_outcomes(spark):
    long = "The water in the river flows down to the sea and takes sand and stones along with it."
    slo = "Students describe how water turns to steam when it boils in a pan"
    t = {"paras": paras(spark, "".join(para(x) for x in ("SLOs", "• " + slo, "Warm-up", long)))}
    from lektor.sources import ooxml

    slide = lambda k, title, text, notes: ("g", k, title, [text], notes, 1, 1, [], [], [])
    t["slides"] = spark.createDataFrame([slide(1, "Cover", "x", "n"), slide(2, "Session Overview", slo, "n"), slide(3, "Warm-up", long.replace("river", "River"), "n")], ooxml.SLIDES)
    links = spark.createDataFrame([("g", "d0.docx")], "rel string, plan string")
    assert [tuple(r) for r in rules.facilitator_part(t, links).select("doc", "status").collect()] == [("g", "fail")]
    assert [tuple(r) for r in rules.pasted_outcomes(t, links).select("code", "doc", "status").collect()] == [("FG1", "g", "fail")]
    assert rules.facilitator_part({"slides": t["slides"]}).first().status == "pass"
