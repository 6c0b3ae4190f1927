"""Rules, packing, notes, quotes and streams on small tables."""

import pytest
from pyspark.sql import functions as F
from test_sources import docx, para

from lektor.operators import assessments, assisted, packing, rules, sinks
from lektor.sources import ooxml
from lektor.streaming import windows


def paras(spark, *bodies):
    rows = [(f"d{k}.docx", *r) for k, body in enumerate(bodies) for r in ooxml.docx_paragraphs(docx(body))]
    return spark.createDataFrame(rows, ooxml.PARAS)


def verdicts(frame):
    return {r.doc: r.status for r in frame.collect()}


def numbered(*labels):
    return "".join(para(f"{x} Head", "H1") if x else para("Head", "H1") for x in labels)


def test_heading_numbers(spark):
    table = paras(spark, numbered("1.", "1.1.", "2."), numbered("1.", "1.1.1."), numbered("1.", "3."), numbered("1.", ""), numbered("1.", "1.1.", "1.1.1.", "1.1.1.1."), para("body"))
    assert verdicts(rules.heading_numbers({"paras": table})) == {"d0.docx": "pass", "d1.docx": "fail", "d2.docx": "fail", "d3.docx": "fail", "d4.docx": "fail", "d5.docx": "na"}


def test_citations(spark):
    table = paras(spark, para("x (Smith, 2019) y"), para("x [1] y"), para("x (Smith 2019) y"), para("none"))
    assert verdicts(rules.citations({"paras": table})) == {"d0.docx": "pass", "d1.docx": "fail", "d2.docx": "fail", "d3.docx": "na"}


def test_references(spark):
    table = paras(spark, para("(Smith, 2019)") + para("References") + para("Smith, J.") + para("Adams, A."), para("plain"))
    assert verdicts(rules.references({"paras": table})) == {"d0.docx": "fail", "d1.docx": "na"}


def test_names(spark):
    docs = spark.createDataFrame([("a/LessonPlan-G6-Tauheed-v1.0.docx",), ("Plan final.docx",)], "rel string")
    got = {(r.code, r.doc): r.status for r in rules.run({"docs": docs}).collect()}
    good, bad = "a/LessonPlan-G6-Tauheed-v1.0.docx", "Plan final.docx"
    assert [got[c, good] for c in ("WE1", "WE2", "WE3")] == ["pass", "pass", "needs_review"]
    assert [got[c, bad] for c in ("WE1", "WE2", "WE3")] == ["fail", "fail", "fail"]


def test_captions_fonts_numbers(spark):
    cell = lambda text: f"<w:tbl><w:tr><w:tc>{para(text)}</w:tc></w:tr></w:tbl>"
    table = paras(spark, para("Table 1: a") + cell("x") + para("Table 2: b") + cell("y"), para("Table 2: a") + cell("x"), cell("x"), para("no tables ٣"))
    assert verdicts(rules.table_captions({"paras": table})) == {"d0.docx": "pass", "d1.docx": "fail", "d2.docx": "fail", "d3.docx": "na"}
    assert set(verdicts(rules.latin_family({"paras": table})).values()) == {"pass"}
    assert verdicts(rules.western_numbers({"paras": table}))["d3.docx"] == "fail"
    assert rules.run({"paras": table}).select("code").distinct().count() >= 10


def test_sections_and_questions(spark):
    labels = {"a": ["intro"], "b": ["main part"], "c": ["close"]}
    table = paras(spark, para("Intro: x") + para("Main part") + para("Close"), para("Close") + para("Intro") + para("Main part"))
    assert verdicts(rules.sections_in_order(table, labels)) == {"d0.docx": "pass", "d1.docx": "fail"}
    quiz = paras(spark, "".join(para(x) for x in ("1. First?", "a) x", "b) y", "c) z", "2) Second ____", "3: True or false: it rains")))
    got = assessments.questions(quiz).orderBy("num").collect()
    assert [(r.num, r.kind) for r in got] == [(1, "mcq"), (2, "fill_blank"), (3, "true_false")]
    row = assessments.counted({"paras": quiz}, "PQ1", 2, 3, 0.3).first()
    assert (row.status, row.partial) == ("pass", True)


def test_slides(spark):
    slide = lambda rel, k, title, text, notes: (rel, k, title, [text], notes, 12192000, 6858000, [{"kind": "ftr", "text": "Guide v1"}, {"kind": "sldNum", "text": "1"}, {"kind": "dt", "text": "d"}], [], [{"text": text, "font": "Poppins", "size": 12.0, "bold": False, "color": None, "spacing": 1.5}])
    rows = [slide("g", 1, "Cover", "Duration: 40 minutes", "Time: 2 min"), slide("g", 2, "A", "x", "18-20 min"), slide("g", 3, "B", "y", "19 min")]
    rows += [slide("b", 1, "Cover", "x", "1 min"), slide("b", 2, "A", "x", "")]
    t = {"slides": spark.createDataFrame(rows, ooxml.SLIDES)}
    assert verdicts(rules.notes_everywhere(t)) == {"g": "pass", "b": "fail"} and verdicts(rules.timed(t)) == {"g": "pass", "b": "fail"}
    assert verdicts(rules.cover_duration(t)) == {"g": "pass", "b": "pass"} and verdicts(rules.slide_shape(t)) == {"g": "pass", "b": "pass"}
    assert verdicts(rules.slide_footers(t)) == {"g": "pass", "b": "pass"}


def test_chunks_lose_nothing(spark):
    lines = [(d, i, "x" * (37 * i % 400)) for d in (1, 2) for i in range(30)]
    got = packing.chunks(spark.createDataFrame(lines, "doc int, i int, line string"), "doc", "i", "line", 1500).collect()
    assert sorted((r.doc, r.i) for r in got if not r.repeated) == [(d, i) for d, i, _ in lines]
    per = {}
    for r in got:
        per.setdefault((r.doc, r.chunk), []).append(r)
    assert all(sum(len(r.line) + 1 for r in rows if not r.repeated) <= 1500 for rows in per.values())
    assert all(sum(r.repeated for r in rows) == 2 for (_, c), rows in per.items() if c)


@pytest.mark.parametrize("sizes, budget", [([10, 200, 300], 300), ([10, 20], 300), ([100, 100, 100], 90), ([5, 50, 50, 500], 205)])
def test_water_filling(spark, sizes, budget):
    got = packing.fitted(spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "k int, i int, s int"), "k", "i", "s", budget).orderBy("i").collect()
    level = max((x for x in range(max(sizes) + 1) if sum(min(s, x) for s in sizes) <= budget))
    assert [r.share for r in got] == [min(s, level) for s in sizes]


def test_model_seam(spark):
    model = lambda prompts: ['{"verdict": "yes", "reason": "r", "quote": "the real words"}' if "good" in p else "no json" for p in prompts]
    answers = assisted.ask(spark.createDataFrame([("good",), ("good",), ("bad",)], "prompt string"), model)
    assert sorted(str(r.verdict) for r in assisted.verdicts(answers).collect()) == ["None", "yes"]
    again = assisted.ask(spark.createDataFrame([("good",)], "prompt string"), lambda p: 1 / 0, answers.select("digest", "answer"))
    assert again.count() == 1
    rows = spark.createDataFrame([("the real words", "here are The real, words."), ("an invented one", "other text"), ("short", "short")], "quote string, material string")
    assert [r.kept for r in assisted.quoted(rows, "quote", "material").collect()] == [True, False, False]


def test_sinks(spark, tmp_path):
    findings = spark.createDataFrame([("A", "d", "fail", "m", False), ("B", "d", "pass", "ok", False)], "code string, doc string, status string, message string, partial boolean")
    assert sinks.notes(findings).first().note == "To fix: m [A]\nOK: ok [B]"
    sinks.write_json(findings, str(tmp_path / "j"))
    sinks.write_tables({"findings": findings}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "findings")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert "<td>fail</td>" in sinks.report(findings)


def test_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.write.parquet(str(tmp_path / "in"))
    stream = windows.tumbling(windows.events(spark, str(tmp_path / "in"), source.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == source.count()


def test_workbook_and_outputs(spark, tmp_path):
    import zipfile as zip_

    grid = spark.createDataFrame([("Lesson 1", "fail", "pass"), ("Lesson <2>", None, "fail")], "label string, A string, B string")
    book = sinks.workbook({"Grid": grid}, ("Grid",))
    assert list(ooxml.xlsx_cells(book)) == [("Grid", 1, 1, "label"), ("Grid", 1, 2, "A"), ("Grid", 1, 3, "B"), ("Grid", 2, 1, "Lesson 1"), ("Grid", 2, 2, "fail"), ("Grid", 2, 3, "pass"), ("Grid", 3, 1, "Lesson <2>"), ("Grid", 3, 3, "fail")]
    import io as io_

    assert 'COUNTIF(B2:C2,"fail")' in zip_.ZipFile(io_.BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
    findings = spark.createDataFrame([("A", "d", "fail", "question has no SLO tag", False), ("B", "e", "fail", "question has no SLO tag", False), ("C", "e", "pass", "ok", True), ("D", None, "needs_review", "x", False)], "code string, doc string, status string, message string, partial boolean")
    assert [(r.codes, r.places, r.line) for r in sinks.grouped_notes(findings).where("status = 'fail'").collect()] == [(["A", "B"], ["d", "e"], "To fix: Tag this question with the SLO it tests. [A, B]")]
    sinks.outputs({"notes": sinks.notes(findings.where("doc is not null"))}, findings, grid, str(tmp_path), {"name": "run"})
    assert spark.read.parquet(str(tmp_path / "files")).count() == 2 and spark.read.json(str(tmp_path / "meta")).first().value == "run"
    from lektor.operators import status

    assert {r.doc: r.note for r in status.cell_notes(findings, "doc").collect()} == {"d": "A: question has no SLO tag", "e": "B: question has no SLO tag | C (auto, partial): ok", None: "D (reviewer): x"}
    docs = spark.createDataFrame([("a.docx", "lesson", 1, 1, "", "lesson_plan", False)], "rel string, scope string, chapter int, lesson int, variant string, doc_type string, superseded boolean")
    assert [r.doc_type for r in status.missing(docs, ["lesson_plan", "chapter_exam"]).collect()] == ["chapter_exam"]
    assert status.uploaded(findings.withColumn("code", F.when(F.col("code") == "D", "PQ1").otherwise(F.col("code"))), docs).count() == 3
    registry = spark.createDataFrame([("A", "a", "yes"), ("Z", "z", None)], "code string, text string, automated string")
    assert {r.code: (r.automated, r.verdict, r.n) for r in status.checklist(findings, registry).collect()} == {"A": ("yes", "fail", 1), "Z": ("no", None, 0)}


def test_wording(spark):
    from lektor.operators import wording

    rows = spark.createDataFrame([("WE17", "3 figures lack captions"), ("WE8", "Section heading (14 bold): 31% of text is wrong (12pt: 39)"), ("WE25", "Footer is missing: no version"), ("LP3", "missing: warm_up"), ("CE1", "9 questions"), ("WE20", None)], "code string, message string")
    got = {r.code: r for r in rows.select("code", wording.todo_line(F.col("code"), F.col("message")).alias("todo"), wording.fail_line(F.col("code"), F.col("message")).alias("fail"), wording.named_code(F.col("code")).alias("name")).collect()}
    assert got["WE17"].todo == "To fix: Add a caption under each picture, like 'Figure 1: ...' (3 pictures). [WE17]"
    assert got["WE8"].todo == "To fix: Some text is not the right size. It should be: section heading 14 pt, bold. [WE8]"
    assert got["WE25"].todo == "To fix: Add the version to the footer. [WE25]" and got["LP3"].todo.endswith("out of order: missing: warm_up. [LP3]") and got["CE1"].fail == "To fix: 9 questions. [CE1]" and got["CE1"].name == "CE1 (Assessment)" and got["WE20"].todo.startswith("To fix: Add alt text to the pictures")
    lines = spark.createDataFrame([("pass", True), ("fail", True), ("fail", False), ("unclear", True)], "v string, first boolean").select(wording.model_line(F.lit("LP1"), F.col("v"), F.lit("why"), F.col("first")).alias("l")).collect()
    assert [r.l.split("\n")[0] for r in lines] == ["AI check, looks fine: why [LP1]", "AI check, may need fixing: why [LP1]", "Same as the AI note above: why [LP1]", "The AI could not decide this one. Please check it yourself. [LP1]"]
    assert spark.createDataFrame([("Recognised as pop quiz from its content: x",)], "n string").select(wording.source_note(F.col("n"))).first()[0] == "Treated as a Pop Quiz, worked out from what is in the file."


def test_profiles(tmp_path):
    from lektor.functions import profile

    path = str(tmp_path / "p.json")
    profile.save_pattern(path, r"^ex ([0-9]+)", "exercise")
    profile.save_pattern(path, r"^ex ([0-9]+)", "exercise")
    own = profile.load(path)
    assert profile.extra_patterns(own) == [r"^ex ([0-9]+)"] and own["house_rules"] == profile.PROFILE["house_rules"]
    with pytest.raises(Exception):
        profile.save_pattern(path, "(")
    assert profile.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_text_scalars(spark):
    from lektor.functions import text as T

    def one(value, f, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y

    assert one("غزوۂ ہ ه", T.fold) == "غزوہ ہ ہ".replace("ہ", "\u06C1") and one("قُلْ هُوَ اللَّهُ أَحَدٌ", T.is_scripture) and not one("یہ اردو ہے اور بس", T.is_scripture)
    assert one("Lesson-3_Part-2-The-sea", T.clean_title) == "The sea"
    assert one("Name v1.2 and version 3", T.last_version) == "3" and one("Class V 2024", T.last_version) is None
    assert one("0:45, 1:30", T.seconds_span).secs == 90 and one("2 min", T.seconds) == 120
    assert one("باب دوم", lambda c: T.chapter_number(c, {2: ["دوم"]})) == 2 and one("Chapter 12", lambda c: T.chapter_number(c, {})) == 12
    assert one("1.2.3) Head", T.leading_number) == [1, 2, 3] and one("12", T.leading_number) is None
    assert one("```json\n{}\n```", T.without_fences) == "{}" and one("a ... bb cc dd ee\nfffffff", T.pieces) == ["bb cc dd ee", "fffffff"]
    assert one("Warm-up: " + "x" * 70, lambda c: T.run_in(c, ["Warm-up"])) == 7 and one("Note: short", lambda c: T.run_in(c, [])) is None
    assert one([("a", 3), ("b", 5), ("c", 3)], lambda c: T.top_counts(c, 2), "array<struct<k:string,n:int>>") == "b: 5, a: 3"
