"""Packages and Office files, made in code."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lektor.sources import ooxml, packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:rFonts w:ascii="Poppins"/></w:rPr></w:style>
<w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/><w:rPr><w:b/><w:sz w:val="32"/></w:rPr></w:style></w:styles>"""
NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl>
<w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(text, style=None, level=None, spacing=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>' if level is not None else "") + (f'<w:spacing w:line="{spacing}"/>' if spacing else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(body):
    return archive({"word/document.xml": f'<w:document {W}><w:body>{body}<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr></w:body></w:document>', "word/styles.xml": STYLES, "word/numbering.xml": NUMBERING})


def test_docx():
    rows = list(ooxml.docx_paragraphs(docx(para("Title", "H1") + para("a", level=0) + para("b", level=1) + para("c", level=0, spacing=276) + f"<w:tbl><w:tr><w:tc>{para('x')}</w:tc><w:tc>{para('y')}</w:tc></w:tr></w:tbl>")))
    assert [r[1] for r in rows] == ["Title", "a", "b", "c", "x", "y"]
    assert rows[0][3] == 1 and rows[0][13] and rows[0][17][0]["size"] == 16 and rows[0][17][0]["font"] == "Poppins"
    assert [r[8] for r in rows[1:4]] == ["1.", "1.1", "2."]
    assert rows[3][10:12] == ("multiple", 1.15) and rows[1][10:12] == ("default", 1.0)
    assert [r[6] for r in rows[4:]] == [0, 0]
    assert next(ooxml.docx_pages(docx("")))[1] == pytest.approx(8.268, abs=1e-3)


def test_numbering_resets():
    rows = list(ooxml.docx_paragraphs(docx("".join(para("t", level=x) for x in (0, 1, 1, 0, 1)))))
    assert [r[8] for r in rows] == ["1.", "1.1", "1.2", "2.", "2.1"]


def _listed(levels, texts, kinds=("decimal",) * 3, starts=(1, 1, 1)):
    """Labels of paragraphs (list, level) where two lists share one abstract definition."""
    own = "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="{st}"/><w:numFmt w:val="{k}"/><w:lvlText w:val="{t}"/></w:lvl>' for i, (t, k, st) in enumerate(zip(texts, kinds, starts)))
    root = ooxml.ET.fromstring(f'<w:numbering {W}><w:abstractNum w:abstractNumId="4">{own}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="4"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="4"/></w:num></w:numbering>')
    numbering = ooxml.Numbering(root)
    return [numbering.label(num, level) for num, level in levels]


def test_numbering_of_shared_definitions():
    assert [x for x, _ in _listed([("1", 0), ("2", 0), ("1", 1), ("2", 1), ("1", 0), ("1", 2)], ("%1)", "%1.%2", "%1.%2.%3"))] == ["1)", "2)", "2.1", "2.2", "3)", "3.1.1"]
    assert [x for x, _ in _listed([("1", 0), ("1", 1), ("1", 1)], ("%1.", "%2)", "-"), ("upperLetter", "lowerLetter", "bullet"), (3, 1, 1))] == ["C.", "a)", "b)"]
    assert _listed([("1", 0), ("1", 1), ("1", 2), ("9", 0)], ("%1", "", "*"), ("decimalZero", "none", "bullet")) == [("1", "decimal"), ("", None), ("", "bullet"), (None, None)]


def test_theme_fonts():
    theme = ooxml.ET.fromstring('<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:minorFont><a:latin typeface="Poppins"/><a:cs typeface=""/><a:font script="Arab" typeface="Noto"/></a:minorFont></a:theme>')
    styles = ooxml.Styles(None, ooxml.Theme(theme))
    node = lambda how: [ooxml.ET.fromstring(f"<w:rPr {W}><w:rFonts {how}/></w:rPr>")]
    assert styles.font(node('w:asciiTheme="minorHAnsi"'), "ascii") == "Poppins" and styles.font(node('w:cstheme="minorBidi"'), "cs") == "Noto"
    assert styles.font(node('w:hAnsi="Own" w:asciiTheme="minorHAnsi"'), "ascii") == "Own" and styles.font(node(""), "ascii") is None


def test_circular_styles():
    assert ooxml._lineages({"a": "b", "b": "c", "c": "a", "d": "a", "e": "x"}) == {"a": ["a", "b", "c"], "b": ["b", "c", "a"], "c": ["c", "a", "b"], "d": ["d", "a", "b", "c"], "e": ["e"]}


def test_footers_and_image_sizes():
    footer = f'<w:ftr {W}><w:p><w:r><w:t>Plan v2</w:t></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:fldSimple w:instr="DATE x"/></w:p></w:ftr>'
    assert list(ooxml.docx_parts(archive({"word/footer1.xml": footer, "word/document.xml": "<x/>"}))) == [("footer", "Plan v2", ["PAGE", "DATE"])]
    assert ooxml.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")) == (640, 480)
    assert ooxml.image_size(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little")) == (7, 9)
    assert ooxml.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01") == (32, 16)
    assert ooxml.image_size(b"?") == (None, None)


def test_package(spark, tmp_path):
    names = ["Course/Chapter 1/Lesson 2/LessonPlan-v1.docx", "Course/Spec-v0.1.docx", "Course/Spec-v1.10.docx", "Course/Spec-v1.9.docx", "Course/notes.txt", "Course/~$Spec.docx", "__MACOSX/x"]
    (tmp_path / "p.zip").write_bytes(archive({n: docx(para(n)) if n.endswith("docx") else "t" for n in names}))
    files = packages.files(spark, str(tmp_path / "p.zip"))
    rows = {r.rel: r for r in packages.classified(files.drop("content"), None, [("plan", "(?i)plan", "docx", "lesson"), ("spec", "(?i)spec", "docx", "subject")]).collect()}
    assert set(rows) == {"Chapter 1/Lesson 2/LessonPlan-v1.docx", "Spec-v0.1.docx", "Spec-v1.10.docx", "Spec-v1.9.docx", "notes.txt"}
    assert (rows["Chapter 1/Lesson 2/LessonPlan-v1.docx"].chapter, rows["Chapter 1/Lesson 2/LessonPlan-v1.docx"].lesson) == (1, 2)
    assert [r for r in rows if not rows[r].superseded and rows[r].doc_type == "spec"] == ["Spec-v1.10.docx"]
    assert rows["notes.txt"].doc_type is None
    assert ooxml.paragraphs(files).groupBy("rel").agg(F.count(F.lit(1)).alias("n")).count() == 4
    assert ooxml.unreadable(files).count() == 0


def test_guard():
    def entry(name, size=1, packed=1):
        e = zipfile.ZipInfo(name)
        e.file_size, e.compress_size = size, packed
        return e

    packages.guard([entry("a/b")])
    for bad in ([entry("../x")], [entry("/x")], [entry("a", 5 << 30)], [entry("a", 60 << 20, 1)], [entry(str(i)) for i in range(20_001)]):
        with pytest.raises(packages.UnsafeArchive):
            packages.guard(bad)


def test_locations_and_names(spark):
    rels = ["Chapter 2/Lesson 3 Part 2/x.docx", "Chpater-4/Lesson_5 part 1 c /y.docx", "Lesson-2b-Chapter-7-v1.docx", "notes.docx", "Chapter 1/Pop Quiz.docx", "Chapter 3/Chapter-Exam.docx", "deck.pptx", "old.pdf"]
    rows = spark.createDataFrame([(r, r.rsplit(".", 1)[-1]) for r in rels], "rel string, ext string")
    got = {r.rel: r for r in packages.classified(rows).collect()}
    assert [tuple(got[r][c] for c in ("chapter", "lesson", "variant")) for r in rels[:3]] == [(2, 3, "B"), (4, 5, "C"), (7, 2, "B")]
    assert (got[rels[4]].doc_type, got[rels[4]].chapter, got[rels[5]].doc_type, got[rels[5]].chapter, got[rels[5]].lesson) == ("pop_quiz", None, "worksheet", 3, None)
    assert (got["deck.pptx"].doc_type, got["deck.pptx"].chapter, got["deck.pptx"].lesson, got["notes.docx"].doc_type) == ("facilitator_guide", 1, 1, None)
    names = {r.rel: r.n for r in packages.classified(rows).select("rel", packages.new_name(F.lit("1.2"), F.lit("Grade-6")).alias("n")).collect()}
    assert names["Chapter 1/Pop Quiz.docx"] == "Pop-Quiz-Grade-6-v1.2.docx" and names["Chapter 3/Chapter-Exam.docx"] == "Chapter-Exam-Chapter-3-v1.2.docx" and names["deck.pptx"] == "Facilitator-Guide-Lesson-1-Chapter-1-v1.2.pptx" and names["notes.docx"] is None


def test_kinds_by_content(spark):
    cell = lambda *texts: "<w:tbl><w:tr>" + "".join(f"<w:tc>{para(t)}</w:tc>" for t in texts) + "</w:tr></w:tbl>"
    bodies = {"a": para("Pop Quiz for chapter 3, lesson 2"), "b": para("Introduction") + para("SLOs") + para("Key Takeaways"), "c": para("x") * 6 + para("Lesson Plan Location: 4.2"), "d": para("x") + cell("Incorrect feedback", "no"), "e": cell("Scene", "Narration"), "f": "".join(para(f"{i}. What is it?") for i in range(1, 5)), "g": para("Just text")}
    rows = [(f"{k}.docx", *r) for k, b in bodies.items() for r in ooxml.docx_paragraphs(docx(b))]
    got = {r.rel[0]: r for r in packages.by_content(spark.createDataFrame(rows, ooxml.PARAS)).collect()}
    assert {k: got[k].doc_type for k in bodies} == {"a": "pop_quiz", "b": "lesson_plan", "c": "pop_quiz", "d": "data_bank", "e": "video_storyboard", "f": "chapter_exam", "g": "document"}
    assert (got["a"].chapter, got["a"].lesson) == (3, 2)
