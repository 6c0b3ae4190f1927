"""Rules over document tables: a code and a function from tables to findings (code, doc, status, message, partial).

``tables`` maps names to DataFrames in the shape of ``sources.ooxml``: docs (rel, doc_type), paras, pages (sections of Word files), parts (headers
and footers), images, slides, cells (tables of Word files). Rules measure with one aggregate per document and decide with one ``when``
chain; ``run`` unites what the asked-for codes find. Names, fonts, sizes and thresholds come from a profile. Register more with ``rule``.

Comparisons use the folded, lower-case form of a line. Where it needs compatibility composition as well, give paras a column ``norm`` made by
``prepared`` with ``udf.nfkc``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektor.functions import profile as P
from lektor.functions import text as T
from lektor.operators import matching, segments, status

Tables = dict[str, DataFrame]
RULES: dict[str, tuple[str, Callable[..., DataFrame]]] = {}
PROFILE = P.PROFILE
VOCAB, HOUSE, TOLERANCE, GREY = PROFILE["vocab"], PROFILE["house_rules"], PROFILE["thresholds"]["text_size_tolerance"], PROFILE["thresholds"]["colour_grey_tolerance"]
SECTIONS = PROFILE["lesson_plan_sections"]
SECTION_LABELS = [x for labels in SECTIONS.values() for x in labels]


def rule(code: str, table: str) -> Callable:
    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        RULES[code] = (table, f)
        return f

    return register


def run(tables: Tables, codes: list[str] | None = None) -> DataFrame:
    """Bag union of the findings of all rules whose table is there."""
    chosen = [f(tables) for code, (table, f) in RULES.items() if table in tables and (codes is None or code in codes)]
    return reduce(DataFrame.unionByName, chosen)


def _emit(code: str, rows: DataFrame, verdict: Column, message: str, partial: Column | bool = False) -> DataFrame:
    flag = F.coalesce(partial, F.lit(False)) if isinstance(partial, Column) else partial
    return rows.select(*status.finding(code, F.col("rel"), verdict, F.lit(message), flag))


def _share(off: Column, size: Column) -> Column:
    return F.try_divide(F.sum(F.when(off, size).otherwise(0)), F.sum(size))


def prepared(paras: DataFrame, compose: Callable[[str], Column] | None = None) -> DataFrame:
    """``paras`` with its comparison form: folded and lower case, composed first where ``compose`` does that."""
    return paras.withColumn("norm", F.lower(T.fold(compose("text") if compose else F.col("text"))))


def _paras(t: Tables) -> DataFrame:
    rows = t["paras"] if "norm" in t["paras"].columns else prepared(t["paras"])
    return rows.withColumn("west", T.western_digits(F.col("norm"))).withColumn("quoted", T.is_scripture(F.col("text"))).withColumn("bare", T.unlabelled(F.col("text")))


def _lines(t: Tables) -> DataFrame:
    return _paras(t).where(F.trim("text") != "")


def _every(t: Tables, rows: DataFrame, table: str = "paras") -> DataFrame:
    """``rows`` with a row of nulls for each document of the table that has none."""
    return t[table].select("rel").distinct().join(rows, "rel", "left")


def _typed(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(t["docs"].select("rel", "doc_type"), "rel", "left") if "docs" in t else rows.withColumn("doc_type", F.lit(None).cast("string"))


def _runs(t: Tables) -> DataFrame:
    if "paras" in t:
        return t["paras"].select("rel", "idx", F.explode("runs").alias("r")).select("rel", "idx", "r.*")
    rows = t["slides"].select("rel", F.col("slide").alias("idx"), F.explode("runs").alias("r")).select("rel", "idx", "r.*")
    return rows.withColumn("script", T.dominant_script(F.col("text")))


# names


def _stem() -> Column:
    return T.file_stem(F.col("rel"))


@rule("WE1", "docs")
def name_shape(t: Tables) -> DataFrame:
    good = _stem().rlike(r"^[^-]+-[^-]+-.+-v[0-9]+(\.[0-9]+)*$")
    return _emit("WE1", t["docs"], F.when(good, "pass").otherwise("fail"), "name: type, id, topic, version", good)


@rule("WE2", "docs")
def no_draft(t: Tables) -> DataFrame:
    return _emit("WE2", t["docs"], F.when(F.lower(F.element_at(F.split("rel", "/"), -1)).rlike("draft|final"), "fail").otherwise("pass"), "no draft or final in the name")


@rule("WE3", "docs")
def version_named(t: Tables) -> DataFrame:
    return _emit("WE3", t["docs"], F.when(F.lower(F.element_at(F.split("rel", "/"), -1)).rlike("-v[0-9]"), "needs_review").otherwise("fail"), "version in the name")


# page and type


@rule("WE4", "paras")
def page_and_spacing(t: Tables) -> DataFrame:
    off = (F.col("line_kind") == "points") | (F.abs(F.col("line_value") - 1.15) > 0.01)
    lines = _every(t, t["paras"].where(F.trim("text") != "").groupBy("rel").agg(_share(off, F.length("text")).alias("off")))
    near = lambda c, x, tol: F.abs(F.col(c) - x) <= tol
    good = near("width_in", 8.27, 0.06) & near("height_in", 11.69, 0.06) & F.forall("margins", lambda m: F.abs(m - 1) <= 0.02)
    pages = t["pages"].groupBy("rel").agg(F.bool_and(good).alias("good")) if "pages" in t else lines.select("rel", F.lit(True).alias("good"))
    return _emit("WE4", lines.join(pages, "rel", "left"), F.when(~F.coalesce("good", F.lit(True)) | (F.coalesce("off", F.lit(0.0)) > TOLERANCE), "fail").otherwise("pass"), "A4 upright, margins of one inch, spacing 1.15")


@rule("WE5", "slides")
def slide_shape(t: Tables) -> DataFrame:
    """16:9, line spacing 1.5; spacing that isn't stated is 1.0 by the master and makes a pass partial."""
    shape = t["slides"].groupBy("rel").agg(F.max(F.abs(F.try_divide(F.col("width").cast("double"), F.col("height")) - 16 / 9)).alias("shape"))
    spacing = _runs({"slides": t["slides"]}).groupBy("rel").agg(_share(F.abs(F.coalesce("spacing", F.lit(1.0)) - 1.5) > 0.01, F.length("text")).alias("off"), F.bool_or(F.col("spacing").isNull()).alias("inherited"))
    rows = shape.join(spacing, "rel", "left")
    return _emit("WE5", rows, F.when((F.coalesce("shape", F.lit(9.0)) > 0.02) | (F.coalesce("off", F.lit(0.0)) > TOLERANCE), "fail").otherwise("pass"), "slides of 16:9, spacing 1.5", (F.coalesce("shape", F.lit(9.0)) <= 0.02) & (F.coalesce("off", F.lit(0.0)) <= TOLERANCE) & F.col("inherited"))


def _families(t: Tables, script: str) -> DataFrame:
    """(rel, fonts): canonical faces of all runs of a script; one that isn't known counts as a face of its own."""
    rows = _runs(t).where(F.col("script") == script)
    if script == "arabic":
        rows = rows.where(~T.is_scripture(F.col("text")))
    return _every(t, rows.groupBy("rel").agg(F.collect_set(F.coalesce(T.canonical_font(F.col("font")), F.lit("?"))).alias("fonts")), "paras" if "paras" in t else "slides")


def _allowed(fonts: list[str]) -> Column:
    return F.array(*[F.lit(f.lower().replace(" ", "").replace("-", "").replace("_", "")) for f in fonts])


@rule("WE6", "paras")
def latin_family(t: Tables, fonts: list[str] = HOUSE["english_fonts"]) -> DataFrame:
    good = (F.size("fonts") == 1) & (F.size(F.array_except("fonts", _allowed(fonts))) == 0)
    return _emit("WE6", _families(t, "latin"), F.when(F.col("fonts").isNull(), "na").when(good, "pass").otherwise("fail"), "one allowed Latin family")


@rule("WE7", "paras")
def arabic_family(t: Tables, fonts: list[str] = HOUSE["urdu_fonts"]) -> DataFrame:
    return _emit("WE7", _families(t, "arabic"), F.when(F.col("fonts").isNull(), "na").when(F.size(F.array_except("fonts", _allowed(fonts))) == 0, "pass").otherwise("fail"), "allowed Urdu families")


def grade_sizes(grade: int | None) -> dict:
    """The sizes for a grade; the default grade where none is known, the lowest band's where no band holds it."""
    at = HOUSE["default_grade"] if grade is None else grade
    return next((b for b in HOUSE["sizes_by_grade"] if b["grades"][0] <= at <= b["grades"][1]), {"title": 20, "section_heading": 16, "body": 14, "table_body": 14, "table_header": 14, "caption": 11})


def is_caption() -> Column:
    return F.lower(F.coalesce("style", F.lit(""))).contains("caption") | F.col("west").rlike(P.caption_pattern(PROFILE, "table")) | F.col("west").rlike(P.caption_pattern(PROFILE, "figure"))


def roles(t: Tables) -> DataFrame:
    """Non-blank lines with their role: title, section_heading, toc, caption, table_header, table_body, body; null for lower headings and scripture."""
    w = Window.partitionBy("rel")
    rows = _lines(t).withColumn("head", heading_like()).withColumn("first", F.col("idx") == F.min(F.when(~F.col("in_table"), F.col("idx"))).over(w))
    level = F.col("heading_level")
    head = F.col("head") & ~(F.col("first") & level.isNull())
    role = (
        F.when(F.col("quoted"), None)
        .when((F.lower(F.coalesce("style", F.lit(""))) == "title") | (F.col("first") & level.isNull()), "title")
        .when((level == 1) | (head & level.isNull()), "section_heading")
        .when(level.isNotNull(), None)
        .when(F.col("in_toc"), "toc")
        .when(is_caption(), "caption")
        .when(F.col("in_table") & (F.col("row_idx") == 0), "table_header")
        .when(F.col("in_table"), "table_body")
        .otherwise("body")
    )
    return rows.withColumn("role", role).withColumn("head", head)


@rule("WE8", "paras")
def sizes_by_role(t: Tables, grade: int | None = None) -> DataFrame:
    sizes = grade_sizes(grade)
    want = F.coalesce(*[F.when(F.col("role") == k, float(sizes[k])) for k in ("title", "section_heading", "body", "table_body", "table_header", "caption")])
    rows = roles(t).where("role is not null").select("rel", "role", F.explode("runs").alias("r")).where("r.script is not null")
    bad = F.coalesce(F.col("r.size").isNull() | (F.abs(F.col("r.size") - want) > 0.01), F.lit(False)) & want.isNotNull()
    bad = bad | (F.col("role").isin("title", "section_heading", "table_header") & ~F.coalesce("r.bold", F.lit(False))) | ((F.col("role") == "caption") & ~F.coalesce("r.italic", F.lit(False)))
    bad = bad | ((F.col("role") == "toc") & (F.coalesce(T.canonical_font(F.col("r.font")), F.lit("")) != "arial"))
    per = rows.groupBy("rel", "role").agg(_share(bad, F.length("r.text")).alias("off"))
    return _emit("WE8", _every(t, per.groupBy("rel").agg(F.max("off").alias("off"))), F.when(F.col("off").isNull(), "na").when(F.col("off") > TOLERANCE, "fail").otherwise("pass"), "sizes and weights by role")


@rule("WE10", "paras")
def western_numbers(t: Tables) -> DataFrame:
    """Other digits than Western ones fail, but for verse numbers and vowelled scripture, which are quoted as written."""
    every, outside = T.eastern_digits(F.col("text")), T.eastern_digits(T.outside_verse_marks(F.col("text")))
    kept = F.when(F.col("quoted"), every).otherwise(every - outside)
    rows = _paras(t).groupBy("rel").agg(F.sum(F.when(F.col("quoted"), 0).otherwise(outside)).alias("n"), F.sum(kept).alias("q"))
    return _emit("WE10", rows, F.when(F.col("n") > 0, "fail").otherwise("pass"), "Western digits", (F.col("n") == 0) & (F.col("q") > 0))


@rule("WE11", "paras")
def direction(t: Tables) -> DataFrame:
    size = lambda script: F.aggregate(F.filter("runs", lambda r: r["script"] == script), F.lit(0), lambda a, r: a + F.length(r["text"]))
    rows = t["paras"].withColumn("ar", size("arabic")).withColumn("la", size("latin")).where("ar + la > 0")
    bad = rows.groupBy("rel").agg(F.count_if(F.coalesce("bidi", F.lit(False)) != (F.col("ar") >= F.col("la"))).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _emit("WE11", _every(t, bad), F.when(n > 0, "fail").otherwise("pass"), "direction follows the script", n == 0)


@rule("WE23", "paras")
def colours(t: Tables) -> DataFrame:
    """No colour in text, highlights and shading; yellow highlights are how quizzes and banks mark answers."""
    plain = lambda c: c.isNull() | F.lower(c).isin("auto", "ffffff") | T.is_grey(c, GREY)
    marks = _typed(t, t["paras"])
    answers = F.coalesce(F.col("doc_type").isin("pop_quiz", "data_bank"), F.lit(False))
    lit_ = lambda r: r["highlight"].isNotNull() & (r["highlight"] != "none") & ~(answers & (F.lower(r["highlight"]) == "yellow"))
    coloured = F.exists("runs", lambda r: ~plain(r["color"]) | F.coalesce(lit_(r), F.lit(False)))
    rows = marks.groupBy("rel").agg(F.count_if(F.coalesce(coloured, F.lit(False)) | ~plain(F.col("shading"))).alias("n"))
    return _emit("WE23", rows, F.when(F.col("n") > 0, "fail").otherwise("pass"), "neutral colours only")


# headings


def misstyled() -> Column:
    """Running text in a heading style: long, or of two sentences or more."""
    bare = F.regexp_replace(T.western_digits(F.trim("text")), r"^\s*[0-9]+(?:\.[0-9]+)*[.)]?\s*", "")
    long = (F.length(bare) > 90) | (F.regexp_count(bare, F.lit(r"[.!?؟۔](\s|$)")) >= 2)
    return F.coalesce(F.col("heading_level").isNotNull() & ~F.col("in_table") & ~T.starts_with_label(bare, SECTION_LABELS) & long, F.lit(False))


def heading_like() -> Column:
    """A section heading: in a heading style, with a section's label, or a short bold line that ends no sentence. Questions, answers, options, items,
    quoted scripture, labels of sub-lists and lines with a lesson's or chapter's own number are none."""
    line, norm, west = F.trim("text"), F.col("norm"), F.col("west")
    never = F.col("in_table") | F.col("in_toc") | (F.lower(F.coalesce("style", F.lit(""))) == "title") | west.rlike(P.question_pattern(PROFILE, True)) | west.rlike(P.own_number_pattern(PROFILE)) | F.col("quoted")
    never = never | F.rtrim(F.regexp_replace(norm, "[:：]+$", "")).isin(P.lower(VOCAB["slo_sublabels"])) | T.begins_with_any(norm, VOCAB["answer_line_labels"])
    never = never | line.rlike(r"\S\s*/\s*\S[^/]*\s/\s*\S") | T.bullet_text(F.col("text"))
    bare = (F.length(line) <= 90) & F.col("list_kind").isNull() & (T.label_leads(F.col("bare"), SECTION_LABELS) | (F.coalesce("all_bold", F.lit(False)) & ~line.rlike("[.!?؟۔:：]$")))
    return F.coalesce(~never & F.when(F.col("heading_level").isNotNull(), ~misstyled()).otherwise(bare), F.lit(False))


def headings(t: Tables) -> DataFrame:
    """Heading lines; the opening line is the title unless it is in a heading style."""
    return roles(t).where("head")


def numbers() -> Column:
    """The decimal number of a heading, from its automatic label or its text."""
    label = F.coalesce("num_label", F.lit(""))
    auto = F.when(F.col("list_kind") == "decimal", F.transform(F.regexp_extract_all(label, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")))
    return F.when(label != "", F.when(F.size(auto) > 0, auto)).otherwise(T.leading_number(F.col("text")))


@rule("WE12", "paras")
def heading_numbers(t: Tables, code: str = "WE12") -> DataFrame:
    """All headings numbered (but for appendices), three levels at most, no level skipped, children from one, siblings by one."""
    appendix = T.begins_with_any(F.col("norm"), VOCAB["appendix_headings"])
    heads = headings(t).withColumn("p", numbers()).where(~(F.col("p").isNull() & appendix))
    every = headings(t).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    bare = heads.groupBy("rel").agg(F.count_if(F.col("p").isNull()).alias("bare"))
    own = heads.where("p is not null").withColumn("q", F.coalesce(F.lag("p").over(Window.partitionBy("rel").orderBy("idx")), F.array().cast("array<int>")))
    n, m, last = F.size("p"), F.size("q"), F.element_at("p", -1)
    siblings = (n <= m) & (F.slice("p", F.lit(1), n - 1) == F.slice("q", F.lit(1), n - 1)) & (last != F.try_element_at("q", n) + 1)
    wrong = own.groupBy("rel").agg(F.count_if((n > 3) | (n > m + 1) | ((n == m + 1) & (last != 1)) | siblings).alias("wrong"))
    rows = _every(t, every.join(bare, "rel", "left").join(wrong, "rel", "left"))
    bad = F.coalesce("bare", F.lit(0)) + F.coalesce("wrong", F.lit(0))
    return _emit(code, rows, F.when(F.col("n").isNull(), "na").when(bad > 0, "fail").otherwise("pass"), "decimal numbering of headings")


@rule("WE13", "paras")
def heading_styles(t: Tables) -> DataFrame:
    rows = roles(t).groupBy("rel").agg(F.count_if("head").alias("n"), F.count_if(F.col("head") & F.col("heading_level").isNull()).alias("bare"), F.count_if(misstyled() & ~F.col("quoted")).alias("body"))
    return _emit("WE13", rows, F.when(F.col("n") + F.col("body") == 0, "na").when(F.col("bare") + F.col("body") > 0, "fail").otherwise("pass"), "headings, and only those, in heading styles")


def page_estimate(t: Tables, width: float = 468.0, height: float = 648.0) -> DataFrame:
    """(rel, pages): a low estimate from text length and size, for files that don't record their pages."""
    size = F.coalesce(F.array_max(F.transform("runs", lambda r: r["size"])), F.lit(11.0))
    lead = F.when(F.exists("runs", lambda r: F.coalesce(r["script"] == "arabic", F.lit(False))), 1.8).otherwise(1.2)
    rows = F.greatest(F.lit(1), F.ceil(F.length("text") / F.greatest(F.lit(1.0), F.lit(width) / (size * 0.45))))
    return t["paras"].where(F.trim("text") != "").groupBy("rel").agg((F.sum(rows * size * lead) / height).alias("pages"))


@rule("WE15", "paras")
def contents_table(t: Tables) -> DataFrame:
    """A lesson plan of more than two pages has a table of contents; without a page count the estimate decides from three on."""
    toc = t["paras"].groupBy("rel").agg(F.bool_or("in_toc").alias("toc"))
    rows = _typed(t, toc.join(page_estimate(t).withColumnRenamed("pages", "guess"), "rel", "left"))
    known = F.col("pages") if "docs" in t and "pages" in t["docs"].columns else F.lit(None).cast("int")
    if "docs" in t and "pages" in t["docs"].columns:
        rows = rows.join(t["docs"].select("rel", "pages"), "rel", "left")
    verdict = F.when(~F.coalesce(F.col("doc_type") == "lesson_plan", F.lit(False)), "na").when(F.col("toc"), "pass")
    verdict = verdict.when(known.isNull(), F.when(F.col("guess") >= 3, "fail").otherwise("needs_review")).when(known > 2, "fail").otherwise("pass")
    return _emit("WE15", rows, verdict, "contents of long lesson plans")


# captions and pictures


@rule("WE16", "paras")
def table_captions(t: Tables) -> DataFrame:
    """Each table has a numbered caption right above; numbers count up from the last one seen."""
    w = Window.partitionBy("rel").orderBy("idx")
    rows = _lines(t).withColumn("n", F.when(~F.col("in_table"), F.regexp_extract("west", P.caption_pattern(PROFILE, "table"), 1).try_cast("int")))
    rows = rows.withColumn("above", F.lag("n").over(w)).withColumn("first", F.col("in_table") & ~F.coalesce(F.lag("in_table").over(w), F.lit(False)))
    tops = rows.where("first").withColumn("seen", F.coalesce(F.last("above", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = tops.groupBy("rel").agg(F.count_if(F.col("above").isNull() | (F.col("above") != F.col("seen") + 1)).alias("bad"))
    return _emit("WE16", _every(t, got), F.when(F.col("bad").isNull(), "na").when(F.col("bad") > 0, "fail").otherwise("pass"), "a numbered caption above each table")


@rule("WE17", "images")
def figure_captions(t: Tables) -> DataFrame:
    """Each picture's next line is a numbered caption, 11 points and italic; numbers count up from the last one seen."""
    lines = _lines(t).select("rel", "idx", F.regexp_extract("west", P.caption_pattern(PROFILE, "figure"), 1).try_cast("int").alias("n"), "runs")
    places = t["images"].select("rel", F.col("place").alias("idx")).distinct()
    both = lines.withColumn("pic", F.lit(False)).unionByName(places.withColumn("n", F.lit(None).cast("int")).withColumn("runs", F.lit(None).cast(lines.schema["runs"].dataType)).withColumn("pic", F.lit(True)))
    nexts = both.withColumn("cap", F.first(F.when(~F.col("pic"), F.struct("idx", "n", "runs")), ignorenulls=True).over(Window.partitionBy("rel").orderBy("idx", "pic").rowsBetween(1, Window.unboundedFollowing))).where("pic")
    w = Window.partitionBy("rel").orderBy("idx")
    nexts = nexts.withColumn("seen", F.coalesce(F.last("cap.n", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plain = F.exists("cap.runs", lambda r: r["script"].isNotNull() & (r["size"].isNull() | (F.abs(r["size"] - 11) > 0.01) | ~F.coalesce(r["italic"], F.lit(False))))
    got = nexts.groupBy("rel").agg(F.count_if(F.col("cap.n").isNull() | (F.col("cap.n") != F.col("seen") + 1) | F.coalesce(plain, F.lit(False))).alias("bad"))
    return _emit("WE17", _every(t, got), F.when(F.col("bad").isNull(), "na").when(F.col("bad") > 0, "fail").otherwise("pass"), "a numbered caption under each figure")


def _pictures(code: str, t: Tables, verdict: Column, message: str, *measures: Column, partial: Column | bool = False) -> DataFrame:
    rows = _every(t, t["images"].groupBy("rel").agg(F.count(F.lit(1)).alias("k"), *measures), "docs")
    return _emit(code, rows, F.when(F.col("k").isNull(), "na").otherwise(verdict), message, partial)


@rule("WE18", "images")
def monochrome(t: Tables) -> DataFrame:
    """Colour can't be told without an image decoder; where a column ``colourful`` says so it counts, else a reviewer looks."""
    known = F.col("colourful") if "colourful" in t["images"].columns else F.lit(None).cast("boolean")
    return _pictures("WE18", t, F.when(F.col("c") > 0, "fail").when(F.col("u") > 0, "needs_review").otherwise("pass"), "pictures without colour", F.count_if(known).alias("c"), F.count_if(known.isNull()).alias("u"))


@rule("WE19", "images")
def resolution(t: Tables) -> DataFrame:
    dpi = F.col("width_px") / (F.col("width_emu") / 914400)
    low = F.coalesce(~F.lower("name").rlike(r"\.(emf|wmf|svg)$") & (F.col("width_emu") > 0) & (F.col("width_px") > 0) & (dpi < PROFILE["thresholds"]["min_image_dpi"]), F.lit(False))
    return _pictures("WE19", t, F.when(F.col("c") > 0, "fail").otherwise("pass"), "pictures of 150 dpi", F.count_if(low).alias("c"), partial=F.col("c") == 0)


@rule("WE20", "images")
def alt_text(t: Tables) -> DataFrame:
    return _pictures("WE20", t, F.when(F.col("c") > 0, "fail").otherwise("pass"), "alt text on every picture", F.count_if(F.coalesce("descr", F.lit("")) == "").alias("c"))


# sources


# Citations as (Author, Year), as numbers, and without the comma.
_AUTHORS = r"[A-Z][A-Za-z\-']+(?:\s+(?:&|and)\s+[A-Z][A-Za-z\-']+|\s+et al\.)?"
CITED = rf"\({_AUTHORS},\s+(?:[0-9]{{4}}[a-z]?|n\.d\.)\)"
MISCITED = [r"\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]", rf"\({_AUTHORS}\s+[0-9]{{4}}[a-z]?\)"]


def cited(t: Tables) -> DataFrame:
    """(rel, good, bad): citations as author and year, and others."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    return t["paras"].groupBy("rel").agg(F.sum(count(CITED)).alias("good"), F.sum(count(MISCITED[0]) + count(MISCITED[1])).alias("bad"))


@rule("WE21", "paras")
def citations(t: Tables) -> DataFrame:
    return _emit("WE21", cited(t), F.when(F.col("bad") > 0, "fail").when(F.col("good") > 0, "pass").otherwise("na"), "citations as author and year")


@rule("WE22", "paras")
def references(t: Tables) -> DataFrame:
    head = ~F.col("in_table") & (F.length(F.trim("text")) <= 40) & F.trim(F.regexp_replace("norm", "^[ :]+|[ :]+$", "")).isin(P.lower(VOCAB["reference_list_labels"]))
    rows = _lines(t).withColumn("head", F.min(F.when(head, F.col("idx"))).over(Window.partitionBy("rel"))).where("not in_table and idx > head")
    order = segments.ascending(rows, ["rel"], ["idx"], F.col("norm"))
    hang = rows.groupBy("rel").agg(F.bool_and(F.coalesce("hanging", F.lit(0)) > 0).alias("hang"))
    found = _lines(t).where(head).select("rel").distinct().withColumn("listed", F.lit(True))
    all_ = cited(t).join(found, "rel", "left").join(order, "rel", "left").join(hang, "rel", "left")
    verdict = F.when(F.col("listed").isNull(), F.when(F.col("good") + F.col("bad") > 0, "fail").otherwise("na")).when(F.coalesce(F.col("in_order") & F.col("hang"), F.lit(False)), "pass").otherwise("fail")
    return _emit("WE22", all_, verdict, "alphabetical references with hanging indent")


@rule("WE25", "parts")
def footers(t: Tables) -> DataFrame:
    """Footers hold a page number, a version, a date and a name."""
    rows = t["parts"].where("kind = 'footer'").groupBy("rel").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("s"), F.flatten(F.collect_list("fields")).alias("f"))
    rows = _every(t, rows, "docs")
    said = F.coalesce("s", F.lit(""))
    has = lambda name: F.coalesce(F.array_contains("f", name), F.lit(False))
    date = has("DATE") | has("SAVEDATE") | T.western_digits(said).rlike(r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{1,2}\s+[A-Za-z]{3,9}\s+[0-9]{4}")
    name = F.length(F.trim(F.regexp_replace(said, r"(?i)v\s?[0-9]+(?:\.[0-9]+)*|[0-9][0-9\-/.]*", ""))) >= 3
    good = (has("PAGE") | said.rlike("[0-9]")) & said.rlike(r"(?i)v\s?[0-9]+") & date & name
    return _emit("WE25", rows, F.when(good, "pass").otherwise("fail"), "footer with page, version, date and name", good)


def slide_footers(t: Tables, code: str = "WE25") -> DataFrame:
    """For slides: number, date, and a footer text with a version."""
    kinds = F.array_distinct(F.flatten(F.collect_list(F.transform("footers", lambda f: f["kind"]))))
    said = F.array_join(F.flatten(F.collect_list(F.transform(F.filter("footers", lambda f: f["kind"] == "ftr"), lambda f: f["text"]))), " ")
    rows = t["slides"].groupBy("rel").agg(kinds.alias("k"), said.alias("s"))
    good = F.array_contains("k", "sldNum") & F.array_contains("k", "dt") & F.array_contains("k", "ftr") & F.col("s").rlike(r"(?i)v\s?[0-9]+")
    return _emit(code, rows, F.when(good, "pass").otherwise("fail"), "footer with page, version, date and name", good)


# lesson plans


def sections(paras: DataFrame, labels: dict[str, list[str]] = SECTIONS) -> DataFrame:
    """(rel, section, start): the first paragraph, outside tables and contents, that begins with a label of each section."""
    hits = F.array_compact(F.array(*[F.when(T.label_leads(F.col("bare"), words), F.lit(name)) for name, words in labels.items()]))
    return paras.where("not in_table and not in_toc").withColumn("bare", T.unlabelled(F.col("text"))).withColumn("section", F.explode(hits)).groupBy("rel", "section").agg(F.min("idx").alias("start"))


@rule("LP3", "paras")
def plan_sections(t: Tables) -> DataFrame:
    return sections_in_order(t["paras"])


def sections_in_order(paras: DataFrame, labels: dict[str, list[str]] = SECTIONS, code: str = "LP3") -> DataFrame:
    names = list(labels)
    want = F.coalesce(*[F.when(F.col("section") == n, k) for k, n in enumerate(names)])
    found = sections(paras, labels).groupBy("rel").agg(F.transform(F.array_sort(F.collect_list(F.struct(want.alias("k"), "start"))), lambda x: x["start"]).alias("s"))
    every = paras.select("rel").distinct().join(found, "rel", "left")
    return _emit(code, every, F.when((F.size("s") == len(names)) & (F.col("s") == F.array_sort("s")), "pass").otherwise("fail"), "all sections, in order")


@rule("WE14", "paras")
def plan_sections_again(t: Tables) -> DataFrame:
    """The same rule under another code."""
    return sections_in_order(t["paras"], code="WE14")


@rule("LP4", "paras")
def plan_numbers(t: Tables) -> DataFrame:
    return heading_numbers(t, "LP4")


def section_lines(t: Tables, section: str, labels: dict[str, list[str]] = SECTIONS) -> DataFrame:
    """Non-blank lines strictly inside a section: behind its first line, before the next section's."""
    starts = sections(t["paras"], labels)
    w = Window.partitionBy("rel").orderBy("start", "section")
    spans = starts.withColumn("stop", F.lead("start").over(w)).where(F.col("section") == section).select("rel", "start", "stop")
    return _lines(t).join(spans, "rel").where((F.col("idx") > F.col("start")) & (F.col("stop").isNull() | (F.col("idx") < F.col("stop"))))


def outcome_blocks(t: Tables) -> DataFrame:
    """(rel, start, stop): every outcome section, to the next section or heading that is no label of a sub-list."""
    own = F.rtrim(F.regexp_replace("norm", "[:：]+$", ""))
    end = ~F.col("in_table") & (T.label_leads(F.col("bare"), SECTION_LABELS) | (F.col("head") & ~own.isin(P.lower(VOCAB["slo_sublabels"]))))
    rows = roles(t).withColumn("open", ~F.col("in_table") & ~F.col("in_toc") & T.label_leads(F.col("bare"), SECTIONS["slos"]))
    behind = Window.partitionBy("rel").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("stop", F.first(F.when(end, F.col("idx")), ignorenulls=True).over(behind)).where("open").select("rel", F.col("idx").alias("start"), "stop")


def outcomes(t: Tables) -> DataFrame:
    """The statements of the outcome sections: lines without lead-ins and labels, up to the first instruction of a block."""
    head = F.left("norm", F.lit(40))
    ends = VOCAB["slo_block_end_labels"]
    stop = T.begins_with_any(head, ends) | (T.contains_any(head, ends) & F.left(F.trim("text"), F.lit(45)).contains(":"))
    lead = T.begins_with_any(head, VOCAB["slo_lead_ins"])
    label = F.trim("text").rlike("[:：]$") | F.rtrim(F.regexp_replace("norm", "[:：]+$", "")).isin(P.lower(VOCAB["slo_sublabels"]))
    rows = _lines(t).join(outcome_blocks(t), "rel").where((F.col("idx") > F.col("start")) & (F.col("stop").isNull() | (F.col("idx") < F.col("stop"))) & ~F.col("in_table"))
    rows = rows.where(~label).withColumn("lead", lead)
    block = Window.partitionBy("rel", "start").orderBy("idx")
    rows = rows.withColumn("ended", F.max(F.when(stop & ~F.col("lead"), 1).otherwise(0)).over(block)).where("ended = 0")
    first = F.min(F.when(~F.col("lead"), F.struct("start", "idx"))).over(Window.partitionBy("rel"))
    return rows.withColumn("first", first).where(~F.col("lead") | (F.struct("start", "idx") > F.col("first"))).drop("lead", "ended", "first")


@rule("LP5", "paras")
def outcome_bullets(t: Tables) -> DataFrame:
    numbered = (F.col("list_kind") == "decimal") | F.col("west").rlike(r"^\s*[0-9]+[.)]\s")
    good = ~F.coalesce(numbered, F.lit(False)) & (F.coalesce(F.col("list_kind") == "bullet", F.lit(False)) | T.bullet_text(F.col("text")))
    rows = _every(t, outcomes(t).groupBy("rel").agg(F.bool_and(good).alias("good")))
    return _emit("LP5", rows, F.when(F.col("good").isNull(), "needs_review").when(F.col("good"), "pass").otherwise("fail"), "outcomes as bullets")


@rule("LPG1", "paras")
def warm_up_questions(t: Tables) -> DataFrame:
    labelled = r"^\s*[•\-–—*]?\s*(?:" + "|".join(P.lower(VOCAB["question_prefixes"])) + r")\s*[0-9]"
    rows = section_lines(t, "warm_up").groupBy("rel").agg(F.count_if(F.col("text").rlike("[?؟]") | F.col("west").rlike(labelled)).alias("n"))
    return _emit("LPG1", _every(t, rows), F.when(F.coalesce("n", F.lit(0)) == 0, "needs_review").when(F.col("n") > 3, "fail").otherwise("pass"), "one to three warm-up questions")


@rule("LPG2", "paras")
def takeaway_bullets(t: Tables) -> DataFrame:
    found = sections(t["paras"]).where("section = 'key_takeaways'").select("rel")
    bullet = F.coalesce(F.col("list_kind") == "bullet", F.lit(False)) | T.bullet_text(F.col("text"))
    numbered = F.coalesce(F.col("list_kind") == "decimal", F.lit(False)) | T.numbered_text(F.col("norm"))
    items = section_lines(t, "key_takeaways").where("not in_table").groupBy("rel").agg(F.count_if(bullet).alias("b"), F.count_if(numbered).alias("n"))
    rows = _every(t, found.join(items, "rel", "left").withColumn("has", F.lit(True)))
    verdict = F.when(F.col("has").isNull(), "needs_review").when((F.coalesce("n", F.lit(0)) > 0) | (F.coalesce("b", F.lit(0)) == 0), "fail").otherwise("pass")
    return _emit("LPG2", rows, verdict, "takeaways as bullets")


@rule("LPG3", "paras")
def coverage_table(t: Tables) -> DataFrame:
    rows = _paras(t)
    heads = rows.where("in_table and row_idx = 0").groupBy("rel", "table_idx").agg(F.array_join(F.collect_list("norm"), " ").alias("h"))
    n = reduce(lambda a, b: a + b, [F.col("h").contains(x).cast("int") for x in P.lower(VOCAB["coverage_headers"])])
    tables = heads.groupBy("rel").agg(F.max(n).alias("n"))
    title = rows.groupBy("rel").agg(F.bool_or(T.contains_any(F.col("norm"), P.lower(VOCAB["coverage_titles"]))).alias("title"))
    found = F.coalesce("n", F.lit(0)) >= 2
    return _emit("LPG3", title.join(tables, "rel", "left"), F.when(found, "pass").when(F.col("title"), "needs_review").otherwise("fail"), "a coverage table", found)


@rule("LPG4", "paras")
def glossary(t: Tables) -> DataFrame:
    hit = (F.length("text") < 60) & T.begins_with_any(F.col("norm"), VOCAB["glossary_labels"])
    return _emit("LPG4", _paras(t).groupBy("rel").agg(F.bool_or(hit).alias("g")), F.when(F.col("g"), "pass").otherwise("needs_review"), "a glossary")


@rule("WEG1", "paras")
def space_after(t: Tables) -> DataFrame:
    off = F.col("space_after").isNull() | (F.abs(F.col("space_after") - HOUSE["paragraph_space_after_pt"]) > 0.5)
    rows = _every(t, t["paras"].where((F.trim("text") != "") & ~F.col("in_table")).groupBy("rel").agg(_share(off, F.lit(1)).alias("off")))
    return _emit("WEG1", rows, F.when(F.col("off").isNull(), "na").when(F.col("off") > TOLERANCE, "fail").otherwise("pass"), "8 points after each paragraph")


@rule("WEG2", "paras")
def no_numbered_lists(t: Tables) -> DataFrame:
    rows = roles(t).groupBy("rel").agg(F.count_if(~F.col("in_table") & ~F.col("head") & F.coalesce(F.col("list_kind") == "decimal", F.lit(False))).alias("n"))
    return _emit("WEG2", _every(t, rows), F.when(F.coalesce("n", F.lit(0)) > 0, "fail").otherwise("pass"), "bullets, not numbers, inside sections")


@rule("ASG1", "paras")
def all_or_none(t: Tables) -> DataFrame:
    rows = _paras(t).groupBy("rel").agg(F.count_if(T.contains_any(F.col("norm"), P.lower(VOCAB["all_or_none"]))).alias("n"))
    return _emit("ASG1", rows, F.when(F.col("n") > 0, "fail").otherwise("pass"), "no 'all of the above'")


# slides


def _slides(t: Tables) -> DataFrame:
    norm = lambda c: F.lower(T.fold(c))
    rows = t["slides"].withColumn("notes", F.coalesce("notes", F.lit(""))).withColumn("name", norm(F.coalesce("title", F.lit("")))).withColumn("said", norm(F.array_join("texts", " ")))
    return rows.withColumn("own", F.transform("texts", norm))


def note_text(labels: list[str] | None = None) -> Column:
    """Speaker notes and on-slide texts that begin as a facilitator's note."""
    words = P.lower(labels or [*VOCAB["facilitator_note_labels"], "سہولت کار کے لیے نوٹ", "تدریسی ہدایت"])
    return F.trim(F.lower(F.concat_ws(" ", T.fold(F.col("notes")), F.array_join(F.filter("own", lambda x: T.contains_any(F.left(x, F.lit(80)), words)), " "))))


@rule("FGG1", "slides")
def notes_everywhere(t: Tables) -> DataFrame:
    rows = t["slides"].groupBy("rel").agg(F.count_if(F.trim(F.coalesce("notes", F.lit(""))) == "").alias("n"))
    return _emit("FGG1", rows, F.when(F.col("n") > 0, "fail").otherwise("pass"), "speaker notes on every slide")


@rule("FGG2", "slides")
def timed(t: Tables) -> DataFrame:
    """The notes of every slide state minutes; their sum is within a tenth of the duration that one of the first three slides states."""
    rows = _slides(t).withColumn("m", T.minutes_range(F.col("notes")))
    stated = F.when((F.col("slide") <= 3) & T.contains_any(F.col("said"), P.lower(VOCAB["duration_labels"])), T.minutes_range(F.col("said"))["hi"])
    got = rows.groupBy("rel").agg(F.count_if(F.col("m").isNull()).alias("none"), F.sum("m.lo").alias("lo"), F.sum("m.hi").alias("hi"), F.min(F.when(stated.isNotNull(), F.struct("slide", stated.alias("total"))))["total"].alias("total"))
    off = (F.col("total") > 0) & ~((F.col("lo") * 0.9 <= F.col("total")) & (F.col("total") <= F.col("hi") * 1.1))
    return _emit("FGG2", got, F.when((F.col("none") > 0) | F.coalesce(off, F.lit(False)), "fail").otherwise("pass"), "every slide timed, the sum near the plan")


@rule("FGG3", "slides")
def cover_duration(t: Tables) -> DataFrame:
    cover = T.minutes_range(F.concat_ws(" ", F.col("said"), F.col("notes"))).isNotNull()
    w = Window.partitionBy("rel")
    rows = _slides(t).withColumn("first", F.min("slide").over(w)).where("slide = first").groupBy("rel").agg(F.bool_or(cover).alias("c"))
    return _emit("FGG3", rows, F.when(F.col("c"), "pass").otherwise("fail"), "the cover states the duration", F.col("c"))


@rule("FG4", "slides")
def concept_notes(t: Tables) -> DataFrame:
    """Slides on concepts have notes, which mention five kinds of help."""
    rows = _slides(t).where(T.contains_any(F.col("name"), P.lower(SECTIONS["concept_building"]))).withColumn("n", note_text())
    groups = reduce(lambda a, b: a + b, [T.contains_any(F.col("n"), P.lower(words)).cast("int") for words in VOCAB["note_items"].values()])
    got = _every(t, rows.groupBy("rel").agg(F.count_if(F.col("n") == "").alias("bare"), F.count_if(groups < len(VOCAB["note_items"])).alias("gaps")), "slides")
    verdict = F.when(F.col("bare").isNull(), "needs_review").when(F.col("bare") > 0, "fail").when(F.col("gaps") > 0, "needs_review").otherwise("pass")
    return _emit("FG4", got, verdict, "notes on concept slides", (F.col("bare") == 0) & (F.col("gaps") == 0))


@rule("FG7", "slides")
def slide_order(t: Tables) -> DataFrame:
    """Slides follow the plan's sections; the outcomes may come early, but before the concepts."""
    labels = {k: v + VOCAB["fg_section_labels"].get(k, []) for k, v in SECTIONS.items()}
    role = F.coalesce(*[F.when(T.label_leads(F.col("bare"), words), k) for k, words in labels.items()])
    first = _slides(t).withColumn("bare", T.unlabelled(F.col("title"))).withColumn("role", role).where("role is not null").groupBy("rel").pivot("role", list(SECTIONS)).agg(F.min("slide"))
    every = _every(t, first, "slides")
    rest = [F.col(k) for k in SECTIONS if k != "slos"]
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in SECTIONS])
    rising = reduce(lambda a, b: a & b, [a <= b for a, b in zip(rest, rest[1:])])
    good = F.coalesce(there & rising & (F.col("slos") <= F.col("concept_building")), F.lit(False))
    return _emit("FG7", every, F.when(good, "pass").otherwise("fail"), "slides follow the plan's sections", good)


def _bare(text: Column) -> Column:
    return F.regexp_replace(T.fold(text), "^[ •\\-–—*]+|[ •\\-–—*]+$", "")


def slide_lines(t: Tables, notes: bool = True) -> DataFrame:
    """(rel, slide, place, line): the lines of texts and notes, without bullets."""
    texts = F.concat("texts", F.array(F.coalesce("notes", F.lit("")))) if notes else F.col("texts")
    return t["slides"].select("rel", "slide", F.explode(texts).alias("x")).select("rel", "slide", F.posexplode(F.split("x", "\n")).alias("place", "l")).select("rel", "slide", "place", _bare(F.col("l")).alias("line"))


def copied(t: Tables, links: DataFrame, shortest: int = 60, least: float = 0.9) -> DataFrame:
    """(rel, slide, ratio) of slide lines that repeat a paragraph of their plan (outcomes aside); ``links`` has (rel, plan)."""
    own = outcomes(t).select("rel", "idx")
    plan = _lines(t).where(F.length(F.trim("text")) >= shortest).join(own, ["rel", "idx"], "left_anti").select(F.struct(F.col("rel").alias("plan")).alias("b"), T.fold(F.col("text")).alias("y"))
    lines = slide_lines(t).where(F.length("line") >= shortest).select(F.struct("rel", "slide").alias("a"), F.col("line").alias("x"))
    hits = matching.similar_lines(lines, plan, least)
    return hits.select("a.rel", "a.slide", "b.plan", "ratio").join(links, ["rel", "plan"]).select("rel", "slide", "ratio")


def facilitator_part(t: Tables, links: DataFrame | None = None) -> DataFrame:
    """FG2: a facilitator's part on every slide behind the cover, and no paragraph of the plan copied."""
    labels = P.lower(VOCAB["facilitator_note_labels"])
    has = (F.trim("notes") != "") | F.exists("own", lambda x: T.contains_any(F.left(x, F.lit(60)), labels))
    w = Window.partitionBy("rel")
    rows = _slides(t).withColumn("first", F.min("slide").over(w)).where("slide > first").groupBy("rel").agg(F.count_if(~F.coalesce(has, F.lit(False))).alias("bare"))
    copies = copied(t, links).groupBy("rel").agg(F.count(F.lit(1)).alias("c")) if links is not None else rows.select("rel", F.lit(0).alias("c")).limit(0)
    got = _every(t, rows, "slides").join(copies, "rel", "left")
    c = F.coalesce("c", F.lit(0))
    return _emit("FG2", got, F.when(F.col("bare").isNull(), "na").when(c > 0, "fail").when(F.col("bare") > 0, "needs_review").otherwise("pass"), "a facilitator's part, nothing copied", (c == 0) & (F.col("bare") == 0))


rule("FG2", "slides")(facilitator_part)


def pasted_outcomes(t: Tables, links: DataFrame, least: float = 0.9, shortest: int = 25) -> DataFrame:
    """FG1: the overview slide pastes half of the plan's outcomes or more; where it doesn't there is no finding."""
    own = outcomes(t).select("rel", _bare(F.col("text")).alias("y"), F.length(F.trim("text")).alias("n")).where(F.col("n") >= shortest)
    counts = own.groupBy(F.col("rel").alias("plan")).agg(F.count(F.lit(1)).alias("k"))
    overview = _slides(t).where(T.contains_any(F.col("name"), P.lower(["SLO", "Learning Outcomes", "Session Overview", "حاصلات تعلیم", "سبق کے مقاصد", "سیشن کا خلاصہ"])))
    first = overview.groupBy("rel").agg(F.min("slide").alias("slide"))
    lines = slide_lines(t, False).where(F.length("line") >= shortest).join(first, ["rel", "slide"], "left_semi").select(F.struct("rel", "slide", "place").alias("a"), F.col("line").alias("x"))
    hits = matching.similar_lines(lines, own.select(F.struct(F.col("rel").alias("plan")).alias("b"), "y"), least)
    got = hits.select("a.rel", "a.slide", "a.place", "b.plan").distinct().join(links, ["rel", "plan"]).groupBy("rel", "plan").agg(F.count(F.lit(1)).alias("n")).join(counts, "plan")
    return _emit("FG1", got.where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("k") / 2))), F.lit("fail"), "outcomes pasted on the overview")


# storyboards


def storyboard(t: Tables) -> DataFrame:
    """(rel, table_idx, columns, rows): of each document the table with most rows among those whose header names three columns or more; rows as
    maps from column to text."""
    cells = t["cells"].withColumn("norm", F.lower(T.fold(F.col("text"))))
    names = F.array_compact(F.array(*[F.when(T.contains_any(F.col("norm"), P.lower(words)), F.lit(k)) for k, words in VOCAB["storyboard_columns"].items()]))
    heads = cells.where("row = 0").select("rel", "table_idx", "col", F.explode(names).alias("name")).groupBy("rel", "table_idx", "name").agg(F.min("col").alias("col"))
    good = heads.groupBy("rel", "table_idx").agg(F.count(F.lit(1)).alias("n"), F.collect_set("name").alias("columns")).where("n >= 3")
    filled = cells.where("row > 0 and trim(text) <> ''").groupBy("rel", "table_idx").agg(F.countDistinct("row").alias("rows"))
    best = good.join(filled, ["rel", "table_idx"], "left").groupBy("rel").agg(F.max_by(F.struct("table_idx", "columns"), F.struct(F.coalesce("rows", F.lit(0)), -F.col("table_idx"))).alias("b")).select("rel", "b.*")
    body = cells.where("row > 0 and trim(text) <> ''").join(heads, ["rel", "table_idx", "col"]).select("rel", "table_idx", "row", "name", F.trim("text").alias("text"))
    return best.join(body, ["rel", "table_idx"], "left")


def _storyboard(code: str, t: Tables, name: str, measure: Callable[[Column], Column], verdict: Column, message: str) -> DataFrame:
    rows = storyboard(t).where(F.array_contains("columns", name)).groupBy("rel").agg(measure(F.when(F.col("name") == name, F.col("text"))).alias("m"))
    return _emit(code, rows, verdict, message)


@rule("SB1", "cells")
def storyboard_columns(t: Tables) -> DataFrame:
    rows = _every(t, storyboard(t).groupBy("rel").agg(F.first(F.size("columns")).alias("n")), "cells")
    return _emit("SB1", rows, F.when(F.coalesce("n", F.lit(0)) == len(VOCAB["storyboard_columns"]), "pass").otherwise("fail"), "scene, duration, text, narration and visual columns")


@rule("SB2", "cells")
def storyboard_length(t: Tables, most: int = 120) -> DataFrame:
    def total(x: Column) -> Column:
        span = T.seconds_span(x)
        return F.coalesce(F.max(F.when(span["is_end"], span["secs"])), F.sum(F.when(~span["is_end"], span["secs"])))

    return _storyboard("SB2", t, "duration", total, F.when(F.col("m").isNull(), "needs_review").when(F.col("m") > most, "fail").otherwise("pass"), "two minutes at most")


def _words(x: Column) -> Column:
    return F.when(x.isNotNull(), F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))


@rule("SB3", "cells")
def storyboard_narration(t: Tables, most: int = 300) -> DataFrame:
    return _storyboard("SB3", t, "narration", lambda x: F.coalesce(F.sum(_words(x)), F.lit(0)), F.when(F.col("m") > most, "fail").otherwise("pass"), "300 words of narration at most")


@rule("SB5", "cells")
def storyboard_labels(t: Tables, most: int = 12) -> DataFrame:
    return _storyboard("SB5", t, "on_screen", lambda x: F.count_if(_words(x) > most), F.when(F.col("m") > 0, "fail").otherwise("pass"), "short labels on screen")


@rule("SB4", "paras")
def storyboard_origin(t: Tables) -> DataFrame:
    top = _paras(t).withColumn("k", F.row_number().over(Window.partitionBy("rel").orderBy("idx"))).where("k <= 12")
    hit = T.contains_any(F.col("norm"), P.lower(VOCAB["storyboard_origin"])) | F.col("norm").rlike(r"(^|[^a-z])new([^a-z]|$)")
    return _emit("SB4", top.groupBy("rel").agg(F.bool_or(hit).alias("h")), F.when(F.col("h"), "pass").otherwise("fail"), "new, or edited from a source")


# derived


# What a rule on a whole document is made of.
DERIVED = {"LP10": ["WE1", "WE2", "WE3", "WE4", "WE6", "WE7", "WE8"], "FG8": ["WE5", "WE6", "WE7", "WE23"]}
HUMAN = ("WE24", "FG5")


def derived(findings: DataFrame) -> DataFrame:
    """LP10 and FG8 from the findings of their parts, for documents that have any."""
    return reduce(DataFrame.unionByName, [status.derived(findings, code, parts) for code, parts in DERIVED.items()])


def both_languages(t: Tables) -> DataFrame:
    """WE9 over a whole package: undecided (null) unless both languages occur."""
    langs = t["docs"].where(F.col("lang").isNotNull()).agg(F.countDistinct("lang").alias("n"))
    return langs.select(F.lit("WE9").alias("code"), F.when(F.col("n") >= 2, "needs_review").alias("status"))
