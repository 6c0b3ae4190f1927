"""Questions, quizzes, exams, question banks and the coverage of learning outcomes.

Questions are islands of lines: start marks, one windowed pass each, blocks by aggregation. Findings have the shape of ``rules``; rules on lessons
and chapters put their key in ``doc``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektor.functions import profile as P
from lektor.functions import text as T
from lektor.operators import matching, rules, segments, status

PROFILE, VOCAB = P.PROFILE, P.PROFILE["vocab"]
# Option letters and check marks.
LETTER = "(?:الف|ب|ج|د|[A-Da-d])"
CHECKS = "[✅✔☑]"
OPTION = rf"^\s*{CHECKS}?\s*\(?{LETTER}\s*[).]"
INLINE_OPTION = rf"(?:^|\s){CHECKS}?\s*\(?{LETTER}\s*\)"
BRACKETED, SHORT = r"^\s*\(([0-9]{1,3})\)\s*\S", r"^\s*q\.?\s*([0-9]{1,3})(?![0-9])\s*\S"


def _yellow() -> Column:
    lit = F.exists("runs", lambda r: F.lower(F.coalesce(r["highlight"], F.lit(""))) == "yellow")
    return F.coalesce(lit, F.lit(False)) | F.coalesce(T.is_yellow(F.col("shading")), F.lit(False))


def starts(paras: DataFrame, profile: dict = PROFILE) -> DataFrame:
    """Non-blank lines with ``num`` (a question starts), ``stop`` (something else that ends the question before) and ``live`` (before the end of the
    questions). Typed labels and numbers count, those without a label only behind the first labelled one; where nothing is typed, automatic
    list numbers do."""
    rows = rules._lines({"paras": paras})
    west, table = F.col("west"), F.col("in_table")
    option = F.col("norm").rlike(OPTION)
    take = lambda pattern: F.nullif(F.regexp_extract("west", pattern, 1), F.lit(""))
    labelled = F.coalesce(take(P.question_pattern(profile, True)), F.when(table, take(P.cell_question_pattern(profile))))
    plain = F.when(~table, F.coalesce(take(P.question_pattern(profile)), take(BRACKETED), take(SHORT)))
    learned = [take("(?i)" + p) for p in P.extra_patterns(profile)]
    lesson = ~table & west.rlike(P.lesson_pattern(profile)) & ~option
    stop = lesson | (~table & F.coalesce(F.col("heading_level") == 1, F.lit(False)))
    number = F.when(~stop & ~option, T.question_number(F.coalesce(labelled, plain, *learned)))
    rows = rows.withColumn("stop", stop).withColumn("typed", number).withColumn("labelled", F.col("typed").isNotNull() & labelled.isNotNull())
    w = Window.partitionBy("rel").orderBy("idx")
    whole = Window.partitionBy("rel")
    rows = rows.withColumn("first_q", F.min(F.when(F.col("typed").isNotNull(), F.col("idx"))).over(whole)).withColumn("first_label", F.min(F.when(F.col("labelled"), F.col("idx"))).over(whole))
    ends = T.begins_with_any(F.col("norm"), profile["vocab"]["question_region_end_labels"])
    closing = ~table & (F.length("west") <= 90) & ends & (F.col("idx") > F.col("first_q"))
    rows = rows.withColumn("end", F.min(F.when(closing, F.col("idx"))).over(whole)).withColumn("live", F.col("end").isNull() | (F.col("idx") < F.col("end")))
    kept = F.when(F.col("live") & (F.col("first_label").isNull() | F.col("labelled") | (F.col("idx") > F.col("first_label"))), F.col("typed"))
    auto = F.when(~table & (F.col("list_kind") == "decimal"), F.regexp_extract(T.western_digits(F.col("num_label")), r"^\s*([0-9]+)", 1).try_cast("int"))
    rows = rows.withColumn("kept", kept).withColumn("any", F.max(F.col("kept").isNotNull().cast("int")).over(whole))
    return rows.withColumn("num", F.when(F.col("any") == 1, F.col("kept")).otherwise(F.when(F.col("live"), auto))).withColumn("stop", F.col("stop") & F.col("live") & F.col("num").isNull())


def kind(block: Column, options: Column) -> Column:
    low = F.lower(T.fold(block))
    return (
        F.when(options >= 3, "mcq")
        .when(low.rlike(r"درست\s*(?:یا|/)\s*غلط|true\s*/?\s*(?:or)?\s*false"), "true_false")
        .when(block.contains("____") | low.contains("خالی جگہ") | low.contains("fill in"), "fill_blank")
        .when(low.contains("جوڑ") | low.contains("match"), "matching")
        .otherwise("open")
    )


def questions(paras: DataFrame, profile: dict = PROFILE) -> DataFrame:
    """(rel, num, start, text, block, options, kind, highlighted, checked): numbered questions, each up to the next start or stop."""
    rows = starts(paras, profile)
    rows = segments.islands(rows.where("live"), ["rel"], ["idx"], F.col("num").isNotNull() | F.col("stop"), "island").where("island > 0")
    own = Window.partitionBy("rel", "island")
    rows = rows.withColumn("start", F.min("idx").over(own)).withColumn("q", F.max(F.when(F.col("idx") == F.col("start"), F.col("num"))).over(own)).where("q is not null")
    option = (F.col("idx") > F.col("start")) & ~F.col("in_table") & F.trim("text").rlike(OPTION)
    got = rows.groupBy("rel", "start", F.col("q").alias("num")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("lines"), F.count_if(option).alias("listed"), F.bool_or(option & _yellow()).alias("lit"), F.bool_or(_yellow()).alias("any_lit"),
    )
    block = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    got = got.withColumn("block", block).withColumn("text", F.trim(F.element_at("lines", 1)["text"]))
    got = got.withColumn("inline", F.when(F.col("listed") == 0, F.regexp_count("block", F.lit(INLINE_OPTION))).otherwise(0))
    options = F.when(F.col("listed") > 0, F.col("listed")).otherwise(F.col("inline")).cast("int")
    return got.select("rel", "num", "start", "text", "block", options.alias("options"), kind(F.col("block"), options).alias("kind"), (F.col("lit") | ((F.col("inline") >= 3) & F.col("any_lit"))).alias("highlighted"), F.col("block").rlike(CHECKS).alias("checked"))


def regular(found: DataFrame) -> DataFrame:
    """(rel, n, regular): whether questions are numbered 1 to n."""
    rows = found.withColumn("k", F.row_number().over(Window.partitionBy("rel").orderBy("start")))
    return rows.groupBy("rel").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("k") == F.col("num")).alias("regular"))


def level(text: Column, block: Column) -> Column:
    """higher or lower by the words in a question's first line or its order level; null where neither or both are found."""
    head = F.lower(T.fold(F.concat_ws(" ", F.element_at(F.split(text, "\n"), 1), F.array_join(F.regexp_extract_all(block, F.lit(r"(?i)((?:order level|آرڈر لیول)[^\n]*)"), F.lit(1)), " "))))
    hi, lo = (T.contains_any(head, P.lower(VOCAB[k])) for k in ("higher_order_words", "lower_order_words"))
    return F.when(hi & ~lo, "higher").when(lo & ~hi, "lower")


def _docs(t: dict, doc_type: str | None = None) -> DataFrame:
    every = t["paras"].select("rel").distinct()
    return every.join(t["docs"].where(F.col("doc_type") == doc_type).select("rel"), "rel", "left_semi") if doc_type and "docs" in t else every


def counted(t: dict, code: str, lo: int, hi: int, higher: float, doc_type: str | None = None, found: DataFrame | None = None) -> DataFrame:
    """Number of questions within bounds, and the share of higher-order ones near what is asked where half of them state a level; none, or
    irregular numbers, need a review; a pass is always partial."""
    found = questions(t["paras"]) if found is None else found
    levels = found.withColumn("l", level(F.col("text"), F.col("block"))).groupBy("rel").agg(F.count("l").alias("known"), F.avg(F.when(F.col("l") == "higher", 1.0).when(F.col("l") == "lower", 0.0)).alias("share"))
    rows = _docs(t, doc_type).join(regular(found), "rel", "left").join(levels, "rel", "left")
    n = F.coalesce("n", F.lit(0))
    off = (F.col("known") >= F.greatest(F.lit(2.0), n / 2)) & (F.abs(F.col("share") - higher) > 0.2)
    verdict = F.when((n == 0) | ~F.col("regular"), "needs_review").when(~n.between(lo, hi) | F.coalesce(off, F.lit(False)), "fail").otherwise("pass")
    return rules._emit(code, rows, verdict, f"{lo} to {hi} questions", verdict == "pass")


def exam_count(t: dict, found: DataFrame | None = None) -> DataFrame:
    return counted(t, "CE1", 6, 8, 0.3, "chapter_exam", found)


def worksheet_count(t: dict, found: DataFrame | None = None) -> DataFrame:
    return counted(t, "WS1", 8, 10, 0.6, "worksheet", found)


def tag(text: Column) -> Column:
    """Whether the text as written carries an outcome's mark."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in VOCAB["slo_tag_patterns"]])


def tagged(t: dict, code: str = "CE4", doc_type: str | None = "chapter_exam", found: DataFrame | None = None) -> DataFrame:
    found = questions(t["paras"]) if found is None else found
    some = t["paras"].groupBy("rel").agg(F.bool_or(tag(F.col("text"))).alias("some"))
    bare = found.groupBy("rel").agg(F.count_if(~tag(F.col("block"))).alias("bare"))
    rows = _docs(t, doc_type).join(some, "rel", "left").join(bare, "rel", "left").join(regular(found), "rel", "left")
    verdict = F.when(~F.coalesce("some", F.lit(False)), "fail").when(~F.coalesce("regular", F.lit(False)), "needs_review").when(F.col("bare") > 0, "fail").otherwise("pass")
    return rules._emit(code, rows, verdict, "every question tagged")


def answer_key(t: dict, doc_type: str | None = "chapter_exam", found: DataFrame | None = None) -> DataFrame:
    """CE5: a key, or answers under questions, is a partial pass; it may be left out."""
    found = questions(t["paras"]) if found is None else found
    labels = [x for x in P.lower(VOCAB["answer_key_labels"] + VOCAB["answer_line_labels"]) if len(x) > 3]
    key = rules._paras(t).groupBy("rel").agg(F.bool_or(~F.col("in_table") & (F.length(F.trim("text")) <= 40) & T.contains_any(F.col("norm"), P.lower(VOCAB["answer_key_labels"]))).alias("key"))
    under = found.groupBy("rel").agg(F.bool_or(T.contains_any(F.lower(T.fold(F.col("block"))), labels)).alias("under"))
    rows = _docs(t, doc_type).join(key, "rel", "left").join(under, "rel", "left")
    good = F.coalesce("key", F.lit(False)) | F.coalesce("under", F.lit(False))
    return rules._emit("CE5", rows, F.when(good, "pass").otherwise("na"), "an answer key", good)


def formats(t: dict, doc_type: str | None = "worksheet", found: DataFrame | None = None) -> DataFrame:
    """WS2: the mix of formats, for a reviewer."""
    found = questions(t["paras"]) if found is None else found
    mix = found.groupBy("rel", F.col("kind").alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("rel").agg(F.collect_list(F.struct("k", "n")).alias("c"))
    rows = _docs(t, doc_type).join(mix, "rel", "left")
    return rows.select(*status.finding("WS2", F.col("rel"), F.lit("needs_review"), F.concat(F.lit("formats: "), F.coalesce(T.top_counts(F.col("c"), 6), F.lit("")))))


def key_at_end(t: dict, doc_type: str | None = "worksheet", found: DataFrame | None = None) -> DataFrame:
    """WS6: the last answer key stands behind the last question's start."""
    found = questions(t["paras"]) if found is None else found
    hit = ~F.col("in_table") & F.length(F.trim("text")).between(1, 40) & T.contains_any(F.col("norm"), P.lower(VOCAB["answer_key_labels"]))
    keys = rules._paras(t).where(hit).groupBy("rel").agg(F.max("idx").alias("key"))
    last = found.groupBy("rel").agg(F.max("start").alias("last"))
    rows = _docs(t, doc_type).join(keys, "rel", "left").join(last, "rel", "left")
    good = F.coalesce(F.col("key") >= F.coalesce("last", F.lit(0)), F.lit(False))
    return rules._emit("WS6", rows, F.when(good, "pass").otherwise("fail"), "the answer key at the end", good)


# quizzes and banks


def quiz(lessons: DataFrame, found: DataFrame) -> DataFrame:
    """PQ1 to PQ4 of every lesson (column doc), from questions (doc, kind, block, highlighted): two or three multiple-choice questions, each with its place in the plan,
    feedback, and its answer marked yellow."""
    low = F.lower(T.fold(F.col("block")))
    has = lambda labels: F.bool_and(T.contains_any(low, P.lower(VOCAB[labels])))
    got = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("kind") == "mcq").alias("mcq"), has("lesson_plan_location_labels").alias("place"), has("feedback_labels").alias("feedback"), F.bool_and("highlighted").alias("yellow"))
    rows = lessons.join(got, "doc", "left").withColumn("rel", F.col("doc"))
    n = F.coalesce("n", F.lit(0))
    each = lambda code, good, message, partial: rules._emit(code, rows, F.when(n == 0, "na").when(good, "pass").otherwise("fail"), message, (n > 0) & good if partial else False)
    first = rules._emit("PQ1", rows, F.when((n > 0) & n.between(2, 3) & F.col("mcq"), "pass").otherwise("fail"), "2 to 3 multiple-choice questions")
    return first.unionByName(each("PQ2", F.col("place"), "the place in the plan", True)).unionByName(each("PQ3", F.col("feedback"), "feedback", True)).unionByName(each("PQ4", F.col("yellow"), "the answer in yellow", False))


def bank_items(cells: DataFrame, profile: dict = PROFILE) -> DataFrame:
    """(rel, place, fields, raw, highlighted, chapter, lesson): items of a question bank, from table cells (rel, table_idx, row, col, text, highlighted).

    Tables whose first row names three known fields or more, the question among them, hold an item a row; where a document has none, each table whose
    first column names fields is one item.
    """
    names = {name.lower(): field for field, words in profile["vocab"]["data_bank_fields"].items() for name in words}
    known = cells.withColumn("field", F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(T.fold(F.col("text")))))
    heads = known.where("row = 0").groupBy("rel", "table_idx").agg(F.count(F.lit(1)).alias("cols"), F.count("field").alias("n"), F.bool_or(F.col("field") == "question").alias("q")).where("cols >= 4 and n >= 3 and q").select("rel", "table_idx")
    columns = known.where("row = 0 and field is not null").select("rel", "table_idx", "col", "field").join(heads, ["rel", "table_idx"])
    lit = lambda: F.coalesce(F.col("field").isin("options", "answer") & F.col("highlighted"), F.lit(False))
    pack = lambda rows, *keys: rows.groupBy("rel", *keys).agg(F.map_from_entries(F.collect_list(F.struct("field", "text"))).alias("fields"), F.bool_or(lit()).alias("highlighted"))
    body = cells.where("row > 0").join(columns, ["rel", "table_idx", "col"]).withColumn("text", F.trim("text")).dropDuplicates(["rel", "table_idx", "row", "field"])
    wide = pack(body, "table_idx", "row").where(F.coalesce(F.try_element_at("fields", F.lit("question")), F.lit("")) != "").withColumn("place", F.col("table_idx") * 1000 + F.col("row")).drop("table_idx", "row")
    keys = known.where("col = 0 and field is not null").select("rel", "table_idx", "row", "field")
    long = cells.where("col = 1").join(keys, ["rel", "table_idx", "row"]).join(wide.select("rel").distinct(), "rel", "left_anti").withColumn("text", F.trim("text"))
    last = long.withColumn("r", F.row_number().over(Window.partitionBy("rel", "table_idx", "field").orderBy(F.col("row").desc()))).where("r = 1")
    items = wide.select("rel", "place", "fields", "highlighted").unionByName(pack(last, "table_idx").withColumnRenamed("table_idx", "place").select("rel", "place", "fields", "highlighted"))
    get = lambda k: F.try_element_at("fields", F.lit(k))
    both = F.split(get("chapter_lesson"), r"\s*/\s*|\n")
    number = lambda c, pattern: F.regexp_extract(T.western_digits(T.fold(c)), pattern, 1).try_cast("int")
    ordinals = profile["vocab"]["chapter_ordinals"]
    chapter = F.when(F.coalesce(get("chapter_lesson"), F.lit("")) != "", T.chapter_number(F.element_at(both, 1), ordinals)).otherwise(F.coalesce(T.chapter_number(F.concat(F.lit("chapter "), get("chapter")), ordinals), T.chapter_number(get("chapter"), ordinals)))
    lesson = F.when(F.coalesce(get("chapter_lesson"), F.lit("")) != "", number(F.try_element_at(both, F.lit(2)), r"^\s*([0-9]+)")).otherwise(number(get("lesson"), "([0-9]+)"))
    return items.withColumn("chapter", chapter).withColumn("lesson", lesson)


def bank_groups(items: DataFrame) -> DataFrame:
    """Items with ``grp``: runs of the same chapter and lesson, numbered within the chapter in document order."""
    w = Window.partitionBy("rel").orderBy("place")
    moved = ~(F.lag("chapter").over(w).eqNullSafe(F.col("chapter")) & F.lag("lesson").over(w).eqNullSafe(F.col("lesson"))) | (F.row_number().over(w) == 1)
    rows = items.withColumn("run", F.sum(F.coalesce(moved, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("grp", F.dense_rank().over(Window.partitionBy("rel", "chapter").orderBy("run"))).drop("run")


def bank(lessons: DataFrame, items: DataFrame) -> DataFrame:
    """DB1 to DB4 of every lesson (doc, chapter, place within the chapter), from items with their group. Where a chapter has as many lessons as the bank has groups
    they are paired in order; else a reviewer looks."""
    counts = lessons.groupBy("chapter").agg(F.count(F.lit(1)).alias("want")).join(items.groupBy("chapter").agg(F.max("grp").alias("have")), "chapter", "left")
    get = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    present = lambda k: F.array_contains(F.map_keys("fields"), k)
    one_of = lambda value, words: F.lower(T.fold(value)).isin(P.lower(words))
    measures = items.groupBy("chapter", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(one_of(get("question_type"), VOCAB["mcq_types"])).alias("mcq"), F.bool_and(one_of(get("level"), VOCAB["lower_order_levels"])).alias("low"),
        F.bool_and(present("subject") & present("slo") & (present("chapter_lesson") | (present("chapter") & present("lesson")))).alias("tags"),
        F.bool_and((get("feedback_correct") != "") & (get("feedback_incorrect") != "")).alias("feedback"), F.bool_and("highlighted").alias("yellow"),
    )
    rows = lessons.join(counts, "chapter", "left").join(measures.withColumnRenamed("grp", "place"), ["chapter", "place"], "left").withColumn("rel", F.col("doc"))
    odd = F.col("have").isNotNull() & (F.col("have") != F.col("want"))
    n = F.when(F.col("have") == F.col("want"), F.col("n"))
    first = rules._emit("DB1", rows, F.when(odd, "needs_review").when(F.coalesce(n, F.lit(0)).between(4, 6) & F.col("mcq") & F.col("low"), "pass").otherwise("fail"), "4 to 6 lower-order multiple-choice items")
    each = lambda code, good, message, partial: rules._emit(code, rows, F.when(odd, "needs_review").when(n.isNull(), "na").when(good, "pass").otherwise("fail"), message, ~odd & n.isNotNull() & good if partial else False)
    return first.unionByName(each("DB2", F.col("tags"), "subject, chapter, lesson and outcome tags", False)).unionByName(each("DB3", F.col("feedback"), "feedback", True)).unionByName(each("DB4", F.col("yellow"), "the answer in yellow", False))


def near_copies(items: DataFrame, asked: DataFrame, least: float = PROFILE["thresholds"]["duplicate_similarity"]) -> DataFrame:
    """DB5: bank items (doc, item, question) that nearly repeat a quiz question (question); no hit still needs a review."""
    folded = lambda c: T.fold(F.col(c))
    left = items.where(folded("question") != "").select(F.struct("doc", "item").alias("a"), folded("question").alias("x"))
    right = asked.select(folded("question").alias("y")).distinct().select(F.struct(F.md5("y").alias("m")).alias("b"), "y")
    hits = matching.similar_lines(left, right, least).select("a.doc", "a.item").distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    rows = items.select("doc").distinct().join(hits, "doc", "left").withColumn("rel", F.col("doc"))
    return rules._emit("DB5", rows, F.when(F.col("n") > 0, "fail").otherwise("needs_review"), "no item near a quiz question")


def bank_order(items: DataFrame) -> DataFrame:
    """DBS1: items (rel, place, chapter, lesson) in the order of chapters and lessons."""
    w = Window.partitionBy("rel").orderBy("place")
    key = F.struct("chapter", F.coalesce("lesson", F.lit(0)).alias("lesson"))
    rows = items.where("chapter is not null").withColumn("k", key).withColumn("fell", F.coalesce(F.col("k") < F.lag("k").over(w), F.lit(False)))
    got = items.select("rel").distinct().join(rows.groupBy("rel").agg(F.bool_or("fell").alias("fell")), "rel", "left")
    good = ~F.coalesce("fell", F.lit(False))
    return rules._emit("DBS1", got, F.when(good, "pass").otherwise("fail"), "items in order of chapter and lesson", good)


# learning outcomes


def specified(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(chapter, lesson, name, index, text, bloom): outcomes of a specification, from table cells (rel, table_idx, row, col, text, place) and lines (rel, idx, text).

    A table belongs to the last ``Chapter N`` line above it; its header names the lesson number and the outcomes; an empty number goes on with the one above; outcomes
    are numbered within their lesson.
    """
    norm = F.lower(T.fold(F.col("text")))
    head = F.when(norm.startswith("lesson #") | (norm == "lesson no"), "no").when(norm == "lesson", "name").when(norm.startswith("slo"), "slo").when(norm.startswith("bloom"), "bloom").when(norm.contains("coverage"), "cov")
    columns = cells.where("row = 0").withColumn("name", head).where("name is not null").select("rel", "table_idx", "col", "name")
    good = columns.groupBy("rel", "table_idx").agg(F.collect_set("name").alias("s")).where(F.array_contains("s", "slo") & F.array_contains("s", "no")).select("rel", "table_idx")
    marks = lines.select("rel", F.col("idx").alias("place"), F.regexp_extract(T.western_digits(F.lower(T.fold(F.col("text")))), r"^\s*chapter\s*([0-9]+)", 1).try_cast("int").alias("chapter"), F.lit(None).cast("int").alias("table_idx")).where("chapter is not null")
    tables = cells.groupBy("rel", "table_idx").agg(F.min("place").alias("place")).join(good, ["rel", "table_idx"]).select("rel", "place", F.lit(None).cast("int").alias("chapter"), "table_idx")
    above = Window.partitionBy("rel").orderBy("place", F.col("table_idx").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    chapters = marks.unionByName(tables).withColumn("chapter", F.last("chapter", ignorenulls=True).over(above)).where("table_idx is not null and chapter is not null").select("rel", "table_idx", "chapter")
    wide = cells.where("row > 0").join(columns, ["rel", "table_idx", "col"]).groupBy("rel", "table_idx", "row").pivot("name", ["no", "name", "slo", "bloom", "cov"]).agg(F.first(F.trim("text")))
    rows = wide.join(chapters, ["rel", "table_idx"]).where((F.coalesce("slo", F.lit("")) != "") & ~F.lower(T.fold(F.col("slo"))).startswith("slo"))
    w = Window.partitionBy("rel", "table_idx").orderBy("row")
    own = F.regexp_extract(T.western_digits(F.col("no")), r"^\s*([0-9]+)", 1).try_cast("int")
    rows = rows.withColumn("lesson", F.last(own, ignorenulls=True).over(w)).withColumn("title", F.coalesce(F.last(F.nullif(F.col("name"), F.lit("")), ignorenulls=True).over(w), F.lit(""))).where("lesson is not null")
    index = F.row_number().over(Window.partitionBy("rel", "chapter", "lesson").orderBy("table_idx", "row"))
    return rows.select("rel", "chapter", "lesson", F.col("title").alias("name"), index.alias("index"), F.col("slo").alias("text"), F.coalesce("bloom", F.lit("")).alias("bloom"))


def planned(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """As ``specified``, where a reading names the columns: plan (rel, table_idx, chapter, no, name, slo, bloom as column numbers). A cell may hold an outcome a line."""
    rows = cells.join(plan, ["rel", "table_idx"]).groupBy("rel", "table_idx", "chapter", "row").agg(*[F.max(F.when(F.col("col") == F.col(k), F.trim("text"))).alias("c_" + k) for k in ("no", "name", "slo", "bloom")])
    w = Window.partitionBy("rel", "table_idx").orderBy("row")
    own = F.regexp_extract(T.western_digits(F.col("c_no")), r"^\s*([0-9]+)", 1).try_cast("int")
    rows = rows.withColumn("lesson", F.last(own, ignorenulls=True).over(w)).where(F.col("lesson").isNotNull() & (F.coalesce("c_slo", F.lit("")) != ""))
    rows = rows.withColumn("title", F.coalesce(F.last(F.nullif(F.col("c_name"), F.lit("")), ignorenulls=True).over(w), F.lit("")))
    lines = rows.select("*", F.posexplode(F.filter(F.transform(F.split("c_slo", "\n"), lambda x: F.regexp_replace(x, "^[ •\\-–—*]+|[ •\\-–—*]+$", "")), lambda x: x != "")).alias("place", "text"))
    index = F.row_number().over(Window.partitionBy("rel", "chapter", "lesson").orderBy("table_idx", "row", "place"))
    return lines.select("rel", "chapter", "lesson", F.col("title").alias("name"), index.alias("index"), "text", F.coalesce("c_bloom", F.lit("")).alias("bloom"))


def tags(asked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(doc, q, lesson, index): the outcomes that questions (doc, q, chapter, lesson, block) are tied to, by mark or by quoting the statement.

    A question of a lesson is marked ``SLO 2``; one of a whole chapter (null lesson) ``L3 SLO 2``. Lessons in parts share their outcomes, so the key has no part.
    """
    text = F.lower(T.western_digits(T.fold(F.col("block"))))
    rows = asked.withColumn("low", text)
    numbers = F.regexp_extract_all("low", F.lit(r"(?:\bslo\b|حاصلات?\s*تعلیم)[\s\-:#]*([0-9]{1,2})"), F.lit(1))
    bare = rows.where("lesson is not null").select("doc", "q", "chapter", "lesson", F.explode(F.transform(numbers, lambda x: x.try_cast("int"))).alias("index"))
    bare = bare.join(outcomes.select("chapter", "lesson", "index"), ["chapter", "lesson", "index"], "left_semi").select("doc", "q", "lesson", "index")
    pairs = F.regexp_extract_all("low", F.lit(r"(\bl(?:esson)?\s*[0-9]{1,2}[\s,\-:]*slo[\s\-:#]*[0-9]{1,2})"), F.lit(1))
    two = rows.where("lesson is null").select("doc", "q", F.explode(F.transform(pairs, lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)))).alias("n"))
    two = two.select("doc", "q", F.element_at("n", 1).cast("int").alias("lesson"), F.element_at("n", 2).cast("int").alias("index"))
    said = outcomes.select("chapter", F.col("lesson").alias("own"), "index", T.statement(F.col("text")).alias("s")).where(F.length("s") >= 15)
    quoted = rows.join(said, "chapter").where((F.col("lesson").isNull() | (F.col("lesson") == F.col("own"))) & F.col("low").contains(F.col("s"))).select("doc", "q", F.col("own").alias("lesson"), "index")
    return bare.unionByName(two).unionByName(quoted).distinct()


def coverage(outcomes: DataFrame, hits: DataFrame, kinds: list[str]) -> DataFrame:
    """Outcomes with the number of questions of each kind, and in all, that are tied to them; hits have (chapter, lesson, index, kind)."""
    counts = hits.groupBy("chapter", "lesson", "index").pivot("kind", kinds).agg(F.count(F.lit(1)))
    rows = outcomes.join(counts, ["chapter", "lesson", "index"], "left").fillna(0, kinds)
    return rows.withColumn("total", reduce(lambda a, b: a + b, [F.col(k) for k in kinds]))


def coverage_findings(covered: DataFrame) -> DataFrame:
    """ST1 and ST2 over a whole subject."""
    got = covered.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("total") == 0).alias("gaps")).withColumn("rel", F.lit("subject"))
    first = rules._emit("ST1", got, F.when(F.col("n") > 0, "pass").otherwise("needs_review"), "a coverage map")
    return first.unionByName(rules._emit("ST2", got, F.when(F.col("n") == 0, "needs_review").when(F.col("gaps") > 0, "fail").otherwise("pass"), "every outcome is asked about"))


def lesson_coverage(lessons: DataFrame, outcomes: DataFrame, asked: DataFrame, ties: DataFrame) -> DataFrame:
    """PQ5 of every lesson (doc, chapter, lesson): a question on every outcome; untagged questions leave it open."""
    n = asked.join(ties.select("doc", "q").distinct().withColumn("tied", F.lit(1)), ["doc", "q"], "left").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count("tied").alias("tagged"))
    want = lessons.join(outcomes.select("chapter", "lesson", "index"), ["chapter", "lesson"])
    missing = want.join(ties.select("doc", "index").distinct(), ["doc", "index"], "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("missing"))
    rows = lessons.join(n, "doc", "left").join(want.groupBy("doc").agg(F.count(F.lit(1)).alias("slos")), "doc", "left").join(missing, "doc", "left").withColumn("rel", F.col("doc"))
    some = F.coalesce("missing", F.lit(0)) > 0
    verdict = F.when(F.col("slos").isNull(), "needs_review").when(F.col("n").isNull(), "na").when(F.col("tagged") == 0, "needs_review").when(some & (F.col("tagged") == F.col("n")), "fail").when(some, "needs_review").otherwise("pass")
    return rules._emit("PQ5", rows, verdict, "a question on every outcome")


def chapter_coverage(chapters: DataFrame, outcomes: DataFrame, asked: DataFrame, ties: DataFrame) -> DataFrame:
    """WS4 and WS5 of every chapter (doc, chapter): a question on every lesson, and on every outcome."""
    n = asked.join(ties.select("doc", "q").distinct().withColumn("tied", F.lit(1)), ["doc", "q"], "left").groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count("tied").alias("tagged"))
    want = chapters.join(outcomes.select("chapter", "lesson", "index"), "chapter")
    skipped = want.select("doc", "lesson").distinct().join(ties.select("doc", "lesson").distinct(), ["doc", "lesson"], "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("skipped"))
    missing = want.join(ties, ["doc", "lesson", "index"], "left_anti").groupBy("doc").agg(F.count(F.lit(1)).alias("missing"))
    rows = chapters.join(n, "doc", "left").join(skipped, "doc", "left").join(missing, "doc", "left").withColumn("rel", F.col("doc"))

    def verdict(gap: str) -> Column:
        some = F.coalesce(gap, F.lit(0)) > 0
        return F.when(F.coalesce("tagged", F.lit(0)) == 0, "needs_review").when(some & (F.col("tagged") == F.col("n")), "fail").when(some, "needs_review").otherwise("pass")

    first = verdict("skipped")
    return rules._emit("WS4", rows, first, "a question on every lesson", first == "pass").unionByName(rules._emit("WS5", rows, verdict("missing"), "a question on every outcome"))
