"""Zipped packages of documents as a table of files.

Archives are read by Spark (``binaryFile``), opened where they are read, and guarded against bombs and path traversal before any entry is
expanded. Each entry becomes a row, so what follows is spread over files, not archives.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lektor.functions import profile as P
from lektor.functions import text as T
from lektor.operators import status

# Limits of an archive.
MAX_FILES, MAX_BYTES, MAX_RATIO, RATIO_FROM = 20_000, 4 << 30, 1000, 50 << 20


class UnsafeArchive(ValueError):
    pass


def guard(entries: list[zipfile.ZipInfo]) -> None:
    """Refuse too many entries, too much expanded data, absurd compression of large entries, and paths that leave the folder."""
    if len(entries) > MAX_FILES:
        raise UnsafeArchive("too many entries")
    if sum(e.file_size for e in entries) > MAX_BYTES:
        raise UnsafeArchive("too large when expanded")
    for e in entries:
        if e.file_size > RATIO_FROM and e.file_size > MAX_RATIO * max(1, e.compress_size):
            raise UnsafeArchive(f"{e.filename}: suspicious compression")
        clean = posixpath.normpath(e.filename.replace("\\", "/"))
        if clean.startswith(("/", "..")) or (len(clean) > 1 and clean[1] == ":"):
            raise UnsafeArchive(f"{e.filename}: leaves the folder")


def root_of(names: list[str]) -> str:
    """The single top folder, if all files but hidden ones are in it."""
    tops = {n.split("/", 1)[0] if "/" in n else "" for n in names if not n.startswith(("__MACOSX/", "."))}
    return tops.pop() + "/" if len(tops) == 1 and "" not in tops else ""


def files(spark: SparkSession, path: str) -> DataFrame:
    """(package, rel, ext, content) of all visible files of the archives at ``path``."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for package, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    entries = [e for e in archive.infolist() if not e.is_dir()]
                    guard(entries)
                    root = root_of([e.filename for e in entries])
                    for e in sorted(entries, key=lambda e: e.filename):
                        rel = e.filename.removeprefix(root)
                        name = rel.rsplit("/", 1)[-1]
                        if e.filename.startswith("__MACOSX/") or name.startswith((".", "~$")):
                            continue
                        ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                        yield pd.DataFrame({"package": [package], "rel": [rel], "ext": [ext], "content": [archive.read(e)]})

    scan = spark.read.format("binaryFile").load(path).select("path", "content")
    return scan.mapInPandas(expand, "package string, rel string, ext string, content binary")


def first_match(text: Column, patterns: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The name of the first pattern, in order, that the text matches."""
    out = None
    for name, pattern in patterns:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(otherwise))


# Kinds of documents by name, first match wins, with the extension and the scope of each.
KINDS = [
    ("video_storyboard", r"(?i)story\s*board", "docx", "lesson"), ("lesson_plan", "(?i)lesson[-_ ]*plan", "docx", "lesson"), ("facilitator_guide", "(?i)facilitator[-_ ]*guide|lesson[-_ ]*slides", "pptx", "lesson"),
    ("pop_quiz", "(?i)pop[-_ ]*quiz", "docx", "subject"), ("data_bank", "(?i)data[-_ ]*bank", "docx", "subject"), ("specification", "(?i)specification", "docx", "subject"), ("chapter_exam", "(?i)assessment|worksheet", "docx", "lesson"),
    ("worksheet", "(?i)chapter[-_ ]*exam", "docx", "chapter"), ("textbook", "(?i)book", "pdf", "lesson"),
]
GENERIC = "document"


def location(rel: Column, profile: dict = P.PROFILE) -> Column:
    """struct (chapter, lesson, variant, folder) from a path: the first folder that names a number, else the file's name; ``part 2`` or a letter makes a variant."""
    chapter, lesson = (profile["path_patterns"][k] for k in ("chapter", "lesson"))
    parts = F.split(rel, "/")
    folders, stem = F.slice(parts, F.lit(1), F.size(parts) - 1), T.file_stem(rel)
    number = lambda x, p: F.regexp_extract(x, p, 1).try_cast("int")
    first = lambda p: F.try_element_at(F.filter(folders, lambda x: x.rlike(p)), F.lit(1))
    folder = first(lesson)
    part = r"(?i)part[-_ ]*([0-9]+)(?:[-_ ]*([A-Za-z])(?=[-_ .]))?"
    letter, n = F.regexp_extract(folder, part, 2), F.regexp_extract(folder, part, 1).try_cast("int")
    by_folder = F.when(letter != "", F.upper(letter)).when(n.isNotNull(), T.part_letter(n)).otherwise("")
    by_name = F.upper(F.regexp_extract(stem, lesson + r"[-_ ]*([A-Za-z])(?=[-_ .])", 2))
    own = F.coalesce(number(folder, lesson), number(stem, lesson))
    variant = F.when(own.isNull(), F.coalesce(by_folder, F.lit(""))).when(F.coalesce(by_folder, F.lit("")) != "", by_folder).otherwise(by_name)
    return F.struct(F.coalesce(number(first(chapter), chapter), number(stem, chapter)).alias("chapter"), own.alias("lesson"), variant.alias("variant"), F.coalesce(folder, F.lit("")).alias("folder"))


def kind_of(name: Column, ext: Column, kinds: list[tuple] = KINDS) -> Column:
    out = None
    for kind, pattern, own, _ in kinds:
        hit = (ext == own) & name.rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def by_content(paras: DataFrame, profile: dict = P.PROFILE, kinds: list[tuple] = KINDS) -> DataFrame:
    """(rel, doc_type, chapter, lesson): kinds of Word files from what they hold, for names that don't tell: a title that does, three section labels, places in a plan, feedback fields, storyboard columns,
    four questions; else a generic document. The first 400 lines outside tables and the cells count."""
    vocab = profile["vocab"]
    w = Window.partitionBy("rel", "in_table").orderBy("idx")
    rows = paras.where(F.trim("text") != "").withColumn("k", F.row_number().over(w)).where("in_table or k <= 400").withColumn("norm", F.lower(T.fold(F.col("text")))).withColumn("bare", T.unlabelled(F.col("text")))
    title = ~F.col("in_table") & (F.col("k") <= 6)
    named = F.min(F.coalesce(*[F.when(title & F.col("text").rlike(p), F.lit(i)) for i, (_, p, ext, _s) in enumerate(kinds) if ext == "docx"]))
    section = F.coalesce(*[F.when(~F.col("in_table") & T.label_leads(F.col("bare"), labels), F.lit(name)) for name, labels in profile["lesson_plan_sections"].items()])
    question = ~F.col("in_table") & T.western_digits(F.col("norm")).rlike(P.question_pattern(profile)) & F.col("text").rlike(r"[?؟]|_{3,}")
    head = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("in_table") & (F.col("k") <= 8), F.struct("k", "text")))), lambda x: x["text"]), " | ")
    has = lambda words: F.bool_or(T.contains_any(F.col("norm"), words))
    got = rows.groupBy("rel").agg(
        named.alias("named"), F.countDistinct(section).alias("sections"), has(vocab["lesson_plan_location_labels"]).alias("place"), F.bool_or(F.col("in_table") & T.begins_with_any(F.col("norm"), vocab["data_bank_fields"]["feedback_incorrect"])).alias("feedback"),
        (has(["narration", "on-screen", "بیانیہ"]) & has(["scene", "منظر"])).alias("board"), F.count_if(question).alias("questions"), head.alias("head"),
    )
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in kinds]), F.col("named") + 1)
    kind = F.when(F.col("named").isNotNull(), kind).when(F.col("sections") >= 3, "lesson_plan").when(F.col("place"), "pop_quiz").when(F.col("feedback"), "data_bank").when(F.col("board"), "video_storyboard").when(F.col("questions") >= 4, "chapter_exam").otherwise(GENERIC)
    number = lambda words: F.regexp_extract("head", rf"(?i)\b(?:{'|'.join(words)})[-_ :]*([0-9]{{1,2}})\b", 1).try_cast("int")
    return got.select("rel", kind.alias("doc_type"), number(["chapter", "chpater", "unit", "باب"]).alias("chapter"), number(["lesson", "سبق"]).alias("lesson"))


def classified(rows: DataFrame, paras: DataFrame | None = None, kinds: list[tuple] = KINDS, profile: dict = P.PROFILE) -> DataFrame:
    """Files (rel, ext) with doc_type, scope, chapter, lesson, variant, folder, and a flag for superseded versions of documents for the whole subject. A slide deck whose name doesn't tell is a guide; a Word file
    is what its content says, where ``paras`` are given."""
    place = location(F.col("rel"), profile)
    out = rows.withColumn("_l", place).withColumn("doc_type", kind_of(T.file_stem(F.col("rel")), F.col("ext"), kinds))
    if paras is not None:
        told = by_content(paras, profile, kinds).select(F.col("rel").alias("_rel"), F.col("doc_type").alias("_t"), F.col("chapter").alias("_c"), F.col("lesson").alias("_n"))
        out = out.join(told, F.col("rel") == F.col("_rel"), "left")
    else:
        out = out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("_rel", "string"), ("_t", "string"), ("_c", "int"), ("_n", "int"))])
    guessed = F.col("doc_type").isNull() & F.col("ext").isin("docx", "pptx")
    out = out.withColumn("_g", guessed).withColumn("doc_type", F.coalesce("doc_type", F.when(F.col("ext") == "pptx", "facilitator_guide").when(F.col("ext") == "docx", F.col("_t"))))
    scope = F.coalesce(*[F.when(F.col("doc_type") == k, s_) for k, _, _, s_ in kinds], F.lit("lesson"))
    out = out.withColumn("scope", scope)
    assumed = F.when(F.col("_g") & (F.col("scope") == "lesson") & (F.col("doc_type") != GENERIC), 1)
    whole = (F.col("scope") == "subject") | F.coalesce(F.col("doc_type") == GENERIC, F.lit(False))
    out = out.withColumn("chapter", F.when(~whole, F.coalesce("_l.chapter", F.when(F.col("_g"), F.col("_c")), assumed)))
    out = out.withColumn("lesson", F.when(~whole & (F.col("scope") == "lesson"), F.coalesce("_l.lesson", F.when(F.col("_g"), F.col("_n")), assumed)))
    out = out.withColumn("variant", F.when(~whole & (F.col("scope") == "lesson"), F.col("_l.variant")).otherwise("")).withColumn("folder", F.col("_l.folder")).drop("_l", "_rel", "_t", "_c", "_n", "_g")
    name = F.element_at(F.split("rel", "/"), -1)
    subject = out.where("scope = 'subject' and doc_type is not null")
    newest = status.latest(subject, "doc_type", T.version_key(name), "rel")
    rest = out.where("not (scope = 'subject' and doc_type is not null)").withColumn("superseded", F.lit(False))
    return newest.unionByName(rest)


# What a kind is called in file names.
NAMES = {"lesson_plan": "Lesson-Plan", "chapter_exam": "Assessment", "facilitator_guide": "Facilitator-Guide", "video_storyboard": "Storyboard", "worksheet": "Chapter-Exam", "pop_quiz": "Pop-Quiz", "data_bank": "Data-Bank", "specification": "Document-of-Specifications"}


def new_name(version: Column, subject: Column) -> Column:
    """The name a file should have, from columns doc_type, scope, chapter, lesson, variant, ext; null for kinds without one."""
    kind = F.coalesce(*[F.when(F.col("doc_type") == k, v) for k, v in NAMES.items()])
    chapter = F.when(F.col("chapter").isNotNull(), F.concat(F.lit("Chapter-"), F.col("chapter").cast("string"))).otherwise("Chapter")
    lesson = F.concat(F.lit("Lesson-"), F.col("lesson").cast("string"), F.coalesce("variant", F.lit("")), F.lit("-Chapter-"), F.col("chapter").cast("string"))
    ident = F.when(F.col("doc_type").isin("pop_quiz", "data_bank", "specification"), F.coalesce(subject, F.lit("Subject"))).when((F.col("scope") == "chapter") | F.col("lesson").isNull(), chapter).otherwise(lesson)
    return F.concat(kind, F.lit("-"), ident, F.when(version.isNotNull(), F.concat(F.lit("-v"), version)).otherwise(""), F.lit("."), F.col("ext"))


def collapsed(rows: DataFrame) -> DataFrame:
    """Where some files have a lesson folder, lesson files of chapters without any lose lesson and variant."""
    chapters = rows.where("scope = 'lesson' and lesson is not null").select("chapter").distinct().withColumn("_has", F.lit(True))
    any_ = rows.agg(F.bool_or((F.col("scope") == "lesson") & F.col("lesson").isNotNull()).alias("_any"))
    out = rows.join(chapters, rows["chapter"].eqNullSafe(chapters["chapter"]), "left").drop(chapters["chapter"]).crossJoin(F.broadcast(any_))  # one row
    lose = (F.col("scope") == "lesson") & F.col("_any") & F.col("_has").isNull()
    return out.withColumn("lesson", F.when(~lose, F.col("lesson"))).withColumn("variant", F.when(lose, "").otherwise(F.col("variant"))).drop("_has", "_any")
