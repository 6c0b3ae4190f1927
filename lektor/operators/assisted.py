"""The seam for judgements by a model: batches in, verdicts out, and nothing accepted without a quote that is really there.

A model is any function from a list of prompts to a list of JSON strings. It runs inside the tasks, one call per batch; answers are kept by the
hash of the prompt in a table that later runs join first, so a prompt is asked once.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lektor.functions import text as T

Model = Callable[[list[str]], list[str]]


def ask(prompts: DataFrame, model: Model, known: DataFrame | None = None) -> DataFrame:
    """(prompt, digest, answer); ``known`` has (digest, answer) of earlier runs."""
    rows = prompts.withColumn("digest", F.sha1("prompt"))
    todo = rows.join(known, "digest", "left_anti") if known is not None else rows

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(answer=model(batch["prompt"].tolist()))

    fresh = todo.select("prompt", "digest").dropDuplicates(["digest"]).mapInPandas(apply, "prompt string, digest string, answer string")
    if known is None:
        return fresh
    return fresh.unionByName(rows.select("prompt", "digest").distinct().join(known, "digest").select("prompt", "digest", "answer"))


def verdicts(answers: DataFrame) -> DataFrame:
    """Answers as (digest, verdict, reason, quote); what isn't the asked-for JSON has a null verdict."""
    parsed = F.from_json("answer", "verdict string, reason string, quote string")
    return answers.select("digest", parsed.alias("p")).select("digest", F.when(F.col("p.verdict").isin("yes", "no", "partly"), F.col("p.verdict")).alias("verdict"), "p.reason", "p.quote")


def quoted(rows: DataFrame, quote: str, material: str, shortest: int = 8) -> DataFrame:
    """Rows with ``kept``: whether all fragments of the quote (cut at ellipses, bracketed ones with what they hold; short ones ignored) stand in the material."""
    fragments = T.fragments(F.col(quote), shortest)
    hay = T.loose(F.col(material))
    return rows.withColumn("kept", F.coalesce((F.size(fragments) > 0) & F.forall(fragments, lambda f: F.contains(hay, f)), F.lit(False)))


def suggestion(code: str, rows: DataFrame) -> DataFrame:
    """A judgement is never a pass or a fail of its own: it becomes a review note."""
    return rows.select(F.lit(code).alias("code"), "doc", F.lit("needs_review").alias("status"), F.concat_ws(": ", "verdict", "reason").alias("message"), F.lit(True).alias("partial"))


def http_model(url: str, name: str, system: str = "", context: int = 8192, timeout: float = 900.0) -> Model:
    """A model behind an HTTP chat interface that answers in JSON: temperature 0, a fixed seed. A failed call answers with the empty text, which no check accepts."""

    def call(prompts: list[str]) -> list[str]:
        out = []
        for prompt in prompts:
            body = {"model": name, "stream": False, "format": "json", "options": {"temperature": 0, "seed": 7, "num_ctx": context}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}]}
            try:
                request = urllib.request.Request(url.rstrip("/") + "/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    out.append(json.load(reply).get("message", {}).get("content", ""))
            except (urllib.error.URLError, ValueError, OSError):
                out.append("")
        return out

    return call


def available(url: str, name: str, timeout: float = 5.0) -> bool:
    """Whether the server knows the model."""
    try:
        with urllib.request.urlopen(url.rstrip("/") + "/api/tags", timeout=timeout) as reply:
            return any(m.get("name", "").split(":")[0] == name.split(":")[0] for m in json.load(reply).get("models", []))
    except (urllib.error.URLError, ValueError, OSError):
        return False


def replies(prompts: DataFrame, model: Model, schema: str, known: DataFrame | None = None) -> DataFrame:
    """``prompts`` with ``reply``: the model's answer, fences stripped, by a schema; null where it isn't JSON."""
    answers = ask(prompts.select("prompt").distinct(), model, known).select("prompt", F.from_json(T.without_fences(F.col("answer")), schema).alias("reply"))
    return prompts.join(answers, "prompt", "left")


def accepted_share(rows: DataFrame, keys: list[str], ok: Column, asked: Column, least: float = 0.5) -> DataFrame:
    """Groups in which the accepted answers reach the share asked for."""
    got = rows.groupBy(*keys).agg(F.count_if(ok).alias("_ok"), F.max(asked).alias("_n"))
    return got.where(F.col("_ok") >= F.greatest(F.lit(1.0), least * F.col("_n"))).select(*keys)


def proposals(paras: DataFrame, chunks: DataFrame, model: Model, known: DataFrame | None = None, cutoff: float = 0.3) -> DataFrame:
    """(rel, idx, num): question starts that a model proposes, kept where the quote stands in that line or the next one and the line is no answer option.

    ``chunks`` has (rel, chunk, idx, line) of the listing. A document of whose proposals more than the cutoff fail is left out whole. Overlapping chunks count
    a line once; numbers run in line order.
    """
    from lektor.operators.assessments import OPTION

    listing = chunks.groupBy("rel", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("] "), F.left(x["line"], F.lit(240)))), "\n").alias("prompt"))
    got = replies(listing, model, "questions array<struct<para:int,quote:string>>", known).select("rel", F.explode("reply.questions").alias("q")).select("rel", F.col("q.para").alias("idx"), T.fold(F.col("q.quote")).alias("quote"))
    w = Window.partitionBy("rel").orderBy("idx")
    lines = paras.where(F.trim("text") != "").select("rel", "idx", T.fold(F.col("text")).alias("own")).withColumn("next", F.lead("own").over(w))
    checked = got.join(lines, ["rel", "idx"], "left")
    ok = F.coalesce((F.length("quote") >= 3) & (F.col("own").contains(F.col("quote")) | F.coalesce(F.col("next").contains(F.col("quote")), F.lit(False))) & ~F.col("own").rlike(OPTION), F.lit(False))
    checked = checked.withColumn("ok", ok)
    good = checked.groupBy("rel").agg(F.avg((~F.col("ok")).cast("double")).alias("bad")).where(F.col("bad") <= cutoff).select("rel")
    kept = checked.where("ok").select("rel", "idx").distinct().join(good, "rel", "left_semi")
    return kept.withColumn("num", F.row_number().over(w))


def mapped(asked: DataFrame, outcomes: DataFrame, model: Model, known: DataFrame | None = None) -> DataFrame:
    """(doc, q, index): the outcomes that a model ties questions (doc, q, text) to; a row counts with a quote from its question and numbers that exist.

    ``outcomes`` has (doc, index, text). Documents with accepted rows for fewer than half their questions are left out.
    """
    listed = lambda rows, n, text: rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, text))), lambda x: F.concat(x[n].cast("string"), F.lit(". "), F.left(x[text], F.lit(300)))), "\n").alias("l"), F.count(F.lit(1)).alias("n"))
    a, b = listed(outcomes, "index", "text").withColumnRenamed("l", "slos").drop("n"), listed(asked, "q", "text")
    prompts = a.join(b, "doc").select("doc", "n", F.concat(F.lit("Which outcomes does each question test? Quote the question.\nOutcomes:\n"), "slos", F.lit("\n\nQuestions:\n"), "l").alias("prompt"))
    rows = replies(prompts, model, "mapping array<struct<question:int,slos:array<int>,quote:string>>", known).select("doc", "n", F.explode("reply.mapping").alias("m"))
    rows = rows.select("doc", "n", F.col("m.question").alias("q"), "m.slos", T.fold(F.col("m.quote")).alias("quote")).join(asked.select("doc", "q", T.fold(F.col("text")).alias("own")), ["doc", "q"], "left")
    most = outcomes.groupBy("doc").agg(F.max("index").alias("most"))
    rows = rows.join(most, "doc").withColumn("ok", F.coalesce((F.length("quote") >= 8) & F.col("own").contains(F.col("quote")) & F.forall("slos", lambda x: (x >= 1) & (x <= F.col("most"))), F.lit(False)))
    good = accepted_share(rows, ["doc"], F.col("ok"), F.col("n"))
    return rows.where("ok").join(good, "doc", "left_semi").select("doc", "q", F.explode("slos").alias("index")).distinct()


# The levels of a taxonomy, lower and higher ones.
LOWER, HIGHER = ("remember", "understand", "apply"), ("analyze", "analyse", "evaluate", "create")


def levels(asked: DataFrame, model: Model, known: DataFrame | None = None) -> DataFrame:
    """(doc, q, level, higher): a model's level of each question (doc, q, text), with a quote from it; documents with fewer than half are left out."""
    text = lambda c: F.regexp_replace(F.col(c), r"\s+", " ")
    prompts = asked.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", text("text").alias("t")))), lambda x: F.concat(x["q"].cast("string"), F.lit(". "), F.left(x["t"], F.lit(400)))), "\n").alias("l"), F.count(F.lit(1)).alias("n"))
    prompts = prompts.select("doc", "n", F.concat(F.lit("Name each question's level: " + ", ".join((*LOWER, *HIGHER)) + ". Quote it.\nQuestions:\n"), "l").alias("prompt"))
    rows = replies(prompts, model, "levels array<struct<question:int,level:string,quote:string>>", known).select("doc", "n", F.explode("reply.levels").alias("m"))
    rows = rows.select("doc", "n", F.col("m.question").alias("q"), F.lower(F.trim("m.level")).alias("level"), T.fold(F.col("m.quote")).alias("quote")).join(asked.select("doc", "q", T.fold(text("text")).alias("own")), ["doc", "q"], "left")
    ok = F.coalesce(F.col("level").isin(*LOWER, *HIGHER) & (F.length("quote") >= F.least(F.lit(8), F.length("own"))) & F.col("own").contains(F.col("quote")), F.lit(False))
    rows = rows.withColumn("ok", ok)
    good = accepted_share(rows, ["doc"], F.col("ok"), F.col("n"))
    return rows.where("ok").join(good, "doc", "left_semi").select("doc", "q", F.when(F.col("level") == "analyse", "analyze").otherwise(F.col("level")).alias("level"), F.col("level").isin(*HIGHER).alias("higher"))


def feedback_of(block: Column, correct: list[str], incorrect: list[str]) -> Column:
    """struct (correct, incorrect): the feedback under a question: what follows its label, in that line or the next one; the first of each counts."""
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(x))
    shown = F.zip_with(lines, F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit(""))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def first(own: list[str], other: list[str]) -> Column:
        mine = lambda x: T.begins_with_any(F.lower(T.fold(x)), own) & (~T.begins_with_any(F.lower(T.fold(x)), other) if other else F.lit(True))
        rest = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x["a"]), "^" + T.any_of(own), ""), "^[ :：–—-]+", "")
        tail = lambda x: F.when(rest(x) != "", F.right(x["a"], F.length(rest(x)))).otherwise(x["b"])
        return F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(shown, lambda x: mine(x["a"])), tail), lambda t: t != ""), F.lit(1)), F.lit(""))

    return F.struct(first(correct, incorrect).alias("correct"), first(incorrect, []).alias("incorrect"))


def feedback(items: DataFrame, model: Model, known: DataFrame | None = None) -> DataFrame:
    """(doc, q, correct_ok, correct_why, incorrect_ok, incorrect_why): a model's view of the two messages of each item (doc, q, text, correct, incorrect)."""
    line = F.concat(F.lit("Question "), F.col("q").cast("string"), F.lit(": "), F.left("text", F.lit(500)), F.lit("\nCorrect: "), "correct", F.lit("\nIncorrect: "), "incorrect")
    prompts = items.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("l"), F.count(F.lit(1)).alias("n"))
    prompts = prompts.select("doc", "n", F.concat(F.lit("Does correct feedback say why, and does incorrect feedback name the misconception without the answer?\n"), "l").alias("prompt"))
    rows = replies(prompts, model, "items array<struct<question:int,correct_ok:boolean,correct_why:string,incorrect_ok:boolean,incorrect_why:string>>", known).select("doc", "n", F.explode("reply.items").alias("m")).select("doc", "n", F.col("m.question").alias("q"), "m.correct_ok", "m.correct_why", "m.incorrect_ok", "m.incorrect_why")
    rows = rows.join(items.select("doc", "q"), ["doc", "q"], "left_semi").withColumn("ok", F.col("correct_ok").isNotNull() & F.col("incorrect_ok").isNotNull())
    good = accepted_share(rows, ["doc"], F.col("ok"), F.col("n"))
    return rows.where("ok").join(good, "doc", "left_semi").drop("n", "ok")


def readings(lines: DataFrame, model: Model, kind: str, known: DataFrame | None = None) -> DataFrame:
    """(rel, key, at): what a model reads of documents from numbered lines (rel, idx, line): kind sections (key: section, at: line), headings (key: heading) or slides
    (key: role, at: slide). Numbers that no line has are dropped."""
    asks = {"sections": "At which line does each section begin?", "headings": "Which lines are headings?", "slides": "Which part of the lesson is each slide for?"}
    schemas = {"sections": "sections map<string,int>", "headings": "headings array<int>", "slides": "slides map<string,string>"}
    prompts = lines.groupBy("rel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("] "), F.left(x["line"], F.lit(160)))), "\n").alias("l"))
    got = replies(prompts.select("rel", F.concat(F.lit(asks[kind] + "\n"), "l").alias("prompt")), model, schemas[kind], known)
    if kind == "sections":
        rows = got.select("rel", F.explode("reply.sections").alias("key", "at"))
    elif kind == "headings":
        rows = got.select("rel", F.lit("heading").alias("key"), F.explode("reply.headings").alias("at"))
    else:
        rows = got.select("rel", F.explode("reply.slides").alias("slide", "key")).select("rel", "key", F.regexp_replace("slide", "[^0-9]", "").try_cast("int").alias("at"))
    return rows.join(lines.select("rel", F.col("idx").alias("at")), ["rel", "at"], "left_semi").select("rel", "key", "at")


def policy(findings: DataFrame, mode: str = "suggest") -> DataFrame:
    """Findings that rest on a model's reading: as suggestions they become reviews that say what they would be; when the model decides, a pass stays partial."""
    decided = F.col("status").isin("pass", "fail")
    if mode == "decide":
        return findings.withColumn("partial", F.when(decided & (F.col("status") == "pass"), True).otherwise(F.col("partial"))).withColumn("message", F.when(decided, F.concat(F.lit("[model-assisted] "), "message")).otherwise(F.col("message")))
    said = F.concat(F.lit("[model-assisted] Would be "), F.col("status"), F.lit(": "), "message")
    return findings.withColumn("message", F.when(decided, said).otherwise(F.col("message"))).withColumn("partial", F.when(decided, False).otherwise(F.col("partial"))).withColumn("status", F.when(decided, "needs_review").otherwise(F.col("status")))
