"""Results as tables, JSON and a report. Tables and JSON are written by Spark; only the roll-ups, one row a code or lesson, go into the report."""

from __future__ import annotations

import html
import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lektor.operators import wording


def write_tables(frames: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{folder}/{name}")


def write_json(findings: DataFrame, folder: str) -> None:
    """One JSON object a finding, as lines."""
    findings.write.mode("overwrite").json(folder)


def notes(findings: DataFrame) -> DataFrame:
    """(doc, note): one line a finding, worst first."""
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "needs_review", 1).otherwise(2)
    lead = F.when(F.col("status") == "fail", "To fix: ").when(F.col("status") == "needs_review", "Please check: ").otherwise("OK: ")
    line = F.concat(lead, "message", F.lit(" ["), "code", F.lit("]"))
    lines = findings.where("status <> 'na'").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct(rank.alias("r"), F.col("code"), line.alias("line")))).alias("l"))
    return lines.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("note"))


def grouped_notes(findings: DataFrame) -> DataFrame:
    """(status, message, codes, places, line): what several documents share is said once, with the codes and places it is about, in everyday words."""
    got = findings.where("status in ('fail', 'needs_review')").groupBy("status", "message").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set("doc")).alias("places"))
    lead = F.when(F.col("status") == "fail", "To fix: ").otherwise("Please check: ")
    return got.withColumn("line", F.concat(lead, wording.note_words(F.col("message")), F.lit(" ["), F.array_join("codes", ", "), F.lit("]")))


def _letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def _sheet(rows: list[tuple], fails: tuple[int, int] | None) -> str:
    """A worksheet; ``fails`` counts the word fail in columns from the second one on, by formula, behind the last."""
    body = []
    for r, row in enumerate(rows, 1):
        cells = [f'<c r="{_letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for c, v in enumerate(row, 1) if v not in (None, "")]
        if fails and r > 1:
            cells.append(f'<c r="{_letters(len(row) + 1)}{r}"><f>COUNTIF({_letters(fails[0])}{r}:{_letters(fails[1])}{r},"fail")</f></c>')
        body.append(f'<row r="{r}">{"".join(cells)}</row>')
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData></worksheet>'


def workbook(sheets: dict[str, DataFrame], grids: tuple[str, ...] = (), most: int = 100_000) -> bytes:
    """An Excel file of roll-ups, a sheet each; sheets named in ``grids`` get a count of fails behind each row. A table of more than ``most`` rows is refused, not cut."""
    out, names = io.BytesIO(), list(sheets)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
        for k, name in enumerate(names, 1):
            frame = sheets[name]
            rows = frame.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError("not a roll-up: too many rows for one sheet")
            z.writestr(f"xl/worksheets/sheet{k}.xml", _sheet([tuple(frame.columns), *map(tuple, rows)], (2, len(frame.columns)) if name in grids else None))
    return out.getvalue()


def outputs(frames: dict[str, DataFrame], findings: DataFrame, grid: DataFrame, folder: str, meta: dict[str, str]) -> None:
    """All results of a run under a folder that Spark reaches: findings as JSON lines, every roll-up as a table, the workbook and the report as one-row binary and text, and the run's metadata."""
    spark = findings.sparkSession
    write_json(findings, f"{folder}/findings")
    write_tables({**frames, "grid": grid}, folder)
    pages = [("workbook", bytearray(workbook({"Grid": grid, **frames}, ("Grid",)))), ("report", bytearray(report(grid).encode()))]
    spark.createDataFrame(pages, "name string, content binary").write.mode("overwrite").parquet(f"{folder}/files")
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def report(rollup: DataFrame, most: int = 10_000) -> str:
    """An HTML table of a roll-up (one row a key; a roll-up of more than ``most`` rows is refused, not cut)."""
    rows = rollup.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("not a roll-up: too many rows for one page")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rollup.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><meta charset=utf-8><table><tr>{head}</tr>{body}</table>"
