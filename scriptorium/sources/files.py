"""Readers by file kind, and sinks: keyed upserts, deletes, JSON lines, versioned tables."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: What a file name's ending stands for.
KINDS = {"csv": "table", "xlsx": "sheet", "json": "json", "txt": "text", "md": "text", "html": "text", "docx": "word", "pptx": "slides"}


def kind_of(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))[ending], F.lit("text"))


def _xml_text(data: bytes, member_prefix: str) -> str:
    """Paragraph texts of an Office file's XML parts, in order of their names."""
    lines = []
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        for name in sorted(n for n in parts.namelist() if n.startswith(member_prefix) and n.endswith(".xml")):
            for element in ElementTree.fromstring(parts.read(name)).iter():
                if element.tag.rsplit("}", 1)[-1] == "p":
                    line = "".join(t.text or "" for t in element.iter() if t.tag.rsplit("}", 1)[-1] == "t")
                    if line.strip():
                        lines.append(line)
    return "\n".join(lines)


def _sheet_text(data: bytes) -> str:
    """Rows of every sheet of a workbook, from its XML: the first row names the columns, as for csv."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = parts.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter() if local(t) == "t") for item in ElementTree.fromstring(parts.read("xl/sharedStrings.xml")) if local(item) == "si"]
        for name in sorted((n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), key=lambda n: (len(n), n)):
            rows = []
            for row in (e for e in ElementTree.fromstring(parts.read(name)).iter() if local(e) == "row"):
                cells: dict[int, str] = {}
                for at, cell in enumerate(c for c in row if local(c) == "c"):
                    column = 0
                    for letter in filter(str.isalpha, cell.get("r", "")):
                        column = column * 26 + ord(letter.upper()) - 64
                    value = "".join(e.text or "" for e in cell.iter() if local(e) in ("v", "t"))
                    cells[column - 1 if column else at] = shared[int(value)] if cell.get("t") == "s" and value else value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            head, *rest = rows or [[]]
            out += ["; ".join(f"{h}: {c}" for h, c in zip(head, row, strict=False)) for row in rest]
    return "\n".join(out)


def extract(kind: str, data: bytes) -> tuple[str, str]:
    """Text of one file, and an error message if it could not be read (the text is then empty)."""
    try:
        if kind == "word":
            return _xml_text(data, "word/document"), ""
        if kind == "slides":
            return _xml_text(data, "ppt/slides/"), ""
        text = data.decode("utf-8", "replace")
        if kind == "table":
            head, *rows = list(csv.reader(io.StringIO(text))) or [[]]
            return "\n".join("; ".join(f"{h}: {c}" for h, c in zip(head, row, strict=False)) for row in rows), ""
        if kind == "json":
            return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True), ""
        if kind == "sheet":
            return _sheet_text(data), ""
        return text, ""
    except Exception as problem:  # a broken file is a row with an error, not a failed job
        return "", f"{type(problem).__name__}: {problem}"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, text and error of every file under a folder, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", kind_of(F.col("path")).alias("kind"), "content")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [extract(k, bytes(c)) for k, c in zip(frame["kind"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "kind": frame["kind"], "text": [f[0] for f in found], "error": [f[1] for f in found]})

    return rows.mapInPandas(work, "path string, kind string, text string, error string")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of training signals with a fixed schema; blank lines are skipped."""
    schema = "query string, category string, subcategory string, signal_type string, confidence_score double, scores map<string,double>, timestamp string"
    return spark.read.schema(schema).json(path)


def chunk_id(*parts: str) -> Column:
    """A repeatable id from identifying columns and the first 128 characters of the last one."""
    *keys, text = parts
    return F.concat(F.lit("chunk_"), F.sha1(F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.substring(text, 1, 128))))


def checked_vectors(df: DataFrame, column: str, dimensions: int) -> DataFrame:
    """Fails the job where a vector has another length."""
    wrong = F.concat(F.lit(f"a vector of {column} has not {dimensions} dimensions but "), F.size(column).cast("string"))
    return df.withColumn(column, F.when(F.assert_true(F.size(column) == dimensions, wrong).isNull(), F.col(column)))


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows replaced or joined by new ones with the same key; of new rows with one key any stays."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return both.withColumn("_r", F.row_number().over(W.Window.partitionBy(*key).orderBy("_age"))).where("_r = 1").drop("_r", "_age")


def changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """New rows whose key is unknown or whose content hash differs; rows without a key are left out."""
    known = old.select(F.col(key).alias("_k"), F.sha2(F.col(content), 256).alias("_h"))
    rows = new.where(F.col(key).isNotNull())
    return rows.join(known, rows[key] == known["_k"], "left").where(~F.sha2(F.col(content), 256).eqNullSafe(F.col("_h"))).drop("_k", "_h")


def deleted(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def write_json_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)
