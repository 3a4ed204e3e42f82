"""Sources and sinks: ordered recursive scans, XLSX, CSV with BOM, JSON, versioned outputs."""

from __future__ import annotations

import io
import re
import zipfile
from pathlib import Path
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Source columns of an article export and their normalised names.
ARTICLE_COLUMNS = {
    "뉴스 식별자": "article_id", "일자": "date", "언론사": "source", "제목": "title", "통합 분류1": "category1", "통합 분류2": "category2", "통합 분류3": "category3",
    "키워드": "keywords", "특성추출(가중치순 상위 50개)": "features", "본문": "content", "URL": "url", "분석제외 여부": "exclude_flag",
}
#: Schemas of the inputs; ids stay text.
CORPUS = "article_id string, date timestamp, month string, source string, title string, category1 string, category2 string, keywords string, features string, content string, url string"
MONTHLY = "date date, CCSI double, KOSPI double, USD_KRW double, BASE_RATE double, CPI double"
SEARCH = "date date, regime string, group string, score double, anchor_score double, score_rel double"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, months: list[str] | None = None) -> DataFrame:
    """A scan that reads only the columns and, by pushdown, the months asked for."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("month").isin(months)) if months else df
    return df.select(*columns) if columns else df


def files_in_order(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, folder, name and content of all files below a folder; (folder, name) is their order."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    parts = F.split("path", "/")
    return f.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "content")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def _text(node) -> str:
    """The text of a shared or inline string: plain or in runs; phonetic hints are no part of it."""
    out = []
    for part in node:
        if _tag(part) == "t":
            out.append(part.text or "")
        elif _tag(part) == "r":
            out += [t.text or "" for t in part if _tag(t) == "t"]
    return "".join(out)


def sheet_rows(content: bytes, sheet: int = 1):
    """Rows of a worksheet as lists of text, parsed as a stream: shared and inline strings; checked against the declared range."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, node in iterparse(f):
                    if _tag(node) == "si":
                        shared.append(_text(node))
                        node.clear()
        declared, count = None, 0
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, node in iterparse(f):
                if _tag(node) == "dimension":
                    declared = node.get("ref", "")
                elif _tag(node) == "row":
                    cells: list = []
                    for cell in node:
                        at = _column(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        inner = {_tag(part): part for part in cell}
                        if cell.get("t") == "inlineStr":
                            cells[at] = _text(inner["is"]) if "is" in inner else ""
                        elif "v" in inner and inner["v"].text is not None:
                            cells[at] = shared[int(inner["v"].text)] if cell.get("t") == "s" else inner["v"].text
                    node.clear()
                    count += 1
                    yield cells
    first, last = ([int(re.sub("[^0-9]", "", x) or 0) for x in declared.split(":")] if declared and ":" in declared else [0, 0])
    if last and count not in (last, last - first + 1):
        raise ValueError(f"{count} rows; the sheet declares {declared}")


def xlsx(spark: SparkSession, path: str, columns: dict[str, str] = ARTICLE_COLUMNS) -> DataFrame:
    """Workbooks below a folder as one all-text table: selected columns renamed, with folder, name and row for the order of first appearance."""
    names = ["folder", "name", "row", *columns.values()]

    def run(batches):
        for b in batches:
            for folder, name, content in zip(*(b.column(c).to_pylist() for c in ("folder", "name", "content")), strict=True):
                rows = sheet_rows(content)
                head = next(rows, [])
                if missing := [c for c in columns if c not in head]:
                    raise ValueError(f"{name} lacks {missing}")
                at = [head.index(c) for c in columns]
                body = list(rows)
                cols = [[r[i] if i < len(r) else None for r in body] for i in at]
                n = len(body)
                yield pa.RecordBatch.from_arrays([pa.array([folder] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), *(pa.array(c, pa.string()) for c in cols)], names=names)

    kinds = ", ".join(f"`{n}` {'long' if n == 'row' else 'string'}" for n in names)
    return files_in_order(spark, path, "*.xlsx").select("folder", "name", "content").mapInArrow(run, kinds)


def csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header under a declared schema; a byte order mark is dropped; missing columns raise."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    text = text.withColumnsRenamed({c: c.lstrip("﻿") for c in text.columns if c.startswith("﻿")})
    if missing := [f.name for f in schema if f.name not in text.columns]:
        raise ValueError(f"{path} lacks {missing}")
    cast = lambda f: F.col(f.name) if f.dataType.simpleString() == "string" else F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name)
    return text.select(*[cast(f) for f in schema])


def json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def flatten_json(df: DataFrame, key: str, column: str, depth: int = 3) -> DataFrame:
    """key, path, value of JSON objects: dotted paths down to ``depth``; deeper values stay JSON."""
    level = df.select(key, F.lit("").alias("path"), F.col(column).alias("value"))
    done = None
    for k in range(depth):
        inner = F.from_json("value", "map<string,string>")
        step = level.select(key, "path", F.explode(inner).alias("name", "value")).select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "name").alias("path"), "value")
        is_object = F.col("value").startswith("{") & (k < depth - 1)
        leaf = step.filter(~F.coalesce(is_object, F.lit(False)))
        done = leaf if done is None else done.unionByName(leaf)
        level = step.filter(is_object)
    return done


def yaml_config(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def write_parquet(df: DataFrame, path: str, partition: list[str] = ()) -> None:
    """zstd Parquet; an existing path is an error."""
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def append_parquet(df: DataFrame, path: str, schema: StructType | str) -> None:
    """Add rows to zstd Parquet of a fixed schema: columns are taken by name and cast, a missing one raises before anything is written."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if missing := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"the rows lack {missing}")
    df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with header; one file only where the frame is a small report."""
    (df.coalesce(1) if one_file else df).write.mode("errorifexists").option("header", "true").csv(path)


def report_csv(df: DataFrame, path: str | Path) -> Path:
    """A small report as one local CSV with byte order mark, streamed row by row."""
    import csv as std

    target = versioned(path)
    with open(target, "w", encoding="utf-8-sig", newline="") as f:
        out = std.writer(f)
        out.writerow(df.columns)
        for r in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in r])
    return target


def versioned(path: str | Path) -> Path:
    """The path, or with _v2, _v3 … before its suffix where it exists."""
    path, n = Path(path), 2
    out = path
    while out.exists():
        out = path.with_name(f"{path.stem}_v{n}{path.suffix}")
        n += 1
    return out


def markdown(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A report's table; a frame with more than ``most`` rows isn't one and raises."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "N/A" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def markdown_report(path: str | Path, title: str, sections: list[tuple[str, DataFrame | str | list[str]]], digits: int = 4) -> Path:
    """A report with headed sections, each a paragraph, a list or a table of a small frame; an existing file is kept and the report gets the next free name."""
    out = [f"# {title}"]
    for heading, body in sections:
        out += ["", f"## {heading}", ""]
        out.append("\n".join(f"- {x}" for x in body) if isinstance(body, list) else body if isinstance(body, str) else markdown(body, digits))
    target = versioned(path)
    target.write_text("\n".join(out) + "\n", encoding="utf-8")
    return target


#: Limits of the file format.
SHEET_ROWS, CELL_CHARS = 1_048_576, 32_767


def write_xlsx(sheets: dict[str, DataFrame], path: str | Path, glossary: dict[str, str] | None = None) -> Path:
    """A workbook with one sheet per report: numbers as numbers, ids and long digits as text, rows streamed; limits of the format raise.

    ``glossary`` explains columns; its first sheet lists each sheet's columns with their meaning, empty where none is given."""
    target = versioned(path)
    if glossary is not None:
        spark = next(iter(sheets.values())).sparkSession
        terms = [(name, c, glossary.get(c, "")) for name, df in sheets.items() for c in df.columns]
        sheets = {"glossary": spark.createDataFrame(terms, "sheet string, column string, meaning string").coalesce(1)} | sheets
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(n)) + "</Types>")
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(n)) + "</Relationships>")
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, name in enumerate(sheets)) + "</sheets></workbook>")
        for i, df in enumerate(sheets.values()):
            with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as f:
                f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                for k, row in enumerate(_with_header(df)):
                    if k >= SHEET_ROWS:
                        raise ValueError("too many rows for a sheet")
                    f.write(("<row>" + "".join(map(_cell, row)) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
    return target


def _with_header(df: DataFrame):
    yield df.columns
    yield from df.toLocalIterator()


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and abs(v) < 1e15 and v == v:
        return f"<c><v>{v!r}</v></c>"
    text = str(v)
    if len(text) > CELL_CHARS:
        raise ValueError("a cell is longer than the format allows")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
