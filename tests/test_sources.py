"""Sources and sinks: round trips and guards; streaming on files."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.topics import TopicModel
from tidemark.sources import readers as R
from tidemark.streaming import scoring


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("0123456789012345678", "a & <b>", 1.5), ("2", None, None)], "id string, t string, x double")
    folder = tmp_path / "in" / "one"
    folder.mkdir(parents=True)
    R.write_xlsx({"first": df}, folder / "book.xlsx")
    got = R.xlsx(spark, f"file://{tmp_path}/in", {"id": "id", "t": "t", "x": "x"}).orderBy("row").collect()
    assert [(r["id"], r["t"], r["x"], r["folder"], r["row"]) for r in got] == [("0123456789012345678", "a & <b>", "1.5", "one", 0), ("2", None, None, "one", 1)]
    with pytest.raises(Exception, match="lacks"):
        R.xlsx(spark, f"file://{tmp_path}/in", {"nope": "nope"}).collect()


def test_csv_with_bom(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿month,v\n2024-01,1.5\n2024-02,x\n", encoding="utf-8")
    got = R.csv(spark, f"file://{tmp_path}/a.csv", "month string, v double").collect()
    assert [tuple(r) for r in got] == [("2024-01", 1.5), ("2024-02", None)]
    with pytest.raises(ValueError):
        R.csv(spark, f"file://{tmp_path}/a.csv", "month string, w double")


def test_versioned_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert R.report_csv(df, tmp_path / "r.csv").name == "r.csv" and R.report_csv(df, tmp_path / "r.csv").name == "r_v2.csv"
    assert R.markdown(df) == "| a | b |\n| --- | --- |\n| 1 | N/A |"
    with pytest.raises(ValueError):
        R.markdown(spark.range(5), most=4)


def test_flatten_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x", "d": {"e": 2}}}'), (2, None), (3, "{}")], "id int, j string")
    assert sorted((r["id"], r["path"], r["value"]) for r in R.flatten_json(df, "id", "j").collect()) == [(1, "a", "1"), (1, "b.c", "x"), (1, "b.d.e", "2")]


def test_month_pushdown(spark, tmp_path):
    spark.createDataFrame([("2024-01", 1, 2), ("2024-02", 3, 4)], "month string, a int, b int").write.parquet(f"{tmp_path}/p")
    df = R.parquet(spark, f"{tmp_path}/p", ["a"], ["2024-02"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert [r["a"] for r in df.collect()] == [3] and "b#" not in plan.split("ReadSchema")[1] and "month" in plan.split("PushedFilters")[1]


def test_stream_scores_arriving_documents(spark, tmp_path):
    import numpy as np

    spark.createDataFrame([(1, "alpha beta", "2024-01-02 00:00:00"), (2, "gamma", "2024-01-03 00:00:00"), (3, "zzz", "2024-01-03 00:00:00")], "doc_id long, text string, t string").select("doc_id", "text", F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/in")
    vocab = spark.createDataFrame([("alpha", 0, 1.0), ("beta", 1, 1.0), ("gamma", 2, 1.0)], "term string, idx int, idf double")
    model = TopicModel(np.array([[1.0, 1.0, 0.0], [0.0, 0.0, 1.0]]), [], True)
    scored = scoring.score_arriving(scoring.arriving(spark, f"{tmp_path}/in", "doc_id long, text string, ts timestamp"), vocab, model)
    q = scored.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = {r["doc_id"]: r for r in spark.sql("SELECT * FROM scored").collect()}
    assert got[1]["topics"][0] == pytest.approx(1) and got[2]["topics"][1] == pytest.approx(1) and not got[3]["valid"]
    weekly = scoring.weekly_shares(scored, 2)
    q = weekly.writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM weekly").collect()
    assert len(r) == 1 and r[0]["n_docs"] == 3 and r[0]["n_valid"] == 2 and r[0]["topic_0"] == pytest.approx(0.5)


def test_shared_strings(tmp_path):
    import io
    import zipfile

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst {space}><si><t>a</t></si><si/><si><t/></si><si><r><t>b </t></r><r><t>&amp; c</t></r><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><dimension ref="A1:D2"/><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="D1" t="s"><v>3</v></c></row><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>x</t></is></c><c><v>1.5</v></c><c/></row></sheetData></worksheet>')
    assert list(R.sheet_rows(out.getvalue())) == [["a", None, None, "b & c"], ["", "x", "1.5", None]]


def test_append_keeps_the_schema(spark, tmp_path):
    path = f"{tmp_path}/grown"
    R.append_parquet(spark.createDataFrame([(1, "a", 9)], "n int, id string, extra int"), path, "id string, n long")
    R.append_parquet(spark.createDataFrame([("b", "2")], "id string, n string"), path, "id string, n long")
    got = spark.read.parquet(path)
    assert [f.simpleString() for f in got.schema] == ["id:string", "n:bigint"] and sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        R.append_parquet(spark.createDataFrame([("c",)], "id string"), path, "id string, n long")


def test_workbook_glossary(spark, tmp_path):
    import zipfile

    book = R.write_xlsx({"one": spark.createDataFrame([(1,)], "share int")}, tmp_path / "g.xlsx", {"share": "part of the month"})
    with zipfile.ZipFile(book) as z:
        assert "part of the month" in z.read("xl/worksheets/sheet1.xml").decode() and 'name="glossary" sheetId="1"' in z.read("xl/workbook.xml").decode()


def test_a_report_has_sections_and_never_overwrites(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5), ("b|c", None)], "name string, value double").orderBy("name")
    first = R.markdown_report(tmp_path / "r.md", "Title", [("Text", "One line."), ("List", ["x", "y"]), ("Table", table)], 2)
    second = R.markdown_report(tmp_path / "r.md", "Title", [])
    assert first.read_text() == "# Title\n\n## Text\n\nOne line.\n\n## List\n\n- x\n- y\n\n## Table\n\n| name | value |\n| --- | --- |\n| a | 1.50 |\n| b\\|c | N/A |\n"
    assert second.name == "r_v2.md" and second.read_text() == "# Title\n"
