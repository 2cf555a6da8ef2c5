"""Readers, page parsers, resumable processing."""

import pytest
from pyspark.sql import functions as F

from corvelo.schemas import PAPER
from corvelo.sources import files, pages
from corvelo.streaming.resume import append_once, process_available


def test_json_lines(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"paper_id": "1", "title": "T"}\n\n{"paper_id": "2"}\n')
    got = files.read_json_lines(spark, str(tmp_path / "p.jsonl"), PAPER)
    assert got.count() == 2
    assert files.read_papers(spark, str(tmp_path / "p.jsonl")).where("size(authors) = 0").count() >= 2
    assert files.read_json_lines(spark, str(tmp_path / "none.jsonl"), PAPER).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"paper_id": "1"}\n{oops\n')
    with pytest.raises(ValueError, match="line 2"):
        files.read_json_lines(spark, str(tmp_path / "bad.jsonl"), PAPER)


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "c.csv").write_text('﻿country_code,country_name\nBR,"Bra""zil"\n', encoding="utf-8")
    panel = files.read_panel(spark, str(tmp_path / "c.csv"))
    assert panel.first().country_name == 'Bra"zil'
    files.write_csv(panel, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).count() == 1
    assert files.write_json_lines(panel, str(tmp_path / "j")) == 1
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "c.csv"), "missing")


PMLR = '<div class="paper"><p class="title">A Second &amp; Better Paper</p><p class="authors">Ana A, Bo B</p><a href="x/b1.html">abs</a><a href="x/b1.pdf">pdf</a></div>'
TRACKS = '<ul><li data-track="main"><a title="paper title" href="/hash/ab1-Abstract-C.html">T</a><span class="paper-authors">Ana, Bo</span></li></ul>'
TEI = '<TEI xmlns="t"><affiliation><orgName>U</orgName><orgName>L</orgName><address><country key="br"/></address></affiliation></TEI>'


def test_pages(spark):
    d = spark.createDataFrame([("v", PMLR), ("v", None)], "venue string, html string")
    p = pages.papers_of_pages(d, "proceedings").collect()
    assert len(p) == 1 and p[0].title == "A Second & Better Paper" and p[0].authors == ["Ana A", "Bo B"] and p[0].paper_id == "b1"
    t = pages.track_list(TRACKS)[0]
    assert t["paper_id"] == "ab1" and t["pdf_url"] == "/file/ab1-Paper-C.pdf" and t["track"] == "main"
    a = pages.anthology('<a href="/2025.x.0/">Front</a><a href="/2025.x.1/">One</a><a href="/2025.x.1/">Again</a>', "2025.x")
    assert [(x["title"], x["doi"]) for x in a] == [("One", "10.18653/v1/2025.x.1")]
    assert pages.tei_affiliations(TEI) == [("U; L", "BR")]
    table = "<table><tr><td>1</td><td>S</td><td>Brazil</td><td>1,024</td><td>12.5</td><td>3</td></tr><tr><td>x</td></tr></table>"
    r = pages.systems_of_pages(spark.createDataFrame([(table,)], "html string")).first()
    assert (r["rank"], r["country"], r["cores"], r["rmax"]) == (1, "Brazil", 1024, 12.5)
    assert pages.zip_chart(["1", "2,000", "axis", "BR", "US"], "axis") == [("BR", 1.0), ("US", 2000.0)]
    for labels in (["BR"], ["BR", "US", "FR"]):
        with pytest.raises(ValueError):
            pages.zip_chart(["1", "2,000", "axis", *labels], "axis")
    t = pages.affiliations_of_tei(spark.createDataFrame([(1, TEI), (2, "<broken"), (3, None)], "k int, xml string")).collect()
    assert [(r.k, r.institution_name, r.country_code) for r in t] == [(1, "U; L", "BR")]
    k = pages.cycle_tables('<table><tr><td>T</td><td>Ana (U); Bo (V)</td><td>10.1145/1</td></tr></table>')[0]
    assert k["authors"] == ["Ana", "Bo"] and k["doi"] == "10.1145/1" and k["track"] == "february"


def test_notes_and_items(spark):
    n = spark.createDataFrame([(1, '{"id":"a","content":{"title":{"value":"T"},"authors":{"value":["X"]}}}'), (2, '{"id":"a","content":{"title":"U"}}'), (3, '{"id":"b","content":{"title":""}}')], "at int, note string")
    got = files.openreview_papers(n, "v", "at").collect()
    assert len(got) == 1 and got[0].title == "T" and got[0].authors == ["X"]
    i = spark.createDataFrame([('{"DOI":"10.1/A","title":["T"],"author":[{"given":"Ana","family":"B"}],"container-title":["J"],"volume":"3"}',)], "item string")
    assert files.crossref_papers(i, "v", "J", "3").first().authors == ["Ana B"]


def test_resume(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "request_id string, v int")
    append_once(log, rows)
    append_once(log, rows)
    assert spark.read.parquet(log).count() == 2
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows, spark.createDataFrame([("c", 9)], rows.schema)):
        part.write.mode("append").parquet(source)
        q = process_available(spark, source, rows.schema, lambda d: d.withColumn("w", F.col("v") + 1), out, str(tmp_path / "ck"), "request_id")
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_replaced_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    d = spark.createDataFrame([(1,), (2,)], "k int")
    files.write_csv(d, path)
    files.write_csv(spark.read.option("header", True).csv(path).where("k = 2"), path)  # reads what it replaces
    assert [r.k for r in spark.read.option("header", True).csv(path).collect()] == ["2"]
    with pytest.raises(Exception):
        files.replace_table(d.select(F.raise_error(F.lit("broken")).alias("x")), path, lambda w: w.csv)
    assert [r.k for r in spark.read.option("header", True).csv(path).collect()] == ["2"]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_bundle(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.json").write_text("{}")
    out = tmp_path / "out"
    rows = files.write_bundle(spark, {"one.csv": str(tmp_path / "a.csv"), "two.json": str(tmp_path / "b.json")}, str(out), bundle_version="1.0").collect()
    assert [(r.published_file, r.bytes) for r in rows] == [("one.csv", 4), ("two.json", 2)]
    sums = (out / "SHA256SUMS").read_text().splitlines()
    assert sums[0] == hashlib.sha256(b"x\n1\n").hexdigest() + "  one.csv"
    held = json.loads((out / "source-manifest.json").read_text())
    assert held["bundle_version"] == "1.0" and len(held["files"]) == 2 and (out / "two.json").read_text() == "{}"
    with pytest.raises(FileNotFoundError, match="c.txt"):
        files.write_bundle(spark, {"c": str(tmp_path / "c.txt")}, str(out))
