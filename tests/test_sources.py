"""Snapshots that are read in pieces, traces by run, and files of replacements."""

import json

import pytest

from citeflow.operators.tables import new_folder
from citeflow.sources import readers

SECTIONS = "part string, section string, heading string, text string"


def plain(df):
    return sorted((r.title, r.part, r.section, r.heading, r.text, r.source_url) for r in df.collect())


def snapshot(spark, n=60):
    rows = [(f"{i // 20 + 1}", f"{i // 20 + 1}.{i}", f"§ {i // 20 + 1}.{i} Rule <{i}> & more", f"First  line {i} & \x0bmore\n\n<tag> é {'long ' * (i * 7 % 40)}") for i in range(n)]
    path = new_folder(spark, "snapshot")
    readers.write_xml_snapshot(spark.createDataFrame(rows, SECTIONS).repartition(3), path)
    return path, rows


def test_pieces_agree_with_whole_files(spark):
    path, rows = snapshot(spark)
    whole = plain(readers.read_xml_sections(spark, path, version="2031-05-06"))
    assert len(whole) == 60 and whole[0][:3] == (12, "1", "1.0")
    for i, (part, section, heading, text) in enumerate(rows):
        body = [f"Rule <{i}> & more", *(" ".join(t.replace("\x0b", " ").split()) for t in text.split("\n"))]
        assert (12, part, section, heading, "\n".join(b for b in body if b), f"https://www.ecfr.gov/on/2031-05-06/title-12/section-{section}") in whole
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        assert plain(readers.scan_xml_sections(spark, path, version="2031-05-06")) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_snapshot(spark, tmp_path):
    body = """<?xml version="1.0"?><ECFR><DIV5 TYPE="PART" N=""><HEAD>PART <I>7a</I> Loans</HEAD><DIV6 TYPE="SUBPART"><HEAD>Subpart A</HEAD>
      <DIV8 N="1" TYPE="SECTION"><HEAD>Sec. 7.1 Scope.</HEAD><P>One <E T="1">two</E></P><NOTE><P>nested</P></NOTE></DIV8><DIV8 TYPE="SECTION"><HEAD>Reserved</HEAD></DIV8></DIV6></DIV5>
      <DIV8 TYPE="SECTION"><HEAD>§ 9.3 Loose</HEAD><FP>text</FP></DIV8><DIV5 TYPE='PART' N='8'><HEAD>PART 8</HEAD><DIV8 TYPE='SECTION'><HEAD>8.1-a</HEAD></DIV8></DIV5></ECFR>"""
    (tmp_path / "one.xml").write_text(body)
    whole = plain(readers.read_xml_sections(spark, str(tmp_path), version="v"))
    assert [r[1:3] for r in whole] == [("7a", "7.1"), ("8", "8.1-a"), ("9", "9.3")] and whole[0][4] == "Scope.\nOne two\nnested\nnested"
    assert plain(readers.scan_xml_sections(spark, str(tmp_path), version="v")) == whole
    (tmp_path / "one.xml").write_text("<ECFR></ECFR>")
    assert readers.scan_xml_sections(spark, str(tmp_path), version="v").count() == 0


def test_traces(spark):
    path = new_folder(spark, "traces")
    runs = spark.createDataFrame([(f"run-{i}", [f"step {k}" for k in range(i % 4)]) for i in range(50)], "run_id string, steps array<string>")
    readers.write_traces(runs, path, folders=4)
    found = readers.read_trace(spark, path, "run-7")
    assert [tuple(r) for r in found.collect()] == [("run-7", ["step 0", "step 1", "step 2"])]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(run_id,run-7)" in plan
    assert readers.read_traces(spark, path).count() == 50
    for bad in ("..\\secret", "a/b", "a.json", ""):
        with pytest.raises(ValueError):
            readers.read_trace(spark, path, bad)
        with pytest.raises(ValueError, match="bad trace id"):
            readers.write_traces(spark.createDataFrame([(bad, ["x"])], runs.schema), new_folder(spark, "traces"))
    with pytest.raises(KeyError):
        readers.read_trace(spark, path, "run-99")
    with pytest.raises(ValueError, match="repeated"):
        readers.write_traces(runs.union(runs.limit(1)), new_folder(spark, "traces"))


def test_replacements(spark, tmp_path):
    one = {"groups": [{"candidates": [{"id": "a", "n": 1}, {"id": "b"}]}, {"other": 1}, {"candidates": []}], "candidates": [{"id": "hidden"}]}
    (tmp_path / "one.json").write_text(json.dumps(one, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"candidates": [{"id": "c", "n": 3, "more": True}], "title": "x"}, indent=2))
    (tmp_path / "three.json").write_text("{}")
    paths = [str(tmp_path / x) for x in ("one.json", "absent.json", "two.json", "three.json")]
    found = readers.read_replacements(spark, paths, "id string, n int")
    assert sorted(map(tuple, found.collect())) == [("a", 1), ("b", None), ("c", 3)]
    empty = readers.read_replacements(spark, paths[1:2], "id string, n int")
    assert empty.count() == 0 and empty.columns == ["id", "n"]
