"""Sources and sinks: JSON lines with key checks, XML snapshots, replacement unions, traces."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeflow.functions.text import section_key
from citeflow.operators.positions import evenly_spaced  # noqa: F401
from citeflow.operators.tables import read_note, stored, write_note

# Fixed values of the snapshot format.
BODY = ("P", "NOTE", "EXAMPLE", "XREF", "FP")
NUMBER = re.compile(r"^\D*([0-9]+[A-Za-z]?(?:\.[0-9A-Za-z-]+)*)\s*[-‐‑‒–—]?\s*")
PART = re.compile(r"(?:PART\s+)?([0-9]+[A-Za-z]?)", re.I)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Blank lines are skipped; a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_sections(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Sections by unique normalised key; a repeated one raises."""
    df = read_json_lines(spark, path, schema).withColumn("section_key", section_key(F.col("section")))
    twice = df.groupBy("section_key").count().where("count > 1").orderBy("section_key").limit(5).collect()
    if twice:
        raise ValueError("duplicate sections: " + ", ".join(r.section_key for r in twice))
    return df


def read_records(spark: SparkSession, path: str, field: str = "records") -> DataFrame:
    """The rows of an array inside a JSON document."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(field))


def prefer_split(rows: DataFrame, split: str = "development") -> DataFrame:
    """Rows of the split if there is any, else all."""
    some = rows.agg(F.coalesce(F.max(F.col("split") == split), F.lit(False)).alias("_some"))
    return rows.crossJoin(F.broadcast(some)).where(~F.col("_some") | (F.col("split") == split)).drop("_some")


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Rows of files whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].upper()


def _text(e: ET.Element | None) -> str:
    return " ".join(" ".join(e.itertext()).split()) if e is not None else ""


def _sections(e: ET.Element, part: str, asked: str) -> Iterator[tuple[str, str, str, str]]:
    """(part, section, heading, text) below ``e``; the part comes from the nearest PART above."""
    for child in e:
        kind, inner = (child.get("TYPE") or "").upper(), part
        if _name(child).startswith("DIV"):
            head = next((x for x in child.iter() if _name(x) == "HEAD"), None)
            if kind == "PART":
                inner = next((m[1] for x in (child.get("N") or "", _text(head)) if (m := PART.search(x))), part)
            if kind == "SECTION":
                heading = _text(head)
                if m := NUMBER.match(heading):
                    body = [heading[m.end() :], *(_text(x) for x in child.iter() if _name(x) in BODY)]
                    yield part or asked or m[1].split(".")[0], m[1], heading, "\n".join(b for b in body if b)
                continue
        yield from _sections(child, inner, asked)


XML_COLUMNS = "title int, part string, section string, heading string, text string, version_date string, source_url string"


def read_xml_sections(spark: SparkSession, path: str, *, title: int = 12, version: str, part: str = "") -> DataFrame:
    """(title, part, section, heading, text, version_date, source_url) of XML snapshot files.

    A file is parsed in one piece by the task that reads it; sections without a number are left out."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(title, *r, version, f"https://www.ecfr.gov/on/{version}/title-{title}/section-{r[1]}") for raw in f.content for r in _sections(ET.fromstring(raw), "", part)]
            yield pd.DataFrame(rows, columns=["title", "part", "section", "heading", "text", "version_date", "source_url"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, XML_COLUMNS)


_DIV = re.compile(r"<(/?)(DIV\w*)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_ATTRIBUTE = re.compile(r"""\b(TYPE|N)\s*=\s*("[^"]*"|'[^']*')""", re.I)
_HEAD = re.compile(r"\s*<HEAD\b[^>]*>(.*?)</HEAD>", re.I | re.S)


def _piece(raw: str, tag: str) -> tuple[str | None, str | None]:
    """(the part that the last PART tag of a piece opens, empty where it is closed again; the section that
    ends the piece). A piece is what stands between two ends of sections."""
    part, start = None, None
    for m in _DIV.finditer(raw):
        name, attributes = m[2].upper(), {k.upper(): v[1:-1] for k, v in _ATTRIBUTE.findall(m[3])}
        if m[1]:
            part = "" if name == "DIV5" else part
        elif attributes.get("TYPE", "").upper() == "PART":
            head = _HEAD.match(raw, m.end())
            part = next((x[1] for t in (attributes.get("N", ""), re.sub(r"<[^>]*>", " ", head[1]) if head else "") if (x := PART.search(t))), "")
        elif name == tag and attributes.get("TYPE", "").upper() == "SECTION":
            start = m.start()
    return part, None if start is None else f"<X>{raw[start:]}</{tag}></X>"


def scan_xml_sections(spark: SparkSession, path: str, *, title: int = 12, version: str, part: str = "", tag: str = "DIV8") -> DataFrame:
    """``read_xml_sections`` for files larger than a task: Spark splits them where sections end.

    Sections are ``tag`` elements that do not hold one another; parts are DIV5. Each piece of a file that
    ends with a section is parsed alone. The part that it stands in is the last that was opened before it,
    in its own stretch of the file or, from one number a stretch, in those before it. A snapshot in which
    ``tag`` is written in another way, or sections are nested, is for ``read_xml_sections``.
    """
    lines = spark.read.option("lineSep", f"</{tag}>").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [_piece(raw, tag) for raw in f.value]
            yield pd.DataFrame({"file": f.file, "block": f.block, "at": f["at"], "opened": [o for o, _ in found], "section": [x for _, x in found]})

    pieces = stored(lines.mapInPandas(split, "file string, block long, at long, opened string, section string"), "pieces")
    ends = pieces.where("opened is not null").groupBy("file", "block").agg(F.max_by("opened", "at").alias("left"))
    blocks = pieces.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("carried", F.last("left", ignorenulls=True).over(before)).drop("left")
    here = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("inside", F.last("opened", ignorenulls=True).over(here)).where("section is not null").join(blocks, ["file", "block"])
    placed = placed.select(F.coalesce("inside", "carried", F.lit("")).alias("part"), "section")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(title, *r, version, f"https://www.ecfr.gov/on/{version}/title-{title}/section-{r[1]}") for p, raw in zip(f.part, f.section, strict=True) for r in _sections(ET.fromstring(raw), p, part)]
            yield pd.DataFrame(rows, columns=["title", "part", "section", "heading", "text", "version_date", "source_url"])

    return placed.mapInPandas(parse, XML_COLUMNS)


def write_xml_snapshot(sections: DataFrame, path: str) -> None:
    """Sections (part, section, heading, text) as XML snapshot files, in order of part and section.

    A file opens its part again where the part goes on in the next file; lines of a text are paragraphs.
    Characters that XML cannot hold become spaces."""
    bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
    clean = lambda t: escape(bad.sub(" ", t or ""))

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first = None, True
        for f in frames:
            out = ["<ECFR>"] if first and len(f) else []
            first = first and not len(f)
            for r in f.itertuples():
                if r.part != part:
                    out += ["</DIV5>"] if part is not None else []
                    part = r.part
                    out.append(f'<DIV5 N="{clean(part)}" TYPE="PART"><HEAD>PART {clean(part)}</HEAD>')
                body = "".join(f"<P>{clean(t)}</P>" for t in (r.text or "").split("\n"))
                out.append(f'<DIV8 N="{clean(r.section)}" TYPE="SECTION"><HEAD>{clean(r.heading)}</HEAD>{body}</DIV8>')
            yield pd.DataFrame({"value": out})
        if not first:
            yield pd.DataFrame({"value": ["</DIV5>", "</ECFR>"]})

    dealt = sections.select(F.coalesce("part", F.lit("")).alias("part"), "section", "heading", "text").repartitionByRange("part", "section").sortWithinPartitions("part", "section")
    dealt.mapInPandas(lines, "value string").write.text(path)


#: Folders that traces are dealt to by the hash of their run.
TRACE_FOLDERS = 256


def write_traces(traces: DataFrame, path: str, folders: int = TRACE_FOLDERS) -> None:
    """Traces (run_id and others, one row a run) where ``read_trace`` finds them. Ids that are no names of
    traces raise before anything is written, as do repeated ones."""
    bad = traces.where(F.col("run_id").isNull() | (F.col("run_id") == "") | F.col("run_id").rlike(r"[\\/.]")).limit(1).collect()
    if bad:
        raise ValueError(f"bad trace id: {bad[0].run_id!r}")
    twice = traces.groupBy("run_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated trace id: {twice[0].run_id}")
    dealt = traces.withColumn("folder", F.pmod(F.xxhash64("run_id"), F.lit(folders)).cast("int"))
    dealt.repartition("folder").sortWithinPartitions("folder", "run_id").write.partitionBy("folder").parquet(path)
    write_note(traces.sparkSession, f"{path}/_folders", {"folders": folders})


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("folder")


def read_trace(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The trace of one run: one folder is listed, and in it only files and row groups that may have the id
    are read. Bad ids and unknown ones raise."""
    trace_name(run_id)
    folders = read_note(spark, f"{path}/_folders")["folders"]
    folder = spark.range(1).select(F.pmod(F.xxhash64(F.lit(run_id)), F.lit(folders)).cast("int")).first()[0]
    found = spark.read.parquet(path).where((F.col("folder") == folder) & (F.col("run_id") == run_id)).drop("folder")
    if found.isEmpty():
        raise KeyError(f"no trace {run_id}")
    return found


def read_replacements(spark: SparkSession, paths: list[str], candidate: str) -> DataFrame:
    """Replacement candidates of several JSON files; ``candidate`` is their fields as DDL.

    A file is an object with ``groups`` of ``candidates``, or one with ``candidates`` alone; where it has
    both, the groups count. Files that are not there are left out; where none is, the result is empty."""
    items = f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in candidate.split(','))}>>"
    shape = f"groups array<struct<candidates:{items}>>, candidates {items}"
    found = [x for x in paths if _is_there(spark, x)]
    if not found:
        return spark.createDataFrame([], candidate)
    files = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(found)
    grouped = F.flatten(F.transform(F.filter("groups", lambda g: g["candidates"].isNotNull()), lambda g: g["candidates"]))
    return files.select(F.inline(F.when(F.col("groups").isNotNull(), grouped).otherwise(F.col("candidates"))))


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def trace_name(run_id: str) -> str:
    """The file name of a run's trace; ids that could leave the folder are refused."""
    if not run_id or re.search(r"[\\/.]", run_id):
        raise ValueError("bad trace id")
    return f"{run_id}.json"


def write_json_rows(df: DataFrame, path: str, *, append: bool = False) -> None:
    """JSON lines by Spark's committer: readers see all of a write or none."""
    df.write.mode("append" if append else "overwrite").json(path)


def manifest(df: DataFrame, *, name: str, version: str) -> str:
    """Row count and an order-free content hash as JSON."""
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return json.dumps({"name": name, "schema_version": version, "rows": n, "content": str(total or 0), "columns": df.columns})
