"""Readers and writers of JSON lines, CSV, pages and keyed tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvelo.operators.checks import require_rows
from corvelo.schemas import PAPER, RECONCILED, require_columns


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of papers; a broken line fails the read, a missing authors list is empty."""
    return spark.read.schema(PAPER).option("mode", "FAILFAST").json(path).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))


def read_reconciled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECONCILED).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant reader: no file gives no rows, blank lines are skipped, a broken line raises with its number."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    if bad := parsed.where("r._bad IS NOT NULL").select("value").take(1):
        number = spark.sparkContext.textFile(path).zipWithIndex().filter(lambda x, text=bad[0][0]: x[0] == text).map(lambda x: x[1] + 1).take(1)
        raise ValueError(f"{path}: line {number[0] if number else '?'} is not JSON")
    return parsed.select("r.*").drop("_bad")


def read_csv(spark: SparkSession, path: str | list[str], *required: str) -> DataFrame:
    """CSV of strings with a header, quotes doubled, lines within quotes; a byte-order mark is dropped."""
    frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    frame = frame.toDF(*(c.lstrip("﻿") for c in frame.columns))
    return require_columns(frame, *required)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A country panel; the code must be unique."""
    from corvelo.operators.checks import require_unique

    return require_unique(read_csv(spark, path, "country_code", "country_name"), ["country_code"])


def read_many(spark: SparkSession, glob: str) -> DataFrame:
    """Text files whole, with their path for the order of files."""
    return spark.read.option("wholetext", True).text(glob).withColumn("path", F.col("_metadata.file_path"))


def write_json_lines(frame: DataFrame, path: str, mode: str = "error") -> int:
    """Writes JSON lines and returns how many lines there are at `path`. (Counted in what was written: an
    observation of the write would stay with the session and keep trained pipelines from running in it.)"""
    frame.write.mode(mode).option("ignoreNullFields", False).json(path)
    return frame.sparkSession.read.text(path).count()


def write_csv(frame: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """CSV with a header in a fixed order of columns; raises for no rows. What is at `path` stays until the
    new table is whole, see `replace_table`."""
    rows = require_rows(frame)
    replace_table(rows.select(*columns) if columns else rows, path, lambda w: w.option("header", True).option("escape", '"').csv)


def replace_table(frame: DataFrame, path: str, writer: Callable) -> None:
    """Writes a table aside and puts it in the place of the one at `path` by renaming. A failure before that
    leaves the old table, one between the two renamings puts it back. `frame` may read from `path`.
    `writer` makes of a DataFrameWriter a function of the path."""
    spark = frame.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    target = Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    tag = uuid.uuid4().hex
    fresh, old = (Path(target.getParent(), f"_{target.getName()}-{kind}-{tag}") for kind in ("new", "old"))
    try:
        writer(frame.write)(fresh.toString())
        had = files.exists(target)
        if had and not files.rename(target, old):
            raise OSError(f"cannot move {path} aside")
        if not files.rename(fresh, target):
            if had:
                files.rename(old, target)
            raise OSError(f"cannot put the new table at {path}")
        if had:
            files.delete(old, True)
    finally:
        files.delete(fresh, True)


def write_manifest(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """A manifest (path, bytes, sha256) of files; raises where one is missing."""
    hadoop = spark._jsc.hadoopConfiguration()
    missing = [p for p in paths if not (w := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(hadoop).exists(w)]
    if missing:
        raise ValueError(f"missing inputs: {missing}")
    manifest = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    manifest.orderBy("path").coalesce(1).write.mode("overwrite").option("header", True).csv(out)  # a row a file of the bundle
    return manifest


def write_bundle(spark: SparkSession, named: dict[str, str], folder: str, **about: str) -> DataFrame:
    """Copies files (published name: source path) into a folder, compares the hash of every copy with its
    source's, and writes source-manifest.json (`about` and the files) and SHA256SUMS beside them. Missing
    sources are all named before anything is written; a differing copy raises. Returns the manifest
    (published_file, source_artifact, bytes, sha256), a row a file of the bundle."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    at = lambda p: (Path(p).getFileSystem(hadoop), Path(p))
    missing = [p for p in named.values() if not at(p)[0].exists(at(p)[1])]
    if missing:
        raise FileNotFoundError(f"missing inputs: {missing}")
    for name, source in named.items():
        jvm.org.apache.hadoop.fs.FileUtil.copy(*at(source), *at(f"{folder}/{name}"), False, True, hadoop)
    hashed = lambda paths: {r.path: r for r in spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).collect()}
    whole = lambda p: at(p)[0].makeQualified(at(p)[1]).toString()
    sources, copies = hashed(list(named.values())), hashed([f"{folder}/{n}" for n in named])
    rows = []
    for name, source in named.items():
        one, two = sources[whole(source)], copies[whole(f"{folder}/{name}")]
        if one.sha256 != two.sha256:
            raise RuntimeError(f"copied file hash mismatch: {name}")
        rows.append((name, source, two.bytes, two.sha256))
    fields = ("published_file", "source_artifact", "bytes", "sha256")

    def put(name: str, text: str) -> None:
        files, path = at(f"{folder}/{name}")
        stream = files.create(path, True)
        stream.write(text.encode())
        stream.close()

    put("source-manifest.json", json.dumps(about | {"files": [dict(zip(fields, r)) for r in rows]}, ensure_ascii=False, indent=2) + "\n")
    put("SHA256SUMS", "".join(f"{r[3]}  {r[0]}\n" for r in rows))
    return spark.createDataFrame(rows, "published_file string, source_artifact string, bytes bigint, sha256 string")


def markdown_table(frame: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row `report`: a Markdown table of a small result."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = F.array_sort(F.collect_list(F.struct(order, line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("line"))))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    return frame.agg(F.concat(F.lit(head), F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("report"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed table with rows inserted or replaced."""
    from corvelo.operators.records import replace_group

    return replace_group(table, rows, keys)


def fresh(table: DataFrame, now: Column, days: int, at: str = "retrieved_at") -> DataFrame:
    """Cached rows not older than a number of days."""
    return table.where(F.col(at) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def crossref_papers(items: DataFrame, venue: str, container: str, volume: str | None = None) -> DataFrame:
    """Papers of bibliographic items (JSON in `item`) of a container and volume."""
    schema = "DOI string, title array<string>, author array<struct<given:string,family:string>>, `container-title` array<string>, volume string, URL string, published struct<`date-parts`:array<array<int>>>"
    r = items.select(F.from_json("item", schema).alias("i")).select("i.*").where(F.array_contains("container-title", container))
    r = r.where(F.col("volume") == volume) if volume else r
    names = F.filter(F.transform(F.coalesce("author", F.array()), lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), lambda n: n != "")
    return r.select(F.lower("DOI").alias("paper_id"), F.lit(venue).alias("venue_key"), F.get(F.get(F.col("published")["date-parts"], F.lit(0)), F.lit(0)).alias("year"), F.get("title", F.lit(0)).alias("title"), names.alias("authors"), F.lower("DOI").alias("doi"), F.col("URL").alias("official_url")).where("title IS NOT NULL")


def openreview_papers(notes: DataFrame, venue: str, order: str) -> DataFrame:
    """Papers of notes (JSON in `note`), values wrapped or not, the first of each id, titles required."""
    from corvelo.functions.text import normalize_space
    from corvelo.operators.records import first_per_key

    value = lambda name: F.coalesce(F.get_json_object("note", f"$.content.{name}.value"), F.get_json_object("note", f"$.content.{name}"))
    rows = notes.select(order, F.get_json_object("note", "$.id").alias("paper_id"), F.lit(venue).alias("venue_key"), normalize_space(value("title")).alias("title"), F.coalesce(F.from_json(value("authors"), "array<string>"), F.array().cast("array<string>")).alias("authors"))
    return first_per_key(rows.where(F.length("title") > 0), ["paper_id"], [F.col(order)])


def search_results(payloads: DataFrame) -> DataFrame:
    """Search results (JSON in `response` of two providers' shapes) as rows with tags stripped."""
    from corvelo.functions.text import strip_tags
    from corvelo.functions.web import source_authority

    one = "struct<title:string,url:string,description:string,content:string,age:string,published_date:string>"
    r = payloads.select("query", F.from_json("response", f"struct<web:struct<results:array<{one}>>,results:array<{one}>>").alias("r"))
    each = r.select("query", F.posexplode(F.coalesce("r.web.results", "r.results")).alias("at", "x")).where(F.length("x.url") > 0)
    return each.select("query", "at", strip_tags(F.col("x.title")).alias("title"), F.col("x.url").alias("url"), strip_tags(F.coalesce("x.description", "x.content")).alias("snippet"), F.coalesce("x.age", "x.published_date").alias("published_at"), source_authority(F.col("x.url")).alias("source_rank"))


def world_bank_rows(pages: DataFrame, panel: DataFrame) -> DataFrame:
    """Observations of panel countries with a value from indicator pages (JSON in `page`)."""
    each = pages.select(F.explode(F.from_json("page", "array<struct<countryiso3code:string,country:struct<id:string>,indicator:struct<id:string>,date:string,value:double>>")).alias("x")).select("x.*")
    rows = each.select(F.col("country.id").alias("country_code"), F.col("indicator.id").alias("indicator_code"), F.col("date").try_cast("int").alias("year"), "value").where("value IS NOT NULL")
    return rows.join(F.broadcast(panel.select("country_code")), "country_code", "left_semi")


def read_pdf_text(spark: SparkSession, glob: str, pages: int = 2) -> DataFrame:
    """Text of the first pages of PDF files (path, text); needs a PDF library on the workers."""
    try:
        import pypdf  # noqa: F401
    except ImportError as missing:
        raise RuntimeError("reading PDF needs the package pypdf; supply texts instead") from missing

    @F.pandas_udf("string")
    def extract(contents):
        import io

        import pypdf

        return contents.map(lambda c: "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(c)).pages[:pages]))

    return spark.read.format("binaryFile").load(glob).select("path", extract("content").alias("text"))


def read_conference_csv(spark: SparkSession, path: str, venue: str, year: int) -> DataFrame:
    """Papers of an exported list (DOI, Title, Authors): resolver prefixes dropped, `and` between names."""
    from corvelo.functions.text import split_authors

    rows = read_csv(spark, path, "DOI", "Title", "Authors")
    doi = F.lower(F.regexp_replace("DOI", r"^https?://(?:dx\.)?doi\.org/", ""))
    return rows.select(doi.alias("paper_id"), F.lit(venue).alias("venue_key"), F.lit(year).alias("year"), F.trim("Title").alias("title"), split_authors(F.col("Authors")).alias("authors"), doi.alias("doi"))
