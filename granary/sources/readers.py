"""Sources: files by suffix, tolerant records, catalogs of local datasets, databases, streams of files.

Every source yields a DataFrame with an explicit schema or Spark's own; rows get keys from columns, not from positions.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FORMATS = {".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".orc": "orc", ".txt": "text"}


def format_of(path: str) -> str:
    """The reader for a path by its suffix; Parquet for folders without one."""
    name = path.rstrip("/").removesuffix(".gz").removesuffix(".zst")
    return next((f for s, f in FORMATS.items() if name.endswith(s)), "parquet")


def read(spark: SparkSession, *paths: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Files, folders or globs of one format; several are read as one table."""
    kind = format_of(paths[0])
    reader = spark.read.options(**({"header": True, "sep": "\t" if ".tsv" in paths[0] else ","} if kind == "csv" else {}) | options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(kind).load(list(paths))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def resolve(spark: SparkSession, name: str, split: str = "train", roots: tuple[str, ...] = (".",), schema=None) -> DataFrame:
    """A dataset by name: a table of the catalog, a path, or <root>/<name>/<split> with any suffix; no network."""
    if re.fullmatch(r"\w+(\.\w+){0,2}", name) and not re.match(r"[0-9]|\w*\.[0-9]", name) and spark.catalog.tableExists(name):
        return spark.table(name)
    if any(name.endswith(s) for s in FORMATS) or "://" in name:
        return read(spark, name, schema=schema)
    for root in roots:
        base = f"{root.rstrip('/')}/{name}"
        for path in (f"{base}/{split}", *(f"{base}/{split}{s}" for s in FORMATS), base):
            if exists(spark, path):
                return read(spark, path, schema=schema)
    raise FileNotFoundError(f"no dataset {name} with split {split} under {', '.join(roots)}")


def read_tolerant(spark: SparkSession, path: str, schema: StructType, key: str = "id", defaults: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are none): unknown fields dropped, missing ones defaulted, the last of equal keys kept.

    The order of lines is their file and the place in it, which the text reader's rows keep within a split.
    """
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select("value", place.alias("place")).where("trim(value) <> ''")
    wide = StructType([*schema.fields, StructField("_broken", StringType())])
    parsed = lines.withColumn("r", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    bad = parsed.where("r is null or r._broken is not null").select("value")
    good = parsed.where("r is not null and r._broken is null").select("place", "r.*").drop("_broken")
    for name, value in (defaults or {}).items():
        good = good.withColumn(name, F.coalesce(name, F.lit(value)))
    others = [c for c in schema.names if c != key]
    last = good.groupBy(key).agg(F.max_by(F.struct(*others), "place").alias("r"))
    return last.select(*[F.col(key) if c == key else F.col("r")[c].alias(c) for c in schema.names]), bad


def read_shards(spark: SparkSession, glob: str, schema=None, column: str = "file_id") -> DataFrame:
    """All files of a glob, each row with its file's name without folders and suffix."""
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.[^.]+$", "")
    return read(spark, glob, schema=schema).withColumn(column, name)


def tag_files(spark: SparkSession, tags: dict[str, str], column: str = "dataset", schema=None) -> DataFrame:
    """Several files as one table, each row with its file's tag."""
    out = None
    for path, tag in tags.items():
        part = read(spark, path, schema=schema).withColumn(column, F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


_MAIN, _REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(raw: bytes, sheet: str | None) -> list[list[str | None]]:
    """The rows of one sheet of a workbook (an archive of XML parts), the first one by default; cells as text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = {s.get("name"): targets[s.get(_REL)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        part = sheets[sheet] if sheet else next(iter(sheets.values()))
        root = ElementTree.fromstring(z.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
    out = []
    for row in root.iter(f"{_MAIN}row"):
        line: list[str | None] = []
        for cell in row.iter(f"{_MAIN}c"):
            at = 0
            for letter in re.match("[A-Z]*", cell.get("r") or "")[0]:
                at = at * 26 + ord(letter) - 64
            line += [None] * (at - 1 - len(line))
            value = cell.find(f"{_MAIN}v")
            text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
            line.append(shared[int(text)] if cell.get("t") == "s" and text is not None else text)
        out.append(line)
    return out


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of one sheet of spreadsheet workbooks as text, named by the first line; missing cells are null.

    A workbook is parsed by one task; a folder of them by several. All must have the first one's columns.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    header = next(iter(_cells(files.first()["content"], sheet)), [])
    names = [h or f"column_{i}" for i, h in enumerate(header)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                rows = [(line + [None] * len(names))[: len(names)] for line in _cells(raw, sheet)[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=names)

    return files.mapInArrow(run, StructType([StructField(n, StringType()) for n in names]))


def read_database(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A database table or query over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def stream(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.schema(schema).options(**options).format(format_of(path)).load(path)


def with_key(df: DataFrame, name: str, order: list[Column | str], column: str = "id") -> DataFrame:
    """Rows without an id get ``name_<hash>`` of the ordering columns: stable under any split, unlike a row number."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("string") if column in df.columns else F.lit(None).cast("string"), F.concat(F.lit(name + "_"), F.sha2(F.to_json(F.struct(*order)), 256))))
