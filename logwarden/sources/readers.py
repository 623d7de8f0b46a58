"""Event sources: files by type, request bodies, batches of dictionaries, and streams. All give a raw column of JSON text."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input types by file ending.
TYPES = {".evtx": "evtx", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".xml": "xml", ".csv": "csv", ".log": "auditd"}


def input_type(path: str) -> str:
    return TYPES.get(PurePosixPath(path.lower()).suffix, "json")


#: Bytes up to which a file that begins with [ is read as one array; a longer one is read by lines.
ARRAY_BYTES = 1 << 30
#: Files whose first characters are looked at together.
HEADS = 16
#: Rows that a task should take to parse and match.
TASK_ROWS = 50_000


def spread(rows: DataFrame, *by: str, most: int = TASK_ROWS) -> DataFrame:
    """rows in as many partitions as the cluster has cores, and of most rows each at most, by the values of by, if they come in fewer: one small file is one task otherwise, however much work each of its rows is, and a task's time and memory would follow the input. Rows of many partitions stay where they are. Rows are counted, which for files of columns reads their footers only."""
    wanted = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(wanted, *by) if rows.rdd.getNumPartitions() < wanted else rows


def malformed(raw: Column) -> Column:
    """Whether a text is no JSON object. Such lines are kept as events without fields."""
    return ~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(raw)), F.lit("OBJECT")), F.lit(False))


def _opens_array(spark: SparkSession, path: str) -> bool:
    """Whether a file's first character that is neither blank nor a byte order mark is [, and it isn't too long to be one row."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    fs = at.getFileSystem(conf)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
    stream = fs.open(at)
    try:
        source = codec.createInputStream(stream) if codec else stream
        while block := bytes(source.readNBytes(4096)):
            if head := block.removeprefix(b"\xef\xbb\xbf").strip():
                return head[:1] == b"[" and fs.getFileStatus(at).getLen() <= ARRAY_BYTES
        return False
    finally:
        stream.close()


def _as_path(spark: SparkSession, uri: str) -> str:
    """The path, as readers take it, of a file by its URI: nothing in its name is a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString())


def _elements(text: Column) -> Column:
    """The elements of a text that is one array and nothing else; null otherwise. Spark's parser passes over what follows a value, so a mark is put behind it that must be found."""
    mark = uuid.uuid4().hex
    pair = F.from_json(F.concat(F.lit("["), text, F.lit(f',"{mark}"]')), "array<variant>")
    whole = F.when((F.size(pair) == 2) & (F.try_variant_get(F.get(pair, F.lit(1)), "$", "string") == mark), F.get(pair, F.lit(0)))
    return F.transform(F.try_variant_get(whole, "$", "array<variant>"), lambda v: F.to_json(v))


def _events_of_lines(lines: Column) -> Column:
    """The events of an array of lines: blank ones are passed over, one that is a whole array gives its elements, any other is one as it is."""
    own = lambda x: F.when(F.startswith(F.ltrim(x), F.lit("[")), _elements(x))
    return F.flatten(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.coalesce(own(x), F.array(x))))


def read_json(spark: SparkSession, path: str | list[str], layout: str = "auto") -> DataFrame:
    """Events of files of lines, or of files that each are one array. No line is lost: one that can't be read is an event as it is.

    layout: lines, array, or auto: an array if the file's first character
    is [. For that the first bytes of each file are read, nothing else. What begins as an array
    and isn't one is taken as lines. A file that is an array is one row of
    one task.
    """
    if layout not in ("auto", "lines", "array"):
        raise ValueError(f"unknown layout {layout!r}")
    paths = path if isinstance(path, list) else [path]
    whole = paths if layout == "array" else []
    if layout == "auto":
        files = spark.read.text(paths).inputFiles()
        with ThreadPoolExecutor(HEADS) as pool:
            arrays = list(pool.map(lambda f: _opens_array(spark, f), files))
        if any(arrays):
            named = [_as_path(spark, f) for f in files]
            whole, paths = [f for f, a in zip(named, arrays, strict=True) if a], [f for f, a in zip(named, arrays, strict=True) if not a]
    parts = []
    if whole:
        text = spark.read.text(whole, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value")).select(F.explode(F.coalesce(_elements(F.col("value")), _events_of_lines(F.split("value", "\r\n|\n")))).alias("raw"))
        parts.append(text)
    if layout != "array" and (paths or not whole):
        parts.append(spark.read.text(paths).select(F.explode(_events_of_lines(F.array("value"))).alias("raw")))
    return reduce(DataFrame.unionByName, parts)


def read_json_array(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files that each are one array, over several lines."""
    return read_json(spark, path, "array")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw"))


def read_xml(spark: SparkSession, path: str, row_tag: str = "Event") -> DataFrame:
    """Windows event XML: System fields and named Data values in one flat object; other XML by its elements."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).load(path)
    if "EventData" not in rows.columns or "System" not in rows.columns:
        return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("raw"))
    names = rows.schema["System"].dataType.names
    plain = [n for n in names if not hasattr(rows.schema["System"].dataType[n].dataType, "names")]
    parts = [F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"System.{n}").cast("string").alias("value")) for n in plain]))]
    if "TimeCreated" in names:
        parts.append(F.create_map(F.lit("SystemTime"), F.col("System.TimeCreated._SystemTime")))
    data = rows.schema["EventData"].dataType["Data"].dataType
    items = F.col("EventData.Data") if data.typeName() == "array" else F.array("EventData.Data")
    parts.append(F.map_from_entries(F.transform(F.filter(items, lambda d: d["_Name"].isNotNull()), lambda d: F.struct(d["_Name"].alias("key"), d["_VALUE"].alias("value")))))
    return rows.select(F.to_json(F.map_filter(F.map_concat(*parts), lambda _, v: v.isNotNull())).alias("raw"))


def read_auditd(spark: SparkSession, path: str) -> DataFrame:
    """Lines of k=v pairs; quotes around values are dropped. msg=audit(time:serial) also gives SystemTime and serial."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.regexp_extract_all("value", F.lit(r"([A-Za-z_][\w-]*)=(\"[^\"]*\"|'[^']*'|\S*)"), F.lit(1))
    values = F.transform(F.regexp_extract_all("value", F.lit(r"([A-Za-z_][\w-]*)=(\"[^\"]*\"|'[^']*'|\S*)"), F.lit(2)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    # Of a repeated key the first stays.
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    flat = F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))
    seconds = F.regexp_extract("value", r"audit\((\d+)(?:\.\d+)?:(\d+)\)", 1)
    time = F.when(seconds != "", F.date_format(F.timestamp_seconds(seconds.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"))
    extra = F.map_filter(F.create_map(F.lit("SystemTime"), time), lambda _, v: v.isNotNull())
    return lines.select(F.to_json(F.map_concat(flat, extra)).alias("raw"))


def read_evtx(spark: SparkSession, path: str) -> DataFrame:
    """Binary Windows logs, by the optional package evtx."""
    try:
        import evtx  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading .evtx files takes the optional package evtx") from e

    def parse(batches):
        import io

        import pandas as pd
        from evtx import PyEvtxParser

        for b in batches:
            yield pd.DataFrame({"raw": [r["data"] for c in b["content"] for r in PyEvtxParser(io.BytesIO(c)).records_json()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, "raw string")


_READERS = {"json": read_json, "csv": read_csv, "xml": read_xml, "auditd": read_auditd, "sysmon_linux": read_xml, "evtx": read_evtx}


def read_events(spark: SparkSession, path: str, kind: str | None = None, source_label: str | None = None) -> DataFrame:
    """raw and source_batch of a file or folder; the label is the file's stem by default."""
    kind = kind or input_type(path)
    if kind not in _READERS:
        raise ValueError(f"unknown input type {kind!r}")
    return _READERS[kind](spark, path).withColumn("source_batch", F.lit(source_label or PurePosixPath(path).stem))


def parse_body(body: str) -> list[dict]:
    """A request body: lines of JSON objects, or one array of them."""
    text = body.strip()
    if text.startswith("["):
        rows = json.loads(text)
    else:
        rows = [json.loads(line) for line in text.splitlines() if line.strip()]
    if not all(isinstance(r, dict) for r in rows):
        raise ValueError("events are objects")
    return rows


def from_dicts(spark: SparkSession, events: Iterable[dict], source_label: str) -> DataFrame:
    """raw and source_batch of events in memory; none is an error."""
    rows = [(json.dumps(e, ensure_ascii=False, default=str),) for e in events]
    if not rows:
        raise ValueError("no events")
    return spark.createDataFrame(rows, "raw string").withColumn("source_batch", F.lit(source_label))


def stream_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New NDJSON files under path as they come; each file's stem is its label, without the number of a flush."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[0-9a-f]{32})?(\.[^.]*)?$", 1)
    return lines.where(F.trim("value") != "").select(F.col("value").alias("raw"), stem.alias("source_batch"))
