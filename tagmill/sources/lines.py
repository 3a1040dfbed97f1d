"""Command lines as rows of events: one parse for batch files and streams.

Plain lines (EVENT in:<word> entity:<word> and bare key:value tags) are cut up by Spark's own expressions; every other
line, refused ones included, goes through the parser of tagmill.lang, in Python. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.lang.parser import MAX_CUSTOM_TAGS, MAX_ENTITY
from tagmill.lang.tokens import KEYWORDS, MAX_COMMAND, CommandError
from tagmill.lang.validate import SYSTEM, read

EVENT_LINE = "ns string, entity_str string, entity_i64 long, tags map<string,string>, tags_i64 map<string,long>, tag_order array<string>, error string, line string, arrival long, source string, pos long"
_ARROW = pa.schema(
    [
        ("ns", pa.string()),
        ("entity_str", pa.string()),
        ("entity_i64", pa.int64()),
        ("tags", pa.map_(pa.string(), pa.string())),
        ("tags_i64", pa.map_(pa.string(), pa.int64())),
        ("tag_order", pa.list_(pa.string())),
        ("error", pa.string()),
        ("line", pa.string()),
        ("arrival", pa.int64()),
        ("source", pa.string()),
        ("pos", pa.int64()),
    ]
)
_FREE = rf"(?!(?:{'|'.join(sorted(KEYWORDS))})(?![A-Za-z0-9_.-]))"
_KEY, _VALUE = rf"{_FREE}[A-Za-z_][A-Za-z0-9_]{{0,63}}", rf"{_FREE}(?:[0-9]{{1,18}}(?![A-Za-z0-9_.-])|[A-Za-z0-9_.-]*[A-Za-z_.-][A-Za-z0-9_.-]*)"
_NS = rf"{_FREE}(?!{SYSTEM}(?![A-Za-z0-9_.-]))(?![0-9]+(?![A-Za-z0-9_.-]))[A-Za-z0-9_-]{{1,64}}"
#: What Spark's expressions may cut up; its key and value tokens are short of every limit of the language.
PLAIN = rf"(?i)\AEVENT in:{_NS} entity:{_VALUE}(?: {_KEY}:{_VALUE}){{0,{MAX_CUSTOM_TAGS}}}[\r\n]*\z"


def parse_event(line: str) -> dict:
    """The fields of one EVENT line, or its error."""
    try:
        command = read(line.rstrip("\r\n"))
        if command.kind != "event":
            raise CommandError("Only EVENT commands can be ingested")
    except CommandError as e:
        return {"error": str(e)}
    entity = command.get("entity")
    text = isinstance(entity, str)
    tags = command.custom()
    return {
        "ns": command.get("in"),
        "entity_str": entity if text else None,
        "entity_i64": None if text else entity,
        "tags": [(t.key, str(t.value)) for t in tags],
        "tags_i64": [(t.key, t.value) for t in tags if isinstance(t.value, int)],
        "tag_order": [t.key for t in tags],
        "error": None,
    }


def _parsed_in_python(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [parse_event(x["line"] or "") | x for x in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return lines.mapInArrow(run, EVENT_LINE)


def _parsed_in_spark(lines: DataFrame) -> DataFrame:
    """Lines that fit PLAIN and repeat no key."""
    number = lambda v: F.when(v.rlike(r"\A[0-9]+\z"), v.cast("long"))
    cut = lines.select("line", "arrival", "source", "pos", "_k", F.regexp_extract_all("line", F.lit(r" [A-Za-z0-9_]+:([A-Za-z0-9_.-]+)"), F.lit(1)).alias("_v"))
    cut = cut.select("line", "arrival", "source", "pos", F.slice(F.transform("_k", F.lower), 3, 256).alias("tag_order"), F.transform("_v", F.lower).alias("_v"))
    cut = cut.withColumns({"_entity": F.get("_v", F.lit(1)), "_own": F.slice("_v", 3, 256)}).withColumn("_n", F.transform("_own", number))
    as_text = F.zip_with("_own", "_n", lambda v, n: F.coalesce(n.cast("string"), v))
    numbers = F.filter(F.arrays_zip(F.col("tag_order").alias("k"), F.col("_n").alias("n")), lambda x: x["n"].isNotNull())
    entity = number(F.col("_entity"))
    return cut.select(
        F.get("_v", F.lit(0)).alias("ns"), F.when(entity.isNull(), F.col("_entity")).alias("entity_str"), entity.alias("entity_i64"),
        F.map_from_arrays("tag_order", as_text).alias("tags"), F.map_from_entries(numbers).alias("tags_i64"), "tag_order",
        F.lit(None).cast("string").alias("error"), "line", "arrival", "source", "pos",
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """EVENT_LINE rows of lines (line, arrival in ms, source, pos); a refused line keeps its error and has no event."""
    keys = F.when(F.col("line").rlike(PLAIN), F.regexp_extract_all("line", F.lit(r" ([A-Za-z0-9_]+):"), F.lit(1)))
    told = lines.select("line", "arrival", "source", "pos", keys.alias("_k"))
    text_entity = F.regexp_extract("line", r"(?i) entity:([A-Za-z0-9_.-]+)", 1)
    plain = F.col("_k").isNotNull() & (F.length("line") <= MAX_COMMAND) & (F.size(F.array_distinct(F.transform("_k", F.lower))) == F.size("_k")) & (F.length(text_entity) <= MAX_ENTITY) & ~F.exists(F.regexp_extract_all("line", F.lit(r":([A-Za-z0-9_.-]+)"), F.lit(1)), lambda v: F.length(v) > 100)
    told = told.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    return _parsed_in_spark(told.where("_plain")).union(_parsed_in_python(told.where("not _plain").select("line", "arrival", "source", "pos")))


def text_lines(spark: SparkSession, path: str, arrival: int) -> DataFrame:
    """The lines of text files with their file and their order in it."""
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.lit(arrival).cast("long").alias("arrival"), F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("pos"))
    return raw.where(F.length(F.trim("line")) > 0)
