"""One folder per subject, one CSV per kind of reading.

Each kind is read with one multi-file scan per header over all subject folders.
Which subjects own which files comes from the scan's file listing, so a file
that holds no row still counts as present.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.functions import scalars

# Columns of the seven reading files. Timestamps stay text here
# and are converted leniently afterwards.
FILE_SCHEMAS = {
    "daily_questions": "timeStampScheduled string, timeStampSent string, timeStampStart string, "
    "timeStampStop string, originalTimeStampSent string, timeZoneOffset string, "
    "deltaUTC string, stress double, anxiety double",
    "sleep": "timestamp string, overall_score double, deep_sleep_in_minutes double",
    "activity_level": "timestamp string, level string",
    "steps": "timestamp string, steps double",
    "hrv": "timestamp string, rmssd double, coverage double, low_frequency double, high_frequency double",
    "oxygen": "timestamp string, value double",
    "stress": "DATE string, UPDATED_AT string, STRESS_SCORE double, CALCULATION_FAILED boolean",
}
MODALITIES = list(FILE_SCHEMAS)
WEARABLE_MODALITIES = ["sleep", "activity_level", "steps", "hrv", "oxygen"]
NOT_VALUES = {
    "timestamp",
    "DATE",
    "UPDATED_AT",
    "timeStampScheduled",
    "timeStampSent",
    "timeStampStart",
    "timeStampStop",
    "originalTimeStampSent",
    "timeZoneOffset",
    "deltaUTC",
}

_FOLDER = r"([^/]+)/[^/]+$"


def schema_of(modality: str) -> T.StructType:
    kinds = {"string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    pairs = [field.split() for field in FILE_SCHEMAS[modality].split(",")]
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in pairs])


def value_columns(modality: str) -> list[str]:
    return [f.name for f in schema_of(modality).fields if f.name not in NOT_VALUES]


# Texts that count as missing besides the empty one.
MISSING = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]


Headers = dict[tuple[str, ...], list[str]]


def line_facts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, header, lines, checksum) of every file that holds a line.

    The checksum is a sum of line hashes: it does not depend on the order of
    lines, as no daily column does, and a large file is summed in pieces.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    return lines.groupBy("path").agg(
        F.min_by("value", F.when(F.col("_block") == 0, F.col("_at"))).alias("header"),
        F.count("*").alias("lines"),
        F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("checksum"),
    )


def column_names(header: str) -> tuple[str, ...]:
    return tuple(n.strip() for n in next(csv.reader([header.lstrip("\ufeff")]), []))


def _headers(spark: SparkSession, pattern: str) -> Headers:
    """Paths by the column names in their first line.

    One line per file comes to the driver, which has to list the files anyway.
    """
    found: Headers = {}
    for row in line_facts(spark, pattern).select("path", "header").toLocalIterator():
        found.setdefault(column_names(row.header), []).append(row.path)
    return found


def _typed(column: Column, kind: T.DataType) -> Column:
    """A cell as its type; missing texts, unreadable ones and NaN give null."""
    text = F.when(~F.trim(column).isin(["", *MISSING]), F.trim(column))
    if isinstance(kind, T.DoubleType):
        return scalars.number(text)
    return text.try_cast(kind)


def scan_modality(spark: SparkSession, root: str, modality: str, subject: str = "subject_id") -> DataFrame:
    """All readings of one kind; the subject is the folder name, digits only.

    Files are read by column name: columns may come in any order, unknown ones
    are ignored and absent ones are null. Files with the same header share one scan.
    """
    try:
        headers = _headers(spark, f"{root}/*/{modality}.csv")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        headers = {}
    return scan_files(spark, headers, modality, subject).drop("path")


def scan_files(spark: SparkSession, headers: Headers, modality: str, subject: str = "subject_id") -> DataFrame:
    """Readings of one kind from given files, (path, subject, columns of the kind)."""
    schema = schema_of(modality)
    path = F.col("_metadata.file_path")
    front = [T.StructField("path", T.StringType()), T.StructField(subject, T.StringType())]
    scans = [spark.createDataFrame([], T.StructType([*front, *schema.fields]))]
    for names, paths in sorted(headers.items()):
        texts = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        raw = spark.read.schema(texts).option("header", True).option("encoding", "UTF-8").csv(paths)
        cells = {n: F.col(f"_c{i}") for i, n in reversed(list(enumerate(names)))}
        typed = [
            (_typed(cells[f.name], f.dataType) if f.name in cells else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
        scans.append(raw.select(path.alias("path"), F.regexp_extract(path, _FOLDER, 1).alias(subject), *typed))
    union = reduce(DataFrame.unionByName, scans[1:] or scans)
    return union.where(F.col(subject).rlike("^[0-9]+$"))


def list_files(spark: SparkSession, root: str, subject: str = "subject_id") -> DataFrame:
    """(path, length, modified, subject, modality) of every reading file, those without a row too.

    Only the listing is read, not the files; Spark leaves out files of no bytes.
    """
    path = F.col("_metadata.file_path")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(f"{root}/*/*.csv")
    return found.select(
        path.alias("path"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
        F.regexp_extract(path, _FOLDER, 1).alias(subject),
        F.regexp_extract(path, r"([^/]+)\.csv$", 1).alias("modality"),
    ).where(F.col(subject).rlike("^[0-9]+$") & F.col("modality").isin(MODALITIES))
