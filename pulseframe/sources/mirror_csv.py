"""Mirror CSV: scan and export.

Files are read by the names in their own headers: those with the same header are one scan with the
schema of that header, and the scans are united by name, so older files with fewer columns, newer
ones with more and files in another order give the same typed rows.
"""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pulseframe import schema as S
from pulseframe.functions import clean as C
from pulseframe.functions.metrics import with_catalog
from pulseframe.operators.workouts import expand_deletes, unpivot_workout

OPTIONAL_DEFAULTS = {"op": "upsert"}
#: columns without which a file means nothing; an upsert row without ``hk_uuid`` fails later
REQUIRED = ("timestamp", "metric_type", "metric_value")
_FILES = "path string, modificationTime timestamp, length long, content binary"


class HeaderError(ValueError):
    """A mirror file lacks a column it cannot do without."""


def read_mirror_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Text rows of mirror files with their order, in the columns of a full mirror file.

    A column that a file does not have is NULL, a missing operation an upsert; columns unknown here
    are left out; a file without a required column raises :class:`HeaderError`; one without a header
    has no rows. Rows wider than their header keep its columns and are flagged in the corrupt-record
    column. Cells may hold quoted line breaks: uploads are at most 200 MB, so a file is not split;
    larger files are, unless one of their cells is found to go over lines.
    """
    listed = spark.read.format("binaryFile").load([path] if isinstance(path, str) else list(path)).select("path", "length")
    sizes = {r.path: r.length for r in listed.collect()}  # names only, one row a file; contents are not read
    scans = defaultdict(list)
    over_lines = _over_lines(spark, [p for p, n in sizes.items() if n > S.MAX_UPLOAD_BYTES])
    for file, header in zip(sizes, _headers(spark, list(sizes))):
        if header:
            scans[header, sizes[file] <= S.MAX_UPLOAD_BYTES or file in over_lines].append(file)
    rows = spark.createDataFrame([], T.StructType([*S.MIRROR_TEXT.fields, T.StructField("_place", _PLACE)]))
    for (header, whole), files in scans.items():
        missing = [c for c in REQUIRED if c not in header]
        if missing:
            raise HeaderError(f"no column {', '.join(missing)} in {len(files)} files, first {min(files)}")
        rows = rows.unionByName(_scan(spark, header, files, whole))
    return with_ordinal(rows)


def _headers(spark: SparkSession, files: list[str]) -> list[tuple[str, ...]]:
    """The header of each file, of which nothing but the first line is read."""
    hadoop = spark._jsc.hadoopConfiguration()
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop)

    def first_line(file: str) -> tuple[str, ...]:
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        stream, codec = at.getFileSystem(hadoop).open(at), codecs.getCodec(at)
        opened = stream if codec is None else codec.createInputStream(stream)
        try:
            line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(opened, "UTF-8")).readLine()
        finally:
            opened.close()
        cells = next(csv.reader([line.removeprefix("\ufeff")]), []) if line else []
        return tuple(c.strip() for c in cells)

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(inheritable_thread_target(spark)(first_line), files))


def _over_lines(spark: SparkSession, files: list[str]) -> set[str]:
    """Files in which some line has an odd number of quotes."""
    if not files:
        return set()
    odd = F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1
    return {r[0] for r in spark.read.text(files).filter(odd).select("_metadata.file_path").distinct().collect()}


def _scan(spark: SparkSession, header: tuple[str, ...], files: list[str], whole: bool) -> DataFrame:
    """Files of one header. The first of equal names counts; a mirror file's names are taken as they
    are and all others by place, so that they cannot clash."""
    names = [c if c in S.MIRROR_COLUMNS and c not in header[:i] else f"_other{i}" for i, c in enumerate(header)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*names, S.CORRUPT_COLUMN)])
    rows = spark.read.schema(schema).options(
        header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=S.CORRUPT_COLUMN, multiLine=whole,
        # cells keep their blanks here; blank-to-NULL is an explicit later step
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=True,
    ).csv(files)
    return with_optional_columns(_placed(rows)).select(*S.MIRROR_COLUMNS, S.CORRUPT_COLUMN, "_place")


def stream_mirror_files(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Names of the files of a landing folder, each once, at most ``max_files`` a micro-batch; their
    rows are read per micro-batch with :func:`read_mirror_csv`, since headers differ."""
    stream = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", max_files)
    return stream.load(path).select("path")


_PLACE = T.StructType([
    T.StructField("file_modification_time", T.TimestampType()), T.StructField("file_path", T.StringType()),
    T.StructField("file_block_start", T.LongType()),
])


def _placed(df: DataFrame) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    )
    return df.withColumn("_place", place)


def with_ordinal(df: DataFrame) -> DataFrame:
    """Order of rows for rules in which the last row wins: older files first, then by
    position. The row number grows within a split, and splits carry their own offset."""
    return df.withColumn("ordinal", F.struct("_place", F.monotonically_increasing_id().alias("row"))).drop("_place")


def with_optional_columns(df: DataFrame) -> DataFrame:
    """Add mirror columns an older file does not have; a missing operation is an upsert."""
    missing = {
        c: F.lit(OPTIONAL_DEFAULTS.get(c)).cast("string")
        for c in S.MIRROR_COLUMNS if c not in df.columns
    }
    return df.withColumns(missing) if missing else df


def export_mirror(samples: DataFrame) -> DataFrame:
    """Samples as mirror rows, all text, in header order.

    Unknown metrics and non-finite values are not exported; line breaks become blanks.
    """
    stage = F.col("metric_type").like("sleep_%") & (F.col("metric_type") != "sleep_hours")
    known = with_catalog(samples.filter(~stage)).withColumn("unit", F.col("unit_label"))
    stages = samples.filter(stage).withColumn("unit", F.lit("min"))
    cols = [*samples.columns]
    rows = known.select(*cols).unionByName(stages.select(*cols)).filter(C.is_finite(F.col("metric_value")))

    def iso(c: str):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))

    end = F.when(F.col("end_ts") != F.col("ts"), F.col("end_ts"))
    text = {
        "timestamp": iso("ts"),
        "metric_value": C.four_decimals(F.col("metric_value")),
        "source": C.one_line(F.col("hk_source_name")),
        "timezone": F.coalesce("meta.tz_name", F.lit("")),
        "utc_offset_min": F.coalesce(F.col("meta.utc_offset_min").cast("string"), F.lit("")),
        "created_at": iso("created_at"),
        "op": F.lit("upsert"),
        "end_ts": F.coalesce(F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")),
        "hk_source_name": C.one_line(F.col("hk_source_name")),
        "hk_source_version": C.one_line(F.col("hk_source_version")),
        "hk_metadata": C.one_line(F.col("hk_metadata")),
    }
    plain = ("user_id", "metric_type", "unit", "hk_uuid")
    return rows.select(
        *[
            text[c].alias(c) if c in text
            else F.col(c) if c in plain
            else F.lit("").alias(c)
            for c in S.MIRROR_COLUMNS
        ]
    )


def export_workouts(workouts: DataFrame) -> DataFrame:
    """Workouts as mirror rows, one for each attribute that has a value."""
    rows = unpivot_workout(workouts).withColumnsRenamed({"event_type": "metric_type", "value": "metric_value"})
    rows = rows.filter(C.is_finite(F.col("metric_value")))
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    text = {"timestamp": stamp("ts"), "end_ts": stamp("end_ts"), "metric_value": C.four_decimals(F.col("metric_value")), "op": F.lit("upsert")}
    rows = rows.withColumn("source", F.col("workout_type")) if "workout_type" in rows.columns else rows
    plain = {c for c in ("user_id", "metric_type", "unit", "hk_uuid", "source") if c in rows.columns}
    return rows.select(*(text.get(c, C.one_line(F.col(c)) if c in plain else F.lit("")).alias(c) for c in S.MIRROR_COLUMNS))


def export_deletes(deleted: DataFrame) -> DataFrame:
    """Delete rows of a delta: an id may be a sample's or a workout's, so each is stated in every form."""
    ids = expand_deletes(deleted.select("user_id", "hk_uuid"))
    return ids.select(*(F.col(c) if c in ("user_id", "hk_uuid", "op") else F.lit("").alias(c) for c in S.MIRROR_COLUMNS))


def export_delta(samples: DataFrame, workouts: DataFrame, deleted: DataFrame) -> DataFrame:
    """Everything a delta upload carries."""
    return export_mirror(samples).unionByName(export_workouts(workouts)).unionByName(export_deletes(deleted))


def write_mirror_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)
