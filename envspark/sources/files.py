"""File sources (S1-S5) and the measurement sink.

* ``list_files``      recursive listing with size and suffix, no content read (binaryFile prunes content).
* ``detect_type``     magic bytes -> suffix for downloads without a usable name (S4).
* ``format_gate``     accepted / rejected by suffix for automatic or manual mode (S3).
* ``expand_zip``      archive members as chunks of lines (S5), so neither an archive nor a member stands in one row;
                      ``read_zip_members`` parses delimited members straight from those rows.
* ``read_delimited``  delimited files -> staging rows (S1, S2): delimiter sniffed per file from its header
                      line, latin-1 fallback, BOM removed; files sharing a header are read by one scan.
* ``write_measurements`` a versioned table partitioned by variable_code (S11, L6).
"""

from __future__ import annotations

import io
import re
import zipfile
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from envspark import vocab
from envspark.operators.normalize import HELPERS, normalize_frame, quoted
from envspark.schema import STAGING
from envspark.sources import blocks as B
from envspark.sources import versions as V

# Magic numbers.
RAR_MAGIC = b"Rar!\x1a\x07"
ZIP_MAGIC = b"PK\x03\x04"
# Candidate delimiters counted in the header line, in preference order on ties.
DELIMITERS = (",", ";", "\t", "|")


def _suffix(path_col):
    return F.lower(F.regexp_extract(path_col, r"(\.[^./]+)$", 1))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under root (recursive), with name, suffix and size; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), _suffix(F.col("path"))
                     .alias("suffix"), "length", "modificationTime")


def detect_type(content_col, content_type: F.Column | None = None) -> F.Column:
    """S4: '.rar' / '.zip' by magic bytes, '.xlsx' by a spreadsheet's content type, else '.bin'."""
    head6 = F.substring(content_col, 1, 6)
    head4 = F.substring(content_col, 1, 4)
    kind = (F.when(head6 == F.lit(bytearray(RAR_MAGIC)), F.lit(".rar"))
            .when(head4 == F.lit(bytearray(ZIP_MAGIC)), F.lit(".zip")))
    if content_type is not None:
        kind = kind.when(F.lower(content_type).rlike("spreadsheetml|ms-excel"), F.lit(".xlsx"))
    return kind.otherwise(F.lit(".bin"))


def format_gate(files: DataFrame, mode: str = "manual") -> DataFrame:
    """S3: accepted flag by suffix (automatic: .rar .zip .xlsx .xls; manual: .csv .xlsx .txt)."""
    allowed = vocab.AUTOMATIC_SUFFIXES if mode == "automatic" else vocab.MANUAL_SUFFIXES
    return files.withColumn("accepted", F.col("suffix").isin(list(allowed)))


def located(spark: SparkSession, root: str) -> DataFrame:
    """Every file under root with its URI (``file``), name, suffix and length; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return df.select("path", F.col("_metadata.file_path").alias("file"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                     _suffix(F.col("path")).alias("suffix"), "length")


def expand_zip(spark: SparkSession, root: str, chunk: int = B.CHUNK) -> DataFrame:
    """The members of every .zip under root as chunks of lines (``blocks.CHUNKS``). Broken archives and members that
    cannot be read are rows with an error. File and member names reach the driver, as they make the tasks."""
    archives = [(r["file"], r["length"]) for r in located(spark, root).where("suffix = '.zip'").select("file", "length").collect()]
    return expand_located(spark, sorted(archives), chunk)


def expand_located(spark: SparkSession, archives: list[tuple[str, int]], chunk: int = B.CHUNK) -> DataFrame:
    """Chunks of the members of (URI, length) archives; archives in stores that only Spark reads stand in one row each."""
    near = [a for a in archives if B.opens(a[0])]
    far = [readable_path(uri) for uri, _ in archives if not B.opens(uri)]
    listed = sorted(B.zip_directory(spark, near).collect(), key=lambda r: (r["archive"], r["number"] or 0)) if near else []
    bad = [(r["archive"], r["member"], r["number"], None, None, None, None, r["error"]) for r in listed if r["error"]]
    out = B.zip_chunks(spark, [(r["archive"], r["number"], r["length"]) for r in listed if not r["error"]], chunk)
    if bad:
        out = out.unionByName(spark.createDataFrame(bad, B.CHUNKS))
    if far:
        whole = spark.read.format("binaryFile").load(far).select(F.col("_metadata.file_path").alias("path"), "content")
        out = out.unionByName(expand_archives(whole, chunk))
    return out


def expand_archives(archives: DataFrame, chunk: int = B.CHUNK) -> DataFrame:
    """(path, content) rows of zip archives -> chunks of their members. One archive is one row here, so it may have 2 GB
    at most; its members are streamed, so they may be larger."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                        for number, info in enumerate(archive.infolist()):
                            if not info.is_dir():
                                yield from B.as_batches(B.member_chunks(archive, path, number, chunk))
                except B.UNREADABLE as error:
                    yield from B.as_batches(iter([(path, None, None, None, None, None, None, f"not a readable zip archive: {error}")]))

    return archives.select("path", "content").mapInArrow(run, B.CHUNKS)


def read_zip_members(spark: SparkSession, root: str, dayfirst: bool = False,
                     wide_axis: str = "station") -> DataFrame:
    """S5 -> S1 without landing files: delimited members of every archive become staging rows.

    Members are decoded (UTF-8, else ISO-8859-1) line by line, the first line with text is the header; lines are parsed with
    ``from_csv`` per distinct (header, delimiter) layout and normalised like any delimited file.
    """
    return parse_members(spark, expand_zip(spark, root), dayfirst, wide_axis)


def parse_members(spark: SparkSession, chunks: DataFrame, dayfirst: bool = False, wide_axis: str = "station",
                  keep_file: bool = False, rejects: bool = False) -> DataFrame:
    """Chunks of delimited archive members -> staging rows. ``keep_file`` adds ``source_path``: the archive, a line end and
    the member; ``rejects`` see ``normalize_frame``."""
    utf8 = F.expr("is_valid_utf8(cast(content AS STRING))")
    text = lambda c, good: F.when(good, F.col(c).cast("string")).otherwise(F.decode(F.col(c), "ISO-8859-1"))
    file = F.concat_ws("\n", "archive", "member").alias("_file")
    chunks = chunks.where(F.col("content").isNotNull())
    files = chunks.groupBy(file).agg(F.min(utf8).alias("_good"), F.first("head").alias("head"))
    files = files.withColumn("header", text("head", F.col("_good")))
    files = files.select("_file", "_good", "header", _best_delimiter(F.col("header")).alias("sep"))
    layouts = files.select("header", "sep").distinct().collect()  # distinct layouts only
    out = None
    for lay in layouts:
        if not lay["header"] or not lay["header"].strip():
            continue
        cols = clean_header(_split_header(lay["header"], lay["sep"]))
        ddl = ", ".join(f"`c{i}` STRING" for i in range(len(cols)))
        own = files.where((F.col("header") == lay["header"]) & (F.col("sep") == lay["sep"])).select("_file", "_good")
        lines = chunks.withColumn("_file", file).join(F.broadcast(own), "_file").select(  # one row a member
            "_file", F.regexp_extract("member", r"([^/]+)$", 1).alias("_name"), "first_line", "head_line",
            F.posexplode(F.split(text("content", F.col("_good")), "\r?\n")).alias("_pos", "line"))
        body = lines.withColumn("_row", F.col("first_line") + F.col("_pos") - F.col("head_line") - 1).where("_row >= 0")
        body = body.withColumn("line", F.regexp_replace("line", "\r$", ""))
        parsed = body.select("_file", "_name", "_row", F.from_csv("line", ddl, {"sep": lay["sep"]}).alias("r"))
        frame = without_na(parsed.select("_file", "_name", "_row", *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(cols)]))
        staged = normalize_frame(frame, F.lit("data"), F.col("_name"), wide_axis=wide_axis, dayfirst=dayfirst,
                                 file_col="_file", keep_file=keep_file, rejects=rejects)
        out = staged if out is None else out.unionByName(staged)
    return out if out is not None else _no_rows(spark, keep_file, rejects)


def _no_rows(spark: SparkSession, keep_file: bool, rejects: bool) -> DataFrame:
    more = [c for c, wanted in (("source_path", keep_file), ("reject", rejects)) if wanted]
    return spark.createDataFrame([], T.StructType([*STAGING.fields, *(T.StructField(c, T.StringType()) for c in more)]))


def clean_header(cells: list[str]) -> list[str]:
    """Column names of a header: blank ones are numbered by place, a name seen before gets its place added, and none is one
    of the names this library adds to a frame."""
    names, seen = [], set()
    for i, cell in enumerate(cells):
        name = cell.lstrip("\ufeff").strip() or f"unnamed_{i}"
        if name in HELPERS or name.lower() in seen:
            name = f"{name} {i}"
        seen.add(name.lower())
        names.append(name)
    return names


def escaped(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def readable_path(uri: str) -> str:
    """The path of a file URI as Spark's readers take it."""
    return escaped(unquote(uri))


def url_decoded(c: F.Column) -> F.Column:
    """Percent escapes decoded; "+" is no blank in a path."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def without_na(df: DataFrame) -> DataFrame:
    """Cells that spell a missing value become null."""
    return df.select(*[quoted(c) if c in HELPERS else F.when(~quoted(c).isin(*vocab.MISSING), quoted(c)).alias(c)
                       for c in df.columns])


def _split_header(header: str, sep: str) -> list[str]:
    import csv

    return next(csv.reader([header], delimiter=sep))


def _best_delimiter(header):
    counts = [F.size(F.split(header, "\\" + d if d in "|" else d)) - 1 for d in DELIMITERS]
    best = F.lit(DELIMITERS[0])
    best_n = counts[0]
    for d, c in zip(DELIMITERS[1:], counts[1:]):
        best = F.when(c > best_n, F.lit(d)).otherwise(best)
        best_n = F.greatest(best_n, c)
    return best


# ---------------------------------------------------------------------------------------------------------
# Delimited files
# ---------------------------------------------------------------------------------------------------------

def sniff(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Per file: header line, delimiter (most frequent of , ; tab | in the header), encoding.

    The header is the first line of the file's first split that is not blank; latin-1 is chosen when any line of the file is
    not valid UTF-8. One aggregation over the text of the files.
    """
    txt = (spark.read.option("lineSep", "\n").text([escaped(p) for p in paths])
           .select("value", F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("pos")))
    candidate = (F.col("block") == 0) & (F.trim(F.regexp_replace("value", "[\ufeff\r]", "")) != "")
    first = F.min_by(F.when(candidate, F.col("value")), F.when(candidate, F.col("pos")))
    agg = txt.groupBy("file").agg(first.alias("header"),
                                  F.max((~F.expr("is_valid_utf8(value)")).cast("int")).alias("bad_utf8"))
    best = _best_delimiter(F.col("header"))
    return agg.select("file", F.regexp_replace(F.regexp_replace("header", "^﻿", ""), "\r$", "").alias("header"),
                      best.alias("sep"),
                      F.when(F.col("bad_utf8") == 1, F.lit("iso-8859-1")).otherwise(F.lit("UTF-8")).alias("encoding"))


def with_row_index(df: DataFrame, file_col: str = "_file") -> DataFrame:
    """0-based row index within each file without gathering a file into one task.

    Rows of a file inside one Spark partition are contiguous and monotonically_increasing_id is consecutive
    there, so per (file, partition) the smallest id and the row count give the offset; a running sum over
    those few groups gives the file-level start of each partition.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.spark_partition_id())
    parts = tagged.groupBy(file_col, "_pid").agg(F.min("_mid").alias("_first"), F.count("*").alias("_cnt"))
    w = Window.partitionBy(file_col).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # one row a file and partition, so the rows stay where they were read
    return (tagged.join(F.broadcast(offs.select(file_col, "_pid", "_first", "_off")), [file_col, "_pid"])
            .withColumn("_row", F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_mid", "_pid", "_first", "_off"))


def read_delimited(spark: SparkSession, paths: list[str], dayfirst: bool = False, wide_axis: str = "station",
                   multi_line: bool = False, keep_file: bool = False, rejects: bool = False) -> DataFrame:
    """Delimited files -> staging rows (N1-N17), one scan per distinct (header, delimiter, encoding).

    The per-file header/delimiter table is small (one row per file) and is collected to plan the scans.
    ``multi_line`` allows quoted fields spanning lines (each file is then read by one task); ``keep_file`` adds the
    file's path as ``source_path``.
    """
    layouts = sniff(spark, paths).where(F.col("header").isNotNull() & (F.trim("header") != "")).collect()
    groups: dict[tuple, list[str]] = {}
    for r in layouts:
        groups.setdefault((r["header"], r["sep"], r["encoding"]), []).append(r["file"])
    out = None
    for (_header, sep, enc), files in groups.items():
        raw = (spark.read.option("header", "true").option("sep", sep).option("encoding", enc)
               .option("mode", "PERMISSIVE").option("multiLine", multi_line)
               .csv([readable_path(f) for f in files]))
        # Spark's own names of blank and repeated headers carry their place
        cells = [re.sub(r"^_c\d+$", "", c) for c in raw.columns]
        raw = raw.toDF(*clean_header(cells)).withColumn("_file", F.col("_metadata.file_path"))
        raw = with_row_index(without_na(raw))
        name = url_decoded(F.regexp_extract(F.col("_file"), r"([^/]+)$", 1))
        staged = normalize_frame(raw, F.lit("data"), name, wide_axis=wide_axis, dayfirst=dayfirst,
                                 file_col="_file", keep_file=keep_file, rejects=rejects)
        out = staged if out is None else out.unionByName(staged)
    return out if out is not None else _no_rows(spark, keep_file, rejects)


# ---------------------------------------------------------------------------------------------------------
# Sink
# ---------------------------------------------------------------------------------------------------------

def write_measurements(df: DataFrame, table_dir: str, replace_variables: list[str] | None = None) -> int:
    """Write facts as a versioned table (``sources.versions``) partitioned by variable_code, sorted within files by
    (station, observed_at) so min/max statistics prune time ranges; returns the version.

    The variables of the rows are replaced, other variables keep their folders. With ``replace_variables`` only rows of
    those variables count, and those without fresh rows are gone. One manifest is the last step: a failure before it, or
    within it, leaves the version before readable.
    """
    codes = None if replace_variables is None else set(replace_variables)
    rows = df if codes is None else df.where(F.col("variable_code").isin(*codes))
    rows = rows.hint("rebalance", F.col("variable_code")).sortWithinPartitions("station_code", "observed_at")
    return V.commit(rows, table_dir.rstrip("/"), ["variable_code"], drop=lambda values: codes is not None and values[0] in codes)
