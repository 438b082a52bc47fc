"""Scans: note folders, the curated and serving tables, knowledge documents, vectors."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW, SERVING, VECTOR, conform


def clean_text(value: Column) -> Column:
    """Bad UTF-8 bytes replaced, and every line end as ``\\n``."""
    text = F.make_valid_utf8(value)
    text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(text, F.lit("\r"), F.lit("\n"))


def base_name() -> Column:
    """Base name of the file a row came from. It arrives URL-encoded; a literal
    plus is protected first, since decoding turns it into a blank."""
    encoded = F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(encoded)


def folder_name() -> Column:
    """Last folder of the path that a row came from, for files that are told apart by it."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def _as_raw(files: DataFrame, name: Column | None = None) -> DataFrame:
    named = base_name() if name is None else name
    return conform(files.select(clean_text(F.col("value")).alias("raw_text"), named.alias("file_name")), RAW)


def _missing(path: str, error: AnalysisException, hint: str) -> Exception:
    if error.getCondition() == "PATH_NOT_FOUND":
        return FileNotFoundError(f"{hint} not found: {path}")
    return error


def read_notes(
    spark: SparkSession, folder: str, check: bool = True, nested: bool = False, name: Column | None = None
) -> DataFrame:
    """One row per ``.txt`` file of ``folder``: ``raw_text``, ``file_name``.

    ``nested`` looks into subfolders; ``name`` is another column than the base name, :func:`folder_name` say.
    Fails on a missing folder; with ``check`` also on one without ``.txt`` files,
    which reads a single file at most.
    """
    try:
        # wholetext must be an argument: the argument's default overrides an option.
        reader = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(nested).lower())
        files = reader.text(folder, wholetext=True)
    except AnalysisException as error:
        raise _missing(folder, error, "note folder") from error
    if check and files.isEmpty():
        raise ValueError(f"no .txt files in {folder}")
    return _as_raw(files, name)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Notes that :func:`sinks.pack_notes` has packed: as :func:`read_notes` gives them, from few files."""
    try:
        return conform(spark.read.parquet(path).select(*RAW.names), RAW)
    except AnalysisException as error:
        raise _missing(path, error, "packed notes") from error


def stream_notes(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same scan as a stream over files that keep arriving."""
    reader = spark.readStream.schema("value string").option("pathGlobFilter", "*.txt")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _as_raw(reader.text(folder, wholetext=True))


def read_knowledge(spark: SparkSession, folder: str) -> DataFrame:
    """Knowledge documents as ``doc_id`` (file name) and ``text``."""
    notes = read_notes(spark, folder)
    return notes.select(F.col("file_name").alias("doc_id"), F.col("raw_text").alias("text"))


def read_curated(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise _missing(path, error, "curated table") from error


def read_serving(
    spark: SparkSession, path: str, json_array: bool = False, missing_ok: bool = False
) -> DataFrame:
    """The serving set, read with its declared schema.

    ``json_array`` reads a file that holds one JSON array instead of JSON lines.
    ``missing_ok`` gives an empty set instead of an error when nothing is there.
    """
    try:
        return spark.read.schema(SERVING).json(path, multiLine=json_array)
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], SERVING)
        raise _missing(path, error, "serving set") from error


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    try:
        return conform(spark.read.parquet(path), VECTOR)
    except AnalysisException as error:
        raise _missing(path, error, "vector table") from error
