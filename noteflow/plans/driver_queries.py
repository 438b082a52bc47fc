"""Every registered query: a callable of (spark, sf_dir) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import HashedWords
from ..operators import approximate, conversations, neighbours, records, reports, retrieval, vector_index
from ..schemas import SERVING
from ..sources import readers, sinks, tables
from ..sources.work import work_path, written
from ..streaming import changes, ingest, turns
from ..streaming.ingest import run_curated_stream
from . import batch_job

LISTED = ["file_name", *SERVING.names]


# ---- inputs ----------------------------------------------------------------

def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.notes(spark, sf_dir).transform(records.curate)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curated(spark, sf_dir).transform(records.with_points)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "conversations")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as ``query_id, text``."""
    turns = conversations.user_turns(messages(spark, sf_dir))
    return turns.select(_query_id(), "text")


def _query_id():
    return F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id")


def chunk_index(spark: SparkSession, sf_dir: str) -> str:
    """Path of the vector index of all document chunks, built once per application."""
    path = _own_path(spark, sf_dir, "chunk-index")
    made = []

    def vectors() -> DataFrame:
        # the model runs once: pivots and placement both read the vectors. The Python form, since chunks come from Python
        made.append(written(retrieval.vector_table(tables.documents(spark, sf_dir), HashedWords()), "chunk-vectors"))
        return made[0]

    if vector_index.build_once(spark, path, vectors):
        # the index has every column of it
        for file in made[0].inputFiles():
            place = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            break
    return path


def _own_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A path in the shared folder that is new unless this session has made it for the same tables.

    It goes when the session ends; a table that changes its files gets another.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listing = [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(place)]
    key = (spark.sparkContext.applicationId, sf_dir, name, *sorted(listing))
    if key not in _OWN_PATHS:
        _OWN_PATHS[key] = work_path(spark, name)
    return _OWN_PATHS[key]


_OWN_PATHS: dict[tuple, str] = {}


# ---- extraction and quality ------------------------------------------------

def extract_fields(spark, sf_dir):
    return tables.notes(spark, sf_dir).transform(records.extract_fields)


def quality_scores(spark, sf_dir):
    return curated(spark, sf_dir)


def quality_counts(spark, sf_dir):
    return reports.confidence_counts(curated(spark, sf_dir))


def record_counts(spark, sf_dir):
    return reports.record_counts(curated(spark, sf_dir))


def serving_set(spark, sf_dir):
    return records.serving_set(curated(spark, sf_dir))


def serving_round_trip(spark, sf_dir):
    """Curated table written, serving set written from it as JSON and read back."""
    table, serving = _own_path(spark, sf_dir, "curated"), _own_path(spark, sf_dir, "serving")
    sinks.materialise_once(
        spark, table, lambda: sinks.write_curated(curated(spark, sf_dir), table)
    )
    sinks.materialise_once(
        spark, serving, lambda: sinks.write_serving(readers.read_curated(spark, table), serving)
    )
    return readers.read_serving(spark, serving)


def stream_curated(spark, sf_dir):
    """The orders table read as a file stream, curated, appended, and read back."""
    orders = spark.readStream.schema(tables.table(spark, sf_dir, "orders").schema)
    keys = orders.option("pathGlobFilter", "orders.parquet").parquet(sf_dir).select("o_orderkey")
    notes = tables.notes_from_orders(keys.repartition(_note_tasks(spark, sf_dir), "o_orderkey"))
    path = _own_path(spark, sf_dir, "stream")
    return run_curated_stream(notes, f"{path}/table", f"{path}/checkpoint")


def _note_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the notes of a stream of all orders are dealt out to: a file of keys, a few bytes each, is read by one."""
    return tables.tasks_for(tables.table(spark, sf_dir, "orders").select("o_orderkey"), tables.NOTE_BYTES)


def _note_folder(keys: DataFrame, folder: str, named=lambda number: number % REWRITTEN) -> None:
    """A note per key, each in a file below a folder that bears its number, the key's rest; others stay as they are.

    ``named`` makes another number of the key's own. Notes of one number share a file, so it must keep keys apart.
    """
    number = named(F.regexp_extract("file_name", "([0-9]+)", 1).cast("long"))
    keys = tables.spread(keys, "o_orderkey", bytes_a_row=tables.FILE_BYTES)
    made = tables.notes_from_orders(keys).select("raw_text", number.alias("name"))
    # notes of one number are one file, as the writer by folder makes it
    joined = made.groupBy("name").agg(F.array_join(F.collect_list("raw_text"), "\n").alias("value"))
    named = F.coalesce(F.col("name").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    if not sinks.write_text_files(joined.select(F.concat(F.lit("name="), named, F.lit("/note.txt")).alias("path"), "value"), folder):
        by_name = tables.spread(made, "name", bytes_a_row=tables.FILE_BYTES)
        by_name.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(folder)


#: What is added to a key whose note is written anew.
REWRITTEN = 1_000_000


def changed_files(spark, sf_dir):
    """A folder of one note per supplier, taken in twice: every third file is written anew between the two runs."""
    table = _own_path(spark, sf_dir, "changes")
    if not sinks.is_complete(spark, table):
        folder = work_path(spark, "changing")
        keys = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_orderkey"))
        anew = keys.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") + REWRITTEN).alias("o_orderkey"))
        name = lambda path: F.regexp_extract(path, "name=([^/]+)/", 1)
        # a file keeps its supplier's whole number, whatever its note is made of
        supplier = lambda n: F.when(n >= REWRITTEN, n - REWRITTEN).otherwise(n)
        for version, named in ((keys, lambda n: n), (anew, supplier)):
            _note_folder(version, folder, named)
            changes.ingest_changes(spark, folder, table, nested=True, name=name)
    shown = F.when(F.col("file_name").rlike("^[0-9]+$"), (F.col("file_name").try_cast("long") % REWRITTEN).cast("string"))
    return changes.current(spark, table).withColumn("file_name", F.coalesce(shown, "file_name"))


def text_file_scan(spark, sf_dir):
    """Documents written as one ``.txt`` file each, read by the note scan and cut to lines again.

    The writer ends a file with a line end, which the text did not have.
    """
    folder = work_path(spark, "text-files")
    documents = tables.documents(spark, sf_dir).select("text")
    lots = -(-tables.table(spark, sf_dir, "documents").count() // LOT_FILES)
    if lots > 1:
        return _texts_in_lots(documents, folder, lots)
    name = F.concat(F.lit("part-"), F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"), F.lit(".txt"))
    if not sinks.write_text_files(documents.select(name.alias("path"), F.col("text").alias("value")), folder):
        documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)
    return _scanned(spark, folder)


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    found = readers.read_notes(spark, folder)
    return found.select(
        F.regexp_replace("raw_text", r"\n\z", "").alias("raw_text"), F.col("file_name").endswith(".txt").alias("is_text_file")
    )


#: Text files that are listed at once: the driver holds a status and a split of each.
LOT_FILES = 1 << 15


def _texts_in_lots(documents: DataFrame, folder: str, lots: int) -> DataFrame:
    """A file per document as ever, in folders of about ``LOT_FILES``, which are scanned one after the other.

    What a lot gives is kept in a table; then its files go, so that the disk does not hold all texts twice.
    """
    spark = documents.sparkSession
    kept = work_path(spark, "scanned-texts")
    named = documents.withColumn("id", F.monotonically_increasing_id())
    lot = F.concat(F.lit("lot="), F.pmod(F.xxhash64("id"), F.lit(lots)).cast("string"))
    path = F.concat(lot, F.lit("/part-"), F.lpad(F.col("id").cast("string"), 19, "0"), F.lit(".txt"))
    if not sinks.write_text_files(named.select(path.alias("path"), F.col("text").alias("value")), folder):
        by_lot = named.select("text", F.pmod(F.xxhash64("id"), F.lit(lots)).alias("lot"))
        by_lot.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("lot").text(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    tasks = tables.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    for own in [f.getPath() for f in files.listStatus(place) if f.isDirectory()]:
        # the scan makes a task of a few files
        _scanned(spark, own.toString()).coalesce(tasks).write.mode("append").parquet(kept)
        files.delete(own, True)
    return spark.read.schema("raw_text string, is_text_file boolean").parquet(kept)


def stream_counts(spark, sf_dir):
    """The counts that a stream leaves per micro-batch, added up: those of the batch job but for the serving set."""
    path = _own_path(spark, sf_dir, "counted-stream")
    if not sinks.is_complete(spark, f"{path}/metrics"):
        orders = spark.readStream.schema(tables.table(spark, sf_dir, "orders").schema)
        # the table in four files, one micro-batch each
        tables.table(spark, sf_dir, "orders").repartition(4, "o_orderkey").write.parquet(f"{path}/orders")
        keys = orders.option("maxFilesPerTrigger", 1).parquet(f"{path}/orders").select("o_orderkey")
        notes = tables.notes_from_orders(keys.repartition(max(spark.sparkContext.defaultParallelism, _note_tasks(spark, sf_dir) // 4), "o_orderkey"))
        ingest.run_counted_stream(notes, f"{path}/table", f"{path}/checkpoint", f"{path}/metrics")
    counted = spark.read.parquet(f"{path}/metrics")
    names = ("n_notes", "n_with_id", "n_high", "n_medium", "n_low", "n_serving")
    return counted.agg(*[F.sum(n).alias(n) for n in names])


def packed_note_scan(spark, sf_dir):
    """A note file per supplier, packed with its name and length and read from the packed table."""
    path = _own_path(spark, sf_dir, "packed-notes")
    if not sinks.is_complete(spark, path):
        folder = work_path(spark, "note-files")
        _note_folder(tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_orderkey")), folder, lambda n: n)
        sinks.pack_notes(spark, path, lambda: readers.read_notes(spark, folder, nested=True, name=readers.folder_name()))
    return readers.read_packed(spark, path).withColumn("file_name", F.regexp_replace("file_name", "^name=", ""))


def batch_counts(spark, sf_dir):
    """The counts that the batch job tells of its curated table and its serving set."""
    counts = batch_job.run_batch_on(tables.notes(spark, sf_dir), work_path(spark, "batch"))
    return spark.createDataFrame([counts], ", ".join(f"{name} long" for name in sorted(counts)))


# ---- risk ------------------------------------------------------------------

def risk_points(spark, sf_dir):
    return scored(spark, sf_dir).select("file_name", "patient_id", "risk_points", "risk_tier")


def risk_points_guideline(spark, sf_dir):
    rated = curated(spark, sf_dir).transform(records.with_guideline_points)
    return rated.select("file_name", "patient_id", "guideline_points", "guideline_tier")


def risk_signals(spark, sf_dir):
    rated = curated(spark, sf_dir).transform(records.with_signals)
    return rated.select("file_name", "patient_id", "signal_count", "signal_tier")


def risk_summary(spark, sf_dir):
    return reports.risk_summary(scored(spark, sf_dir))


def risk_crosstab(spark, sf_dir):
    return reports.risk_crosstab(curated(spark, sf_dir))


def risk_reasons(spark, sf_dir):
    rated = scored(spark, sf_dir).transform(records.with_reasons)
    return rated.select("file_name", "risk_tier", F.array_join("risk_reasons", "; ").alias("risk_reasons"))


def risk_bands(spark, sf_dir):
    rated = curated(spark, sf_dir).transform(records.with_bands)
    return rated.select("file_name", *[c for c in rated.columns if c.endswith("_band")])


def risk_caveat(spark, sf_dir):
    rated = scored(spark, sf_dir).transform(records.with_caveat)
    return rated.select("file_name", "risk_tier", "confidence_label", "score_caveat")


def intervention_plan(spark, sf_dir):
    rated = scored(spark, sf_dir).transform(records.with_intervention)
    return rated.select("file_name", "patient_id", "risk_tier", "action")


def diagnosis_rates(spark, sf_dir):
    rated = curated(spark, sf_dir).transform(records.with_readmission_rate)
    return rated.select("file_name", "diagnosis", "dx_key", "rate_pct")


def diagnosis_rates_from_table(spark, sf_dir):
    """Rates from a table: the ten of the guideline, and one for every third patient, looked for in id and diagnosis."""
    fixed = spark.createDataFrame(list(rules.READMISSION_RATES), "dx_key string, rate_pct int")
    orders = tables.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    own = orders.select(
        F.concat(F.lit("PAT-"), tables.patient_number(F.col("o_orderkey"))).alias("dx_key"),
        (F.col("o_orderkey") % 31).cast("int").alias("rate_pct"),
    )
    named = curated(spark, sf_dir).withColumn("named", F.concat_ws(" ", "patient_id", "diagnosis"))
    return records.with_rate_from(named, fixed.unionByName(own), "named").select("file_name", "named", "dx_key", "rate_pct")


# ---- the users' questions --------------------------------------------------

def top5_high_risk(spark, sf_dir):
    best = reports.highest_risk(scored(spark, sf_dir), 5)
    return best.select("file_name", "patient_id", "risk_points", "completeness_score")


def all_high_risk(spark, sf_dir):
    best = reports.highest_risk(scored(spark, sf_dir), None)
    return best.select("file_name", "patient_id", "risk_points", "completeness_score")


def low_confidence(spark, sf_dir):
    return reports.by_confidence(curated(spark, sf_dir), "LOW").select(*LISTED)


def no_follow_up(spark, sf_dir):
    return reports.no_follow_up(curated(spark, sf_dir)).select(*LISTED)


def over75_high_risk(spark, sf_dir):
    return reports.over_age_high_risk(scored(spark, sf_dir)).select(*LISTED, "risk_points")


def non_compliant(spark, sf_dir):
    return reports.non_compliant(curated(spark, sf_dir)).select(*LISTED)


def quality_issues(spark, sf_dir):
    return reports.quality_issues(curated(spark, sf_dir)).select(*LISTED, "missing_fields")


def missing_field_records(spark, sf_dir):
    return reports.quality_issues(curated(spark, sf_dir), any_missing=True).select(*LISTED, "missing_fields")


def chf_no_follow_up(spark, sf_dir):
    return reports.chf_no_follow_up(curated(spark, sf_dir)).select(*LISTED)


def patient_explain(spark, sf_dir):
    return _explained(reports.explain_patient(curated(spark, sf_dir), "PAT-0023"))


def patient_assessments(spark, sf_dir):
    return _explained(reports.assessments(curated(spark, sf_dir)))


def _explained(rated: DataFrame) -> DataFrame:
    reasons = F.array_join("risk_reasons", "; ").alias("risk_reasons")
    return rated.select("file_name", "patient_id", "risk_tier", "risk_points", reasons, "assessment")


def first_records(spark, sf_dir):
    return reports.first_records(serving_set(spark, sf_dir))


# ---- conversations ---------------------------------------------------------

def turn_routing(spark, sf_dir):
    routed = conversations.routes(messages(spark, sf_dir))
    return routed.select("conv_id", "turn", "route", F.array_join("path", " > ").alias("path"))


def turn_routing_stream(spark, sf_dir):
    """Routes and places of turns that arrive in three lots, each taken in by a stream started anew."""
    path = _own_path(spark, sf_dir, "turns")
    if not sinks.is_complete(spark, f"{path}/done"):
        talk = messages(spark, sf_dir).select("conv_id", "turn", "role", "text")
        for lot in ("turn < 2", "turn >= 2 AND turn < 4", "turn >= 4"):
            talk.where(lot).write.mode("append").parquet(f"{path}/arriving")
            turns.run(spark, f"{path}/arriving", f"{path}/routed", f"{path}/checkpoint")
        spark.range(1).write.parquet(f"{path}/done")
    return spark.read.schema(turns.ROUTED).parquet(f"{path}/routed")


def turn_positions(spark, sf_dir):
    return conversations.turn_positions(messages(spark, sf_dir))


def turn_history(spark, sf_dir):
    return conversations.history(messages(spark, sf_dir))


def turn_history_sparse(spark, sf_dir):
    """The history where turn numbers lie far apart and some keys are NULL."""
    talk, conv, turn = messages(spark, sf_dir), F.col("conv_id"), F.col("turn")
    sparse = talk.select(
        F.when(conv % 17 != 3, conv).alias("conv_id"),
        F.when((turn != 2) | (conv % 13 != 5), turn * 1000003).alias("turn"),
        "role",
        "text",
    )
    return conversations.history(sparse, segment=64)


def turn_history_listed(spark, sf_dir):
    """The messages before each user turn, one per row."""
    talk = messages(spark, sf_dir)
    turns = conversations.user_turns(talk).select("conv_id", "turn").distinct()
    return conversations.history_of(talk, turns).select("conv_id", "asked_turn", "turn", "role", "text")


def turn_keywords(spark, sf_dir):
    return retrieval.keywords(questions(spark, sf_dir))


# ---- retrieval -------------------------------------------------------------

def _embeddings(spark, sf_dir):
    held = tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return held.withColumnRenamed("vec_id", "query_id"), held


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


def knn_top3(spark, sf_dir):
    return _rounded(neighbours.nearest(*_embeddings(spark, sf_dir)))


def knn_top3_by_pivots(spark, sf_dir):
    """The same neighbours by the way that is taken when both sides are large."""
    asked, held = _embeddings(spark, sf_dir)
    return _rounded(neighbours.nearest(asked, held, small=0, pivots=32, block=512))


def knn_with_bad_vectors(spark, sf_dir):
    """The search where a share of the vectors is NULL or holds NULL, NaN or infinity."""
    held = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>"))
    kind, whole = F.col("vec_id") % 50, F.col("embedding")
    spoilt = lambda x: F.transform(whole, lambda v, i: F.when(i == 0, F.lit(x).cast("double")).otherwise(v))
    vector = F.when(kind == 7, spoilt("NaN")).when(kind == 11, spoilt(None)).when(kind == 13, spoilt("Infinity"))
    held = held.select("vec_id", vector.when(kind == 17, None).otherwise(whole).alias("embedding"))
    return _rounded(neighbours.nearest(held.withColumnRenamed("vec_id", "query_id"), held))


def knn_approximate(spark, sf_dir):
    """Most of the three nearest of each embedding, by hash families."""
    return _rounded(approximate.nearest_approximate(*_embeddings(spark, sf_dir)))


def knn_from_index(spark, sf_dir):
    """Neighbours from a kept index that was built from some vectors, added to and partly deleted from."""
    asked, held = _embeddings(spark, sf_dir)
    path = _own_path(spark, sf_dir, "embedding-index")
    if vector_index.build_once(spark, path, lambda: held.where("vec_id % 3 <> 0")):
        vector_index.add(held.where("vec_id % 3 = 0"), path)
        vector_index.delete(held.where("vec_id % 11 = 3"), path)
    return _rounded(vector_index.search(asked, path))


def context_assembly(spark, sf_dir):
    """Context of each embedding from the whole texts of its three nearest documents."""
    asked, held = _embeddings(spark, sf_dir)
    documents = tables.table(spark, sf_dir, "documents")
    chunks = documents.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("chunk"))
    hits = neighbours.nearest(asked, held)
    return retrieval.context(asked.select("query_id"), hits, chunks)


def chunk_documents(spark, sf_dir):
    return retrieval.chunk_documents(tables.documents(spark, sf_dir))


def _word_weights(texts: DataFrame, key: str) -> DataFrame:
    held = retrieval.word_counts(texts, "text", out="held")
    pairs = F.explode(F.arrays_zip(F.col("held.indices").alias("bucket"), F.col("held.values").alias("weight"))).alias("p")
    return held.select(key, pairs).select(key, "p.bucket", F.round("p.weight", 6).alias("weight"))


def hashed_embeddings(spark, sf_dir):
    return _word_weights(tables.documents(spark, sf_dir), "doc_id")


def question_embeddings(spark, sf_dir):
    """Vectors of the benchmark's query texts."""
    return _word_weights(tables.table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id")


def retrieve_context(spark, sf_dir):
    return retrieval.retrieve_from_index(questions(spark, sf_dir), chunk_index(spark, sf_dir))


def prompt_table(spark, sf_dir):
    """Prompts with the number of messages that go before each; records are extracted once."""
    found = retrieve_context(spark, sf_dir).select("query_id", "context")
    talk = messages(spark, sf_dir)
    routed = conversations.routes(talk).withColumn("query_id", _query_id())
    turns = routed.join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    places = conversations.turn_positions(talk).select("conv_id", "turn", "messages_before")
    asked = conversations.prompts(turns, written(serving_set(spark, sf_dir), "serving"))
    return asked.join(places, ["conv_id", "turn"]).select("conv_id", "turn", "route", "messages_before", "prompt")


ALL = {
    f.__name__: f
    for f in (
        extract_fields, quality_scores, quality_counts, record_counts, serving_set,
        serving_round_trip, stream_curated, stream_counts, changed_files, text_file_scan, packed_note_scan, batch_counts,
        risk_points, risk_points_guideline, risk_signals, risk_summary, risk_crosstab,
        risk_reasons, risk_bands, risk_caveat, intervention_plan, diagnosis_rates, diagnosis_rates_from_table,
        top5_high_risk, all_high_risk, low_confidence, no_follow_up, over75_high_risk,
        non_compliant, quality_issues, missing_field_records, chf_no_follow_up,
        patient_explain, patient_assessments, first_records,
        turn_routing, turn_routing_stream, turn_positions, turn_history, turn_history_sparse, turn_history_listed,
        turn_keywords,
        knn_top3, knn_top3_by_pivots, knn_with_bad_vectors, knn_from_index, knn_approximate, context_assembly,
        chunk_documents, hashed_embeddings, question_embeddings,
        retrieve_context, prompt_table,
    )
}
