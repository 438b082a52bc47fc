"""A search structure for vectors that is built once, kept, and added to.

``<path>/pivots`` holds the pivots, ``<path>/placed`` every vector with its nearest pivot (``cell``) and the distance
to it (``reach``), in files that follow the cells, and ``<path>/gone`` the ids taken out. Every change
appends files with the next version, so what was written stays as it is and a lost job leaves nothing behind
but files without a marker.

* :func:`build` places all vectors; :func:`add` places new ones into the kept cells; :func:`delete` marks ids.
* :func:`search` is exact: it reads ``cell`` and ``reach`` of the rows that are left, finds the cells that can
  hold a neighbour of some query, and reads the vectors of these cells alone. It places nothing.

The pivots are chosen when the index is built. Results never depend on them, the work does: build anew when the
table has grown many times over.
"""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sinks
from . import neighbours

#: Rows of one file, about: a cell that a query visits is read with little beside it.
FILE_ROWS = 1 << 18


def build(vectors: DataFrame, path: str, pivots: int | None = None) -> None:
    """Write the index of ``vectors(vec_id, embedding, ...)``; further columns are kept beside each vector."""
    spark = vectors.sparkSession
    held = _usable(vectors)
    centres = neighbours._pivots(held.select("vec_id", "embedding"), pivots)
    rows = [(i, [float(x) for x in centre]) for i, centre in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/pivots")
    _write(held, centres, path, version=1, mode="overwrite")
    spark.createDataFrame([], _gone_schema(vectors)).write.mode("overwrite").parquet(f"{path}/gone")


def build_once(spark: SparkSession, path: str, vectors) -> bool:
    """Build unless ``path`` holds a finished index; True when it was built. ``vectors`` is called only then."""
    if all(sinks.is_complete(spark, f"{path}/{part}") for part in ("pivots", "placed", "gone")):
        return False
    build(vectors(), path)
    return True


def add(vectors: DataFrame, path: str) -> int:
    """Place new vectors into the kept cells; returns the index's new version.

    A vector whose id the index holds replaces the older one. An index built from no vectors has no cells: it is
    built from these.
    """
    spark = vectors.sparkSession
    version, centres = latest(spark, path) + 1, _centres(spark, path)
    if not len(centres):
        build(vectors, path)
        return 1
    _write(_usable(vectors), centres, path, version, "append")
    return version


def delete(ids: DataFrame, path: str) -> int:
    """Take out the vectors of ``ids(vec_id)``; they may be added again later. Returns the new version."""
    spark = ids.sparkSession
    version = latest(spark, path) + 1
    gone = ids.select(F.col("vec_id").cast(_kind(spark, path)).alias("vec_id")).distinct()
    gone.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/gone")
    return version


def latest(spark: SparkSession, path: str) -> int:
    """The newest version: of vectors or of ids taken out. Reads one column of each."""
    placed, gone = (spark.read.parquet(f"{path}/{part}").agg(F.max("version").alias("v")) for part in ("placed", "gone"))
    return max(placed.first()["v"] or 0, gone.first()["v"] or 0)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the index as they stand: the newest of each id, without those taken out."""
    try:
        placed = spark.read.parquet(f"{path}/placed")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"vector index not found: {path}") from error
        raise
    return _standing(spark, path, placed)


def search(
    queries: DataFrame, path: str, k: int = 3, small: int = neighbours.SMALL, block: int | None = None
) -> DataFrame:
    """``query_id, vec_id, rank, distance`` of the ``k`` nearest vectors of the index; exact.

    ``small`` queries or fewer (and ``SMALL_BYTES`` of them) travel to the cells that some of them visits, and nothing
    but the winners is shuffled; more of them travel in lots.
    """
    spark = queries.sparkSession
    centres = _centres(spark, path)
    asked, held = neighbours._prepared(queries, "query_id"), vectors(spark, path)
    if not len(centres):
        return neighbours._ranked(asked.join(held, F.lit(False)).select("query_id", "vec_id", F.lit(0.0).alias("square")), k)
    asked = neighbours._equally_long(asked, centres.shape[1])
    cells = neighbours._cells(held.select("cell", "reach"), len(centres), k)
    visits = neighbours._visit_counts(asked, centres, cells, k)
    visited = [int(cell) for cell in np.flatnonzero(visits[:-1])]
    placed = held.where(F.col("cell").isin(visited)).select("vec_id", "embedding", "cell", "reach")
    few = neighbours._few(asked, min(small, neighbours.SMALL_BYTES // (8 * centres.shape[1])))
    if few is not None:
        return neighbours._ranked(neighbours._queries_to_vectors(asked, placed.select("vec_id", "embedding"), few, k), k)
    return neighbours._ranked(neighbours._search_cells(asked, placed, centres, cells, k, block), k)


def _usable(vectors: DataFrame) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    return vectors.withColumn("embedding", vector).where(neighbours.usable(F.col("embedding")))


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    """The pivots; ``MOST_PIVOTS`` and ``SMALL_BYTES`` bound them."""
    rows = spark.read.parquet(f"{path}/pivots").collect()
    centres = np.array([r.centre for r in sorted(rows, key=lambda r: r.cell)], dtype=np.float64)
    return centres.reshape(len(rows), -1) if rows else np.zeros((0, 0))


def _write(held: DataFrame, centres: np.ndarray, path: str, version: int, mode: str) -> None:
    others = [c for c in held.columns if c not in ("vec_id", "embedding")]
    clash = {"cell", "reach", "version"} & set(others)
    if clash:
        raise ValueError(f"columns that the index has itself: {sorted(clash)}")
    width = centres.shape[1] if centres.size else 0
    if len(centres):
        held = neighbours._equally_long(held, width)
    placed = neighbours._placed(held.select("vec_id", "embedding", *others), centres)
    placed = placed.withColumn("version", F.lit(version))
    # sorted by cell, so that a filter on cells skips files and row groups; by id beside it, so that a hot cell is cut
    files = max(1, -(-held.count() // FILE_ROWS), min(len(centres) // 16, 64))
    ranged = placed.repartitionByRange(files, "cell", F.xxhash64("vec_id")).sortWithinPartitions("cell")
    ranged.write.mode(mode).option("parquet.block.size", 4 << 20).parquet(f"{path}/placed")


def _standing(spark: SparkSession, path: str, placed: DataFrame) -> DataFrame:
    """Without what a later version has replaced or taken out.

    An index that was only built, never changed, is read as it is.
    """
    changed = spark.read.parquet(f"{path}/placed").where("version > 1").select("vec_id", "version")
    gone = spark.read.parquet(f"{path}/gone").select("vec_id", "version")
    changes = changed.unionByName(gone)
    if changes.isEmpty():
        return placed
    # one short row per changed id; the vectors' side is split where an id is hot
    last = changes.groupBy("vec_id").agg(F.max("version").alias("last"))
    ended = gone.groupBy("vec_id").agg(F.max("version").alias("ended"))
    last = last.join(ended, "vec_id", "left")
    kept = placed.join(last, "vec_id", "left")
    stands = F.col("last").isNull() | ((F.col("version") == F.col("last")) & (F.col("ended").isNull() | (F.col("version") > F.col("ended"))))
    return kept.where(stands).select(*placed.columns)


def _kind(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/placed").schema["vec_id"].dataType.simpleString()


def _gone_schema(vectors: DataFrame) -> str:
    return f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, version int"
