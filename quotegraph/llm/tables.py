"""Rows by their place in stored files, names that a table hasn't, and the most frequent of counted values."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotegraph.plans.shared import forget, fresh_path, materialize

#: Locators, of some 150 bytes each, that may be broadcast.
BROADCAST_ROWS = 200_000


def free_name(taken: Iterable[str], name: str) -> str:
    """``name`` behind so many underscores that no column of ``taken`` has it, whatever the case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def located(docs: DataFrame, label: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the file and the row index of each row, and the two columns' names; what isn't a plain scan of files is written first."""
    file, row = free_name(docs.columns, "_file"), free_name(docs.columns, "_row")
    own = [*own_columns(docs), F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)]
    try:
        return docs.select(*own), file, row
    except AnalysisException:
        return materialize(docs, label).select(*own), file, row


def place(doc_id: str = "doc_id", file: str = "_file", row: str = "_row") -> Column:
    """Orders rows: an id before none, then by id, then by locator."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))


def without(docs: DataFrame, gone: DataFrame, file: str, row: str) -> DataFrame:
    """Located ``docs`` without the rows that ``gone`` names by _file and _row.

    Few enough locators are broadcast, and no text moves; more are joined by a shuffle.
    """
    gone = materialize(gone.select(F.col("_file").alias(file), F.col("_row").alias(row)), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, [file, row], "left_anti")


def most_frequent(counts: DataFrame, least: int, most: int) -> list[tuple]:
    """Rows of ``counts`` (a value, n) with n of at least ``least``, the most frequent ones, ``most`` at most.

    Counts fall into steps of an eighth of an octave; the upper steps that fit count. Only the
    number of rows of each step, and the rows themselves, reach the driver.
    """
    step = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    frequent = materialize(counts.filter(F.col("n") >= least).withColumn("_step", step), "frequent")
    lowest, fit = None, 0
    for at, n in sorted(frequent.groupBy("_step").agg(F.count(F.lit(1))).collect(), reverse=True):  # 512 rows at most
        if (fit := fit + n) > most:
            break
        lowest = at
    rows = [] if lowest is None else [tuple(r) for r in frequent.filter(F.col("_step") >= lowest).drop("_step").collect()]
    forget(frequent)
    return rows


_SHIPPED: dict[str, set[str]] = {}


def ship(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file below the shared folder and has each executor fetch it; SparkFiles.get finds it there by ``name``, which a hash of the content should be part of."""
    done = _SHIPPED.setdefault(spark.sparkContext.applicationId, set())
    if name not in done:
        where = f"{fresh_path(spark, 'shipped')}/{name}"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(data)
        out.close()
        spark.sparkContext.addFile(where)
        done.add(name)
    return name


def spread_repeats(rows: DataFrame, draw: str, at: str) -> DataFrame:
    """``rows``, a written table, where those that share a ``draw`` get another by their place ``at``, so no number of equal rows shares a block."""
    repeats = materialize(rows.groupBy(draw).agg(F.count(F.lit(1)).alias("_same")).filter("_same > 1").select(F.col(draw).alias("_d"), F.lit(True).alias("_again")), "repeats")
    many = repeats.count()
    if not many:
        return rows
    found = rows.join(F.broadcast(repeats) if many <= BROADCAST_ROWS else repeats, F.col(draw) == F.col("_d"), "left")
    return found.withColumn(draw, F.when(F.col("_again"), F.xxhash64(draw, at)).otherwise(F.col(draw))).drop("_d", "_again")


def part_place(file: str, row: str) -> Column:
    """A hash of a row's place: the number of its file's part, or the file's name, and the row's index, which stay from run to run."""
    name = F.element_at(F.split(F.col(file), "/"), -1)
    return F.xxhash64(F.coalesce(F.nullif(F.regexp_extract(name, "^part-[0-9]+", 0), F.lit("")), name), F.col(row))


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of some ``most`` bytes, with the place of the first; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, end - at).to_pylist()
        at = end
