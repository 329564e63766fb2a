"""What the operators of this package share: the cluster's shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattmill.staging import new_path, shared_dir, written  # noqa: F401  (the operators take them from here)

#: Rows of text that a Python worker holds at once. Texts are long, so batches are small.
BATCH_ROWS = 500
#: Bytes of text after which a worker hands on what it has.
BATCH_BYTES = 8 << 20
#: Rows and bytes in an Arrow batch from Spark: its default of 10,000 whole texts would be the largest thing that a worker holds.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def ship(spark: SparkSession) -> None:
    """Readies a session: small Arrow batches (the session's settings are lowered, and stay so), and this package for Python workers that don't find it by themselves (once a session)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = Path(__file__).resolve().parents[2]
    name = f"{Path(__file__).resolve().parents[1].name}-package.zip"
    if any(f.endswith(name) for f in spark.sparkContext.listFiles):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / name
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(Path(__file__).resolve().parents[1].rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def under_own_names(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """`docs` with all columns but `needed` under plain numbered names, which no operator uses, and the columns that give them back."""
    name = lambda i, c: c if c in needed else f"in{i}"
    inner = docs.select(*(F.col(f"`{c.replace('`', '``')}`").alias(name(i, c)) for i, c in enumerate(docs.columns)))
    return inner, [F.col(name(i, c)).alias(c) for i, c in enumerate(docs.columns)]


#: A table up to this number of short rows is broadcast.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `most` rows (short ones, read from a written table); else as it is, for a join that Spark may split at hot keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows` rows and about `size` bytes (one row may be longer)."""
    for batch in batches:
        step = max(1, min(rows, int(size * batch.num_rows / max(1, batch.nbytes)) or 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
