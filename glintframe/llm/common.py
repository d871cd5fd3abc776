"""What the operators of this package share: tables, checkpoints, zlib checksums, block packing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoint import checkpointed as cut
from ..checkpoint import shared_folder  # noqa: F401  the pipeline's folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, on any file system Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame, gathered: bool = False) -> DataFrame:
    """`df` written to the shared folder and read back, lineage cut.

    gathered: in a few files for each core of the cluster rather than one for each shuffle partition,
    for what is small beside the corpus; partitions are joined without a shuffle and read in turn.
    """
    if gathered:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    return cut(df)


def salted_join(rows: DataFrame, small: DataFrame, on: str, *by: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """rows joined with `small`, one row for each value of `on`, over (on, salt): a hot value is spread over tasks.

    by: columns of `rows` that tell rows of one value apart; `small` is repeated `salts` times.
    """
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(17), *by), F.lit(salts)))
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(small, [on, "__salt"], how).drop("__salt")


def kept(docs: DataFrame, scorer, keep) -> DataFrame:
    """The rows of `docs`, all columns as they are, for which keep(scores) holds.

    scorer: a broadcast model whose scores(texts) gives an array; null texts count as empty. Rows stay
    in their partition.
    """
    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if texts:
                flags = np.concatenate([keep(scorer.value.scores([t or "" for t in part])) for part in in_parts(texts)])
                yield batch.filter(pa.array(flags))

    return docs.mapInArrow(run, docs.schema)


def slices(batches, rows: int = 512):
    """Arrow batches cut short, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_parts(texts: list[str | None], chars: int = 1_000_000):
    """Runs of texts of about `chars` characters together, one text at least."""
    part: list[str | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or "") > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


def crc32_of(value: object) -> int:
    """zlib's unsigned crc32 of the decimal text of `value`."""
    return zlib.crc32(str(value).encode())


def fold_of(column, folds: int):
    """crc32(text of `column`) mod `folds`, as a column."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(folds))


def vectors_of(df: DataFrame, id_col: str, vec_col: str, nonzero: bool = False) -> DataFrame:
    """(vec_id long, vec array<double>): rows whose vector is whole and finite (and not all zero if `nonzero`)."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(
        F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    if nonzero:
        ok = ok & F.exists(F.col("vec"), lambda x: x != 0.0)
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"), F.col(vec_col)).where(ok)
    return out.select("vec_id", "vec")


def one_each(vectors: DataFrame) -> DataFrame:
    """vec_id, vec: of rows that repeat an id the least vector."""
    return vectors.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(series) -> np.ndarray:
    """A float64 matrix from a series of equally long arrays."""
    return np.stack([np.asarray(x, dtype=np.float64) for x in series]) if len(series) else np.zeros((0, 0))


def best_k(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query's candidates: score descending, then id ascending; equal ids count once."""
    if len(ids) > 4 * k:
        kth = -np.partition(-scores, k - 1)[k - 1]
        keep = scores >= kth
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    return ids[:k], scores[:k]
