"""Interchange files: vocabularies, totals, vectors, spools and models.

Native persistence is Parquet; these are for exchange with other tools.  Text
files are written and read by Spark; only the binary model, which is one
file by definition, is made by the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.params import Params

# Fixed values of the binary model.
MODEL_MAGIC = 0xBEA25956
MODEL_VERSION = 1


#: The first line of a vector file: how many vectors, and of which dimension.
HEADER = r"^\d+ \d+\s*$"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of a text file or folder, a line a document."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def write_counts(df: DataFrame, path: str, name: str, count: str, order: list) -> None:
    """Lines `name count` in the given order, in one file."""
    lines = df.orderBy(*order).select(F.concat_ws(" ", F.col(name), F.col(count).cast("string")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(w, freq) of lines `name count`; the name is what precedes the last space."""
    line = r"^(.+?)\s+(\d+)\s*$"
    parts = spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("w"), F.regexp_extract("value", line, 2).alias("freq"))
    return parts.where(F.col("freq") != "").select("w", F.col("freq").cast("bigint").alias("freq"))


def vector_lines(vectors: DataFrame, name: str) -> DataFrame:
    """(idx, value): the lines of a vector file, six decimals a component."""
    text = F.array_join(F.transform("v", lambda x: F.format_string("%.6f", x)), " ")
    return vectors.select("idx", F.concat_ws(" ", F.col(name), text).alias("value"))


def write_vectors(vectors: DataFrame, path: str, name: str = "w") -> None:
    """A header `count dim` and a line per vector in the order of idx."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    head = vectors.sparkSession.createDataFrame([(-1, f"{size['n']} {size['d'] or 0}")], "idx bigint, value string")
    lines = head.unionByName(vector_lines(vectors, name)).orderBy("idx").select("value")
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(w, v); the header line is recognised by its two numbers."""
    parts = F.split(F.rtrim("value"), " ")
    rows = spark.read.text(path).where(~F.col("value").rlike(HEADER) & (F.size(parts) >= 2))
    return rows.select(parts[0].alias("w"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("double")).alias("v"))


#: Records of a spool that travel as one value.
RECORDS = 65_536


def write_spool(cells: DataFrame, path: str) -> None:
    """Little-endian unsigned 32-bit triples (w_idx, c_idx, cooc), written by
    Spark as a table of binary chunks, so wherever its file systems are."""

    def run(batches):
        for b in batches:
            rows = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            if (rows < 0).any() or (rows > 0xFFFFFFFF).any():
                raise ValueError("a spool holds unsigned 32-bit numbers")
            packed = rows.astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([packed[i : i + RECORDS].tobytes() for i in range(0, len(packed), RECORDS)], pa.binary())], names=["content"])

    cells.select("w_idx", "c_idx", "cooc").mapInArrow(run, "content binary").write.parquet(path)


def read_spool(spark: SparkSession, path: str, width: int = 3) -> DataFrame:
    """(w_idx, c_idx, cooc[, sampled]) of a spool that write_spool() made."""
    return _unpacked(spark.read.schema("content binary").parquet(path), width)


def read_records(spark: SparkSession, path: str, width: int = 3) -> DataFrame:
    """The same of bare files of 12 (or 16) bytes a record, as other tools write
    them; Spark reads them record by record, splitting large files."""
    size = 4 * width
    records = spark.sparkContext.binaryRecords(path, size).map(lambda r: (bytes(r),))
    return _unpacked(spark.createDataFrame(records, "content binary"), width)


def _unpacked(chunks: DataFrame, width: int) -> DataFrame:
    names = ["w_idx", "c_idx", "cooc", "sampled"][:width]

    def unpack(batches):
        for b in batches:
            rows = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4").reshape(-1, width).astype(np.int64)
            for i in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(rows[i : i + 100_000, k]) for k in range(width)], names=names)

    return chunks.mapInArrow(unpack, ", ".join(f"{n} bigint" for n in names))


@dataclass
class BinaryModel:
    """Words, their matrix rows and the hashed rows behind them."""

    words: list[str]
    matrix: np.ndarray
    minn: int
    maxn: int

    @property
    def buckets(self) -> int:
        return len(self.matrix) - len(self.words)


def write_model(path: str, model: BinaryModel) -> None:
    rows, dim = model.matrix.shape
    _write_model(path, model.words, len(model.words), model.matrix, rows, dim, model.minn, model.maxn)


def write_model_rows(path: str, words: Iterable[str], n_words: int, rows: Iterable, n_rows: int, p: Params) -> None:
    """A binary model from words and matrix rows in order, which stream through
    the driver one by one."""
    _write_model(path, words, n_words, rows, n_rows, p.dim, max(p.minn, 0), p.maxn)


def _write_model(path: str, words: Iterable[str], n_words: int, rows: Iterable, n_rows: int, dim: int, minn: int, maxn: int) -> None:
    with open(path, "wb") as out:
        out.write(struct.pack("<7I", MODEL_MAGIC, MODEL_VERSION, n_words, n_rows, dim, minn, maxn))
        for w in words:
            b = w.encode()
            out.write(struct.pack("<I", len(b)) + b)
        for v in rows:
            out.write(np.asarray(v, "<f8").tobytes())


def read_model(path: str) -> BinaryModel:
    """The matrix is mapped, so rows are read as they are used."""
    with open(path, "rb") as f:
        head = f.read(28)
        if len(head) < 28:
            raise ValueError("not a model file: it is too short")
        magic, version, n, rows, dim, minn, maxn = struct.unpack("<7I", head)
        if magic != MODEL_MAGIC:
            raise ValueError(f"not a model file: magic number {magic:#x}")
        if version != MODEL_VERSION:
            raise ValueError(f"model version {version} is not supported")
        words = [f.read(struct.unpack("<I", f.read(4))[0]).decode() for _ in range(n)]
        matrix = np.memmap(path, "<f8", "r", f.tell(), (rows, dim)) if rows and dim else np.zeros((rows, dim))
    return BinaryModel(words, matrix, minn, maxn)


def merge_vector_files(spark: SparkSession, words: str, contexts: str, out: str) -> int:
    """Word vectors plus the sums of their contexts' vectors, all as files.

    Contexts are positional where there are more of them than words.  Returns
    how many words had no context vector.  Files of different dimension are
    an error.
    """
    from wordloom.operators.vectors import merged_contexts, unmerged_words

    w, c = read_vectors(spark, words), read_vectors(spark, contexts).withColumnRenamed("w", "c")
    sizes = {r[0] for t in (w, c) for r in t.select(F.size("v")).distinct().collect()}
    if len(sizes) != 1:
        raise ValueError(f"vectors have different dimensions: {sorted(sizes)}")
    dim, positional = sizes.pop(), c.count() > w.count()
    lines = spark.read.text(words).select(F.monotonically_increasing_id().alias("idx"), "value")
    # The header is no word, also where a word is the same number.
    order = lines.where(~F.col("value").rlike(HEADER)).select("idx", F.split("value", " ")[0].alias("w"))
    merged = merged_contexts(w, c, dim, positional).join(order, "w")
    write_vectors(merged, out)
    return unmerged_words(w, c, positional).count()
