"""Batch embedding through a provider built once per task."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EmbeddingProvider(Protocol):
    """A provider may have `embed_counted(texts)` too, which gives the vectors and each text's token counts."""

    dimensions: int
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Offline provider: vectors from SHA-256 of the text; carries no meaning."""

    def __init__(self, dimensions: int = 16) -> None:
        self.dimensions = dimensions
        self.model = f"hash-{dimensions}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._vector(t) for t in texts]

    def _vector(self, text: str) -> list[float]:
        data = text.encode()
        blocks = b"".join(
            hashlib.sha256(b"%d:" % i + data).digest() for i in range(-(-self.dimensions // 32))
        )
        raw = np.frombuffer(blocks, dtype=np.uint8)[: self.dimensions] / 255.0 - 0.5
        length = float(np.sqrt(np.dot(raw, raw)))
        if length == 0.0:
            raw = np.eye(1, self.dimensions)[0]
            length = 1.0
        return (raw / length).tolist()


def _checked(vectors: list, n: int, width: int) -> list:
    if len(vectors) != n:
        raise ValueError(f"expected {n} vectors, got {len(vectors)}")
    wrong = next((len(v) for v in vectors if len(v) != width), None)
    if wrong is not None:
        raise ValueError(f"the model made a {wrong}-wide vector, expected {width}")
    return vectors


def _built(provider: Callable[[], EmbeddingProvider], width: int) -> EmbeddingProvider:
    model = provider()
    if model.dimensions != width:
        raise ValueError(f"the provider makes {model.dimensions}-wide vectors, the table holds {width}")
    return model


def embed(df: DataFrame, provider: Callable[[], EmbeddingProvider], width: int,
          text: str = "text", vector: str = "embedding") -> DataFrame:
    """Rows with the vector of their text; one provider per task, one call per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            vectors: list = []
            if batch.num_rows:
                model = model or _built(provider, width)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                vectors = _checked(model.embed(texts), len(texts), width)
            column = pa.array(vectors, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column],
                                             names=[*batch.schema.names, vector])

    return df.mapInArrow(run, schema)


CALL_COLUMNS = [T.StructField("usage", T.MapType(T.StringType(), T.LongType())),
                T.StructField("error", T.StringType()), T.StructField("ms", T.DoubleType())]


def embed_outcomes(df: DataFrame, provider: Callable[[], EmbeddingProvider], width: int,
                   text: str = "text", vector: str = "embedding") -> DataFrame:
    """Rows with vector, usage, error and milliseconds. A failed call is an error of each of its rows, not a failed job.

    The time of a call is shared out evenly over its rows. A model of another width is still an error of the job.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType())), *CALL_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            model = model or _built(provider, width)
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            begun, usages, error = time.perf_counter(), [None] * n, None
            try:
                if hasattr(model, "embed_counted"):
                    vectors, counts = model.embed_counted(texts)
                    usages = [list(c.items()) for c in counts]
                else:
                    vectors = model.embed(texts)
                vectors = _checked(vectors, n, width)
            except Exception as exc:  # noqa: BLE001 - any provider failure becomes a row
                vectors, usages, error = [None] * n, [None] * n, f"{type(exc).__name__}: {exc}"
            each = (time.perf_counter() - begun) * 1000 / n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(usages, pa.map_(pa.string(), pa.int64())),
                 pa.array([error] * n, pa.string()), pa.array([each] * n, pa.float64())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def width_report(chunks: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """How many vectors have each width, and whether it is the one the table holds."""
    return (
        chunks.groupBy(F.size(vector).alias("width")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("fits", F.col("width") == width)
    )


def require_width(chunks: DataFrame, width: int, vector: str = "embedding") -> DataFrame:
    """The same rows; the job fails on the first vector of another width."""
    found = F.coalesce(F.size(vector), F.lit(-1))
    complaint = F.concat(F.lit("vector width is "), found.cast("string"),
                         F.lit(f", expected {width}"))
    return chunks.withColumn(
        vector, F.when(found == width, F.col(vector)).otherwise(F.raise_error(complaint))
    )
