"""Vector arithmetic as Column expressions (doubles throughout)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def _as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector: Column) -> Column:
    squares = F.aggregate(_as_double(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; null for a zero vector."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalise(vector: Column, width: int) -> Column:
    """Unit length; a zero vector becomes the first unit vector; a wrong width is an error."""
    first_unit = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), width - 1))

    def scaled(v: Column) -> Column:
        unit = let(norm(v), lambda length: F.when(length == 0.0, first_unit).otherwise(
            F.transform(v, lambda x: x / length)))
        complaint = F.concat(F.lit("vector width is "), F.size(v).cast("string"),
                             F.lit(f", expected {width}"))
        return F.when(F.size(v) == width, unit).otherwise(F.raise_error(complaint))

    return let(_as_double(vector), scaled)


def hash_embed(text: Column, dims: int = 16) -> Column:
    """Deterministic vector from SHA-256 blocks of "counter:text", scaled to unit length."""
    blocks = -(-dims // 32)
    digests = F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), text), 256) for i in range(blocks)])
    # Two hexadecimal digits to a byte.
    values = let(digests, lambda hexes: F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
        / 255.0 - 0.5,
    ))
    return l2_normalise(values, dims)


_PAYLOAD = "struct<data:array<struct<index:int,embedding:array<double>>>>"


def vectors_from_payload(payload: Column, expected: Column, width: int) -> Column:
    """Vectors of an embedding response in index order, or why there are none."""
    data = F.from_json(payload, _PAYLOAD).getField("data")
    ordered = F.array_sort(data)
    vectors = F.transform(ordered, lambda item: item.getField("embedding"))
    malformed = data.isNull() | F.exists(
        data, lambda d: d.getField("index").isNull() | d.getField("embedding").isNull()
    )
    bad_width = F.filter(vectors, lambda v: F.size(v) != width)
    error = (
        F.when(malformed, F.lit("Unexpected response shape"))
        .when(F.size(data) != expected, F.concat(
            F.lit("Expected "), expected.cast("string"), F.lit(" vectors, got "),
            F.size(data).cast("string")))
        .when(F.size(bad_width) > 0, F.concat(
            F.lit("Model produced a "), F.size(F.try_element_at(bad_width, F.lit(1))).cast("string"),
            F.lit(f"-wide vector, expected {width}")))
    )
    return F.struct(F.when(error.isNull(), vectors).alias("vectors"), error.alias("error"))
