"""Fixed-width vectors in array columns. All of it stays in generated code; nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDTH = 14


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def vector(c, width: int = WIDTH, on_mismatch: str = "raise") -> Column:
    """The array as floats if it has `width` elements. A null array stays null; another width raises an error when the value is
    used (on_mismatch="raise") or becomes null ("null")."""
    c = col(c)
    if on_mismatch not in ("raise", "null"):
        raise ValueError(on_mismatch)
    other = F.lit(None) if on_mismatch == "null" else F.raise_error(F.format_string(f"expected a vector of {width} elements, got %d", F.size(c)))
    return F.when(c.isNull() | (F.size(c) == width), c.cast("array<float>")).otherwise(other.cast("array<float>"))


def sum_of(c: Column, f=lambda x: x) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def norm(c) -> Column:
    """Euclidean norm: accumulated in double, given as float. A null element makes it null."""
    return F.sqrt(sum_of(col(c), lambda x: x * x)).cast("float")


def distance(a, b) -> Column:
    """Norm of the difference in double; null unless both have the same number of elements."""
    a, b = col(a), col(b)
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))


def swapped(c, width: int = WIDTH) -> Column:
    """The two halves exchanged: an arm's joints for the other's."""
    half = width // 2
    return F.concat(F.slice(col(c), half + 1, half), F.slice(col(c), 1, half))


def close(now, before, atol: float = 1e-4, rtol: float = 1e-5) -> Column:
    """Whether each element differs from the one before by no more than atol + rtol * |before|. NaN is close to nothing."""
    now, before = col(now), col(before)
    near = F.zip_with(now, before, lambda x, y: ~F.isnan(x) & ~F.isnan(y) & (F.abs(x.cast("double") - y.cast("double")) <= atol + rtol * F.abs(y.cast("double"))))
    return F.when(F.size(now) == F.size(before), F.forall(near, lambda x: F.coalesce(x, F.lit(False)))).otherwise(F.lit(False))


def first_or_null(c) -> Column:
    return F.try_element_at(col(c), F.lit(1))


def camera(name: Column) -> Column:
    return F.replace(name, F.lit("observation.images."), F.lit(""))


def video_path(camera_key, chunk, file) -> Column:
    """Where a camera's video file lies within a dataset."""
    return F.format_string("videos/%s/chunk-%03d/file-%03d.mp4", col(camera_key), col(chunk), col(file))
