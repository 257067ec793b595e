"""Arrow batches as numpy columns, whole groups at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have `width` elements, as doubles; null elements are NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def ragged(column: pa.Array, width: int) -> np.ndarray:
    """As matrix(); lists that are null or of another width are rows of NaN."""
    out = np.full((len(column), width), np.nan)
    fits = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), width), False))
    if fits.any():
        out[fits] = matrix(column.filter(pa.array(fits)), width)
    return out


def whole_groups(batches: Iterator[dict[str, np.ndarray]], keys: tuple[str, ...], same: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of rows sorted by keys, cut so that no group spans two; rows equal to the one before in `same` are dropped
    as they come, so that a group of copies of any size takes no memory."""
    rest: dict[str, np.ndarray] | None = None
    for b in batches:
        if rest is not None:
            b = {k: np.concatenate([rest[k], v]) for k, v in b.items()}
        n = len(b[keys[0]])
        if not n:
            continue
        again = np.ones(n - 1, bool)
        for k in same:
            v = b[k]
            equal = v[1:] == v[:-1]
            if v.dtype.kind == "f":
                equal |= np.isnan(v[1:]) & np.isnan(v[:-1])
            again &= equal.all(1) if v.ndim == 2 else equal
        if again.any():
            stay = np.concatenate([[True], ~again])
            b = {k: v[stay] for k, v in b.items()}
        last = np.ones(len(b[keys[0]]), bool)
        for k in keys:
            last &= b[k] == b[k][-1]
        cut = len(last) - int(last[::-1].cumprod().sum())
        if cut:
            yield {k: v[:cut] for k, v in b.items()}
        rest = {k: v[cut:] for k, v in b.items()}
    if rest is not None:
        yield rest


def bounds(b: dict[str, np.ndarray], keys: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where the groups of sorted rows begin and end."""
    n = len(b[keys[0]])
    if not n:
        return []
    new = np.zeros(n - 1, bool)
    for k in keys:
        new |= b[k][1:] != b[k][:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:]))
