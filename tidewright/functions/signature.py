"""Truncated path signatures: an Arrow kernel for any depth, tensor-algebra helpers, and the shuffle product."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature_dim(d: int, depth: int, level_zero: bool = False) -> int:
    return sum(d**k for k in range(0 if level_zero else 1, depth + 1))


def signatures_of(paths: np.ndarray, depth: int) -> np.ndarray:
    """(n, L, d) paths of one length -> (n, signature_dim): levels 1 to depth. One pass over the segments for all paths together; the highest level is
    updated first, by Horner's scheme for the exponential of a segment."""
    n, length, d = paths.shape
    if length < 2:
        raise ValueError("a path needs at least two points")
    levels = [np.ones((n, 1))] + [np.zeros((n, d**k)) for k in range(1, depth + 1)]
    for delta in np.moveaxis(np.diff(paths, axis=1), 1, 0):
        for k in range(depth, 0, -1):
            # s_k + s_(k-1) x + s_(k-2) x^2/2 + ... = s_k + (s_(k-1) + (s_(k-2) + ...) x/2) x
            acc = levels[0] * delta / k
            for j in range(1, k):
                acc = ((acc + levels[j])[:, :, None] * (delta / (k - j))[:, None, :]).reshape(n, -1)
            levels[k] = levels[k] + acc
    return np.concatenate(levels[1:], axis=1)


def with_signature(df: DataFrame, depth: int, path: str = "path", name: str = "sig") -> DataFrame:
    """df with the signature of `path`; one Arrow pass, points move as flat doubles. Null for a null
    path, for fewer than two points, and for a path with a null or NaN coordinate."""
    d = df.withColumn("_len", F.size(path)).withColumn("_flat", F.flatten(path))
    columns = list(df.columns)
    schema = d.select(*columns, F.lit(None).cast("array<double>").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = batch.column("_len").fill_null(-1).to_numpy(zero_copy_only=False)
            flat = batch.column("_flat")
            ends = flat.offsets.to_numpy()
            values = flat.values.to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            out: list = [None] * len(lens)
            for length, size in {(int(a), int(b)) for a, b in zip(lens, sizes) if a > 1 and b}:
                at = np.flatnonzero((lens == length) & (sizes == size))
                stacked = np.stack([values[ends[i] : ends[i + 1]] for i in at]).reshape(len(at), length, size // length)
                for i, s in zip(at, signatures_of(stacked, depth)):
                    out[i] = s if np.isfinite(s).all() else None
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.list_(pa.float64()))], names=[*columns, name])

    return d.mapInArrow(run, schema)


def level_slice(sig: Column, d: int, level: int) -> Column:
    """The levels 1 to `level` of a flat signature over d channels."""
    return F.slice(sig, 1, signature_dim(d, level))


def split_levels(flat: np.ndarray, d: int, depth: int) -> list[np.ndarray]:
    out, at = [np.ones(1)], 0
    for k in range(1, depth + 1):
        out.append(np.asarray(flat[at : at + d**k], float))
        at += d**k
    return out


def tensor_product(a: list[np.ndarray], b: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Product of two elements of the truncated tensor algebra (lists of levels from nought)."""
    return [sum((np.multiply.outer(a[j], b[k - j]).ravel() for j in range(k + 1) if j < len(a) and k - j < len(b)), np.zeros(len(a[1]) ** k if len(a) > 1 else 1)) for k in range(depth + 1)]


def shuffle_product(u: np.ndarray, p: int, v: np.ndarray, q: int, d: int) -> np.ndarray:
    """Shuffle of level p with level q: the sum over all ways to place the p letters of u among p + q."""
    joint = np.multiply.outer(u.reshape((d,) * p), v.reshape((d,) * q))
    out = np.zeros((d,) * (p + q))
    for places in itertools.combinations(range(p + q), p):
        rest = [i for i in range(p + q) if i not in places]
        out = out + np.transpose(joint, np.argsort([*places, *rest]).astype(int))
    return out.ravel()


def shuffle_elements(a: list[np.ndarray], b: list[np.ndarray], d: int) -> list[np.ndarray]:
    out = [np.zeros(d**k) for k in range(len(a) + len(b) - 1)]
    for p, u in enumerate(a):
        for q, v in enumerate(b):
            out[p + q] = out[p + q] + shuffle_product(u, p, v, q, d)
    return out


def shuffle_power(a: list[np.ndarray], power: int, d: int) -> list[np.ndarray]:
    out = [np.ones(1)]
    for _ in range(power):
        out = shuffle_elements(out, a, d)
    return out


def paired(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    return float(sum(np.dot(x, y) for x, y in zip(a, b)))
