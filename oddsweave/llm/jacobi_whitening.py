"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become whole numbers, so sums, means and centred rows are exact up to
one rounding.  Blocks of centred rows are reduced to triangles by QR, triangles
are stacked and reduced again along a tree, and what is left is one triangle R
with the covariance of all rows.  Plane rotations, many disjoint pairs at once,
turn R's columns until all are orthogonal: their lengths are the standard
deviations (small ones as accurate as large ones, since the covariance is never
formed), the gathered rotations are the components.

Rows stay where they are.  What moves is one triangle per task, some numbers per
dimension, and the components, whose size the dimension alone decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import removed, row_key, stored

BLOCK_BYTES = 8 << 20
FAN_IN = 16
#: Scaled entries stay within the whole numbers that a double holds.
LARGEST = float(1 << 53)
_LIMB = 21


@dataclass(frozen=True)
class Model:
    """A fitted whitening: all that scoring a row needs."""

    n: int
    shift: np.ndarray  # whole part of each dimension's mean
    rest: np.ndarray  # n times what is left of it, from 0 to n - 1
    components: np.ndarray  # a row each, by falling standard deviation
    deviations: np.ndarray
    explained: np.ndarray  # share of the whole variance

    @property
    def dimensions(self) -> int:
        return len(self.shift)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift).astype(np.float64) - self.rest / self.n

    def whitened(self, x: np.ndarray, count: int) -> np.ndarray:
        return self.centred(x) @ self.components[:count].T / self.deviations[:count]


def clean(table: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64, offset: int = 1_000_000) -> DataFrame:
    """``row_id`` and ``x``, the whole numbers floor(scale * entry) + offset, of each sound row.

    Not sound are null and empty vectors, and vectors with an entry that is null,
    not finite, or beyond 2^53 when scaled.
    """
    scaled = table.select(row_key(table, key).alias("row_id"), F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda c: F.lit(float(scale)) * c).alias("s"))
    sound = scaled.filter(F.col("s").isNotNull() & (F.size("s") > 0) & F.forall("s", lambda c: c.isNotNull() & (F.abs(c) <= LARGEST)))
    return sound.select("row_id", F.transform("s", lambda c: F.floor(c) + F.lit(offset).cast("long")).alias("x"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _row_blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[np.ndarray]:
    step = max(4 * dimensions, BLOCK_BYTES // (8 * dimensions))
    for batch in batches:
        x = _matrix(batch.column(batch.schema.get_field_index("x")), dimensions)
        for k in range(0, len(x), step):
            yield x[k : k + step]


def _sums(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64), 0
        for x in _row_blocks(batches, dimensions):
            high += (x >> 26).sum(0)
            low += (x & ((1 << 26) - 1)).sum(0)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), pa.array(high), pa.array(low), pa.array(np.full(dimensions, n))], ["dim", "high", "low", "n"])

    return run


def _reduced(parts: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """One value from one per task (``data``), ``FAN_IN`` at a time along a tree whose shape the tasks' numbers decide."""
    level = written = stored(parts.withColumn("part", F.spark_partition_id()), "parts")
    most = written.agg(F.max("part")).first()[0] or 0

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"data": [merge(rows["data"].tolist())], "part": [int(rows["part"].iloc[0]) // FAN_IN]})

    while most:
        level = level.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(merged, "data binary, part int")
        most //= FAN_IN
    row = level.select("data").first()
    removed(written)
    return bytes(row[0]) if row else None


def _triangles(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, model.dimensions))
        for x in _row_blocks(batches, model.dimensions):
            r = np.linalg.qr(np.vstack((r, model.centred(x))), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["data"])

    return run


def _stacked(dimensions: int):
    def merge(parts: list[bytes]) -> bytes:
        r = np.frombuffer(parts[0]).reshape(-1, dimensions)
        for p in parts[1:]:
            r = np.linalg.qr(np.vstack((r, np.frombuffer(p).reshape(-1, dimensions))), mode="r")
        return r.tobytes()

    return merge


def one_sided_jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as rows.

    A sweep meets all pairs of columns in rounds of disjoint pairs, as in a
    tournament; it ends when no pair is further from orthogonal than rounding.
    """
    d = r.shape[1]
    even = d + d % 2
    columns, turned = np.zeros((even, r.shape[0])), np.zeros((even, d))
    columns[:d], turned[:d] = r.T, np.eye(d)
    limit = np.finfo(float).eps * np.sqrt(max(d, 1))
    seats = np.arange(even)
    for _ in range(sweeps):
        still = True
        for _ in range(even - 1):
            i, j = seats[: even // 2], seats[: even // 2 - 1 : -1]
            a, b = columns[i], columns[j]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            go = np.abs(ab) > limit * np.sqrt(aa) * np.sqrt(bb)
            if go.any():
                still = False
                i, j, a, b = i[go], j[go], a[go], b[go]
                z = (bb[go] - aa[go]) / (2 * ab[go])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                columns[i], columns[j] = c * a - s * b, s * a + c * b
                u, v = turned[i], turned[j]
                turned[i], turned[j] = c * u - s * v, s * u + c * v
            seats = np.concatenate((seats[:1], np.roll(seats[1:], 1)))
        if still:
            break
    lengths = np.sqrt((columns * columns).sum(1))
    order = np.argsort(-lengths, kind="stable")
    order = order[np.any(turned[order] != 0, axis=1)]  # the column that made their number even
    return lengths[order], turned[order]


def fit(sound: DataFrame) -> Model | None:
    """The whitening of all rows of ``sound`` (from ``clean``) whose vectors have the most frequent length (of equally many, the longest).

    None where there is no row.  Components without variance (standard
    deviation at rounding level) are left out.
    """
    length = sound.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not length:
        return None
    d = length["d"]
    rows = sound.filter(F.size("x") == d).select("x")
    total = rows.mapInArrow(_sums(d), "dim long, high long, low long, n long").groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low", "n"))).collect()  # a row per dimension
    n = int(total[0]["n"])
    sums = {r["dim"]: (int(r["high"]) << 26) + int(r["low"]) for r in total}
    shift, rest = zip(*(divmod(sums[k], n) for k in range(d)))
    start = Model(n, np.array(shift, np.int64), np.array(rest, np.int64), np.zeros((0, d)), np.zeros(0), np.zeros(0))
    triangle = _reduced(rows.mapInArrow(_triangles(start), "data binary"), _stacked(d))
    lengths, components = one_sided_jacobi(np.frombuffer(triangle).reshape(-1, d))
    explained = lengths**2 / max((lengths**2).sum(), np.finfo(float).tiny)
    vary = lengths > lengths[0] * d * np.finfo(float).eps
    sign = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])
    return Model(n, start.shift, start.rest, (components * sign[:, None])[vary], lengths[vary] / np.sqrt(n), explained[vary])


def _moments(model: Model, count: int):
    """Rows, means and products about the means, of whitened rows: parts merge without the mean's size harming the products."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for x in _row_blocks(batches, model.dimensions):
            z = model.whitened(x, count)
            mean = z.mean(0)
            held = [_met([*held, np.concatenate(([len(z)], mean, ((z - mean).T @ (z - mean)).ravel())).tobytes()])]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["data"])

    return run


def _met(parts: list[bytes]) -> bytes:
    total = np.frombuffer(parts[0])
    for p in parts[1:]:
        other = np.frombuffer(p)
        k = (int(np.sqrt(4 * len(total) - 3)) - 1) // 2
        n, m = total[0], other[0]
        apart = other[1 : k + 1] - total[1 : k + 1]
        products = total[k + 1 :] + other[k + 1 :] + np.outer(apart, apart).ravel() * (n * m / (n + m))
        total = np.concatenate(([n + m], total[1 : k + 1] + apart * (m / (n + m)), products))
    return total.tobytes()


def identity_error(sound: DataFrame, model: Model, count: int = 32) -> float:
    """The largest entry, sign aside, of the covariance of the whitened rows less the identity."""
    k = len(model.deviations[:count])
    if not k:
        return 0.0
    rows = sound.filter(F.size("x") == model.dimensions).select("x")
    found = np.frombuffer(_reduced(rows.mapInArrow(_moments(model, count), "data binary"), _met))
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max())


def _square_sums(model: Model, x: np.ndarray) -> list[int | None]:
    """Of each row, the exact sum over dimensions of (n * x - sum)^2, in limbs that 64-bit sums hold; None from 10^38 on."""
    away = x - model.shift
    out: list[int | None] = []
    if len(away) and int(np.abs(away).max()) + 1 > (1 << 62) // model.n:
        rest = model.rest.tolist()
        out = [sum((model.n * a - r) ** 2 for a, r in zip(row, rest)) for row in away.tolist()]
    elif len(away):
        v = model.n * away - model.rest
        mask = (1 << _LIMB) - 1
        low, mid, high = v & mask, (v >> _LIMB) & mask, v >> (2 * _LIMB)
        limbs = ((low * low).sum(1), 2 * (low * mid).sum(1), (2 * low * high + mid * mid).sum(1), 2 * (mid * high).sum(1), (high * high).sum(1))
        out = [sum(part << (k * _LIMB) for k, part in enumerate(row)) for row in zip(*(p.tolist() for p in limbs))]
    return [v if v < 10**38 else None for v in out]


def _whitened(model: Model, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1), model.dimensions)
            step = max(1, BLOCK_BYTES // (8 * model.dimensions))
            for k in range(0, len(x), step):
                z = model.whitened(x[k : k + step], count)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(1, z.shape[1]), dtype=np.int32)), pa.array(z.ravel())) if z.size else pa.array([[]] * len(z), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([ids[k : k + step], pa.array(_square_sums(model, x[k : k + step]), pa.decimal128(38, 0)), rows], ["row_id", "deviation", "whitened"])

    return run


def whiten(sound: DataFrame, model: Model | None, count: int = 32) -> DataFrame:
    """Each row's ``row_id``, exact ``deviation`` (decimal; null from 10^38 on) and ``whitened``, its first ``count`` whitened coordinates.

    ``sound`` comes from ``clean``; rows of another length than the model's are
    dropped like unsound ones.  Null and repeated keys are kept as they are;
    without a model (an empty table) there are no rows.
    """
    shape = "row_id long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return sound.sparkSession.createDataFrame([], shape)
    return sound.filter(F.size("x") == model.dimensions).select("row_id", "x").mapInArrow(_whitened(model, count), shape)
