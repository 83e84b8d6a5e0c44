"""Quality classifier with supervised subword embeddings.

Words, runs of two words, and runs of three and four characters inside words
(with the blank around them) are hashed to rows of a table of learned vectors.
An average can't tell a text that repeats itself from one that doesn't; so a
run of three words that came before in the text has a vector more, one for all
(``Settings.repeats``; without it held-out accuracy is lower, see the README).  A document is the average of its vectors, and a softmax over classes stands on
it.  All is trained together by stochastic gradient descent in numpy, one
document at a step, with a rate that falls to 0.

Training reads a bounded sample of labelled rows: the ``sample`` smallest by a
hash of the key, as far as ``sample_bytes`` go.  Scoring reads every whole text.
As output and average are both linear, a trained model is one number per row of
the table and class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import Words, mix, row_key, slabs, stored, windows

KINDS = 5


@dataclass(frozen=True)
class Settings:
    """``rows``: of each kind of feature in the table (a power of two).

    ``repeats``: whether runs of three words that came before are a feature;
    ``sample``: labelled documents that training reads at most;
    ``sample_bytes``: of their features, eight for each that differs.
    """

    rows: int = 1 << 16
    dim: int = 10
    epochs: int = 6
    rate: float = 0.3
    boost: float = 10.0
    repeats: bool = True
    sample: int = 4000
    sample_bytes: int = 256 << 20
    seed: int = 7


def features(data: np.ndarray, at: np.ndarray, rows: int, repeats: bool = True):
    """Rows of the table that the documents of a slab use: pairs of (document of each, rows), kind by kind."""
    w = Words(data, at)
    shift = np.uint64(64 - rows.bit_length() + 1)
    h, doc = w.hashes(), w.doc_of()
    yield doc, (h >> shift).astype(np.int64)
    two, start = windows(h, w.first, 2)
    yield doc[start], (two >> shift).astype(np.int64) + rows
    # Characters of the slab: each byte that begins one, and how many stand before each byte.
    begins = (w.data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(begins)))
    codes = np.frombuffer(w.data.tobytes().decode().encode("utf-32-le"), "<u4")
    edge = np.zeros(len(codes) + 1, np.int8)
    edge[before[w.starts]] += 1
    edge[before[w.ends]] -= 1
    letters = np.concatenate(([False], np.cumsum(edge[:-1], dtype=np.int8).view(bool)))
    shown = np.where(letters, np.concatenate((codes[:1], codes)), 32).astype(np.uint64)  # a blank before all, so first words begin like others
    owner = np.repeat(np.arange(w.docs), np.diff(before[w.doc_at]))  # of a run: whose its second character is
    for n in (3, 4):
        if len(shown) >= n:
            inside = np.ones(len(shown) - n + 1, bool)
            for k in range(1, n - 1):
                inside &= letters[k : k + len(inside)]
            place = np.flatnonzero(inside)
            code = np.zeros(len(place), np.uint64)
            for k in range(n):
                code = code * np.uint64(0x9FB21C651E98DF25) + shown[place + k]
            yield owner[place], (mix(code) >> shift).astype(np.int64) + rows * (n - 1)
    if repeats:
        three, start = windows(h, w.first, 3)
        salted = mix(three + doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(salted, return_index=True)
        again = np.ones(len(salted), bool)
        again[first] = False
        yield doc[start[again]], np.full(int(again.sum()), rows * (KINDS - 1), np.int64)


def _bags(rows: int, repeats: bool):
    """Documents as distinct rows and how often each, for training."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                owner, used = (np.concatenate(x) for x in zip(*features(data, at, rows, repeats)))
                pair, count = np.unique(owner * (rows * KINDS) + used, return_counts=True)
                cut = np.searchsorted(pair, np.arange(hi - lo + 1) * (rows * KINDS))
                part = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([(pair[s] % (rows * KINDS)).astype("<i4").tobytes() for s in part], pa.binary()),
                        pa.array([count[s].astype("<f4").tobytes() for s in part], pa.binary()),
                    ],
                    names=["rank", "label", "used", "count"],
                )

    return run


@dataclass(frozen=True)
class Model:
    """``weight[row]`` and ``bias``: by how much they lift class 1 over class 0."""

    weight: np.ndarray
    bias: float
    rows: int
    repeats: bool = True

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, many = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for owner, used in features(data, at, self.rows, self.repeats):
            total += np.bincount(owner, self.weight[used], len(total))
            many += np.bincount(owner, minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(many, 1), -60, 60)))


def descend(bags: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent over bags of (rows, shares, label)."""
    rng = np.random.Generator(np.random.PCG64(settings.seed))
    table = rng.uniform(-1 / settings.dim, 1 / settings.dim, (settings.rows * KINDS, settings.dim)).astype(np.float32)
    out, bias = np.zeros((2, settings.dim), np.float32), np.zeros(2, np.float32)
    if bags:
        share = sum(y for *_, y in bags) / len(bags)
        bias[1] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    steps, step = max(1, settings.epochs * len(bags)), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(bags)):
            used, part, label = bags[k]
            rate = settings.rate * (1 - step / steps)
            step += 1
            hidden = part @ table[used]
            raw = out @ hidden + bias
            p = np.exp(raw - raw.max())
            p /= p.sum()
            p[label] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            # An average moves each vector by its share only; the step grows with the number of rows to make up for it.
            table[used] -= settings.boost * rate * (rate * len(used)) ** 0.5 * part[:, None] * back
    lift = out[1] - out[0]
    return Model((table @ lift).astype(np.float32), float(bias[1] - bias[0]), settings.rows, settings.repeats)


def train(docs: DataFrame, labels: DataFrame, learn, settings: Settings = Settings(), key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fits on labelled rows for which the boolean column ``learn`` (of the key) holds; labels other than 0 and 1 are left out.

    Of rows that share a key each counts as a document, in the order of a hash of
    the text.  Texts without words are left out.  Without any row left the model
    says one half for every text.
    """
    marks = labels.select(row_key(labels, key).alias("_key"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").filter(learn(F.col("_key")))
    few = marks.withColumn("rank", F.xxhash64(F.lit(settings.seed), "_key")).orderBy("rank", "_key", "label").limit(settings.sample)
    rows = docs.select(row_key(docs, key).alias("_key"), F.col(text).alias("text"))
    chosen = rows.join(F.broadcast(few), "_key").select(F.struct("rank", "_key", "label", F.xxhash64("text").alias("tie")).alias("rank"), "label", "text")
    bagged = chosen.mapInArrow(_bags(settings.rows, settings.repeats), chosen.select("rank", "label").schema.add("used", "binary").add("count", "binary"))
    most = stored(bagged.orderBy("rank").limit(settings.sample), "bags")
    # Rows in order, as far as their bytes go: their sizes are ``sample`` numbers.
    sizes = most.select("rank", (F.octet_length("used") + F.octet_length("count")).alias("size")).orderBy("rank").collect()
    inside = int(np.searchsorted(np.cumsum([r["size"] for r in sizes]), settings.sample_bytes, side="right"))
    got = most.orderBy("rank").limit(inside).collect() if inside else []
    bags = []
    for r in got:
        used, count = np.frombuffer(r["used"], "<i4"), np.frombuffer(r["count"], "<f4")
        if len(used):
            bags.append((used, count / count.sum(), int(r["label"])))
    return descend(bags, settings)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id and score (0 to 1, of class 1) of every row.

    Null and empty texts have the bias's score; repeated rows give repeated
    rows; keys are whole numbers or null; other columns are not read; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of rows, whatever the data

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.scores(data, at))], names=["row_id", "score"])

    return docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text")).mapInArrow(run, "row_id long, score double")
