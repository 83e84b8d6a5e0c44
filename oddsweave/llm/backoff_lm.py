"""LM scoring with a weighted backoff automaton.

The model is an n-gram model under Dirichlet smoothing.  A history ``h`` seen
``c(h)`` times is a state; it has one arc for every word seen behind it, of
weight ``(c(hw) + mu * p(w | h')) / (c(h) + mu)``, and a failure arc of weight
``mu / (c(h) + mu)`` to the state ``h'`` that lacks the oldest word.  The empty
state has an arc for every word, and one for all unknown words.  Each state's
weights sum to one.

Neither the counts nor the automaton ever meet in one place.  Documents are
taken in blocks of a bounded number of bytes, written once as numbered tokens
(``blocks``).  Each block asks for the counts of its own distinct n-grams, and
brings what it has counted itself, in slices of the hash space; a slice adds up
what all blocks brought and answers each block in the order of its question.  A
block then builds exactly that part of the automaton which its texts can visit:
numbered states, arcs and failure arcs as arrays.

One traversal from left to right carries the state and adds up the weights.  It
runs in lanes that advance together, one token a step.  As a state is a run of at
most ``order - 1`` tokens, a lane that begins inside a text starts that many
tokens earlier and is in the true state when its own part begins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import Words, mix, per_doc_sum, remainder, row_key, slabs, stored

BLOCK_BYTES = 6 << 20
#: Asked n-grams that one slice answers together, about; tokens of a lane.
SLICE_ROWS, LANE = 2_000_000, 512
ORDER, MU, ADD = 3, 20.0, 0.1
END = np.uint64(0x5BD1E995A3C59AC3)

_BLOCKS = "block string, size long, tokens binary, words binary, ids binary, lengths binary, held binary"
_ASKED = "slice long, n int, block string, hashes binary, counts binary"
_ANSWERS = "slice long, n int, block string, totals binary, distinct long, total long"
_SCORES = "row_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _packed(values: np.ndarray) -> bytes:
    """Numbers that aren't negative, in as few bytes each as the largest needs, byte plane by byte plane, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(f"<u{kind.itemsize}").view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + _codec()[0](planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_codec()[1](blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{blob[0]}").ravel().astype(np.int64)


@lru_cache(1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress


def _sorted(values: np.ndarray, bits: int, drop: int = 0) -> bytes:
    """Ascending 64-bit numbers that agree in the first ``bits`` bits (16 at most) and of which the last ``drop`` (0 or 8) are zero.

    The bytes of each below the first 16 bits, plane by plane, behind how many share what these 16 bits are.
    """
    high = np.bincount((values >> np.uint64(48)).astype(np.int64) & ((1 << (16 - bits)) - 1), minlength=1 << (16 - bits))
    kind = np.min_scalar_type(int(high.max(initial=0)))
    planes = (values >> np.uint64(drop)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 6 - drop // 8]
    return bytes([kind.itemsize]) + high.astype(f"<u{kind.itemsize}").tobytes() + planes.T.tobytes()


def _unsorted(blob: bytes, bits: int, drop: int = 0) -> np.ndarray:
    """The numbers of ``_sorted`` without their first ``bits`` bits."""
    size = blob[0] << (16 - bits)
    many = np.frombuffer(blob, f"<u{blob[0]}", 1 << (16 - bits), 1)
    planes = np.frombuffer(blob, np.uint8, offset=1 + size).reshape(6 - drop // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, drop // 8 : 6] = planes.T
    return out.view("<u8").ravel() | np.repeat(np.arange(len(many), dtype=np.uint64) << np.uint64(48), many)


def _cut(block_bytes: int):
    """Documents to blocks: tokens as numbers into the block's own sorted words."""

    def run(batches):
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            held = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in slabs(batch, "text", block_bytes):
                w = Words(data, at, lower=True)
                sizes = w.per_doc + 1
                ends = np.cumsum(sizes) - 1
                h = np.empty(int(sizes.sum()), np.uint64)
                own = np.ones(len(h), bool)
                own[ends] = False
                h[own], h[ends] = w.hashes(), END
                words, tokens = np.unique(h, return_inverse=True)
                key = np.where(null[lo:hi], np.iinfo(np.int64).min, ids[lo:hi]).astype("<i8")
                row = [f"{task}-{serial}", len(h), _packed(tokens), _sorted(words, 0), key.tobytes(), _packed(sizes), held[lo:hi].astype("u1").tobytes()]
                yield pa.record_batch([pa.array([x]) for x in row], names=[x.split()[0] for x in _BLOCKS.split(", ")])
                serial += 1

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, tokens of each document, ids, held-out flags of a block."""
    return _unsorted(row["words"], 0)[_unpacked(row["tokens"])], _unpacked(row["lengths"]), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["held"], "u1").astype(bool)


def grams(h: np.ndarray, lengths: np.ndarray, order: int):
    """For each n up to ``order``: hashes of the n-grams that end at tokens with n-1 tokens before them in their document, and those tokens.

    Words have 64 bits, longer n-grams 56: of ten billion different ones, one in
    seven million shares its count with another.
    """
    nth = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashed = h
    for n in range(1, order + 1):
        at = np.flatnonzero(nth >= n - 1)
        if n > 1:  # of the history's hash one token back, and the token
            hashed = np.concatenate((hashed[:1], mix(hashed[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:] + np.uint64(n))))
        yield n, at, hashed[at] if n == 1 else hashed[at] & ~np.uint64(255)


def _ask(order: int, bits: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, lengths, _, held = _unpack(row)
                train = np.repeat(~held, lengths)
                for n, at, hashed in grams(h, lengths, order):
                    asked, inverse = np.unique(hashed, return_inverse=True)
                    count = np.bincount(inverse, train[at], len(asked)).astype(np.int64)
                    part = (asked >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(asked), np.int64)
                    first = np.flatnonzero(np.diff(part, prepend=-1))
                    last = np.append(first[1:], len(part))
                    yield pa.record_batch(
                        [
                            pa.array(part[first]),
                            pa.array(np.full(len(first), n, np.int32)),
                            pa.array([row["block"]] * len(first), pa.string()),
                            pa.array([_sorted(asked[a:b], min(bits, 16), 8 * (n > 1)) for a, b in zip(first, last)], pa.binary()),
                            pa.array([_packed(count[a:b]) for a, b in zip(first, last)], pa.binary()),
                        ],
                        names=[x.split()[0] for x in _ASKED.split(", ")],
                    )

    return run


def _answer(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Adds up one slice and answers every block that asked; the first answer also has the slice's distinct and all training n-grams."""
        drop = 8 * (table["n"][0].as_py() > 1)
        hashes = [_unsorted(x, bits, drop) for x in table["hashes"].to_pylist()]
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_unpacked(x) for x in table["counts"].to_pylist()])).astype(np.int64)
        ends = np.cumsum([len(x) for x in hashes])
        first = np.arange(len(hashes)) == 0
        return pa.table(
            {
                "slice": table["slice"],
                "n": table["n"],
                "block": table["block"],
                "totals": pa.array([_packed(total[inverse[b - len(x) : b]]) for x, b in zip(hashes, ends)], pa.binary()),
                "distinct": pa.array(np.where(first, (total > 0).sum(), 0)),
                "total": pa.array(np.where(first, total.sum(), 0)),
            }
        )

    return run


@dataclass(frozen=True)
class Gram:
    """Distinct n-grams of one length in a block: training counts, and for each its last word, its history and itself without its oldest word (numbers of n-1-grams)."""

    count: np.ndarray
    word: np.ndarray
    history: np.ndarray
    suffix: np.ndarray


class Automaton:
    """The part of the automaton that a block's texts can visit.

    State 0 is the empty one; each n-gram shorter than the order that training
    has seen is a state.  ``fail`` and ``fail_weight``: a state's failure arc.
    Arcs are sorted by state and word: ``keys``, and ``to`` and ``weight`` of each.
    The empty state has an arc for every word of the block.
    """

    def __init__(self, grams: dict[int, Gram], tokens: int, words: int, mu: float = MU, add: float = ADD):
        order = max(grams)
        self.order, self.words = order, len(grams[1].count)
        p = {1: (grams[1].count + add) / (tokens + add * (words + 1))}
        state, fail, fail_weight, states = {}, [np.zeros(1, np.int32)], [np.zeros(1)], 1
        for n in range(1, order):  # number the states, length by length
            seen = grams[n].count > 0
            state[n] = np.where(seen, states + np.cumsum(seen) - 1, 0).astype(np.int32)
            fail.append(state[n - 1][grams[n].suffix[seen]] if n > 1 else np.zeros(int(seen.sum()), np.int32))
            fail_weight.append(np.log10(mu / (grams[n].count[seen] + mu)))
            states += int(seen.sum())
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        keys, to, weight = [], [], []
        for n in range(1, order + 1):
            g = grams[n]
            if n > 1:  # of every n-gram, as longer ones go on from it; only those that training has seen are arcs
                p[n] = (g.count + mu * p[n - 1][g.suffix]) / (grams[n - 1].count[g.history] + mu)
            arc = np.flatnonzero(g.count > 0) if n > 1 else np.arange(self.words)
            keys.append((state[n - 1][g.history[arc]].astype(np.int64) if n > 1 else 0) * self.words + g.word[arc])
            to.append(state[n][arc] if n < order else state[n - 1][g.suffix[arc]] if n > 1 else np.zeros(len(arc), np.int32))
            weight.append(np.log10(p[n][arc]))
        by = np.argsort(np.concatenate(keys))
        self.keys, self.to, self.weight = (np.concatenate(x)[by] for x in (keys, to, weight))
        self.empty = np.log10(p[1])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind a word each, and the weights of the way there: failure arcs until a state has an arc for the word."""
        state, total, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            has = self.keys[at] == key
            there, at = todo[has], at[has]
            total[there] += self.weight[at]
            state[there] = self.to[at]
            todo = todo[~has]
            total[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail[state[todo]]
        return state, total

    def walk(self, tokens: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> np.ndarray:
        """Weight of each token on the way through its text."""
        per = -(-lengths // lane)
        owner = np.repeat(np.arange(len(lengths)), per)
        first = np.cumsum(lengths) - lengths
        begin = first[owner] + lane * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        end = np.minimum(begin + lane, (first + lengths)[owner])
        at = np.maximum(begin - (self.order - 1), first[owner])  # tokens that lead into a lane's first state
        by = np.argsort(at - end, kind="stable")  # long ways first
        begin, end, at = begin[by], end[by], at[by]
        state, out = np.zeros(len(by), np.int32), np.zeros(len(tokens))
        active, size = len(by), end - at
        for k in range(int(size.max(initial=0))):
            while size[active - 1] <= k:
                active -= 1
            here = at[:active] + k
            state[:active], weight = self.step(state[:active], tokens[here])
            own = here >= begin[:active]
            out[here[own]] = weight[own]
        return out


def counted(h: np.ndarray, lengths: np.ndarray, order: int, totals) -> tuple[dict[int, Gram], np.ndarray]:
    """The n-grams of a block with the counts that ``totals(n)`` gives in the order of their hashes, and each token's word."""
    out, before, words = {}, None, None
    for n, at, hashed in grams(h, lengths, order):
        distinct, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        total = totals(n)
        if len(total) != len(distinct):
            raise ValueError(f"asked for {len(distinct)} {n}-grams and got {len(total)}")
        number = np.zeros(len(h), np.int32)  # of the n-gram that ends at each token
        number[at] = inverse
        words = number if n == 1 else words
        end = at[where]
        none = np.zeros(len(distinct), np.int32)
        out[n] = Gram(total, words[end], before[end - 1] if n > 1 else none, before[end] if n > 1 else none)
        before = number
    return out, words


def _score(order: int, tokens: int, words: int, mu: float, add: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        got = answers.sort_by([("n", "ascending"), ("slice", "ascending")])
        kinds, blobs = got["n"].to_numpy(), got["totals"].to_pylist()
        for row in block.to_pylist():
            h, lengths, ids, held = _unpack(row)
            model_of, words_of = counted(h, lengths, order, lambda n: np.concatenate([np.zeros(0, np.int64), *(_unpacked(blobs[k]) for k in np.flatnonzero(kinds == n))]))
            model = Automaton(model_of, tokens, words, mu, add)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            known = per_doc_sum((model_of[1].count[words_of] > 0).view(np.int8), ends)
            base, score = np.add.reduceat(model.empty[words_of], ends[:-1]), np.add.reduceat(model.walk(words_of, lengths), ends[:-1])
            null = ids == np.iinfo(np.int64).min
            out.append(pa.table([pa.array(ids, pa.int64(), mask=null), pa.array(held), pa.array(lengths, pa.int64()), pa.array(known), pa.array(np.full(len(ids), tokens)), pa.array(base), pa.array(score)], names=[x.split()[0] for x in _SCORES.split(", ")]))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], schema=pa.schema([("row_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))

    return run


def score(docs: DataFrame, held_out=None, order: int = ORDER, mu: float = MU, add: float = ADD, block_bytes: int = BLOCK_BYTES, slice_rows: int = SLICE_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: its counts, the add-constant unigram score and the automaton's log10 probability.

    ``held_out``: a boolean column of rows that the model doesn't learn from
    (default: crc32 of the key as text is divisible by 10).  Null or empty
    text is one end token; keys are whole numbers or null, and null stays null;
    repeated rows count each time; other columns are not read.  No rows in, no
    rows out.
    """
    spark = docs.sparkSession
    held = F.coalesce(remainder(F.col(key), 10) == 0 if held_out is None else held_out, F.lit(False))
    rows = docs.select(row_key(docs, key).alias("row_id"), held.alias("held"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(_cut(block_bytes), _BLOCKS), "lm-blocks", compression="zstd")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    bits = max(0, int(size * order // slice_rows)).bit_length()
    asked = blocks.select("block", "tokens", "words", "ids", "lengths", "held").mapInArrow(_ask(order, bits), _ASKED)
    answers = stored(asked.groupBy("n", "slice").applyInArrow(_answer(min(bits, 16)), _ANSWERS), "lm-answers", compression="zstd")
    seen = answers.filter("n = 1").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    scorer = _score(order, int(seen[1]), int(seen[0]), mu, add)
    return blocks.groupBy("block").cogroup(answers.select("block", "n", "slice", "totals").groupBy("block")).applyInArrow(scorer, _SCORES)
