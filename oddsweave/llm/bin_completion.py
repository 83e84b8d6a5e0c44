"""Best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens.  How pieces combine
depends on their lengths alone, so the plan is made on the histogram of lengths,
which has ``capacity`` numbers whatever the data.  Around the largest length left
the undominated fillings are enumerated, least waste first; a branch uses one of
them as often as its lengths last, or fewer times, and ends where its waste and
that of the rest can't beat the incumbent.  Best-fit decreasing is the first
incumbent and, from nodes of the search on, gives further ones.  The search ends
when the lower bound is met, so the plan is proven best, or after ``STEPS`` nodes.

A plan is a short list of (filling, times).  A piece finds its sequence by its
rank among pieces of its length: ranks come from counters in each partition and
one sum over partitions, never from sorting all pieces of a length in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsweave.llm._shared import row_key, slabs, stored, texts_of
from oddsweave.llm.token_resync import encoder

CAPACITY, END_ID = 1024, 2
#: Nodes that the search may visit before it settles for its incumbent, and after how many it tries best fit from where it is.
STEPS, DIVE = 4_000, 64

Plan = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing needs (the bound of Martello and Toth over all thresholds); ``counts[n]``: pieces of length n."""
    cap = len(counts) - 1
    size = np.arange(cap + 1)
    number, volume = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-int(volume[-1]) // cap)
    for k in range(0, cap // 2 + 1):
        large = int(number[-1] - number[cap - k])  # alone against all of at least k
        middle = int(number[cap - k] - number[cap // 2])
        middle_volume, small_volume = int(volume[cap - k] - volume[cap // 2]), int(volume[cap // 2] - (volume[k - 1] if k else 0))
        best = max(best, large + middle + max(0, -(-(small_volume - (middle * cap - middle_volume)) // cap)))
    return best


def best_fit_decreasing(counts: np.ndarray) -> Plan:
    """Longest piece first, each filled up with the longest piece that still fits, again and again."""
    left, plan = counts.copy(), []
    for size in range(len(counts) - 1, 0, -1):
        while left[size] > 0:
            filling, room = [size], len(counts) - 1 - size
            used = Counter(filling)
            while room > 0:
                fit = next((s for s in range(min(room, size), 0, -1) if left[s] > used[s]), 0)
                if not fit:
                    break
                filling.append(fit)
                used[fit] += 1
                room -= fit
            times = min(int(left[s]) // n for s, n in used.items())
            for s, n in used.items():
                left[s] -= n * times
            plan.append((tuple(filling), times))
    return plan


def _sums(sizes: list[int], left: np.ndarray, most: int) -> list[int]:
    """For each number of sizes from the smallest on: which sums up to ``most`` their pieces make, as bits."""
    reach, mask = [1], (1 << (most + 1)) - 1
    for s in sizes:
        bits, n, step = reach[-1], min(int(left[s]), most // s), 1
        while n > 0:  # pieces in groups of 1, 2, 4 ... and the rest
            take = min(step, n)
            bits |= (bits << (s * take)) & mask
            n, step = n - take, step * 2
        reach.append(bits)
    return reach


def _exact(total: int, parts: int, least: int, left: np.ndarray, most: int):
    """Fillings of exactly ``parts`` pieces of ``least`` to ``most`` that add up to ``total``, the most even first."""
    if parts == 1:
        if least <= total <= most and left[total] > 0:
            yield (total,)
        return
    for s in range(min(total // parts, most), least - 1, -1):
        if left[s] > 0 and total - s <= most * (parts - 1):
            left[s] -= 1
            for rest in _exact(total - s, parts - 1, s, left, most):
                left[s] += 1
                yield (*rest, s)
                left[s] -= 1
            left[s] += 1


def _any(total: int, k: int, sizes: list[int], reach: list[int], left: np.ndarray):
    """Fillings of the ``k`` smallest sizes that add up to ``total``, longest pieces first."""
    if not total:
        yield ()
        return
    for i in range(k - 1, -1, -1):
        s = sizes[i]
        if s <= total and left[s] > 0 and reach[i + 1] >> (total - s) & 1:
            left[s] -= 1
            for rest in _any(total - s, i + 1, sizes, reach, left):
                left[s] += 1
                yield (s, *rest)
                left[s] -= 1
            left[s] += 1


def dominated(filling: tuple[int, ...], left: np.ndarray, room: int) -> bool:
    """Whether one piece that is left could stand for some of ``filling`` (several, or a shorter one) and still fit.

    ``left``: pieces beside those of the filling; the other filling leaves no
    more waste and uses up harder pieces, so this one need not be tried.
    """
    slack = room - sum(filling)
    several, seen, swap = 0, 1, 0
    for s in filling:
        several |= (several << s) | ((seen ^ 1) << s if seen > 1 else 0)
        seen |= seen << s
        swap |= ((1 << (s + slack + 1)) - 1) ^ ((1 << (s + 1)) - 1)  # longer than the piece, by no more than the slack
    width = 1
    while width <= slack:  # any sum of several, up to the slack more
        by = min(width, slack + 1 - width)
        several |= several << by
        width += by
    have = sum(1 << int(x) for x in np.flatnonzero(left[: room + 1]) if x)
    return bool((several | swap) & have)


def completions(left: np.ndarray, size: int, waste: int | None = None):
    """Undominated fillings around a piece of ``size`` that waste at most ``waste``, least waste first; few and even pieces come before many."""
    room = len(left) - 1 - size
    left = left.copy()
    left[size] -= 1
    sizes = [int(s) for s in np.flatnonzero(left[: min(room, size) + 1]) if s]
    reach = _sums(sizes, left, room)
    top, longest = reach[-1], sizes[-1] if sizes else 0
    for lost in range(0, min(room, room if waste is None else waste) + 1):
        total = room - lost
        if not top >> total & 1:
            continue
        if not total:
            if not sizes or sizes[0] > room:
                yield (size,)
            continue
        few = -(-total // longest)
        for parts in range(few, min(few + 2, 4)):
            for filling in _exact(total, parts, sizes[0], left, longest):
                rest = left.copy()
                np.subtract.at(rest, list(filling), 1)
                if not dominated(filling, rest, room):
                    yield (size, *filling)
        for filling in _any(total, len(sizes), sizes, reach, left):
            if few <= len(filling) < min(few + 2, 4):
                continue  # above
            rest = left.copy()
            np.subtract.at(rest, list(filling), 1)
            if (rest >= 0).all() and not dominated(filling, rest, room):
                yield (size, *filling)


def _uses(left: np.ndarray, waste: int):
    """Branches of a node: a filling around its largest piece and how often it is used, as often as its lengths last first."""
    size = int(np.flatnonzero(left)[-1])
    for filling in completions(left, size, waste):
        need = Counter(filling)
        for times in range(min(int(left[s]) // n for s, n in need.items()), 0, -1):
            yield filling, need, times


def _search(left: np.ndarray, path: Plan, least: int, bound: int, steps: int) -> tuple[Plan | None, int]:
    """Branch and bound behind the fillings of ``path``: the best plan of under ``least`` sequences it finds, and the steps that remain.

    Depth first; ends when ``bound`` is met, all branches are done, or no step is left.
    """
    cap, best, kept = len(left) - 1, None, len(path)
    left, path, used = left.copy(), list(path), sum(n for _, n in path)
    waste = sum(n * (cap - sum(f)) for f, n in path)
    volume = int((left * np.arange(cap + 1)).sum()) + used * cap - waste
    may_waste = lambda: (least - 1) * cap - volume  # what a plan of one sequence less would waste
    open_ = [_uses(left.copy(), may_waste() - waste)] if left.any() and waste <= may_waste() else []
    while open_ and least > bound and steps > 0:
        filling, need, times = next(open_[-1], (None, None, 0))
        if not times:  # all branches of the node are done
            open_.pop()
            if len(path) > kept:
                filling, times = path.pop()
                for s in filling:
                    left[s] += times
                used, waste = used - times, waste - times * (cap - sum(filling))
            continue
        steps -= 1
        more = times * (cap - sum(filling))
        if waste + more > may_waste():
            continue
        for s, n in need.items():
            left[s] -= n * times
        path.append((filling, times))
        used, waste = used + times, waste + more
        if not left.any():
            best, least = list(path), used
        elif not steps % DIVE:
            rest = best_fit_decreasing(left)
            if used + sum(n for _, n in rest) < least:
                best, least = [*path, *rest], used + sum(n for _, n in rest)
        # A node whose rest needs too much by its own bound has no branches.
        go = left.any() and used + lower_bound(left) < least
        open_.append(_uses(left.copy(), may_waste() - waste) if go else iter(()))
    return best, steps


def plan(counts: np.ndarray, steps: int = STEPS) -> Plan:
    """Fillings and how often each is used, for a histogram of lengths from 0 to the capacity.

    Best-fit decreasing is the incumbent.  The search then starts behind parts
    of it: what best fit did with pieces above some length, half the capacity
    first, is kept, and the rest completed.  Last it starts from nothing, where
    a search that comes to its end has tried all.
    """
    cap = len(counts) - 1
    bound = lower_bound(counts)
    fit = incumbent = best_fit_decreasing(counts)
    least = sum(n for _, n in incumbent)
    starts = sorted(range(cap // 4, cap, max(1, cap // 40)), key=lambda x: abs(x - cap // 2 - 1))
    for nth, above in enumerate([*starts, cap + 1]):
        if least <= bound or steps <= 0:
            break
        path = [(f, n) for f, n in fit if f[0] > above]
        left = counts.copy()
        for f, n in path:
            for s in f:
                left[s] -= n
        share = steps if above > cap else max(1, steps // (len(starts) + 1 - nth))
        found, unused = _search(left, path, least, bound, share)
        steps -= share - unused
        if found:
            incumbent, least = found, sum(n for _, n in found)
    return incumbent


def _cut(vocabulary: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc, tail = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, _, data, at in slabs(batch):
                doc, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(enc.encode(texts_of(data, at)), lo):
                    body = ids.tobytes() + tail
                    n = len(ids) + 1
                    a, k = 0, 0
                    while a < n:
                        size = n % capacity if not k and n % capacity else min(capacity, n)
                        for to, x in ((doc, i), (piece, k), (start, a), (length, size), (crc, zlib.crc32(body[4 * a : 4 * (a + size)])), (rank, int(seen[size]))):
                            to.append(x)
                        seen[size] += 1
                        a, k = a + size, k + 1
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(doc), pa.int32()), pa.array(rank, pa.int64())],
                    names=["row_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every row, written once: of a long document the first is the shorter one."""
    rows = docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_cut(vocabulary, capacity, end_id), "row_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: where it comes from, and its sequence and place there.

    Null or empty text is the end id alone; keys are whole numbers or null, and
    null stays null; repeated rows are packed each; other columns are not read;
    no rows give no rows.
    """
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, capacity, end_id, key, text)
    cells = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    begins = cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).select("length", "part", "before")
    # Slots of the plan: pieces of a length take them by rank. Their number depends on the capacity and the search, not on the data's size.
    slots, sequence = [], 0
    taken = Counter()
    for filling, times in plan(counts):
        offset = 0
        for size in filling:
            slots.append((size, taken[size], taken[size] + times, sequence, offset))
            taken[size] += times
            offset += size
        sequence += times
    by_size: dict[int, list] = {}
    for size, a, b, seq, off in slots:
        by_size.setdefault(size, []).append((a, b, seq, off))
    first = np.full(capacity + 2, 0, np.int64)
    flat = []
    for size in range(capacity + 1):
        first[size] = len(flat)
        flat += by_size.get(size, [])
    first[capacity + 1] = len(flat)
    table = np.array(flat, np.int64).reshape(-1, 4)

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                part = table[first[size] : first[size + 1]]
                k = np.searchsorted(part[:, 0], rank[at], side="right") - 1
                seq[at], off[at] = part[k, 2] + rank[at] - part[k, 0], part[k, 3]
            yield pa.record_batch([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(begins, ["length", "part"]).select("row_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    out = "row_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, out) if len(table) else spark.createDataFrame([], out)
