"""SimHash near-dedup with a segment-popcount embedding.

A 64-bit fingerprint is cut into segments of two bits; the numbers of bits set in
them are its place in a grid.  A differing bit moves one coordinate by one, so
the Manhattan distance of two places is a lower bound of the Hamming distance.
The coordinates lie in three groups.  At a distance of up to four, one group has
a Manhattan distance of at most one; so a fingerprint meets its neighbours in a
group's cell or in those one step up, and each meeting is verified exactly.

All of this is done on distinct fingerprints, so exact copies cost nothing.  A
cell hands on a spanning forest of the links it has verified, never all pairs.
Components come from alternating large and small stars over written tables.

Texts that share 0.8 of their shingles lie up to a fifth of the bits apart.  At
that radius every cell of the grid neighbours every other, so ``similar_groups``
takes the cells of such pairs from min-wise samples of the shingles.  Fingerprints
of 256 bits only sort out pairs that can't be that alike; a link is a pair whose
sets of shingle hashes share that much.  With a ``distance``, what the grid links
is linked too, and components are those of both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import Words, mix, removed, row_key, slabs, stored, windows

DISTANCE, SHINGLE, SEED = 4, 4, 42
GROUPS, WIDTH = 3, 2
#: Pairs that are compared at once in a task; rows of one cell above which it is split.
PAIRS, CELL_ROWS = 4 << 20, 20_000
#: Rows of one cell above which it is split where whole sets of shingles are compared.
SET_ROWS = 1000


@dataclass(frozen=True)
class Similar:
    """Texts whose sets of shingles are alike.

    Two texts meet where one of ``bands`` samples of ``rows`` shingles agrees: at
    a similarity of 0.8, all but 7 in 10,000 pairs do.  They link if their sets
    have ``least`` (a fraction) of their union in common.  Pairs of which more
    than ``bits`` of 256 differ aren't compared: at 0.8, 39 do on average (48 in
    the smallest sets), with a deviation of 6.  Pairs within ``close`` come first.
    """

    shingle: int = 5
    bands: int = 24
    rows: int = 6
    bits: int = 96
    close: int = 50
    least: tuple[int, int] = (4, 5)
    seed: int = 42


def shingle_bytes(w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank behind each, and where each begins and ends there."""
    sizes = w.ends - w.starts
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    keep = np.zeros(len(w.data) + 1, np.int8)
    keep[w.starts] += 1
    keep[w.ends + 1] -= 1
    out = w.data[np.cumsum(keep[:-1], dtype=np.int8).view(bool)] if len(sizes) else w.data[:0]
    out = out.copy()
    out[begins + sizes] = 32
    return out.tobytes(), begins, begins + sizes


def fingerprint_slab(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprints of the documents of a slab."""
    import xxhash

    w = Words(data, at, lower=True)
    body, begins, ends = shingle_bytes(w)
    many = w.per_doc
    count = np.where(many >= shingle, many - shingle + 1, np.minimum(many, 1))
    doc = np.repeat(np.arange(w.docs), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    head = w.first[doc] + nth
    tail = np.minimum(head + shingle, w.first[doc + 1]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(body[a:b], seed) for a, b in zip(begins[head].tolist(), ends[tail].tolist())), np.uint64, len(doc))
    out = np.zeros(w.docs, np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, (np.cumsum(count) - count)[has], axis=0, dtype=np.int32)
        over = 2 * ones > count[has, None]
        out[has] = np.packbits(over, axis=1).view(">u8").ravel()
    return out


def _fingerprints(shingle: int, seed: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(fingerprint_slab(data, at, shingle, seed).view(np.int64))], names=["row_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the 64-bit fingerprint (as a signed number) of every row; zero for null and for texts without words."""
    return docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text")).mapInArrow(_fingerprints(shingle, seed), "row_id long, fp long")


def places(fp: np.ndarray, groups: int = GROUPS, width: int = WIDTH):
    """For each group: cell numbers, and for each coordinate of it where it can go up and by how much the cell's number grows."""
    for g in range(groups):
        lo, hi = 64 * g // groups, 64 * (g + 1) // groups
        cell, steps, base = np.zeros(len(fp), np.int64), [], 1
        for a in range(lo, hi, width):
            size = min(width, hi - a)
            count = np.bitwise_count((fp >> np.uint64(a)) & np.uint64((1 << size) - 1)).astype(np.int64)
            cell += count * base
            steps.append((count < size, base))
            base *= size + 1
        yield cell * groups + g, [(up, base * groups) for up, base in steps]


def _cells(groups: int, width: int):
    def run(batches):
        for batch in batches:
            signed = batch.column(0).to_numpy()
            fp = signed.view(np.uint64)
            for cell, steps in places(fp, groups, width):
                rows = [(cell, signed, np.ones(len(fp), bool))] + [(cell[up] + by, signed[up], np.zeros(int(up.sum()), bool)) for up, by in steps]
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*rows)], names=["cell", "fp", "home"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link for each node but the smallest of each."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[at]], nodes[at]


def links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in whole cells; rows are sorted by cell, those at home first."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0)))
    size = np.diff(np.append(first, len(cell)))
    at_home = np.add.reduceat(home, first, dtype=np.int64)
    # The k-th row at home is compared with all rows of its cell behind it.
    own = np.repeat(first, at_home) + np.arange(int(at_home.sum())) - np.repeat(np.cumsum(at_home) - at_home, at_home)
    behind = np.repeat(first + size, at_home) - own - 1
    unsigned = fp.view(np.uint64)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(behind)))
    i = 0
    while i < len(own):
        j = max(i + 1, int(np.searchsorted(total, total[i] + pairs, side="right")) - 1)
        left = np.repeat(own[i:j], behind[i:j])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[i:j] - total[i], behind[i:j])
        near = np.flatnonzero(np.bitwise_count(unsigned[left] ^ unsigned[right]) <= distance)
        if len(near):
            a, b = _forest(np.concatenate((a, fp[left[near]])), np.concatenate((b, fp[right[near]])))
        i = j
    return a, b


def _by_cell(out, least: int = 200_000):
    """Hands ``out`` tables of whole cells; rows come sorted by cell."""

    def run(batches):
        left: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            left.append(batch)
            rows += batch.num_rows
            if rows < least:
                continue
            table = pa.Table.from_batches(left).combine_chunks()
            cell = table["cell"].to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield out(table.slice(0, cut))
                left = table.slice(cut).to_batches()
                rows -= cut
        if left:
            yield out(pa.Table.from_batches(left))

    return run


def _meet(distance: int):
    def out(table):
        a, b = links(*(table[c].to_numpy() for c in ("cell", "fp", "home")), distance)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return _by_cell(out)


def _dealt(cells: DataFrame, cell_rows: int, alone: bool) -> DataFrame:
    """``cells`` (cell, fp, ...) with cells of over ``cell_rows`` rows dealt out in blocks; without cells of one row unless ``alone``.

    Rows of such a cell fall into parts by ``fp``, and each pair of parts is a
    block: all pairs of rows meet, and no block has more than about two parts.
    """
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (cell_rows if alone else 1))
    rows = cells.join(counts, "cell", "left" if alone else "inner")
    parts = F.coalesce(F.ceil(F.col("n") / cell_rows), F.lit(1)).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least("own", q).cast("long") * F.col("parts") + F.greatest("own", q))
    rows = rows.select("*", F.explode(blocks).alias("block"))
    cell = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", "block"))
    return rows.select(cell.alias("cell"), *(c for c in cells.columns if c != "cell"))


def near_links(distinct: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a < b) of distinct fingerprints (column ``fp``) that differ in at most ``distance`` bits: a spanning forest of each cell's.

    A cell of more than ``cell_rows`` rows is dealt out in blocks of two parts each.
    """
    groups = max(1, -(-(distance + 1) // 2))
    cells = distinct.select("fp").mapInArrow(_cells(groups, WIDTH), "cell long, fp long, home boolean")
    rows = _dealt(cells, cell_rows, alone=True)
    return rows.repartition("cell").sortWithinPartitions("cell", F.col("home").desc()).mapInArrow(_meet(distance), "a long, b long").distinct()


def shingle_sets(data: np.ndarray, at: np.ndarray, rule: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document of a slab: a hash of its set of shingles.  Then all sets: ascending hashes, and the document of each."""
    w = Words(data, at, lower=True)
    words = w.hashes()
    h, start = windows(words, w.first, rule.shingle)
    doc = np.searchsorted(w.first, start, side="right") - 1
    for n in range(1, rule.shingle):  # shorter texts: the whole sequence
        few = np.flatnonzero(w.per_doc == n)
        whole = np.full(len(few), n, np.uint64)
        for k in range(n):
            whole = mix(whole * np.uint64(0x9FB21C651E98DF25) + words[w.first[few] + k])
        h, doc = np.concatenate((h, whole)), np.concatenate((doc, few))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    name = np.zeros(w.docs, np.uint64)
    if len(h):
        first = np.flatnonzero(np.concatenate(([True], np.diff(doc) != 0)))
        size = np.diff(np.append(first, len(doc)))
        name[doc[first]] = mix(np.add.reduceat(mix(h + np.uint64(rule.seed)), first) + size.astype(np.uint64))
    return name, h, doc


def sketch_slab(data: np.ndarray, at: np.ndarray, rule: Similar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document of a slab: a hash of its set of shingles, a fingerprint of four words, the cells of its samples."""
    name, h, doc = shingle_sets(data, at, rule)
    sketch, cells = np.zeros((len(name), 4), np.uint64), np.zeros((len(name), rule.bands), np.uint64)
    if not len(h):
        return name, sketch, cells
    first = np.flatnonzero(np.concatenate(([True], np.diff(doc) != 0)))
    has, size = doc[first], np.diff(np.append(first, len(doc)))
    rng = np.random.Generator(np.random.PCG64(rule.seed))
    for k in range(4):
        bits = np.unpackbits(mix(h ^ rng.integers(0, 1 << 63, dtype=np.uint64)).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        sketch[has, k] = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()
    for band in range(rule.bands):
        cell = np.full(len(has), band, np.uint64)
        for _ in range(rule.rows):
            turned = h * (rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) + rng.integers(0, 1 << 63, dtype=np.uint64)
            cell = mix(cell * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(turned, first))
        cells[has, band] = cell
    return name, sketch, cells


_SKETCH = [f"s{k}" for k in range(4)]


def _sketches(rule: Similar, grid: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                name, sketch, cells = sketch_slab(data, at, rule)
                prints = [pa.array(fingerprint_slab(data, at).view(np.int64))] if grid else []
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * rule.bands), pa.array(cells.view(np.int64).ravel()))
                words = [pa.array(np.ascontiguousarray(sketch[:, k]).view(np.int64)) for k in range(4)]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(name.view(np.int64)), *words, lists, *prints], names=["row_id", "fp", *_SKETCH, "cells", *["print"] * grid])

    return run


def tree_links(cell: np.ndarray, fp: np.ndarray, sketch: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Trees that connect the rows of each cell (rows are sorted by cell) which chains of at most ``bits`` differing bits connect."""
    first = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0)))
    size = np.diff(np.append(first, len(cell)))
    two = first[size == 2]
    two = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(axis=1, dtype=np.int64) <= bits]
    a, b = [fp[two]], [fp[two + 1]]
    for i, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        left = np.arange(i, i + n)
        while len(left) > 1:
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                x = reached.pop()
                near = np.bitwise_count(sketch[left] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= bits
                if near.any():
                    hit, left = left[near], left[~near]
                    a.append(np.full(len(hit), fp[x]))
                    b.append(fp[hit])
                    reached.extend(hit.tolist())
    return np.concatenate(a), np.concatenate(b)


def _sketch_of(table) -> np.ndarray:
    return np.column_stack([table[c].to_numpy() for c in _SKETCH]).view(np.uint64)


def _trees(rule: Similar):
    def out(table):
        cell, fp, sketch = table["cell"].to_numpy(), table["fp"].to_numpy(), _sketch_of(table)
        (a, b), (c, d) = (tree_links(cell, fp, sketch, bits) for bits in (rule.close, rule.bits))
        # Of the wider trees both ends count as met, also those that nothing leads to.
        return pa.record_batch([pa.array(np.concatenate((b, d, c))), pa.array(np.concatenate((a, c, c))), pa.array(np.arange(len(a) + 2 * len(c)) >= len(a))], names=["fp", "other", "far"])

    return _by_cell(out)


def open_rows(cell: np.ndarray, label: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """Which rows (sorted by cell) have, in their cell, one of another label at most ``bits`` bits away."""
    out = np.zeros(len(cell), bool)
    first = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0)))
    size = np.diff(np.append(first, len(cell)))
    for i, n in zip(first.tolist(), size.tolist()):
        names, own, many = np.unique(label[i : i + n], return_inverse=True, return_counts=True)
        if len(names) == 1:
            continue
        part = sketch[i : i + n]
        for x in np.flatnonzero(own != np.argmax(many)).tolist():  # pairs have an end outside the largest
            near = (np.bitwise_count(part ^ part[x]).sum(axis=1, dtype=np.int64) <= bits) & (own != own[x])
            if near.any():
                out[i : i + n] |= near
                out[i + x] = True
    return out


def _open(bits: int):
    def out(table):
        cell, fp, label = (table[c].to_numpy() for c in ("cell", "fp", "label"))
        at = np.flatnonzero(open_rows(cell, label, _sketch_of(table), bits))
        return pa.record_batch([pa.array(cell[at]), pa.array(fp[at]), pa.array(label[at])], names=["cell", "fp", "label"])

    return _by_cell(out)


def set_links(label: np.ndarray, sets: np.ndarray, at: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Links of one cell's rows that join different labels: pairs (row numbers) whose sets share ``least`` of their union.

    The set of row k is ``sets[at[k] : at[k + 1]]``.
    """
    size = np.diff(at)
    _, flat = np.unique(sets, return_inverse=True)
    owner = np.repeat(np.arange(len(label)), size)
    order = np.argsort(flat, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(flat))))
    posted, label = owner[order], label.copy()
    a, b = [], []
    for x in range(len(label) - 1):
        if (label[x + 1 :] == label[x]).all():
            continue
        ids = flat[at[x] : at[x + 1]]
        many = starts[ids + 1] - starts[ids]
        where = np.repeat(starts[ids] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        shared = np.bincount(posted[where], minlength=len(label))
        hit = np.flatnonzero((least[1] * shared >= least[0] * (size + size[x] - shared)) & (label != label[x]))
        if len(hit):
            _, one = np.unique(label[hit], return_index=True)
            a += [x] * len(one)
            b += hit[one].tolist()
            label[np.isin(label, label[hit])] = label[x]
    return np.array(a, np.int64), np.array(b, np.int64)


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and at which each list begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(sizes)))


def _exact(least: tuple[int, int]):
    def out(table):
        cell, fp, label = (table[c].to_numpy() for c in ("cell", "fp", "label"))
        sets, at = _lists(table["shingles"])
        first = np.flatnonzero(np.concatenate(([True], np.diff(cell) != 0)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(cell)]):
            left, right = set_links(label[i:j], sets[at[i] : at[j]], at[i : j + 1] - at[i], least)
            a.append(fp[i + left])
            b.append(fp[i + right])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_cell(out, 2 * SET_ROWS)


def _alike(least: tuple[int, int]):
    def run(batches):
        for batch in batches:
            one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (x, at), (y, to) = _lists(batch.column(2)), _lists(batch.column(3))
            keep = np.zeros(len(one), bool)
            for k in range(len(one)):
                u, v = x[at[k] : at[k + 1]], y[to[k] : to[k + 1]]
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep[k] = least[1] * shared >= least[0] * (len(u) + len(v) - shared)
            yield pa.record_batch([pa.array(np.minimum(one, two)[keep]), pa.array(np.maximum(one, two)[keep])], names=["a", "b"])

    return run


def _sets(rule: Similar):
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                name, h, doc = shingle_sets(data, at, rule)
                ends = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.record_batch([pa.array(name.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["fp", "shingles"])

    return run


def similar_links(rows: DataFrame, distinct: DataFrame, rule: Similar = Similar(), cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a < b) of distinct texts (columns fp, least, s0 to s3, cells) that are similar; they connect all that meet and are, never all pairs.

    First each text is held against one other, the likeliest.  That leaves few
    pairs of a cell in different components; for these the sets go to the cell.
    ``rows`` (row_id, text) are read again, for the sets of texts that meet any.
    """
    cells = distinct.select(F.explode("cells").alias("cell"), "fp", *_SKETCH)
    trees = _dealt(cells, cell_rows, alone=False).repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_trees(rule), "fp long, other long, far boolean")
    met = stored(trees.groupBy("fp").agg(F.min(F.when(F.col("other") != F.col("fp"), F.struct("far", "other"))).alias("m")).select("fp", "m.other"), "met")
    ids = distinct.join(met, "fp", "left_semi").select(F.col("least").alias("_id")).distinct()
    texts = rows.join(ids, rows["row_id"].eqNullSafe(ids["_id"]), "left_semi").select("text")
    found = texts.mapInArrow(_sets(rule), "fp long, shingles array<long>").join(met, "fp", "left_semi")
    sets = stored(found.groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")

    pairs = met.filter("other is not null").join(sets, "fp")
    pairs = pairs.join(sets.select(F.col("fp").alias("other"), F.col("shingles").alias("others")), "other").select("fp", "other", "shingles", "others")
    sure = stored(pairs.mapInArrow(_alike(rule.least), "a long, b long"), "sure")

    label = components(sure).withColumnRenamed("node", "fp")
    named = distinct.join(met.select("fp"), "fp").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    cells = stored(named.select(F.explode("cells").alias("cell"), "fp", "label", *_SKETCH), "cells")
    left = _dealt(cells, cell_rows, alone=False).repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_open(rule.bits), "cell long, fp long, label long")
    left = _dealt(stored(left, "open"), SET_ROWS, alone=False).join(sets, "fp")
    more = left.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_exact(rule.least), "a long, b long")
    return sure.unionByName(more).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of all nodes with links; columns a, b."""

    def least(pairs):
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")), "edges")
    before = None
    while True:
        # Large star: neighbours above a node go to the smallest around it.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its neighbours below go to the smallest of these.
        low = least(large)
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges, last = stored(small, "edges"), edges
        removed(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: row_id, fp and component_id, the smallest key that can be reached.

    Texts without words have fingerprint zero and link like others; repeated
    rows give repeated rows; a null key stays null and, where a group has other
    keys, names no group; other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle, seed, key, text), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("row_id").alias("least")), "distinct")
    return _grouped(prints, distinct, near_links(distinct, distance))


def _grid_links(prints: DataFrame, distance: int, cell_rows: int) -> DataFrame:
    """Links (a, b) of sets of shingles (``fp``) whose texts' 64-bit fingerprints (``print``) are equal or, by the grid, differ in at most ``distance`` bits."""
    both = stored(prints.select("print", "fp").distinct(), "prints")
    heads = stored(both.groupBy("print").agg(F.min("fp").alias("head")), "heads")
    equal = both.join(heads, "print").filter("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    near = near_links(heads.select(F.col("print").alias("fp")), distance, cell_rows)
    ends = [heads.select(F.col("print").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b")]
    return near.join(ends[0], "a").join(ends[1], "b").filter("head_a <> head_b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b")).unionByName(equal)


def similar_groups(docs: DataFrame, rule: Similar = Similar(), cell_rows: int = CELL_ROWS, key: str = "doc_id", text: str = "text", distance: int | None = None) -> DataFrame:
    """One row per input row: row_id, fp (names the set of shingles) and component_id, the smallest key that similar texts reach.

    Words are lower-cased (A-Z).  Texts of fewer words than a shingle are one
    shingle; null texts and texts without words are alike; repeated rows give
    repeated rows; null keys as in ``groups``; other columns are not read.  With
    ``distance``, texts that ``groups`` links at this distance are linked as well.
    """
    grid = distance is not None
    rows = docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text"))
    schema = f"row_id long, fp long, {', '.join(f'{c} long' for c in _SKETCH)}, cells array<long>{', print long' * grid}"
    prints = stored(rows.mapInArrow(_sketches(rule, grid), schema), "sketches")
    same = [F.first(c).alias(c) for c in (*_SKETCH, "cells")]  # equal sets have equal sketches
    distinct = stored(prints.groupBy("fp").agg(F.min("row_id").alias("least"), *same), "distinct")
    edges = similar_links(rows, distinct, rule, cell_rows)
    if grid:
        edges = edges.unionByName(_grid_links(prints, distance, cell_rows))
    return _grouped(prints.select("row_id", "fp"), distinct.select("fp", "least"), edges)


def _grouped(prints: DataFrame, distinct: DataFrame, edges: DataFrame) -> DataFrame:
    label = components(edges)
    named = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "label").select("fp", "component_id")
    return prints.join(by_print, "fp").select("row_id", "fp", "component_id")


def _firsts(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    chosen = found.filter(F.col("row_id").eqNullSafe(F.col("component_id"))).select(F.col("row_id").alias("_kept")).distinct()
    return docs.join(chosen, docs[key].cast("long").eqNullSafe(chosen["_kept"]), "left_semi").select(*docs.columns)


def keep(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group the row with the smallest key (of rows that share it, each).  Rows with a null key stay if their group has no other."""
    return _firsts(docs, groups(docs, distance, key=key, text=text), key)


def keep_similar(docs: DataFrame, rule: Similar = Similar(), key: str = "doc_id", text: str = "text", distance: int | None = None) -> DataFrame:
    """``keep`` for the groups of ``similar_groups``."""
    return _firsts(docs, similar_groups(docs, rule, key=key, text=text, distance=distance), key)
