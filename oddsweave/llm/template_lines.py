"""Line dedup with a tree of log templates.

A line goes down a tree of fixed depth: first by its number of tokens, then by
its leading tokens, tokens with a digit counting as a variable field.  In a
leaf, templates generalise: what stands behind the leading tokens is cut into
four segments, and a template holds two of them fast and lets the others vary.
So lines of a leaf that agree, masked fields aside, but for fields in any two
segments have a template in common, whatever their order and number.  Short
lines have one template, themselves; in the shortest no field is masked.

A template that occurs in ``min_docs`` documents or more recurs; the shortest
lines, which ordinary sentences may share, do from a share of all documents on.
Lines under it are dropped everywhere but in the document of the smallest id
that has it.

A template is known by a 64-bit hash, computed from the line alone, so no leaf
is ever collected: counting documents of a template is one aggregation with
partial sums, however large the leaf or common the line.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from oddsweave.llm._shared import Words, free_name, mix, row_key, slabs, stored

_VARIABLE = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Tree:
    """``depth``: leading tokens that must agree; lines of ``wild_tokens`` or more may vary in ``wild`` of ``segments``.

    Lines of fewer than ``min_tokens`` recur in ``short_docs`` documents or more
    that are ``short_share`` of all rows or more.
    """

    depth: int = 3
    segments: int = 4
    wild: int = 2
    min_tokens: int = 5
    wild_tokens: int = 12
    min_docs: int = 2
    short_docs: int = 20
    short_share: float = 0.005


def lines_of(data: np.ndarray, at: np.ndarray, tree: Tree):
    """Lines of a slab (first byte, end, document) and their templates: hashes (odd for the shortest lines), and the line of each."""
    w = Words(data, at)
    breaks = np.flatnonzero(w.data == 10)  # every document has one more, at its end
    begins, ends = np.concatenate(([0], breaks[:-1] + 1)), breaks
    doc = np.searchsorted(w.doc_at, begins, side="right") - 1
    first = np.searchsorted(w.starts, np.concatenate((begins, [len(w.data)])))
    tokens = np.diff(first)
    digits = np.concatenate(([0], np.cumsum((w.data >= 48) & (w.data <= 57))))
    line = np.repeat(np.arange(len(tokens)), tokens)
    place = np.arange(len(line)) - first[line]
    masked = (digits[w.ends] > digits[w.starts]) & (tokens[line] >= tree.min_tokens)
    h = np.where(masked, _VARIABLE, w.hashes())
    h = mix(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h)))
    whole = total[first[1:]] - total[first[:-1]]
    lead = np.minimum(first[:-1] + tree.depth, first[1:])
    leaf = mix((total[lead] - total[first[:-1]]) + tokens.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    short = np.flatnonzero((tokens >= tree.min_tokens) & (tokens < tree.wild_tokens))
    long = np.flatnonzero(tokens >= max(tree.wild_tokens, tree.min_tokens, tree.depth + tree.segments))
    tiny = np.flatnonzero((tokens > 0) & (tokens < tree.min_tokens))
    hashes, owner = [mix(leaf[short] + whole[short])], [short]
    behind = tokens[long] - tree.depth
    edge = [total[lead[long] + behind * k // tree.segments] for k in range(tree.segments + 1)]
    for nth, loose in enumerate(combinations(range(tree.segments), tree.wild), 1):
        held = leaf[long] + whole[long]
        for k in loose:
            held = held - (edge[k + 1] - edge[k])
        hashes.append(mix(held + np.uint64(nth)))
        owner.append(long)
    even, odd = np.concatenate(hashes) & ~np.uint64(1), mix(leaf[tiny] + whole[tiny]) | np.uint64(1)
    return w, begins, ends, doc, np.concatenate((even, odd)).view(np.int64), np.concatenate((*owner, tiny))


def _templates(tree: Tree):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, at in slabs(batch):
                *_, doc, hashes, owner = lines_of(data, at, tree)
                pair = np.unique(np.column_stack((doc[owner], hashes)), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
                yield pa.record_batch([pa.array(pair[:, 1]), pa.array(ids[lo:hi][pair[:, 0]], pa.int64())], names=["template", "doc"])

    return run


def _document(docs: DataFrame, key: str, text: str) -> Column:
    """What a row counts as: its key; without one, a number far below zero that its text gives."""
    nameless = F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`")), 2) + F.lit(-(1 << 63))
    return F.coalesce(row_key(docs, key), nameless)


def templates(docs: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and template in it."""
    rows = docs.select(_document(docs, key, text).alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_templates(tree), "template long, doc long")


def recurring(found: DataFrame, docs: DataFrame, tree: Tree = Tree()) -> DataFrame:
    """Of ``templates`` of ``docs``: those in enough documents, with the number of documents and the first."""
    counts = found.groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    again = counts.filter((F.col("n_docs") >= tree.min_docs) & (F.col("first_doc") < F.col("last_doc"))).drop("last_doc")
    of_all = F.greatest(F.lit(tree.short_docs), tree.short_share * F.col("_rows"))
    least = F.when(F.col("template").bitwiseAND(F.lit(1)) == 1, of_all).otherwise(F.lit(tree.min_docs))
    return again.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("_rows")))).filter(F.col("n_docs") >= least).drop("_rows")


def _rewrite(tree: Tree):
    def run(batches):
        for batch in batches:
            new = batch.column(1).to_pylist()
            drop = batch.column(2)
            n_lines, n_dropped = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
            for lo, hi, data, at in slabs(batch):
                w, begins, ends, doc, hashes, owner = lines_of(data, at, tree)
                n_lines[lo:hi] = np.bincount(doc, minlength=hi - lo)
                part = drop.slice(lo, hi - lo)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                if not sizes.sum():
                    continue
                dropped = np.column_stack((np.repeat(np.arange(hi - lo), sizes), part.flatten().to_numpy(zero_copy_only=False)))
                pair = np.column_stack((doc[owner], hashes))
                code = np.unique(np.concatenate((dropped, pair)), axis=0, return_inverse=True)[1].ravel()
                gone = np.zeros(len(doc), bool)
                gone[owner[np.isin(code[len(dropped) :], code[: len(dropped)])]] = True
                n_dropped[lo:hi] = np.bincount(doc[gone], minlength=hi - lo)
                body = w.data.tobytes()
                for i in np.flatnonzero(n_dropped[lo:hi]):
                    a, b = np.searchsorted(doc, (i, i + 1))
                    new[lo + i] = b"\n".join(body[begins[k] : ends[k]] for k in range(a, b) if not gone[k]).decode()
            yield pa.record_batch([batch.column(0), pa.array(new, pa.string()), pa.array(n_lines), pa.array(n_dropped)], names=["record", "text", "lines", "dropped"])

    return run


def _drops(found: DataFrame, again: DataFrame) -> DataFrame:
    """doc and templates: which of its recurring templates each document loses."""
    again = stored(again, "recurring")
    rows = again.agg(F.sum("n_docs")).first()[0] or 0
    # Of all rows of ``found`` with a recurring template, those of templates that hold a 5000th of them each: under 5000 templates, whatever the data.
    hot = again.filter(F.col("n_docs") > max(10_000, rows // 5000))
    often = found.join(F.broadcast(hot.select("template", "first_doc")), "template")
    others = found.join(F.broadcast(hot.select("template")), "template", "left_anti")
    rare = others.join(again.join(F.broadcast(hot.select("template")), "template", "left_anti").select("template", "first_doc"), "template")
    lost = often.unionByName(rare).filter(F.col("doc") > F.col("first_doc"))
    return lost.groupBy("doc").agg(F.collect_set("template").alias("templates"))


def rewrite(docs: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with recurring lines taken out of their texts, and two more columns: ``_lines`` before, ``_dropped``.

    Every row is returned, no rows give no rows.  A null or empty text has one
    empty line and stays as it is.  Keys are whole numbers or null.  Rows with
    equal keys count as one document when it is asked where a template comes
    first: all keep the line; so do rows without a key that have equal texts,
    and these come before all others.  Other columns pass by; where one has the
    name of a new column, the new one has an underscore more behind it.
    """
    found = stored(templates(docs, tree, key, text), "templates")
    drops = _drops(found, recurring(found, docs, tree))
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(record.alias("record"), _document(docs, key, text).alias("doc")).join(drops, "doc", "left")
    rows = rows.select("record", F.col("record").getField(text).alias("text"), "templates")
    schema = StructType([rows.schema["record"], StructField("text", StringType()), StructField("lines", LongType()), StructField("dropped", LongType())])
    new = rows.mapInArrow(_rewrite(tree), schema)
    own = [F.col("text").cast(docs.schema[c].dataType).alias(c) if c == text else F.col("record").getField(c).alias(c) for c in docs.columns]
    return new.select(*own, F.col("lines").alias(free_name("_lines", docs.columns)), F.col("dropped").alias(free_name("_dropped", docs.columns)))


def keep(docs: DataFrame, tree: Tree = Tree(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` rewritten; rows that had words and are left without any are dropped; ``n_chars``, if there is one, is counted anew.

    Nulls, empty and repeated rows, keys and clashing names as in ``rewrite``.
    """
    dropped = F.col(free_name("_dropped", docs.columns))
    out = rewrite(docs, tree, key, text).filter((dropped == 0) | F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length(f"`{text}`").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))
