"""Quality rules by compression bands.

A document is compressed whole, and in chunks that cover all of it, with zstandard.  A ratio
(compressed bytes over bytes) below the band says the text repeats itself, one
above it says the text is noise.  What is usual depends on length, so the
limits do too.  Beside the bands stands a plain base rule on word counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import Words, mix, per_doc_sum, row_key, slabs, windows

#: Bytes from which a band holds, the least and the largest ratio that pass.
BANDS = ((0, 0.0, 9.0), (64, 0.30, 1.30), (128, 0.30, 1.05), (256, 0.30, 0.90), (512, 0.28, 0.85), (1024, 0.25, 0.77), (4096, 0.22, 0.72), (16384, 0.20, 0.70))
SYMBOLS = b"#*$%&|<>"

SCHEMA = "row_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_bytes long, ratio double, n_chunks long, n_chunks_low long, n_chunks_high long, band string"


@dataclass(frozen=True)
class Rules:
    """``chunk``: bytes of a chunk; a document fails when over ``chunk_share`` of its chunks lie outside their band.

    The last chunk ends where the text ends, so it may overlap the one before it.
    Texts shorter than a chunk have chunks of ``small`` bytes with limits of
    their own; those shorter still are one chunk, the band of their length.
    """

    level: int = 3
    chunk: int = 4096
    chunk_low: float = 0.25
    chunk_high: float = 0.72
    small: int = 512
    small_low: float = 0.28
    small_high: float = 0.75
    chunk_share: float = 0.34
    min_words: int = 50
    max_repeat_percent: int = 50


def band_of(n_bytes: int) -> tuple[int, float, float]:
    return next(b for b in reversed(BANDS) if n_bytes >= b[0])


def chunk_ratios(body: bytes, rules: Rules, pack) -> tuple[list[float], float, float]:
    """Ratios of the chunks that cover all of a text, and the least and the largest that pass."""
    size = len(body)
    step, low, high = (rules.chunk, rules.chunk_low, rules.chunk_high) if size >= rules.chunk else (rules.small, rules.small_low, rules.small_high)
    if size < step:
        return [len(pack(body)) / size] if size else [], *band_of(size)[1:]
    starts = [*range(0, size - step, step), size - step]
    return [len(pack(body[k : k + step])) / step for k in starts], low, high


def _measure(rules: Rules):
    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=rules.level, write_content_size=False).compress
        is_symbol = np.zeros(256, bool)
        is_symbol[list(SYMBOLS)] = True
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, at in slabs(batch):
                w = Words(data, at)
                starts_char = (data & 0xC0) != 0x80
                byte_first = at
                space = np.zeros(256, bool)
                space[[9, 10, 11, 12, 13, 32]] = True
                word_chars = per_doc_sum((starts_char & ~space[data]).view(np.int8), byte_first)
                symbols = per_doc_sum(is_symbol[data].view(np.int8), byte_first)
                h, at_word = windows(w.hashes(), w.first, 3)
                doc = w.doc_of()[at_word] if len(at_word) else at_word
                _, inverse, count = np.unique(mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
                again = np.zeros(len(w.starts), bool)
                hit = at_word[count[inverse] > 1]
                for k in range(3):
                    again[hit + k] = True
                repeat = per_doc_sum(again.view(np.int8), w.first)
                raw = data.tobytes()
                out = []
                for i in range(hi - lo):
                    body = raw[at[i] : at[i + 1]]
                    lines = [x for x in body.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
                    size = len(body)
                    ratio = len(pack(body)) / size if size else 0.0
                    chunks, chunk_low, chunk_high = chunk_ratios(body, rules, pack)
                    low, high = sum(x < chunk_low for x in chunks), sum(x > chunk_high for x in chunks)
                    _, least, most = band_of(size)
                    verdict = "empty" if not size else "repetitive" if ratio < least else "noisy" if ratio > most else "chunks" if low + high > rules.chunk_share * len(chunks) else "ok"
                    out.append((len(lines) - len(set(lines)), size, ratio, len(chunks), low, high, verdict))
                dup, size, ratio, n, low, high, verdict = zip(*out)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in (w.per_doc, word_chars, symbols, dup, repeat, size)), pa.array(ratio, pa.float64()), *(pa.array(x, pa.int64()) for x in (n, low, high)), pa.array(verdict, pa.string())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return run


def measure(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the key (as ``row_id``), the base counts, the ratios and the band's verdict.

    Null or empty text: no words, ratio 0, verdict ``empty``.  Rows that repeat
    give rows that repeat.  Other columns are not read.  No shuffle.
    """
    return docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text")).mapInArrow(_measure(rules), SCHEMA)


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``measure`` with base_failed (too few words, or too many of them in repeated windows) and kept."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return measure(docs, rules).withColumnRenamed("row_id", "doc_id").withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("band") == "ok"))


def _passes(rules: Rules):
    judge = _measure(rules)

    def run(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(batch.schema.get_field_index("text"))], names=["row_id", "text"])
            got = pa.Table.from_batches(list(judge([rows]))) if batch.num_rows else None
            if got is None:
                continue
            n, again = got["n_words"].to_numpy(), got["n_repeat_words"].to_numpy()
            keep = (n >= rules.min_words) & (100 * again <= rules.max_repeat_percent * n) & (got["band"].to_numpy() == "ok")
            yield batch.filter(pa.array(keep))

    return run


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they were, whatever they are called; judged in place, so no join and no shuffle.

    Null and empty texts have no words and go; repeated rows are judged alike;
    an empty table gives no rows.
    """
    return docs.mapInArrow(_passes(rules), docs.schema)
