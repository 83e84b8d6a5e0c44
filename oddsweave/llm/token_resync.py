"""Token counts by overlap resynchronisation.

Texts of up to ``chunk`` characters are encoded as they are.  A longer one is
encoded in chunks that overlap, with offsets; two neighbours are spliced at a
boundary that both encodings have and that is proven stable:

* it lies between two pre-tokens in both (merges never cross pre-tokens);
* in the left chunk a character other than white space follows it, a margin
  before the chunk's end, so nothing that the chunk's end hides can move it.

From such a place on the pre-tokeniser depends on the following text alone, so
both encodings agree from there with that of the whole text.  If the overlap
has no such place, it is doubled and the pair is encoded again, up to the whole
rest of the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import row_key, slabs, texts_of

CHUNK, OVERLAP = 16384, 512
#: More characters than any added token of the vocabulary has.
MARGIN = 32


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


#: Beyond these letters the two libraries' character classes may be of different Unicode versions.
_FAR = re.compile("[\u0250-\U0010ffff]")
#: A longer text could exhaust the stack of one library's regexes.
LONGEST = 1 << 20


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them, without added tokens.

    Where the same vocabulary also exists as byte ranks, ``tiktoken`` encodes
    the texts for which both are known to agree, several times as fast: those
    of Latin letters without an added token's string.
    """

    def __init__(self, vocabulary: str):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(_path(vocabulary))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = _path(vocabulary).removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        return [np.array(self._ids(t), "<u4") for t in texts]

    def _ids(self, text: str):
        if self.fast and len(text) <= LONGEST and not any(s in text for s in self.special) and not _FAR.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return self.library.encode(text, add_special_tokens=False).ids


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary)


def boundaries(encoding, base: int) -> dict[int, int]:
    """Where pre-tokens start: place in the text, and how many tokens come before it in the chunk."""
    words, spans = encoding.word_ids, encoding.offsets
    out, last = {}, None
    for n, (word, (start, _)) in enumerate(zip(words, spans)):
        if word != last or word is None:
            out[base + start] = n
        last = word
    return out


def stable_until(text: str, end: int) -> int:
    """Boundaries before this place are proven in a chunk that ends at ``end``."""
    if end >= len(text):
        return len(text) + 1
    k = end - MARGIN - 1
    while k > 0 and text[k].isspace():
        k -= 1
    return max(k, 0)


def resynchronised(library, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of the whole text, and how often an overlap had to be widened."""
    total, widened = 0, 0
    start, before = 0, 0  # of the open chunk; tokens of it that the splice before it has counted already
    end = min(len(text), chunk)
    left = library.encode(text[:end], add_special_tokens=False)
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            stop = min(len(text), begin + max(chunk, 2 * width))
            right = library.encode(text[begin:stop], add_special_tokens=False)
            a, b = boundaries(left, start), boundaries(right, begin)
            limit = stable_until(text, end)
            common = max((p for p in b if p in a and p > begin and p < limit and a[p] >= before), default=None)
            if common is not None:
                break
            widened += 1
            if begin == start:  # nothing lies between: take both chunks as one
                end = min(len(text), max(end + chunk, start + 2 * (end - start)))
                left = library.encode(text[start:end], add_special_tokens=False)
                if end == len(text):
                    return total + len(left) - before, widened
            else:
                width *= 2
        total += a[common] - before
        left, start, end, before = right, begin, stop, b[common]
    return total + len(left) - before, widened


def _count(vocabulary: str, limit: int, chunk: int, overlap: int):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                part = texts_of(data, at)
                short = [k for k, t in enumerate(part) if len(t) <= chunk]
                n, widened = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for k, ids in zip(short, enc.encode([part[k] for k in short])):
                    n[k] = len(ids)
                for k, t in enumerate(part):
                    if len(t) > chunk:
                        n[k], widened[k] = resynchronised(enc.library, t, chunk, overlap)
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit), pa.array(widened)], names=["row_id", "n_bytes", "n_tokens", "over_limit", "n_widened"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: bytes, tokens as the library gives them, whether they are more than ``limit``.

    Null or empty text has none; repeated rows give repeated rows; keys are
    whole numbers or null; other columns are not read; no rows give no rows.
    ``n_widened``: how often an overlap had to be widened.  No shuffle.
    """
    schema = "row_id long, n_bytes long, n_tokens long, over_limit boolean, n_widened long"
    return docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text")).mapInArrow(_count(vocabulary, limit, chunk, overlap), schema)
