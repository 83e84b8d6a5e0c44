"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oddsweave.llm import backoff_lm, bin_completion, compression_bands, external_shuffle, secret_automaton, simhash_popcount, string_tiling, subword_classifier, template_lines, token_resync
from oddsweave.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, fp string, _hash string"


def text(rng, n, words=40):
    vocabulary = ["der", "Die", "café", "x1", "and", "of", "The", "niño", "#a", "b|c", "日本"] + [f"w{k}" for k in range(words)]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", "  ", "\t", "\x0b"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    long = text(rng, 9000, 500)
    base = [text(rng, rng.randint(1, 200), 400) for _ in range(60)]
    near = base[5] + " tail"
    texts = [*base, long, None, "", "  \n\t ", base[7], base[7], base[5], near, "one two", "one two", "a", "x" * 3000]
    out = [(k, t) for k, t in enumerate(texts)]
    return [*out, (3, base[3]), (3, base[3]), (None, base[9]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "f", "h") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def held(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n == 0


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_scores(docs, rows, empty, order):
    """Against the formula of every order, token by token."""
    tokens = [[*words((t or "").translate(LOWER)), None] for _, t in rows]
    count = Counter()
    for (i, _), v in zip(rows, tokens):
        if not held(i, 10):
            count.update(tuple(v[k : k + n]) for n in range(1, order + 1) for k in range(len(v) - n + 1))
    n, v_size = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def p(gram):
        if len(gram) == 1:
            return (count[gram] + 0.1) / (n + 0.1 * (v_size + 1))
        return (count[gram] + 20 * p(gram[1:])) / (count[gram[:-1]] + 20)

    want = {}
    for (i, _), v in zip(rows, tokens):
        base = sum(math.log10(p((w,))) for w in v)
        s = sum(math.log10(p(tuple(v[max(0, k - order + 1) : k + 1]))) for k in range(len(v)))
        want.setdefault((i, len(v)), (held(i, 10), sum(count[(w,)] > 0 for w in v), n, base, s))
    got = backoff_lm.score(docs, order=order, block_bytes=4000, slice_rows=500).collect()
    assert len(got) == len(rows)
    for r in got:
        h, known, total, base, s = want[r.row_id, r.n_tokens]
        assert (r.held_out, r.n_known, r.train_tokens) == (h, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(s, abs=1e-8)
    assert backoff_lm.score(empty, order=order).count() == 0


def lm_of(texts, order):
    """The automaton of texts that are all learned, its tokens and lengths."""
    numbers = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    h = np.array([numbers[w] * 0x9E3779B97F4A7C15 % (1 << 64) for t in texts for w in t], np.uint64)
    lengths = np.array([len(t) for t in texts])
    totals = {n: np.unique(hashed, return_counts=True)[1] for n, _, hashed in backoff_lm.grams(h, lengths, order)}
    grams, tokens = backoff_lm.counted(h, lengths, order, totals.get)
    return backoff_lm.Automaton(grams, len(h), len(numbers)), tokens, lengths


def test_lm_states_sum_to_one_and_lanes_carry_state():
    rng = random.Random(12)
    texts = [[rng.choice("abcdefg") for _ in range(rng.randint(1, 90))] + ["$"] for _ in range(30)]
    model, tokens, lengths = lm_of(texts, 3)
    unseen = 0.1 / (len(tokens) + 0.1 * (model.words + 1))
    every = np.arange(model.words)
    for state in range(len(model.fail)):
        _, weight = model.step(np.full(model.words, state), every)
        out, at = unseen, state  # a word that training never saw takes every failure arc
        while at:
            out, at = out * 10 ** model.fail_weight[at], model.fail[at]
        ends_text = any(model.to[k] == state for k in np.flatnonzero(model.keys % model.words == tokens[-1]))
        assert ends_text or (10**weight).sum() + out == pytest.approx(1)
    whole = model.walk(tokens, lengths, lane=1 << 20)
    for lane in (1, 2, 7, 50):
        assert np.allclose(model.walk(tokens, lengths, lane=lane), whole, atol=1e-12)
    assert len(model.fail) > model.words + 1  # states of two words, too


def test_lm_numbers_are_packed_whole():
    rng = np.random.default_rng(3)
    for bits in (0, 5, 16, 21):
        for drop in (0, 8):
            v = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) >> np.uint64(drop) << np.uint64(drop)
            v = np.sort(v >> np.uint64(bits + drop) << np.uint64(drop) | np.uint64(0x5A5A5A5A5A5A5A5A) << np.uint64(64 - bits) if bits else v)
            cut = min(bits, 16)
            back = backoff_lm._unsorted(backoff_lm._sorted(v, cut, drop), cut, drop)
            assert (back == v & np.uint64((1 << 64 - cut) - 1)).all()
    for top in (0, 1, 255, 256, 70_000, 1 << 40):
        v = rng.integers(0, top + 1, 50)
        assert (backoff_lm._unpacked(backoff_lm._packed(v)) == v).all()
    assert len(backoff_lm._unpacked(backoff_lm._packed(np.zeros(0, np.int64)))) == 0


def test_bands_base_counts(docs, rows, empty):
    want = []
    for i, t in rows:
        w = words(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        bad = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), bad))
    got = compression_bands.verdicts(docs)
    same([tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()], want)
    kept = sorted(str(r[0]) for r in got.filter("kept").select("doc_id").collect())
    assert kept == sorted(str(r[0]) for r in compression_bands.keep(docs).select("doc_id").collect())
    assert compression_bands.keep(docs).columns == docs.columns and compression_bands.keep(empty).count() == 0


def test_bands_reject_repetition_and_noise(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) for _ in range(100))
    prose = " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "on", "th", "ing"]) for _ in range(3)) for _ in range(900))
    got = compression_bands.verdicts(spark.createDataFrame([(1, noise), (2, prose), (3, "lorem ipsum dolor " * 500)], "doc_id long, text string"))
    assert {r.doc_id: r.band for r in got.collect()} == {1: "noisy", 2: "ok", 3: "repetitive"}


def test_shuffle_law(docs, rows, empty):
    got = external_shuffle.shuffle(docs, 5, bucket_bytes=20_000).collect()
    same([(r.doc_id, r.text) for r in got], rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    again = external_shuffle.shuffle(docs.repartition(3), 5, bucket_bytes=20_000).collect()
    same([(r.shard, r.slot, r.doc_id) for r in got], [(r.shard, r.slot, r.doc_id) for r in again])
    assert external_shuffle.shuffle(empty).count() == 0
    few = external_shuffle.shuffle(docs.limit(3), 24).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2]


def test_shuffle_salts_repeated_rows(spark):
    one = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    got = external_shuffle.shuffle(one, 4, bucket_bytes=4000)
    assert got.count() == 6000
    assert got.groupBy("bucket").count().agg(F.max("count")).first()[0] < 3000
    assert [r["count"] for r in got.groupBy("shard").count().collect()] == [1500] * 4


def document(i, t):
    """A row's document: its key; rows without one are as old as their text, and older than others."""
    return i if i is not None else -(1 << 63) + zlib.crc32((t or "").encode())


def brute_templates(rows, tree):
    """Documents of every template, by tokens."""
    found, lines = {}, []
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            w = ["<*>" if re.search("[0-9]", x) else x for x in words(line)]
            keys = []
            if tree.min_tokens <= len(w) < tree.wild_tokens:
                keys = [tuple(w)]
            elif len(w) >= tree.wild_tokens:
                behind = len(w) - tree.depth
                edge = [tree.depth + behind * k // tree.segments for k in range(tree.segments + 1)]
                for loose in combinations(range(tree.segments), tree.wild):
                    held = [x for k in range(tree.segments) if k not in loose for x in w[edge[k] : edge[k + 1]]]
                    keys.append((loose, len(w), *w[: tree.depth], *held))
            lines.append((n, line, keys))
            for key in keys:
                found.setdefault(key, set()).add(document(i, t))
    return found, lines


def test_template_lines(spark, empty):
    rng = random.Random(5)
    mark = "this line of some length comes again in document {} with a number and a name in place of {} here"
    rows = [(k, "\n".join([text(rng, 30).replace("\n", " "), mark.format(k * 7, rng.choice(["x", "yy", "zz"])), "short line", "exactly five words stand here"])) for k in range(12)]
    rows += [(99, None), (None, "exactly five words stand here\nown line of this document alone"), (98, ""), (5, "exactly five words stand here")]
    frame = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in rows], "doc_id long, text string, n_chars int, template string").repartition(4)
    tree = template_lines.Tree()
    found, lines = brute_templates(rows, tree)
    want = []
    for n, (i, t) in enumerate(rows):
        key = document(i, t)
        own = [x for x in lines if x[0] == n]
        kept = [line for _, line, keys in own if not any(len(found[k]) > 1 and key > min(found[k]) for k in keys)]
        want.append((i, "\n".join(kept) if t is not None else None, len(own), len(own) - len(kept)))
    got = template_lines.rewrite(frame, tree)
    same([(r.doc_id, r.text, r._lines, r._dropped) for r in got.collect()], want)
    kept = template_lines.keep(frame, tree)
    assert kept.columns == frame.columns and not [r for r in kept.collect() if r.n_chars != len(r.text or "")]
    assert kept.filter("doc_id = 5").count() == 1  # its other row was one recurring line
    assert template_lines.keep(empty).count() == 0


def test_templates_vary_in_two_fields_and_hot_ones_drop(spark):
    """Words that vary in two places of a long line, one of them at the end; a line of every document; clashing, wide and nested columns; no keys."""
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    common = "every single document has this one line of some ten words"
    rows = [(k, f"{name()} {name()} own line {name()}\nreport of the day was written by {name()} for the board and signed in {name()}\n{common}") for k in range(300)]
    rows += [(None, common), (None, common), (None, f"{common}\n{name()} alone"), (None, None)]
    many = ", ".join(f"F.lit({k}).alias('column_with_a_long_name_{k}')" for k in range(60))
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS _doc", "1 AS _lines", "2 AS _dropped", "array(3) AS _drop", "named_struct('a', 4) AS record")
    frame = frame.select("*", *eval(f"[{many}]")).repartition(6)
    got = template_lines.rewrite(frame).collect()
    assert got[0].asDict().keys() == {*frame.columns, "_lines_", "_dropped_"}
    assert Counter(r._dropped_ for r in got if r.doc_id) == {2: 299} and all((r._doc, r._lines, r._dropped, r._drop, r.record.a) == (0, 1, 2, [3], 4) for r in got)
    # The oldest rows are those without keys: one text keeps the line, in all rows that have it.
    without = sorted((r.text or "", r._dropped_) for r in got if r.doc_id is None)
    assert sum(common in t for t, _ in without) in (1, 2) and len(without) == 4
    kept = template_lines.keep(frame)
    assert kept.columns == frame.columns and kept.filter("doc_id IS NOT NULL").count() == 300


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = Counter()
    for i, t in rows:
        ids[i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    got = bin_completion.pack(docs, capacity=128).collect()
    crc = lambda v: zlib.crc32(np.array(v, "<u4").tobytes())
    want = Counter()
    for (i, v), times in ids.items():
        cut = len(v) % 128 or min(128, len(v))
        bounds = [0, *range(cut, len(v) + 1, 128)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, k, a, b - a, crc(v[a:b])] += times
    assert Counter((r.row_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= 1.02 * -(-sum(r.length for r in got) // 128) + 1
    assert bin_completion.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_pieces_and_beats_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(20, 101, 60), minlength=101).astype(np.int64)
    made = bin_completion.plan(counts)
    used = Counter()
    for filling, times in made:
        assert sum(filling) <= 100
        for s in filling:
            used[s] += times
    assert all(used[s] == counts[s] for s in range(101))
    total = sum(n for _, n in made)
    assert bin_completion.lower_bound(counts) <= total <= sum(n for _, n in bin_completion.best_fit_decreasing(counts))


def test_tiling_finds_reordered_passages(spark, empty):
    rng = random.Random(2)
    item = [f"t{k}" for k in range(30)]
    other = [f"o{rng.randint(0, 50)}" for _ in range(4000)]
    rows = [
        (1, " ".join(other[:50] + item + other[50:90])),
        (2, " ".join(other[:50] + item[15:] + other[:40] + item[:15] + other[50:90])),
        (3, " ".join(other[:50] + item[:8] + other[50:90])),
        (4, ", ".join(x.upper() for x in item)),
        (5, " ".join(other)),
        (6, None),
        (7, ""),
        (1, " ".join(item)),
        (None, " ".join(item)),
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, "")], "item_id long, text string")
    got = string_tiling.pairs(docs, bench).collect()
    assert sorted((str(r.row_id), r.item_id, r.coverage, r.n_tiles) for r in got) == [("1", 1, 1.0, 1), ("1", 1, 1.0, 1), ("2", 1, 1.0, 2), ("4", 1, 1.0, 1), ("None", 1, 1.0, 1)]
    assert sorted(r.doc_id for r in string_tiling.keep(docs, bench).collect()) == [3, 5, 6, 7]
    assert string_tiling.pairs(empty, bench).count() == 0 and string_tiling.pairs(docs, bench.limit(0)).count() == 0
    assert string_tiling.keep(docs, bench.limit(0)).count() == len(rows)


def greedy_tiles(a, b, least):
    """Greedy tiling by its definition: longest common run of unmarked tokens, again and again."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return out
        n, i, j = best[0], -best[1], -best[2]
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
        out.append((i, j, n))


def test_tiles_against_plain_search():
    rng = random.Random(8)
    hashed = {c: np.uint64(rng.getrandbits(64)) for c in "abc"}
    for _ in range(60):
        a, b = [rng.choice("abc") for _ in range(25)], [rng.choice("abc") for _ in range(40)]
        assert string_tiling.tile(np.array([hashed[x] for x in a]), np.array([hashed[x] for x in b]), 3) == greedy_tiles(a, b, 3)


def test_pairs_against_plain_tiling(spark):
    """Every document against every item: passages in any order, torn, with repeats, or missing."""
    rng = random.Random(31)
    items = [[f"v{rng.randrange(30)}" for _ in range(rng.randint(4, 40))] for _ in range(12)]
    made = []
    for k in range(60):
        w = [f"v{rng.randrange(30)}" for _ in range(20)]
        for item in rng.sample(items, 2):
            cut = rng.randrange(len(item))
            for part in rng.sample([item[:cut], item[cut:]], 2):
                w += part + [f"u{k}"] * rng.randint(0, 3)
        made.append(w)
    rule = string_tiling.Tiling(least=4, coverage=0.6)
    want = {}
    for d, w in enumerate(made):
        for i, item in enumerate(items):
            tiles = greedy_tiles(item, w, 4)
            if tiles and sum(n for *_, n in tiles) >= 0.6 * len(item):
                want[d, i] = ",".join(f"{p}:{s}:{n}" for p, s, n in sorted(tiles))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(made)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.row_id, r.item_id): r.tiles for r in string_tiling.pairs(docs, bench, rule).collect()} == want and len(want) > 60


def test_tiling_of_long_repeats(spark):
    """A text of a million equal words against an item of a thousand takes the memory of the two."""
    docs = spark.createDataFrame([(1, "a " * 500_000), (2, "b " * 500_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a " * 1000)], "item_id long, text string")
    assert [(r.row_id, r.item_id, r.coverage, r.n_tiles) for r in string_tiling.pairs(docs, bench).collect()] == [(1, 7, 1.0, 1)]


def test_classifier_learns(spark, empty):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["apple", "stone", "river", "cloud", "green"]) + rng.choice(["", "s", "ly"]) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY", "$$$", "click", "win", "###"]) + rng.choice(["!", "!!"]) for _ in range(40)) for _ in range(150)]
    rows = [(k, t, int(k < 150)) for k, t in enumerate([*good, *bad])]
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(900, None, None), (901, "", None)], "doc_id long, text string, label string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (2, 7)], "doc_id long, quality int")
    model = subword_classifier.train(docs, labels, lambda key: key % 5 != 0, subword_classifier.Settings(rows=1 << 12))
    got = {r.row_id: r.score for r in subword_classifier.score(docs, model).collect()}
    assert len(got) == 302 and got[900] == got[901]
    assert all((got[i] >= 0.5) == y for i, _, y in rows if i % 5 == 0)
    none = subword_classifier.train(docs, labels.limit(0), lambda key: key > 0, subword_classifier.Settings(rows=1 << 12))
    assert {r.score for r in subword_classifier.score(docs, none).collect()} == {0.5}
    assert subword_classifier.score(empty, model).count() == 0


def test_secret_spans(spark, rows):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(6)
    parts = ["password = 'hunter22'", "API_KEY: abc", "AKIA" + "Z9" * 10, "AKIA" + "Z9" * 3, "0123456789abcdef" * 2, "deadbeef", "café ", "token:token=xyzxyz1", "secretpassword: longvalue1", "K", "x ", "\n"]
    own = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))) for _ in range(80)]
    texts = [*(t for _, t in rows), *own, "a" * 5000, "password=" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_automaton.scan(docs).collect():
        t = texts[r.row_id] or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 24]
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    clean = {r.doc_id: r.text for r in secret_automaton.redact(docs).collect()}
    assert secret_automaton.scan(spark.createDataFrame(list(clean.items()), "doc_id long, text string")).filter("n_access > 0").count() == 0


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    for chunk, overlap in ((16384, 512), (400, 20)):
        got = token_resync.count_tokens(docs, chunk=chunk, overlap=overlap)
        same([tuple(r) for r in got.select("row_id", "n_bytes", "n_tokens", "over_limit").collect()], want)
    assert token_resync.count_tokens(empty).count() == 0


def test_encoder_agrees_with_library():
    encode = token_resync.encoder("byte_bpe_50k.json")
    rng = random.Random(9)
    hard = ["a  b\n\n c \t\x0b d  e　f 12²½ it's IT'S <|endoftext|> x", " ", "  ", "İſ", "日本語 क्", "'LL 've\r\n\r\n 1,000.5"]
    alphabet = "ab \n\t'sS12.,é  中"
    for t in [*hard, *("".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300))]:
        assert list(encode.encode([t])[0]) == encode.library.encode(t, add_special_tokens=False).ids


def brute_fingerprint(t):
    w = words((t or "").lower())
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids = list(prints)
    label = {i: i for i in ids}
    while True:
        new = {i: min(label[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 4) for i in ids}
        if new == label:
            return label
        label = new


def test_simhash_groups(spark, docs, rows, empty):
    prints = {k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)}
    label = brute_components(prints)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    want = [(i, prints[k], least.get(label[k])) for k, (i, _) in enumerate(rows)]
    same([(r.row_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash_popcount.groups(docs).collect()], want)
    assert Counter(r.doc_id for r in simhash_popcount.keep(docs).collect()) == Counter(i for i, _, c in want if i == c)
    assert simhash_popcount.keep(docs).columns == docs.columns
    assert simhash_popcount.groups(empty).count() == 0


@pytest.mark.parametrize("cell_rows", [20_000, 7])
def test_simhash_chain_of_near_prints(spark, cell_rows):
    """Long chains and dense balls of fingerprints, links lost by none."""
    rng = random.Random(11)
    prints, at = [], rng.getrandbits(64)
    for _ in range(300):  # a chain: each is four bits from the last
        for b in rng.sample(range(64), 4):
            at ^= 1 << b
        prints.append(at)
    center = rng.getrandbits(64)
    prints += [center ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints += [rng.getrandbits(64) for _ in range(500)]
    v = np.array(prints, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    while True:
        new = np.where(near, label[None, :], len(v)).min(axis=1)
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long").distinct()
    got = {r.node: r.label for r in simhash_popcount.components(simhash_popcount.near_links(frame, cell_rows=cell_rows)).collect()}
    groups = {}
    for x, k in zip(v.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(k, set()).add(got.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("cell_rows", [20_000, 9])
def test_similar_groups(spark, docs, rows, empty, cell_rows):
    """Families of edited copies, a chain of edits, and clean texts, against the similarities of all pairs."""
    rng = random.Random(23)
    vocabulary = [f"word{k}" for k in range(3000)]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 300))) for _ in range(40)]
    for base in made[:8]:
        for _ in range(12):  # one edit in about 80 words
            w = base.split()
            for _ in range(max(1, len(w) // 80)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            made.append(" ".join(w).title() if rng.random() < 0.3 else " ".join(w))
    made += [made[0], "\n".join(made[0].split()), None, "", " ", "two words", "Two  words", "two", " ".join(made[20].split() + made[21].split())]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    got = {r.row_id: r.component_id for r in simhash_popcount.similar_groups(frame, cell_rows=cell_rows).collect()}
    sets = []
    for t in made:
        w = words((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    alike = [[len(a & b) / len(a | b) for b in sets] for a in sets]
    for i, line in enumerate(alike):
        for j, x in enumerate(line):
            assert got[i] == got[j] or x < 0.8
        assert got[i] == i or max(line[j] for j in range(len(sets)) if j != i and got[j] == got[i]) > 0.5
    kept = simhash_popcount.keep_similar(frame).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))
    assert simhash_popcount.keep_similar(docs).columns == docs.columns
    again = simhash_popcount.similar_groups(docs)
    assert Counter(r.row_id for r in again.collect()) == Counter(i for i, _ in rows)
    assert simhash_popcount.similar_groups(empty).count() == 0


def test_queries_have_the_stated_columns(spark):
    first = {
        "op1": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op3": "doc_id size text_crc32 law shard slot grown_shard",
        "op5": "doc_id piece start length ids_crc32 sequence_id offset",
        "op7": "doc_id held_out score predicted",
        "op8": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op9": "doc_id n_bytes n_tokens over_limit",
        "op10": "doc_id fingerprint component_id",
        "op11": "vec_id component n deviation whitened explained identity_error",
        "op12": "doc_id n_features weight score rank",
        "op13": "doc_id keep_id group_size kept text_sha256",
    }
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for name, query in q.queries().items():
        got = query(spark, "/root/testdata/sf0.001")
        want = first.get(name.split("_")[0], "doc_id").split()
        assert got.columns[: len(want)] == want
        if name.split("_")[0] not in ("op5", "op6", "op11"):
            assert got.count() == rows


def test_similar_groups_are_exact_components(spark):
    """Families of which pairs lie around 0.8: links are those of exact similarity, and chains of them."""
    rng = random.Random(29)
    vocabulary = [f"word{k}" for k in range(3000)]
    made = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 250))]
        made.append(" ".join(base))
        for _ in range(14):
            w = base.copy()
            for _ in range(max(1, round(len(w) * rng.choice([0.01, 0.015, 0.02, 0.03, 0.04])))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            made.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in made]
    want = list(range(len(made)))
    near = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x = len(a & b) / len(a | b)
            near += 0.7 < x < 0.8
            if x >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if v == high else v for v in want]
    frame = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(5)
    for cell_rows in (20_000, 9):
        got = {r.row_id: r.component_id for r in simhash_popcount.similar_groups(frame, cell_rows=cell_rows).collect()}
        assert near > 100 and [got[i] for i in range(len(made))] == want


def test_short_lines_recur_by_share_of_documents(spark):
    """A notice of three words goes from all documents but the first; sentences as short that few documents share stay, also behind digits."""
    rng = random.Random(11)
    rows = []
    for k in range(6000):
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(4)), f"Page {k}"]
        lines += ["All rights reserved."] * (k % 100 == 7) + ["And so."] * (k % 300 == 9) + ["", "Yes."] * (k % 250 == 3)
        rows.append((k, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r._dropped) for r in template_lines.rewrite(frame).collect()}
    gone = {k for k in range(6000) if k % 100 == 7 and k != 7}
    assert got == {k: (t.replace("\nAll rights reserved.", "") if k in gone else t, int(k in gone)) for k, t in rows}


@pytest.mark.parametrize("size", [4096, 1000])
def test_bands_judge_all_of_a_text(spark, size):
    """Noise is found wherever it stands, also behind the last whole chunk and in texts shorter than one."""
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) for _ in range(100))
    prose = " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "on", "th", "ing"]) for _ in range(3)) for _ in range(1500))
    made = [prose[:size] + noise[: size - 6], noise[: size - 6] + prose[:size], prose[: 2 * size - 6]]
    got = {r.doc_id: r for r in compression_bands.verdicts(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    assert [got[k].band for k in range(3)] == ["chunks", "chunks", "ok"]
    assert {got[k].n_chunks for k in range(3)} == {-(-(2 * size - 6) // (4096 if size == 4096 else 512))}
