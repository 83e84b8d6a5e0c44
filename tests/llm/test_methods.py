"""Methods of the training-data operators by themselves: features and gradient, rules and spans, verdicts, plans, whole records, keys."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsweave.llm import backoff_lm, bin_completion, compression_bands, external_shuffle, secret_automaton, simhash_popcount, string_tiling, subword_classifier, template_lines, token_resync

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def slab(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


# --- quality classifier


def brute_features(text):
    """Words, pairs, three and four characters inside words with a blank around, repeats of three words."""
    w = WORD.findall(text)
    out = [("word", x) for x in w] + [("two", *x) for x in zip(w, w[1:])]
    for x in w:
        for n in (3, 4):
            padded = f" {x} "
            out += [(n, padded[k : k + n]) for k in range(len(padded) - n + 1)]
    seen = set()
    for x in zip(w, w[1:], w[2:]):
        out += [("again",)] * (x in seen)
        seen.add(x)
    return Counter(out)


def test_classifier_features_against_brute_force():
    rng = random.Random(4)
    texts = ["", "a", "né über 日本語 é", "one two one two one two", " \n x\ty  z "] + [" ".join(rng.choice(["añb", "cde", "日本", "x", "fghij", "été"]) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = 1 << 16
    data, at = slab(texts)
    got = [Counter() for _ in texts]
    for owner, used in subword_classifier.features(data, at, rows):
        for d, u in zip(owner.tolist(), used.tolist()):
            got[d][u] += 1
    name = {}  # equal features have equal rows, and (but for collisions, none here) only these
    for text, bag in zip(texts, got):
        want = brute_features(text)
        assert sorted(want.values()) == sorted(bag.values())
    for k, text in enumerate(texts):  # each word's row is the same wherever it stands
        for owner, used in list(subword_classifier.features(*slab([text]), rows))[:1]:
            for x, u in zip(WORD.findall(text), used.tolist()):
                assert name.setdefault(x, u) == u
    assert len(set(name.values())) == len(name)
    without = [u for kind in subword_classifier.features(data, at, rows, repeats=False) for u in kind[1].tolist()]
    assert max(without) < rows * (subword_classifier.KINDS - 1)


def test_classifier_takes_gradient_steps():
    """One epoch of descent against the same steps written out, the gradient by differences."""
    settings = subword_classifier.Settings(rows=4, dim=3, epochs=1, seed=5)
    rng = np.random.default_rng(1)
    bags = []
    for y in (0, 1, 1):
        used = np.sort(rng.choice(4 * subword_classifier.KINDS, 5, replace=False)).astype("<i4")
        part = rng.random(5).astype("<f4")
        bags.append((used, part / part.sum(), y))
    model = subword_classifier.descend(bags, settings)
    rng = np.random.Generator(np.random.PCG64(5))
    table = rng.uniform(-1 / 3, 1 / 3, (4 * subword_classifier.KINDS, 3)).astype(np.float32).astype(float)
    out, bias = np.zeros((2, 3)), np.array([0, np.log(2)])

    def loss(table, out, bias, bag):
        raw = out @ (bag[1].astype(float) @ table[bag[0]]) + bias
        return np.log(np.exp(raw).sum()) - raw[bag[2]]

    def slope(x, f):
        g = np.zeros_like(x)
        for k in np.ndindex(x.shape):
            old, h = x[k], 1e-6
            x[k] = old + h
            high = f()
            x[k] = old - h
            g[k] = (high - f()) / (2 * h)
            x[k] = old
        return g

    for step, k in enumerate(rng.permutation(3)):
        rate, bag = settings.rate * (1 - step / 3), bags[k]
        f = lambda: loss(table, out, bias, bag)  # noqa: B023, E731
        d_out, d_bias, d_table = slope(out, f), slope(bias, f), slope(table, f)
        d_table[bag[0]] *= settings.boost * (rate * 5) ** 0.5
        out, bias, table = out - rate * d_out, bias - 0.1 * rate * d_bias, table - rate * d_table
    assert np.allclose(model.weight, table @ (out[1] - out[0]), atol=1e-4) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_classifier_sample_is_bounded(spark):
    """Repeated rows of a labelled key count against the sample; bytes bound it, too."""
    docs = spark.createDataFrame([(k % 3, f"word{k} other") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(3)], "doc_id long, quality int")
    always = lambda key: key.isNotNull()
    few = subword_classifier.train(docs, labels, always, subword_classifier.Settings(rows=64, sample=2))
    assert np.isfinite(few.weight).all()
    none = subword_classifier.train(docs, labels, always, subword_classifier.Settings(rows=64, sample_bytes=1))
    assert none.bias == 0


def test_classifier_held_out_accuracy(spark):
    from oddsweave.llm import queries

    scored = queries.op7_subword_classifier(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("quality IN (0, 1)")
    n, right = scored.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 50 and right / n > 0.95


# --- secret scans

PARTS = ["eyJ", ".", "AKIA", "a1b2", "://", "x", "@", ":", "https", "password", "=", '"', " ", "npm_", "AIza", "-----BEGIN ", "PRIVATE KEY-----", "RSA ", "ghp_", "0123456789abcdef", "_", "-", "é", "KLMNOPQRSTUVWXYZ"]


def test_secret_rules_against_regex(spark):
    """All spans of all rules, those the method adds included."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    texts += ["-----BEGIN RSA PRIVATE KEY-----", "eyJabcdefghijklmno.eyJabcdefghijklmnop.abcdefgh", "AIza" + "x" * 35, "npm_" + "y" * 30, "https://me:secretpass@host", "ghp_" + "z" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fired = Counter()
    for r in secret_automaton.scan(docs).collect():
        want = []
        for n, rule in enumerate(secret_automaton.RULES):
            for m in re.finditer(rule.pattern, texts[r.row_id]):
                if (secret_automaton._value_size(m[0].encode()) if rule.value else len(m[0])) >= rule.least:
                    want.append((m.start(), n, m.end()))
                    fired[rule.kind] += 1
        assert r.spans == secret_automaton.joined(sorted(want), secret_automaton.RULES)
    assert set(fired) == {r.kind for r in secret_automaton.RULES}


def test_secret_automaton_tells_many_rules_apart(spark):
    rules = tuple(secret_automaton.Rule(f"r{k}", f"mark{k:02d}x") for k in range(40))
    docs = spark.createDataFrame([(1, "mark01x mark18x mark20x mark39x"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.row_id: r.spans for r in secret_automaton.scan(docs, rules, base=0).collect()}
    assert got == {1: "r1:0:7,r18:8:15,r20:16:23,r39:24:31", 2: "", 3: ""}
    with pytest.raises(ValueError):
        secret_automaton.compile_rules(("a",) * 65, True)


def test_secret_spans_take_linear_time():
    single = secret_automaton.automata(secret_automaton.RULES)[1]
    kinds = [r.kind for r in secret_automaton.RULES]
    for kind, part in (("jwt", b"eyJ"), ("assign", b"password"), ("login", b"a://b:"), ("pem", b"-----BEGIN ")):
        began = time.perf_counter()
        assert secret_automaton.matches(single[kinds.index(kind)], part * (1_000_000 // len(part))) == []
        assert time.perf_counter() - began < 5


def test_redaction_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "token=abcdef12 é password: hunter22", "c"), (3, "clean", "d")], "doc_id long, text string, row_id string")
    got = sorted(((r.doc_id, r.text, r.row_id) for r in secret_automaton.redact(docs).collect()), key=lambda x: x[2])
    assert got == [(1, None, "a"), (2, "", "b"), (3, "[SECRET] é [SECRET]", "c"), (3, "clean", "d")]
    assert secret_automaton.redact(docs.limit(0)).count() == 0


# --- quality rules


def test_band_verdicts_against_brute_force(spark):
    """kept, ratio, chunk counts and band of all small documents, and of crafted ones."""
    import zstandard

    rules, pack = compression_bands.Rules(), zstandard.ZstdCompressor(level=3, write_content_size=False).compress
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "ab " * 4000), (-2, "x" * 511), (-3, None), (-4, ""), (-5, "é" * 300)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    bands = set()
    for r in compression_bands.verdicts(docs).collect():
        body = texts[r.doc_id].encode()
        low = high = n = 0
        limits = [b for b in compression_bands.BANDS if len(body) >= b[0]][-1]
        if body:
            size, least, most = (4096, 0.25, 0.72) if len(body) >= 4096 else (512, 0.28, 0.75) if len(body) >= 512 else (len(body), *limits[1:])
            starts = list(range(0, len(body), size))
            starts[-1] = len(body) - size
            for k in starts:
                ratio, n = len(pack(body[k : k + size])) / size, n + 1
                low, high = low + (ratio < least), high + (ratio > most)
        ratio = len(pack(body)) / len(body) if body else 0.0
        band = "empty" if not body else "repetitive" if ratio < limits[1] else "noisy" if ratio > limits[2] else "chunks" if low + high > rules.chunk_share * n else "ok"
        assert (r.ratio, r.n_chunks, r.n_chunks_low, r.n_chunks_high, r.band) == (ratio, n, low, high, band)
        assert r.kept == (not r.base_failed and band == "ok")
        bands.add(band)
    assert {"empty", "repetitive", "ok"} <= bands


# --- packing


@pytest.mark.parametrize("seed", range(4))
def test_completions_against_all_fillings(seed):
    """Every filling that is left out is dominated by, or wastes more than, one that is given."""
    rng = np.random.default_rng(seed)
    left = np.zeros(31, np.int64)
    for s in rng.integers(2, 16, 8):
        left[s] += 1
    size = int(np.flatnonzero(left)[-1])
    room = 30 - size
    free = left.copy()
    free[size] -= 1
    pieces = [s for s in range(1, 31) for _ in range(free[s])]
    every = {tuple(sorted((pieces[k] for k in range(len(pieces)) if bits >> k & 1), reverse=True)) for bits in range(1 << len(pieces))}
    every = {f for f in every if sum(f) <= room}

    def beaten(f):
        rest = Counter(pieces) - Counter(f)
        slack = room - sum(f)
        for bits in range(1, 1 << len(f)):
            part = [f[k] for k in range(len(f)) if bits >> k & 1]
            if any(sum(part) <= x <= sum(part) + slack and [x] != part for x in rest):
                return True
        return any(x <= slack for x in rest)  # room for one more

    want = {f for f in every if not beaten(f)}
    got = [tuple(sorted(f[1:], reverse=True)) for f in bin_completion.completions(left, size)]
    assert set(got) >= want and all(f in every for f in got)
    wastes = [room - sum(f) for f in got]
    assert wastes == sorted(wastes)


def test_search_beats_best_fit_and_proves_it(spark):
    """On the lengths of sf0.01 the plan meets the lower bound; best fit alone doesn't."""
    counts = np.zeros(1025, np.int64)
    for r in bin_completion.pieces(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    total = lambda p: sum(n for _, n in p)
    fit, made = bin_completion.best_fit_decreasing(counts), bin_completion.plan(counts)
    assert total(made) == bin_completion.lower_bound(counts) < total(fit)


def test_plan_is_optimal_on_small_tables():
    """Against all partitions of up to nine pieces."""
    rng = random.Random(2)
    for _ in range(25):
        pieces = [rng.randint(2, 20) for _ in range(rng.randint(1, 9))]
        bins_of = lambda rest: 0 if not rest else min(1 + bins_of(tuple(rest[k] for k in range(1, len(rest)) if not bits >> (k - 1) & 1)) for bits in range(1 << (len(rest) - 1)) if rest[0] + sum(rest[k] for k in range(1, len(rest)) if bits >> (k - 1) & 1) <= 24)
        best = bins_of(tuple(sorted(pieces, reverse=True)))
        made = bin_completion.plan(np.bincount(pieces, minlength=25).astype(np.int64), steps=3000)
        assert sum(n for _, n in made) == best


def test_ids_of_all_documents_are_the_librarys(spark):
    """The second tokenizer gives the ids of the first on every text of sf0.1, whole tables of pages and conversations included."""
    encode = token_resync.encoder("byte_bpe_50k.json")
    sf = "/root/testdata/sf0.1"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(spark.read.parquet(f"{sf}/conversations.parquet").select("text"))
    texts = texts.union(spark.read.parquet(f"{SF}/pages.parquet").select("html"))

    def differing(batches):
        import pyarrow as pa

        for batch in batches:
            part = [t for t in batch.column(0).to_pylist() if t]
            bad = [t for t, ids in zip(part, encode_here().encode(part)) if ids.tolist() != encode_here().library.encode(t, add_special_tokens=False).ids]
            yield pa.record_batch([pa.array([len(part)]), pa.array([len(bad)])], names=["n", "bad"])

    def encode_here():
        return token_resync.encoder("byte_bpe_50k.json")

    n, bad = texts.repartition(16).mapInArrow(differing, "n long, bad long").agg(F.sum("n"), F.sum("bad")).first()
    assert encode.fast is not None and n > 10_000 and bad == 0


# --- sharding


def test_shuffle_keeps_whole_records(spark, tmp_path):
    """Clashing columns stay as they are; folders hold the shards, files their rows in slot order; no second shuffle."""
    rows = [(k, f"text {k}", k % 7, "s", 1.5, f"o{k}") for k in range(500)] + [(None, None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, Slot string, _bucket double, _order string")
    got = external_shuffle.shuffle(docs, 5, bucket_bytes=2000)
    assert got.columns == [*docs.columns, "shard_", "slot_", "bucket"]
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter(rows)
    path = str(tmp_path / "out")
    external_shuffle.write(docs, path, 5)
    back = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.shard, r.Slot, r._bucket, r._order) for r in back.collect()) == Counter(rows)
    where = {(r.doc_id, r.shard_, r.slot_) for r in external_shuffle.shuffle(docs, 5).collect() if r.doc_id is not None}
    assert where == {(r.doc_id, r.shard_, r.slot_) for r in back.collect() if r.doc_id is not None}


# --- keys


def test_keys_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for run in (
        lambda: backoff_lm.score(docs),
        lambda: compression_bands.verdicts(docs),
        lambda: template_lines.rewrite(docs),
        lambda: bin_completion.pack(docs),
        lambda: string_tiling.pairs(docs, labels.withColumnRenamed("doc_id", "item_id").withColumn("text", F.lit("x"))),
        lambda: subword_classifier.train(docs, labels, lambda key: key > 0),
        lambda: secret_automaton.scan(docs),
        lambda: token_resync.count_tokens(docs),
        lambda: simhash_popcount.groups(docs),
        lambda: simhash_popcount.keep_similar(docs),
    ):
        with pytest.raises(TypeError):
            run()
    assert external_shuffle.shuffle(docs, 2).count() == 1  # any key will do here
    small = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    assert compression_bands.verdicts(small).first().doc_id == 1


def test_equal_long_rows_are_dealt_out_by_their_bytes(spark):
    rows = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 4000).alias("text")).unionByName(spark.range(300).select("id", F.concat(F.lit("t"), "id")).toDF("doc_id", "text"))
    got = external_shuffle.shuffle(rows, 3, bucket_bytes=100_000).groupBy("bucket").agg(F.sum(F.length("text")).alias("n")).collect()
    assert sum(r.n for r in got) == 1_200_000 + 300 + 10 + 180 + 600 and max(r.n for r in got) < 300_000
