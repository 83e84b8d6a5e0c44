"""Whitening, resampling and exact dedup against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsweave.llm import content_sort, jacobi_whitening, queries, tuple_resampling
from oddsweave.llm._shared import text_bytes

# --- exact dedup


def brute_classes(rows, largest):
    best, size = {}, Counter()
    for key, text in rows:
        text = text or ""
        size[text] += 1
        known = [k for k in (best.get(text), key) if k is not None]
        best[text] = (max if largest else min)(known) if known else None
    return sorted((str(k), str(best[t or ""]), size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows)


def texts_with_copies():
    rng = random.Random(5)
    rows = [(k, f"text {rng.randrange(400)} {'é' * rng.randrange(3)}") for k in range(900)]
    rows += [(k, "a copy that a third of all rows share") for k in range(900, 1500)]
    rows += [(k, None) for k in range(1500, 1530)] + [(k, "") for k in range(1530, 1560)]
    rows += [(k, "x" * 3_000_000) for k in range(1560, 1564)] + [(k, "x" * 3_000_000 + "y") for k in range(1564, 1566)]
    rows += [(None, "only null keys"), (None, "only null keys"), (None, "text 1 "), (7, "twice"), (7, "twice"), (-5, "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("largest", [False, True])
def test_exact_dedup_against_brute_force(spark, largest):
    rows = texts_with_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = content_sort.classes(docs, largest=largest).collect()
    assert sorted((str(r["row_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_classes(rows, largest)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["row_id"] == r["keep_id"] for r in kept)


def test_exact_dedup_keeps_all_columns_and_takes_a_normal_form(spark):
    docs = spark.createDataFrame([(1, "A b", 1.5, "p"), (2, "a B", None, "q"), (3, None, 2.5, "r"), (4, "", None, "s"), (None, "c", 0.0, "t")], "doc_id long, text string, hash double, record string")
    got = content_sort.keep(docs, normal=F.lower)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["hash"], r["record"]) for r in got.collect()) == [(0, "c", 0.0, "t"), (1, "A b", 1.5, "p"), (3, None, 2.5, "r")]
    assert content_sort.keep(docs.limit(0)).count() == content_sort.classes(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        content_sort.classes(docs, key="record")


def test_exact_dedup_shuffles_texts_once_and_runs_no_python(spark, monkeypatch):
    plans = []
    stored = content_sort.stored

    def spy(df, name, *more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name, *more)

    monkeypatch.setattr(content_sort, "stored", spy)
    content_sort.classes(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect()
    plan = dict(plans)["runs"]
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan
    assert not re.search("Python|Pandas|Arrow", "".join(p for _, p in plans))


# --- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), Counter(" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1))


def brute_resample(docs, target, percent=5, least=20):
    def total(texts):
        out = Counter()
        for t in texts:
            for f, n in brute_features(t)[1].items():
                out[crc32(f.encode()) % 10_000] += n
        return out

    s, t = total(x for _, x in docs), total(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (all_t * 0.0 + all_s + 10_000)) / ((s[b] + 1) * (all_t + 10_000.0)))) for b in range(10_000)]
    rows = []
    for key, text in docs:
        n, features = brute_features(text)
        weight = sum(gain[crc32(f.encode()) % 10_000] * k for f, k in features.items())
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, n, sum(features.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = k + 1
    return sorted(map(str, rows))


def some_texts(n, seed=3):
    rng = random.Random(seed)
    words = ["Über", "naïve", "x2", "the", "The", "日本語", "a", "e-mail", "don't", "ÀB"] + [f"w{k}" for k in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


def test_resampling_against_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(some_texts(400))] + [(-1, None), (-2, ""), (-3, " \n..!"), (5000, "long word " * 4000), (5001, "the " * 30), (5001, "the " * 30)]
    target = some_texts(30, seed=9) + [None, ""]
    frame = spark.createDataFrame([(k, t, 1, "z") for k, t in docs], "doc_id long, text string, rank int, score string").repartition(3)
    got = tuple_resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=20)
    assert sorted(str([r[c] for c in ("row_id", "n_words", "n_features", "weight", "score", "rank")]) for r in got.collect()) == brute_resample(docs, target, percent=20)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20), (None, "c " * 25), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = tuple_resampling.resample(docs, none, percent=50)
    assert sorted(str([r[c] for c in ("row_id", "n_words", "n_features", "weight", "score", "rank")]) for r in got.collect()) == brute_resample([(1, "a b " * 20), (None, "c " * 25), (None, None)], [], percent=50)
    assert tuple_resampling.resample(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_tuples_of_cut_texts(size):
    texts = [*some_texts(30, seed=1), "", None, "one", "x" * 300 + " " * 200 + "y z", " " * 500, "a  b\n\nc" * 50]
    import pyarrow as pa

    words, found = Counter(), [Counter() for _ in texts]
    for row, data, at, context in tuple_resampling.blocks(*text_bytes(pa.array(texts)), size):
        block = tuple_resampling.Tuples(data, at, context)
        for k, r in enumerate(row.tolist()):
            words[r] += int(block.words[k])
        for owner, inverse, hashes in block.orders:
            for o, i in zip(owner.tolist(), inverse.tolist()):
                found[row[o]][int(hashes[i])] += 1
    for k, text in enumerate(texts):
        n, features = brute_features(text)
        assert words[k] == n
        assert found[k] == sum((Counter({crc32(f.encode()): c}) for f, c in features.items()), Counter())


# --- whitening


def brute_whitened(vectors, count=32):
    """By eigenvectors of the covariance, in numpy."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    away = (n * x - x.sum(0)) / n
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return away @ vectors[:, :count] / np.sqrt(values[:count]), values[:count] / values.sum(), [sum(int(n * a - s) ** 2 for a, s in zip(r, x.sum(0).tolist())) for r in x.tolist()]


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(500, 9)) @ rng.normal(size=(9, 9)) * np.geomspace(1, 50, 9)).astype(np.float32).tolist()
    vectors[100:200] = [vectors[3]] * 100
    broken = [None, [], [1.0] * 8 + [None], [float("nan")] + [1.0] * 8, [float("inf")] * 9, [1e300] * 9, [1.0, 2.0]]
    rows = [(k, v, 1) for k, v in enumerate(vectors)] + [(1000 + k, v, 2) for k, v in enumerate(broken)] + [(None, vectors[0], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int").repartition(7)
    sound = jacobi_whitening.clean(table)
    model = jacobi_whitening.fit(sound)
    got = {r["row_id"]: r for r in jacobi_whitening.whiten(sound, model, 6).collect()}
    whitened, explained, deviation = brute_whitened([*vectors, vectors[0]], 6)
    assert set(got) == {*range(500), None} and model.n == 501
    for k in range(500):
        assert int(got[k]["deviation"]) == deviation[k]
    mine = np.array([got[k]["whitened"] for k in range(500)])
    turn = np.sign((mine * whitened[:500]).sum(0))
    assert np.allclose(mine * turn, whitened[:500], atol=1e-9)
    assert np.allclose(model.explained[:6], explained, rtol=1e-10)
    assert jacobi_whitening.identity_error(sound, model, 6) < 1e-12


def test_jacobi_is_accurate_for_small_deviations():
    rng = np.random.default_rng(1)
    left, right = np.linalg.qr(rng.normal(size=(40, 7)))[0], np.linalg.qr(rng.normal(size=(7, 7)))[0]
    for d in (1, 2, 7):
        lengths, turned = jacobi_whitening.one_sided_jacobi(np.linalg.qr(left[:, :d] * np.geomspace(1, 1e-10, d), mode="r"))
        assert np.allclose(lengths, np.geomspace(1, 1e-10, d), rtol=1e-12)
        assert np.allclose(turned @ turned.T, np.eye(d), atol=1e-14)
    lengths, turned = jacobi_whitening.one_sided_jacobi(right @ np.diag([5, 5, 5, 1, 1, 0, 0.0]))
    assert np.allclose(lengths, [5, 5, 5, 1, 1, 0, 0]) and np.allclose(turned @ turned.T, np.eye(7))


def test_whitening_of_little(spark):
    shape = "vec_id long, embedding array<double>"
    none = jacobi_whitening.clean(spark.createDataFrame([], shape))
    assert jacobi_whitening.fit(none) is None and jacobi_whitening.whiten(none, None).count() == 0
    one = jacobi_whitening.clean(spark.createDataFrame([(1, [1.0, 2.0])] * 2, shape))
    model = jacobi_whitening.fit(one)
    assert len(model.deviations) == 0 and jacobi_whitening.identity_error(one, model) == 0
    assert [(int(r["deviation"]), r["whitened"]) for r in jacobi_whitening.whiten(one, model).collect()] == [(0, [])] * 2
    flat = jacobi_whitening.clean(spark.createDataFrame([(k, [7.0, float(k), 2.0 * k]) for k in range(10)], shape))
    assert len(jacobi_whitening.fit(flat).deviations) == 1  # a constant and a multiple vary no further
    far = jacobi_whitening.clean(spark.createDataFrame([(k, [k * 1e13, 1.0 * k]) for k in range(10)], shape))
    sums = [sum(int(64 * k * 1e13) + 1_000_000 for k in range(10)), sum(64 * k + 1_000_000 for k in range(10))]
    want = {k: (10 * (int(64 * k * 1e13) + 1_000_000) - sums[0]) ** 2 + (10 * (64 * k + 1_000_000) - sums[1]) ** 2 for k in range(10)}
    assert {r["row_id"]: int(r["deviation"]) for r in jacobi_whitening.whiten(far, jacobi_whitening.fit(far)).collect()} == want


def test_query_of_whitening(spark):
    got = queries.op11_jacobi_whitening(spark, "/root/testdata/sf0.001").toPandas()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").toPandas()
    whitened, explained, deviation = brute_whitened([list(v) for v in vectors["embedding"]])
    mine = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(mine * np.sign((mine * whitened).sum(0)), whitened, atol=1e-8)
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation and (got["n"] == len(vectors)).all()
    assert np.allclose(got.groupby("component")["explained"].first(), explained) and got["identity_error"].max() < 1e-10
