"""The corpus pipeline, stage by stage, on the smallest table."""

import random

import corpus_pipeline
from oddsweave.llm import bin_completion, compression_bands, simhash_popcount, string_tiling
from oddsweave.llm._shared import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents")
    bench = table(spark, SF, "benchmark")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        before = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = before
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(kept["quality_rules"]) == ids(compression_bands.verdicts(docs).filter("kept"))
    lined = kept["line_dedup"]
    assert ids(lined) <= ids(kept["quality_rules"])
    assert ids(kept["near_dedup"]) == {r.component_id for r in simhash_popcount.similar_groups(lined).collect()}
    assert ids(kept["decontamination"]) == ids(kept["near_dedup"]) - {r.row_id for r in string_tiling.pairs(kept["near_dedup"], bench).collect()}
    packed = bin_completion.pack(kept["decontamination"])
    assert {r.row_id for r in packed.collect()} == ids(kept["decontamination"])


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, ties, repeated rows, an empty benchmark, clashing columns, and no rows at all."""
    words = max((r.text for r in compression_bands.keep(table(spark, SF, "documents")).limit(20).collect()), key=len)
    rows = [(1, words, "x", None), (2, words, None, 1.5), (2, words, None, 1.5), (None, words + " and a little more of it", "y", None), (3, None, None, None), (4, "", "z", 0.0), (5, "short", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, kept double")
    folder = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        before = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, before, folder)
            assert after.columns == docs.columns
            before = spark.createDataFrame(after.collect(), docs.schema)
            if name == "quality_rules":
                assert before.filter("text IS NULL OR text IN ('', 'short')").count() == 0
        packed = corpus_pipeline.STAGES[-1][1](spark, before, folder).collect()
        assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
        assert len(packed) >= before.count() and (start is docs) == bool(packed)
    # Of equal and near texts one row stays, whichever keys tie; a null and an empty text are copies.
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, folder).collect()
    assert sum(r.text is not None and len(r.text) > 100 for r in near) == 1 and len(near) == 3


def test_near_dedup_links_what_the_grid_links(spark):
    """Texts whose frequent shingles agree have near fingerprints and unlike sets; edited copies the other way round: both are copies, also in chains."""
    rng = random.Random(31)
    word = lambda: f"w{rng.randrange(10**6)}"
    made = []
    for repeats in (3, 5, 40):
        often = [word() for _ in range(31)] * repeats
        made += [" ".join(often + [word() for _ in range(24)]) for _ in range(8)]
    for base in [made[2].split(), [word() for _ in range(120)]]:
        edited = base.copy()
        edited[40] = word()
        made += [" ".join(base + ["end"]), " ".join(edited)]
    made += [" ".join(word() for _ in range(60)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    by_grid = simhash_popcount.groups(docs).collect()
    by_sets = simhash_popcount.similar_groups(docs).collect()
    label = list(range(len(made)))
    for r in by_grid + by_sets:
        low, high = sorted((label[r.row_id], label[r.component_id]))
        label = [low if x == high else x for x in label]
    grid, sets = (dict((r.row_id, r.component_id) for r in rows) for rows in (by_grid, by_sets))
    print_of = {r.row_id: r.fp for r in by_grid}
    # Equal fingerprints and near ones, beyond what sets link, and sets beyond what fingerprints link.
    apart = {print_of[i] == print_of[c] for i, c in grid.items() if i != c and sets[i] != sets[c]}
    assert apart == {True, False} and any(c != i and grid[i] != grid[c] for i, c in sets.items())
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(label))
