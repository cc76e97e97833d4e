"""What the operators leave on disk while they run, and large inputs dealt out in parts."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngram_join import SCHEMA, brute_force, corpus

import corpus_pipeline
from millrace.llm import collocations, ngram_join, shared


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def tables(spark, before=()):
    """Labels of the stored tables that are not among the paths ``before``, and these paths."""
    paths = {p for p in Path(shared.shared_dir(spark).removeprefix("file:")).iterdir() if p.is_dir()} - set(before)
    return [p.name.rsplit("-", 1)[0] for p in paths], paths


def test_shuffle_files_go_with_the_table_that_was_written(spark):
    before = shuffle_files(spark)
    usual = spark.conf.get(shared._CLEANUP)
    summed = spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    held = shared.staged(summed, "sums")
    assert shuffle_files(spark) <= before
    assert held.count() == 7 == summed.count()  # what was written may be computed again
    assert spark.conf.get(shared._CLEANUP) == usual


def test_discarded_tables_are_gone(spark):
    _, path = shared.stored(spark.range(3), "gone")
    assert "gone" in tables(spark)[0]
    shared.discard(spark, path)
    assert "gone" not in tables(spark)[0]


@pytest.mark.parametrize(("words", "percent", "sizes"), [(3, 90, (8, 12, 20, 60, 150)), (2, 50, (5, 12, 30))])
def test_tiles_in_parts_and_what_the_join_leaves(spark, monkeypatch, words, percent, sizes):
    before = tables(spark)[1]
    monkeypatch.setattr(ngram_join, "PART_TILES", 1)
    how = ngram_join.Similarity(words, percent)
    rows = corpus(words, sizes)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), how)
    left = tables(spark, before)[0]
    assert not {"sketches", "sets", "shared-tiles"} & set(left)
    assert left.count("tile-members") == ngram_join.PARTS
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_force(rows, how)


def test_the_pipeline_keeps_its_last_table_only(spark, small):
    before = tables(spark)[1]
    found = corpus_pipeline.run(spark, small)
    left = [label for label in tables(spark, before)[0] if label.startswith("pipeline-")]
    assert left == [f"pipeline-{corpus_pipeline.STAGES[-1][0]}"]
    assert found.count() > 150


def test_blocks_that_are_answered_equal_those_that_are_sent_names(spark, monkeypatch):
    rows = [(f"{a} {b} of the {c}. {b} {c}, {a} {a} {a}", lang) for a in ("x", "yy", "İ") for b in ("town", "river") for c in ("x", "é", "end") for lang in ("en", "de", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    blocks = shared.staged(collocations.word_blocks(docs, 20), "blocks")
    for first in (True, False):
        frequent, buckets = collocations._frequent(blocks, first, 3)
        made = []
        for limit in (collocations.FREQUENT_ROWS, 0):
            monkeypatch.setattr(collocations, "FREQUENT_ROWS", limit)
            made.append(collocations._next_blocks(blocks, frequent, first, buckets))
        monkeypatch.undo()
        plan = made[1]._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "collect_list" not in plan  # neither names nor numbers are rows of their own
        sent, answered = ({r.block: tuple(r) for r in m.collect()} for m in made)
        assert sent == answered and len(sent) > 3
        assert {kind for name, kind in made[1].dtypes if name not in ("lang", "block", "names")} == {"binary"}
        blocks = shared.staged(made[0], "blocks")


def test_numbers_are_packed_and_read_again():
    for kind in (np.int32, np.int64):
        for values in ([], [0], [-1, 5, 2**31 - 1, -(2**31)], range(-500, 500)):
            packed = collocations._zipped(np.array(values, dtype=np.int64), kind)
            assert collocations._unzipped(packed, kind).tolist() == list(values)
    ids = np.random.default_rng(1).integers(0, 1 << 20, 10_000) + (5 << 33)
    assert len(collocations._zipped(ids)) < 3 * len(ids)
