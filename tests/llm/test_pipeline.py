"""The pipeline against a chain of brute force, stage by stage, each on what the stage before kept."""

from __future__ import annotations

import collections
import random

import pytest

import corpus_pipeline
from lodestone.llm import packing, quality, source_mixing
from lodestone.llm.queries import tokenizer_path

from .test_documents import near_components, removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join(f"word{rng.randrange(900)}" for _ in range(n))
    junk = lambda n: " ".join(rng.choice("#%&@") * 3 + str(rng.randrange(99)) for _ in range(n))
    rows = [(i, junk(60) if i % 4 == 0 else prose(rng.randrange(60, 140)), "en", f"s{i % 3}", 5) for i in range(200)]
    passage = prose(60)
    rows += [(300 + i, f"{prose(30)} {passage} {prose(30)}", "en", "s1", 5) for i in range(4)]
    rows += [(400 + i, " ".join([*rows[1][1].split()[:-1], f"last{i}"]), None, None, None) for i in range(5)] + [rows[2]] * 3
    rows += [(500, None, None, None, None), (501, "", "en", "s0", 0), (None, prose(80), "en", "s2", 3), (502, prose(9000), "en", "s0", 9)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def same(a, b):
    return collections.Counter(map(tuple, a)) == collections.Counter(map(tuple, b))


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    def written(df, name):
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = written(STAGES["quality_classifier"](spark, docs, sf_dir), "good")
    scores = {(r.doc_id, r.score) for r in quality.quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.collect()} == {i for i, s in scores if s >= 0.3}
    kept = {r.doc_id for r in good.collect()}
    assert sum(i in kept for i in range(200) if i % 4) >= 145 and sum(i in kept for i in range(0, 200, 4)) <= 5

    alone = written(STAGES["minhash_near_dedup"](spark, good, sf_dir), "alone")
    rows = [tuple(r) for r in good.collect()]
    groups = [{rows[i] for i in g} for g in near_components(rows)]
    left = collections.Counter(tuple(r) for r in alone.collect())
    assert sum(left.values()) == len(groups) and all(sum(left[r] for r in g) >= 1 for g in groups)

    cut = written(STAGES["substring_dedup"](spark, alone, sf_dir), "cut")
    rows = [tuple(r) for r in alone.collect()]
    want = [(i, " ".join(w) if n != len(w) else t) for (i, t, *_), (_, n, w) in zip(rows, removed(rows), strict=True)]
    assert same([(r.doc_id, r.text) for r in cut.collect()], want)

    mixed = written(STAGES["source_mixing"](spark, cut, sf_dir), "mixed")
    n = collections.Counter(r.doc_id for r in mixed.collect())
    taken = collections.Counter()
    for r in source_mixing.mix_table(cut).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    assert n == +taken and mixed.join(cut.select("doc_id"), "doc_id", "left_anti").where("doc_id is not null").count() == 0

    packed = STAGES["best_fit_packing"](spark, mixed, sf_dir).collect()
    fill = collections.defaultdict(list)
    for r in packed:
        fill[r.sequence_id].append((r.offset, r.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in packed)
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == n and -(-total // 4096) <= len(fill) <= 1.2 * total / 4096 + 2
    whole = packing.pack(mixed, tokenizer_path()).collect()
    assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in whole) == collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_run_applies_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "x", None, None, None), (1, "x", None, None, None)]])
def test_stages_bear_empty_and_null_tables(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 0
