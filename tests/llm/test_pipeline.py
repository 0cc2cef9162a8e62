"""The pipeline, stage by stage, against plain Python."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lodestone.llm import language_id, mixing, token_output
from test_operators import brute_components


@pytest.fixture(scope="module")
def steps(spark, small, tmp_path_factory):
    """(rows in, rows out) of each stage, written and read between them."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(steps):
    assert [n for n, _, _ in steps] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing", "token output"]
    assert all(tuple(after.columns) == pipeline.COLUMNS for _, _, after in steps[:-1])
    assert all(after.count() > 0 for _, _, after in steps)


def test_language_stage_drops_what_is_rejected(steps):
    _, before, after = steps[0]
    gone = {r.doc_id for r in language_id.identify(before).where("rejected").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone
    assert len(gone) <= 0.02 * before.count()


def test_near_dedup_keeps_one_of_each_group(steps):
    _, before, after = steps[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {low for _, _, low in brute_components(rows, pipeline.NEAR)}
    got = [r.doc_id for r in after.collect()]
    assert sorted(got) == sorted(want)


def test_decontamination_drops_documents_with_a_window(spark, small, steps):
    import re

    _, before, after = steps[2]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    grams = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))}
    clean = {r.doc_id for r in before.collect() if not any(tuple(w[i : i + n]) in grams for w in [words(r.text)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in after.collect()} == clean


def test_mixing_repeats_documents(steps):
    _, before, after = steps[3]
    taken = {r.doc_id: round(r.taken / r["size"] + 1e-12) if r["size"] else 0 for r in mixing.mix(before).collect()}
    count = {}
    for r in after.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {k: v for k, v in taken.items() if v > 0}
    assert max(count.values()) <= 2


def test_token_files_hold_the_mix(steps):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_output.default_path())
    _, before, after = steps[4]
    at, want = 0, []
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        ids = [*lib.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in after.collect()) == want


def test_run_equals_the_stages(spark, small, steps):
    assert sorted(map(tuple, pipeline.run(spark, small).collect())) == sorted(map(tuple, steps[-1][2].collect()))


def test_stages_of_odd_and_no_rows(spark, small):
    rows = [(1, None, None, None, None), (None, "a b", "en", None, 3), (None, "a b", "en", None, 3), (2, "", "en", "s", 0), (3, "some words and some more words", "en", "s", 5), (3, "some words and some more words", "en", "s", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, source string, n_chars long, size string")
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, small)
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        docs.collect()
