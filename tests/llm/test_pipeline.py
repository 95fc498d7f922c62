"""Each stage of the pipeline by brute force, on rows with null and shared ids."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from cargolens.llm import quality_crf

R = random.Random(3)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ("st", "rn", "ll", "ck", "mp")]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


A, B, C, D, E, P, ITEM = prose(70), prose(70), prose(70), prose(70), prose(70), prose(60), prose(12)
ROWS = [(None, A), (None, B), (None, B), (None, C), (None, None), (None, "x " * 40 + "!!! $$$"), (7, D), (7, E), (7, E), (7, None), (8, A + " tail"), (9, D + " end")]
ROWS += [(None, f"{prose(30)} {P} {prose(30)}"), (7, f"{prose(30)} {P} {prose(30)}"), (None, f"{prose(30)} {ITEM} {prose(9)}"), (7, f"{prose(30)} {ITEM} {prose(9)}"), (10, prose(50)), (-(2**63), prose(50))]


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in"))
    spark.createDataFrame([(k, t, "en", f"s{n % 3}", len(t or "")) for n, (k, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(10, 1), (8, 1), (7, 0), (9, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_keys_without_room_beyond_the_ids(spark):
    rows = [(2**63 - 1, "a"), (2**63 - 1, "b"), (None, "a"), (None, "a"), (-(2**63), "a"), (5, None)]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.text): r.pid for r in corpus_pipeline.told_apart(docs).collect()}
    assert len(set(got.values())) == len(got) == 5
    assert got[-(2**63), "a"] < got[5, None] < min(got[2**63 - 1, x] for x in "ab") and got[None, "a"] == max(got.values())


def after(stage, spark, where):
    out = stage(spark, spark.read.parquet(f"{where}/documents.parquet"), where)
    assert out.columns == corpus_pipeline.COLUMNS
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_quality_judges_each_row(spark, where):
    docs = spark.read.parquet(f"{where}/documents.parquet")
    model = quality_crf.train(docs, spark.read.parquet(f"{where}/labels.parquet"))
    one = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    good = {r.pid for r in quality_crf.scored(one, model).collect() if r.score >= quality_crf.THRESHOLD}
    assert {ROWS[k][0] for k in good} & {ROWS[k][0] for k in range(len(ROWS)) if k not in good}
    assert after(corpus_pipeline.quality, spark, where) == Counter(ROWS[k] for k in good)


def test_near_copies_keep_every_distinct_text(spark, where):
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    got = after(corpus_pipeline.near_copies, spark, where)
    assert set(got.values()) == {1} and set(got) <= set(ROWS)
    alike = lambda x, y: x == y or sh(x[1]) and 4 * len(sh(x[1]) & sh(y[1])) >= 3 * len(sh(x[1]) | sh(y[1]))
    for row in set(ROWS):
        assert sum(bool(alike(row, kept)) for kept in got) == 1, row
    assert (8, A + " tail") in got and (None, A) not in got


def test_passages_are_cut_from_each_row_alone(spark, where):
    texts = set(ROWS)
    want = Counter()
    for k, t in ROWS:
        raw = t or ""
        gone = set()
        for s in range(len(raw) - 199):
            if any(raw[s : s + 200] in (u or "") for j, u in texts if (j, u) != (k, t)):
                gone.update(range(s, s + 200))
        want[k, "".join(c for n, c in enumerate(raw) if n not in gone) if gone else t] += 1
    assert after(corpus_pipeline.passages, spark, where) == want


def test_leaks_remove_only_rows_with_a_hit(spark, where):
    assert after(corpus_pipeline.benchmark_leaks, spark, where) == Counter(r for r in ROWS if ITEM not in (r[1] or ""))
