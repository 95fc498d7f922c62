"""Whitening, piece encoding and hard negatives: SQL, brute force and the library itself."""

import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from cargolens.llm import hard_negatives, piece_codec, whitening

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = piece_codec.codec(open(PATH, "rb").read())
VECTORS = "vec_id long, embedding array<float>, label int, x string, block int"


# piece encoding


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcdeth in▁\n\t.é日本\x00𝒳€ ")), max_size=60) | st.text(max_size=40))
def test_encoding_equals_the_library(text):
    ids = LIBRARY.encode(text, add_eos=True)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=12))
def test_decoding_any_ids_equals_the_library(ids):
    assert CODEC.decode(ids) == LIBRARY.decode(ids)


def test_runs_and_very_long_texts():
    for text in [c * k for c in " \na▁é" for k in range(40)] + ["intheon" * 20000, "xq" * 30000, " word" * 40000]:
        assert CODEC.encode(text) == LIBRARY.encode(text, add_eos=True)


def test_vocabulary_with_spaces_inside_pieces():
    own = piece_codec.Vocabulary(("<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "a", "b", "▁", "a▁", "▁b", "a▁b", "ab"), (*[0.0] * 259, -9.0, -9.0, -9.0, -1.0, -2.0, -3.0, -2.0), (2, 3, 3, *[6] * 256, *[1] * 7), True)
    code = piece_codec.Codec(own)
    r = random.Random(5)
    for _ in range(500):
        text = "".join(r.choice("ab c") for _ in range(r.randrange(1, 12)))
        parts, _ = piece_codec.merges(("▁" + text if text else "").replace(" ", "▁"), code.scores)
        want = [i for t in parts for i in ([code.ids[t]] if t in code.ids else [code.bytes_[b] for b in t.encode()])]
        assert code.encode(text) == [*want, 2]


def test_unfit_models_are_refused():
    with pytest.raises(ValueError):
        piece_codec.Vocabulary.read(b"\x0a\x08\x0a\x01a\x15\x00\x00\x00\x00")


def test_encode_and_decode_tables(spark):
    texts = [(1, "two words", "x"), (2, None, "x"), (3, "", None), (None, "é\n日本  x", "y"), (4, "same", "y"), (4, "same", "y"), (5, "long " * 30000, "z")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, decoded string").withColumnRenamed("decoded", "ids")
    rows = piece_codec.encode(docs, PATH)
    assert rows.columns == ["doc_id", "ids"]
    want = sorted(((i, LIBRARY.encode(t or "", add_eos=True)) for i, t, _ in texts), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows.collect()), key=str) == want
    back = sorted(((r.doc_id, r.decoded) for r in piece_codec.decode(rows, PATH).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t, _ in texts), key=str)
    both = sorted(((r.doc_id, list(r.ids), r.decoded) for r in piece_codec.both_ways(docs, PATH).collect()), key=str)
    assert both == [(i, ids, LIBRARY.decode(ids)) for i, ids in want]
    assert piece_codec.both_ways(docs.limit(0), PATH).collect() == []
    assert piece_codec.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).select("decoded").distinct().collect()[0].decoded == ""


def test_codec_query_equals_the_library(spark, sf_dir):
    got = {r.doc_id: r for r in piece_codec.digest_query(spark, sf_dir).collect()}
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in texts:
        ids = LIBRARY.encode(d.text or "", add_eos=True)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))


# whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], VECTORS)


def exact(rows, k):
    """Components of whole-number rows by a dense covariance."""
    x = np.array(rows, np.float64)
    c = x - x.mean(0)
    values, turn = np.linalg.eigh(c.T @ c / len(x))
    return values[::-1][:k], turn[:, ::-1][:, :k], c, values.sum()


def check(got, rows, k):
    values, turn, c, total = exact(rows, k)
    assert np.allclose(got.variances, values, rtol=1e-12, atol=1e-9)
    assert np.allclose(got.explained, values / total, rtol=1e-10)
    signs = np.sign((got.components * turn).sum(0))
    assert np.abs(got.components * signs - turn).max() < 1e-8


def test_whitening_query_equals_brute_force(spark, sf_dir):
    rows = whitening.digest_query(spark, sf_dir).collect()
    source = {r.vec_id: [math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    values, turn, c, total = exact(list(source.values()), 32)
    n, sums = len(source), [sum(col) for col in zip(*source.values())]
    at = {v: i for i, v in enumerate(source)}
    w = np.zeros((n, 32))
    for r in rows:
        w[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / total) < 1e-12
    want = c @ (turn / np.sqrt(values))
    assert len(rows) == 32 * n and np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-8
    for r in rows[::1000]:
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(source[r.vec_id], sums))


def test_narrow_blocks_widen_until_certified(spark):
    rng = np.random.default_rng(3)
    for d, spread in ((150, np.linspace(1, 1.2, 150)), (150, 0.8 ** np.arange(150) + 0.01)):
        x = np.floor(1000 * rng.standard_normal((700, d)) * spread).astype(int).tolist()
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(5)
        got = whitening.fit(df, 5)
        assert got.passes > 1
        check(got, x, 5)
        assert whitening.identity_error(df, got) < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(4)
    fine = [(i, [r.gauss(0, 1) for _ in range(3)], 1) for i in range(40)] + [(None, [0.5, 0.25, 1.0], None), (7, [1.0, 2.0, 3.0], 1), (7, [1.0, 2.0, 3.0], 1)]
    bad = [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [nan, 1.0, 1.0], 1), (93, [inf, 1.0, 1.0], 1), (94, [], 1), (95, [1.0], 1)]
    x = whitening.whole(vectors(spark, fine + bad), 64, 1_000_000)
    assert x.count() == len(fine)
    model = whitening.fit(x)
    assert model.n == len(fine) and model.components.shape == (3, 3)
    assert whitening.transform(x, model).count() == len(fine)
    assert whitening.fit(whitening.whole(vectors(spark, bad[:5]), 64, 0)) is None
    assert whitening.fit(whitening.whole(vectors(spark, [(1, [1.0, 2.0], 1)] * 3), 64, 0)) is None
    flat = whitening.fit(whitening.whole(vectors(spark, [(i, [float(i), 2.0 * i, 5.0], 1) for i in range(9)]), 64, 0))
    assert flat.components.shape == (3, 1)
    with pytest.raises(OverflowError):
        whitening.centred(np.array([[2**60, 1]]), 1000, np.array([2**60, 1]))


# hard negatives


def brute(rows, every, k_pos, k_neg):
    best = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        lab = math.fmod(lab + 1, 10) if i % 7 == 0 else lab
        row = (int(lab), [math.floor(256 * float(np.float32(c))) for c in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (lab, x) in best.items():
        if a % every:
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y)), j, l) for j, (l, y) in best.items() if j != a)
        for s, p, _ in [t for t in score if t[2] == lab][:k_pos]:
            fit = [(j, -n) for n, j, l in score if l != lab and 80 * -s <= 100 * -n <= 100 * -s][:k_neg]
            out += [(a, p, k + 1, j, -s, n) for k, (j, n) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("anchors", "rows_", "dims"), [(256, 4096, 32), (2, 7, 3), (3, 5, 1)])
def test_hard_negatives_equal_brute_force(spark, anchors, rows_, dims):
    r = random.Random(anchors)
    rows = [(i, [r.choice([0.5, 0.25, -0.125, 1.0, 0.3]) for _ in range(7)], 1 if r.random() < 0.4 else r.randrange(10)) for i in range(120)]
    rows += [(200, None, 1), (201, [float("nan")] * 7, 1), (202, [1.0, None] * 3 + [1.0], 2), (203, [], 2), (None, [1.0] * 7, 2), (204, [1.0] * 7, None), (205, [1.0] * 3, 4)]
    rows += rows[:20] + [(10, [0.75] * 7, 0)]
    m = hard_negatives.Mining(every=10, anchors_a_tile=anchors, rows_a_tile=rows_, dimensions=dims)
    got = sorted(tuple(x) for x in hard_negatives.mine(vectors(spark, rows), m).collect())
    assert got == brute(rows, 10, 5, 5) and len(got) > 50


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, [])).collect() == []
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1), (100, [1.0], 2)])).collect() == []


def test_products_beyond_doubles():
    a, b = np.array([[2**30, 3], [1, 2]]), np.array([[2**29, 5], [7, 1]])
    assert hard_negatives.product(a, b).tolist() == [[2**59 + 15, 7 * 2**30 + 3], [2**29 + 10, 9]]
    with pytest.raises(OverflowError):
        hard_negatives.product(np.array([[2**40]]), np.array([[2**40]]))
    tile = np.array([[5, -7], [2**40, 0]])
    assert (hard_negatives.unpacked(hard_negatives.packed(tile), (2, 2)) == tile).all()


def test_hard_negatives_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    got = sorted(tuple(r) for r in hard_negatives.digest_query(spark, sf_dir).collect())
    assert got == sorted(con.execute(hard_negatives.ORACLE_SQL).fetchall()) and got
