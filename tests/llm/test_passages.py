"""Suffix-array and FM-index dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from cargolens.llm import arrowtext as at
from cargolens.llm import fm_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, pos int, spans string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], SCHEMA)


def brute_bytes(rows, window):
    where = defaultdict(set)
    data = {i: (t or "").encode() for i, t in rows}
    for i, b in data.items():
        for s in range(len(b) - window + 1):
            where[b[s : s + window]].add((i, s))
    out = {}
    for i, b in data.items():
        cover = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if len(where[b[s : s + window]]) > 1:
                cover[s : s + window] = b"\1" * window
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[i] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, window):
    least = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in words.items():
        cover = bytearray(len(w))
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                cover[s : s + window] = b"\1" * window
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        out[i] = (len(w), sum(cover), hashlib.sha256(kept).hexdigest())
    return out


def planted(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    common, line = text(60), text(18)
    rows = [(k, text(r.randint(5, 150))) for k in range(40)]
    rows += [(100 + k, f"{text(20)} {common} {text(30)}") for k in range(10)]
    rows += [(200 + k, f"{text(k)}\n{line}\n{text(20)}\t{line}") for k in range(10)]
    rows += [(300 + k, rows[3][1]) for k in range(25)]
    near = rows[45][1].split()
    for k in range(15):
        w = list(near)
        w[r.randrange(len(w))] = word()
        rows.append((400 + k, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "   "), (503, "a" * 900), (504, "a" * 700 + "b"), (505, "x y " * 300), (506, "é" * 400), (507, "q" * 200), (-7, common)]
    return rows


def result(df, cols):
    return {r["pid"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("window,gram", [(200, 50), (40, 10), (9, 3)])
def test_suffix_dedup_matches_brute_force(spark, window, gram):
    rows = planted()
    got = result(suffix_dedup.dedup(frame(spark, rows).repartition(5), window, gram), ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == brute_bytes(rows, window)


@pytest.mark.parametrize("window,gram", [(13, 5), (4, 2)])
def test_fm_dedup_matches_brute_force(spark, window, gram):
    rows = planted()
    got = result(fm_dedup.dedup(frame(spark, rows).repartition(5), window, gram), ["n_words", "n_removed", "kept_sha256"])
    assert got == brute_words(rows, window)


def test_both_on_the_test_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest_query(spark, sf_dir).collect()}
    assert got == brute_bytes(rows, 200)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fm_dedup.digest_query(spark, sf_dir).collect()}
    assert got == brute_words(rows, 13)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "k " * 300), (1, "z" * 300), (1, "z" * 300), (2, "")]
    out = suffix_dedup.dedup(frame(spark, rows)).collect()
    assert len(out) == 4
    assert fm_dedup.dedup(frame(spark, rows)).count() == 4
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    assert fm_dedup.dedup(frame(spark, [])).count() == 0


def test_suffix_array_orders_suffixes():
    r = np.random.default_rng(3)
    for t in (r.integers(0, 3, 500), np.zeros(50), np.array([255, 255, 0, 255]), np.array([7])):
        t = t.astype(np.uint8)
        b = t.tobytes()
        assert [b[i:] for i in suffix_dedup.suffix_array(t, len(t))] == sorted(b[i:] for i in range(len(b)))


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_wanted_suffixes_and_adjacent_prefixes(letters, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COMPARED", 50)
    rng = np.random.default_rng(letters)
    for _ in range(60):
        n, depth = int(rng.integers(1, 300)), int(rng.integers(1, 20))
        t = rng.integers(0, letters, n).astype(np.uint8)
        for wanted in (rng.random(n) < 0.3, np.zeros(n, bool), np.ones(n, bool)):
            sa = suffix_dedup.suffix_array(t, depth, wanted)
            assert sorted(sa.tolist()) == np.flatnonzero(wanted).tolist()
            heads = [bytes(t[i : i + depth]) for i in sa]
            assert heads == sorted(heads)
            full = sa[n - sa >= depth]
            heads = [bytes(t[i : i + depth]) for i in full]
            assert suffix_dedup.adjacent_common(t, full, depth).tolist() == [a == b for a, b in zip(heads, heads[1:])]


def test_minimizers_cover_every_window():
    h = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    chosen = set(at.minimizers(h, 7).tolist())
    want = {j + k for j in range(394) for k in range(7) if h[j + k] == h[j : j + 7].min()}
    assert chosen == want


def brute_rows(rows, window, words):
    """What each row keeps, rows alike in id and text being one document."""
    docs = sorted(set(rows), key=str)
    cut = (lambda t: (t or "").encode().split()) if words else (lambda t: (t or "").encode())
    grams = [{tuple(u[s : s + window]) for s in range(len(u) - window + 1)} for u in map(cut, [t for _, t in docs])]
    out = []
    for i, t in rows:
        own, me = cut(t), docs.index((i, t))
        gone = set()
        for s in range(len(own) - window + 1):
            g = tuple(own[s : s + window])
            if words:
                bad = i is not None and any(j is not None and j < i and g in grams[k] for k, (j, _) in enumerate(docs))
            else:
                bad = any(g in grams[k] for k in range(len(docs)) if k != me) or sum(tuple(own[q : q + window]) == g for q in range(len(own) - window + 1)) > 1
            if bad:
                gone.update(range(s, s + window))
        kept = [x for n, x in enumerate(own) if n not in gone]
        out.append((str(i), len(own), len(gone), hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("words", [False, True])
def test_unlike_rows_of_one_id_and_without_any(spark, words):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    p, q, a, b = text(60), text(60), text(60), text(60)
    rows = [(None, f"{a} {p}"), (None, f"{b} {q}"), (1, p), (7, f"{text(20)} {p}"), (7, f"{text(60)} {text(60)}"), (7, f"{p} {p}"), (5, q), (5, text(30)), (5, q), (3, None), (9, f"{q} {q}"), (9, ""), (None, None)]
    frame_ = frame(spark, rows).repartition(4)
    if words:
        got = fm_dedup.dedup(frame_).select("doc_id", "n_words", "n_removed", "kept_sha256")
    else:
        got = suffix_dedup.dedup(frame_).select("doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert sorted((str(x[0]), *x[1:]) for x in got.collect()) == brute_rows(rows, 13 if words else 200, words)


def test_words_that_collide_under_polynomial_hashes(spark):
    s = "a"
    while len(s) < 2048:
        s += s.translate(str.maketrans("ab", "ba"))
    t = s.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([s] * 13)), (2, " ".join([t] * 13)), (3, " ".join(["q", s] * 13)), (4, " ".join(["q", t] * 13))]
    assert result(fm_dedup.dedup(frame(spark, rows)), ["n_words", "n_removed", "kept_sha256"]) == brute_words(rows, 13)
    assert result(suffix_dedup.dedup(frame(spark, rows[:2])), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute_bytes(rows[:2], 200)
