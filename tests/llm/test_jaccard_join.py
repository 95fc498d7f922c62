"""The Jaccard join against all pairs."""

import random

from cargolens.llm import jaccard_join

SCHEMA = "doc_id long, text string, k long, bucket int"


def brute(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(sets[a][0]), find(sets[b][0])))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 1) for i, t in rows], SCHEMA)


def collected(df):
    return {r.pid: (r.n_shingles, r.component_id) for r in df.collect()}


def test_planted_groups(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join(word() for _ in range(r.randint(1, 40)))) for k in range(60)]
    for k in range(60):  # a drifting family: neighbours link, ends don't
        base[r.randrange(120)] = word()
        rows.append((100 + k, " ".join(base)))
    rows += [(200 + k, " ".join(passage + [word() for _ in range(15 + k)])) for k in range(40)]
    rows += [(300 + k, rows[5][1].upper()) for k in range(30)]
    rows += [(400, None), (401, ""), (402, " \t "), (403, "One two"), (404, "one  two"), (405, "one two three"), (406, "a " * 500), (407, "a " * 9), (-5, rows[70][1])]
    r.shuffle(rows)
    assert collected(jaccard_join.groups(frame(spark, rows).repartition(4))) == brute(rows)


def test_loose_family_beside_a_passage(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    base, rows = [word() for _ in range(150)], []
    for k in range(150):  # about as alike as the bound: some pairs link, most don't
        w = list(base)
        for _ in range(r.randint(2, 9)):
            w[r.randrange(150)] = word()
        rows.append((k, " ".join(w[r.randint(0, 20) :])))
    rows += [(1000 + k, " ".join(base[:40] + [word() for _ in range(r.randint(5, 60))])) for k in range(80)]
    assert collected(jaccard_join.groups(frame(spark, rows).repartition(3))) == brute(rows)


def test_test_table(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.digest_query(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard_join.groups(frame(spark, [])).count() == 0
    assert [tuple(x) for x in jaccard_join.groups(frame(spark, [(3, None)])).collect()] == [(3, 0, 3)]


def test_large_family_in_parts(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    base, rows = [word() for _ in range(100)], []
    for k in range(120):
        w = list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(100)] = word()
        rows.append((k, " ".join(w[r.randint(0, 12) :])))
    for k in range(60):  # one step further from the family each
        base[r.randrange(100)] = word()
        rows.append((500 + k, " ".join(base)))
    want = brute(rows)
    for part in (200, 900, 5000):
        assert collected(jaccard_join.groups(frame(spark, rows).repartition(3), part_shingles=part)) == want


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomial_hashes(spark):
    a, b = thue_morse(2048)
    rows = [(1, " ".join([a] * 3)), (2, " ".join([b] * 3)), (3, " ".join([a, "x"] * 5)), (4, " ".join([b, "x"] * 5))]
    assert collected(jaccard_join.groups(frame(spark, rows))) == brute(rows)


def test_null_and_shared_ids_are_linked_by_their_own_texts(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "q r s t u v"), (7, "A b c d e f"), (9, "q r s t u v"), (None, "z")]
    got = sorted((tuple(x) for x in jaccard_join.groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 2, 7), (None, 2, 7), (7, 2, 7), (7, 2, 7), (9, 2, 7), (None, 1, None)], key=str)
