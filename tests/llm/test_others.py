"""The other operators: oracles, exact round trips, brute force, held-out accuracy."""

import gzip
import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import pytest

from cargolens.llm import decontaminate, license_scan, media, mixing, quality_crf, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pid long, _phases int, slot string"


def frame(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, None, source, None, 1, 2, "x") for i, t in rows], DOCS)


EDGES = [(1, "plain text"), (2, None), (3, ""), (4, " \n\t "), (None, "no id"), (5, "same"), (5, "same"), (6, "long " * 30000), (7, "é  x")]


def duck(sf_dir, sql, **tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return sorted(con.execute(f"SELECT COLUMNS(*) FROM ({sql})").fetchall(), key=str)


def test_decontamination_equals_sql(spark, sf_dir):
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.digest_query(spark, sf_dir).collect()]
    assert sorted(got, key=str) == duck(sf_dir, decontaminate.ORACLE_SQL)
    assert any(r[5] for r in got)


def test_decontamination_brute_force(spark):
    import re

    r = random.Random(2)
    word = lambda: r.choice(["a", "b", "C", "É", "x9"])
    docs = [(k, " ".join(word() for _ in range(r.randint(0, 60)))) for k in range(60)] + [(900, None), (901, "--")]
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 10, 11, 14])] + [(50, docs[3][1] or "a"), (51, None), (52, "??")]
    got = {x.pid: (x.n_words, x.n_hit, x.items) for x in decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for k, x in items:
            v = split(x)
            size = min(10, len(v))
            for a in range(len(v) - size + 1 if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[a : a + size]:
                        hit |= set(range(p, p + size))
                        found.add(str(k))
        assert got[i] == (len(w), len(hit), sorted(found))


def test_archives_equal_sql(spark, sf_dir):
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest_query(spark, sf_dir).collect()]
    assert sorted(got, key=str) == duck(sf_dir, warc.ORACLE_SQL)


def test_archive_edges(spark, tmp_path):
    long = "z" * 1500
    rows = [(1, "http://a b", long), (2, None, long), (3, "u", None), (None, "u", long), (4, "u", ""), (4, "u", ""), (9, "\n", long)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.digest_query(spark, str(tmp_path)).collect()}
    assert got == {(1, "revisit", 9), (2, "revisit", 9), (None, "revisit", 9), (9, "response", None), (3, "response", None), (4, "response", None)}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [{"url": f"http://x/{k}", "date": "20010203040506", "body": b"HTTP/1.0 200 OK\r\n\r\n" + bytes([10, 13, k]) * k} for k in range(20)]
    back = list(warc.arc_records(warc.arc_file(records, version)))
    assert [(b["URL"], b["body"]) for b in back] == [(r["url"], r["body"]) for r in records]
    fields, block = next(warc.warc_records(warc.warc_record(back[3])))
    assert fields["warc-date"] == "2001-02-03T04:05:06Z" and block == records[3]["body"]
    with pytest.raises(ValueError):
        list(warc.arc_records(warc.arc_file(records, version)[:-5]))


def test_token_counts_equal_the_library(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, (_, t) in enumerate(EDGES)] + [(2 * 10**6, "a<|endoftext|> b<|endoftext|><|endof text|>"), (2 * 10**6 + 1, "it's  \x1c\x1f\x85   don't\r\n\r\n  'LL ½ ² ٣ 中文  "), (2 * 10**6 + 2, "​　﻿ x")]
    lib = Tokenizer.from_file(path)
    want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False)), len(lib.encode(t or "", add_special_tokens=False)) > 512) for i, t in rows}
    for most in (token_counts.PART_PRE_TOKENS, 20):
        got = {r.pid: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count(frame(spark, rows), path, part_pre_tokens=most).collect()}
        assert got == want


def test_media_round_trip(spark):
    rows = EDGES + [(8, "q" * 576), (9, "q" * 577)]
    got = media.document_media(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        data = (text[r.pid] or "").encode()
        full = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        stored = media.png(full)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_interleaved_sequence_keeps_order_and_captions():
    items = media.sequence('<p>One &amp; two<img src="sha256:aa" alt="A">three</p><script>no()</script><figure><img src="b"><figcaption>Bee <b>x</b></figcaption></figure>tail')
    assert [(i["pos"], i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [(0, "text", "One & two", None), (1, "media", "aa", "A"), (2, "text", "three", None), (3, "media", "b", "Bee x"), (4, "text", "tail", None)]
    assert media.sequence(None) == []


PAGES = {
    '<figure><figcaption>One</figcaption><img src="a" alt="x"></figure><figure><img src="b"><figcaption>Two</figcaption></figure>': [("a", "One"), ("b", "Two")],
    '<figure><img src="a"><img src="b" alt="y"><figcaption>Both</figcaption></figure><img src="c" alt="z">': [("a", "Both"), ("b", "Both"), ("c", "z")],
    '<img src="a" alt="x"><figure><figcaption>No medium</figcaption></figure><p>after</p>': [("a", "x"), "No medium", "after"],
    '<img src="a"><figcaption>Stray</figcaption>': [("a", None), "Stray"],
    '<picture><source srcset="a 1x, b,c 2x"><source srcset="a"><img src="d" alt="Pic"></picture>end': [("a", "Pic"), ("b,c", "Pic"), ("d", "Pic"), "end"],
    '<video><source src="sha256:v"><source src="w"></video><audio src="s"></audio><source src="none">': [("v", None), ("w", None), ("s", None)],
    '<figure><img src="a"><figure><img src="b"><figcaption>In</figcaption></figure><figcaption>Out': [("a", "Out"), ("b", "In")],
    '<figure><figcaption>Cap</figcaption>text<img src="a"></figure>': ["text", ("a", "Cap")],
    "": [],
}


@pytest.mark.parametrize("page", PAGES)
def test_captions_belong_to_their_figure_and_no_reference_is_lost(page):
    got = media.sequence(page)
    assert [(i["digest"], i["caption"]) if i["kind"] == "media" else i["text"] for i in got] == PAGES[page]
    assert [i["pos"] for i in got] == list(range(len(got)))


def test_resolved_sequences_keep_texts_order_and_rows_of_one_key(spark):
    pages = [(1, '<p>a</p><img src="d1" alt="x"><p>b</p><img src="gone"><img src="d1">'), (2, None), (3, "only text"), (3, "only text"), (4, '<img src="d2">')]
    sequences = media.interleaved(spark.createDataFrame(pages, "key long, html string"))
    payloads = spark.createDataFrame([("d1", 10, "f1"), ("d2", 20, "f2"), ("d3", 30, "f3")], "digest string, media_bytes long, feature string")
    got = [(r.key, [(i.pos, i.text or i.digest, i.caption, i.media and i.media.feature) for i in r["items"]]) for r in media.resolved(sequences, payloads).collect()]
    assert sorted(got, key=str) == [(1, [(0, "a", None, None), (1, "d1", "x", "f1"), (2, "b", None, None), (3, "gone", None, None), (4, "d1", None, "f1")]), (2, []), (3, [(0, "only text", None, None)]), (3, [(0, "only text", None, None)]), (4, [(0, "d2", None, "f2")])]
    assert media.resolved(sequences.limit(0), payloads).count() == 0


def test_mixing_keeps_rows_and_shares(spark):
    rows = [(k, f"t{k}", None, "abc"[0 if k % 10 < 6 else 1 if k % 10 < 9 else 2], 0, 1, 2, "x") for k in range(1000)] + [(5000, None, None, None, 0, 1, 2, "x")] * 2
    out = mixing.mixed(spark.createDataFrame(rows, DOCS), {"a": 2, "b": 1, "c": 1}, block=4, period=60).collect()
    assert len(out) == 1002 and sorted(r.place for r in out) == list(range(1002))
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, r.src) == r.src
    assert sorted(slots) == list(range(len(slots)))
    blocks = {s: sum(v == s for v in slots.values()) for s in "abc"}
    first_end = min(max(k for k, v in slots.items() if v == s) for s in "abc")
    parts = mixing.parts_of({"a": 2, "b": 1, "c": 1, "\0null": 1}, 60)
    one = min(max(k for k, v in slots.items() if v == s) for s in slots.values())
    for end in range(one + 1):
        for s in parts:
            assert abs(sum(slots[k] == s for k in range(end + 1)) - (end + 1) * parts[s] / 60) < 1
    assert blocks["a"] == 150 and first_end >= one
    assert mixing.mixed(spark.createDataFrame([], DOCS)).count() == 0


def test_period_meets_deadlines():
    r = random.Random(4)
    for _ in range(30):
        parts = mixing.parts_of({str(k): r.random() + 0.01 for k in range(r.randint(1, 9))}, 97)
        assert sum(parts.values()) == 97
        slots = mixing.one_period(parts)
        assert sorted(x for v in slots.values() for x in v) == list(range(97))


@pytest.mark.parametrize("weights", [{str(k): 1.0 for k in range(11)}, {"0": 2.0} | {str(k): 1.0 for k in range(1, 18)}, {"a": 0.7, "b": 0.29999, "c": 0.00001}, {"a": 1 / 3, "b": 0.123456789, "c": 2}])
def test_mix_follows_target_weights_over_many_periods(weights):
    from fractions import Fraction

    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    blocks = {s: 1 + int(60_000 * w / sum(exact.values())) for s, w in exact.items()}
    plan = mixing.phases(blocks, weights)
    at = {}
    for p in plan:
        for k in range(p["to"] - p["from"]):
            at[p["phase_start"] + k // p["parts"] * p["size"] + p["slots"][k % p["parts"]]] = p["source"]
    assert sorted(at) == list(range(sum(blocks.values())))
    end = min((p["phase_start"] for p in plan if p["phase_start"]), default=len(at))
    share, n = {s: w / sum(exact.values()) for s, w in exact.items()}, dict.fromkeys(weights, 0)
    assert end > 20_000
    for slot in range(end):
        n[at[slot]] += 1
        assert slot % 97 and slot < end - 1 or all(abs(n[s] - share[s] * (slot + 1)) < 1 for s in n)


LONG_WEIGHTS = {"a": 1.0, "b": 1.4142135623730951, "c": 0.1234567891}


def test_segments_of_long_periods_follow_weights_slot_by_slot():
    exact = {s: Fraction(str(w)) for s, w in LONG_WEIGHTS.items()}
    blocks = {s: 1 + int(30_000 * w / sum(exact.values())) for s, w in exact.items()} | {"b": 12_000}
    plan, at = mixing.outlines(blocks, LONG_WEIGHTS), {}
    assert mixing.phases(blocks, LONG_WEIGHTS, most=10_000) is None
    for p in plan:
        for start in range(0, p["length"], mixing.SEGMENT):
            first, slots = mixing.segment(p["rates"], start)
            for s, xs in slots.items():
                at |= {p["phase_start"] + x: (s, p["from"][s] + first[s] + k) for k, x in enumerate(xs) if x < p["length"]}
    assert sorted(at) == list(range(sum(blocks.values()))) and sorted(at.values()) == sorted((s, i) for s, n in blocks.items() for i in range(n))
    for p in plan:
        n = dict.fromkeys(p["rates"], 0)
        for slot in range(p["length"]):
            n[at[p["phase_start"] + slot][0]] += 1
            assert all(abs(n[s] - Fraction(*p["rates"][s]) * (slot + 1)) < 1 for s in n)
    assert len(plan) == 3 and plan[0]["length"] > 3 * mixing.SEGMENT


def test_rows_take_the_slots_that_segments_give(spark, monkeypatch):
    rows = [(k, f"t{k}", None, "abc"[k % 3], 0, 1, 2, "x") for k in range(999)] + [(5000, None, None, None, 0, 1, 2, "x")] * 2
    docs, weights = spark.createDataFrame(rows, DOCS), LONG_WEIGHTS
    short = mixing.mixed(docs, weights, block=4).collect()
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 100)
    long = mixing.mixed(docs, weights, block=4).collect()
    for out in (short, long):
        assert len(out) == 1001 and sorted(r.place for r in out) == list(range(1001))
        at = {}
        for r in out:
            assert at.setdefault(r.slot, (r.src, r.block_no)) == (r.src, r.block_no)
        assert sorted(at) == list(range(len(at)))
        by_place = [r.slot for r in sorted(out, key=lambda r: r.place)]
        assert by_place == sorted(by_place)
    assert {(r.doc_id, r.block_no) for r in short} == {(r.doc_id, r.block_no) for r in long}


def test_mix_of_many_sources_keeps_double_weight():
    weights = {"0": 2.0} | {str(k): 1.0 for k in range(1, 2600)}
    plan = mixing.phases({s: 4 if s == "0" else 2 for s in weights}, weights)
    assert {p["source"]: p["to"] - p["from"] for p in plan if p["phase_start"] == 0}["0"] >= 3
    late = mixing.phases({"a": 2, "b": 2, "c": 1}, {"a": 0, "b": 1, "c": 1})
    assert min(p["phase_start"] for p in late if p["source"] == "a") == 3


def test_quality_on_held_out_documents(spark, sf_dir):
    bigger = sf_dir.replace("sf0.001", "sf0.1")
    got = {r.doc_id: r for r in quality_crf.digest_query(spark, bigger).collect()}
    pairs = [(got[r.doc_id].predicted, r.quality, got[r.doc_id].score) for r in spark.read.parquet(f"{bigger}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(0 <= p[2] <= 1 for p in pairs)
    good, bad = [p for p in pairs if p[1]], [p for p in pairs if not p[1]]
    assert sum(p[0] for p in good) / len(good) > 0.9 and sum(1 - p[0] for p in bad) / len(bad) > 0.7


def test_quality_edges(spark):
    docs = frame(spark, EDGES)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    got = quality_crf.rejected(docs, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_crf.rejected(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_crf.rejected(docs.limit(0), labels).count() == 0


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(0)
    x, first = r.normal(size=(6, 3)), np.array([0, 4, 5, 6])
    model = quality_crf.Model(np.zeros(3), np.ones(3), r.normal(size=3), r.normal(size=(2, 2)))
    good, _ = quality_crf.marginals(model, x, first)
    for s, e in zip(first[:-1], first[1:]):
        total, hit = 0.0, np.zeros(e - s)
        for y in itertools.product((0, 1), repeat=e - s):
            v = sum((x[s + k] @ model.node) * (y[k] - 0.5) for k in range(e - s)) + sum(model.edge[y[k], y[k + 1]] for k in range(e - s - 1))
            total += np.exp(v)
            hit += np.exp(v) * np.array(y)
        assert np.allclose(good[s:e], hit / total)


def test_license_scan_equals_every_line(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(10**6, "x\nReleased under the MIT License"), (10**6 + 1, "LICENSED under CC BY-NC 4.0.\n\nno licence"), (10**6 + 2, None), (10**6 + 3, "a\nlicense")]
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    want = set()
    for i, t in rows:
        for k, line in enumerate((t or "").encode().split(b"\n")):
            found = scanner(line)
            if found["confirmed"]:
                want.add((i, k, found["template"], found["saved_bytes"], found["lacking"], found["added"]))
    got = {(r.pid, r.line_no, r.template, r.saved_bytes, r.lacking, r.added) for r in license_scan.scan(frame(spark, rows)).filter("confirmed").collect()}
    assert got == want and len(want) >= 5


def licence_rows(spark, texts, templates=None):
    return {(r.pid, r.line_no, r.template, r.lacking, r.added, r.block.count("\n")) for r in license_scan.scan(frame(spark, list(enumerate(texts))), templates).filter("confirmed").collect()}


def test_license_blocks_join_lines_and_follow_templates(spark):
    import textwrap

    full, filler = license_scan.TEMPLATES, "some plain words that are prose " * 9
    wrap = lambda t, lead="": "\n".join(lead + x for x in textwrap.wrap(" ".join(t.split()), 70))
    mit, apache = wrap(full["MIT#text"], "# "), wrap(full["Apache-2.0-notice#text"])
    texts = [
        f"{filler}\n{mit}\n{filler}",
        full["BSD-2-Clause#text"],
        f'{filler} Licensed under the Apache License, Version 2.0 (the "License"); {filler}',
        "This work is licensed\nunder the GNU General Public\nLicense, version 3.",
        apache,
        full["GPL-3.0-only#text"],
    ]
    n = mit.count("\n")
    got = licence_rows(spark, texts)
    assert (0, 1, "MIT#text", 0, 0, n) in got and len([g for g in got if g[0] == 0]) == 1
    assert {g[2:5] for g in got if g[0] == 1} == {("BSD-2-Clause#text", 0, 0)}
    assert {g[1:] for g in got if g[0] == 2} == {(0, "Apache-2.0", 0, 0, 0)}
    assert {g[1:] for g in got if g[0] == 3} == {(0, "GPL-3.0-only", 0, 0, 2)}
    assert (4, 0, "Apache-2.0-notice#text", 0, 0, apache.count("\n")) in got
    assert any(g[0] == 5 and g[2:5] == ("GPL-3.0-only#text", 0, 0) for g in got)
    own = {"own": "Anyone may paint this fence on any Tuesday of the year."}
    assert licence_rows(spark, ["a\nAnyone may paint this\nfence on any Tuesday of the year", "Anyone may paint this fence on any Tuesday of the year"], own) == {(0, 1, "own", 0, 0, 1), (1, 0, "own", 0, 0, 0)}


def test_near_alike_templates_are_all_compared():
    r = random.Random(12)
    base = "use of this code in any form is granted to all who keep this note and the name of its author".split()
    templates = {f"t{i}": " ".join(w if r.random() > 0.25 else r.choice(base) for w in base) for i in range(8)}
    scanner = license_scan.Scanner(templates)
    best_of = lambda block: min(int(license_scan.costs(scanner.coded[k], scanner.code(license_scan.WORD.findall(block))).min()) // license_scan.ADD for k in templates)
    for _ in range(200):
        block = " ".join(w if r.random() > 0.15 else r.choice(base) for w in templates[r.choice(list(templates))].split())
        found = scanner(block.encode())
        assert found["lacking"] + found["added"] == best_of(block)
    for name, text in license_scan.TEMPLATES.items():  # whole texts, the shorter ones parts of longer ones
        if name.endswith("#text"):
            found = license_scan.Scanner(license_scan.TEMPLATES)(text.encode(), whole=True)
            assert (found["template"], found["lacking"], found["added"], found["confirmed"]) == (name, 0, 0, True)


def test_license_costs_equal_brute_force():
    import functools

    import numpy as np

    def plain(t, w):
        @functools.cache
        def d(i, j):
            if i == 0 or j == 0:
                return i + j, i
            a, b = d(i - 1, j), d(i, j - 1)
            return min((a[0] + 1, a[1] + 1), (b[0] + 1, b[1]), *([d(i - 1, j - 1)] if t[i - 1] == w[j - 1] else []))

        return d(len(t), len(w))

    r = random.Random(5)
    for _ in range(60):
        t, w = ([r.randint(0, 3) for _ in range(r.randint(1, 8))] for _ in range(2))
        want = min(plain(t, w[a:b]) for a in range(len(w) + 1) for b in range(a, len(w) + 1))
        assert divmod(int(license_scan.costs(np.array(t), np.array(w)).min()), license_scan.ADD) == want


def test_arc_files_of_a_table(spark):
    records = [{"url": f"http://x/{k} y", "date": "20010203040506", "body": b"HTTP/1.0 200 OK\r\n\r\n" + b"p" * k} for k in range(5)]
    one = warc.arc_file(records, 1, "one.arc").replace(b"/3%20y", b"/3 y z")
    files = [("a", one), ("b", gzip.compress(warc.arc_file(records, 2))), ("c", one[:-5]), ("d", b"nonsense"), ("e", None), ("f", b"")]
    got = warc.converted(spark.createDataFrame(files, "path string, content binary")).orderBy("path", "record_no").collect()
    kinds = lambda p: [r.record_type for r in got if r.path == p]
    assert kinds("a") == kinds("b") == ["warcinfo"] + ["response"] * 5
    assert kinds("c") == ["warcinfo"] + ["response"] * 4 + [None] and "shorter" in got[-2].error
    assert kinds("d") == [None] and not kinds("e") and not kinds("f")
    assert [r.url for r in got if r.path == "a"][4] == "http://x/3 y z"
    fields, block = next(warc.warc_records(gzip.decompress(got[3].warc)))
    assert fields["warc-date"] == "2001-02-03T04:05:06Z" and block == records[2]["body"]


def test_pages_with_null_and_shared_ids(spark):
    p, q = "p" * 1200, "q" * 1200
    pages = [(1, "u", p), (2, "u", p), (2, "v", q), (None, "u", p), (None, None, None), (3, "w", ""), (4, "w", "p" * 10), (5, "w", "p" * 10), (1, "u", p), (7, "u", q)]
    frame_ = spark.createDataFrame([(i, u, h, 0, "x") for i, u, h in pages], "page_id long, url string, html string, top int, digest string")
    back = warc.archives(frame_).select("content").mapInArrow(warc.read_back, "page string, payload_bytes long, payload_digest string, record_type string, refers string")
    got = sorted((r.page, r.payload_bytes, r.record_type, r.refers) for r in back.collect() if r.page != "null")
    assert got == [("1", 1200, "revisit", "2"), ("1", 1200, "revisit", "2"), ("2", 1200, "response", None), ("2", 1200, "revisit", "7"), ("3", 0, "response", None), ("4", 10, "response", None), ("5", 10, "response", None), ("7", 1200, "response", None)]
    assert warc.archives(frame_.limit(0)).count() == 0


def test_decontamination_of_unlike_rows_of_one_id(spark):
    r = random.Random(4)
    w = [f"w{k}" for k in range(30)]
    item = " ".join(w[:20])
    docs = [(None, " ".join(w[:5] + ["x"] * 5)), (None, " ".join(["y"] * 5 + w[5:10])), (3, " ".join(w[:10])), (3, " ".join(w[:9])), (4, None), (4, " ".join(w[:10])), (4, " ".join(w[:10])), (5, " ".join(r.sample(w, 30)))]
    got = [(x.doc_id, x.n_words, x.n_hit, x.n_items) for x in decontaminate.contamination(frame(spark, docs), spark.createDataFrame([(1, item, 0)], "item_id long, text string, pid int")).collect()]
    assert sorted(got, key=str) == sorted([(None, 10, 0, 0), (None, 10, 0, 0), (3, 10, 10, 1), (3, 9, 0, 0), (4, 0, 0, 0), (4, 10, 10, 1), (4, 10, 10, 1), (5, 30, 0, 0)], key=str)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert decontaminate.contamination(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    out = decontaminate.contamination(frame(spark, [(1, "a b")]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == [(2, 0, False)]
    import public_tokenizers

    assert token_counts.count(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert media.document_media(none).count() == 0
    assert license_scan.scan(none).count() == 0
