"""License scans by conditional compression.

A block is a line, or a run of adjacent lines. Lines that speak of a licence,
and blocks that hold a piece of a template which no confirmed block can lack,
are compressed alone and once with each template as a raw zstandard
dictionary. Templates are ranked by how much they save, and compared in that
order by the exact wording differences between the template and the part of
the block that is most like it, until a bound excludes all that are left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import arrowtext as at
from cargolens.llm.passages import keyed

#: Licence notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-only": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole licences and longer notices, by the names of their files.
TEMPLATES |= {f"{p.stem}#text": p.read_text() for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
CUES = re.compile(rb"(?i)licen[cs]e|copyright|public domain|spdx|warrant|all rights")
MOST_DIFFERENT = 0.25
WORD = re.compile(r"\w[\w.\-]*\w|\w")


LACK, ADD, NEVER = (1 << 20) + 1, 1 << 20, 1 << 60  # the cost of a difference; of equally many, fewer lacking words win


def costs(template: np.ndarray, words: np.ndarray, free: bool = True) -> np.ndarray:
    """For each end from 0 the least cost of the template against words up to it, from any start if free, else from 0."""
    n, m = len(template), len(words)
    if n <= m:
        add = ADD * np.arange(m + 1)
        cost = np.zeros(m + 1, np.int64) if free else add.copy()
        for t in template:
            new = cost + LACK
            np.minimum(new[1:], np.where(words == t, cost[:-1], NEVER), out=new[1:])
            cost = np.minimum.accumulate(new - add) + add
        return cost
    lack = LACK * np.arange(n + 1)
    cost, ends = lack.copy(), np.empty(m + 1, np.int64)
    ends[0] = cost[-1]
    for j, w in enumerate(words):
        new = cost + ADD
        if free:
            new[0] = 0
        np.minimum(new[1:], np.where(template == w, cost[:-1], NEVER), out=new[1:])
        cost = np.minimum.accumulate(new - lack) + lack
        ends[j + 1] = cost[-1]
    return ends


class Scanner:
    """Compares blocks with templates."""

    def __init__(self, templates: dict[str, str]):
        self.words = {k: WORD.findall(t.lower()) for k, t in templates.items()}
        self.most = {k: int(MOST_DIFFERENT * len(w)) for k, w in self.words.items()}
        self.ids = {w: i for i, w in enumerate(sorted({w for t in self.words.values() for w in t}))}
        self.coded = {k: self.code(w) for k, w in self.words.items()}
        self.bags = {k: Counter(w) for k, w in self.words.items()}
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = {k: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, t in templates.items()}
        # of most + 1 pieces of a template, a confirmed block has one unaltered
        self.pieces: dict[int, dict[tuple, set[str]]] = {1: {}, 2: {}, 3: {}}
        for k, w in self.words.items():
            size = len(w) // (self.most[k] + 1)
            for q in range(self.most[k] + 1 if w else 0):
                piece = tuple(w[q * size : q * size + min(size, 3)])
                self.pieces[len(piece)].setdefault(piece, set()).add(k)

    def code(self, words: list[str]) -> np.ndarray:
        return np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))

    def least(self, k: str, bag: Counter) -> int:
        """A bound: the template's words that are lacking whatever the order."""
        return sum(max(0, n - bag[w]) for w, n in self.bags[k].items())

    def __call__(self, block: bytes, whole: bool = False) -> dict:
        """The best template: what it saves, and the words that the block lacks and adds, but for those before and after it.

        Templates are compared in the order of what they save, each exactly
        unless a bound shows that it can't be better than the best so far. The
        best has the fewest differences; of a whole run of lines, the most words
        explained less differences, which a short notice inside it hasn't.
        """
        plain = len(self.alone.compress(block))
        saves = sorted(((plain - len(c.compress(block)), k) for k, c in self.given.items()), key=lambda x: (-x[0], x[1]))
        words = WORD.findall(block.decode("utf-8", "replace").lower())
        coded, bag, best, value = self.code(words), Counter(words), None, None
        for saved, k in saves:
            size = len(self.words[k])
            bound = size - len(words)
            worth = lambda lacks: -2 * lacks + size if whole else -lacks  # noqa: E731, B023
            if best is not None and (worth(bound) <= value or worth(self.least(k, bag)) <= value):
                continue
            found = self.found(k, plain, saved, int(costs(self.coded[k], coded).min()))
            own = (self.gain(found) if found["confirmed"] else -(1 << 40) + self.gain(found)) if whole else -found["lacking"] - found["added"]
            if best is None or own > value:
                best, value = found, own
        return best

    def found(self, k: str, plain: int, saved: int, cost: int) -> dict:
        differ, lacks = divmod(cost, ADD)
        return {"template": k, "plain_bytes": plain, "saved_bytes": saved, "lacking": lacks, "added": differ - lacks, "confirmed": bool(self.words[k]) and differ <= self.most[k]}

    def gain(self, found: dict) -> int:
        """Words explained less differences: what decides between blocks that overlap."""
        return len(self.words[found["template"]]) - 2 * found["lacking"] - found["added"]

    def hits(self, words: list[str]) -> list[tuple[int, int, set[str]]]:
        """Place and size of each piece of a template among words, and its templates."""
        out = []
        for size, pieces in self.pieces.items():
            if pieces and not pieces.keys().isdisjoint(zip(*(words[i:] for i in range(size)))):
                out += [(i, size, pieces[g]) for i, g in enumerate(zip(*(words[i:] for i in range(size)))) if g in pieces]
        return out

    def places(self, k: str, words: list[str], at: list[int]) -> Iterator[tuple[int, int, int]]:
        """First word, end and cost of each part of words that a template confirms, best first in its surroundings; a piece stands at each place of `at`."""
        reach, near = len(self.words[k]) + self.most[k], []
        for i in sorted(at):
            if near and i - reach <= near[-1][1]:
                near[-1][1] = i + reach
            else:
                near.append([max(0, i - reach), i + reach])
        near = [(lo, min(hi, len(words))) for lo, hi in near]
        while near:
            lo, hi = near.pop()
            if self.least(k, Counter(words[lo:hi])) > self.most[k]:
                continue
            coded = self.code(words[lo:hi])
            cost = costs(self.coded[k], coded)
            end = int(cost.argmin())
            if cost[end] // ADD > self.most[k]:
                continue
            start = end - int(costs(self.coded[k][::-1], coded[:end][::-1], False).argmin())
            yield lo + start, lo + end, int(cost[end])
            near += [(lo, lo + start), (lo + end, hi)]

    def runs(self, lines: list[bytes], words: list[str], of: list[int], hits: list, confirmed: dict[int, dict]) -> Iterator[tuple[int, int, dict]]:
        """First and last line, and result by compression and exact differences, of runs of lines that a template confirms; of those that overlap, lines or runs, the one with most gain."""
        at: dict[str, list[int]] = {}
        for i, _, names in hits:
            for k in names:
                at.setdefault(k, []).append(i)
        all_ = []
        for k, places in at.items():
            for start, end, cost in self.places(k, words, places):
                if of[start] < of[end - 1]:
                    all_.append((of[start], of[end - 1], self.found(k, 0, 0, cost)))
        kept: list[tuple[int, int]] = []
        for lo, hi, found in sorted(all_, key=lambda x: (-self.gain(x[2]), x[2]["template"], x[0])):
            if any(lo <= i <= hi and self.gain(line) >= self.gain(found) for i, line in confirmed.items()) or any(lo <= b and a <= hi for a, b in kept):
                continue
            kept.append((lo, hi))
            yield lo, hi, self(b"\n".join(lines[lo : hi + 1]), whole=True)

    def blocks(self, text: bytes, known: dict) -> Iterator[tuple[int, bytes, dict]]:
        """Line number, block and result: each line with a cue, and what else is confirmed."""
        hits = self.hits(WORD.findall(text.decode("utf-8", "replace").lower()))
        if not hits and not CUES.search(text):
            return
        lines = text.split(b"\n")
        per_line = [WORD.findall(x.decode("utf-8", "replace").lower()) for x in lines]
        of = [i for i, w in enumerate(per_line) for _ in w]
        whole = {of[i] for i, size, _ in hits if of[i] == of[i + size - 1]}
        confirmed = {}
        for i, line in enumerate(lines):
            cue = CUES.search(line)
            if cue or i in whole:
                if line not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[line] = self(line)
                if known[line]["confirmed"]:
                    confirmed[i] = known[line]
                if cue or known[line]["confirmed"]:
                    yield i, line, known[line]
        for lo, hi, found in self.runs(lines, [w for x in per_line for w in x], of, hits, confirmed):
            yield lo, b"\n".join(lines[lo : hi + 1]), found


RESULT = pa.schema([("pid", pa.int64()), ("line_no", pa.int32()), ("block", pa.string()), ("template", pa.string()), ("plain_bytes", pa.int32()), ("saved_bytes", pa.int32()), ("lacking", pa.int32()), ("added", pa.int32()), ("confirmed", pa.bool_())])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each candidate block: its first line, best template, sizes, wording differences, and whether that confirms it.

    Every line with a cue has a row; other lines, and runs of lines (block has
    the line ends), have one where a template confirms them. Of runs that
    overlap each other or a confirmed line, the one that explains most words
    is given. Null and empty texts have no line. Every row of a doc_id is
    scanned, so repeated rows give repeated results. Ties go to fewer
    differences, then to the larger saving, then to the first name. Other
    columns are not read.
    """
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, known = Scanner(templates), {}
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for row, _, data, offsets in at.chunks(*at.buffers(batch.column(1))):
                raw = data.tobytes()
                for r in range(len(offsets) - 1):
                    for line, block, found in scanner.blocks(raw[int(offsets[r]) : int(offsets[r + 1])], known):
                        out.append({"pid": keys[row + r], "line_no": line, "block": block.decode("utf-8", "replace"), **found})
            yield pa.RecordBatch.from_pylist(out, schema=RESULT)

    return keyed(docs).mapInArrow(run, "pid long, line_no int, block string, template string, plain_bytes int, saved_bytes int, lacking int, added int, confirmed boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every candidate line of all documents with its best template."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("pid").alias("doc_id"), "line_no", F.sha2("block", 256).alias("block_sha256"), "template", "plain_bytes", "saved_bytes", "lacking", "added", "confirmed")
