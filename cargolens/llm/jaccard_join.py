"""N-gram Jaccard join: documents whose shingle sets have Jaccard distance of 0.25 at most.

Documents of a corpus lie at distance 1 from almost every other, where Voronoi
regions of document pivots overlap wholly. The first pivots are therefore
single shingles: the set {s} is at distance 1 - 1/|x| from each x that holds s
and at 1 from all others, so a document's nearest pivots are its own shingles,
ties broken by a rarity order that all share. Its window is the pivots that
a document within the radius could be nearest to: two sets within 0.25 share
one of the first |x| - ceil(3|x|/4) + 1 shingles of each. A document is
replicated to those regions alone.

Members of one region that its bounds leave are joined recursively, with
documents as pivots: the member of the least key leads, and as the regions of
a family mostly have the same leader, a family is one group, whose texts come
once. A group that is too large for one task is split at random, with its
leader in each part. In a part the leader's ball (distance within the radius)
is connected; a member outside it is the next pivot, and meets those alone
whose distances to the pivots so far differ by no more than the radius and
that it isn't connected with. What stays outside the leader's component then
visits the other parts: residents are dealt to rings by distance to the
leader, and a visitor is replicated to its own ring and its neighbours, the
triangle's window. Before texts are sent, members that can't be linked to any
other of a family go, by sets of bits made from the shingles' hashes, which only
ever overstate what two sets share. Everything is compared by words, not by hashes. No link
between components is lost; pairs that are connected already aren't listed.

Rarity comes from a fixed number of counters over all documents' shingles and
sets only the order; any order gives the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm import arrowtext as at
from cargolens.llm import shared
from cargolens.llm.passages import packed

WORDS, COUNTERS, RADIUS = 5, 1 << 22, 0.25
AT_ONCE = 300_000  # windows held before they are sent on
BROADCAST_KEYS = 1 << 18  # at most so many class keys of 8 bytes go to every executor; beyond that the join shuffles
PART_SHINGLES, LEAST_SHINGLES, PIVOTS, PRUNED = 1 << 18, 64, 8, 512  # of a part; what a member counts at least; pivots whose distances are kept; members of a family whose bits are compared
WINDOW = np.dtype([("s", "<u4"), ("k", "<i8"), ("n", "<u4"), ("q", "u1")])
MEMBER = np.dtype([("l", "<i8"), ("k", "<i8"), ("n", "<i4")])


def window_size(n):
    """How many first shingles of a set of n another set within the radius must meet."""
    return n - (3 * n + 3) // 4 + 1


def counts_of(first):
    """How many shingles with repeats rows of so many words have."""
    m = np.diff(first)
    return m, np.where(m >= WORDS, m - WORDS + 1, (m > 0).astype(np.int64))


def exact_sets(data, offsets, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct shingles of each row as numbers that stand for their words, without hashing, the rows' bounds, and hashes if wanted."""
    w, first, known = at.coded_words(data, offsets, lower=True)
    m, count = counts_of(first)
    row = np.repeat(np.arange(len(m)), count)
    s = np.arange(len(row)) - np.repeat((np.cumsum(count) - count), count) + first[row]
    long = m[row] >= WORDS
    ids, code, span, top = np.empty(len(row), np.int64), w, 1, 0
    while span < WORDS and len(code) >= WORDS:  # code: for each place the `span` words from there on
        step = min(span, WORDS - span)
        kinds, code = np.unique(code[: len(code) - step] * (int(code.max()) + 1) + code[step:], return_inverse=True)
        span, top = span + step, len(kinds)
    if long.any():
        ids[long] = code[s[long]]
    seen: dict[tuple, int] = {}
    for i in np.flatnonzero(~long):  # texts of fewer words: one shingle
        ids[i] = top + seen.setdefault(tuple(w[s[i] : s[i] + m[row[i]]].tolist()), len(seen))
    order = np.argsort((row << 32) | ids)
    ids, row, s = ids[order], row[order], s[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])][: len(ids)]
    ids, row, s = ids[new], row[new], s[new]
    h = at.slice_hash(at.prefix_sums(at.hashes_of(known)[w]), s, s + np.minimum(WORDS, m[row])) if hashed else None
    return ids, np.searchsorted(row, np.arange(len(m) + 1)), h


def shingles(data, offsets, rarity):
    """44-bit hashes of the distinct shingles of each row in rarity order, and the rows' bounds among them.

    The rows are a chunk's, so 20 bits number those that aren't empty.
    """
    _, bounds, h = exact_sets(data, offsets, hashed=True)
    n = np.diff(bounds)
    n = n[n > 0]
    classed = rarity[(h >> np.uint64(6) & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(38)
    h = np.sort(np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(44) | classed | h >> np.uint64(26))
    return h & np.uint64((1 << 44) - 1), bounds


def bit_sets(h: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """For each row a set of bits, a power of two of them and at least twice as many as shingles; None for a row without any."""
    n = np.diff(bounds)
    size = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64), 0)
    base = np.cumsum(size) - size
    row = np.repeat(np.arange(len(n)), n)
    on = np.zeros(int(size.sum()), bool)
    on[base[row] + (at.mix(h) & (size[row] - 1).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(on, bitorder="little").tobytes()
    return [raw[b // 8 : (b + k) // 8] if k else None for b, k in zip(base.tolist(), size.tolist(), strict=True)]


def keys_of(data, offsets, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a digest of each row's lowered words; the first is the class, and 0 for a row without words."""
    raw, out = data.tobytes(), np.zeros((len(offsets) - 1, 2), np.int64)
    salt = seed.to_bytes(8, "little")
    for i in range(len(out)):
        words = raw[int(offsets[i]) : int(offsets[i + 1])].lower().split()
        if words:
            out[i] = np.frombuffer(hashlib.blake2b(b" ".join(words), digest_size=16, salt=salt).digest(), "<i8")
            out[i, 0] = out[i, 0] or 1
    return out[:, 0], out[:, 1]


def rarity_classes(texts: DataFrame) -> np.ndarray:
    """For each counter its class, below 64: how far above the mean its shingles occur."""

    def slots(batch):
        for *_, data, offsets in at.chunks(*at.buffers(batch.column(1))):
            *_, h = exact_sets(data, offsets, hashed=True)
            yield (h >> np.uint64(6) & np.uint64(COUNTERS - 1)).astype(np.int64)

    counts = shared.tally(texts, slots, COUNTERS)
    mean = counts.mean(dtype=np.float64)
    out = np.zeros(COUNTERS, np.uint8)
    for part, to in zip(np.split(counts, 64), np.split(out, 64), strict=True):
        z = (part - mean) / max(np.sqrt(mean), 1.0)
        to[:] = np.where(z > 2, np.minimum(63, 1 + np.floor(2 * np.log2(np.maximum(z, 2) / 2))), 0)
    return out


def classes(seed: int):
    """(pid, k, check, n_shingles, text, bits): class and set size of every row; compressed text and bits of the batch's first of a class."""
    schema = pa.schema([("pid", pa.int64()), ("k", pa.int64()), ("check", pa.int64()), ("n_shingles", pa.int64()), ("text", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            have: set[int] = set()
            for row, end, data, offsets in at.chunks(*at.buffers(batch.column(1))):
                k, check = keys_of(data, offsets, seed)
                _, bounds, h = exact_sets(data, offsets, hashed=True)
                bits = bit_sets(h, bounds)
                texts = [None] * len(k)
                for i, x in enumerate(k.tolist()):
                    if x and x not in have:
                        have.add(x)
                        texts[i] = squeeze.compress(data[offsets[i] : offsets[i + 1]].tobytes())
                bits = [None if t is None else b for t, b in zip(texts, bits, strict=True)]
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.array(k), pa.array(check), pa.array(np.diff(bounds), pa.int64()), pa.array(texts, pa.binary()), pa.array(bits, pa.binary())], schema=schema)

    return run


def replicate(rarity, n_buckets: int, seed: int):
    """Each class of a batch goes to its window of regions."""
    schema = pa.schema([("bucket", pa.int32()), ("windows", pa.binary())])

    def flush(parts: list) -> pa.RecordBatch:
        bucket, out = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows = packed(bucket, out, n_buckets)
        return pa.record_batch([pa.array(rows, pa.int32()), pa.array(rows.values(), pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, have = [], np.zeros(0, np.int64)
            for *_, data, offsets in at.chunks(*at.buffers(batch.column(1))):
                key, _ = keys_of(data, offsets, seed)
                h, bounds = shingles(data, offsets, rarity.value)
                _, once = np.unique(key, return_index=True)
                once = once[(key[once] != 0) & ~np.isin(key[once], have)]
                have = np.r_[have, key[once]]
                n = np.diff(bounds)[once]
                w = window_size(n)
                of = np.repeat(np.arange(len(once)), w)
                pos = np.arange(len(of)) - np.repeat((np.cumsum(w) - w), w)
                g = at.mix(h[bounds[:-1][once[of]] + pos])
                out = np.empty(len(of), WINDOW)
                out["s"], out["k"], out["n"], out["q"] = g >> np.uint64(32), key[once[of]], n[of], pos * 256 // w[of]
                parts.append(((g % np.uint64(n_buckets)).astype(np.int32), out))
                if sum(len(x) for _, x in parts) > AT_ONCE:
                    yield flush(parts)
                    parts = []
            if parts:
                yield flush(parts)

    return run


def close_sizes(n, m, p, q):
    """Whether sets of n and m whose first common shingle stands at p and q can be within the radius."""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= (3 * (n + m) + 6) // 7)


def regions(table: pa.Table) -> pa.Table:
    """A bucket's regions as (leader, member) rows, without members that fit no other by size and place.

    A region is split where the next larger set is too large to be linked to
    any smaller one. The leader is the member of the least key.
    """
    a = np.frombuffer(b"".join(table.column("windows").to_pylist()), WINDOW)
    a = a[np.lexsort((a["k"], a["n"], a["s"]))]
    a = a[np.r_[True, (a["s"][1:] != a["s"][:-1]) | (a["k"][1:] != a["k"][:-1])][: len(a)]]

    def split(a):
        n = a["n"].astype(np.int64)
        head = np.flatnonzero(np.r_[True, (a["s"][1:] != a["s"][:-1]) | (4 * n[:-1] < 3 * n[1:])][: len(a)])
        return n, head, np.diff(np.r_[head, len(a)])

    n, head, size = split(a)
    several = np.repeat(size > 1, size)
    a = a[several]
    n, head, size = split(a)
    if len(a):
        p = a["q"].astype(np.int64) * window_size(n) // 256
        index, first = np.arange(len(a)), np.repeat(head, size)
        least = np.where(index == first, n[np.minimum(first + 1, len(a) - 1)], n[first])  # the smallest other set
        least = np.maximum(least, (3 * n + 3) // 4)
        keep = n - p >= (3 * (n + least) + 6) // 7
        two = np.flatnonzero(size == 2)
        fits = close_sizes(n[head[two]], n[head[two] + 1], p[head[two]], p[head[two] + 1])
        keep[head[two]] &= fits
        keep[head[two] + 1] &= fits
        group = np.repeat(np.arange(len(head)), size)[keep]
        a = a[keep]
        enough = (np.bincount(group, minlength=1) > 1)[group]
        a, group = a[enough], group[enough]
    out = np.empty(len(a), MEMBER)
    if len(a):
        by = np.lexsort((a["k"], group))
        start = np.flatnonzero(np.r_[True, np.diff(group) > 0])
        out["l"] = np.repeat(a["k"][by][start], np.diff(np.r_[start, len(a)]))
        out["k"], out["n"] = a["k"], a["n"]
        out = np.unique(out)
    return pa.table({c: out[c].astype(np.int64) for c in MEMBER.names})


def fits(rows: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Which of these sets could be within the radius of another one, by their bits: a bit that one has alone is a shingle that it has alone."""
    fold = lambda x: x[..., : x.shape[-1] // 2] | x[..., x.shape[-1] // 2 :]  # noqa: E731  as if made with half the bits
    words = np.array([len(x) for x in rows])
    at_ = {k: np.flatnonzero(words == k) for k in np.unique(words).tolist()}
    full = {k: np.stack([rows[i] for i in at_[k]]) for k in at_}
    half = {k: fold(full[k]) if k > 1 else full[k] for k in at_}
    out = np.zeros(len(rows), bool)
    for y, own in enumerate(rows):
        for k, of in at_.items():
            if k == len(own):
                mine, theirs = own, full[k]
            elif k == 2 * len(own):
                mine, theirs = own, half[k]
            elif 2 * k == len(own):
                mine, theirs = fold(own), full[k]
            else:
                continue
            inter = np.minimum(n[y] - np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64), n[of] - np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64))
            if ((7 * inter >= 3 * (n[y] + n[of])) & (of != y)).any():
                out[y] = True
                break
    return out


def prune(table: pa.Table) -> pa.Table:
    """Drops members that can't be linked to any other of their family, where the whole family is here and not large; a leader stays while others do."""
    l, k, n, parts, part = (table.column(c).to_numpy() for c in ("l", "k", "n", "parts", "part"))
    bits = table.column("bits").to_pylist()
    order = np.lexsort((k, part, l))
    keep = np.ones(len(k), bool)
    for of in np.split(order, np.flatnonzero((l[order][1:] != l[order][:-1]) | (part[order][1:] != part[order][:-1])) + 1):
        if len(of) and parts[of[0]] == 1 and len(of) <= PRUNED:
            keep[of] = fits([np.frombuffer(bits[i], np.uint64) for i in of], n[of])
            if keep[of].any():
                keep[of] |= k[of] == l[of]
    return table.select(["l", "k", "n", "parts", "part"]).filter(pa.array(keep))


class Sets:
    """Shingle sets of a bucket's texts, and what they have in common."""

    def __init__(self, texts: list[bytes]):
        sizes = np.cumsum([0, *(len(t) for t in texts)]).astype(np.int64)
        self.ids, self.bounds, _ = exact_sets(np.frombuffer(b"".join(texts), np.uint8), sizes)
        self.size = np.diff(self.bounds)
        self.mark = np.zeros(int(self.ids.max(initial=-1)) + 1, bool)

    def gathered(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these sets, one set after another, and where each begins; sets aren't empty."""
        n = self.size[which]
        start = np.cumsum(n) - n
        return self.ids[np.arange(int(n.sum())) + np.repeat(self.bounds[which] - start, n)], start

    def common(self, one: int, gathered: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How many shingles a set shares with each of the gathered."""
        own = self.ids[self.bounds[one] : self.bounds[one + 1]]
        self.mark[own] = True
        out = np.add.reduceat(self.mark[gathered[0]], gathered[1], dtype=np.int64)
        self.mark[own] = False
        return out


def linked(sets: Sets, which: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of these sets the index of one that it is connected with, and its common and joint shingles with which[lead]."""
    n, gathered = sets.size[which], sets.gathered(which)
    inter = sets.common(which[lead], gathered)
    all_ = n + n[lead] - inter
    ball = 4 * inter >= 3 * all_
    root = np.where(ball, lead, np.arange(len(which)))
    far = [1 - inter / all_]
    for y in np.flatnonzero(~ball):
        meets = (root != root[y]) & (4 * np.minimum(n, n[y]) >= 3 * np.maximum(n, n[y]))
        for d in far:
            meets &= np.abs(d - d[y]) <= RADIUS + 1e-9
        if not meets.any():
            continue
        both = sets.common(which[y], gathered)
        hit = meets & (4 * both >= 3 * (n + n[y] - both))
        if hit.any():
            names = np.unique(np.r_[root[hit], root[y]])
            root[np.isin(root, names)] = lead if root[lead] in names else names[0]
        if len(far) < PIVOTS:
            far.append(1 - both / (n + n[y] - both))
    return root, inter, all_


LINKS = "l long, k long, n long, parts int, root long, inter long, `all` long"


def join_parts(table: pa.Table) -> pa.Table:
    """Joins each part of a bucket: (l, k, n, parts, root, common and joint shingles with the leader)."""
    l, k, part, n, parts = (table.column(c).to_numpy() for c in ("l", "k", "part", "n", "parts"))
    keys, first, where = np.unique(k, return_index=True, return_inverse=True)
    texts = table.column("text").take(pa.array(first)).to_pylist()
    sets = Sets([zstandard.decompress(t) for t in texts])
    order = np.lexsort((k, part, l))
    edge = np.flatnonzero(np.r_[True, (l[order][1:] != l[order][:-1]) | (part[order][1:] != part[order][:-1])])
    root, inter, all_ = (np.empty(len(k), np.int64) for _ in range(3))
    for of in np.split(order, edge[1:]):
        r, inter[of], all_[of] = linked(sets, where[of], int(np.flatnonzero(k[of] == l[of])[0]))
        root[of] = k[of][r]
    return pa.table({"l": l, "k": k, "n": n, "parts": parts, "root": root, "inter": inter, "all": all_})


def join_visitors(table: pa.Table) -> pa.Table:
    """Edges between the visitors of a ring's part and its residents: at most one that each new connection needs."""
    group, k, root, visits = (table.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "k", "root", "visits"))
    keys, first, where = np.unique(k, return_index=True, return_inverse=True)
    sets = Sets([zstandard.decompress(t) for t in table.column("text").take(pa.array(first)).to_pylist()])
    order = np.lexsort((k, group))
    a, b = [], []
    for of in np.split(order, np.flatnonzero(group[order][1:] != group[order][:-1]) + 1):
        here, guests = of[~visits[of]], of[visits[of]]
        if not len(here) or not len(guests):
            continue
        gathered, n, name = sets.gathered(where[here]), sets.size[where[here]], root[here].copy()
        label = dict(zip(k[guests].tolist(), root[guests].tolist(), strict=True))
        for y, key in zip(where[guests].tolist(), k[guests].tolist(), strict=True):
            both = sets.common(y, gathered)
            hit = (4 * both >= 3 * (n + sets.size[y] - both)) & (name != label[key])
            for old in np.unique(name[hit]):
                a.append(key)
                b.append(int(k[here[np.flatnonzero(hit & (name == old))[0]]]))
            names = np.unique(name[hit])
            name[np.isin(name, names)] = label[key]
            gone = set(names.tolist())
            label = {g: label[key] if x in gone else x for g, x in label.items()} if gone else label
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def dealt(df: DataFrame, n_buckets: int, *by: str) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*by), F.lit(n_buckets)).cast("int"))


def edges_of(families: DataFrame, known: DataFrame, n_buckets: int, part_shingles: int, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): links that connect whatever the links of all families connect; and the tables that they are read from."""
    weight = F.greatest("n", F.lit(LEAST_SHINGLES))
    first = lambda c: known.filter("text is not null").select("k", c).groupBy("k").agg(F.first(c).alias(c))
    sizes = families.groupBy("l").agg(F.ceil(F.sum(weight) / part_shingles).cast("int").alias("parts"))
    rows = families.join(sizes, "l").withColumn("part", F.when(F.col("k") == F.col("l"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))))
    rows = rows.select("l", "k", "n", "parts", F.explode("part").alias("part")).join(first("bits"), "k")
    rows = shared.table(dealt(rows, n_buckets, "l", "part").groupBy("bucket").applyInArrow(prune, "l long, k long, n long, parts int, part int"), most)
    members = shared.table(rows.select("k").distinct(), most)
    wanted = F.broadcast(members) if members.count() <= BROADCAST_KEYS else members
    sets = known.filter("text is not null").select("k", "text").join(wanted, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    found = shared.table(dealt(rows.join(sets, "k"), n_buckets, "l", "part").groupBy("bucket").applyInArrow(join_parts, LINKS), most)
    tables = [rows, members, found]
    edges = found.filter("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b"))
    split = found.filter("parts > 1")
    if split.isEmpty():
        return edges, tables
    # the recursion: rings around the leader, visitors from outside its component
    split = split.withColumn("ring", F.least(F.lit(3), F.floor(4 * (F.col("all") - F.col("inter")) / F.col("all"))).cast("int"))
    here = split.filter("k <> l")
    guests = here.filter("root <> l")
    rings = here.groupBy("l", "ring").agg(F.ceil(F.sum(weight) / part_shingles).cast("int").alias("salts"))
    blocks = guests.groupBy("l").agg(F.ceil(F.sum(weight) / part_shingles).cast("int").alias("blocks"))
    plan = rings.join(blocks, "l")
    at_home = here.join(plan, ["l", "ring"]).select("l", "ring", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "k", "root", F.lit(False).alias("visits"))
    near = F.explode(F.sequence(F.greatest(F.col("ring") - 1, F.lit(0)), F.least(F.col("ring") + 1, F.lit(3)))).alias("ring")
    visiting = guests.select("l", "k", "root", near).join(plan, ["l", "ring"]).select("l", "ring", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"), "k", "root", F.lit(True).alias("visits"))
    rows = at_home.unionByName(visiting).withColumn("grp", F.xxhash64("l", "ring", "salt", "block")).select("grp", "k", "root", "visits").join(sets, "k")
    more = dealt(rows, n_buckets, "grp").groupBy("bucket").applyInArrow(join_visitors, "a long, b long")
    return edges.unionByName(more), tables


def groups(docs: DataFrame, per_partition: int = 4, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """pid, n_shingles and component_id of every row of docs.

    Words are split at ASCII white space after A-Z became a-z. A null or empty
    text has no shingle and stands alone. Each row is linked by its own text,
    also where rows share a doc_id; component_id is the least doc_id that a row
    reaches, and null where no row that it reaches has one. Rows of equal words
    are one class, so copies cost one row a class and batch. Other columns are
    not read.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    n_buckets = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, most = docs.select(F.col("doc_id").cast("long").alias("pid"), F.col("text").cast("string").alias("text")), shared.tasks(docs)
    for seed in range(8):
        known = shared.table(texts.mapInArrow(shared.tidied(classes(seed)), "pid long, k long, check long, n_shingles long, text binary, bits binary"), most)
        # a class is 64 bits of a digest; should two classes ever meet there, the other 64 bits tell
        if known.groupBy("k").agg((F.min("check") != F.max("check")).alias("mixed")).filter("mixed").isEmpty():
            break
        shared.discard(known)
    else:
        raise RuntimeError("class keys collide under every seed")
    rarity = sc.broadcast(rarity_classes(texts))
    windows = texts.mapInArrow(shared.tidied(replicate(rarity, n_buckets, seed)), "bucket int, windows binary")
    families = shared.table(windows.groupBy("bucket").applyInArrow(regions, "l long, k long, n long").distinct(), most)
    shared.release(spark)
    edges, tables = edges_of(families, known, n_buckets, part_shingles, most)
    roots = shared.components(edges, most)
    for used in (families, *tables):
        shared.discard(used)
    shared.release(spark)
    least = known.filter("k <> 0").groupBy("k").agg(F.min("pid").alias("least")).join(roots.selectExpr("node k", "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    lowest = shared.table(least.groupBy("root").agg(F.min("least").alias("component_id")), most)  # a table of its own, so that a join can split a large component
    component = least.join(lowest, "root").select("k", "component_id")
    return known.select("pid", "k", "n_shingles").join(component, "k", "left").select("pid", "n_shingles", F.coalesce("component_id", "pid").alias("component_id"))


def digest_query(spark, sf_dir: str) -> DataFrame:
    """op2: one row a document with its component."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("pid", "doc_id")
