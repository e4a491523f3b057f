"""Exact n-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct word n-grams (with fewer
words, of the whole sequence; without words it is empty and links with
nothing). Two documents link when den * |x & y| >= num * |x | y|.

1. Equal sets collapse to their smallest document.
2. Candidates, without loss: every n-gram gets its document count over the
   whole corpus; a set's first |x| - ceil(t |x|) + 1 n-grams by (count class,
   hash) must share one with those of any set it links with. The rarest come
   first, so a line or passage that many documents hold hardly makes
   candidates. Counting and matching go between batches of documents (by hash
   of the id) and buckets of hashes: a batch sends each distinct hash once and
   gets a few bits back, so no hash, however common, is a large group.
3. Documents joined by candidates form blocks. In a block, or a tile of at
   most ``TILE`` documents of a larger one, a signature tree is built: nodes
   hold OR-combined token bitmaps and size ranges. A dual traversal drops node
   pairs whose greatest possible overlap is too small, then document pairs by
   their own bitmaps, then verifies on the sets, skipping pairs that are
   connected already. The links found are a spanning forest.
4. Larger blocks: the tiles' components are compared by their smallest
   documents, tile by tile again; where a block still has several components,
   all pairs of tiles are joined but those inside one component, which needs
   no further link. A block whose documents link costs a number of tiles in
   proportion to its size, and no link between components is lost.

Defined cases: null and empty texts have n_shingles 0 and are their own
component; a null id is a node below all others and is returned as null; rows
that repeat an id are one node with several sets; copies are linked.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, isolate, mix64, restore, row_id, slots, value_ranges, write_once
from .graph import components

WORDS, NUM, DEN = 3, 90, 100
TILE, BITS, FAN, BATCH_MB, BUCKET_MB = 1024, 4096, 8, 4, 8
_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[list(b" \t\n\x0b\x0c\r")] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_GOLD = _U(0x9E3779B97F4A7C15)
_PIECE, _LONG = 1 << 20, 1 << 16
_rng = np.random.default_rng(4)
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWER = np.cumprod(np.concatenate([np.ones(1, _U), np.full(_LONG, int(_rng.integers(1 << 62)) * 2 + 1, _U)]))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of lower-cased bytes, piece by piece."""
    starts, hashes, a = [], [], 0
    while a < len(raw):
        cut = _GAP.search(raw, a + _PIECE) if a + _PIECE < len(raw) else None
        b = cut.start() if cut else len(raw)
        data = np.frombuffer(raw, np.uint8, b - a, a)
        word = ~_WHITE[data]
        first = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
        if len(first):
            last = np.flatnonzero(word & np.concatenate([~word[1:], [True]])) + 1
            own = np.repeat(first, np.diff(np.append(first, len(data))))
            place = np.arange(first[0], len(data)) - own
            part = np.where(word[first[0]:], _VALUE[data[first[0]:]] * _POWER[np.minimum(place, _LONG)], _U(0))
            h = mix64(np.add.reduceat(part, first - first[0]) ^ (last - first).astype(_U) * _GOLD)
            for i in np.flatnonzero(last - first > _LONG):   # no power of its own for each byte: hashed as a whole
                h[i] = int.from_bytes(hashlib.blake2b(raw[a + first[i]:a + last[i]], digest_size=8).digest(), "little")
            starts.append(first + a)
            hashes.append(h)
        a = b
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, _U))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, ends): sorted distinct shingle hashes of the texts, one after the other."""
    raw = b"\n".join(texts).lower()
    start, h = word_hashes(raw)
    stops = np.cumsum([len(t) + 1 for t in texts])
    cut = np.concatenate([[0], np.searchsorted(start, stops)])
    gram = np.zeros(max(0, len(h) - words + 1), _U)
    for j in range(words):
        gram = mix64(gram * _GOLD + h[j:len(h) - words + 1 + j])
    out = []
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(gram[a:b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, _U)
            for j in range(a, b):
                whole = mix64(whole * _GOLD + h[j:j + 1])
            out.append(mix64(whole + _GOLD))
        else:
            out.append(np.zeros(0, _U))
    ends = np.cumsum([len(x) for x in out], dtype=np.int64)
    return (np.concatenate(out) if out else np.zeros(0, _U)), ends


def group_sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(x)])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(np.int64)]


class Sets:
    """The documents of one batch and their shingle sets."""

    def __init__(self, ids, texts: list[bytes], words: int):
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))   # rows of a group come in any order
        self.ids = np.asarray(ids, np.int64)[order]
        self.tokens, self.ends = shingle_sets([texts[i] for i in order], words)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.sizes = self.ends - self.starts
        self.doc = np.repeat(np.arange(len(order), dtype=np.int32), self.sizes)
        self.key1, self.key2 = group_sums(mix64(self.tokens), self.ends), group_sums(mix64(self.tokens ^ _GOLD), self.ends)
        # the first document of each distinct set; the rows are in order of id
        pair = np.rec.fromarrays([self.sizes, self.key1, self.key2])
        self.rep = np.unique(pair, return_index=True)[1]
        self.is_rep = np.zeros(len(order), bool)
        self.is_rep[self.rep] = True
        self.is_rep &= self.sizes > 0
        self.short, self.where, counts = np.unique((self.tokens >> _U(32)).astype(np.uint32), return_inverse=True, return_counts=True)
        self.where = self.where.astype(np.int32)
        self.counts = np.minimum(counts, 255).astype(np.uint8)

    def prefixes(self, level: np.ndarray, num: int, den: int) -> None:
        """The prefix tokens of the distinct sets: ``p_digit`` and ``p_doc``, and their distinct digits with tags."""
        rank = (level[self.where].astype(_U) << _U(58)) | (self.tokens >> _U(6))
        picked = []
        for i in np.flatnonzero(self.is_rep).tolist():
            a, n = int(self.starts[i]), int(self.sizes[i])
            most = n - (num * n + den - 1) // den + 1
            own = rank[a:a + n]
            picked.append(a + (np.argpartition(own, most - 1)[:most] if most < n else np.arange(n)))
        at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        digit, doc = self.tokens[at] >> _U(6), self.doc[at]
        order = np.lexsort((doc, digit))
        self.p_digit, self.p_doc = digit[order], doc[order]
        self.digits, first, self.p_kind, many = np.unique(self.p_digit, return_index=True, return_inverse=True, return_counts=True)
        self.shared = many > 1
        self.tags = (mix64(self.key1[self.p_doc[first]] ^ self.key2[self.p_doc[first]] ^ self.digits * _GOLD) >> _U(32)).astype(np.uint32)


def ranges(sorted_values: np.ndarray, bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets present, bounds) of sorted values of ``bits`` bits, split into equal ranges."""
    b = ((sorted_values.astype(_U) >> _U(bits - 32)) * _U(buckets)) >> _U(32)
    present, start = np.unique(b, return_index=True)
    return present.astype(np.int64), np.append(start, len(sorted_values))


def pieces(cut: np.ndarray):
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, in 16 bits each where they fit."""
    d = np.diff(x, prepend=x[:1])
    d = d.astype(np.uint16) if len(d) == 0 or d.max() < 65536 else d
    return x[:1].tobytes() + d.tobytes()


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    d = np.frombuffer(raw, np.uint16 if len(raw) == 4 + 2 * n else np.uint32, n, 4)
    return (np.cumsum(d, dtype=np.int64) + np.frombuffer(raw, np.uint32, 1)[0]).astype(np.uint32)


def nibbles(x: np.ndarray) -> bytes:
    x = np.append(x, 0).astype(np.uint8) if len(x) % 2 else x.astype(np.uint8)
    return (x[::2] << 4 | x[1::2]).tobytes()


def from_nibbles(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    return np.stack([x >> 4, x & 15], axis=1).ravel()[:n]


def count_classes(table: pa.Table) -> pa.Table:
    """Bucket side of the counts: for each asked hash the class (log2, at most 15) of its document count."""
    counts = [np.frombuffer(x.as_py(), np.uint8) for x in table.column("counts")]
    values = [unpack_sorted(x.as_py(), len(c)) for x, c in zip(table.column("hashes"), counts, strict=True)]
    level = [np.empty(len(c), np.uint8) for c in counts]
    for cut in value_ranges(values):
        v = np.concatenate([x[a:b] for x, (a, b) in zip(values, cut, strict=True)])
        c = np.concatenate([x[a:b] for x, (a, b) in zip(counts, cut, strict=True)]).astype(np.int64)
        order = np.argsort(v, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]]))
        total = np.add.reduceat(c[order], start)
        own = np.empty(len(v), np.uint8)
        own[order] = np.repeat(np.minimum(np.log2(total), 15).astype(np.uint8), np.diff(np.append(start, len(v))))
        put_back(level, cut, own)
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"),
                     "answer": pa.array([nibbles(x) for x in level], pa.binary())})


def put_back(into: list[np.ndarray], cut, values: np.ndarray) -> None:
    """Hand a range's joined values back to the arrays it was cut from."""
    k = 0
    for x, (a, b) in zip(into, cut, strict=True):
        x[a:b] = values[k:k + b - a]
        k += b - a


def open_tokens(table: pa.Table) -> pa.Table:
    """Bucket side of the match: which prefix tokens two different sets hold. A bucket below 0 is a batch's note to itself."""
    if table.column("bucket")[0].as_py() < 0:
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": table.column("digits")})
    digits = [np.frombuffer(x.as_py(), _U) for x in table.column("digits")]
    tags = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("tags")]
    shared = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(d)) for x, d in zip(table.column("shared"), digits, strict=True)]
    answer = [np.empty(len(d), bool) for d in digits]
    for cut in value_ranges(digits):
        d, tag, two = (np.concatenate([x[a:b] for x, (a, b) in zip(xs, cut, strict=True)]) for xs in (digits, tags, shared))
        order = np.argsort(d, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], d[order][1:] != d[order][:-1]]))
        is_open = (np.maximum.reduceat(two[order], start) > 0) | (np.minimum.reduceat(tag[order], start) != np.maximum.reduceat(tag[order], start))
        own = np.empty(len(d), bool)
        own[order] = np.repeat(is_open, np.diff(np.append(start, len(d))))
        put_back(answer, cut, own)
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"),
                     "answer": pa.array([np.packbits(x).tobytes() for x in answer], pa.binary())})


def answers_of(table: pa.Table) -> list[bytes]:
    """A batch's answers in bucket order, without its notes."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True))
    return [a for b, a in rows if b >= 0]


FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                   ("tokens", pa.binary())])
FOUND_SQL = "kind int, a long, b long, n long, k1 long, k2 long, tokens binary"


def found_rows(s: Sets, is_open: np.ndarray) -> pa.Table:
    """kind 0: documents (a; n; the key of the set; the set, where it has candidates and is the batch's first);
    1: candidates a, b inside the batch; 2: open token a held by document b."""
    hit = is_open[s.p_kind]
    digit, doc = s.p_digit[hit], s.p_doc[hit]
    new = np.concatenate([[True], digit[1:] != digit[:-1]]) if len(digit) else np.zeros(0, bool)
    head = doc[new]   # the first document of each open token
    to = np.repeat(head, np.diff(np.append(np.flatnonzero(new), len(digit)))) if len(digit) else head
    inner = np.unique(np.stack([s.ids[to[~new]], s.ids[doc[~new]]], axis=1), axis=0) if len(digit) else np.zeros((0, 2), np.int64)
    wanted = np.zeros(len(s.ids), bool)
    wanted[doc] = True
    sets = [s.tokens[a:e].tobytes() if w else None for a, e, w in zip(s.starts.tolist(), s.ends.tolist(), wanted.tolist(), strict=True)]
    n, m, k = len(s.ids), len(inner), len(head)
    zero = np.zeros(m + k, np.int64)
    return pa.table([np.repeat(np.array([0, 1, 2], np.int32), [n, m, k]),
                     np.concatenate([s.ids, inner[:, 0], digit[new].astype(np.int64)]), np.concatenate([np.zeros(n, np.int64), inner[:, 1], s.ids[head]]),
                     np.concatenate([s.sizes, zero]), np.concatenate([s.key1.view(np.int64), zero]), np.concatenate([s.key2.view(np.int64), zero]),
                     pa.array(sets + [None] * (m + k), pa.binary())], schema=FOUND)


class Tree:
    """Signature tree over sets in order of size: ``levels[0]`` are the sets, each node above has up to FAN children.
    A level holds OR-combined bitmaps, size ranges and the fewest bits of a set below."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(x) for x in sets])
        tokens = np.concatenate(sets)
        bits = np.zeros((len(sets), BITS // 64), _U)
        doc = np.repeat(np.arange(len(sets)), sizes)
        bit = (mix64(tokens) & _U(BITS - 1)).astype(np.int64)
        np.bitwise_or.at(bits, (doc, bit >> 6), _U(1) << (bit & 63).astype(_U))
        fewest = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, fewest)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, few = self.levels[-1]
            at = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(few, at)))

    def children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.levels[level - 1][0])
        k = np.arange(FAN)
        x, y = np.broadcast_arrays((a[:, None] * FAN + k)[:, :, None], (b[:, None] * FAN + k)[:, None, :])
        x, y = x.ravel(), y.ravel()
        keep = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
        return x[keep], y[keep]

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether the greatest possible overlap of the pairs below is enough."""
        bits, lo, hi, few = self.levels[level]
        fits = (den * hi[a] >= num * lo[b]) & (den * hi[b] >= num * lo[a])
        at = np.flatnonzero(fits)
        both = np.bitwise_count(bits[a[at]] & bits[b[at]]).sum(axis=1, dtype=np.int64)
        # a set's bits outside the other side's are at least that many tokens outside it
        most = np.minimum(hi[a[at]] - np.maximum(few[a[at]] - both, 0), hi[b[at]] - np.maximum(few[b[at]] - both, 0))
        least = -(-num * (lo[a[at]] + lo[b[at]]) // (num + den))
        fits[at] = most >= least
        return fits


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def forest(sets: list[np.ndarray], group: np.ndarray, side: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links between sets of different ``group`` (and, with ``side``, of different sides) that join all groups that link."""
    if len(sets) < 2:
        return []
    order = np.lexsort((np.array([int(x[0]) for x in sets], dtype=_U), np.array([len(x) for x in sets])))
    sets, labels = [sets[i] for i in order], group[order]
    side = None if side is None else side[order]
    tree, links = Tree(sets), []
    _, parent = np.unique(labels, return_inverse=True)
    head = list(range(int(parent.max()) + 1))   # union-find over the groups

    def root(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    stack = [(len(tree.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        x, y = tree.children(level, a, b)
        if level == 1:
            roots = np.array([root(i) for i in range(len(head))])[parent]
            keep = roots[x] != roots[y]
            if side is not None:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
        keep = tree.may_link(level - 1, x, y, num, den)
        x, y = x[keep], y[keep]
        if level == 1:
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                p, q = root(int(parent[i])), root(int(parent[j]))
                if p != q:
                    both = overlap(sets[i], sets[j])
                    if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                        head[q] = p
                        links.append((int(order[i]), int(order[j])))
            continue
        far = x != y   # near pairs are taken first: they connect most
        for part in (far, ~far):
            for k in range(0, int(part.sum()), 512):
                stack.append((level - 1, x[part][k:k + 512], y[part][k:k + 512]))
    return links


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def join_group(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links inside each block of a group of rows (block, id, comp, side, tokens)."""
    blocks, ids = np.asarray(table.column("block")), np.asarray(table.column("id"))
    comp, side = np.asarray(table.column("comp")), np.asarray(table.column("side"))
    tokens, out = table.column("tokens"), []
    order = np.lexsort((side, ids, blocks))
    for part in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
        sets = [np.frombuffer(tokens[int(i)].as_py(), _U) for i in part]
        two = len(np.unique(side[part])) > 1
        out += [(int(ids[part[i]]), int(ids[part[j]])) for i, j in forest(sets, comp[part], side[part] if two else None, num, den)]
    return pa.table([np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)], schema=LINKS)


def verified_links(members: DataFrame, num: int, den: int, tile: int = TILE) -> DataFrame:
    """(a, b): links that connect all members (block, id, tokens) of a block that are connected by links."""
    def joined(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).applyInArrow(lambda t: join_group(t.select(["block", "id", "comp", "side", "tokens"]), num, den), "a long, b long")

    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = write_once(members.join(sizes, "block").withColumns({"comp": F.col("id"), "side": F.lit(0)}), "members")
    totals = members.agg(F.count(F.lit(1)), F.max("m")).first()
    n_bins = max(8, -(-totals[0] // tile))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / F.lit(tile)))
    bin_of = F.when(F.col("m") <= tile, F.pmod(F.xxhash64("block"), F.lit(n_bins))).otherwise(
        F.lit(n_bins) + F.pmod(F.xxhash64("block", salt), F.lit(1 << 60)))
    links = write_once(joined(members.withColumn("bin", bin_of), "bin"), "links")
    if (totals[1] or 0) <= tile:
        return links

    def labelled(found: DataFrame) -> DataFrame:
        own = components(found).toDF("id", "label")
        rows = members.where(F.col("m") > tile).drop("comp").join(own, "id", "left")
        return write_once(rows.withColumn("comp", F.coalesce("label", "id")).drop("label"), "labelled")

    # components meet by their smallest documents
    rows = labelled(links)
    reps = rows.where("id = comp")
    count = reps.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / F.lit(tile)))
    links = write_once(links.unionByName(joined(reps.join(count, "block").withColumn("bin", F.xxhash64("block", salt)), "bin")), "links")
    # what is left: pairs of tiles of blocks with several components
    rows = labelled(links)
    several = rows.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("block")
    rows = rows.join(several, "block")
    size = rows.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(size, ["block", "comp"]).withColumn("part", F.when(F.col("c") * 2 >= tile, F.col("comp")))   # null: the small ones
    parts = rows.groupBy("block", "part").agg(F.count(F.lit(1)).alias("t"))
    rows = (rows.join(parts.withColumnRenamed("block", "block_").withColumnRenamed("part", "part_"),
                      (F.col("block") == F.col("block_")) & F.col("part").eqNullSafe(F.col("part_"))).drop("block_", "part_")
            .withColumn("tile", F.xxhash64(F.coalesce("part", F.lit(0)), F.col("part").isNull(), F.pmod(F.xxhash64("id"), F.ceil(F.col("t") / F.lit(tile))))))
    rows = write_once(rows.select("block", "id", "comp", "part", "tile", "tokens"), "tiles")
    tiles = rows.select("block", "tile", "part").distinct()
    pairs = (tiles.toDF("block", "tile", "p").join(tiles.toDF("block", "tile2", "q"), "block").where("tile <= tile2")
             .where(F.col("p").isNull() | F.col("q").isNull() | (F.col("p") != F.col("q")))
             .withColumn("pair", F.xxhash64("block", "tile", "tile2")))
    one = rows.join(pairs.select("block", "tile", "pair"), ["block", "tile"]).withColumn("side", F.lit(0))
    two = (rows.join(pairs.where("tile < tile2").select("block", F.col("tile2").alias("tile"), "pair"), ["block", "tile"])
           .withColumn("side", F.lit(1)))
    return links.unionByName(joined(one.unionByName(two), "pair"))


def jaccard_components(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text",
                       tile: int = TILE, batch_mb: float = BATCH_MB, bucket_mb: float = BUCKET_MB) -> DataFrame:
    """(doc_id, n_shingles, component_id, k1, k2) of every row; (k1, k2) is the key of its set."""
    base, at = isolate(docs)
    batches, buckets = slots(docs, batch_mb), slots(docs, bucket_mb)
    rows = base.select(F.pmod(F.xxhash64(F.lit(4), row_id(at[id_col])), F.lit(batches)).alias("batch"), row_id(at[id_col]).alias("id"),
                       F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).cast("binary").alias("bytes"))

    def load(t: pa.Table) -> Sets:
        return Sets(np.asarray(t.column("id")), t.column("bytes").to_pylist(), words)

    def ask_counts(t: pa.Table) -> pa.Table:
        s = load(t)
        present, cut = ranges(s.short, 32, buckets)
        return pa.table({"bucket": present, "batch": np.full(len(present), t.column("batch")[0].as_py(), np.int64),
                         "hashes": pa.array([pack_sorted(s.short[i:j]) for i, j in pieces(cut)], pa.binary()),
                         "counts": pa.array([s.counts[i:j].tobytes() for i, j in pieces(cut)], pa.binary())})

    def with_prefixes(t: pa.Table, levels: list[bytes]) -> tuple[Sets, list[bytes]]:
        s = load(t)
        cut = ranges(s.short, 32, buckets)[1]
        parts = [from_nibbles(x, j - i) for x, (i, j) in zip(levels, pieces(cut), strict=True)] if len(s.short) else []
        s.prefixes(np.concatenate(parts) if parts else np.zeros(0, np.uint8), num, den)
        return s, levels

    asked = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("digits", pa.binary()), ("tags", pa.binary()), ("shared", pa.binary())])

    def ask_tokens(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return asked.empty_table()
        s, levels = with_prefixes(t, answers_of(answers))
        present, cut = ranges(s.digits, 58, buckets)
        batch, own = t.column("batch")[0].as_py(), b"".join(len(x).to_bytes(8, "little") + x for x in levels)
        return pa.table({"bucket": np.append(present, -1 - batch), "batch": np.full(len(present) + 1, batch, np.int64),
                         "digits": [s.digits[i:j].tobytes() for i, j in pieces(cut)] + [own],
                         "tags": [s.tags[i:j].tobytes() for i, j in pieces(cut)] + [b""],
                         "shared": [np.packbits(s.shared[i:j]).tobytes() for i, j in pieces(cut)] + [b""]}, schema=asked)

    def tell(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return FOUND.empty_table()
        note = next(a for b, a in zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True) if b < 0)
        levels, k = [], 0
        while k < len(note):
            n = int.from_bytes(note[k:k + 8], "little")
            levels.append(note[k + 8:k + 8 + n])
            k += 8 + n
        s, _ = with_prefixes(t, levels)
        cut = ranges(s.digits, 58, buckets)[1]
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=j - i).astype(bool) for x, (i, j) in zip(answers_of(answers), pieces(cut), strict=True)] \
            if len(s.digits) else []
        return found_rows(s, np.concatenate(bits) if bits else np.zeros(0, bool))

    answer = "batch long, bucket long, answer binary"
    levels = (rows.groupBy("batch").applyInArrow(ask_counts, "bucket long, batch long, hashes binary, counts binary")
              .groupBy("bucket").applyInArrow(count_classes, answer))
    opened = (rows.groupBy("batch").cogroup(levels.groupBy("batch"))
              .applyInArrow(ask_tokens, "bucket long, batch long, digits binary, tags binary, shared binary")
              .groupBy("bucket").applyInArrow(open_tokens, answer))
    found = write_once(rows.groupBy("batch").cogroup(opened.groupBy("batch")).applyInArrow(tell, FOUND_SQL), "shingles")

    nodes = found.where("kind = 0").select(F.col("a").alias("id"), "n", "k1", "k2")
    key = ["n", "k1", "k2"]
    classes = write_once(nodes.where("n > 0").groupBy(*key).agg(F.min("id").alias("rep")), "classes")
    copies = nodes.join(classes, key).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    copies = write_once(copies, "copies")
    holders = found.where("kind = 2").select(F.col("a").alias("token"), F.col("b").alias("id"))
    across = (holders.join(holders.groupBy("token").agg(F.min("id").alias("low")), "token").where("id <> low")
              .select(F.col("low").alias("a"), F.col("id").alias("b")))
    candidates = found.where("kind = 1").select("a", "b").unionByName(across).unionByName(copies)
    blocks = components(candidates).toDF("id", "block")
    sets = found.where("kind = 0 and tokens is not null").select(F.col("a").alias("id"), *key, "tokens")
    members = (sets.join(classes.select(F.col("rep").alias("id"), *key), ["id", *key]).join(blocks, "id").select("block", "id", *key, "tokens")
               .dropDuplicates(["id", *key]).select("block", "id", "tokens"))
    links = verified_links(members, num, den, tile).unionByName(copies)
    own = components(links).toDF("id", "component")
    return nodes.join(own, "id", "left").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.coalesce("component", "id") != NULL_ID, F.coalesce("component", "id")).alias("component_id"), "k1", "k2")


def query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: of its smallest id (rows without one last) the longest text.

    Rows are told apart by 64 bits over id and text, so rows without an id, or of one id, are documents of their own
    and spread over all batches; of rows alike in both, one that all reruns agree on stays.
    """
    base, at = isolate(docs)
    text = F.col(at[text_col]).cast("string")
    keyed = base.withColumn("row", F.xxhash64(F.col(at[id_col]).cast("long"), F.coalesce(text, F.lit("")), text.isNull()))
    found = jaccard_components(keyed.select("row", F.col(at[text_col]).alias("text")), id_col="row", text_col="text", **options)
    component = write_once(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).distinct(), "components")
    rank = F.struct(F.col(at[id_col]).isNull(), F.col(at[id_col]), -F.coalesce(F.octet_length(text), F.lit(-1)), "row")
    kept = (keyed.select("row", rank.alias("rank")).join(component, "row").groupBy("component")
            .agg(F.min("rank").alias("rank")).select("rank.row").distinct())
    met = keyed.join(write_once(kept, "kept"), "row")
    nth = F.row_number().over(Window.partitionBy("row").orderBy(F.to_json(F.struct(*base.columns))))
    return restore(met.withColumn("nth", nth).where("nth = 1"), docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 90 * (p.n + q.n - i)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.y) AS component_id
FROM words w JOIN reach r ON r.x = w.doc_id LEFT JOIN sizes s ON s.doc_id = w.doc_id GROUP BY w.doc_id
"""
