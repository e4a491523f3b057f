"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

A document's set holds the hashes of its distinct word n-grams (with fewer
words, of the whole sequence; without words it is empty). Two documents link
when den * |x & y| >= num * |x | y|; groups are the connected components.

1. Signatures. Each element draws a random rank and a random slot in each
   round, its slots forming a permutation (Fisher-Yates); in round j its value
   is j + rank, and a slot keeps the least value. So every element enters
   every slot once and ranks of one element are correlated, which lowers the
   variance against independent hashes. A document stops as soon as its
   largest slot is below the round: long sets need one or two rounds.
2. Equal sets are one node, named by 128 bits over the set and its size.
3. Banding. ``BANDS`` keys of ``ROWS`` slots each; nodes that share a key are
   candidates. At the least similarity that links (0.85) a pair shares no key
   with a chance of (1 - 0.85^5)^24 = 8e-7; every other step is exact.
4. Verification. In every bucket one node is the centre and is compared, on
   full sets, with all others; then it leaves the bucket. Buckets whose other
   nodes are connected are done. Of the rest, ranges of sizes are cut by hash
   into tiles of ``TILE_WEIGHT`` shingles; pairs of tiles whose sizes allow a
   link are each compared in a task. No step makes all pairs of a bucket as
   rows and none is left out.
5. Union-find in every partition of the links leaves a forest; forests are
   joined by contraction (``graph.components``).

A centre's partners are salted into parts of ``PARTNERS``; copies meet only in
partial aggregates.

Defined cases: null and empty texts have n_shingles 0 and are a component of
their own; component_id is the smallest id that is not null, null if there is
none; rows that repeat an id are separate rows, each kept if its id is the
component's (null equal to null); an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import isolate, mix64, write_once
from .graph import components
from .op4_jaccard_join import group_sums, shingle_sets

WORDS, NUM, DEN = 3, 85, 100
#: Slots of a signature: BANDS keys of ROWS slots.
BANDS, ROWS = 24, 5
#: Shingles in a tile; partners of a centre in one part.
TILE_WEIGHT, PARTNERS = 1 << 18, 256
#: Text in a slice that is worked on at once, and elements that draw at once.
SLICE_BYTES, AT_ONCE = 4 << 20, 1 << 17
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_RANK = _U(56)   # bits of a rank, below the round


def superminhash(tokens: np.ndarray, ends: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots) of sets that stand one after the other. Unset slots of empty sets are the largest value."""
    docs = len(ends)
    least = np.full(docs * slots, np.iinfo(np.uint64).max)
    owner = np.repeat(np.arange(docs), np.diff(ends, prepend=0))
    for a in range(0, len(tokens), AT_ONCE):
        x, doc = tokens[a:a + AT_ONCE], owner[a:a + AT_ONCE]
        order = None   # each element's slots, permuted as far as drawn
        for j in range(slots):
            draw = mix64(x + _U((j + 1) * int(_GOLD) % (1 << 64)))
            pick = (j + (((draw & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32))).astype(np.int64)
            if j == 0:
                slot = pick
            else:
                at = np.arange(len(x))
                slot = order[at, pick].astype(np.int64)
                order[at, pick] = order[:, j]
                order[:, j] = slot
            np.minimum.at(least, doc * slots + slot, (_U(j) << _RANK) | (mix64(draw) >> (_U(64) - _RANK)))
            if j + 1 == slots:
                break
            here = np.unique(doc)
            on = np.zeros(docs, bool)
            on[here] = least.reshape(docs, slots)[here].max(axis=1) >= _U(j + 1) << _RANK
            go = on[doc]
            if not go.any():
                break
            if j == 0:
                order = np.tile(np.arange(slots, dtype=np.uint16), (int(go.sum()), 1))
                first = pick[go]
                order[np.arange(len(first)), first] = 0
                order[:, 0] = first
            elif not go.all():
                order = order[go]
            x, doc = x[go], doc[go]
    return least.reshape(docs, slots)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents x bands) keys; the band takes part, so that keys of different bands differ."""
    key = np.repeat((np.arange(bands, dtype=np.uint64) * _GOLD)[None], len(signatures), axis=0)
    parts = signatures.reshape(len(signatures), bands, rows)
    for r in range(rows):
        key = mix64(key + parts[:, :, r] * _GOLD + _U(r))
    return key.view(np.int64)


def text_slices(batch: pa.RecordBatch, column: int):
    """(slice, texts) of at most ``SLICE_BYTES`` of text, or one row."""
    texts, begin, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        raw = (t.as_py() or "").encode()
        if texts and size + len(raw) > SLICE_BYTES:
            yield batch.slice(begin, i - begin), texts
            texts, begin, size = [], i, 0
        texts.append(raw)
        size += len(raw)
    if texts:
        yield batch.slice(begin), texts


def _nodes(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(ends, prepend=0).astype(np.uint64)
    return (mix64(group_sums(mix64(tokens), ends) + n).view(np.int64), mix64(group_sums(mix64(tokens ^ _GOLD), ends) ^ n).view(np.int64))


def scanned(slim: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc, t1, t2, n, k1, k2, keys) of every row of (doc, t1, t2, text)."""
    def run(batches):
        for b in batches:
            for part, texts in text_slices(b, 3):
                tokens, ends = shingle_sets(texts, words)
                n = np.diff(ends, prepend=0)
                k1, k2 = _nodes(tokens, ends)
                keys = band_keys(superminhash(tokens, ends, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), lists],
                                                 names=["doc", "t1", "t2", "n", "k1", "k2", "keys"])

    return slim.mapInArrow(run, "doc long, t1 long, t2 long, n long, k1 long, k2 long, keys array<long>")


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens) of (text); a row for each text."""
    def run(batches):
        for b in batches:
            for _, raws in text_slices(b, 0):
                tokens, ends = shingle_sets(raws, words)
                k1, k2 = _nodes(tokens, ends)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(np.diff(ends, prepend=0), pa.int64()), lists], names=["k1", "k2", "n", "tokens"])

    return texts.mapInArrow(run, "k1 long, k2 long, n long, tokens array<long>").select(_node(), "n", "tokens")


def _node():
    return F.struct("k1", "k2").alias("node")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (node, centre) that link, on their full sets. Centres with many partners get a copy of their set for each part."""
    hot = write_once(pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")).where("parts > 1"), "hot")
    part = F.coalesce(F.pmod(F.hash("node"), F.col("parts")), F.lit(0))
    left = (pairs.join(sets.select("node", F.col("n").alias("n1"), F.col("tokens").alias("x")), "node")
            .join(hot, "centre", "left").withColumn("salt", part).drop("parts"))
    right = (sets.select(F.col("node").alias("centre"), F.col("n").alias("n2"), F.col("tokens").alias("y")).join(hot, "centre", "left")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts"))
    same = F.size(F.array_intersect("x", "y")).cast("long")
    return (left.join(right, ["centre", "salt"]).withColumn("same", same)
            .where(F.col("same") * (num + den) >= num * (F.col("n1") + F.col("n2")))
            .select(F.col("node").alias("a"), F.col("centre").alias("b")))


class Union:
    """Union-find over hashable nodes."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def join(self, x, y) -> bool:
        """True if they were apart. The smaller root stays."""
        x, y = sorted((self.find(x), self.find(y)))
        self.up[y] = x
        return x != y


#: Links that one union-find holds before it is emptied; a forest in parts is still one.
HELD = 1 << 18


def forest(links: DataFrame) -> DataFrame:
    """The links that join something new within their partition."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches):
        union = Union()
        for b in batches:
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            if len(union.up) > HELD:
                union = Union()
            new = [union.join(tuple(x.values()), tuple(y.values())) for x, y in zip(a, c, strict=True)]
            yield b.filter(pa.array(new, pa.bool_()))

    return links.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def tile_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between components of the members (key, node, n, comp) of a bucket, which join them as all links between them do.

    A bucket's tiles are ranges of sizes, cut by hash to about ``TILE_WEIGHT`` shingles.
    """
    sized = members.withColumn("class", F.floor(F.log("n") / math.log(den / num)))
    spans = write_once(sized.groupBy("key", "class").agg(F.min("n").alias("low"), F.max("n").alias("high"),
                                                        F.ceil(F.sum("n") / TILE_WEIGHT).cast("int").alias("parts")), "spans")
    placed = sized.join(spans.select("key", "class", "parts"), ["key", "class"]).withColumn(
        "tile", F.struct("class", F.pmod(F.hash("node"), F.col("parts")).alias("part"))).drop("class", "parts")
    tiles = spans.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.struct("class", "part").alias("tile"), "low", "high")
    first, second = tiles.toDF("key", "i", "low1", "high1"), tiles.toDF("key", "j", "low2", "high2")
    near = (first.join(second, "key").where("i <= j")   # classes follow one another by size
            .where(F.col("high1") * den >= F.col("low2") * num).select("key", "i", "j"))
    ways = near.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    rows = placed.join(ways, ["key", "tile"]).join(sets.drop("n"), "node").select(
        "key", "i", "j", (F.col("tile") == F.col("i")).alias("tile"), "node", "comp", "n", "tokens")

    def run(table: pa.Table) -> pa.Table:
        comps = [tuple(x.values()) for x in table.column("comp").to_pylist()]
        tile, n = np.array(table.column("tile")), np.array(table.column("n"))
        lists = table.column("tokens").combine_chunks()
        tokens, cuts = lists.flatten().to_numpy(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        order = np.argsort(tokens, kind="stable")
        flat, doc = tokens[order], np.repeat(np.arange(len(n)), n)[order]
        union, a, b = Union(), [], []
        cross = tile.min() != tile.max()
        for i in range(len(n)):
            if len({union.find(c) for c in comps}) == 1:
                break
            own = tokens[cuts[i]:cuts[i + 1]]
            low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
            long = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange(int((high - low).sum()))
            same = np.bincount(doc[long], minlength=len(n))
            fit = same * (num + den) >= num * (n + n[i])
            for k in np.flatnonzero(fit & ((tile != tile[i]) if cross else (np.arange(len(n)) > i))).tolist():
                if union.join(comps[i], comps[k]):
                    a.append(comps[i])
                    b.append(comps[k])
        kind = table.schema.field("comp").type
        pairs = [pa.array([dict(zip(("k1", "k2"), x, strict=True)) for x in side], kind) for side in (a, b)]
        return pa.Table.from_arrays(pairs, names=["a", "b"])

    kind = members.schema["node"].dataType.simpleString()
    return rows.groupBy("key", "i", "j").applyInArrow(run, f"a {kind}, b {kind}")


def near_components(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of the nodes with a link, from the buckets (key, node, n)."""
    centres = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c"))
    live = write_once(members.join(centres, "key").where("node <> c.node"), "stars")
    pairs = live.where(F.least("n", "c.n") * den >= F.greatest("n", "c.n") * num).select("node", F.col("c.node").alias("centre")).distinct()
    links = write_once(forest(verified(write_once(pairs, "pairs"), sets, num, den)), "links")
    joined = write_once(components(links), "components")
    rest = write_once(live.select("key", "node", "n").join(joined, "node", "left")
                      .select("key", "node", "n", F.coalesce("component", "node").alias("comp")), "members")
    apart = rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    rest = write_once(rest.join(apart, "key", "left_semi"), "members")
    if rest.isEmpty():
        return joined
    more = components(forest(tile_links(rest, sets, num, den))).toDF("comp", "to")
    nodes = joined.select("node", F.col("component").alias("comp")).unionByName(more.select(F.col("comp").alias("node"), "comp")).distinct()
    return nodes.join(more, "comp", "left").select("node", F.coalesce("to", "comp").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    base, at = isolate(docs)
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    slim = base.select(F.col(at[id_col]).cast("long").alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text"))
    seen = write_once(scanned(slim, words, bands, rows), "signatures")
    keyed = seen.where("n > 0").select(F.explode("keys").alias("key"), "k1", "k2", "n")
    shared = (keyed.groupBy("key").agg(*[f(c).alias(f.__name__ + c) for c in ("k1", "k2") for f in (F.min, F.max)])
              .where("mink1 <> maxk1 OR mink2 <> maxk2").select("key"))
    members = write_once(keyed.join(shared, "key", "left_semi").distinct().select("key", _node(), "n"), "members")
    wanted = members.select("node.k1", "node.k2").distinct()
    # one text for each node: copies of a set may differ in case and white space
    picks = seen.join(wanted, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min(F.struct("t1", "t2")).alias("t")).select("t.t1", "t.t2")
    texts = slim.join(picks, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).select("text")
    sets = write_once(full_sets(texts, words), "sets")
    joined = near_components(members, sets, num, den)
    low = seen.where("n > 0").groupBy("k1", "k2").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("copies")).select(_node(), "low", "copies")
    known = low.join(joined, "node", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    known = write_once(known, "nodes")
    least = known.groupBy("component").agg(F.min("low").alias("component_id"))
    of = known.join(least, "component").select("node.k1", "node.k2", "component_id", F.lit(True).alias("grouped"))
    found = seen.select("doc", "n", "k1", "k2").join(of, ["k1", "k2"], "left")
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                        F.when(F.col("grouped") & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: All pairs that share a shingle, counted exactly; the components by repeated minimum.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + least(3, len(w)) - 1), ' ') || ' ' || least(3, len(w))) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS s FROM w WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
sets AS (
  SELECT min(doc_id) AS rep, list(doc_id) AS docs, n FROM (
    SELECT g.doc_id, s.n, md5(string_agg(g.g, '' ORDER BY g.g)) AS whole FROM grams g JOIN sizes s USING (doc_id) GROUP BY g.doc_id, s.n)
  GROUP BY whole, n
), rg AS (SELECT s.rep, s.n, g.g FROM sets s JOIN grams g ON g.doc_id = s.rep),
ranked AS (
  SELECT r.rep, r.n, r.g, row_number() OVER (PARTITION BY r.rep ORDER BY c.c, r.g) AS k
  FROM rg r JOIN (SELECT g, count(*) AS c FROM rg GROUP BY g) c USING (g)
), pre AS (SELECT rep, n, g FROM ranked WHERE k <= n - CAST(ceil(n * 85 / 100.0) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.g = b.g AND a.rep < b.rep AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85),
links AS (
  SELECT c.a, c.b FROM cand c JOIN rg x ON x.rep = c.a JOIN rg y ON y.rep = c.b AND y.g = x.g
  GROUP BY c.a, c.b, c.na, c.nb HAVING 100 * count(*) >= 85 * (c.na + c.nb - count(*))
), both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
walk(node, low) AS (
  SELECT rep, rep FROM sets
  UNION
  SELECT b.b, w.low FROM walk w JOIN both_ b ON b.a = w.node
), comp AS (SELECT node, min(low) AS component_id FROM walk GROUP BY node),
of AS (SELECT unnest(s.docs) AS doc_id, c.component_id FROM sets s JOIN comp c ON c.node = s.rep)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(o.component_id, w.doc_id) AS component_id,
       w.doc_id IS NOT DISTINCT FROM coalesce(o.component_id, w.doc_id) AS kept
FROM w LEFT JOIN sizes s USING (doc_id) LEFT JOIN of o USING (doc_id)
"""
