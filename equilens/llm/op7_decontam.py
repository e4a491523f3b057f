"""Benchmark decontamination by Wu-Manber search over words.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased. A window is ``n`` consecutive words of an item; an item of fewer
words, but not none, is one window. The symbols of the search are words: a
block is two words (one for one-word windows), the shift table gives how far
the window's end may move on, blocks that end a window lead to a bucket, and
direct comparison confirms each occurrence.

Spark computes the benchmark's distinct windows with their item ids and writes
them once, ordered by a hash. They are taken in slices of about
``SLICE_WINDOWS`` windows by ranges of that hash; the driver fetches one slice
at a time and tasks build its tables, per window length, so what is broadcast
has a bound whatever the benchmark's size. A second slice is a second pass
over the documents, after the first one's hits are written; the passes' hits
are merged per document. Each document is searched whole, alone, in one task.

Defined cases: null and empty text have no words; repeated item texts give
each of their item ids; items without an id are searched like any, and all of
them together count as one item, with no part in the hash of the ids; repeated document rows are each answered; an empty
benchmark or document table gives no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import isolate, restore, row_id, write_once

N = 10
SLICE_WINDOWS = 200_000
#: Values of the hash that orders the windows.
PLACES = 1 << 30
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class WuManber:
    """All occurrences of word windows of one length."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for window, items in windows.items():
            for end in range(self.block - 1, length):
                key = self.key(window, end)
                self.shift[key] = min(self.shift.get(key, self.most), length - 1 - end)
            self.bucket.setdefault(self.key(window, length - 1), []).append((list(window), items))

    def key(self, words, end: int):
        return (words[end - 1], words[end]) if self.block == 2 else words[end]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, item ids) of each occurrence."""
        shift, most, length, two = self.shift.get, self.most, self.length, self.block == 2
        i, n = length - 1, len(words)
        while i < n:
            key = (words[i - 1], words[i]) if two else words[i]
            step = shift(key, most)
            if step:
                i += step
                continue
            start = i - length + 1
            for window, items in self.bucket[key]:
                if words[start] == window[0] and words[start:i + 1] == window:
                    yield start, items
            i += 1


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(length, window, items, nameless, place): the distinct windows with the ids of their items, and whether
    an item without an id holds them; ``place`` is a hash, and the rows are written in its order."""
    def run(batches):
        for b in batches:
            ids, lengths, wins = [], [], []
            for k, (item, text) in enumerate(zip(b.column(0), b.column(1), strict=True), start=1):
                words = words_of(text.as_py())
                length = min(n, len(words))
                own = {b" ".join(words[s:s + length]) for s in range(len(words) - length + 1)} if length else ()
                ids += [item.as_py()] * len(own)
                lengths += [length] * len(own)
                wins += own
                if len(wins) >= 50_000 or k == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(wins, pa.binary())],
                                                     ["item", "length", "window"])
                    ids, lengths, wins = [], [], []

    found = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "item string, length int, window binary")
    return write_once(found.groupBy("length", "window").agg(F.collect_set("item").alias("items"), F.bool_or(F.col("item").isNull()).alias("nameless"))
                      .withColumn("place", F.pmod(F.xxhash64("length", "window"), F.lit(PLACES))).orderBy("place"), "windows")


def slices(benchmark: DataFrame, id_col: str, text_col: str, n: int, most: int) -> list[DataFrame]:
    """The benchmark's distinct windows in parts of about ``most``."""
    windows = windows_of(benchmark, id_col, text_col, n)
    parts = -(-windows.count() // most)
    return [windows.where((F.col("place") >= PLACES * k // parts) & (F.col("place") < PLACES * (k + 1) // parts)) for k in range(parts)]


def fetched(part: DataFrame) -> list[tuple[int, bytes, list]]:
    """The windows of one slice, for the closure that a pass over the documents ships; tasks make their tables of them."""
    return [(r["length"], bytes(r["window"]), [*r["items"], *[None] * r["nameless"]]) for r in part.collect()]


def matchers_of(rows: list[tuple[int, bytes, list]]) -> list[WuManber]:
    by_length: dict[int, dict] = {}
    for length, window, items in rows:
        by_length.setdefault(length, {})[tuple(window.split(b" "))] = items
    return [WuManber(w, k) for k, w in sorted(by_length.items())]


def listed(items: set) -> list:
    """Ids in order; one null at the end stands for all items without an id."""
    return sorted(x for x in items if x is not None) + [None] * (None in items)


def search(words: list[bytes], matchers: list[WuManber]) -> tuple[list[int], set[str]]:
    """Starts of maximal hit runs and their ends, flattened (s0, e0, s1, e1, ...), and the items found."""
    spans, items = [], set()
    for m in matchers:
        for start, found in m.find(words):
            spans.append((start, start + m.length))
            items.update(found)
    runs: list[int] = []
    for s, e in sorted(spans):
        if runs and s <= runs[-1]:
            runs[-1] = max(runs[-1], e)
        else:
            runs += [s, e]
    return runs, items


def _hits(slim: DataFrame, windows: list) -> DataFrame:
    """(doc, version, n_words, runs, items) of each row."""
    def run(batches):
        tables = matchers_of(windows)   # a closure over 1 MB is broadcast by PySpark itself
        for b in batches:
            n_words, runs, items = [], [], []
            for text in b.column(2):
                words = words_of(text.as_py())
                found = search(words, tables)
                n_words.append(len(words))
                runs.append(found[0])
                items.append(listed(found[1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.string()))], ["doc", "version", "n_words", "runs", "items"])

    return slim.mapInArrow(run, "doc long, version long, n_words long, runs array<long>, items array<string>")


def _merged(hits: DataFrame) -> DataFrame:
    """One row for each document row again, from the rows of several slices."""
    def run(batches):
        for b in batches:
            docs = b.to_pylist()
            for d in docs:
                runs: list[int] = []
                for s, e in sorted((r[k], r[k + 1]) for r in d["runs"] for k in range(0, len(r), 2)):
                    if runs and s <= runs[-1]:
                        runs[-1] = max(runs[-1], e)
                    else:
                        runs += [s, e]
                d["runs"], d["items"] = runs, listed({x for r in d["items"] for x in r})
            yield pa.RecordBatch.from_pylist(docs, schema=pa.schema(
                [("doc", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()),
                 ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))]))

    grouped = hits.groupBy("doc", "version", "n_words").agg(F.collect_set("runs").alias("runs"),
                                                           F.collect_set("items").alias("items"))
    return grouped.mapInArrow(run, hits.schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", n: int = N,
              slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """(doc_id, n_words, runs, items): runs are the maximal hit word ranges, items the sorted ids found, then
    a null if an item without an id was. Of several slices each pass is written before the next slice is fetched."""
    base, at = isolate(docs)
    bench, b = isolate(benchmark)
    slim = base.select(row_id(at[id_col]).alias("doc"), F.xxhash64(at[text_col]).alias("version"),
                       F.col(at[text_col]).cast("string"))
    parts = slices(bench, b[item_col], b[item_text], n, slice_windows)
    if len(parts) > 1:
        for k, part in enumerate(parts):
            hits = _hits(slim, fetched(part))
            parts[k] = write_once(hits.where(F.size("runs") > 0) if k else hits, "hits")
        copies = slim.groupBy("doc", "version").agg(F.count(F.lit(1)).cast("int").alias("copies"))
        union = parts[0]
        for p in parts[1:]:
            union = union.unionAll(p)
        hits = (_merged(union).join(copies, ["doc", "version"])
                .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))
    else:
        hits = _hits(slim, fetched(parts[0]) if parts else [])
    doc = F.when(F.col("doc") != -(2 ** 63), F.col("doc"))
    return hits.select(doc.alias("doc_id"), "n_words", "runs", "items")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2 - 1).cast("int")),
                        lambda k: F.element_at("runs", 2 * k + 2) - F.element_at("runs", 2 * k + 1))
    n_hit = F.when(F.size("runs") == 0, F.lit(0).cast("long")).otherwise(
        F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x))
    return find_hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = N,
                  slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """``docs`` without the rows that hold any benchmark window; columns as they were.

    One pass over the rows for each slice: the text column alone goes to
    Python and one boolean comes back. With one slice nothing is shuffled; of
    several, each pass writes the hashes (128 bits) of the texts it finds
    before the next slice is fetched, and those texts go at the end.
    """
    base, at = isolate(docs)
    bench, b = isolate(benchmark)
    text = F.col(at[text_col]).cast("string")

    def clean_by(windows: list) -> Column:
        made = []   # the tables of this task

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            if not made:
                made.append(matchers_of(windows))
            return texts.map(lambda t: not any(True for m in made[0] for _ in m.find(words_of(t)))).astype(bool)

        return clean(text)

    parts = slices(bench, b["item_id"], b["text"], n, slice_windows)
    if len(parts) == 1:
        base = base.where(clean_by(fetched(parts[0])))
    elif parts:
        version = [F.xxhash64(text).alias("v1"), F.xxhash64(F.lit(7), text).alias("v2")]
        dirty = [write_once(base.where(~clean_by(fetched(part))).select(*version).distinct(), "dirty") for part in parts]
        found = write_once(reduce(DataFrame.unionAll, dirty).distinct(), "dirty")
        base = base.select("*", *version).join(found, ["v1", "v2"], "left_anti")
    return restore(base, docs.columns)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, s, s + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, k, s, list_slice(w, s, s + k - 1) AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT g.doc_id, g.k, g.s, i.item_id FROM grams g JOIN windows i ON g.k = i.k AND g.win = i.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT doc_id, k, s FROM found)) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, h.doc_id IS NOT NULL AS contaminated
FROM words w LEFT JOIN hit h USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""
