"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``PREFIX`` nearest of ``PIVOTS`` pivots, in
order. Inside a shard of the index the vectors are posted in inverted files,
one per pivot, with the place that the pivot has for them. A query reads the
files of its own nearest pivots and adds, for each pivot two vectors share,
PREFIX - max(place, place'): a pair's footrule distance over prefixes is
PREFIX * (PREFIX + 1) minus twice that sum, so the order is the footrule
order. The best ``SHARE`` of a shard (``LEAST`` at least, ties at the cut
included) is reranked by the exact cosine in double precision on the original
vectors; the shards' best meet in a ranking per query.

The pivots are chosen from a bounded sample (``SAMPLE`` vectors by hash),
skipping vectors close to a chosen pivot, so that a dense group does not use
them up. Every vector is indexed. Shards hold about ``SHARD`` vectors and
queries come in blocks of about ``BLOCK``, so memory has a bound whatever the
table's size, and no vector value can make a shard larger than others.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another dimension than the most
frequent one; rows that repeat an id are different rows, each a candidate for
the other; equal scores rank by smaller id; fewer candidates than ``k`` give
all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, isolate, row_id, write_once

PIVOTS, PREFIX, SAMPLE, APART = 256, 64, 4096, 0.8
SHARD, BLOCK, SHARE, LEAST = 8192, 1024, 0.08, 256
EVERY, K = 50, 5


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, nth, vec): vectors that take part, as doubles; ``nth`` tells rows of one id apart. Where
    squares come near under- or overflow a vector is divided by a power of two near its largest component, which leaves cosines as they are."""
    base, at = isolate(vectors)
    vec = F.col(at[vec_col]).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)
    rows = base.where(F.col(at[vec_col]).isNotNull() & fine).select(row_id(at[id_col]).alias("id"), vec.alias("vec"), squares.alias("sq"))
    far = (F.col("sq") > 1e200) | (F.col("sq") < 1e-200)   # only these cost a second look
    most = F.array_max(F.transform("vec", F.abs))
    rows = rows.where(~far | (most > 0)).withColumn("scale", F.when(far, F.pow(F.lit(2.0), F.floor(F.log2(most)))))
    rows = rows.select("id", F.when(F.col("scale").isNull(), F.col("vec")).otherwise(F.transform("vec", lambda x: x / F.col("scale"))).alias("vec"))
    dims = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("vec")))
    return rows.where(F.size("vec") == (dims["d"] if dims else 0)).withColumn("nth", nth)


def choose_pivots(sample: np.ndarray, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors in sample order, each less than ``apart`` in cosine from those before, filled up if too few."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(unit)):
        if not chosen or (unit[chosen] @ unit[i]).max() < apart:
            chosen.append(i)
            if len(chosen) == most:
                break
    if len(chosen) < min(most, len(unit)):
        rest = [i for i in range(len(unit)) if i not in set(chosen)]
        chosen += rest[:most - len(chosen)]
    return unit[chosen]


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each row, nearest first."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


def inverted_files(perm: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, start): postings by pivot; those of pivot p are start[p]:start[p + 1]."""
    n, prefix = perm.shape
    flat = perm.ravel()
    order = np.argsort(flat, kind="stable")
    start = np.searchsorted(flat[order], np.arange(pivots + 1))
    return (order // prefix).astype(np.int32), (order % prefix).astype(np.int16), start


def search_shard(ids, nth, x, files, queries, q_ids, q_nth, pivots, prefix, share, least, k):
    """The k best of a shard for each query: lists of query place, id and score."""
    row, place, start = files
    n = len(x)
    norm = np.sqrt((x * x).sum(axis=1))
    keep = min(n, max(least, int(np.ceil(share * n)))) + 1   # the query's own row may be among them
    q_perm = permutations(queries, pivots, prefix)
    out_q, out_id, out_score = [], [], []
    for i, q in enumerate(queries):
        lists = [slice(start[p], start[p + 1]) for p in q_perm[i]]
        rows = np.concatenate([row[s] for s in lists])
        gain = np.concatenate([prefix - np.maximum(place[s], a) for a, s in enumerate(lists)])
        near = np.bincount(rows, gain, n)
        cand = np.arange(n) if keep >= n else np.flatnonzero(near >= np.partition(near, n - keep)[n - keep])
        cand = cand[~((ids[cand] == q_ids[i]) & (nth[cand] == q_nth[i]))]
        score = (x[cand] * q).sum(axis=1) / (norm[cand] * np.sqrt((q * q).sum()))
        best = np.lexsort((ids[cand], -score))[:k]
        out_q += [i] * len(best)
        out_id.append(ids[cand[best]])
        out_score.append(score[best])
    return np.array(out_q, np.int64), np.concatenate(out_id), np.concatenate(out_score)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K,
            pivots: int = PIVOTS, prefix: int = PREFIX, shard: int = SHARD, block: int = BLOCK, share: float = SHARE,
            least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id divides by ``every``."""
    rows = write_once(usable(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(6), "id", "nth"), "id", "nth").limit(SAMPLE).select("vec").collect()
    dims = len(sample[0]["vec"]) if sample else 1
    table = choose_pivots(np.array([r["vec"] for r in sample], float).reshape(-1, dims), pivots)
    prefix = min(prefix, len(table))
    shards, is_query = max(1, -(-n // shard)), (F.col("id") != NULL_ID) & (F.pmod("id", F.lit(every)) == 0)
    blocks = max(1, -(-rows.where(is_query).count() // block))

    def matrix(column) -> np.ndarray:
        return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, dims)

    def index(group: pa.Table) -> pa.Table:
        x = matrix(group.column("vec"))
        row, place, start = inverted_files(permutations(x, table, prefix), len(table))
        parts = [np.asarray(group.column("id")), np.asarray(group.column("nth"), np.int32), x, row, place, start.astype(np.int64)]
        return pa.table({"shard": [group.column("shard")[0].as_py()]} | {c: [np.ascontiguousarray(p).tobytes()] for c, p in zip(
            ("ids", "nths", "x", "row", "place", "start"), parts, strict=True)},
            schema=pa.schema([("shard", pa.int64())] + [(c, pa.binary()) for c in ("ids", "nths", "x", "row", "place", "start")]))

    files = write_once(rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(61), "id", "nth"), F.lit(shards)))
                       .groupBy("shard").applyInArrow(index, "shard long, ids binary, nths binary, x binary, row binary, place binary, start binary"),
                       "permutations")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        got = pa.schema([("query_id", pa.int64()), ("nth", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return got.empty_table()
        b = {c: left.column(c)[0].as_py() for c in ("ids", "nths", "x", "row", "place", "start")}
        q_ids, q_nth = np.asarray(right.column("id")), np.asarray(right.column("nth"))
        x = np.frombuffer(b["x"]).reshape(-1, dims)
        q, ids, score = search_shard(
            np.frombuffer(b["ids"], np.int64), np.frombuffer(b["nths"], np.int32), x,
            (np.frombuffer(b["row"], np.int32), np.frombuffer(b["place"], np.int16), np.frombuffer(b["start"], np.int64)),
            matrix(right.column("vec")), q_ids, q_nth, table, prefix, share, least, k)
        return pa.table([q_ids[q], q_nth[q].astype(np.int32), ids, score], schema=got)

    left = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    queries = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit(62), "id", "nth"), F.lit(blocks)))
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search, "query_id long, nth int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score"))


def query(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
