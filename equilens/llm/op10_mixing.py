"""Mixing sources to target weights by pivotal dependent rounding.

A source's target words over its size is the copy number of each of its
documents: a whole part and a fraction p. Pivotal rounding decides who gets
the extra copy: two units with fractions trade words - what one loses, the
other gains - in a random direction, with probabilities that leave each
expectation unchanged, until one of them is 0 or 1. A source's taken words
thus stay at its target, up to the one unit left over at the end.

Distribution: the documents of a source are dealt by hash to chunks of about
``CHUNK`` rows, so a source with a third of all documents is many chunks; each
chunk ends with at most one open unit, and the open units go up a reduction
tree of fan-in ``FAN`` until one per source is left, which a seeded draw
decides. Every order and draw comes from hashes of the data: reruns agree.

Defined cases: null text and white space have size 0 and nothing is taken of
them; a null source is a source of its own, last in order; sources of size 0
have target 0; rows that repeat an id are separate units; an empty table gives
an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, isolate, row_id, write_once

WEIGHTS, MOST_COPIES = (5.0, 2.0, 1.0), 3.0
CHUNK, FAN, SEED = 2_000, 256, 17
_TOL = 1e-12


def sized(docs: DataFrame, text_col: str) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("size", words.cast("long"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` 0, 1, ... by code point, null last: a distributed
    sort, a count per partition, and the offsets of the partitions."""
    keyed = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    keyed = write_once(keyed, "sources")
    part = F.shiftrightunsigned("place", 33)
    counts = keyed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offset, at = F.lit(0).cast("long"), 0
    starts = []
    for r in counts:   # one row for each partition of the sort
        starts.append((r["part"], at))
        at += r["n"]
    if starts:
        table = sources.sparkSession.createDataFrame(starts, "part long, start long")
        keyed = keyed.withColumn("part", part).join(table, "part")
        offset = F.col("start")
    rank = offset + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return keyed.withColumn("rank", rank).drop("part", "start", "place")


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target): shares by weight of all words, each held at
    ``most`` times its source's size and the excess reshared until none is above."""
    table = ranked(sources)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", F.when(F.col("source_size") > 0, w).otherwise(F.lit(0.0)))
    cap = F.col("source_size") * F.lit(float(most))
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    # Sources without words count in the first split; what they can't take is reshared at once.
    level, full = 0.0, -1
    while True:   # each pass closes at least one more source; two numbers come back
        above = F.col("weight") * F.lit(level) > cap
        r = table.agg(F.sum(F.when(above, cap).otherwise(F.lit(0.0))).alias("held"),
                      F.sum(F.when(~above, F.col("weight")).otherwise(F.lit(0.0))).alias("open"),
                      F.sum(above.cast("long")).alias("full")).first()
        if not r["open"] or r["full"] == full:
            break
        full, level = r["full"], (total - r["held"]) / r["open"]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight", "rank")


def pivot(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round fractions so that sum(p * size) is kept; at most one stays open."""
    p = p.copy()
    i = -1   # the open unit
    for j in range(len(p)):
        if p[j] <= _TOL or p[j] >= 1 - _TOL:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        si, sj = size[i], size[j]
        to_j, to_i = min(p[i] * si, (1 - p[j]) * sj), min(p[j] * sj, (1 - p[i]) * si)   # words that can move
        if draws[j] * (to_j + to_i) < to_i:   # towards j, with the odds of the other move
            moved, i_closes, i_end, j_end = to_j, p[i] * si <= (1 - p[j]) * sj, 0.0, 1.0
        else:
            moved, i_closes, i_end, j_end = -to_i, (1 - p[i]) * si <= p[j] * sj, 1.0, 0.0
        if i_closes:
            p[i], p[j] = i_end, p[j] + moved / sj
            if _TOL < p[j] < 1 - _TOL:
                i = j
            else:
                p[j], i = round(p[j]), -1
        else:
            p[j], p[i] = j_end, p[i] - moved / si
            if not _TOL < p[i] < 1 - _TOL:
                p[i], i = round(p[i]), -1
    return p


def _round_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "size", "unit"], kind="stable", na_position="last")
    seed = np.random.SeedSequence([SEED, len(pdf), int(pdf["order"].iloc[0]) & (2 ** 63 - 1)])
    draws = np.random.default_rng(seed).random(len(pdf))
    p = pivot(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), draws)
    return pdf.assign(p=p)


def round_units(units: DataFrame, most_docs: int, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``units`` (…, source, chunk, order, doc_id, size, p) with every p 0 or 1."""
    schema = units.schema
    rounded = write_once(units.groupBy("source", "chunk").applyInPandas(_round_chunk, schema), "mix")
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    done, parts = rounded.where(~is_open), -(-most_docs // chunk)
    rest = rounded.where(is_open)
    while parts > 1:   # the tree over the open units, one level at a time
        parts = -(-parts // fan)
        up = rest.withColumn("chunk", F.floor(F.col("chunk") / F.lit(fan)).cast("long"))
        up = write_once(up.groupBy("source", "chunk").applyInPandas(_round_chunk, schema), "mix")
        done, rest = done.unionByName(up.where(~is_open)), up.where(is_open)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "order", "doc_id", "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return done.unionByName(rest.withColumn("p", (draw < F.col("p")).cast("double")))


def plan_copies(rows: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES, chunk: int = CHUNK) -> DataFrame:
    """(unit, doc_id, source, size, source_size, target, copies) of rows (unit, doc_id, source, size)."""
    rows = write_once(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    table = write_once(targets(sources, weights, most), "targets")
    most_docs = table.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    copies = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    order = F.xxhash64(F.lit(SEED), "doc_id", "size", "unit")
    n_chunks = F.ceil(F.col("n_docs") / F.lit(chunk))
    units = (rows.join(table.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
             .withColumns({"copies": copies, "order": order})
             .withColumns({"whole": F.floor("copies").cast("long"), "chunk": F.pmod(F.xxhash64(F.col("order")), n_chunks).cast("long")})
             .withColumn("p", F.when(F.col("size") > 0, F.col("copies") - F.col("whole")).otherwise(F.lit(0.0)))
             .drop("copies", "n_docs"))
    rounded = round_units(units, most_docs, chunk)
    return rounded.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("long")).otherwise(F.lit(0).cast("long"))) \
        .drop("whole", "p", "chunk", "order")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    base, at = isolate(docs)
    slim = sized(base.select(row_id(at[id_col]).alias("doc_id"), F.col(at[source_col]).cast("string").alias("source"),
                             F.col(at[text_col]).alias("text")), "text")
    rows = slim.select(F.lit(0).cast("long").alias("unit"), "doc_id", "source", "size")
    return plan_copies(rows, **options).select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, without the rows that get
    no copy. Rows alike in id, text and source are interchangeable units: the n-th of them gets the n-th decision."""
    base, at = isolate(docs)
    keys = {"doc_id": row_id(at[id_col]), "version": F.xxhash64(F.col(at[text_col])),
            "source": F.col(at[source_col]).cast("string")}
    keyed = base.withColumns(keys).withColumn("unit", F.xxhash64("version", "source"))
    rows = sized(keyed.select("unit", "doc_id", "source", F.col(at[text_col]).alias("text")), "text").drop("text")
    plan = (plan_copies(rows, **options).groupBy("doc_id", "unit")
            .agg(F.sort_array(F.collect_list("copies"), asc=False).alias("each"), F.first("size").alias("size"),
                 F.first("source_size").alias("source_size"), F.first("target").alias("target")))
    whole = F.to_json(F.struct(*base.columns))   # rows that differ elsewhere are told apart the same way in every run
    nth = F.row_number().over(Window.partitionBy("doc_id", "unit").orderBy(whole))
    met = keyed.withColumn("nth", nth).drop("version", "source").join(plan, ["doc_id", "unit"])
    met = met.withColumn("copies", F.element_at("each", F.col("nth"))).where(F.col("copies") > 0)
    extra = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": F.col("copies"),
             "taken": F.col("size") * F.col("copies")}
    return met.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)],
                      *[x.alias(c) for c, x in extra.items() if c not in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
