"""Line dedup, native Spark SQL.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with
A-Z lower-cased. Keys of ``min_chars`` code points or more that occur in
``min_docs`` documents or more lose all their lines except those in the
largest id that holds the key.

Plan: (1) every long line becomes a 128-bit key hash with document and
position, written once; (2) the hashes are range-partitioned by (hash,
document), so a hash held by a third of all documents spreads over many
ranges, and each range is sorted by hash, document and position: the first
occurrence of a hash in a document streams out of that order without another
shuffle or sort, and partial counts and maxima of them leave each range; (3) repeated
keys come back to their (document, position) entries and fold into compressed
bitmaps, one (word number, 64 drop bits) entry per non-empty word; (4) the
bitmap meets the text once. No text is shuffled before that last join.

Defined cases: null and empty text are one empty line; a null id is one
document below all others; rows that repeat an id are the same document, each
row is answered; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, isolate, restore, row_id, slots, write_once

MIN_CHARS, MIN_DOCS = 40, 5


def line_entries(docs: DataFrame, doc: Column, text: Column, min_chars: int) -> DataFrame:
    """(doc, version, pos, h1, h2) of each line whose key is long enough; ``version`` tells rows of one id apart."""
    stripped = F.btrim(F.col("line"), F.lit(WHITE))
    return (docs.select(doc.alias("doc"), F.xxhash64(text).alias("version"),
                        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
            .where(F.char_length("line") >= min_chars)
            .select("doc", "version", "pos", stripped.alias("line"))
            .where(F.char_length("line") >= min_chars)
            .select("doc", "version", "pos", ascii_lower(F.col("line")).alias("key"))
            .select("doc", "version", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(7), F.col("key")).alias("h2")))


def first_occurrences(entries: DataFrame, ranges: int) -> DataFrame:
    """(h1, h2, doc): one row of each hash and document, its first position in the sorted ranges.
    Rows of one id are one document."""
    at = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    return (entries.select("h1", "h2", "doc", "pos").repartitionByRange(ranges, "h1", "h2", "doc")
            .sortWithinPartitions("h1", "h2", "doc", "pos")
            .withColumn("nth", F.row_number().over(at)).where("nth = 1").select("h1", "h2", "doc"))


def repeated_keys(entries: DataFrame, min_docs: int, ranges: int) -> DataFrame:
    """(h1, h2, keep): keys held by ``min_docs`` documents, and the one that keeps them."""
    first = first_occurrences(entries, ranges)
    return (first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keep"))
            .where(F.col("n") >= min_docs).select("h1", "h2", "keep"))


def drop_bitmaps(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, version, drop, n_dropped): ``drop`` maps a word number to the 64 drop bits of lines 64w..64w+63."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pos", F.lit(64)).cast("int"))
    words = (entries.join(keys, ["h1", "h2"]).where(F.col("doc") != F.col("keep"))
             .groupBy("doc", "version", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(bit).alias("bits")))
    return words.groupBy("doc", "version").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drop"),
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its text replaced by the kept lines, plus ``n_lines`` and ``n_dropped``."""
    base, at = isolate(docs)
    text = F.coalesce(F.col(at[text_col]), F.lit(""))
    entries = write_once(line_entries(base, row_id(at[id_col]), text, min_chars), "lines")
    drops = drop_bitmaps(entries, repeated_keys(entries, min_docs, slots(entries, 8)))
    joined = (base.withColumns({"doc": row_id(at[id_col]), "version": F.xxhash64(text)})
              .join(drops, ["doc", "version"], "left"))
    lines = F.split(text, "\n", -1)
    word = lambda i: F.coalesce(F.try_element_at("drop", F.shiftright(i, 6)), F.lit(0).cast("long"))
    kept = F.filter(lines, lambda x, i: F.getbit(word(i), F.pmod(i, F.lit(64))) == 0)
    out = joined.withColumns({
        at[text_col]: F.when(F.col("drop").isNull(), F.col(at[text_col])).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce("n_dropped", F.lit(0).cast("long"))})
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)]
    extra = [F.col(c) for c in ("n_lines", "n_dropped") if c not in docs.columns]
    return out.select(*named, *extra)


def stage(docs: DataFrame, **options) -> DataFrame:
    """Pipeline form: the columns of ``docs``, with the text (and ``n_chars``, if there) of the kept lines."""
    out = line_dedup(docs, **options)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    return line_dedup(slim).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keep AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
