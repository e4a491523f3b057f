"""Exact removal of repeated 50-byte strings by two grouping passes.

Only ``WINDOW`` bytes of a suffix count. No suffix is ordered: a first pass
groups windows by a leading digit, a group that holds one document closes and
goes no further, and a second pass groups the windows of open digits by two
64-bit hashes of all their bytes; its groups are the repeated windows.

Passing every suffix on would move more than eight bytes for each byte of
text. So windows are grouped before they are ordered: the leading digit of a
window is its least ``GRAM``-byte string by hash. Equal windows have equal
least strings, and neighbouring windows mostly share theirs, which makes one
entry for about eighteen windows. The passes:

1. each batch of documents sends its distinct leading digits to buckets by
   their top bits (the radix split); a bucket sorts them and answers which are
   held by two documents or more;
2. windows of open digits go on, one entry for a run of windows with the bytes
   they cover, once for each distinct run of a batch; the bucket groups them
   by two 64-bit hashes of the whole window and answers, per window, whether a smaller document
   holds it. Only the smallest document of equal runs asks; later ones are
   covered whole.

Batches are hashes of the document id and answers come back as bits, so every
group has a bounded size: a passage in a third of all documents is one entry
per batch. The text is shuffled once; all three readings reuse that exchange.
Window groups are compared by two independent 64-bit hashes inside a 58-bit
digit.

Defined cases: null and empty texts have no bytes; a null id sorts below all;
rows that repeat an id are the same document (they don't remove each other);
windows never cross documents; texts shorter than a window stay whole. A very
long text is worked on in slices that overlap by a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, isolate, mix64, row_id, slots, value_ranges

WINDOW, GRAM, SLICE = 50, 16, 1 << 18
BATCH_MB, BUCKET_MB = 3, 2
#: Windows that a bucket orders at once; a digit's entries (one per batch at most, and distinct run) stay together.
AT_ONCE = 200_000
_U = np.uint64


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, and powers of an odd base and of its inverse modulo 2^64, for slices and their overlap."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62)) * 2 + 1
    inverse = pow(base, -1, 1 << 64)
    powers = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(SLICE + 256, b, _U)])) for b in (base, inverse)]
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1), *powers


class Hashes:
    """Polynomial hashes of all strings of one width in a piece of at most SLICE + 256 bytes."""

    def __init__(self, seed: int):
        self.value, self.power, self.inverse = _tables(seed)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.value[data] * self.power[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, stop) -> np.ndarray:
        return mix64((sums[stop] - sums[start]) * self.inverse[start])

    def all(self, data: np.ndarray, width: int) -> np.ndarray:
        s = self.sums(data)
        n = len(data) - width + 1
        return mix64((s[width:] - s[:n]) * self.inverse[:n])


def least(h: np.ndarray, count: int) -> np.ndarray:
    """Minimum of each run of ``count`` neighbours (sliding)."""
    width = 1
    while width * 2 <= count:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return h if width == count else np.minimum(h[:len(h) - (count - width)], h[count - width:])


def window_runs(data: np.ndarray, valid: np.ndarray, hashes: Hashes, window: int, gram: int):
    """(digit, first, last) of runs of windows with one leading digit at one place: windows first..last.
    ``valid`` marks the starts of windows that lie inside a document."""
    out = []
    per = window - gram + 1
    low, six = _U(63), _U(6)
    for a in range(0, len(valid), SLICE):
        piece = data[a:a + SLICE + window - 1]
        ok = valid[a:a + SLICE]
        ok = ok[:max(0, len(piece) - window + 1)]
        if not ok.any():
            continue
        h = hashes.all(piece, gram)
        place = np.arange(len(h), dtype=_U)
        m = least((h & ~low) | (place & low), per)[:len(ok)]
        at = place[:len(m)] + ((m - place[:len(m)]) & low)   # where the least string of the window begins
        at = np.where(ok, at.astype(np.int64), -1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        keep = at[first] >= 0
        first, last = first[keep], last[keep]
        out.append((m[first] >> six, first + a, last + a))
    if not out:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Batch:
    """The documents of one batch laid end to end, and their runs of windows."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, gram: int):
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))   # rows of a group come in any order
        self.window, self.order = window, order
        self.ids = np.asarray(ids, np.int64)[order]
        raw = [texts[i] for i in order]
        self.ends = np.cumsum([len(t) for t in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if raw else self.ends
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        valid = np.ones(len(self.data), bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            valid[max(s, e - window + 1):e] = False
        self.digit, self.first, self.last = window_runs(self.data, valid, Hashes(1), window, gram)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, side="right")]
        # distinct digits, and whether two documents of the batch hold one
        self.kinds, self.kind = np.unique(self.digit, return_inverse=True)
        low, high = np.full(len(self.kinds), np.iinfo(np.int64).max), np.full(len(self.kinds), np.iinfo(np.int64).min)
        np.minimum.at(low, self.kind, self.doc)
        np.maximum.at(high, self.kind, self.doc)
        self.shared = low < high

    def entries(self, is_open: np.ndarray) -> None:
        """Distinct runs (digit and covered bytes) among those with an open digit: ``entry`` of each open run,
        and per entry the smallest document, digit, bytes (start and length) in digit order."""
        self.runs = np.flatnonzero(is_open[self.kind])
        first, last, digit, doc = self.first[self.runs], self.last[self.runs], self.digit[self.runs], self.doc[self.runs]
        hashes, key = Hashes(2), np.empty(len(first), _U)
        piece = first // SLICE
        for k in np.unique(piece):
            mine = piece == k
            base = int(k) * SLICE
            sums = hashes.sums(self.data[base:base + SLICE + 2 * self.window])
            key[mine] = hashes.of(sums, first[mine] - base, last[mine] + self.window - base)
        key = mix64(key ^ ((last - first).astype(_U) * _U(0x9E3779B97F4A7C15)))
        order = np.lexsort((doc, key, digit))
        new = np.ones(len(order), bool)
        new[1:] = (digit[order][1:] != digit[order][:-1]) | (key[order][1:] != key[order][:-1])
        head = order[new]
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.e_digit, self.e_doc, self.e_start = digit[head], doc[head], first[head]
        self.e_count = (last - first + 1)[head]   # windows

    def removed(self, masks: np.ndarray) -> np.ndarray:
        """Which bytes go, from the answered window bits of the entries."""
        full = (_U(1) << self.e_count.astype(_U)) - _U(1)
        bits = np.where(self.doc[self.runs] == self.e_doc[self.entry], masks[self.entry], full[self.entry])
        edge = np.zeros(len(self.data) + 1, np.int32)
        hit = np.flatnonzero(bits)
        first, bits = self.first[self.runs][hit], bits[hit]
        whole = bits == full[self.entry][hit]
        stop = self.last[self.runs][hit] + self.window
        np.add.at(edge, first[whole], 1)
        np.add.at(edge, stop[whole], -1)
        first, bits = first[~whole], bits[~whole]
        for j in range(int(self.e_count.max()) if len(first) else 0):
            at = first[(bits >> _U(j)) & _U(1) == 1] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def bucket_bounds(digits: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets present, bounds) of sorted digits, split by their top bits into equal ranges."""
    b = (digits >> _U(26)) * _U(buckets) >> _U(32)   # 32 leading bits of 58
    present, start = np.unique(b, return_index=True)
    return present.astype(np.int64), np.append(start, len(digits))


def open_digits(table: pa.Table) -> pa.Table:
    """Bucket side of pass 1: which digits occur in two documents or more."""
    parts = [np.frombuffer(x.as_py(), _U) for x in table.column("digits")]
    shared = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool)
              for x, p in zip(table.column("shared"), parts, strict=True)]
    answer = [np.empty(len(p), bool) for p in parts]
    for cut in value_ranges(parts):
        digits, mark = (np.concatenate([x[a:b] for x, (a, b) in zip(xs, cut, strict=True)]) for xs in (parts, shared))
        order = np.argsort(digits, kind="stable")
        d = digits[order]
        start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        sizes = np.diff(np.append(start, len(d)))
        own = np.empty(len(d), bool)
        own[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(mark[order], start), sizes)
        k = 0
        for x, (a, b) in zip(answer, cut, strict=True):
            x[a:b] = own[k:k + b - a]
            k += b - a
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"),
                     "answer": pa.array([np.packbits(x).tobytes() for x in answer], pa.binary())})


def covered_windows(table: pa.Table, window: int) -> pa.Table:
    """Bucket side of pass 2: for every entry, the bits of its windows that a smaller document holds.
    A bucket below 0 is a batch's note to itself (its open digits) and goes back as it is."""
    if table.column("bucket")[0].as_py() < 0:
        return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": table.column("digits")})
    get = lambda c, t: [np.frombuffer(x.as_py(), t) for x in table.column(c)]
    digits = get("digits", _U)
    lengths = [len(x) for x in digits]
    digit, doc, count = np.concatenate(digits), np.concatenate(get("docs", np.int64)), np.concatenate(get("counts", np.uint8)).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_py() for x in table.column("bytes")), np.uint8)
    begin = np.cumsum(count + window - 1) - (count + window - 1)
    masks = np.zeros(len(count), _U)
    # some digits at a time, all entries of a digit together
    order = np.argsort(digit, kind="stable")
    total = np.cumsum(count[order])
    last = np.append(digit[order][1:] != digit[order][:-1], True)   # where a digit's entries end
    ends, a = np.flatnonzero(last) + 1, 0
    while a < len(order):
        enough = np.searchsorted(total[ends - 1], (total[a - 1] if a else 0) + AT_ONCE)
        b = int(ends[max(enough - 1, np.searchsorted(ends, a, side="right"))])
        part = order[a:b]
        size = count[part] + window - 1
        piece = data[np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        masks[part] = window_masks(digit[part], doc[part], count[part], piece, window)
        a = b
    cuts = np.cumsum([0] + lengths)
    out = [masks[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": pa.array(out, pa.binary())})


def window_masks(digit: np.ndarray, doc: np.ndarray, count: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """For entries laid end to end in ``data``: bits of the windows that also stand in an entry of a smaller document."""
    begin = np.cumsum(count + window - 1) - (count + window - 1)
    entry = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[entry] + place
    keys = []
    for seed in (2, 3):
        hashes, key = Hashes(seed), np.empty(len(at), _U)
        for a in range(0, len(data), SLICE):
            lo, hi = np.searchsorted(at, [a, a + SLICE])
            if lo < hi:
                sums = hashes.sums(data[a:a + SLICE + window])
                key[lo:hi] = hashes.of(sums, at[lo:hi] - a, at[lo:hi] - a + window)
        keys.append(mix64(key ^ digit[entry] * _U(0x9E3779B97F4A7C15)))
    order = np.argsort(keys[0], kind="stable")
    k0, k1 = keys[0][order], keys[1][order]
    new = np.concatenate([[True], k0[1:] != k0[:-1]])
    if (~new[1:] & (k1[1:] != k1[:-1])).any():   # the first hash met by chance: order by both
        order = np.lexsort((keys[1], keys[0]))
        k0, k1 = keys[0][order], keys[1][order]
        new = np.concatenate([[True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])])
    start = np.flatnonzero(new)
    own = doc[entry[order]]
    smallest = np.repeat(np.minimum.reduceat(own, start), np.diff(np.append(start, len(order))))
    hit = order[smallest < own]
    masks = np.zeros(len(count), _U)
    np.bitwise_or.at(masks, entry[hit], _U(1) << place[hit].astype(_U))
    return masks


def _joined(answers: pa.Table, dtype, lengths: np.ndarray) -> np.ndarray:
    """A batch's answers in bucket order, one value per asked item."""
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist(), strict=True))
    if dtype is bool:
        parts = [np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool) for (_, a), n in zip(rows, lengths, strict=True)]
    else:
        parts = [np.frombuffer(a, dtype) for _, a in rows]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def mark_repeats(docs: DataFrame, finish, schema: str, window: int, gram: int, id_col: str, text_col: str,
                 batch_mb: float = BATCH_MB, bucket_mb: float = BUCKET_MB) -> DataFrame:
    """Rows that ``finish(batch, removed)`` makes for every batch, ``removed`` being one flag per byte."""
    if not 0 < window - gram < 63 or gram < 1:
        raise ValueError("window must be longer than gram by less than 63 bytes")
    base, at = isolate(docs)
    buckets, batches = slots(docs, bucket_mb), slots(docs, batch_mb)
    rows = base.select(F.pmod(F.xxhash64(F.lit(3), row_id(at[id_col])), F.lit(batches)).alias("batch"), row_id(at[id_col]).alias("id"),
                       F.coalesce(F.col(at[text_col]).cast("string"), F.lit("")).cast("binary").alias("bytes"))

    def load(table: pa.Table) -> Batch:
        return Batch(np.asarray(table.column("id")), table.column("bytes").to_pylist(), window, gram)

    def ask_digits(table: pa.Table) -> pa.Table:
        b = load(table)
        present, cut = bucket_bounds(b.kinds, buckets)
        pieces = list(zip(cut, cut[1:], strict=False))
        return pa.table({"bucket": present, "batch": np.full(len(present), table.column("batch")[0].as_py(), np.int64),
                         "digits": pa.array([b.kinds[i:j].tobytes() for i, j in pieces], pa.binary()),
                         "shared": pa.array([np.packbits(b.shared[i:j]).tobytes() for i, j in pieces], pa.binary())})

    def opened(docs_table: pa.Table, is_open) -> Batch:
        b = load(docs_table)
        b.entries(is_open(b))
        return b

    asked = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("digits", pa.binary()), ("docs", pa.binary()),
                       ("counts", pa.binary()), ("bytes", pa.binary())])

    def ask_windows(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return asked.empty_table()
        flags = []

        def is_open(b: Batch) -> np.ndarray:
            flags.append(_joined(answers, bool, np.diff(bucket_bounds(b.kinds, buckets)[1])))
            return flags[0]

        b, batch = opened(docs_table, is_open), docs_table.column("batch")[0].as_py()
        present, cut = bucket_bounds(b.e_digit, buckets)
        pieces = list(zip(cut, cut[1:], strict=False))
        data, stop = memoryview(b.data), b.e_start + b.e_count + window - 1   # slices of it are no copies
        covered = [b"".join([data[s:e] for s, e in zip(b.e_start[i:j].tolist(), stop[i:j].tolist(), strict=True)]) for i, j in pieces]
        note = np.packbits(flags[0]).tobytes()
        return pa.table({"bucket": np.append(present, -1 - batch), "batch": np.full(len(present) + 1, batch, np.int64),
                         "digits": [b.e_digit[i:j].tobytes() for i, j in pieces] + [note],
                         "docs": [b.e_doc[i:j].tobytes() for i, j in pieces] + [b""],
                         "counts": [b.e_count[i:j].astype(np.uint8).tobytes() for i, j in pieces] + [b""],
                         "bytes": covered + [b""]}, schema=asked)

    def close(docs_table: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_table.num_rows:
            return finish(None, None)
        own = pa.compute.less(answers.column("bucket"), 0)
        note = np.frombuffer(answers.filter(own).column("answer")[0].as_py(), np.uint8)
        b = opened(docs_table, lambda b: np.unpackbits(note, count=len(b.kinds)).astype(bool))
        return finish(b, b.removed(_joined(answers.filter(pa.compute.invert(own)), _U, None)))

    answer = "batch long, bucket long, answer binary"
    one = (rows.groupBy("batch").applyInArrow(ask_digits, "bucket long, batch long, digits binary, shared binary")
           .groupBy("bucket").applyInArrow(open_digits, answer))
    two = (rows.groupBy("batch").cogroup(one.groupBy("batch"))
           .applyInArrow(ask_windows, "bucket long, batch long, digits binary, docs binary, counts binary, bytes binary")
           .groupBy("bucket").applyInArrow(lambda t: covered_windows(t, window), answer))
    return rows.groupBy("batch").cogroup(two.groupBy("batch")).applyInArrow(close, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
            texts: bool = False, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    got = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts)

    def finish(b: Batch | None, removed) -> pa.Table:
        if b is None:
            return got.empty_table()
        rows = []
        for i, s, e in zip(b.ids.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True):
            gone = removed[s:e]
            n = int(np.count_nonzero(gone))
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
            kept = (b.data[s:e][~gone] if n else b.data[s:e]).tobytes()
            rows.append((None if i == NULL_ID else i, e - s, n, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if texts else ()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), got, strict=True)], schema=got)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return mark_repeats(docs, finish, schema, window, gram, id_col, text_col, **options)


def query(docs: DataFrame) -> DataFrame:
    return repeats(docs)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, s, hash(substr(h, 2 * s - 1, 100)) AS a, md5_number_lower(substr(h, 2 * s - 1, 100)) AS b
  FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS s FROM d WHERE n >= 50)
), m AS (
  SELECT a, b, min(doc_id) AS first FROM w GROUP BY a, b HAVING count(DISTINCT doc_id) > 1
), hit AS (
  SELECT w.doc_id, w.s FROM w JOIN m USING (a, b) WHERE w.doc_id > m.first
), islands AS (
  SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 1 ELSE 0 END AS new FROM hit
), spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 50 AS z
  FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM islands) GROUP BY doc_id, g
), cuts AS (
  SELECT d.doc_id, d.h, d.n, s.a, s.z, lag(s.z, 1, 1) OVER (PARTITION BY d.doc_id ORDER BY s.a) AS prev
  FROM d JOIN spans s USING (doc_id)
), pieces AS (
  SELECT doc_id, prev AS pos, substr(h, 2 * prev - 1, 2 * (a - prev)) AS part FROM cuts
  UNION ALL
  SELECT doc_id, max(z), any_value(substr(h, 2 * z - 1)) FROM (SELECT *, max(z) OVER (PARTITION BY doc_id) AS top FROM cuts)
  WHERE z = top GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(part, '' ORDER BY pos) AS h FROM pieces GROUP BY doc_id
), tally AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN tally t USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
