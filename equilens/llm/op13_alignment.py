"""Alignment of two tokenizers' tokens, with corpus-wide pair counts by external spill counting.

Every text is encoded by a byte-level BPE (A, given a leading space) and by a
sentencepiece model (B, which adds the space). Byte offsets where tokens of
both end cut the tokens into groups; an A and a B token whose bytes overlap
are linked. A pair of ids counts the documents that hold it linked.

1. Runs. A task cuts texts at single spaces between other characters: neither
   tokenizer's tokens cross such a place, so the units between are encoded
   once and kept in a bounded cache. Between two neighbouring ends of either
   side lies exactly one link. A document's distinct pairs become records
   (pair, document, occurrences); ``RUN_RECORDS`` of them are sorted by radix
   of the A id, then A id, B id and document, and written as zstd blocks: for
   each radix bucket the pairs with the run's counts, and one posting list.
   Runs live in a table in the shared folder; a lost executor repeats a task.
2. Counts. The runs of a bucket are merged through a heap of the ends of
   their current blocks, ``FAN`` runs at a time, level by level, so no task
   reads more than ``FAN`` runs. The order is by A id first, so an A id's
   highest count is known when its last pair has passed.
3. Contributions. The final counts of a bucket meet its runs, again ``FAN`` at
   a time, and each run gets the counts of its own pairs back. A run holds all
   records of its documents, so it alone sums their contributions.

Posting lists are never shuffled by pair: a pair that a third of all documents
hold is one entry in each run.

The A side is encoded by tiktoken over the vocabulary of the JSON file, whose
merges are checked to be in order of id (else, and for units of more than
``LONG`` characters, by the tokenizers library itself).

Defined cases: null and empty texts, and texts that either tokenizer does not
give back byte for byte, have no tokens: zeros and an empty hash; a null id is
returned as null; rows that repeat an id are separate rows and count as
separate documents; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import isolate, write_once
from .op12_superminhash import text_slices

#: Where the vocabulary files are, on every executor, and their names.
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""   # of the byte-level vocabulary
#: Records of a run, radix buckets, runs merged at once, pairs in a block.
RUN_RECORDS, BUCKETS, FAN, BLOCK = 1 << 20, 64, 64, 1 << 16
#: Units that a worker keeps, characters of a unit that is kept, characters that tiktoken gets at once.
UNITS, KEPT, LONG = 100_000, 200, 4000
B_BITS = 16   # of a pair's code, below the A id


def kept_by_worker(name: str, make):
    """One object a Python worker: functions sent to it are made anew for each task."""
    held = sys.modules.setdefault("_alignment_held", types.ModuleType("_alignment_held"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both encoders, and the bytes of every id."""

    def __init__(self, folder: str):
        import sentencepiece
        self.a_path = os.path.join(folder, A_FILE)
        with open(self.a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        table, vocab, merges = byte_of(), model["vocab"], model["merges"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(table[c] for c in piece) if all(c in table for c in piece) else b""
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.in_order = all(vocab[m] == 256 + k for k, m in enumerate(joined))
        self.ranks = {self.a_bytes[vocab[p]]: vocab[p] for p in [*table, *joined]}
        self.fast = self.whole = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # pieces that go on after a space would cross the cuts
        self.cuts = not any(" " in p.replace("▁", " ").lstrip(" ").rstrip(" ") or (p.endswith("▁") and p.strip("▁")) for p in pieces)
        self.a_size = np.array([len(x) for x in self.a_bytes])
        self.b_size = np.array([len(x) for x in self.b_bytes])

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None and self.in_order:
            import tiktoken
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return [self.fast.encode_ordinary(t) if self.fast and len(t) <= LONG else self._library(t) for t in texts]

    def _library(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer
            self.whole = Tokenizer.from_file(self.a_path)
            self.whole.encode_special_tokens = True   # their strings in a text are ordinary text
        return self.whole.encode(text, add_special_tokens=False).ids


class Units:
    """What is known of each unit, by its number."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)      # clean, good, A tokens, B tokens, groups
        self.codes, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        t = self.tokenizers
        a, b = t.encode_a([" " + u for u in new]), t.b.encode(new, num_threads=1)
        raws = [(" " + u).encode() for u in new]
        good = np.array([u != "" and b"".join([t.a_bytes[i] for i in x]) == raw and b"".join([t.b_bytes[i] for i in y]) == raw
                         for u, x, y, raw in zip(new, a, b, raws, strict=True)])
        a = [x if g else [] for x, g in zip(a, good, strict=True)]
        b = [y if g else [] for y, g in zip(b, good, strict=True)]
        x, y = (np.fromiter((i for one in side for i in one), np.int64) for side in (a, b))
        p, q = np.cumsum(t.a_size[x]), np.cumsum(t.b_size[y])
        # units stand one after the other; every end of either side closes one link: that of the tokens that reach it
        ends = np.union1d(p, q)
        i, j = np.searchsorted(p, ends), np.searchsorted(q, ends)
        both = np.flatnonzero((p[i] == ends) & (q[j] == ends)) if len(ends) else np.zeros(0, np.int64)
        over = np.cumsum([len(r) if g else 0 for r, g in zip(raws, good, strict=True)])
        upto = np.searchsorted(ends, over, side="right")          # links up to each unit's end
        grouped = np.searchsorted(ends[both], over, side="right")   # and groups
        sa, sb = list(map(str, x.tolist())), list(map(str, y.tolist()))
        i2, j2 = [0, *(i[both] + 1).tolist()], [0, *(j[both] + 1).tolist()]
        text = [",".join(sa[c:d]) + "|" + ",".join(sb[e:f]) for c, d, e, f in zip(i2, i2[1:], j2, j2[1:], strict=False)]
        self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += [";".join(text[c:d]) for c, d in zip([0, *grouped[:-1].tolist()], grouped.tolist(), strict=True)]
        clean = [u != "" and not u[0].isspace() and not u[-1].isspace() for u in new]
        self.facts = np.concatenate([self.facts, np.column_stack([clean, good, list(map(len, a)), list(map(len, b)), np.diff(grouped, prepend=0)])])
        self.codes = np.concatenate([self.codes, (x[i].astype(np.uint32) << np.uint32(B_BITS)) | y[j].astype(np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + upto])

    def forget(self, texts: list[str]) -> None:
        """Drops the units learnt last."""
        n = len(self.groups) - len(texts)
        for u in texts:
            del self.number[u]
        del self.groups[n:]
        self.facts, self.ends = self.facts[:n], self.ends[:n + 1]
        self.codes = self.codes[:self.ends[-1]]


def units_of(text: str, cuts: bool) -> list[str]:
    """The text cut at each single space between two characters that are no white space."""
    if not cuts:
        return [text]
    out: list[list[str]] = []
    before = ""
    for k, part in enumerate(text.split(" ")):
        if k and before and not before[-1].isspace() and part and not part[0].isspace():
            out.append([part])
        elif k:
            out[-1].append(part)
        else:
            out.append([part])
        before = part
    return [" ".join(x) for x in out]


def align_slice(texts: list[str | None], units: Units):
    """(facts of each text: A tokens, B tokens, groups, links), hashes, group strings by text, records (text, code, times)."""
    split = [t.split(" ") if t and units.tokenizers.cuts else [t or ""] for t in texts]
    if len(units.number) > UNITS:
        units.clear()
    units.learn(list({p for parts in split for p in parts if p not in units.number and len(p) <= KEPT}))
    long: dict[str, None] = {}
    for k, parts in enumerate(split):   # a cut next to white space is none
        known = [units.number.get(p) for p in parts]
        if None in known or not units.facts[known, 0].all():
            split[k] = units_of(texts[k] or "", units.tokenizers.cuts)
            long |= dict.fromkeys(p for p in split[k] if p not in units.number)
    units.learn(list(long))
    number = np.array([units.number[p] for parts in split for p in parts], np.int64)
    size = np.array([len(parts) for parts in split])
    doc = np.repeat(np.arange(len(texts)), size)
    first = np.cumsum(size) - size
    facts = units.facts[number]
    links = units.ends[number + 1] - units.ends[number]
    good = (np.minimum.reduceat(facts[:, 1], first) > 0)
    sums = np.add.reduceat(np.column_stack([facts[:, 2:], links]), first, axis=0) * good[:, None]
    at, strings = 0, []
    for n, fine in zip(size.tolist(), good.tolist(), strict=True):
        strings.append(";".join([units.groups[u] for u in number[at:at + n].tolist()]) if fine else "")
        at += n
    # distinct units of a text, then their links, then distinct links of a text
    key, times = np.unique((doc[good[doc]] << 32) | number[good[doc]], return_counts=True)
    unit, owner = key & 0xFFFFFFFF, key >> 32
    many = units.ends[unit + 1] - units.ends[unit]
    place = np.repeat(units.ends[unit] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    link = (np.repeat(owner, many) << 32) | units.codes[place].astype(np.int64)
    order = np.argsort(link, kind="stable")
    link, times = link[order], np.repeat(times, many)[order]
    start = np.flatnonzero(np.diff(link, prepend=-1))
    times = np.add.reduceat(times, start) if len(start) else times
    units.forget(list(long))   # of any length: not kept
    return sums, strings, (link[start] >> 32, (link[start] & 0xFFFFFFFF).astype(np.uint32), times)


def packed(*arrays: np.ndarray) -> bytes:
    """A zstd block of equally long arrays, each in its smallest unsigned type."""
    out = [len(arrays[0]).to_bytes(8, "little")]
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        out += [bytes([kind.itemsize]), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        kind = np.dtype(f"u{raw[at]}")
        out.append(np.frombuffer(raw, kind, n, at + 1).astype(np.int64))
        at += 1 + n * kind.itemsize
    return out


def pair_blocks(codes: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Ascending codes, stored as differences within each block, beside other arrays."""
    return [packed(np.diff(codes[k:k + BLOCK].astype(np.int64), prepend=0), *[m[k:k + BLOCK] for m in more])
            for k in range(0, len(codes), BLOCK)]


def read_pairs(blocks: list[bytes]):
    for block in blocks:
        step, *more = unpacked(block)
        yield (np.cumsum(step), *more)


def heap_merge(runs: list[list[bytes]]):
    """(codes, counts) of all runs in order, equal codes summed; a block of each run is held at a time."""
    readers = [read_pairs(r) for r in runs]
    now: list = [next(r, None) for r in readers]
    heap = [(int(x[0][-1]), k) for k, x in enumerate(now) if x is not None]
    heapq.heapify(heap)
    while heap:
        cut = heap[0][0]   # the least end: up to here no run has more to come
        codes, counts = [], []
        for _, k in heap:
            stop = int(np.searchsorted(now[k][0], cut, side="right"))
            codes.append(now[k][0][:stop])
            counts.append(now[k][1][:stop])
            now[k] = (now[k][0][stop:], now[k][1][stop:])
        while heap and heap[0][0] == cut:
            _, k = heapq.heappop(heap)
            now[k] = next(readers[k], None)
            if now[k] is not None:
                heapq.heappush(heap, (int(now[k][0][-1]), k))
        flat = np.concatenate(codes)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        start = np.flatnonzero(np.diff(flat, prepend=-1))
        yield flat[start], np.add.reduceat(np.concatenate(counts)[order], start)


def with_best(parts):
    """(codes, counts, whether the count is its A id's highest) of ascending parts; an A id's pairs are held until its last has passed."""
    held: list = []

    def closed(codes, counts):
        start = np.flatnonzero(np.diff(codes >> B_BITS, prepend=-1))
        most = np.repeat(np.maximum.reduceat(counts, start), np.diff(np.append(start, len(codes))))
        return codes, counts, (counts == most).astype(np.int64)

    for codes, counts in parts:
        held.append((codes, counts))
        codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        stop = int(np.searchsorted(codes, (codes[-1] >> B_BITS) << B_BITS))
        held = [(codes[stop:], counts[stop:])]
        if stop:
            yield closed(codes[:stop], counts[:stop])
    if held:
        yield closed(*held[0])


#: A document's row before and after its links' counts are known.
FACTS = ["n_a", "n_b", "n_groups", "n_links"]
RUN_SCHEMA = ("run string, bucket int, blocks array<binary>, doc_id array<long>, "
              + ", ".join(f"{c} array<long>" for c in FACTS) + ", groups_sha256 array<string>, alignment array<string>")


def runs_of(docs: DataFrame, folder: str, keep_groups: bool, run_records: int) -> DataFrame:
    """The runs of (doc_id, text): rows with the pairs of a bucket, and one row (bucket -1) with documents and posting list."""
    def run(batches):
        units = kept_by_worker(f"units {folder}", lambda: Units(Tokenizers(folder)))
        ids: list = []
        sums: list = []
        strings: list[str] = []
        records: list = []
        size = 0

        def made():
            doc, code, times = (np.concatenate(x) for x in zip(*records, strict=True))
            bucket = (code >> np.uint32(B_BITS)) % BUCKETS
            order = np.argsort((bucket.astype(np.int64) << 32) | code, kind="stable")
            doc, code, times, bucket = doc[order], code[order], times[order], bucket[order]
            start = np.flatnonzero(np.diff((bucket.astype(np.int64) << 32) | code, prepend=-1))
            count = np.diff(np.append(start, len(code)))
            name = uuid.uuid4().hex
            rows = [{"run": name, "bucket": -1, "blocks": [packed(count), packed(doc, times)],
                     "doc_id": list(ids), **dict(zip(FACTS, np.concatenate(sums).T.tolist(), strict=True)),
                     "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in strings],
                     "alignment": list(strings) if keep_groups else None}]
            for b in np.unique(bucket).tolist():
                mine = bucket[start] == b
                rows.append({"run": name, "bucket": b, "blocks": pair_blocks(code[start][mine], count[mine])})
            ids.clear(), sums.clear(), strings.clear(), records.clear()
            return pa.RecordBatch.from_pylist(rows, schema=RUN_ARROW)

        for batch in batches:
            for part, raws in text_slices(batch, 1):
                texts = [r.decode() for r in raws]
                facts, own, (doc, code, times) = align_slice(texts, units)
                records.append((doc + len(ids), code, times))
                ids += part.column(0).to_pylist()
                sums.append(facts)
                strings += own
                size += len(code)
                if size >= run_records:
                    yield made()
                    size = 0
        if ids:
            yield made()

    longs = pa.list_(pa.int64())
    RUN_ARROW = pa.schema([("run", pa.string()), ("bucket", pa.int32()), ("blocks", pa.list_(pa.binary())), ("doc_id", longs),
                           *[(c, longs) for c in FACTS], ("groups_sha256", pa.list_(pa.string())), ("alignment", pa.list_(pa.string()))])
    return docs.mapInArrow(run, RUN_SCHEMA)


def merged_runs(runs: DataFrame, last: bool) -> DataFrame:
    """Each group (bucket, part) of runs as one run; the last merge also marks each A id's highest counts."""
    def run(table: pa.Table) -> pa.Table:
        parts = heap_merge(table.column("blocks").to_pylist())
        blocks = [b for x in (with_best(parts) if last else parts) for b in pair_blocks(*x)]
        return pa.table({"run": [uuid.uuid4().hex], "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
                         "blocks": pa.array([blocks], pa.list_(pa.binary()))})

    return runs.groupBy("bucket", "part").applyInArrow(run, "run string, bucket int, blocks array<binary>")


def counted(pairs: DataFrame, fan: int) -> DataFrame:
    """(bucket, blocks of code, count, best), one row a bucket, from the runs' pairs: a merge tree of ``fan`` runs a node."""
    while True:
        many = pairs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        parts = -(-many // fan)
        split = F.pmod(F.hash("run"), F.lit(max(1, parts if parts < 2 else 2 * parts))).alias("part")   # hashed: twice the parts, so that one has about half a fan
        pairs = write_once(merged_runs(pairs.select("run", "bucket", "blocks", split), parts < 2), "merged")
        if parts < 2:
            return pairs.select("bucket", "blocks")


def contributions(runs: DataFrame, final: DataFrame, fan: int) -> DataFrame:
    """(doc_id, facts, n_best, count_sum) of every document."""
    def reply(key, mine: pa.Table, counts: pa.Table) -> pa.Table:
        # the runs' distinct pairs are looked up block by block of the final counts
        own = [np.concatenate([c for c, _ in read_pairs(b)]) for b in mine.column("blocks").to_pylist()]
        found = [(np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)) for c in own]
        for code, count, best in read_pairs(counts.column("blocks")[0].as_py()):
            for c, (n, top) in zip(own, found, strict=True):
                a, b = np.searchsorted(c, code[0]), np.searchsorted(c, code[-1], side="right")
                at = np.searchsorted(code, c[a:b])
                n[a:b], top[a:b] = count[at], best[at]
        return pa.table({"run": mine.column("run"), "bucket": mine.column("bucket"), "answer": pa.array([packed(n, t) for n, t in found], pa.binary())})

    pairs = runs.where("bucket >= 0").select("run", "bucket", "blocks")
    many = pairs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-many // fan))
    left = pairs.withColumn("part", F.pmod(F.hash("run"), F.lit(parts))).groupBy("bucket", "part")
    right = final.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    filled = right.join(pairs.select("bucket", F.pmod(F.hash("run"), F.lit(parts)).alias("part")).distinct(), ["bucket", "part"], "left_semi")
    answers = left.cogroup(filled.groupBy("bucket", "part")).applyInArrow(reply, "run string, bucket int, answer binary")

    def summed(key, own: pa.Table, got: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        order = np.argsort(got.column("bucket").to_numpy())
        parts_ = [unpacked(got.column("answer")[int(k)].as_py()) for k in order]
        n, top = (np.concatenate(x) for x in zip(*parts_, strict=True)) if parts_ else (np.zeros(0, np.int64),) * 2
        (count,), (doc, times) = unpacked(row["blocks"][0]), unpacked(row["blocks"][1])
        best, total = (np.zeros(len(row["doc_id"]), np.int64) for _ in range(2))
        np.add.at(best, doc, times * np.repeat(top, count))
        np.add.at(total, doc, times * np.repeat(n, count))
        return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in FACTS},
                         "n_best": best, "count_sum": total, "groups_sha256": pa.array(row["groups_sha256"], pa.string()),
                         "alignment": pa.array(row["alignment"] or [None] * len(best), pa.string())})

    schema = ", ".join(["doc_id long", *[f"{c} long" for c in FACTS], "n_best long", "count_sum long", "groups_sha256 string", "alignment string"])
    return runs.where("bucket = -1").drop("bucket").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(summed, schema)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, keep_groups: bool = True,
            run_records: int = RUN_RECORDS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The documents' alignments (``alignment``: groups ``a1,a2|b1;a3|b2``; null unless kept) with their counts, and the final counts of all pairs."""
    base, at = isolate(docs)
    slim = base.select(F.col(at[id_col]).cast("long").alias("doc_id"), F.col(at[text_col]).cast("string").alias("text"))
    runs = write_once(runs_of(slim, folder, keep_groups, run_records), "runs")
    final = counted(runs.where("bucket >= 0").select("run", "bucket", "blocks"), fan)
    return contributions(runs, final, fan), final


def pair_counts(final: DataFrame) -> DataFrame:
    """(a, b, documents, best) of every linked pair of ids, from the final counts."""
    def run(batches):
        for batch in batches:
            for blocks in batch.column(0).to_pylist():
                for code, count, best in read_pairs(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(code >> B_BITS), pa.array(code & ((1 << B_BITS) - 1)), pa.array(count), pa.array(best > 0)],
                                                     names=["a", "b", "documents", "best"])

    return final.select("blocks").mapInArrow(run, "a long, b long, documents long, best boolean")


def query(docs: DataFrame) -> DataFrame:
    return aligned(docs, keep_groups=False)[0].drop("alignment").select("doc_id", *FACTS, "n_best", "count_sum", "groups_sha256")
