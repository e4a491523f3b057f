"""Conversation structure repair by Wagner-Fischer alignment to target role strings.

A conversation is its rows in order of turn (nulls first, then role and text).
The repaired role initials must be ``(s?(ua)+)?``. Edits: Keep 0, Rerole to
user or assistant 1, Delete 2, Insert an empty user or assistant turn 5. A
blank row (only white space) and a duplicate (role and text seen earlier in
the conversation) must go; a truncated row (its last character that is not
white space is none of ``.!?``) costs 5 more when it stays.

1. Spark shuffles the rows once, by conversation; duplicates are found by a
   window on that layout and the rows sorted within their partition.
2. A task streams over its rows. A conversation of at most ``BLOCK`` rows is
   aligned as a whole: every feasible length of the alternating target (with
   and without ``s``) is a Wagner-Fischer table inside Ukkonen's band, whose
   diagonals follow from the cost of the best audit so far. The audit (the
   initials of the edits) is read off as the ASCII-least of its length;
   audits of equal cost are compared as strings.
3. A longer conversation is aligned block by block, from each role that the
   target may have reached to each that it may reach. At most four audits
   live at a time; the rows on which all agree are returned at once, so a
   conversation of any length needs the memory of a few blocks. One task
   reads it: a hash over its rows in order has no other form.

Block results depend on the rows' initials and faults alone and are kept in a
bounded cache. An audit fixes the repaired rows: ``s`` can only be kept, and
after it user and assistant alternate.

Defined cases: a null role or text is one space (so a null text is blank); a
null turn comes first; rows without a conversation id are one conversation; a
role's initial is its first character ('' for an empty role); equal turns are
ordered by role and text; repeated rows are duplicates; an empty table gives
an empty result; other columns are ignored, whatever their names; ``gaps``
above 2^63 - 1 is that number.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import isolate

#: Costs of the edits, and of a truncated row that stays.
RETAG, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Rows that are aligned at once, and block results that a worker keeps.
BLOCK, CACHED = 32, 1 << 16
#: The roles that edits give.
GIVEN = {"u": "user", "a": "assistant"}
#: What the target can have reached: nothing, the system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = "-sua"
ACCEPTED = START + ASSISTANT
NO_COST = 1 << 60
LEGAL = ["su", "ua", "au"]
WHITE_SPACE = " \t\n\x0b\x0c\r"
MOST = (1 << 63) - 1


def banded(rows: tuple[str, ...], target: str, bound: int) -> tuple[int, str] | None:
    """The cheapest, then ASCII-least audit that turns ``rows`` into ``target``, if it costs at most ``bound``.

    A row is its role's initial and a letter for its fault. Cell (i, j) holds
    the least cost of turning rows from i into the target from j. On diagonal
    i - j at least so many deletions, or insertions, lie before the cell and
    the rest after it; where that alone exceeds the bound no cell is made.
    """
    n, m = len(rows), len(target)
    least = DELETE * (n - m) if n >= m else INSERT * (m - n)
    if least > bound:
        return None
    slack = (bound - least) // (DELETE + INSERT)
    low, high = min(0, n - m) - slack, max(0, n - m) + slack
    cost: dict[tuple[int, int], int] = {}

    def stay(i: int, j: int) -> int:
        row, want = rows[i], target[j]
        fault, initial = row[-1], row[:-1]
        if fault in "bd" or (want == "s" and initial != "s"):
            return NO_COST
        return (CUT_OFF if fault == "t" else 0) + (0 if initial == want else RETAG)

    def moves(i: int, j: int):
        """(letter, cost of the edit and all after it, next cell), letters in ASCII order."""
        if i < n:
            yield "D", DELETE + cost.get((i + 1, j), NO_COST), (i + 1, j)
        if j < m and target[j] != "s":
            yield "I", INSERT + cost.get((i, j + 1), NO_COST), (i, j + 1)
        if i < n and j < m:
            step = stay(i, j)
            kept = target[j] == rows[i][:-1]
            yield "K" if kept else "R", step + cost.get((i + 1, j + 1), NO_COST), (i + 1, j + 1)

    for i in range(n, -1, -1):
        for j in range(min(m, i - low), max(0, i - high) - 1, -1):
            cost[i, j] = 0 if (i, j) == (n, m) else min((c for _, c, _ in moves(i, j)), default=NO_COST)
    total = cost[0, 0]
    if total > bound:
        return None
    audit, at = [], (0, 0)
    while at != (n, m):
        want = cost[at]
        letter, _, at = next(x for x in moves(*at) if x[1] == want)
        audit.append(letter)
    return total, "".join(audit)


def reached(came: str, target: str) -> str:
    return target[-1] if target else came


def targets(came: str, length: int) -> list[str]:
    """The strings of one length that may follow."""
    alternating = (("au" if came == USER else "ua") * length)[:length]
    return [alternating, "s" + alternating[:-1]] if came == START and length else [alternating]


@lru_cache(CACHED)
def block_audits(rows: tuple[str, ...], came: str, last: bool) -> tuple[tuple[str, int, str], ...]:
    """(reached, cost, audit) of the best audit to each state after the rows; of the last block to any accepted one."""
    n, gone = len(rows), sum(r[-1] in "bd" for r in rows)
    best: dict[str, tuple[int, str]] = {}
    # that many deletions, and insertions for the rest, at least
    floor = sorted((DELETE * max(gone, n - m) + INSERT * max(0, m - n + gone), m) for m in range(2 * n + 4))
    for least, m in floor:
        for target in targets(came, m):
            end = reached(came, target)
            if last and end not in ACCEPTED:
                continue
            group = ACCEPTED if last else end
            bound = best[group][0] if group in best else DELETE * n + 2 * INSERT
            if least <= bound and (found := banded(rows, target, bound)) and (group not in best or found < best[group]):
                best[group] = found
    return tuple((end, *v) for end, v in best.items())


class Aligner:
    """Audits of one conversation, whose rows come one after the other."""

    def __init__(self):
        self.live = {START: (0, "")}     # state -> (cost, edits since what was handed out)
        self.rows: list[tuple] = []      # not yet handed out: (row, code)
        self.done = 0                    # of these, aligned
        self.out = START                 # what the handed out edits have reached

    def push(self, row: dict, code: str):
        self.rows.append((row, code))
        if len(self.rows) - self.done > BLOCK:   # one more than a block: it is not the last
            self._align(self.done + BLOCK, False)
            yield from self._agreed()

    def finish(self):
        self._align(len(self.rows), True)
        audit = min(self.live.values())[1]
        yield from self._edits(audit, len(self.rows))

    def _align(self, stop: int, last: bool) -> None:
        codes = tuple(code for _, code in self.rows[self.done:stop])
        after: dict[str, tuple[int, str]] = {}
        for came, (cost, audit) in self.live.items():
            for end, more, edits in block_audits(codes, came, last):
                new = (cost + more, audit + edits)
                if end not in after or new < after[end]:
                    after[end] = new
        self.live, self.done = after, stop

    def _agreed(self):
        """Hands out the rows whose edits are the same in all live audits."""
        audits = [a for _, a in self.live.values()]
        shared, rows, cut = 0, 0, 0
        for letters in zip(*audits, strict=False):
            if len(set(letters)) > 1:
                break
            shared += 1
            if letters[0] != "I":
                rows, cut = rows + 1, shared
        if rows:
            edits = audits[0][:cut]
            self.live = {k: (c, a[cut:]) for k, (c, a) in self.live.items()}
            yield from self._edits(edits, rows)
            self.done -= rows

    def _edits(self, audit: str, rows: int):
        """(row or None, edit, role given or None) for each letter."""
        at = 0
        for letter in audit:
            row, code = (None, "") if letter == "I" else self.rows[at]
            at += letter != "I"
            if letter == "D":
                yield row, letter, None
                continue
            if letter == "K":
                self.out = code[0]
                yield row, letter, row["role"]
            else:
                self.out = ASSISTANT if self.out == USER else USER
                yield row, letter, GIVEN[self.out]
        del self.rows[:rows]


def faults(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """(key, turn, role, text, fault) laid out by key and sorted; one shuffle. The fault is b, d, t or '.'."""
    base, at = isolate(df)
    flat = base.select(F.col(at[key]).alias("key"), F.col(at[order]).cast("long").alias("turn"),
                       F.coalesce(F.col(at[role]).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(at[text]).cast("string"), F.lit(" ")).alias("text")).repartition("key")
    seen = Window.partitionBy("key", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(WHITE_SPACE))
    fault = (F.when(bare == "", "b").when(F.col("nth") > 1, "d")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("."))
    return (flat.withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
            .sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text", "nth").drop("nth"))


def repair(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edits of every conversation, in order: (key, seq, edit, turn, role, text, fault, clash, new_role).

    ``edit`` is K, R, D or I; turn, role, text and fault are the row's (null
    for I), ``clash`` whether its role may not follow the one before, and
    ``new_role`` the repaired role (null for D; an inserted turn's text is
    empty). Rows of a conversation stand together, in order of ``seq``.
    """
    rows = faults(df, key, order, role, text)
    kind = dict(rows.dtypes)["key"]
    names = ["key", "seq", "edit", "turn", "role", "text", "fault", "clash", "new_role"]

    def run(batches):
        aligner, key_now, seq, before = None, None, 0, None
        out: dict[str, list] = {c: [] for c in names}
        size = 0
        schema = None

        def add(edits):
            nonlocal seq, size
            for row, letter, given in edits:
                row = row or {"turn": None, "role": None, "text": None, "fault": None, "clash": None}
                values = (key_now, seq, letter, row["turn"], row["role"], row["text"], row["fault"], row["clash"], given)
                for c, v in zip(names, values, strict=True):
                    out[c].append(v)
                seq += 1
                size += 64 + len(row["text"] or "")

        def flush():
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
            for c in names:
                out[c].clear()
            size = 0
            return batch

        for b in batches:
            schema = schema or pa.schema([("key", b.schema.field("key").type), ("seq", pa.int64()), ("edit", pa.string()),
                                          ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                                          ("fault", pa.string()), ("clash", pa.bool_()), ("new_role", pa.string())])
            for k, row in zip(b.column("key").to_pylist(), b.drop_columns(["key"]).to_pylist(), strict=True):
                if aligner is None or k != key_now:
                    if aligner is not None:
                        add(aligner.finish())
                    aligner, key_now, seq, before = Aligner(), k, 0, None
                initial = row["role"][:1]
                row["clash"] = before is not None and before + initial not in LEGAL
                before = initial
                add(aligner.push(row, initial + row["fault"]))
                if size > 1 << 22:
                    yield flush()
        if aligner is not None:
            add(aligner.finish())
            yield flush()

    return rows.mapInArrow(run, f"key {kind}, seq long, edit string, turn long, role string, text string, fault string, clash boolean, new_role string")


def digest(edits: DataFrame) -> DataFrame:
    """One row a conversation from the rows of ``repair``, streamed in their order without another shuffle."""
    kind = dict(edits.dtypes)["key"]
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    price = {"K": 0, "R": RETAG, "D": DELETE, "I": INSERT}

    def run(batches):
        now: dict | None = None

        def closed() -> list:
            turns = 0 if now["least"] is None else now["most"] - now["least"] + 1 - now["turns"]
            return [now["key"], min(turns, MOST), *(now[c] for c in counts[1:]), "".join(now["audit"]), now["sha"].hexdigest()]

        for b in batches:
            done = []
            for row in b.to_pylist():
                if now is None or row["key"] != now["key"]:
                    if now is not None:
                        done.append(closed())
                    now = dict.fromkeys(counts[1:], 0) | {"key": row["key"], "least": None, "most": None, "turns": 0,
                                                          "audit": [], "sha": hashlib.sha256(), "any": False}
                if row["turn"] is not None:   # turns come in order
                    now["turns"] += row["turn"] != now["most"]
                    now["least"] = row["turn"] if now["least"] is None else now["least"]
                    now["most"] = row["turn"]
                name = {"b": "blank", "d": "duplicate", "t": "truncated"}.get(row["fault"])
                if name:
                    now[name] += 1
                now["illegal"] += bool(row["clash"])
                now["cost"] += price[row["edit"]] + (CUT_OFF if row["fault"] == "t" and row["edit"] in "KR" else 0)
                now["audit"].append(row["edit"])
                if row["edit"] != "D":
                    now["sha"].update((("\n" if now["any"] else "") + row["new_role"] + ":" + (row["text"] or "")).encode())
                    now["any"] = True
            yield made(b, done)
        if now is not None:
            yield made(b, [closed()])

    def made(b, rows: list) -> pa.RecordBatch:
        kinds = [("key", b.schema.field("key").type), *[(c, pa.int64()) for c in counts], ("audit", pa.string()), ("repaired_sha256", pa.string())]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, (_, t) in zip(columns, kinds, strict=True)], names=[c for c, _ in kinds])

    return edits.mapInArrow(run, f"key {kind}, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the query's contract plants."""
    base, at = isolate(conversations)
    flat = base.select(F.col(at["conv_id"]).alias("conv_id"), F.col(at["turn"]).cast("long").alias("turn"),
                       *[F.coalesce(F.col(at[c]).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])

    def named(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    return (flat.withColumn("draw", draw).where("draw <> 0")
            .withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text")))


def query(conversations: DataFrame) -> DataFrame:
    base, at = isolate(conversations)
    named = base.select(F.col(at["conv_id"]).alias("conv_id")).distinct()
    found = digest(repair(damaged(conversations)))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (named.join(found, named["conv_id"].eqNullSafe(found["key"]), "left")
            .select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", none).alias("repaired_sha256")))


#: Plain search over all audits: each row's edit, with up to two insertions before it and at the end, keeping
#: the cheapest, then least, audit and its text for each role reached. crc32 by its defining bit steps.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda k: list_reduce([k, 1, 1, 1, 1, 1, 1, 1, 1],
         lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations
), drawn AS (
  SELECT raw.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
         lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) % 20 AS draw
  FROM raw, bits
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, range(2) AS c(copy) WHERE draw <> 0 AND (copy = 0 OR draw = 3)
), numbered AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS bare,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth
  FROM rows_
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN '.' ELSE 't' END AS f,
         row_number() OVER w AS n, lag(i) OVER w AS before
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), facts AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), inserts(was, now, cost, audit, said) AS (
  VALUES ('-', '-', 0, '', []), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
         ('-', 'u', 5, 'I', ['user:']), ('s', 'u', 5, 'I', ['user:']), ('u', 'a', 5, 'I', ['assistant:']), ('a', 'u', 5, 'I', ['user:']),
         ('-', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 'a', 10, 'II', ['user:', 'assistant:'])
), search(conv_id, n, state, cost, audit, said) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '-', 0, '', CAST([] AS VARCHAR[]) FROM facts
  UNION ALL
  SELECT conv_id, n, state, b.cost, b.audit, b.said FROM (
    SELECT s.conv_id, f.n, e.state, min({'cost': s.cost + x.cost + e.cost, 'audit': s.audit || x.audit || e.edit,
           'said': s.said || x.said || CASE WHEN e.edit = 'D' THEN [] ELSE [CASE WHEN e.edit = 'K' THEN f.role WHEN e.state = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] END}) AS b
    FROM search s JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.n + 1 JOIN inserts x ON x.was = s.state,
         LATERAL (SELECT * FROM (VALUES ('D', x.now, 2),
                  (CASE WHEN f.i = 'u' THEN 'K' ELSE 'R' END, CASE WHEN x.now <> 'u' THEN 'u' END, CASE WHEN f.i = 'u' THEN 0 ELSE 1 END + CASE WHEN f.f = 't' THEN 5 ELSE 0 END),
                  (CASE WHEN f.i = 'a' THEN 'K' ELSE 'R' END, CASE WHEN x.now = 'u' THEN 'a' END, CASE WHEN f.i = 'a' THEN 0 ELSE 1 END + CASE WHEN f.f = 't' THEN 5 ELSE 0 END),
                  ('K', CASE WHEN x.now = '-' AND f.i = 's' THEN 's' END, CASE WHEN f.f = 't' THEN 5 ELSE 0 END)) v(edit, state, cost)
                  WHERE v.state IS NOT NULL AND (v.edit = 'D' OR f.f NOT IN ('b', 'd'))) e
    GROUP BY s.conv_id, f.n, e.state)
), ended AS (
  SELECT s.conv_id, min({'cost': s.cost + x.cost, 'audit': s.audit || x.audit, 'said': s.said || x.said}) AS b
  FROM search s JOIN facts f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND s.n = f.n_rows JOIN inserts x ON x.was = s.state AND x.now IN ('-', 'a')
  GROUP BY s.conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.b.cost, 0) AS BIGINT) AS cost,
       coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
