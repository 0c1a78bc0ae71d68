r"""Conversation structure repair: an error-correcting Earley parse over a weighted role grammar.

The grammar is right-linear: ``turns`` is nothing, or an optional system turn and
then pairs of a user's and an assistant's turn. Each rule that reads a role also
has error productions: Rerole reads any row as a user's or an assistant's (1),
Insert reads nothing and adds an empty turn (5), and Delete reads a row and stays
in its rule (2). A kept row costs nothing; one that is kept or reroled though it
is truncated costs 5 more, and blank and duplicate rows can only be deleted.

A chart column holds, for each nonterminal that may come next, the item with the
least (cost, audit), the audit being the edits' initials so far. In a right-linear
grammar the completer has nothing to do before the end of the rows, so only the
last column is kept; the items' common beginning is settled and put out as the
parse goes on. Of two items of one column, nonterminal and cost, neither audit
begins the other (further inserts would cost more), so the least stays the least.

Rows are merged when all of conv_id, turn, role and text agree (map-side counts),
shuffled by conv_id, and stream through the parse in sorted order. Nothing of a
conversation is gathered, so one of any length needs little memory, but its rows
pass one task: the hash of its whole text is one sequential fold.

Defined results: null roles and texts are one space; rows of one turn are taken
by role, then text; null turns come first; a null conv_id is one conversation;
an empty role has no initial, so such a row isn't kept as it is; a conversation
without rows gives no row here (see :func:`with_all`); an empty table gives no
rows; gaps beyond 2**63 - 1 are that number; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
#: nonterminal: (role initial, next nonterminal); None as initial: the rows may end.
GRAMMAR = {
    "turns": (("s", "opened"), ("u", "asked"), (None, None)),
    "opened": (("u", "asked"),),
    "asked": (("a", "answered"),),
    "answered": (("u", "asked"), (None, None)),
}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
_SETTLE = 256  # letters of an audit before its settled beginning is looked for
_FLUSH = 4 << 20


class Production(NamedTuple):
    """left -> token right; ``reads``: a role initial, any row (True) or nothing (False); ``says``: the role that it gives."""

    left: str
    reads: str | bool
    right: str
    edit: str
    cost: int


def productions(grammar: dict = GRAMMAR) -> list[Production]:
    """The grammar's rules with their error productions."""
    out = []
    for left, rules in grammar.items():
        out.append(Production(left, True, left, "D", DELETE))
        for initial, right in rules:
            if initial:
                out.append(Production(left, initial, right, "K", 0))
            if initial in NAMES:
                out.append(Production(left, True, right, "R", REROLE))
                out.append(Production(left, False, right, "I", INSERT))
    return out


_SCANNED = {x: [p for p in productions() if p.left == x and p.reads] for x in GRAMMAR}
_PREDICTED = [p for p in productions() if not p.reads]
_FINAL = [x for x, rules in GRAMMAR.items() if (None, None) in rules]
Column_ = dict[str, tuple[int, str]]


def _better(column: Column_, x: str, item: tuple[int, str]) -> bool:
    if x not in column or item < column[x]:
        column[x] = item
        return True
    return False


def predict(column: Column_) -> Column_:
    """Add what inserted turns lead to."""
    changed = True
    while changed:
        changed = False
        for p in _PREDICTED:
            if p.left in column:
                cost, audit = column[p.left]
                changed |= _better(column, p.right, (cost + p.cost, audit + p.edit))
    return column


def scan(column: Column_, initial: str, fault: str, copies: int = 1) -> Column_:
    """The next column after ``copies`` rows of this role initial; fault: b(lank), d(uplicate), t(runcated) or none."""
    if fault in ("b", "d"):
        return predict({x: (cost + DELETE * copies, audit + "D" * copies) for x, (cost, audit) in column.items()})
    new: Column_ = {}
    more = TRUNCATED if fault == "t" else 0
    for x, (cost, audit) in column.items():
        for p in _SCANNED[x]:
            if p.reads is True or p.reads == initial:
                _better(new, p.right, (cost + p.cost + (0 if p.edit == "D" else more), audit + p.edit))
    return predict(new)


def complete(column: Column_) -> tuple[int, str]:
    """The cheapest whole parse."""
    return min(column[x] for x in _FINAL if x in column)


class _Parse:
    """One conversation: rows go in, edits come out as they are settled."""

    def __init__(self):
        self.column = predict({"turns": (0, "")})
        self.waiting: deque = deque()  # [role, text, copies] of rows whose edits aren't settled
        self.last = ""
        self.audit: list[str] = []
        self.place = 0

    def row(self, role: str, text: str | None, fault: str, copies: int = 1) -> None:
        self.waiting.append([role, text, copies])
        self.column = scan(self.column, role[:1], fault, copies)

    def settle(self, whole: bool = False) -> Iterator[tuple[int, str, str, str]]:
        """(place, edit, role, text) of the edits that all items share; of the cheapest parse at the end."""
        if whole:
            done = complete(self.column)[1]
        elif max(len(audit) for _, audit in self.column.values()) < _SETTLE:
            return
        else:
            done = os.path.commonprefix([audit for _, audit in self.column.values()])
            self.column = {x: (cost, audit[len(done) :]) for x, (cost, audit) in self.column.items()}
        self.audit.append(done)
        for edit in done:
            role, text = "", ""
            if edit != "I":
                head = self.waiting[0]
                role, text = head[0], head[1]
                head[2] -= 1
                if not head[2]:
                    self.waiting.popleft()
            if edit in "RI":
                role = NAMES["a" if self.last == "u" else "u"]
            if edit != "D":
                self.last = role[:1]
            yield self.place, edit, role, text
            self.place += 1


class _Counts:
    """Faults and gaps of one conversation."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial: str | None = None

    def row(self, turn: int | None, role: str, fault: str, copies: int = 1) -> None:
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in LEGAL
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.initial = initial
        self.blank += copies if fault == "b" else 0
        self.duplicate += copies if fault == "d" else 0
        self.truncated += copies if fault == "t" else 0
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else min(self.last - self.first + 1 - self.turns, (1 << 63) - 1)


_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    + [(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_DDL = "conv_id long, place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _parsed(keep_edits: bool):
    """Sorted rows to a row for each edit (if they are kept) and then one for each conversation, with a null place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        current, parse, counts, digest, first = object(), None, None, None, True

        def put(edits):
            nonlocal held, first
            for place, edit, role, text in edits:
                if edit != "D":
                    line = f"{role}:{text}"
                    digest.update(line.encode() if first else b"\n" + line.encode())
                    first = False
                if keep_edits:
                    out.append((current, place, edit, role, text) + (None,) * 8)
                    held += 100 + len(text or "")

        def close():
            nonlocal held
            cost = complete(parse.column)[0]
            put(parse.settle(whole=True))
            audit = "".join(parse.audit)
            out.append((current, None, None, None, None, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digest.hexdigest()))
            held += 200 + len(audit)

        def flush():
            nonlocal out, held
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)
            out, held = [], 0
            return batch

        for batch in batches:
            names = ("conv_id", "turn", "role", "fault", "copies", "text")
            for conv, turn, role, fault, copies, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
                if parse is None or conv != current:
                    if parse is not None:
                        close()
                    current, parse, counts, digest, first = conv, _Parse(), _Counts(), hashlib.sha256(), True
                single = 1 if fault not in ("b", "d") else copies
                parse.row(role, text, fault, single)
                counts.row(turn, role, fault, single)
                if copies > single:  # further copies of a sound or truncated row are duplicates
                    parse.row(role, text, "d", copies - single)
                    counts.row(turn, role, "d", copies - single)
                put(parse.settle())
                if held > _FLUSH:
                    yield flush()
        if parse is not None:
            close()
        if out:
            yield flush()

    return run


def find_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault: equal rows merged, each with its first row's fault; rows of a conversation lie in order in one partition."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "b").when(again, "d").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    return merged.withColumn("fault", fault).sortWithinPartitions("conv_id", "turn", "role", "text")


def repair_conversations(turns: DataFrame, keep_edits: bool = True) -> DataFrame:
    """The edits of each conversation in order (place, edit K, R, D or I, role and text after it), and a row with
    a null place for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The repaired conversation is the rows whose edit isn't D. Without ``keep_edits`` only the latter rows are given.
    """
    return find_faults(turns).mapInArrow(_parsed(keep_edits), _DDL)


def with_all(summaries: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for every conv_id of ``turns``: those without rows left have zeros, no edits and the hash of nothing."""
    ids = turns.select(F.col("conv_id").cast("long").alias("all_conv_id")).distinct()
    met = ids.join(summaries, ids["all_conv_id"].eqNullSafe(summaries["conv_id"]), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("all_conv_id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 twice, 4 a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), d.alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


ORACLE_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), bits AS (
  SELECT *, list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(key, ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))) AS l FROM k
), d AS (
  SELECT *, xor(4294967295, list_reduce(l, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 20 AS d FROM bits
), r AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS n FROM d
), n AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || role[1] AS pair FROM r
), f AS (
  SELECT *, CASE WHEN ended = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN ended[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n
), step(state, edit, want, nxt, cost) AS (
  VALUES (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (2, 'R', '', 3, 1), (3, 'R', '', 2, 1),
    (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2)
), ins(state, edits, nxt, cost, said) AS (
  VALUES (0, '', 0, 0, CAST([] AS VARCHAR[])), (1, '', 1, 0, []), (2, '', 2, 0, []), (3, '', 3, 0, []), (0, 'I', 2, 5, ['user:']), (1, 'I', 2, 5, ['user:']), (3, 'I', 2, 5, ['user:']), (2, 'I', 3, 5, ['assistant:']),
    (0, 'II', 3, 10, ['user:', 'assistant:']), (1, 'II', 3, 10, ['user:', 'assistant:'])
), p AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS i, ins.nxt AS state, {'c': ins.cost, 'a': ins.edits, 'o': ins.said} AS best FROM (SELECT DISTINCT conv_id FROM conversations) c, ins WHERE ins.state = 0
  UNION ALL
  SELECT p.conv_id, f.i, ins.nxt, min({'c': p.best.c + step.cost + CASE WHEN f.fault = 't' AND step.edit <> 'D' THEN 5 ELSE 0 END + ins.cost, 'a': p.best.a || step.edit || ins.edits,
    'o': p.best.o || (CASE step.edit WHEN 'K' THEN [f.role || ':' || f.text] WHEN 'R' THEN [CASE step.nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] ELSE CAST([] AS VARCHAR[]) END) || ins.said})
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN step ON step.state = p.state AND (step.want = '' OR step.want = f.role[1]) AND (step.edit = 'D' OR f.fault NOT IN ('b', 'd')) JOIN ins ON ins.state = step.nxt
  GROUP BY p.conv_id, f.i, ins.nxt
), e AS (
  SELECT conv_id, count(i) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
    count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), b AS (
  SELECT p.conv_id, any_value(e.gaps) AS gaps, any_value(e.blank) AS blank, any_value(e.duplicate) AS duplicate, any_value(e.truncated) AS truncated, any_value(e.illegal) AS illegal, min(p.best) AS best
  FROM p LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(e.rows_, 0) AND p.state IN (0, 3) GROUP BY p.conv_id
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(array_to_string(best.o, chr(10))) AS repaired_sha256 FROM b
"""
