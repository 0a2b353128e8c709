"""Repair of conversation structure: an automaton that shares suffixes, and costs to go on it.

A row of a conversation is a letter, its role and fault; a conversation is a word. Words are
minimised from their ends: sorted by their reversed letters, words with a common suffix are
neighbours, and a node of the automaton, one common suffix, is visited once for all of them. What
a node adds depends only on its letter and on the costs to go behind it; up to a constant there
are few such costs, so nodes that agree in both are one class, whose decisions are made once. Of
equal costs the least letter wins: an edit leads from a grammar state to one state only, so the
first letter decides and no two audits need to be compared.

Rows are counted as often as they come and first occurrences are found by an aggregate, so no
hot text or row meets in one task. Words are sorted over all tasks by reversed letters and id,
so a word that many conversations share is dealt to many. A conversation's own rows are streamed
by one task in turn order, as its digest is sequential; a task holds a letter of each row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, table, tidy, written

#: Grammar states: nothing yet, after system, after user, after assistant. What a role leads to,
#: what Rerole and Insert lead to, and the cost to end.
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "o": (None,) * 4}
TURN = (2, 2, 3, 2)
AT_END = (0, 10, 5, 0)
NAMES = {2: "user", 3: "assistant"}
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: Letters: role initials, in upper case where the row is truncated; x: the row must go.
GONE = "x"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows of turns damaged by crc32(`conv_id:turn`) % 20, each
    with how often it stands (0: dropped, but its conversation stays). Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    luck = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(luck == 1, "").when(luck == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(luck == 4, "user").otherwise(space("role"))
    n = F.when(luck == 0, 0).when(luck == 3, 2).otherwise(1)
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), n.cast("long").alias("n"))


def counted(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n) with equal ones as one, n added up."""
    gone = F.col("n") == 0
    empty = lambda c: F.when(gone, "").otherwise(F.col(c)).alias(c)
    less = rows.select("conv_id", F.when(~gone, F.col("turn")).alias("turn"), empty("role"), empty("text"), "n")
    return less.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def lettered(rows: DataFrame) -> DataFrame:
    """rows, a written table of counted() rows, with their role's initial, whether it is the first
    of its role and text in its conversation, and its letter if it is."""
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    early = rows.where("n > 0").groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("null"))
    turn = F.when(~F.col("null"), F.col("turn"))
    early = early.select(F.col("conv_id").alias("c"), turn.alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), F.lit(True).alias("first"))
    # both sides have one row a key, so no key is hot
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    core = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(core == "", GONE).when(F.right(core, F.lit(1)).isin(".", "!", "?"), known).otherwise(F.upper(known))
    return rows.join(early, same, "left").select(
        "conv_id", "turn", "role", "text", "n", initial.alias("initial"), F.coalesce("first", F.lit(False)).alias("first"), letter.alias("letter"), (core == "").alias("blank")
    )


def words(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, word) of every conversation of
    lettered() rows."""
    batched(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, word string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, state = None, False, None
        out: list[tuple] = []
        for b in batches:
            for conv, turn, n, initial, first, letter, blank in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if not begun or conv != now:
                    if begun:
                        out.append((now, *state.row()))
                    now, begun, state = conv, True, _Word()
                state.add(turn, n, initial, first, letter, blank)
            yield _batch(out, schema)
            out = []
        if begun:
            yield _batch([(now, *state.row())], schema)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.select("conv_id", "turn", "n", "initial", "first", "letter", "blank").mapInArrow(tidy(run), ddl)


class _Word:
    """A conversation's word and counts, from its rows in order."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before, self.letters = None, bytearray()

    def add(self, turn: int | None, n: int, initial: str, first: bool, letter: str, blank: bool) -> None:
        if not n:
            return
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.turns += 1
        self.illegal += (self.before is not None and self.before + initial not in ("su", "ua", "au")) + n - 1
        self.before = initial
        once = first and not blank
        if blank:
            self.blank += n
        else:
            self.duplicate += n - once
            self.truncated += once and letter.isupper()
        self.letters += (letter if once else GONE).encode() + GONE.encode() * (n - 1)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


class Node:
    """A class of suffixes: costs to go from each grammar state less their least, and for each
    state the edits up to the first letter's own and the state after it."""

    def __init__(self, costs: tuple[int, ...], edits: tuple[tuple[str, int], ...] = ()) -> None:
        self.costs, self.edits = costs, edits
        self.behind: dict[str, tuple[Node, int]] = {}


class Automaton:
    """Suffix classes found so far. Costs to go differ by less than a few inserts, so there is a
    small number of classes however many conversations there are."""

    def __init__(self) -> None:
        self.end = Node(AT_END)
        self.nodes: dict[tuple, Node] = {}

    def before(self, letter: str, node: Node) -> tuple[Node, int]:
        """The class of letter and then node's suffix, and what its costs are above node's."""
        if letter not in node.behind:
            node.behind[letter] = self._add(letter, node.costs)
        return node.behind[letter]

    def _add(self, letter: str, after: tuple[int, ...]) -> tuple[Node, int]:
        use = []  # by state: (cost, edit, state after it) of the best edit of the letter itself
        for q in range(4):
            ways = [(DELETE + after[q], "D", q)]
            if letter != GONE:
                more = LEFT_TRUNCATED if letter.isupper() else 0
                ways.append((REROLE + more + after[TURN[q]], "R", TURN[q]))
                if (to := KEEP[letter.lower()][q]) is not None:
                    ways.append((more + after[to], "K", to))
            use.append(min(ways))
        # inserts cost more than a way round saves, so none but 0, 1 -> 2 -> 3 and 3 -> 2 can help
        best = [u[0] for u in use]
        for q in (2, 3, 2, 3, 0, 1):
            best[q] = min(best[q], INSERT + best[TURN[q]])
        low = min(best)

        def edits(q: int) -> tuple[str, int]:
            shown = ""
            while best[q] != use[q][0] or (best[q] == INSERT + best[TURN[q]] and use[q][1] > "I"):
                shown, q = shown + "I", TURN[q]
            return shown + use[q][1], use[q][2]

        costs = tuple(b - low for b in best)
        steps = tuple(map(edits, range(4)))
        return self.nodes.setdefault((costs, steps), Node(costs, steps)), low


_END_EDITS = ("", "II", "I", "")


class Suffixes:
    """The path of the automaton to the latest word; words must come sorted by reversed letters."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.word, self.path, self.audit = "", [(self.automaton.end, 0)], ("", 0)

    def solve(self, back: str) -> tuple[str, int]:
        """(audit, cost) of the word whose reversed letters are back."""
        if back == self.word and len(self.path) > 1:
            return self.audit
        shared = 0
        if self.word:
            for x, y in zip(back, self.word, strict=False):
                if x != y:
                    break
                shared += 1
        del self.path[shared + 1 :]
        for letter in back[shared:]:
            node, base = self.path[-1]
            new, more = self.automaton.before(letter, node)
            self.path.append((new, base + more))
        shown, q = [], 0
        for node, _ in reversed(self.path[1:]):
            edits, q = node.edits[q]
            shown.append(edits)
        self.word, self.audit = back, ("".join(shown) + _END_EDITS[q], self.path[-1][1] + self.path[-1][0].costs[0])
        return self.audit


def audits(found: DataFrame) -> DataFrame:
    """words() rows with cost and audit in place of the word."""
    batched(found.sparkSession)
    keep = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    ddl = f"conv_id {found.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in keep)}, cost long, audit string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes()
        for b in batches:
            solved = [suffixes.solve(back) for back in b.column(6).to_pylist()]
            cols = [*b.columns[:6], pa.array([c for _, c in solved], pa.int64()), pa.array([a for a, _ in solved], pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = found.select("conv_id", *keep, F.reverse("word").alias("back"))
    return rows.repartitionByRange("back", "conv_id").sortWithinPartitions("back").mapInArrow(tidy(run), ddl)


def repaired(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv_id, line, edit, role, text): the lines of every repaired conversation of counted()
    rows, numbered from 0; partitions hold whole conversations in line order."""
    batched(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, line long, edit string, role string, text string"
    schema = arrow_schema(ddl)
    head = solved.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    every = head.unionByName(rows.where("n > 0").withColumn("kind", F.lit(1)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, q, line, now = "", 0, 0, 0, None

        def inserts() -> Iterator[tuple]:
            nonlocal at, q, line
            while at < len(audit) and audit[at] == "I":
                at, q, line = at + 1, TURN[q], line + 1
                yield now, line - 1, "I", NAMES[q], ""

        for b in batches:
            out: list[tuple] = []
            for conv, head_or_row, role, text, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if head_or_row == 0:
                    out.extend(inserts())  # what the conversation before ends with
                    audit, at, q, line, now = text, 0, 0, 0, conv
                    continue
                for _ in range(n):
                    out.extend(inserts())
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        q = TURN[q] if edit == "R" else KEEP[role[:1]][q]
                        out.append((conv, line, edit, NAMES[q] if edit == "R" else role, text))
                        line += 1
            yield _batch(out, schema)
        yield _batch(list(inserts()), schema)

    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "role", "text"]
    return every.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "n").mapInArrow(tidy(run), ddl)


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired() lines, as they lie."""
    ddl = f"conv_id {lines.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for conv, line, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if line == 0:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                sha.update(f"{chr(10) if line else ''}{role}:{text}".encode())
            yield _batch(out, schema)
        if sha:
            yield _batch([(now, sha.hexdigest())], schema)

    return lines.select("conv_id", "line", "role", "text").mapInArrow(tidy(run), ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def repairs(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every
    conversation of turns (conv_id, turn, role, text) after damaged().

    Null role, text, turn and conv_id are one space in rules and digests; rows without conv_id are
    one conversation; null turns come first and make no gaps. Rows of one turn are ordered by role
    and text, so the order of rows in the table is not needed; repeated rows are duplicates. An
    empty table gives an empty result.
    """
    rows = written(counted(damaged(turns)), "damaged")
    solved = written(audits(written(words(lettered(rows)), "words")), "audits")
    shown = digests(repaired(rows, solved)).withColumnRenamed("conv_id", "shown")
    none = F.lit(hashlib.sha256().hexdigest())
    joined = solved.join(shown, F.col("conv_id").eqNullSafe(F.col("shown")), "left").drop("shown")
    return joined.withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(table(spark, sf_dir, "conversations"))


def _way(cost: str, letter: str, rest: str, line: str | None = None) -> str:
    shown = f"chr(10) || {line} || {rest}.r" if line else f"{rest}.r"
    return f"{{'c': {cost} + {rest}.c, 'a': '{letter}' || {rest}.a, 'r': {shown}}}"


def _best(state: int) -> str:
    """SQL for the best edit of the row itself from a grammar state."""
    late = f"CASE WHEN letter = upper(letter) THEN {LEFT_TRUNCATED} ELSE 0 END"
    ways = [_way(str(DELETE), "D", f"n{state}")]
    to = TURN[state]
    keep = " ".join(f"WHEN '{i}' THEN {_way(late, 'K', f'n{KEEP[i][state]}', 'line')}" for i in "sua" if KEEP[i][state] is not None)
    ways += [_way(f"{REROLE} + {late}", "R", f"n{to}", f"'{NAMES[to]}:' || text"), f"CASE lower(letter) {keep} ELSE {ways[0]} END"]
    return f"CASE WHEN letter = '{GONE}' THEN {ways[0]} ELSE list_min([{', '.join(ways)}]) END AS b{state}"


def _insert(state: int, rest: str) -> str:
    return _way(str(INSERT), "I", rest, f"'{NAMES[TURN[state]]}:'")


_end = {0: ("0", "''", "''"), 1: ("10", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"), 2: ("5", "'I'", "chr(10) || 'assistant:'"), 3: ("0", "''", "''")}
_starts = ", ".join(f"{{'c': CAST({c} AS BIGINT), 'a': {a}, 'r': {r}}} AS n{q}" for q, (c, a, r) in _end.items())
_space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY n) AS t FROM (
  SELECT n, list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), n) AS v FROM range(256) AS x(n))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda h, c: xor(h >> 8, t[xor(h, c) % 256 + 1]), 4294967295), 4294967295) % 20 AS luck FROM keyed, crc),
live AS (SELECT conv_id, turn, CASE WHEN luck = 4 THEN 'user' ELSE role END AS role,
  CASE luck WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, unnest(range(CASE luck WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (SELECT *, row_number() OVER w AS i, lag(role[1:1]) OVER w AS prior,
  rtrim(text, {_space}) AS core
  FROM live WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, core = '' AS blank, core <> '' AND again AS duplicate, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS truncated,
  role || ':' || text AS line, CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS known
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed)),
lettered AS (SELECT *, CASE WHEN blank OR duplicate THEN '{GONE}' WHEN truncated THEN upper(known) ELSE known END AS letter FROM judged),
counts AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
  CAST(sum(blank::INT) AS BIGINT) AS blank, CAST(sum(duplicate::INT) AS BIGINT) AS duplicate, CAST(sum(truncated::INT) AS BIGINT) AS truncated,
  CAST(sum((i > 1 AND prior || role[1:1] NOT IN ('su', 'ua', 'au'))::INT) AS BIGINT) AS illegal FROM lettered GROUP BY conv_id),
path AS (SELECT conv_id, n AS i, {_starts} FROM counts
 UNION ALL
 SELECT conv_id, i, list_min([b0, {_insert(0, "n2")}]) AS n0, list_min([b1, {_insert(1, "n2")}]) AS n1, n2, n3 FROM (
  SELECT conv_id, i, b0, b1, list_min([b2, {_insert(2, "b3")}]) AS n2, list_min([b3, {_insert(3, "b2")}]) AS n3 FROM (
   SELECT p.conv_id, p.i - 1 AS i, {", ".join(map(_best, range(4)))}
   FROM path p JOIN lettered l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i)))
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
 coalesce(illegal, 0) AS illegal, CAST(coalesce(n0.c, 0) AS BIGINT) AS cost, coalesce(n0.a, '') AS audit, sha256(coalesce(n0.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN path p ON p.conv_id IS NOT DISTINCT FROM d.conv_id AND p.i = 0
"""
