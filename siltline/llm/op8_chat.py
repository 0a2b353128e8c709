"""Chat formatting at token level.

Every turn's role and text are encoded apart and reserved ids, which no text can encode to,
are spliced around them. The loss mask is the prefix sum of +1 and -1 marks at the ends of
assistant texts. Control strings that occur inside a text get a backslash after their first
character (backslashes are doubled), so the rendered text is unambiguous as well. Turns are
encoded where they are read, then dealt by conversation and streamed in turn order, in parts
of bounded size, so that a conversation of any length is never held whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, table, tidy, written
from .op10_packing import encoder

#: Reserved ids follow the vocabulary's 50,257 in this order.
FIRST_ID = 50257
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "<|end|>")
ROLES = {"assistant": (0, 1), "user": (2, 3), "system": (4, 5)}
OTHER, TEXT, END = 6, 7, 8
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(\\?)")
#: Tokens after which a part of a conversation ends.
PART = 1 << 18


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_tokens(role: str, text: str) -> tuple[np.ndarray, int, int]:
    """(ids, start, end) of a turn; its text's ids lie from start to end."""
    enc = encoder()
    body = np.frombuffer(enc.encode(escape(text)), "<u4")
    if role in ROLES:
        a, z = ROLES[role]
        head, tail = [FIRST_ID + a], FIRST_ID + z
    else:
        name = np.frombuffer(enc.encode(escape(role)), "<u4").tolist()
        head, tail = [FIRST_ID + OTHER, *name, FIRST_ID + TEXT], FIRST_ID + END
    ids = np.concatenate([np.array(head, "<u4"), body, np.array([tail], "<u4")]).astype("<u4")
    return ids, len(head), len(head) + len(body)


def read_turns(ids: np.ndarray) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn in ids; text is unescaped."""
    bpe = encoder().bpe
    marks = np.flatnonzero(ids >= FIRST_ID)
    kinds = (ids[marks] - FIRST_ID).tolist()
    text = lambda a, z: unescape(bpe.decode_bytes(ids[a:z].tolist()).decode())
    opened = {a: role for role, (a, _) in ROLES.items()}
    i = 0
    while i < len(marks):
        if kinds[i] in opened:
            role = opened[kinds[i]]
        else:
            role = text(marks[i] + 1, marks[i + 1])
            i += 1
        a, z = int(marks[i]) + 1, int(marks[i + 1])
        yield role, text(a, z), a, z
        i += 2


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, part, ids, mask): token ids (little-endian 32 bits) and loss mask (a byte each) of
    every conversation, in parts that end between turns.

    turns: conv_id, turn, role, text. Null text and role are empty; null turns come first, equal
    turns are ordered by role and text, repeated rows are repeated turns; rows without conv_id
    are one conversation without id. Partitions hold whole conversations in part order.
    """
    batched(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, turn {turns.schema['turn'].dataType.simpleString()}, role string, text string, ids binary, first int, last int"
    schema = arrow_schema(ddl)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [turn_tokens(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            cols = [*b.columns, pa.array([x[0].tobytes() for x in got], pa.binary())]
            cols += [pa.array([x[i] for x in got], pa.int32()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    coded = turns.select("conv_id", "turn", empty("role"), empty("text")).mapInArrow(tidy(encode), ddl)
    ordered = coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn", "text")
    out_ddl = f"conv_id {kind}, part int, ids binary, mask binary"
    out = arrow_schema(out_ddl)

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, held, marks, n = None, -1, [], [], 0

        def flush() -> pa.RecordBatch:
            steps = np.zeros(n + 1, np.int8)
            for at, by in marks:
                steps[at] += by
            row = [[conv], [part], [b"".join(held)], [np.cumsum(steps[:n]).astype(np.int8).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, out, strict=True)], schema=out)

        for b in batches:
            for c, role, ids, first, last in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if part >= 0 and (c != conv or n >= PART):
                    yield flush()
                    held, marks, n = [], [], 0
                    part = part + 1 if c == conv else 0
                part = max(part, 0)
                conv = c
                if role == "assistant":
                    marks += [(n + first, 1), (n + last, -1)]
                held.append(ids)
                n += len(ids) // 4
        if part >= 0:
            yield flush()

    return ordered.mapInArrow(tidy(assemble), out_ddl)


def digests(parts: DataFrame) -> DataFrame:
    """What a reader of formatted() output sees of each conversation; parts as formatted() gives,
    in any order. Parts of a conversation are read in order by one task, one part at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, bpe = None, None, encoder().bpe

        def row() -> pa.RecordBatch:
            n, turns, chars, loss, shown, tokens = state
            values = [conv, n, turns.hexdigest(), chars, loss.hexdigest(), shown, tokens]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for b in batches:
            for c, _, raw, mask_ in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if state and c != conv:
                    yield row()
                    state = None
                state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                conv, ids, mask = c, np.frombuffer(raw, "<u4"), np.frombuffer(mask_, np.int8)
                for role, text, a, z in read_turns(ids):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                # the loss text comes from the mask alone: its runs are whole escaped texts
                edge = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
                for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    text = unescape(bpe.decode_bytes(ids[a:z].tolist()).decode())
                    state[2] += len(text)
                    state[3].update(text.encode())
                special = ids >= FIRST_ID
                state[4] += sum(len(CONTROLS[i]) for i in (ids[special] - FIRST_ID).tolist())
                state[4] += len(bpe.decode_bytes(ids[~special].tolist()).decode())
                state[5] += len(ids)
        if state:
            yield row()

    ordered = parts.select("conv_id", "part", "ids", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(tidy(run), ddl)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "SELECT -7L AS conv_id, t.* FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(own))
    return digests(written(formatted(turns), "formatted")).drop("n_tokens")


def _shown(column: str) -> str:
    """SQL for the characters of a column once escaped: backslashes and control strings gain one."""
    controls = "|".join(re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True))
    return f"length({column}) + length({column}) - length(replace({column}, '\\', '')) + len(regexp_extract_all({column}, '{controls}'))"


_marks = " ".join(f"WHEN '{r}' THEN {len(CONTROLS[a]) + len(CONTROLS[z])}" for r, (a, z) in ROLES.items())
_other = len(CONTROLS[OTHER] + CONTROLS[TEXT] + CONTROLS[END])
SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({_shown("text")} + CASE role {_marks} ELSE {_other} + {_shown("role")} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
