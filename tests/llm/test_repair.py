"""Conversation repair against a search over all audits, and its SQL on hard rows."""

import hashlib
import zlib
from functools import cache
from itertools import product

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltline.llm import op11_repair

SPACE = "\t\n\x0b\x0c\r "


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        luck = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if luck == 1:
            text = ""
        if luck == 2:
            text = "".join(c for c in text if c not in ".!?")
        if luck == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(luck, 1)
    return out


def search(rows):
    """The least (cost, audit, lines) over all edits: rows are (role, text, fault)."""

    @cache
    def best(i, state, inserts):
        # state: roles so far as the grammar sees them; (cost, audit, lines)
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        step = lambda role: {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(role) >= 0 and role
        add = lambda cost, letter, line, rest: ways.append((cost + rest[0], letter + rest[1], line + rest[2]))
        if inserts < 3:
            for role in ("user", "assistant"):
                if step(role[0]):
                    add(5, "I", (f"{role}:",), best(i, role[0], inserts + 1))
        if i < len(rows):
            role, text, fault = rows[i]
            add(2, "D", (), best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                late = 5 if fault == "truncated" else 0
                if role[:1] and step(role[:1]):
                    add(late, "K", (f"{role}:{text}",), best(i + 1, role[:1], 0))
                for new in ("user", "assistant"):
                    if step(new[0]):
                        add(1 + late, "R", (f"{new}:{text}",), best(i + 1, new[0], 0))
        return min(ways, default=(10**6, "", ()))

    return best(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = sorted((r for r in plain_damage(table) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in rows if r[1] is not None]
        found = faults([r[2:] for r in rows])
        ini = [r[2][:1] for r in rows]
        cost, audit, lines = search(tuple((r[2], r[3], f) for r, f in zip(rows, found)))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        out[conv] = (conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


ROLES = ["user", "assistant", "system", "tool", "", None, "unknown"]
TEXTS = ["Yes.", "Yes", "", " \n", "No!", None, "é?  ", "a\x0bb", "\xa0", "Yes. "]
HARD = [(c, t, ROLES[(c * 7 + t * t * 3 + t) % 7], TEXTS[(c * c + t * 5) % 10]) for c in range(120) for t in range(c % 9)]
HARD += [(500, t, ("user", "assistant")[t % 2], f"text {t % 5}.") for t in range(0, 60, 3)]
HARD += [(501, None, "user", "One."), (501, None, "user", "One."), (501, 4, "user", "One."), (501, 4, "assistant", "Two."), (501, 4, "assistant", "Two."), (502, None, None, None)]
HARD += [(None, 1, "user", "Of none."), (None, None, "assistant", "Of none.")] + [(c, 0, "user", "x") for c in range(600, 720)]


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("turns")
    df = spark.createDataFrame([(*r, "x", 1, True) for r in HARD], "conv_id long, turn long, role string, text string, letter string, n int, first boolean")
    df.repartition(5).write.parquet(f"{path}/conversations.parquet")
    rows = op11_repair.op11_repair(spark, str(path))
    assert rows.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return path, [tuple(r) for r in rows.collect()]


def test_query_equals_search(got):
    want = plain(HARD)
    assert len(got[1]) == len(want)
    assert {r[0]: r for r in got[1]} == want
    assert any(not r[7] and not r[6] for r in got[1]) and {"D", "K", "R"} <= set("".join(r[7] for r in got[1]))


def test_sql_equals_query(got):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{got[0]}/conversations.parquet/*.parquet'")
    key = lambda r: str(r)
    assert sorted(con.sql(op11_repair.SQL).fetchall(), key=key) == sorted(got[1], key=key)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("suaoSUAx", max_size=9), min_size=1, max_size=8))
def test_suffixes_equal_search(words):
    solved = op11_repair.Suffixes()
    for back in sorted(w[::-1] for w in words):
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool"), "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in back[::-1]]
        cost, audit, _ = search(tuple(rows))
        assert solved.solve(back) == (audit, cost)


def test_few_classes_for_all_words():
    solved = op11_repair.Suffixes()
    for back in sorted("".join(w) for n in range(6) for w in product("suaoSUAOx", repeat=n)):
        solved.solve(back)
    seen = len(solved.automaton.nodes)
    for back in sorted("".join(w) for w in product("suSxA", repeat=7)):
        solved.solve(back)
    assert len(solved.automaton.nodes) == seen < 400


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"row {t}.") for t in range(30000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = op11_repair.repairs(df).first()
    live = plain_damage(rows)
    assert len(r.audit.replace("I", "")) == len(live) and r.cost >= 2 * (r.blank + r.duplicate) + r.audit.count("R")
    assert op11_repair.repairs(df.limit(0)).count() == 0


def test_copies_beyond_counts(spark):
    df = spark.createDataFrame([(1, 0, "user", "Same.")] * 5000 + [(1, 1, "assistant", "End.")], "conv_id long, turn long, role string, text string")
    rows = op11_repair.counted(df.selectExpr("*", "1L AS n"))
    assert rows.count() == 2
    word = op11_repair.words(op11_repair.lettered(rows)).first()
    assert word.word == "u" + "x" * 4999 + "a" and (word.duplicate, word.illegal, word.gaps) == (4999, 4999, 0)
