"""The duplicate cascade against a plain greedy version, and folding and redaction on literals."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltline.functions.text import casefold, dedup_normal, redact
from siltline.operators import linkage, sketch
from siltline.plans import cascade, crawl

ORDERS = sketch.probe_orders()


def plain_signature(text):
    """Slot minima and borrowed values, one gram and one slot at a time."""
    slots = [-1] * 128
    for i in range(max(1, len(text) - 4)):
        h = zlib.crc32(text[i : i + 5].encode())
        slots[h % 128] = h // 128 if slots[h % 128] < 0 else min(slots[h % 128], h // 128)
    for j, order in enumerate(ORDERS):
        if slots[j] < 0:
            slots[j] = next(slots[d] for d in order if slots[d] >= 0)
    return slots


def test_batch_signatures_equal_plain_ones():
    rng = random.Random(1)
    letters = ["a", "b", "c ", "the ", "é", "漢", "🎈", "\n", "x" * 30, "ß"]
    texts = ["", "a", "abcd", "abcde", "é漢", "🎈" * 4, *("".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(150)), "long " * 300_000]
    got = sketch.batch_signatures(texts, ORDERS)
    for t, row in zip(texts[:-1], got):
        assert row.tolist() == (plain_signature(t) if t else [-1] * 128)
    assert got[-1].tolist() == plain_signature(texts[-1][:60]) and sketch.batch_signatures([], ORDERS).shape == (0, 128)


def test_signatures_come_in_small_frames():
    texts = [None if i % 7 == 0 else f"text number {i}" for i in range(2500)]
    frames = list(sketch.signature_frames(iter([pd.DataFrame({"key": range(2500), "text": texts})])))
    assert max(map(len, frames)) <= 1024
    got = pd.concat(frames)
    assert got["key"].tolist() == list(range(2500))
    for t, s, p in zip(texts, got["sig"], got["packed"]):
        assert (s is None) == (p is None) == (t is None)
    for i in (1, 1025, 2498):
        assert got["sig"].iloc[i].tolist() == plain_signature(texts[i])


def plain_links(sig, held, places, most):
    """The rounds of the linkage module with all groups of a band in one cell, on sets and loops."""
    of, members, holds = {k: k for k in sig}, {k: [k] for k in sig}, {p: set(ks) for p, ks in places.items()}
    apart = lambda a, b: sum(x != y for x, y in zip(sig[a], sig[b]))
    while live := {min(p for p in holds if holds[p] == g): g for g in holds.values() if len(g) > 1}:
        choice = {}
        for p, gs in sorted(live.items(), key=lambda x: (-len(x[1]), x[0])):
            for g in gs:
                choice.setdefault(g, p)
        into = {}
        for p in set(choice.values()):
            clusters = []
            for g in sorted(x for x in choice if choice[x] == p):
                near = sorted((apart(c, g), c) for c in clusters)
                fit = [c for d, c in near if all(apart(x, y) <= most for x in members[c] for y in members[g]) and not (held & set(members[c]) and held & set(members[g]))]
                if fit:
                    into[g] = fit[0]
                    members[fit[0]] = members[fit[0]] + members[g]
                else:
                    clusters.append(g)
        done = [p for p, gs in live.items() if all(choice[g] == p for g in gs)]
        holds = {p: {into.get(g, g) for g in gs} for p, gs in live.items() if p not in done}
        of = {k: into.get(g, g) for k, g in of.items()}
    return of


def plain_groups(texts, cosines, places):
    """Groups of ids by the rules of the three tiers, on plain sets and loops."""
    norm = {i: " ".join(t.lower().split()) for i, t in texts.items()}
    copies = {}
    for i in sorted(texts):
        copies.setdefault(norm[i], []).append(i)
    keys = sorted(ids[0] for ids in copies.values())
    held = {k for k in keys if len(copies[norm[k]]) > 1}
    of = {k: k for k in keys} | plain_links({k: plain_signature(norm[k]) for k in keys if norm[k]}, held, places, 19)
    first = {i: ids[0] for ids in copies.values() for i in ids}
    pairs = {}
    for a, b, s in cosines:
        x, y = sorted((first[a], first[b]))
        if x != y:
            pairs[x, y] = max(s, pairs.get((x, y), 0.0))
    members = {}
    for k, g in of.items():
        members.setdefault(g, []).append(k)
    for (a, b), _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        x, y = sorted((of[a], of[b]))
        free = [g for g in (x, y) if len(members[g]) == 1 and g not in held]
        if x != y and free and all((min(p, q), max(p, q)) in pairs for p in members[x] for q in members[y]):
            members[x] += members.pop(y)
            of |= dict.fromkeys(members[x], x)
    grown = {g: [i for k in ks for i in copies[norm[k]]] for g, ks in members.items()}
    return {tuple(sorted(ids)) for ids in grown.values() if len(ids) > 1}


def found_places(spark, sigs):
    out = {}
    for r in linkage.places(sigs).collect():
        out.setdefault(r.place, []).append(r.key)
    return out


def test_cascade_equals_plain_groups(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(40)) for _ in range(8)]
    texts = {}
    for i in range(120):
        words = rng.choice(pool).split()
        for _ in range(rng.choice([0, 0, 0, 1, 2, 4])):
            words[rng.randrange(40)] = f"n{rng.randrange(99)}"
        texts[i] = " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)
    texts |= {200: "only one", 201: "other words", 202: "third thing", 203: "  ", 204: ""}
    cosines = [(200, 201, 0.95), (201, 202, 0.93), (5, 200, 0.91)]
    posts = spark.createDataFrame([(i, t, "") for i, t in texts.items()], "id long, title string, body string")
    got = cascade.cascade(posts, spark.createDataFrame(cosines, "a long, b long, cosine double")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.grp, []).append(r.id)
    assert len({r.id for r in got}) == len(got) and all(min(ids) == g for g, ids in groups.items())
    keyed = spark.createDataFrame([(k, " ".join(t.lower().split())) for k, t in sorted(texts.items(), reverse=True)], "key long, text string").groupBy("text").agg(F.min("key").alias("key"))
    want = plain_groups(texts, cosines, found_places(spark, sketch.signatures(keyed)))
    assert {tuple(sorted(x)) for x in groups.values()} == want and len(want) > 8
    by_id = {r.id: r for r in got}
    assert by_id[203].method == "exact" and by_id[203].similarity is None and by_id[201].joined == "semantic"
    assert {r.method for r in got} == {"exact", "minhash", "semantic"}


def linked(spark, sig, held, cell, keep=64, parts=False):
    rows = [(k, k in held, [int(x) for x in s], np.array(s, "<i4").tobytes()) for k, s in sig.items()]
    items = linkage.written(spark.createDataFrame(rows, "key long, held boolean, sig array<long>, packed binary"), "items")
    return items, {r.key: r.grp for r in linkage.near_links(items, cell=cell, keep=keep, parts=parts).collect()}


def variants(rng, n, bases, changes):
    base = rng.integers(0, 1 << 20, (bases, 128))
    out = {}
    for k in range(n):
        s = base[rng.integers(bases)].copy()
        at = rng.integers(0, 128, rng.integers(0, changes + 1))
        s[at] = rng.integers(0, 1 << 20, len(at))
        out[k * 3 + 1] = s
    return out


@pytest.mark.parametrize("changes", [12])
def test_rounds_equal_plain_rounds(spark, changes):
    rng = np.random.default_rng(changes)
    sig = variants(rng, 100, 4, changes)
    held = set(list(sig)[::11])
    items, got = linked(spark, sig, held, 1000)
    assert got == plain_links(sig, held, found_places(spark, items), 19)
    assert got == linked(spark, sig, held, 1000, 1000, parts=True)[1]


@pytest.mark.parametrize("keep", [2])
def test_small_cells_give_sound_and_full_groups(spark, keep):
    """With cells far below a band's groups, and rows that rarely hold all signatures."""
    rng = np.random.default_rng(8)
    sig = variants(rng, 70, 2, 12)
    held = set(list(sig)[::40])
    items, got = linked(spark, sig, held, 10, keep)
    groups = {}
    for k, g in got.items():
        groups.setdefault(g, []).append(k)
    s = np.array([sig[k] for k in sig])
    far = dict(zip(sig, (dict(zip(sig, row)) for row in linkage.distances(s, s).tolist())))
    fits = lambda x, y: all(far[a][b] <= 19 for a in x for b in y) and len(held & {*x, *y}) < 2
    assert all(min(ks) == g and fits(ks, ks) for g, ks in groups.items())
    band = {}
    for p, ks in found_places(spark, items).items():
        band[p] = {got[k] for k in ks}
    assert not any(fits(groups[a], groups[b]) for gs in band.values() for a in gs for b in gs if a < b)
    assert max(map(len, groups.values())) > 20


def test_a_template_of_many_variants(spark):
    sig = variants(np.random.default_rng(2), 1200, 1, 6)
    _, got = linked(spark, sig, set(), 128)
    assert set(got.values()) == {1}


def test_cascade_of_an_empty_table(spark):
    none = spark.createDataFrame([], "id long, title string, body string")
    assert cascade.cascade(none).count() == 0


@pytest.mark.parametrize(
    "raw, kept",
    [
        ("alice9:hunter22@proxy.example:8080", "alice9:[REDACTED]@proxy.example:8080"),
        ("bot123456789:" + "A" * 35, "bot123456789:[REDACTED]"),
        ("123456789:" + "b" * 35 + ".", "123456789:[REDACTED]."),
        ("Authorization: Bearer abcdefghijklmnop1", "Authorization: Bearer [REDACTED]"),
        ("nothing to hide: 12", "nothing to hide: 12"),
    ],
)
def test_redaction_keeps_names(spark, raw, kept):
    assert spark.range(1).select(redact(F.lit(raw))).first()[0] == kept


def test_folding_and_blanks_are_unicode(spark):
    texts = ["Straße  ﬁn", "ΣΊΣΥΦΟΣ", "ŉ ǰ ẞ", "x y　z", "plain", "İx", "ᾀ K", "one\nEDIT: two", "one\neditor"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.f, r.n) for r in df.select("i", casefold(F.col("t")).alias("f"), dedup_normal(F.col("t")).alias("n")).collect()}
    assert [got[i][0] for i in range(9)] == [t.casefold() for t in texts]
    assert [got[i][1] for i in (0, 3, 7, 8)] == ["strasse fin", "x y z", "one", "one editor"]


def test_site_texts_are_joined_and_cut(spark):
    rows = [("a", 2, "second"), ("a", 1, "first"), ("a", 3, "third"), ("b", 4, "x" * 50)]
    got = {r.site: r.text for r in crawl.joined_texts(spark.createDataFrame(rows, "site string, page_id long, text string"), 17).collect()}
    assert got == {"a": "first\n\nsecond\n\nth", "b": "x" * 17}


def test_joined_texts_over_ranges_of_ids(spark):
    """Pages of a site on both sides of 4,096 ids, against joining in a loop."""
    from siltline.plans import crawl

    rows = [("a", i * 700, "t" * (i % 5 + 1) + str(i)) for i in range(40)] + [("b", 9_000, "x" * 200), ("b", 1, ""), (None, 5, "n")]
    got = {r.site: r.text for r in crawl.joined_texts(spark.createDataFrame(rows, "site string, page_id long, text string"), 150).collect()}
    assert got == {s: "\n\n".join(t for g, _, t in sorted(rows, key=lambda r: r[1]) if g == s)[:150] for s in ("a", "b", None)}



def test_session_windows_against_plain_python(spark):
    from siltline.plans import reports

    d = "/root/testdata/sf0.001"
    rows = sorted((r.user_id, r.ts) for r in spark.read.parquet(f"{d}/events.parquet").select("user_id", "ts").collect())
    want, last = {}, None
    for user, ts in rows:
        if last and last[0] == user and (ts - last[2]).total_seconds() < 1800:
            last = (user, last[1], ts)
        else:
            last = (user, ts, ts)
        want[user, last[1]] = want.get((user, last[1]), 0) + 1
    assert {(r.user_id, r.start): r.n for r in reports.session_windows(spark, d).collect()} == want


def test_page_text_against_the_parser(spark):
    from siltline.plans import sites
    from siltline.sources import html

    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        title, text, _, labels = html.read_page(r.html)
        want[r.page_id] = (title, len(text), hashlib.sha256(text.encode()).hexdigest(), "|".join(labels))
    assert {r.page_id: (r.title, r.n, r.fingerprint, r.labels) for r in sites.page_text(spark, d).collect()} == want


def test_the_cursor_does_not_depend_on_batches():
    """Folding a channel's log in any cuts gives the cursor of one batch."""
    import pandas as pd

    from siltline.plans.streams import advanced

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    rng = np.random.default_rng(4)
    log = pd.DataFrame({"second": np.sort(rng.integers(0, 90_000, 80)), "event_type": rng.choice(["error", "view"], 80)})
    whole = list(advanced((1,), iter([log]), State()))[0]
    for cuts in ([40], [1, 2, 3], list(range(5, 80, 5))):
        state, last = State(), None
        for part in np.split(np.arange(80), cuts):
            last = list(advanced((1,), iter([log.iloc[part]]), state))[0]
        assert np.allclose(last.to_numpy(float), whole.to_numpy(float))


def test_parts_of_many_items_take_one_task(spark, monkeypatch):
    """A part above a cell's size makes no written rounds, and gives what plain rounds give."""
    sig = variants(np.random.default_rng(12), 260, 2, 12)
    names = []
    keep = linkage.written
    monkeypatch.setattr(linkage, "written", lambda df, name: names.append(name) or keep(df, name))
    items, got = linked(spark, sig, set(list(sig)[::50]), linkage.CELL, linkage.KEEP, parts=True)
    assert "stood" not in names
    assert got == plain_links(sig, set(list(sig)[::50]), found_places(spark, items), 19)


def test_cosines_of_the_cascade_are_made_once(spark, monkeypatch):
    names = []
    keep = cascade.written
    monkeypatch.setattr(cascade, "written", lambda df, name: names.append(name) or keep(df, name))
    posts = spark.createDataFrame([(1, "one thing", ""), (2, "other words", "")], "id long, title string, body string")
    got = cascade.cascade(posts, spark.createDataFrame([(1, 2, 0.95)], "a long, b long, cosine double")).collect()
    assert "cosines" in names and {(r.id, r.grp, r.method) for r in got} == {(1, 1, "semantic"), (2, 1, "semantic")}


def plain_cosine_links(of, held, cosines):
    """Best pairs first, one at a time, on plain sets: the groups, and who came late."""
    of, late = dict(of), set()
    members = {}
    for k, g in of.items():
        members.setdefault(g, []).append(k)
    known = {(a, b) for a, b, _ in cosines}
    for a, b, _ in sorted(cosines, key=lambda p: (-p[2], p[0], p[1])):
        x, y = sorted((of[a], of[b]))
        free = [g for g in (x, y) if len(members[g]) == 1 and g not in held]
        if x != y and free and all((min(p, q), max(p, q)) in known for p in members[x] for q in members[y]):
            late |= set(free)
            members[x] += members.pop(y)
            of |= dict.fromkeys(members[x], x)
    return {k: (g, k in late) for k, g in of.items()}


@pytest.mark.parametrize("wide", [linkage.WIDE, 20, 0])
def test_cosine_links_equal_plain_ones(spark, wide):
    """Cliques with gaps, chains, equal cosines, held items and groups; in tasks and in written rounds."""
    rng = random.Random(5)
    of, cosines, held = {}, {}, set()
    for c, (n, share) in enumerate([(30, 1.0), (25, 0.9), (18, 0.6), (40, 0.15), (2, 1.0), (9, 1.0)]):
        keys = [c * 100 + i for i in range(n)]
        rng.shuffle(keys)
        of |= {k: k for k in keys}
        held |= set(rng.sample(keys, n // 8))
        near = sorted(rng.sample(keys, n // 4))  # a group of the near tier
        of |= dict.fromkeys(near, near[0]) if c != 4 else {}
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                if rng.random() < share or {a, b} <= set(near):
                    cosines[min(a, b), max(a, b)] = round(rng.uniform(0.9, 1.0), 2 if c % 2 else 6)
    of |= {k: k for k in range(900, 930)}
    cosines |= {(k, k + 1): 0.9 + k / 10_000 for k in range(900, 929)}  # a chain, the best pair last
    held = {k for k in held if list(of.values()).count(of[k]) == 1 or of[k] == k}
    rows = [(a, b, c) for (a, b), c in cosines.items()]
    near = spark.createDataFrame(list(of.items()), "key long, grp long")
    marks = spark.createDataFrame([(k, k in held) for k in of], "key long, held boolean")
    got = linkage.cosine_links(near, marks, spark.createDataFrame(rows, "a long, b long, cosine double"), wide)
    want = plain_cosine_links(of, held, rows)
    assert {r.key: (r.grp, r.late) for r in got.collect()} == want
    assert sum(late for _, late in want.values()) > 50


def test_a_long_chain_of_cosines_needs_no_rounds(spark, monkeypatch):
    """Each pair but the last is better than the one before, so one pair at a time would join in rounds."""
    names = []
    keep = linkage.written
    monkeypatch.setattr(linkage, "written", lambda df, name: names.append(name) or keep(df, name))
    n = 600
    rows = [(k, k + 1, 0.9 + k / 10_000) for k in range(n - 1)]
    near = spark.range(n).selectExpr("id AS key", "id AS grp")
    got = linkage.cosine_links(near, near.selectExpr("key", "false AS held"), spark.createDataFrame(rows, "a long, b long, cosine double"))
    assert {r.key: (r.grp, r.late) for r in got.collect()} == {k: (k - k % 2, True) for k in range(n)}
    assert names.count("moves") == 1


def test_texts_of_the_cascade_are_normalised_once(spark, monkeypatch):
    """Also where an id comes twice, with one text or with another."""
    names = []
    keep = cascade.written
    monkeypatch.setattr(cascade, "written", lambda df, name: names.append(name) or keep(df, name))
    posts = spark.createDataFrame([(1, "One  thing", ""), (1, "one thing", ""), (2, "other words", ""), (3, "ONE thing", "")], "id long, title string, body string")
    got = cascade.cascade(posts).collect()
    assert names.count("normal") == 1 and sorted((r.id, r.grp, r.method) for r in got) == [(1, 1, "exact"), (1, 1, "exact"), (3, 1, "exact")]
