"""Complete linkage of items in rounds, with no group, band or component in one task.

Items that share a band may be similar; a group is sound only if all its members are. In each
round every group stands under one of its bands, the one that most groups hold, in a cell of a
bounded number of groups. A cell takes its groups by their first item: each joins the cell's
nearest cluster all of whose members it resembles, or opens one. As a group stands in one cell,
a round's joins never conflict, and a band that thousands of groups hold shrinks by about a
cell's size a round. A band whose groups all stood in one cell has nothing left to join, now or
later: what was once too far stays so when it grows.

A cell sees all signatures of a group while there are few; of a larger group it sees the first
item's, a hub in the middle and the distance from it to the farthest member. By the triangle inequality these mostly decide;
where they do not, the members of both groups are compared in blocks.

Rounds of different connected parts know nothing of each other. Parts of at most PART items, which
nearly all are, go through all theirs inside one task, several parts to a task; others, whatever
their size, through written rounds. Inside a task all groups of a band stand in one cell and all
signatures are at hand (8 MB), so the result is that of written rounds with so large a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import sketch
from .sketch import SLOTS, THRESHOLD

#: Groups of one cell, signatures that a group's row holds at most, items of a block of members.
CELL, KEEP, BLOCK = 256, 256, 512
#: Items of a part whose rounds one task does.
PART = 16384
#: Steps in which a part's smallest item makes itself known.
STEPS = 4
#: Groups of a part whose pairs by cosine one task goes through, at a bit a pair (128 MB).
WIDE = 32768
EXACT, NEAR, SEMANTIC = "exact", "minhash", "semantic"
_GROUP = "held boolean, radius int, sigs binary, whole boolean"


def budget(threshold: float) -> int:
    """The most slots in which two similar signatures differ."""
    return max(d for d in range(SLOTS + 1) if (SLOTS - d) / SLOTS >= threshold)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing slots of every signature of x and every one of y."""
    return np.stack([(x != row).sum(axis=1) for row in y], axis=1)


class Cluster:
    """A group's row: its number, whether it is held, its signatures (its first item's first) while
    it is whole; later its first item's, its hub (the commonest value of each slot when it ceased to
    be whole), and how far its farthest member is from the hub."""

    def __init__(self, row: tuple) -> None:
        self.grp, self.held, self.radius, packed, self.whole = row
        self.sigs = np.frombuffer(packed, "<i4").reshape(-1, SLOTS)

    @property
    def hub(self) -> np.ndarray:
        return self.sigs[1]

    def reach(self, hub: np.ndarray) -> int:
        """A bound of the distance of any member to hub; exact for whole groups."""
        if self.whole:
            return int((self.sigs != hub).sum(axis=1).max())
        return int((self.hub != hub).sum()) + self.radius

    def meets(self, other: Cluster, most: int) -> bool | None:
        """Whether all members of both are similar; None where the rows cannot tell."""
        far = int((self.sigs[0] != other.sigs[0]).sum())
        if far > most or self.held and other.held:  # two exact groups stay two
            return False
        if self.whole and other.whole:
            return int(distances(self.sigs, other.sigs).max()) <= most
        one, two = (other, self) if self.whole else (self, other)
        return True if one.radius + two.reach(one.hub) <= most else None

    def take(self, other: Cluster, keep: int = KEEP) -> None:
        self.held = self.held or other.held
        if self.whole and other.whole:
            known = {row.tobytes() for row in self.sigs}
            self.sigs = np.concatenate([self.sigs, *(row[None] for row in other.sigs if row.tobytes() not in known)])
            if len(self.sigs) > keep:
                hub = np.array([values[counts.argmax()] for values, counts in (np.unique(c, return_counts=True) for c in self.sigs.T)], "<i4")
                self.radius = self.reach(hub)
                self.whole, self.sigs = False, np.stack([self.sigs[0], hub])
            return
        hub = other.hub if self.whole else self.hub
        own = self.reach(hub) if self.whole else self.radius
        self.radius = max(own, other.radius if self.whole else other.reach(hub))
        self.whole, self.sigs = False, np.stack([self.sigs[0], hub])

    def row(self) -> tuple:
        return self.held, self.radius, self.sigs.astype("<i4").tobytes(), self.whole


def cell_joins(rows: list[tuple], most: int, keep: int = KEEP) -> tuple[list[Cluster], list[tuple[int, int]], list[tuple[int, int]]]:
    """Clusters of the groups of a cell, (group, its cluster) of all, and pairs left undecided."""
    clusters: list[Cluster] = []
    joins, maybe = [], []
    firsts = np.empty((len(rows), SLOTS), "<i4")  # a cluster's first signature stays its first
    for group in sorted(map(Cluster, rows), key=lambda c: c.grp):
        far = (firsts[: len(clusters)] != group.sigs[0]).sum(axis=1)
        for _, grp, i in sorted((int(far[i]), clusters[i].grp, i) for i in np.flatnonzero(far <= most).tolist()):
            fits = clusters[i].meets(group, most)
            if fits:
                clusters[i].take(group, keep)
                joins.append((group.grp, grp))
                break
            if fits is None:
                maybe.append((grp, group.grp))
        else:
            firsts[len(clusters)] = group.sigs[0]
            clusters.append(group)
            joins.append((group.grp, group.grp))
    return clusters, joins, maybe


def _stand(cells: DataFrame, most: int, keep: int) -> DataFrame:
    """(grp, into, ...group columns of a cluster on its own row, other: a group undecided with grp)."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(cell["grp"], cell["held"], cell["radius"], cell["sigs"], cell["whole"]))
        clusters, joins, maybe = cell_joins(rows, most, keep)
        of = {c.grp: c.row() for c in clusters}
        at, blank = (cell["place"].iloc[0], cell["n"].iloc[0]), (None,) * 4
        out = [(*at, g, c, *(of[g] if g == c else blank), None) for g, c in joins] + [(*at, a, None, *blank, b) for a, b in maybe]
        frame = pd.DataFrame(out, columns=["place", "n", "grp", "into", "held", "radius", "sigs", "whole", "other"])
        return frame.astype({"into": "Int64", "radius": "Int32", "held": "boolean", "whole": "boolean", "other": "Int64"})

    return cells.groupBy("place", "cell").applyInPandas(run, f"place long, n long, grp long, into long, {_GROUP}, other long")


def _sweep(cells: DataFrame, most: int) -> DataFrame:
    """(place, a, b, far, sure) of the groups of a crowded band that may join: every two of its cells meet."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        left = cell["mine"] == cell["p"]
        right = cell["mine"] == cell["q"]
        make = lambda part: [Cluster(r) for r in zip(part["grp"], part["held"], part["radius"], part["sigs"], part["whole"])]
        out = []
        for x in make(cell[left]):
            for y in make(cell[right]):
                if x.grp != y.grp and not (left.equals(right) and x.grp > y.grp):
                    fits = x.meets(y, most)
                    if fits is not False:
                        far = int((x.sigs[0] != y.sigs[0]).sum())
                        out.append((cell["place"].iloc[0], min(x.grp, y.grp), max(x.grp, y.grp), far, fits is True))
        return pd.DataFrame(out, columns=["place", "a", "b", "far", "sure"]).astype({"place": "int64", "a": "int64", "b": "int64", "far": "int32", "sure": "bool"})

    return cells.groupBy("place", "p", "q").applyInPandas(run, "place long, a long, b long, far int, sure boolean")


def similar_members(pairs: DataFrame, of: DataFrame, sigs: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of groups all of whose members are similar; members meet block by block."""
    wanted = pairs.select(F.col("a").alias("grp")).union(pairs.select("b")).distinct()
    members = of.join(wanted, "grp").join(sigs.select("key", "packed"), "key")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"))
    dealt = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)))
    blocks = dealt.groupBy("grp", "block").agg(F.array_join(F.collect_set(F.hex("packed")), "").alias("hexed")).select("grp", F.unhex("hexed").alias("sigs"))
    met = pairs.select("a", "b").join(blocks.toDF("a", "x"), "a").join(blocks.toDF("b", "y"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = ((np.frombuffer(x, "<i4").reshape(-1, SLOTS), np.frombuffer(y, "<i4").reshape(-1, SLOTS)) for x, y in zip(batch["x"], batch["y"]))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "far": [int(distances(x, y).max()) for x, y in parts]})

    worst = met.mapInPandas(run, "a long, b long, far int").groupBy("a", "b").agg(F.max("far").alias("far"))
    return worst.where(F.col("far") <= most).select("a", "b")


def mutual(pairs: DataFrame, *order: F.Column) -> DataFrame:
    """(grp, into): pairs (a, b), a < b, in which each is the other's first by order, a strict order."""
    both = pairs.select("a", "b", *(c.alias(f"o{i}") for i, c in enumerate(order)))
    rank = F.struct(*(f"o{i}" for i in range(len(order))), "a", "b")
    ends = both.select(F.col("a").alias("end"), rank.alias("r")).union(both.select("b", rank))
    first = ends.groupBy("end").agg(F.min("r").alias("r")).select("r.a", "r.b")
    return first.groupBy("a", "b").count().where("count = 2").select(F.col("b").alias("grp"), F.col("a").alias("into"))


def _unlike(holds: DataFrame) -> DataFrame:
    """holds (place, grp) of places that several groups hold, one of those that the same groups hold:
    what stood together under one need not under another."""
    marks = [F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("grp", F.lit(i))).alias(f"h{i}") for i in (0, 1))]
    kinds = holds.groupBy("place").agg(*marks).where("n > 1")
    return holds.join(kinds.groupBy("n", "h0", "h1").agg(F.min("place").alias("place")).select("place", "n"), "place")


def places(sigs: DataFrame) -> DataFrame:
    """(place, key): the bands that several items share; place is a hash of the band's slots."""
    bands = sketch.band_rows(sigs).select(F.xxhash64("band", "hash").alias("place"), "key")
    crowded = bands.groupBy("place").agg(F.count("*").alias("n")).where("n > 1").select("place")
    return bands.join(crowded, "place")


def _moved(rows: DataFrame, moves: DataFrame, column: str = "grp") -> DataFrame:
    """rows with the group in column replaced by what it went into."""
    step = moves.select(F.col("grp").alias(column), "into")
    return rows.join(step, column, "left").withColumn(column, F.coalesce("into", column)).drop("into")


def _then(moves: DataFrame, more: DataFrame) -> DataFrame:
    """One table of moves for moves and then more."""
    step = more.select(F.col("grp").alias("into"), F.col("into").alias("last"))
    return moves.join(step, "into", "left").select("grp", F.coalesce("last", "into").alias("into")).unionByName(more)


def small_parts(holds: DataFrame, keep: int) -> DataFrame:
    """(grp, part) of holds (place, grp, n) in connected parts of at most keep items, as far as
    STEPS steps from the smallest item tell."""
    step = holds.groupBy("place").agg(F.min("grp").alias("part"))
    for _ in range(STEPS):
        item = holds.join(step, "place").groupBy("grp").agg(F.min("part").alias("part"))
        step = holds.join(item, "grp").groupBy("place").agg(F.min("part").alias("part"))
    item = written(item, "parts")
    spans = holds.join(item, "grp").groupBy("place").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    torn = holds.join(spans, "place").join(item, "grp").select("part").distinct()
    fit = item.groupBy("part").agg(F.count("*").alias("c")).where(F.col("c") <= keep).join(torn, "part", "left_anti")
    return item.join(fit.select("part"), "part")


def part_rounds(items: dict[int, tuple], places: dict[int, set[int]], most: int, keep: int) -> dict[int, int]:
    """The group of every item of a part; items: key to a Cluster's row, places: place to keys."""
    of = {k: k for k in items}
    rows = dict(items)
    while True:
        seen: dict[frozenset, int] = {}
        for p, gs in places.items():
            if len(gs) > 1:
                seen[frozenset(gs)] = min(p, seen.get(frozenset(gs), p))
        live = {p: gs for gs, p in seen.items()}
        if not live:
            return of
        choice: dict[int, int] = {}
        for p in sorted(live, key=lambda p: (-len(live[p]), p)):
            for g in live[p]:
                choice.setdefault(g, p)
        stood: dict[int, list[int]] = {}
        for g, p in choice.items():
            stood.setdefault(p, []).append(g)
        into = {}
        for gs in stood.values():
            clusters, joins, _ = cell_joins([(g, *rows[g]) for g in gs], most, keep)
            rows |= {c.grp: c.row() for c in clusters}
            into |= dict(joins)
        places = {p: {into.get(g, g) for g in gs} for p, gs in live.items() if len(stood.get(p, ())) < len(gs)}
        of = {k: into.get(g, g) for k, g in of.items()}


def _in_parts(rows: DataFrame, most: int, keep: int) -> DataFrame:
    """(key, grp) of rows (part, key, held, packed, places: array)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        items = {int(k): (bool(h), 0, p, True) for k, h, p in zip(part["key"], part["held"], part["packed"])}
        places: dict[int, set[int]] = {}
        for k, at in zip(part["key"], part["places"]):
            for p in at:
                places.setdefault(int(p), set()).add(int(k))
        return pd.DataFrame(list(part_rounds(items, places, most, keep).items()), columns=["key", "grp"])

    return rows.groupBy("part").applyInPandas(run, "key long, grp long")


def near_links(items: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, keep: int = KEEP, parts: bool = True, rounds: int = 500) -> DataFrame:
    """(key, grp) of items (key, held, sig, packed), a written table: grp is the smallest key of the
    item's group; an item that shares no band with another is a group of its own.

    Two held items never meet in a group. The order of joins is the one the module states, bands
    of as many groups by place; beyond cell groups, cells are dealt by a hash of group and round.
    parts: whether parts of at most PART items go through their rounds in one task.
    Raises where rounds (far above the number needed) do not suffice.
    """
    most = budget(threshold)
    every = written(_unlike(places(items).select("place", F.col("key").alias("grp"))), "holds")
    part = small_parts(every, PART if parts else 0)
    here = every.groupBy("grp").agg(F.collect_list("place").alias("places")).join(part, "grp").withColumnRenamed("grp", "key")
    solved = written(_in_parts(here.join(items.select("key", "held", "packed"), "key"), most, max(keep, PART)), "solved")
    holds = written(every.join(solved.select(F.col("key").alias("grp")), "grp", "left_anti"), "holds")
    of = items.select("key").join(solved, "key", "left").select("key", F.coalesce("grp", "key").alias("grp"))
    if holds.isEmpty():
        return of
    linked = items.join(holds.select(F.col("grp").alias("key")).distinct(), "key", "left_semi")
    groups = written(linked.select(F.col("key").alias("grp"), "held", F.lit(0).alias("radius"), F.col("packed").alias("sigs"), F.lit(True).alias("whole")), "groups")
    for number in range(rounds):
        chosen = holds.groupBy("grp").agg(F.min_by(F.struct("place", "n"), F.struct(-F.col("n"), "place")).alias("c")).select("grp", "c.*")
        split = F.when(F.col("n") <= cell, 0).otherwise(F.pmod(F.xxhash64("grp", F.lit(number)), F.ceil(F.col("n") / cell)))
        cells = chosen.select("grp", "place", "n", split.alias("cell"))
        stood = written(_stand(cells.join(groups, "grp"), most, keep), "stood")
        seen = stood.agg(F.count("*").alias("all"), F.max("n").alias("widest"), F.sum((F.col("grp") != F.col("into")).cast("int")).alias("joined"), F.count("other").alias("maybe")).first()
        if not seen["all"]:
            return of
        moves = stood.where("grp <> into").select("grp", "into")
        groups = written(
            groups.join(stood.where("into is not null").select("grp"), "grp", "left_anti")
            .unionByName(stood.where("grp = into").select("grp", "held", "radius", "sigs", "whole")), "groups"
        )
        if seen["joined"]:
            of = written(_moved(of, moves), "of")
        # a band whose groups all stood in one cell is done
        present = stood.where("into is not null").groupBy("place", "n").agg(F.count("*").alias("m"))
        done = present.where((F.col("m") == F.col("n")) & (F.col("n") <= cell)).select("place")
        undecided = stood.where("other is not null").select("place", F.col("grp").alias("a"), F.col("other").alias("b"), F.lit(0).alias("far"), F.lit(False).alias("sure"))
        sweep = not seen["joined"] and seen["widest"] > cell
        if sweep:  # crowded bands whose cells found nothing: all their cells meet
            full = present.where((F.col("m") == F.col("n")) & (F.col("n") > cell)).select("place", "n")
            mine = F.pmod(F.xxhash64("grp"), F.ceil(F.col("n") / cell))
            side = holds.drop("n").join(full, "place").join(groups, "grp").withColumn("mine", mine)
            side = side.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / cell) - 1)))
            side = side.withColumn("p", F.least("mine", "t")).withColumn("q", F.greatest("mine", "t"))
            undecided = undecided.unionByName(_sweep(side, most))
            done = done.union(full.select("place"))
        if seen["maybe"] or sweep:
            pairs = _moved(_moved(undecided, moves, "a"), moves, "b").where("a <> b")
            pairs = pairs.select("place", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "far", "sure").distinct()
            pairs = written(pairs, "undecided")
            good = pairs.where("sure").select("a", "b").union(similar_members(pairs.where("not sure").select("a", "b").distinct(), of, items, most))
            good = written(_apart(good.distinct(), groups), "good")
            more = written(mutual(good, F.xxhash64("a", "b")), "more")
            if more.count():
                of = written(_moved(of, more), "of")
                groups = written(_joined(groups, more, keep), "groups")
                moves = _then(moves, more)
            done = done.join(pairs.join(good, ["a", "b"]).select("place"), "place", "left_anti")
        holds = written(_unlike(_moved(holds.drop("n").join(done, "place", "left_anti"), moves).distinct()), "holds")
    raise RuntimeError("linkage did not settle")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs of which at most one is held."""
    held = groups.select("grp", "held")
    both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    return both.where("not (x and y)").select("a", "b")


def _joined(groups: DataFrame, moves: DataFrame, keep: int) -> DataFrame:
    """groups after moves of pairs."""
    cols = ("held", "radius", "sigs", "whole")
    side = lambda name, mark: groups.select(F.col("grp").alias(name), *(F.col(c).alias(f"{c}{mark}") for c in cols))
    both = moves.join(side("grp", 2), "grp").join(side("into", 1), "into")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for grp, into, *x in zip(b["grp"], b["into"], *(b[f"{c}{i}"] for i in (1, 2) for c in cols)):
                one = Cluster((into, *x[:4]))
                one.take(Cluster((grp, *x[4:])), keep)
                out.append((into, *one.row()))
            yield pd.DataFrame(out, columns=["grp", *cols]).astype({"radius": "int32"})

    ends = moves.select("grp").union(moves.select("into"))
    return groups.join(ends, "grp", "left_anti").unionByName(both.mapInPandas(run, f"grp long, {_GROUP}"))


def connected(links: DataFrame) -> DataFrame:
    """(grp, part): the connected part, named by one of its groups, of every group in links (a, b).

    In each step a group goes into the least of itself and its neighbours by a hash of group and
    step, and links between what is left are written; so their number falls by a share a step,
    whatever the form of the parts, and is none after one step where all groups of a part are linked.
    """
    edges, of, number = links.select("a", "b"), None, 0
    while True:
        rank = lambda c, n=number: F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("k"))
        ends = edges.toDF("grp", "other").union(edges.select("b", "a"))
        step = ends.groupBy("grp").agg(F.min(rank("other")).alias("r")).select("grp", F.least("r", rank("grp"))["k"].alias("into"))
        step = written(step, "parts")
        of = step.toDF("grp", "part") if of is None else written(_moved(of, step, "part"), "parts")
        apart = _moved(_moved(edges, step, "a"), step, "b").where("a <> b")
        edges, number = written(apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "between"), number + 1
        if edges.isEmpty():
            return of


class Best:
    """Best pairs first in a part. nodes: the part's groups in rising order; free: whether each is a
    single item that is not held; linked: a bit for every two, whether they may be in one group."""

    def __init__(self, nodes: np.ndarray, free: np.ndarray) -> None:
        self.nodes, self.single = nodes, free.copy()
        self.linked = np.zeros((len(nodes), -(-len(nodes) // 8)), np.uint8)
        self.of = np.arange(len(nodes))
        self.members: dict[int, np.ndarray] = {}

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        for i, j in ((x, y), (y, x)):
            np.bitwise_or.at(self.linked, (i, j >> 3), np.left_shift(1, j & 7).astype(np.uint8))

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        """The pairs of a and b in turn; where neither is single, nothing joins."""
        x, y = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        some = self.single[x] | self.single[y]
        for i, j in zip(x[some].tolist(), y[some].tolist()):
            if not (self.single[i] or self.single[j]):
                continue
            one, grp = (i, int(self.of[j])) if self.single[i] else (j, int(self.of[i]))
            there = self.members.get(grp, np.array([grp]))
            if (self.linked[one, there >> 3] >> (there & 7) & 1).all():
                self.members.pop(grp, None)
                both = np.append(there, one)
                self.members[min(grp, one)], self.of[both], self.single[both] = both, min(grp, one), False


def _in_order(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(grp, into) of those of nodes (grp, part, free) that join by links (part, a, b, first): a part's
    nodes, its links and its links in their order stream through one task, which keeps a bit a pair."""
    none = F.lit(None).cast("struct<o:double,a:bigint,b:bigint>")
    own = nodes.select("part", F.lit(0).alias("turn"), F.col("grp").alias("a"), F.col("grp").alias("b"), "free", none.alias("first"))
    known = links.select("part", F.lit(1), "a", "b", F.lit(False), none)
    rows = own.union(known).union(links.select("part", F.lit(2), "a", "b", F.lit(False), "first"))
    rows = rows.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "turn", "first", "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, free, best = [], [], None
        for batch in batches:
            turn, a, b = (batch[c].to_numpy() for c in ("turn", "a", "b"))
            groups.append(a[turn == 0])
            free.append(batch["free"].to_numpy(bool)[turn == 0])
            if turn[-1] == 0:
                continue
            best = best or Best(np.concatenate(groups), np.concatenate(free))
            best.link(a[turn == 1], b[turn == 1])
            best.take(a[turn == 2], b[turn == 2])
        into = best.nodes[best.of]
        moved = into != best.nodes
        yield pd.DataFrame({"grp": best.nodes[moved], "into": into[moved]})

    return rows.drop("first").groupBy("part").applyInPandas(run, "grp long, into long")


def _in_rounds(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """_in_order of parts of any size: in every written round the pairs join that are each other's
    first, and links that can serve no more are left out. A round joins some pair, or is the last."""
    of = nodes.select(F.col("grp").alias("node"), "grp")
    sizes = nodes.select("grp", F.lit(1).cast("long").alias("n"), "free")
    links = links.select("a", "b", F.lit(1).cast("long").alias("c"), "first")
    while True:
        moves = written(mutual(links, F.col("first")), "moves")
        if moves.isEmpty():
            return of.where("node <> grp").toDF("grp", "into")
        of = written(_moved(of, moves).select("node", "grp"), "of")
        sizes = written(_moved(sizes, moves).groupBy("grp").agg(F.sum("n").alias("n"), (F.min("free") & (F.count("*") == 1)).alias("free")), "sizes")
        met = _moved(_moved(links, moves, "a"), moves, "b").where("a <> b").withColumnsRenamed({"a": "x", "b": "y"})
        links = written(_full(met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("c").alias("c"), F.min("first").alias("first")), sizes).select("a", "b", "c", "first"), "links")


def _full(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """links (a, b, c, ...) that have all pairs of members and one free end, with free of a and b."""
    ends = links.join(sizes.toDF("a", "na", "fa"), "a").join(sizes.toDF("b", "nb", "fb"), "b")
    return ends.where("c = na * nb and (fa or fb)").drop("na", "nb")


def cosine_links(of: DataFrame, held: DataFrame, cosines: DataFrame, wide: int = WIDE) -> DataFrame:
    """(key, grp, late): of (key, grp) after free items joined groups by cosines (a, b, cosine; keys).

    Best pairs first, of equal cosines by a and b: a single item that is not held joins a group, or
    another one, if it has a cosine with every member; groups of several never join. late: whether
    the item came so. What is once incomplete stays so, and what is no longer single too: so only
    complete pairs of groups with a free one are kept, and their connected parts know nothing of each
    other. Parts of at most wide groups are gone through in one task each, others in written rounds.
    """
    of = written(of.join(held, "key"), "of")
    own = of.select("key", "grp")
    pairs = cosines.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.struct((-F.col("cosine")).alias("o"), "a", "b").alias("first"))
    cross = pairs.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("c"), F.min("first").alias("first"))
    sizes = of.groupBy("grp").agg(F.count("*").alias("n"), ((F.count("*") == 1) & ~F.max("held")).alias("free"))
    links = written(_full(cross, sizes), "links")
    if links.isEmpty():
        return own.withColumn("late", F.lit(False))
    free = links.select(F.col("a").alias("grp"), F.col("fa").alias("free")).union(links.select("b", "fb")).distinct()
    nodes = written(connected(links).join(free, "grp"), "nodes")
    fit = nodes.groupBy("part").agg((F.count("*") <= wide).alias("fits"))
    nodes = written(nodes.join(fit, "part"), "nodes")
    placed = links.join(nodes.select(F.col("grp").alias("a"), "part", "fits"), "a").select("part", "a", "b", "first", "fits")
    moves = _in_order(nodes.where("fits").drop("fits"), placed.where("fits").drop("fits"))
    if not nodes.where("not fits").isEmpty():
        moves = moves.union(_in_rounds(nodes.where("not fits"), written(placed.where("not fits"), "links")))
    moves = written(moves, "moves")
    joined = moves.union(moves.select("into", "into").distinct()).join(nodes.select("grp", "free"), "grp")
    rows = own.join(joined.withColumnRenamed("free", "late"), "grp", "left")
    return rows.select("key", F.coalesce("into", "grp").alias("grp"), F.coalesce("late", F.lit(False)).alias("late"))


def near_groups(items: DataFrame, threshold: float = THRESHOLD, cosines: DataFrame | None = None, cell: int = CELL) -> DataFrame:
    """(key, head, joined, method, similarity, size) of the items in groups of several or held ones.

    items: key, text and optionally held, whether an item stands for an exact group already;
    cosines: (a, b, cosine) of items over the semantic threshold, a < b. head: the group's smallest
    key; joined: the tier by which the item came in; method: the last tier that made the group what
    it is; similarity: the greatest of an item to the first one of its near group and of the cosines
    in a group of the last tier, null for exact groups.
    """
    sigs = sketch.signatures(items)
    sigs = sigs.join(items.select("key", "held"), "key") if "held" in items.columns else sigs.withColumn("held", F.lit(False))
    sigs = written(sigs, "signatures")
    near = near_links(sigs, threshold, cell)
    of = near.withColumn("late", F.lit(False))
    if cosines is not None:
        of = cosine_links(near, sigs.select("key", "held"), cosines)
    of = written(of.join(near.select("key", F.col("grp").alias("near")), "key").join(sigs.select("key", "held"), "key"), "of")
    packed = sigs.select("key", "sig")
    alike = of.where("key <> near").join(packed, "key").join(packed.toDF("near", "first"), "near").select("grp", sketch.similarity("sig", "first").alias("s"))
    if cosines is not None:
        late = of.groupBy("grp").agg(F.max("late").alias("l")).where("l").select("grp")
        own = of.select("key", "grp").join(late, "grp")
        inside = cosines.join(own.toDF("grp", "a"), "a").join(own.toDF("other", "b"), "b").where("grp = other")
        alike = alike.union(inside.select("grp", "cosine"))
    best = alike.groupBy("grp").agg(F.max("s").alias("similarity"))
    shape = of.groupBy("grp").agg(F.count("*").cast("int").alias("size"), F.max("late").alias("any_late"), F.max("held").alias("any_held"), F.count_if(F.col("key") != F.col("near")).alias("near_ones"))
    rows = of.join(shape.where("size > 1 or any_held"), "grp").join(best, "grp", "left")
    method = F.when(F.col("any_late"), SEMANTIC).when(F.col("near_ones") > 0, NEAR).otherwise(EXACT)
    joined = F.when(F.col("held"), EXACT).when(F.col("late"), SEMANTIC).otherwise(NEAR)
    return rows.select("key", F.col("grp").alias("head"), joined.alias("joined"), method.alias("method"), "similarity", "size")
