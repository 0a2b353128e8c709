"""Hidden Markov language model over words.

States emit word classes: the most frequent words are a class each, all others share hashed
classes, and a word's share of its class is the same in every state. So the model's size is
bounded while the word counts, which grow with the corpus, stay a table. Baum-Welch runs on
whole class sequences: every task adds up expected counts of its sequences, Spark sums them, and
the new parameters go out with the next round. Long sequences run in pieces side by side, each
given the exact forward and backward messages of its neighbours. Scores come from the scaled forward recursion over
whole texts, plus the words' log shares, looked up by a join for all but frequent words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import arrow_schema, batched, held_out, table, tidy, utf8, written

#: States, words that are classes, hashed classes (a power of two), Baum-Welch rounds.
STATES, OWN, HASHED, ROUNDS = 6, 4096, 1024, 4
#: Words whose counts are sent to tasks, and the longest that go as they are, others by hash: at
#: most 8 MB.
SENT, LONGEST = 65536, 64
#: Tokens of a piece (it has no influence on results) and of the sequences taken together.
PIECE, TOGETHER = 1024, 300_000
#: Additive smoothing of counts, and words a worker remembers or counts before passing on.
ADD, REMEMBERED = 0.1, 200_000
SEED = 7
LN10 = float(np.log(10))


def word_key(word: bytes) -> bytes:
    """What stands for a word among those sent: itself, or its hash where it is long."""
    return word if len(word) <= LONGEST and word[:1] != b"\0" else b"\0%016X" % xxh64_intdigest(word, 42)


def key_hash(key: bytes) -> int:
    return int(key[1:], 16) if key[:1] == b"\0" else xxh64_intdigest(key, 42)


class Vocabulary(NamedTuple):
    """What tasks know of the counts: frequent words by rank, their counts, and class totals."""

    words: list[str]  # as word_key() gives them
    counts: np.ndarray
    class_sum: np.ndarray  # tokens of each hashed class without words that are classes
    class_size: np.ndarray  # distinct words of it
    docs: int
    tokens: int  # N: with one end for each document
    distinct: int  # V: with the end

    def class_log(self) -> np.ndarray:
        """log10 of each hashed class's denominator."""
        return np.log10(self.class_sum + ADD * (self.class_size + 1))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): how often each word comes in the texts of docs, words cut at ASCII blanks."""
    batched(docs.sparkSession)
    schema = arrow_schema("word string, c long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            cols = [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64())]
            n.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        for b in batches:
            for t in b.column(0):
                n.update(t.as_py().lower().split())
                if len(n) > REMEMBERED:
                    yield flush()
        yield flush()

    return docs.select(utf8().alias("text")).mapInArrow(tidy(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    # frequent words by whole steps of a log scale, so no task sends more than its share
    own = (F.octet_length("word") <= LONGEST) & ~F.col("word").startswith("\0")
    key = F.when(own, F.col("word")).otherwise(F.concat(F.lit("\0"), F.lpad(F.hex(F.xxhash64("word")), 16, "0")))
    short, step = counts.select(key.alias("word"), "c"), F.floor(F.log("c") * 32)
    room, least = SENT, None
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    top = [] if least is None else short.where(step >= least).collect()
    top.sort(key=lambda r: (-r.c, r.word))
    words, c = [r.word for r in top], np.array([r.c for r in top], np.float64)
    slot = F.pmod(F.xxhash64("word"), F.lit(HASHED))
    total, size = np.zeros(HASHED), np.zeros(HASHED)
    for r in counts.groupBy(slot.alias("g")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        total[r.g], size[r.g] = r.c, r.v
    tokens, distinct = int(total.sum()) + n_docs, int(size.sum()) + (n_docs > 0)
    for w, n in zip(words[:OWN], c):
        g = key_hash(w.encode()) % HASHED
        total[g] -= n
        size[g] -= 1
    return Vocabulary(words, c, total, size, n_docs, tokens, distinct)


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """docs (rid, text, ...) with text replaced by its class sequence and known log sums.

    classes: 16-bit ids, 0 the end; n_tokens, n_sent: tokens, and those of sent words or the
    end; base_log: sum of log10(c + ADD) over these; share_log: their log10 shares of classes
    and the others' denominators; rare: other words with their number in the text.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    ddl += ", classes binary, n_tokens long, n_sent long, base_log double, share_log double, rare array<struct<word: string, n: int>>"
    schema, at = arrow_schema(ddl), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        known = {w.encode(): i for i, w in enumerate(v.words)}
        m = len(v.words)

        class Ranks(dict):
            def __missing__(self, word: bytes) -> int:
                key = word_key(word)
                self[word] = r = known[key] if key is not word and key in known else m + xxh64_intdigest(word, 42) % HASHED
                return r

        ranks = Ranks(known)
        slot = np.array([key_hash(w) % HASHED for w in known], np.int64)
        class_of = np.r_[np.where(np.arange(m) < OWN, np.arange(m) + 1, OWN + 1 + slot), OWN + 1 + np.arange(HASHED)].astype(np.uint16)
        low = v.class_log()
        base = np.r_[np.log10(v.counts + ADD), np.zeros(HASHED)]
        share = np.r_[np.where(np.arange(m) < OWN, 0.0, np.log10(v.counts + ADD) - low[slot]), -low]
        end = np.log10(v.docs + ADD)
        for b in batches:
            if len(ranks) > m + REMEMBERED:
                ranks = Ranks(known)
            rows, rare, times, ends = [], [], [], [0]
            for t in b.column(at).to_pylist():
                words = t.lower().split()
                r = np.fromiter(map(ranks.__getitem__, words), np.int64, len(words))
                new = np.flatnonzero(r >= m).tolist()
                if new:
                    often = Counter([words[i] for i in new])
                    rare += often
                    times += often.values()
                ends.append(len(rare))
                n = len(words)
                ids = np.append(class_of[r], np.uint16(0)).tobytes()
                rows.append((ids, n + 1, n + 1 - len(new), float(base[r].sum() + end), float(share[r].sum())))
            cols = [c for i, c in enumerate(b.columns) if i != at]
            cols += [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([])] * 5
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"])
            cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.mapInArrow(tidy(run), ddl)


class Model(NamedTuple):
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def first_model(vocab: Vocabulary, states: int = STATES, seed: int = SEED) -> Model:
    """Sticky states whose emissions are the class frequencies, each perturbed at random."""
    rng = np.random.default_rng(seed)
    prior = class_prior(vocab)
    emit = prior[:, None] * np.exp(rng.normal(0, 1, (len(prior), states)))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def class_prior(vocab: Vocabulary) -> np.ndarray:
    own = np.zeros(OWN)
    own[: min(OWN, len(vocab.counts))] = vocab.counts[:OWN]
    n = np.r_[float(vocab.docs), own, vocab.class_sum] + ADD
    return n / n.sum()


def _timed(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols by time and then sequence, live sequences at each time, order): the sequences
    from the longest to the shortest, so those live at a time are a prefix."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    flat = np.concatenate([seqs[i] for i in order])
    time = np.concatenate([np.arange(n) for n in size])
    offset = np.r_[0, np.cumsum(live)]
    place = offset[time] + np.repeat(np.arange(len(size)), size)
    obs = np.empty(len(flat), flat.dtype)
    obs[place] = flat
    return obs, live, order


def forward(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """Natural log likelihood of each sequence by the scaled forward recursion."""
    obs, live, order = _timed(seqs)
    out, alpha, at = np.zeros(len(seqs)), None, 0
    for n in live.tolist():
        e = model.emit[obs[at : at + n]]
        alpha = (model.start if alpha is None else alpha[:n] @ model.step) * e
        c = alpha.sum(axis=1)
        alpha /= c[:, None]
        out[order[:n]] += np.log(c)
        at += n
    return out


def _spans(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """For each sequence the matrix R that takes a forward message before its first emission to
    the one after its last, up to a factor: alpha @ R; and R @ beta the other way round."""
    obs, live, order = _timed(seqs)
    k = len(model.start)
    m, at = np.broadcast_to(np.eye(k), (len(seqs), k, k)).copy(), 0
    for t, n in enumerate(live.tolist()):
        part = (m[:n] @ model.step if t else m[:n]) * model.emit[obs[at : at + n]][:, None, :]
        m[:n] = part / part.sum(axis=(1, 2), keepdims=True)
        at += n
    out = np.empty_like(m)
    out[order] = m
    return out


def pieces_of(seqs: list[np.ndarray], model: Model, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(pieces of at most size tokens, forward message that arrives at each, backward message after
    each, whether it is its sequence's first): cut sequences' pieces get exact messages."""
    parts = [[s[a : a + size] for a in range(0, len(s), size)] for s in seqs]
    flat = [p for ps in parts for p in ps]
    first = np.array([not i for ps in parts for i in range(len(ps))], bool)
    arrive, after = np.zeros((len(flat), len(model.start))), np.ones((len(flat), len(model.start)))
    many = np.flatnonzero(np.repeat([len(ps) > 1 for ps in parts], [len(ps) for ps in parts])).tolist()
    if many:
        spans = dict(zip(many, _spans([flat[i] for i in many], model), strict=True))
        for i in many:
            if not first[i]:
                a = (model.start if first[i - 1] else arrive[i - 1] @ model.step) @ spans[i - 1]
                arrive[i] = a / a.sum()
        for i in many[::-1]:
            if not first[i]:
                b = model.step @ (spans[i] @ after[i])
                after[i - 1] = b / b.sum()
    return flat, arrive, after, first


def expected_counts(seqs: list[np.ndarray], model: Model, total: Model, size: int = PIECE) -> float:
    """Adds a forward-backward pass's expected counts to total (the step counts without the factor
    of the model's step); gives the log likelihood. size, the tokens of a piece, changes nothing."""
    flat, arrive, after, first = pieces_of(seqs, model, size)
    obs, live, order = _timed(flat)
    k = len(model.start)
    start, arrive = first[order], arrive[order].astype(np.float32)
    after, step = after[order].astype(np.float32), model.step.astype(np.float32)
    before = np.where(start[:, None], model.start.astype(np.float32), arrive @ step)
    e = model.emit.astype(np.float32)[obs]
    alpha, scale, at = np.empty_like(e), np.empty(len(e), np.float32), 0
    places = []
    for n in live.tolist():
        a = (before if not places else alpha[places[-1] : places[-1] + n] @ step) * e[at : at + n]
        c = a.sum(axis=1)
        np.divide(a, c[:, None], out=alpha[at : at + n])
        scale[at : at + n] = c
        places.append(at)
        at += n
    like = float(np.log(scale.astype(np.float64)).sum())
    beta = np.zeros((0, k), np.float32)
    for t in range(len(live) - 1, -1, -1):
        at, n = places[t], int(live[t])
        if n > len(beta):  # pieces that end here
            done = alpha[at + len(beta) : at + n]
            last = after[len(beta) : n] / (done * after[len(beta) : n]).sum(axis=1, keepdims=True)
            beta = np.concatenate([beta, last])
        g = e[at : at + n] * beta / scale[at : at + n, None]
        alpha[at : at + n] *= beta
        if t:
            prev = places[t - 1]
            total.step[:] += alpha[prev : prev + n].T @ g
            beta = g @ step.T
    total.start[:] += alpha[: live[0]][start].sum(axis=0)
    total.step[:] += arrive[~start].T @ g[~start]  # between pieces
    for s in range(k):
        total.emit[:, s] += np.bincount(obs, alpha[:, s], len(total.emit))
    return like


def baum_welch(seqs: DataFrame, model: Model, prior: np.ndarray, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model after some rounds over every row of seqs (classes: 16-bit ids), and the log
    likelihood that each round found before its change."""
    batched(seqs.sparkSession)
    k, m = len(model.start), len(prior)
    names, likes = [f"s{i}" for i in range(k)], []
    ddl = "kind int, i int, " + ", ".join(f"{n} double" for n in names)
    schema = arrow_schema(ddl)
    for _ in range(rounds):
        shared = seqs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            old, held, n, like = shared.value, [], 0, 0.0
            total = Model(np.zeros(k), np.zeros((k, k)), np.zeros((m, k)))
            for b in batches:
                for raw in b.column(0):
                    held.append(np.frombuffer(raw.as_py(), np.uint16))
                    n += len(held[-1])
                    if n >= TOGETHER:
                        like += expected_counts(held, old, total)
                        held, n = [], 0
            if held:
                like += expected_counts(held, old, total)
            # emissions; then transitions as the expected pairs without the factor of the step
            used = np.flatnonzero(total.emit.sum(axis=1))
            kinds = np.r_[np.zeros(len(used)), np.ones(k), [2, 3]].astype(np.int32)
            index = np.r_[used, np.arange(k), [0, 0]].astype(np.int32)
            rows = np.vstack([total.emit[used], total.step * old.step, total.start[None], np.full((1, k), like / k)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(index), *(pa.array(rows[:, j]) for j in range(k))], schema=schema)

        sums = seqs.select("classes").mapInArrow(tidy(run), ddl).groupBy("kind", "i").agg(*(F.sum(n).alias(n) for n in names))
        got = sums.toPandas()  # at most classes + states + 2 rows
        new = Model(np.zeros(k), np.zeros((k, k)), np.zeros((m, k)))
        for kind, into in ((0, new.emit), (1, new.step)):
            part = got[got["kind"] == kind]
            into[part["i"].to_numpy()] = part[names].to_numpy()
        start = got[got["kind"] == 2][names].to_numpy().sum(axis=0) + 1.0
        likes.append(float(got[got["kind"] == 3][names].to_numpy().sum()))
        emit = new.emit + prior[:, None] * max(1.0, 0.001 * new.emit.sum() / k)
        step = new.step + 1.0 / k
        model = Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
    return model, likes


def likelihoods(seqs: DataFrame, model: Model) -> DataFrame:
    """(rid, like): natural log likelihood of each row's whole class sequence."""
    shared = seqs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema("rid long, like double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by length, as a step of the recursion serves all sequences that are still alive
        held: dict[int, list] = {}
        size: Counter = Counter()

        def flush(c: int) -> pa.RecordBatch:
            rids, seqs_ = zip(*held.pop(c), strict=True)
            size.pop(c)
            return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(forward(list(seqs_), shared.value))], schema=schema)

        for b in batches:
            for rid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint16)
                c = len(s).bit_length()
                held.setdefault(c, []).append((rid, s))
                size[c] += len(s)
                if size[c] >= 4 * TOGETHER:
                    yield flush(c)
        for c in list(held):
            yield flush(c)

    return seqs.select("rid", "classes").mapInArrow(tidy(run), "rid long, like double")


def lm_scores(docs: DataFrame, train: str = "train", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    docs: doc_id, text and a boolean column that marks training rows. Null text is empty, which
    is one end token. Repeated rows count and score as often as they come; rows need no id.
    Without training rows every word is unknown and scores follow from smoothing alone.
    """
    docs = docs.select("doc_id", F.col(train).alias("train"), "text")
    learn = docs.where("train")
    counts = written(word_counts(learn), "counts")
    vocab = vocabulary(counts, learn.count())
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "train", utf8().alias("text"))
    seqs = written(coded(rows, vocab), "coded")
    prior = class_prior(vocab)
    model, _ = baum_welch(seqs.where("train"), first_model(vocab), prior, rounds)
    rare = seqs.select("rid", F.inline("rare"))
    told = rare.join(counts, "word", "left").select("rid", "n", F.coalesce("c", F.lit(0)).alias("c"))
    told = told.groupBy("rid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known")
    )
    scored = likelihoods(seqs, model)
    flat = seqs.select("rid", "doc_id", "train", "n_tokens", "n_sent", "base_log", "share_log")
    out = flat.join(scored, "rid").join(told, "rid", "left")
    log, known = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0))
    whole = float(np.log10(vocab.tokens + ADD * (vocab.distinct + 1)))
    end_known = 0 if vocab.docs else 1
    return out.select(
        "doc_id",
        "train",
        "n_tokens",
        (F.col("n_sent") + known - end_known).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base_log") + log - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("like") / LN10 + F.col("share_log") + log).alias("score"),
    )


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held_out(10, 0)).alias("train"))
    return lm_scores(docs).withColumn("train", ~F.col("train")).withColumnRenamed("train", "held_out")
