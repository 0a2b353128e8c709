"""Language identification by mixture inference.

Training counts hashed letter trigrams per language over all labelled rows (partial counts in
each task, summed by Spark). A document is a mixture: every word comes from one language with
the likelihood of its trigrams, and expectation-maximisation estimates the proportions. The
language set is the one with the best likelihood less a penalty for each language; the
prediction is the set's largest language, its score that language's proportion.

All sums of a document run over its distinct words and their counts, taken from blocks of the text
in turn: a task holds the words of one block in all languages, and those of one document in the
languages of its shortlist, which the first round of the mixture over all languages draws. A word
is held whole, with about 40 bytes for each of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, batched, held_out, table, tidy, utf8, written

#: Trigram buckets as a power of two; the model is languages x buckets.
BUCKETS = 15
#: Languages that the model learns: those with the most labelled rows, so that it stays below 26 MB.
MAX_LANGUAGES = 200
#: Rounds of expectation-maximisation, and nats for each language in the set and log word count.
ROUNDS, PENALTY = 10, 1.0
#: Languages on a document's shortlist, of which its set is chosen, and bytes of text in a block.
SHORTLIST, BLOCK = 12, 1 << 18
UNKNOWN = "und"

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first of word, word owner) of the trigrams centred on each letter byte.

    bucket: one entry a byte that is no blank; first of word: where each word's entries begin;
    word owner: the text each word is of.
    """
    x = np.frombuffer(b" " + b" ".join(t.translate(_LETTERS) for t in texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = np.flatnonzero(x != 32)
    h = x[at - 1] * np.uint32(0x9E3779B1) + x[at] * np.uint32(0x85EBCA6B) ^ x[at + 1] * np.uint32(0xC2B2AE35)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(x[at - 1] == 32)
    return (h >> np.uint32(32 - BUCKETS)).astype(np.int64), first, np.searchsorted(ends, at[first], "left")


def train(docs: DataFrame, languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of a bucket in each) from the rows of docs (lang, text).

    Rows with null lang or text teach nothing; without any the model has no language. Of more
    than languages labels those with the most rows are learned, of equals the first by name.
    """
    batched(docs.sparkSession)
    ddl = "lang string, bucket int, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for lang in set(langs.tolist()):
                bucket, _, _ = trigrams([texts[i] for i in np.flatnonzero(langs == lang)])
                total.setdefault(lang, np.zeros(1 << BUCKETS, np.int64))
                total[lang] += np.bincount(bucket, minlength=1 << BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            cols = [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    rows = docs.where("lang is not null and text is not null").select("lang", utf8().alias("text"))
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    langs = sorted(r.lang for r in top.collect())
    if not langs:
        return langs, np.zeros((0, 1 << BUCKETS))
    rows = rows.where(F.col("lang").isin(langs))
    counts = written(rows.mapInArrow(tidy(run), ddl).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    got = counts.select(place.alias("lang"), "bucket", "n").toArrow()  # 16 bytes for each language and bucket at most
    n = np.zeros((len(langs), 1 << BUCKETS))
    n[got["lang"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    n += 0.5
    return langs, np.log(n / n.sum(axis=1, keepdims=True))


def _grouped(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of consecutive texts of at most BLOCK bytes together, or of one longer text."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if group and size + len(t) > BLOCK:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(t)
    if group:
        yield group


def _cut(text: bytes) -> Iterator[bytes]:
    """text in pieces that end at the first blank after BLOCK bytes."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _blocks(texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(distinct words of each piece, how often each word is there, the text it is of) by block."""
    pieces = []
    for i, t in enumerate(texts):
        for piece in _cut(t.translate(_LETTERS)):
            words = Counter(piece.split())
            if words:
                n = np.fromiter(words.values(), float, len(words))
                pieces.append((b" ".join(words), n, np.full(len(words), i)))
    if len(texts) == 1:
        return [([w], n, i) for w, n, i in pieces]
    return [([w for w, _, _ in pieces], *(np.concatenate([p[k] for p in pieces]) for k in (1, 2)))] if pieces else []


def _added(total: np.ndarray, owner: np.ndarray, x: np.ndarray) -> None:
    """Adds each word's x to the row of total of its text; owner rises."""
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    total[owner[at]] += np.add.reduceat(x, at, axis=0, dtype=float)


def _mixture(words: list[tuple], size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each text. words: (likelihoods: words x languages, counts,
    text of each word) by block; size: words of each text, allowed: texts x languages."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        total = np.zeros_like(pi)
        for lik, n, owner in words:
            r = lik * pi[owner]
            r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
            _added(total, owner, r)
        pi = total / size[:, None]
    like = np.zeros(len(size))
    for lik, n, owner in words:
        _added(like, owner, n * np.log(np.maximum((lik * pi[owner]).sum(axis=1), 1e-300)))
    return pi, like


def infer(texts: list[bytes], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the language or -1, its proportion, size of the language set, whether the
    text or half of its words are at least as likely in its mixture as trigrams at random) of each text."""
    fits = np.zeros(len(texts), bool)
    best, score, chosen = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), int)
    at = [i for i, t in enumerate(texts) if len(logp) and _LETTER.search(t.decode("utf-8", "replace"))]
    for group in _grouped([texts[i] for i in at]):
        to = [at[i] for i in group]
        best[to], score[to], chosen[to], fits[to] = _inferred([texts[i] for i in to], logp)
    return best, np.clip(score, 0, 1), chosen, fits


def _inferred(texts: list[bytes], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """infer() for texts with a letter, of which all words are held together."""
    blocks = _blocks(texts)
    rows, languages = len(texts), len(logp)
    size, single, first = np.zeros(rows), np.zeros((rows, languages)), np.zeros((rows, languages))
    tops = []
    for pieces, n, owner in blocks:
        bucket, begin, _ = trigrams(pieces)
        # each byte is in three trigrams, so a word's likelihood takes the cube root
        ll = np.stack([np.add.reduceat(p[bucket], begin) for p in logp], axis=1) / 3
        tops.append(ll.max(axis=1))
        ll -= tops[-1][:, None]
        _added(size, owner, n)
        _added(single, owner, ll * n[:, None])
        np.exp(ll, out=ll)
        ll *= (n / ll.sum(axis=1))[:, None].astype(ll.dtype)
        _added(first, owner, ll)
    short = np.sort(np.argsort(-first, axis=1, kind="stable")[:, :SHORTLIST], axis=1)
    words, lengths = [], []
    for (pieces, n, owner), top in zip(blocks, tops, strict=True):
        bucket, begin, _ = trigrams(pieces)
        lengths.append(np.diff(np.r_[begin, len(bucket)]))
        of = np.repeat(owner, lengths[-1])
        ll = np.stack([np.add.reduceat(logp[c[of], bucket], begin) for c in short.T], axis=1) / 3
        words.append((np.exp(ll - top[:, None]), n, owner))
    pi, full = _mixture(words, size, np.ones(short.shape))
    rank = np.argsort(-pi, axis=1, kind="stable")
    cost = PENALTY * np.log(size + 1.0)
    one = single.argmax(axis=1)
    share = np.where(short == one[:, None], pi, 0).sum(axis=1)
    value, pred, count = single.max(axis=1) - cost, one.copy(), np.ones(rows, int)
    for m in range(2, short.shape[1] + 1):
        # a set of m languages is at most as likely as all of them
        todo = np.flatnonzero(full - m * cost > value)
        if not len(todo):
            break
        allowed = np.zeros((len(todo), short.shape[1]))
        np.put_along_axis(allowed, rank[todo, :m], 1.0, axis=1)
        some = words
        if len(todo) < rows:
            keep = [np.isin(owner, todo) for _, _, owner in words]
            some = [(lik[k], n[k], np.searchsorted(todo, owner[k])) for (lik, n, owner), k in zip(words, keep, strict=True)]
        p, like = _mixture(some, size[todo], allowed)
        won = like - m * cost[todo] > value[todo]
        to = todo[won]
        value[to], share[to], count[to] = (like - m * cost[todo])[won], p[won].max(axis=1), m
        pred[to] = short[to, p[won].argmax(axis=1)]
    gains, likely = np.zeros(rows), np.zeros(rows)
    for (lik, n, owner), top, length in zip(words, tops, lengths, strict=True):
        gain = top + np.log(np.maximum((lik * pi[owner]).sum(axis=1), 1e-300)) + length / 3 * BUCKETS * np.log(2)
        _added(gains, owner, n * gain)
        _added(likely, owner, n * (gain >= 0))
    return pred, share, count, (2 * likely >= size) | (gains >= 0)


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs with lang_pred, score and n_languages (columns of these names are replaced).

    Needs a column text. lang_pred is `und` with score 0 where text is null or has no letter,
    or where the model has no language. Rows, ties and repeats stay as they are: equal texts get
    equal values, and of equally likely languages the first in alphabetical order wins.
    """
    batched(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "n_languages")
    langs = [*model[0], UNKNOWN]
    logp = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))  # languages x buckets
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    ddl = f"{kept}, lang_pred string, score double, n_languages int"
    schema = arrow_schema(ddl)
    text = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x or b"" for x in b.column(text).cast(pa.binary()).to_pylist()]
            best, score, m, _ = infer(got, logp.value)
            cols = [pa.array([langs[i] for i in best]), pa.array(score), pa.array(m, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, schema)), *cols], schema=schema)

    return docs.mapInArrow(tidy(run), ddl)


def known_language(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs without the rows whose language is not known: null texts, texts without a letter, and
    texts that are less likely in their mixture of languages than as random trigrams, as a whole
    and in most of their words. A
    mixture of known languages stays, however even. All columns stay as they are, whatever their
    names; without a model every row goes.
    """
    batched(docs.sparkSession)
    logp = docs.sparkSession.sparkContext.broadcast(model[1].astype(np.float32))
    text = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x or b"" for x in b.column(text).cast(pa.binary()).to_pylist()]
            yield b.filter(pa.array(infer(got, logp.value)[3]))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(4, 2)).select("lang", "text"))
    out = with_language(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_languages")
