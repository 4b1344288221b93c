"""Toxic passages as maximum-scoring segments of token log-odds.

Token scores are log-odds of rates in toxic and other training documents, with an
informative Dirichlet prior (Monroe, Colaresi and Quinn, 2008). Tokens are words and word
beginnings; a word takes the score of its longest part with clear evidence, and words
without any share the slightly negative log-odds of the remaining mass. Evidence is clear if
chance would hardly bring it about in any of all words. All maximal scoring segments of a text
come from one linear scan (Ruzzo and Tompa, 1999). A segment of score S in a text of n tokens has the expected count
E = n exp(-lambda S) under the background (Karlin and Altschul, 1990); a document's score is
a logistic function, fitted on training documents, of its best segment's -ln E.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nearcopies import _Sets, _whole_buckets, distinct_shingles
from .simhash import shingle_hashes
from .store import bound_batches, discard, keeps_names, stage, table
from .words import distinct, slices, split_words, texts_of, tidy

#: Most labelled documents that the model is fitted on, taken in the order of a hash of doc_id.
TRAIN_DOCS = 20_000
#: Tokens that chance alone may bring into the model, in expectation: at most one, fewer with more toxic texts.
FALSE_TOKENS = 10.0
#: Lengths of the word beginnings that count as tokens, in characters.
BEGINNINGS = (7, 6, 5, 4)
#: Words of prior for all tokens together.
PRIOR = 1000.0
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’¿¡…–—"


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


@dataclass(frozen=True)
class Model:
    tokens: tuple[str, ...]
    scores: tuple[float, ...]
    other: float  # score of a token that the model does not hold
    rate: float  # Karlin-Altschul lambda
    slope: float
    intercept: float


def _tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Token number of every word, the tokens, and each text's first word."""
    words, first = split_words(texts)
    index, found = distinct(words)
    plain = pc.utf8_trim(pc.utf8_lower(found), characters=_PUNCTUATION)
    again, tokens = distinct(plain)
    return again[index], tokens, first


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by start."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, left, right = i, before, total
        end = i + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((start, end, left, right))
    return [(a, b, right - left) for a, b, left, right in kept]


def text_segments(positions: np.ndarray, scores: np.ndarray, other: float) -> list[tuple[int, int, float]]:
    """maximal_segments of a text whose tokens score `other` except at the given positions."""
    runs: list[float] = []
    where: list[tuple[int, int]] = []
    at = 0
    for p, s in zip(positions.tolist(), scores.tolist(), strict=True):
        if p > at:
            runs.append((p - at) * other)
            where.append((at, p))
        runs.append(s)
        where.append((p, p + 1))
        at = p + 1
    return [(where[a][0], where[b - 1][1], s) for a, b, s in maximal_segments(runs)]


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least hash of a text's 5-word shingles, which near copies mostly share."""
    for batch in batches:
        texts = texts_of(batch.column(0))
        for a, b in slices(texts, 2_000_000):
            hashes, base = shingle_hashes(texts[a:b], 5, 42)
            least = np.zeros(b - a, np.uint64)
            full = np.flatnonzero(np.diff(base))
            if full.size:
                least[full] = np.minimum.reduceat(hashes, base[full])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(least.view(np.int64))], ["_text", "_cell", "_key"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_text, _toxic) without copies: texts of one mark and label whose shingle sets are similar by 0.8 to one that stays."""
    for bucket, rows in _whole_buckets(batches, 50_000):
        sets = _Sets(*distinct_shingles(texts_of(rows.column("_text"))))
        keep = np.ones(len(bucket), bool)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
            rest = np.arange(a, b)
            while rest.size > 1:
                same = sets.similar_to(int(rest[0]), rest[1:])
                keep[rest[1:][same]] = False
                rest = rest[1:][~same]
        kept = rows.filter(pa.array(keep))
        yield from kept.select(["_text", "_cell"]).rename_columns(["_text", "_toxic"]).to_batches()


def _parts(tokens: pa.Array) -> list[pa.Array]:
    """A word, then its beginnings from long to short, marked by a star; null where it has none."""
    long = pc.utf8_length(tokens)
    heads = [pc.if_else(pc.greater_equal(long, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(tokens, 0, k), "*", ""), None) for k in BEGINNINGS]
    return [tokens, *heads]


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, occurrences in toxic and in all texts, toxic texts and all texts that have it)."""
    for batch in batches:
        texts, toxic = texts_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in slices(texts, 4_000_000):
            words, tokens, first = _tokens(texts[a:b])
            owner = np.repeat(np.arange(b - a), np.diff(first)).astype(np.int64)
            for part in _parts(tokens):
                coded = part.dictionary_encode()
                number = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)[words]
                doc, tok = owner[number >= 0], number[number >= 0]
                n = len(coded.dictionary)
                once = np.unique(doc * max(1, n) + tok)
                sums = [np.bincount(t[toxic[a:b][d]] if only else t, minlength=n) for d, t in ((doc, tok), (once // max(1, n), once % max(1, n))) for only in (True, False)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(x.astype(np.int64)) for x in sums)], ["token", "y1", "y", "d1", "d"])


def _best(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[tuple[pa.RecordBatch, int, int, list, np.ndarray]]:
    """(batch, start, end, segments of each text, tokens of each text)."""
    vocabulary = pa.array(model.tokens, pa.string())
    weights = np.array([*model.scores, 0.0])
    for batch in batches:
        texts = texts_of(batch.column(batch.schema.get_field_index("_text")))
        for a, b in slices(texts, 4_000_000):
            index, tokens, first = _tokens(texts[a:b])
            found_at = pc.coalesce(*(pc.index_in(p, vocabulary) for p in _parts(tokens)))
            known = pc.fill_null(found_at, len(model.tokens)).to_numpy(zero_copy_only=False)
            number = known[index]
            hits = np.flatnonzero(number < len(model.tokens))
            cut = np.searchsorted(hits, first)
            found: list = [[] for _ in range(b - a)]
            for i in np.flatnonzero(np.diff(cut)):
                at = hits[cut[i] : cut[i + 1]]
                found[i] = text_segments(at - first[i], weights[number[at]], model.other)
            yield batch, a, b, found, np.diff(first)


def _surprise(model: Model, score: float, n: int) -> float:
    """-ln of the expected count of segments of at least this score among n tokens."""
    return model.rate * score - math.log(max(n, 1))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from labelled documents whose fold is not 0; of near copies with one label, one counts.

    Without toxic examples, or without others, no token is held and every score is 0. How much
    evidence a token needs follows from the words and from the number of toxic texts.
    """
    bound_batches(docs.sparkSession)
    known = labels.filter((fold(doc_id) != 0) & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(doc_id).agg(F.max(label).alias("_toxic")).orderBy(F.xxhash64(doc_id), doc_id).limit(train_docs)
    sample = docs.select(F.col(doc_id), F.col(text).alias("_text")).join(F.broadcast(known), doc_id)  # train_docs rows at most
    marked = sample.select("_text", F.col("_toxic").cast("int")).mapInArrow(tidy(_mark), "_text string, _cell int, _key bigint")
    dealt = marked.repartition("_key", "_cell").sortWithinPartitions("_key", "_cell", F.xxhash64("_text"), "_text")
    sample, sample_path = stage(dealt.mapInArrow(tidy(_apart), "_text string, _toxic int"), "toxic-sample")
    sizes = dict(sample.groupBy("_toxic").count().collect())
    n1, n0 = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not n1 or not n0:
        discard(docs.sparkSession, sample_path)
        return Model((), (), -1.0, 1.0, 1.0, -50.0)
    counts = sample.select("_text", (F.col("_toxic") == 1).alias("_t")).mapInArrow(tidy(_count_tokens), "token string, y1 bigint, y bigint, d1 bigint, d bigint")
    counts, path = stage(counts.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("y1", "y", "d1", "d"))).filter("token <> ''"), "toxic-counts")
    all1, every = counts.filter("NOT endswith(token, '*')").agg(F.sum("y1"), F.sum("y")).first()
    share = n1 / (n1 + n0)
    x = F.col("d1") / F.col("d")  # evidence: -ln of the chance (at most) that as many of a token's texts are toxic
    evidence = F.col("d") * (x * F.ln(x / share) + F.when(x < 1, (1 - x) * F.ln((1 - x) / (1 - share))).otherwise(0.0))
    held_by = dict(counts.filter("NOT endswith(token, '*')").groupBy("d").count().collect())  # a row a number of texts, of train_docs at most
    needed = least_evidence(held_by, n1, n0)
    rows = counts.filter(x > share).filter(evidence >= needed).orderBy(F.desc(evidence), "token").collect()
    discard(docs.sparkSession, path)
    all1, all0 = all1 or 1, max(1, (every or 1) - (all1 or 1))

    def rates(y1: float, y0: float) -> tuple[float, float]:
        mass = PRIOR * (y1 + y0) / (all1 + all0)  # the token's part of the prior
        return (y1 + mass) / (all1 + PRIOR), (y0 + mass) / (all0 + PRIOR)

    held = {r.token: rates(r.y1, r.y - r.y1) for r in rows}
    held = {t: pair for t, pair in held.items() if pair[0] > 2 * pair[1]}
    roots = [pair for t, pair in held.items() if not any(t != u and t.startswith(u) for u in (t[:k] + "*" for k in BEGINNINGS) if u in held)]
    q1, q0 = min(0.5, sum(x for x, _ in roots)), min(0.4, sum(x for _, x in roots))
    other = min(-1e-3, math.log((1 - q1) / (1 - q0)))
    scores = [math.log(x / z) for x, z in held.values()]
    model = Model(tuple(held), tuple(scores), other, _rate([math.log(x / z) for x, z in roots], [z for _, z in roots], other), 1.0, 0.0)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, found, n in _best(batches, model):
            x = [_surprise(model, max((s[2] for s in f), default=0.0), k) for f, k in zip(found, n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)[a:b]], ["x", "_t"])

    points = sample.select("_text", (F.col("_toxic") == 1).alias("_t")).mapInArrow(measure, "x double, _t boolean").collect()
    discard(docs.sparkSession, sample_path)
    slope, intercept = _logistic(np.array([p.x for p in points]), np.array([float(p._t) for p in points]))
    return Model(model.tokens, model.scores, other, model.rate, slope, intercept)


def least_evidence(held_by: dict[int, int], toxic: int, others: int) -> float:
    """The evidence that a token needs. held_by: the number of words that so many texts have.

    Words that too few texts have to reach it even if all of these are toxic are no tests
    (Tarone, 1990); of the others, FALSE_TOKENS / toxic words, one at most, may reach it by chance.
    """
    most = math.log((toxic + others) / toxic)  # evidence of each text if all are toxic
    allowed = min(1.0, FALSE_TOKENS / toxic)
    tests = sum(held_by.values())
    for d in sorted(held_by):
        needed = math.log(max(tests, 1) / allowed)
        if d * most >= needed:
            return needed
        tests -= held_by[d]
    return math.inf


def _rate(scores: list[float], frequency: list[float], other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    s, p = np.array([*scores, other]), np.array([*frequency, max(1e-9, 1 - sum(frequency))])
    low, high = 1e-6, 1.0
    mean = lambda r: float(np.exp(np.minimum(r * s, 700)) @ p)
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return (low + high) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (kept positive) and intercept, by Newton's method with a slight ridge."""
    if not len(x):
        return 1.0, -50.0
    mid, spread = x.mean(), max(x.std(), 1e-6)
    u = np.stack([(x - mid) / spread, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        grad = u.T @ (y - p) - 1e-2 * w
        hess = (u * (p * (1 - p))[:, None]).T @ u + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0], 1e-6) / spread
    return float(slope), float(w[1] - slope * mid)


@keeps_names
def score_documents(docs: DataFrame, model: Model, text: str = "text", significance: float = 1e-3) -> DataFrame:
    """docs with toxic_score (0 to 1), toxic (score at least 0.5) and toxic_spans.

    toxic_spans are the segments, in words counted from 0, whose expected count is at most
    `significance`: (first word, word after the last, score, expected count). Null and empty
    texts score like a text without evidence. Columns of these names are replaced.
    """
    docs = docs.drop("toxic_score", "toxic", "toxic_spans").withColumn("_text", F.col(text))
    names = [c for c in docs.columns if c != "_text"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    extra = "toxic_score double, toxic boolean, toxic_spans array<struct<start: bigint, end: bigint, score: double, expected: double>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_text") + ", " + extra

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, found, n in _best(batches, model):
            points, spans = [], []
            for segments, k in zip(found, n.tolist(), strict=True):
                x = _surprise(model, max((s[2] for s in segments), default=0.0), k)
                points.append(1 / (1 + math.exp(-max(-700.0, min(700.0, model.slope * x + model.intercept)))))
                rated = [(i, j, s, math.exp(max(-700.0, -_surprise(model, s, k)))) for i, j, s in segments]
                spans.append([r for r in rated if r[3] <= significance])
            made = [pa.array(points, pa.float64()), pa.array([p >= 0.5 for p in points], pa.bool_()), pa.array([[dict(zip(("start", "end", "score", "expected"), r, strict=True)) for r in s] for s in spans], pa.list_(span))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(names))), *made], [*names, "toxic_score", "toxic", "toxic_spans"])

    return docs.select(*names, "_text").mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled documents outside fold 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").cast("int").alias("predicted"))
