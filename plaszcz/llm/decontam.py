"""Benchmark decontamination: BM25 retrieval of test items by every training passage.

Test items are indexed; an item's score for a passage is the BM25 weight of the terms they
share, divided by the item's score for itself, so one threshold between 0 and 1 serves all
items. Items stand in blocks, and each term keeps its largest weight in each block. Every
passage is a query: as in block-max WAND, blocks whose summed maxima stay below the
threshold are skipped, and the items of the others are scored exactly, so all items at or
above the threshold are retrieved. A batch's passages go through these steps together, as
array operations. Retrieved items are verified by the share of their question's and of
their answer's word n-grams that the passage holds.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, keeps_names, new_path, read_file, table, write_file
from .toxicity import _PUNCTUATION
from .words import distinct, slices, split_words, texts_of, tidy

K1, B = 1.2, 0.75
BLOCK_ITEMS = 16
STRIDE = 128
#: Items of one index, which every task holds; a larger benchmark is searched index by index.
ITEMS_PER_INDEX = 20_000
#: Pairs of a passage and a block whose bounds are held at once, and bytes of text that are searched index by index.
CELLS, SEARCHED_BYTES = 4_000_000, 32 << 20


def tokens(text: str) -> list[str]:
    return [w for w in (x.strip(_PUNCTUATION) for x in text.lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer: the last sentence answers; of a single one, its last quarter."""
    parts = [p for p in (tokens(s) for s in re.split(r"(?<=[.?!])\s+|\n", text)) if p]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - len(words) // 4
    return words[:cut], words[cut:]


def overlap(part: list[str], passage: list[str], n: int = 3) -> float:
    """Share of the part's distinct word n-grams that the passage holds; 1 for an empty part."""
    n = min(n, len(part))
    if not n:
        return 1.0
    grams = {tuple(part[i : i + n]) for i in range(len(part) - n + 1)}
    return len(grams & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(grams)


@dataclass(frozen=True)
class Index:
    ids: list
    items: list[tuple[list[str], list[str]]]
    terms: pa.Array
    longest: int
    by_block: tuple[np.ndarray, np.ndarray, np.ndarray]  # of each term: start of its blocks (n + 1); block; largest weight
    postings: tuple[np.ndarray, np.ndarray, np.ndarray]  # term * blocks + block, ascending; item; weight
    blocks: int


@dataclass
class Statistics:
    """What BM25 knows of a whole benchmark: items that hold each term, items, words."""

    df: Counter
    items: int = 0
    words: int = 0

    def add(self, texts: list[str]) -> Statistics:
        for ws in map(tokens, texts):
            self.df.update(set(ws))
            self.items += 1
            self.words += len(ws)
        return self


def build_index(ids: list, texts: list[str], whole: Statistics | None = None) -> Index:
    """Weights are shares of each item's own score. Items without words are never retrieved.

    whole: of the benchmark that the items are a part of, by default of the items.
    """
    words = [tokens(t) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({w for ws in words for w in ws}))}
    whole = whole or Statistics(Counter()).add(texts)
    df, n, mean = whole.df, whole.items, max(1.0, whole.words / max(1, whole.items))
    blocks = -(-len(words) // BLOCK_ITEMS)
    term, item, weight = [], [], []
    for i, ws in enumerate(words):
        tf = Counter(ws)
        raw = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean)) for t, f in tf.items()}
        total = sum(raw.values())
        for t, x in raw.items():
            term.append(vocabulary[t])
            item.append(i)
            weight.append(x / total)
    term, item, weight = np.array(term, np.int64), np.array(item, np.int64), np.array(weight, np.float64)
    key = term * max(1, blocks) + item // BLOCK_ITEMS
    order = np.lexsort((item, key))
    key, item, weight = key[order], item[order], weight[order]
    heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    most = np.maximum.reduceat(weight, heads) if len(key) else weight
    start = np.searchsorted(key[heads] // max(1, blocks), np.arange(len(vocabulary) + 1))
    longest = max((len(ws) for ws in words), default=1)
    return Index(ids, [question_and_answer(t) for t in texts], pa.array(list(vocabulary), pa.string()), longest, (start, key[heads] % max(1, blocks), most), (key, item, weight), blocks)


def _expand(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, element) for ranges of elements."""
    owner = np.repeat(np.arange(len(size)), size)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + start[owner]


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all pairs that reach the threshold.

    passage, term: the distinct terms of each passage, sorted by passage. Bounds are held for
    CELLS pairs of a passage and a block at a time.
    """
    step = max(1, CELLS // max(1, index.blocks))
    found = []
    for a in range(0, max(1, n_passages), step):
        lo, hi = np.searchsorted(passage, [a, a + step])
        p, i, s = _retrieve(index, passage[lo:hi] - a, term[lo:hi], min(step, n_passages - a), threshold)
        found.append((p + a, i, s))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _retrieve(index: Index, passage: np.ndarray, term: np.ndarray, n_passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, block, most = index.by_block
    owner, at = _expand(start[term], start[term + 1] - start[term])
    bound = np.bincount(passage[owner] * index.blocks + block[at], most[at], n_passages * index.blocks)
    pairs = np.flatnonzero(bound >= threshold - 1e-9)
    p, b = pairs // index.blocks, pairs % index.blocks
    first = np.searchsorted(passage, np.arange(n_passages + 1))
    pair, at = _expand(first[p], first[p + 1] - first[p])
    key, item, weight = index.postings
    want = term[at] * index.blocks + b[pair]
    lo, hi = np.searchsorted(key, want), np.searchsorted(key, want, side="right")
    own, post = _expand(lo, hi - lo)
    score = np.bincount(pair[own] * BLOCK_ITEMS + item[post] % BLOCK_ITEMS, weight[post], len(pairs) * BLOCK_ITEMS)
    good = np.flatnonzero(score >= threshold - 1e-9)
    return p[good // BLOCK_ITEMS], b[good // BLOCK_ITEMS] * BLOCK_ITEMS + good % BLOCK_ITEMS, score[good]


def search_batch(index: Index, texts: pa.Array, threshold: float, question: float, answer: float) -> list[list[dict]]:
    """Verified items of each text, the best passage of each."""
    words, first = split_words(texts, pc.utf8_split_whitespace)
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    if not len(words) or not len(index.terms):
        return out
    number, found = distinct(words)
    plain = pc.utf8_trim(pc.utf8_lower(found), characters=_PUNCTUATION)
    # as in tokens, words of punctuation alone count for nothing; place: a word's number with them
    solid = (pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0)[number]
    place = (np.arange(len(number)) - np.repeat(first[:-1], np.diff(first)))[solid]
    number, first = number[solid], np.concatenate(([0], np.cumsum(solid)))[first]
    if not len(number):
        return out
    term = pc.fill_null(pc.index_in(plain, index.terms), -1).to_numpy(zero_copy_only=False)[number]
    known = np.flatnonzero(term >= 0)
    text = np.searchsorted(first, known, side="right") - 1
    # passages begin every STRIDE words and are long enough to hold any item whole
    reach = -(-index.longest // STRIDE)
    base = np.concatenate(([0], np.cumsum(-(-np.diff(first) // STRIDE))))
    at = (known - first[text]) // STRIDE
    pairs = [np.stack([base[text[k]] + at[k] - back, term[known[k]]]) for back in range(reach + 1) for k in [np.flatnonzero(at >= back)]]
    n_terms = len(index.terms)
    both = np.unique(np.concatenate([p[0] * n_terms + p[1] for p in pairs]))
    p, i, s = retrieve(index, both // n_terms, both % n_terms, int(base[-1]), threshold)
    best: dict[tuple[int, int], dict] = {}
    for passage, item, score in zip(p.tolist(), i.tolist(), s.tolist(), strict=True):
        t = int(np.searchsorted(base, passage, side="right")) - 1
        a = int(first[t]) + (passage - int(base[t])) * STRIDE
        span = plain.take(pa.array(number[a : min(int(first[t + 1]), a + STRIDE * (reach + 1))])).to_pylist()
        q, r = (overlap(x, span) for x in index.items[item])
        if q >= question and r >= answer and score > best.get((t, item), {"score": -1})["score"]:
            best[t, item] = {"item_id": index.ids[item], "score": round(min(score, 1.0), 6), "question_overlap": q, "answer_overlap": r, "first_word": int(place[a])}
    for (t, _), hit in sorted(best.items()):
        out[t].append(hit)
    return out


_HIT = "struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double, first_word: bigint>"
_HIT_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())]))


@keeps_names
def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, question: float = 0.6, answer: float = 0.6) -> DataFrame:
    """docs with leaks: the items of the benchmark that a passage holds, in question and in answer.

    Null and empty texts hold nothing, null items and items without words are held by nothing;
    repeated items are found each. A column named leaks is replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = max(1, -(-benchmark.count() // ITEMS_PER_INDEX))
    docs = docs.drop("leaks")
    names = docs.columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))

    def part(k: int) -> list:
        return items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()

    whole = Statistics(Counter())
    for k in range(n if n > 1 else 0):
        whole.add([r.t for r in part(k)])

    def build(k: int) -> Index:
        rows = sorted(part(k), key=lambda r: (r.i is None, r.i, r.t))
        return build_index([r.i for r in rows], [r.t for r in rows], whole if n > 1 else None)

    if n == 1:
        (only,) = (build(0),)
        get = lambda k: only
    else:  # indexes in shared files, each of a bounded number of items; driver and tasks hold one at a time
        folder = new_path(spark, "indexes")
        for k in range(n):
            write_file(f"{folder}/{k}", pickle.dumps(build(k)))
        get = lambda k: _stored_index(f"{folder}/{k}")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches, names.index(text), 0 if n == 1 else SEARCHED_BYTES):
            hits: list[list] = [[] for _ in held]
            for k in range(n):
                index = get(k)
                for mine, batch in zip(hits, held, strict=True):
                    texts, found = texts_of(batch.column(names.index(text))), []
                    for a, b in slices(texts, 1_000_000):
                        found += search_batch(index, texts[a:b], threshold, question, answer)
                    mine[:] = [x + y for x, y in zip(mine, found, strict=True)] if k else found
            for mine, batch in zip(hits, held, strict=True):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mine, _HIT_TYPE)], [*names, "leaks"])

    return docs.mapInArrow(run, f"{ddl}, leaks array<{_HIT}>")


def _held(batches: Iterator[pa.RecordBatch], text: int, least: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at least so many bytes of text."""
    out, size = [], 0
    for batch in batches:
        out.append(batch)
        size += batch.column(text).nbytes
        if size >= least:
            yield out
            out, size = [], 0
    if out:
        yield out


@lru_cache(maxsize=1)
def _stored_index(path: str) -> Index:
    return pickle.loads(read_file(path))


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every test item that a document holds, with its best passage's figures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("_l")).select("doc_id", "_l.*")
