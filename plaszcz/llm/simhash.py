"""SimHash fingerprints and their near-duplicate classes, with pivot distance tables.

Fingerprints at Hamming distance d share at least b - d of any b blocks of bits; rows are
dealt to buckets by each choice of b - d blocks, so no linked pair is missed. Within a
bucket every row carries its distances to fixed reference fingerprints (pivots). By the
triangle inequality the distance of a pair is at least the largest difference between
their pivot distances, so pairs that differ too much in any coordinate are discarded
without being compared; the survivors are verified by counting differing bits. Buckets
that outgrow one task are cut into overlapping slabs of pivot distance, which again keeps
every pair within reach together. A bucket yields links, not all its pairs: once rows are
known to be connected, no further link among them is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, keeps_names, stage, table
from .words import joined_words, slices, split_words, texts_of, tidy
from .xxh import xxh64_ranges

_BITS = np.arange(64, dtype=np.uint64)
#: Rows of a bucket that one task handles whole; larger ones are cut by pivot distance.
SLAB_ROWS = 4096
_SHIFT_ROWS = 48


def shingle_hashes(texts: pa.Array, n_words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, repeats included, and each text's first shingle.

    A text of fewer words than n_words has one shingle, one without words none.
    """
    words, first = split_words(pc.ascii_lower(texts))
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    counts = np.diff(first)
    n_shingles = np.where(counts == 0, 0, np.maximum(counts - n_words + 1, 1))
    base = np.concatenate(([0], np.cumsum(n_shingles)))
    owner = np.repeat(np.arange(len(counts)), n_shingles)
    head = first[owner] + (np.arange(base[-1]) - base[owner])
    last = np.minimum(head + n_words, first[owner + 1])
    return xxh64_ranges(joined_words(words), starts[head], starts[last] - 1 - starts[head], seed), base


def fingerprints(texts: pa.Array, n_words: int, seed: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text; no words give zero."""
    return _majority(*shingle_hashes(texts, n_words, seed))


def _majority(hashes: np.ndarray, base: np.ndarray) -> np.ndarray:
    out = np.zeros(len(base) - 1, np.uint64)
    full = np.flatnonzero(np.diff(base) > 0)
    if full.size:
        for bit in _BITS:
            ones = np.add.reduceat((hashes >> bit & np.uint64(1)).astype(np.int32), base[full])
            out[full] |= (2 * ones > np.diff(base)[full]).astype(np.uint64) << bit
    return out


def fingerprint_table(df: DataFrame, text: str = "text", n_words: int = 4, seed: int = 42, column: str = "_fp") -> DataFrame:
    """df without its text, with the fingerprint as a signed long. A null text has no words."""
    rest = [f for f in df.schema.fields if f.name not in (text, column)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{column}` bigint"])
    names = [f.name for f in rest]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(len(names)))
            for a, b in slices(texts, 2_000_000):
                fp = fingerprints(texts[a:b], n_words, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(names))), pa.array(fp)], [*names, column])

    return df.select(*names, text).mapInArrow(run, schema)


def _pivots(n: int) -> np.ndarray:
    return np.random.default_rng(20_11).integers(0, 2**64, n, dtype=np.uint64)


def pivot_distances(fp: np.ndarray, n: int) -> np.ndarray:
    """Hamming distance of each fingerprint (unsigned) to each of n fixed pivots."""
    return np.stack([np.bitwise_count(fp ^ p) for p in _pivots(n)], axis=1)


def _blocks_for(n_rows: int, reach: int) -> int:
    """Fewest blocks whose buckets hold few rows each if fingerprints were spread evenly."""
    for blocks in range(reach + 1, reach + 5):
        if n_rows <= 64 * 2 ** (64 * (blocks - reach) // blocks):
            break
    return blocks


def bucket_keys(fp: np.ndarray, blocks: int, reach: int) -> list[np.ndarray]:
    """For each choice of blocks - reach of the blocks, the bits of these blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for chosen in combinations(range(blocks), blocks - reach):
        key = np.zeros(len(fp), np.uint64)
        for c in chosen:
            key = (key << np.uint64(edges[c + 1] - edges[c])) | parts[c]
        keys.append(key.view(np.int64))
    return keys


def slabs(distance: np.ndarray, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, slab): every row in the slab of its pivot distance, and in the one below if within reach of it."""
    width = 2 * reach + 1
    own = distance.astype(np.int64) // width
    low = np.flatnonzero((distance % width < reach) & (own > 0))
    return [(np.arange(len(own)), own), (low, own[low] - 1)]


def bucket_links(bucket: np.ndarray, fp: np.ndarray, reach: int, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows i, j) that connect what is connected within each bucket; bucket is sorted."""
    table_of = pivot_distances(fp, n_pivots).astype(np.int16)
    order = np.lexsort((table_of[:, 0], bucket))
    bucket, fp, table_of = bucket[order], fp[order], table_of[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(bucket)])))
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero(size_of <= _SHIFT_ROWS)
    shift = 1
    while small.size:  # rows of small buckets against the row `shift` further on
        small = small[small + shift < len(bucket)]
        small = small[(bucket[small + shift] == bucket[small]) & (table_of[small + shift, 0] - table_of[small, 0] <= reach)]
        i, j = small, small + shift
        for p in range(1, n_pivots):
            keep = np.abs(table_of[i, p] - table_of[j, p]) <= reach
            i, j = i[keep], j[keep]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= reach
        left.append(i[near])
        right.append(j[near])
        shift += 1
    for s, n in zip(starts[sizes > _SHIFT_ROWS], sizes[sizes > _SHIFT_ROWS], strict=True):
        a, b = _spanning_links(fp[s : s + n], table_of[s : s + n], reach)
        left.append(a + s)
        right.append(b + s)
    i, j = np.concatenate([*left, np.empty(0, np.int64)]), np.concatenate([*right, np.empty(0, np.int64)])
    return order[i.astype(np.int64)], order[j.astype(np.int64)]


def _spanning_links(fp: np.ndarray, coords: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one bucket, breadth first; rows are sorted by the first coordinate."""
    waiting = np.ones(len(fp), bool)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for seed in range(len(fp)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        front = [seed]
        while front:
            i = front.pop()
            lo = np.searchsorted(coords[:, 0], coords[i, 0] - reach)
            hi = np.searchsorted(coords[:, 0], coords[i, 0] + reach, side="right")
            j = lo + np.flatnonzero(waiting[lo:hi])
            for p in range(1, coords.shape[1]):
                j = j[np.abs(coords[j, p] - coords[i, p]) <= reach]
            j = j[np.bitwise_count(fp[j] ^ fp[i]) <= reach]
            waiting[j] = False
            front.extend(j.tolist())
            a.append(np.full(len(j), i))
            b.append(j)
    return np.concatenate([*a, np.empty(0, np.int64)]), np.concatenate([*b, np.empty(0, np.int64)])


def near_links(distinct_fp: DataFrame, reach: int = 4, n_pivots: int = 12, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """distinct_fp (_fp long) -> links (u, v) whose components are those of all pairs within reach."""
    blocks = _blocks_for(distinct_fp.count(), reach)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for t, key in enumerate(bucket_keys(fp.view(np.uint64), blocks, reach)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key), pa.array(fp)], ["_t", "_key", "_fp"])

    dealt = distinct_fp.select("_fp").mapInArrow(spread, "_t int, _key bigint, _fp bigint")
    sizes = dealt.groupBy("_t", "_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > slab_rows)
    sizes, _ = stage(sizes, "buckets")
    if sizes.limit(1).count():
        cut = dealt.join(sizes, ["_t", "_key"], "left").select("_t", "_key", "_fp", F.coalesce("_n", F.lit(0)).alias("_n"))
    else:
        cut = dealt.withColumn("_n", F.lit(0).cast("long"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, key, fp, n = (c.to_numpy() for c in batch.columns)
            cell = np.zeros(len(fp), np.int64)
            rows, at = np.arange(len(fp)), cell
            distance = pivot_distances(fp.view(np.uint64), n_pivots).astype(np.int64)
            for p in range(n_pivots):  # one more pivot for each doubling beyond what a task takes
                deep = n[rows] > slab_rows << p
                if not deep.any():
                    break
                parts = [(rows[~deep], at[~deep])]
                hot, hot_at = rows[deep], at[deep]
                parts += [(hot[r], hot_at[r] * 16 + s + 1) for r, s in slabs(distance[hot, p], reach)]
                rows, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t[rows], key[rows], at, fp[rows])], ["_t", "_key", "_cell", "_fp"])

    parts = cut.mapInArrow(cells, "_t int, _key bigint, _cell bigint, _fp bigint")
    parts = parts.repartition("_t", "_key", "_cell").sortWithinPartitions("_t", "_key", "_cell")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, fp in _whole_groups(batches):
            i, j = bucket_links(ids, fp.view(np.uint64), reach, n_pivots)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(fp[i], fp[j])), pa.array(np.minimum(fp[i], fp[j]))], ["u", "v"])

    return parts.mapInArrow(links, "u bigint, v bigint")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows in runs that end where a bucket ends: (bucket number, fingerprint)."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        now = tuple(c.to_numpy() for c in batch.columns)
        held.append(now)
        if sum(len(x[0]) for x in held) < 50_000:
            continue
        t, key, cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        new = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        if not new.any():
            held = [(t, key, cell, fp)]
            continue
        end = int(np.flatnonzero(new)[-1]) + 1
        yield np.concatenate(([0], np.cumsum(new[: end - 1]))), fp[:end]
        held = [(t[end:], key[end:], cell[end:], fp[end:])]
    if held:
        t, key, cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(fp):
            yield np.concatenate(([0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))), fp


@keeps_names
def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n_words: int = 4, reach: int = 4, seed: int = 42) -> DataFrame:
    """df's columns other than the text, with fingerprint (16 hex digits) and component_id.

    component_id is the least non-null doc_id that can be reached by links of at most `reach`
    differing bits, the row itself included; null if every reachable doc_id is null. Null and
    empty texts, and texts of white space, have fingerprint zero and are linked like any
    other. Repeated rows stay. Columns named fingerprint and component_id are replaced. No
    rows give no rows.
    """
    spark = df.sparkSession
    df = df.drop("fingerprint", "component_id")
    marked, _ = stage(fingerprint_table(df, text, n_words, seed), "fingerprints")
    distinct_fp, held = stage(marked.groupBy("_fp").agg(F.min(doc_id).alias("_least")), "distinct")
    links, links_path = stage(near_links(distinct_fp, reach).distinct(), "near")
    roots, _ = stage(connected_components(links), "roots")
    discard(spark, links_path)
    classes = distinct_fp.join(roots, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = classes.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named, _ = stage(classes.join(least, "_root").select("_fp", "component_id"), "classes")
    discard(spark, held)
    return marked.join(named, "_fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0"))).drop("_fp")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of 4-word shingles and its component at 4 bits or fewer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "fingerprint", "component_id")
