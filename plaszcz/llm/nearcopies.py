"""Near copies by Jaccard similarity of five-word shingle sets, for filtering: SimHash finds, sets decide.

Buckets are a text's least distinct shingle hashes: of two texts of similarity 0.8 or more, all
but about one pair in 10**5 share one of their 8 least. Within a bucket a pair is a candidate
if its set sizes allow 0.8 and its fingerprints differ in at most REACH bits; fingerprints are
of the distinct shingles. At a similarity of 0.8 the distance is about binomial(64, 0.151), so
about 3 pairs in 10**6 lie further apart; fingerprints of small sets vary more and are not
asked. Pivot distances discard pairs before bits are counted. Rows that have a candidate get
their whole sets, and texts are linked where the sets themselves are similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import _SHIFT_ROWS, SLAB_ROWS, _majority, pivot_distances, shingle_hashes
from .store import discard, keeps_names, stage
from .words import slices, texts_of, tidy

WORDS, REACH, SKETCH, PIVOTS = 5, 24, 8, 4
#: Sets of up to so many shingles are compared whatever their fingerprints.
SMALL = 16
#: Shingles that are compared at a time.
_AT_ONCE = 1_000_000


def distinct_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and each text's first."""
    hashes, base = shingle_hashes(texts, WORDS, 42)
    parts = [np.unique(hashes[a:b]) for a, b in zip(base[:-1], base[1:], strict=True)]
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


def _least(hashes: np.ndarray, base: np.ndarray, k: int) -> pa.Array:
    """The k least distinct hashes of each text; a text without any has the key 0."""
    out = []
    for a, b in zip(base[:-1], base[1:], strict=True):
        out.append((np.unique(hashes[a:b])[:k] if b > a else np.zeros(1, np.uint64)).view(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def sketches(df: DataFrame, node: str, text: str) -> DataFrame:
    """(_node, _fp, _size, _keys) of each text: SimHash, number and least hashes of its distinct shingles."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                hashes, base = distinct_shingles(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(_majority(hashes, base).view(np.int64)), pa.array(np.diff(base)), _least(hashes, base, SKETCH)], ["_node", "_fp", "_size", "_keys"])

    return df.select(node, text).mapInArrow(run, "_node bigint, _fp bigint, _size bigint, _keys array<bigint>")


def shingle_sets(df: DataFrame, node: str, text: str) -> DataFrame:
    """(_node, _set) of each text: its distinct shingle hashes, ascending as unsigned numbers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, 2_000_000):
                hashes, base = distinct_shingles(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(hashes.view(np.int64)))], ["_node", "_set"])

    return df.select(node, text).mapInArrow(run, "_node bigint, _set array<bigint>")


def _possible(i, j, fp: np.ndarray, size: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Whether sizes and fingerprints of rows i and j allow a similarity of 0.8."""
    low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    near = np.abs(pivots[i] - pivots[j]).max(axis=-1) <= REACH
    near &= np.bitwise_count(fp[i] ^ fp[j]) <= REACH
    return (5 * low >= 4 * high) & (near | (low <= SMALL))


def _split(bucket: np.ndarray) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], list[tuple[int, int]]]:
    """Pairs of rows of small buckets, a shift at a time, and the ranges of the large ones; bucket is sorted."""
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(bucket)])))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows, shift = np.flatnonzero(np.repeat(sizes, sizes) <= _SHIFT_ROWS), 1
        while rows.size:
            rows = rows[rows + shift < len(bucket)]
            rows = rows[bucket[rows + shift] == bucket[rows]]
            yield rows, rows + shift
            shift += 1

    return pairs(), [(int(s), int(s + n)) for s, n in zip(starts, sizes, strict=True) if n > _SHIFT_ROWS]


def paired(bucket: np.ndarray, fp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each row is a candidate with another row of its bucket."""
    pivots, out = pivot_distances(fp, PIVOTS).astype(np.int16), np.zeros(len(fp), bool)
    pairs, large = _split(bucket)
    for i, j in pairs:
        ok = _possible(i, j, fp, size, pivots)
        out[i[ok]] = out[j[ok]] = True
    for a, b in large:
        for i in range(a, b - 1):
            if out[i : b].all():
                break
            j = i + 1 + np.flatnonzero(_possible(i, slice(i + 1, b), fp, size, pivots))
            out[j] = True
            out[i] |= bool(j.size)
    return out


class _Sets:
    """Hash sets of rows, one after another and each ascending, to be intersected."""

    def __init__(self, flat: np.ndarray, base: np.ndarray) -> None:
        names, ids = np.unique(flat, return_inverse=True)
        self.base, self.size, self.ids, self.n = base, np.diff(base), ids.astype(np.int64), max(1, len(names))
        self.keys = np.repeat(np.arange(len(self.size)), self.size) * self.n + self.ids
        self.mark = np.zeros(self.n, bool)

    def _elements(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        return owner, self.ids[np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + self.base[rows][owner]]

    def _chunks(self, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        total = np.concatenate(([0], np.cumsum(self.size[rows])))
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, total[a] + _AT_ONCE, side="right")) - 1)
            yield a, b
            a = b

    def _similar(self, one, other, shared: np.ndarray) -> np.ndarray:
        return 5 * shared >= 4 * (self.size[one] + self.size[other] - shared)

    def similar_pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the Jaccard similarity of each pair's sets is at least 0.8."""
        out = np.zeros(len(i), bool)
        for a, b in self._chunks(i):
            owner, ids = self._elements(i[a:b])
            want = j[a:b][owner] * self.n + ids
            at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
            shared = np.bincount(owner[self.keys[at] == want], minlength=b - a)
            out[a:b] = self._similar(i[a:b], j[a:b], shared)
        return out

    def similar_to(self, i: int, j: np.ndarray) -> np.ndarray:
        """Whether the similarity of row i and each of rows j is at least 0.8."""
        out, own = np.zeros(len(j), bool), self.ids[self.base[i] : self.base[i + 1]]
        self.mark[own] = True
        for a, b in self._chunks(j):
            owner, ids = self._elements(j[a:b])
            out[a:b] = self._similar(i, j[a:b], np.bincount(owner[self.mark[ids]], minlength=b - a))
        self.mark[own] = False
        return out


def verified_links(bucket: np.ndarray, fp: np.ndarray, flat: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rows i, j) of similar sets that connect what candidates connect within each bucket; bucket is sorted."""
    sets, pivots = _Sets(flat, base), pivot_distances(fp, PIVOTS).astype(np.int16)
    pairs, large = _split(bucket)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in pairs:
        ok = _possible(i, j, fp, sets.size, pivots)
        i, j = i[ok], j[ok]
        ok = sets.similar_pairs(i, j)
        left.append(i[ok])
        right.append(j[ok])
    for a, b in large:  # a spanning forest, breadth first
        rest = np.arange(a, b)
        while rest.size:
            front, rest = [int(rest[0])], rest[1:]
            while front:
                i = front.pop()
                at = np.flatnonzero(_possible(i, rest, fp, sets.size, pivots))
                at = at[sets.similar_to(i, rest[at])] if at.size else at
                if at.size:
                    j, rest = rest[at], np.delete(rest, at)
                    front.extend(j.tolist())
                    left.append(np.full(len(j), i))
                    right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _dealt(drawn: DataFrame, slab_rows: int) -> DataFrame:
    """(_key, _cell, _fp, _size, _node) with buckets of more than slab_rows rows cut by set size.

    A row of such a bucket stands in its size's slab and the one below; sizes that allow a
    similarity of 0.8 are at most one slab apart.
    """
    dealt = drawn.select(F.explode("_keys").alias("_key"), "_fp", "_size", "_node")
    sizes, _ = stage(dealt.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > slab_rows), "buckets")
    whole = F.array(F.lit(0).cast("long"))
    if sizes.limit(1).count():
        slab = F.floor(F.log(F.greatest("_size", F.lit(1)).cast("double")) / math.log(1.26))
        dealt = dealt.join(sizes, "_key", "left").withColumn("_cells", F.when(F.col("_n").isNull(), whole).otherwise(F.array(slab, slab - 1)))
    else:
        dealt = dealt.withColumn("_cells", whole)
    return dealt.select("_key", F.explode("_cells").alias("_cell"), "_fp", "_size", "_node")


def _links(drawn: DataFrame, marked: DataFrame, text: str, slab_rows: int = SLAB_ROWS) -> DataFrame:
    """drawn (_node, _fp, _size, _keys), marked (_node and text) -> links (u, v) of similar nodes."""

    @tidy
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _whole_buckets(batches, 50_000):
            fp, size = (rows.column(c).to_numpy() for c in ("_fp", "_size"))
            keep = paired(bucket, fp.view(np.uint64), size)
            yield from rows.select(["_key", "_cell", "_fp", "_node"]).filter(pa.array(keep)).to_batches()

    rows = _dealt(drawn, slab_rows).repartition("_key", "_cell").sortWithinPartitions("_key", "_cell")
    picked, _ = stage(rows.mapInArrow(pick, "_key bigint, _cell bigint, _fp bigint, _node bigint"), "paired")
    once, _ = stage(_once(picked), "buckets")
    picked = picked.join(once, ["_key", "_cell"], "left_semi")
    # both sides are dealt by node, so texts move once
    texts = marked.select("_node", text).dropDuplicates(["_node"]).join(picked.select("_node").distinct(), "_node", "left_semi")
    sets = shingle_sets(texts, "_node", text)
    full = picked.join(sets, "_node").select("_key", "_cell", "_fp", "_node", "_set")
    full = full.repartition("_key", "_cell").sortWithinPartitions("_key", "_cell")

    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _whole_buckets(batches, 50_000):
            fp, node = (rows.column(c).to_numpy() for c in ("_fp", "_node"))
            lists = rows.column("_set").combine_chunks()
            base = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))))
            i, j = verified_links(bucket, fp.view(np.uint64), lists.flatten().to_numpy().view(np.uint64), base)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["u", "v"])

    return full.mapInArrow(verify, "u bigint, v bigint")


def _once(picked: DataFrame) -> DataFrame:
    """(_key, _cell) of one bucket for each set of nodes: buckets of the same nodes, as most copies' 8 are, give the same links.

    Sets are told apart by their size and two hashes of 64 bits.
    """
    mixed = [F.bit_xor(F.xxhash64("_node", F.lit(seed))).alias(f"_x{seed}") for seed in (1, 2)]
    buckets = picked.groupBy("_key", "_cell").agg(F.count("*").alias("_n"), *mixed)
    return buckets.groupBy("_n", "_x1", "_x2").agg(F.min(F.struct("_key", "_cell")).alias("_one")).select("_one.*")


def _whole_buckets(batches: Iterator[pa.RecordBatch], most_rows: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Sorted rows in runs of some most_rows, or 8 MB, that end where a bucket ends: (bucket number, rows)."""

    def numbered(rows: pa.Table) -> np.ndarray:
        key, cell = rows.column("_key").to_numpy(), rows.column("_cell").to_numpy()
        return np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (cell[1:] != cell[:-1]))))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            held.append(batch.slice(a, 1000))
            if sum(x.num_rows for x in held) < most_rows and sum(x.nbytes for x in held) < 8 * _AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            bucket = numbered(rows)
            end = int(np.searchsorted(bucket, bucket[-1]))
            if end:
                yield bucket[:end], rows.slice(0, end)
            held = rows.slice(end).combine_chunks().to_batches()
    rows = pa.Table.from_batches(held) if held else None
    if rows is not None and rows.num_rows:
        yield numbered(rows), rows


@keeps_names
def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of exact copies and of texts linked at a similarity of 0.8: that of the least doc_id.

    Null ids come last; of rows with one id and one group, one stays. Null texts count as
    empty, empty texts as copies of each other. All columns stay as they are.
    """
    spark = docs.sparkSession
    node = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marked = docs.withColumn("_node", node)
    drawn, drawn_path = stage(sketches(marked, "_node", text).dropDuplicates(["_node"]), "sketches")
    links, links_path = stage(_links(drawn, marked, text).distinct(), "near")
    roots, _ = stage(connected_components(links), "roots")
    discard(spark, links_path, drawn_path)
    order = F.coalesce(F.col(doc_id), F.lit(2**63 - 1))
    ids = marked.select("_node", order.alias("_order")).join(roots, F.col("_node") == F.col("node"), "left").select("_order", "_node", F.coalesce("root", "_node").alias("_group"))
    first = ids.groupBy("_group").agg(F.min(F.struct("_order", "_node")).alias("_one"))
    chosen, _ = stage(first.select("_one.*"), "chosen")
    kept = marked.withColumn("_order", order).join(chosen, ["_node", "_order"], "left_semi")
    return kept.dropDuplicates(["_node", "_order"]).drop("_node", "_order")
