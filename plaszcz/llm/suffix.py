"""Removal of repeated passages by sparse distributed prefix doubling.

A string of `threshold` bytes counts as repeated if it also starts anywhere else. As in
prefix doubling, positions get ranks for their first L bytes, Spark brings equal ranks
together, positions whose rank is unique leave, and the others are ranked again by the pair
(rank at p, rank at p + L), until they are unique or 2 L reaches the threshold.

Not every position needs a rank of its own in the first round. Among any threshold - L + 1
consecutive positions the one whose L bytes hash least is an anchor; equal strings of
`threshold` bytes hold the same anchor at the same distance, so a string without a repeated
anchor is not repeated. Anchors are about 2 in threshold - L + 2 positions.

1. Rank of an anchor: a hash of its L bytes. Anchors with a unique rank leave.
2. Rank of its surroundings, all bytes of all strings whose anchor it may be: if these are
   equal too, all these strings are repeated.
3. For the others, every string around the anchor is ranked by the pair of its halves'
   ranks, sorted within the anchor's rank; equal pairs at one distance are repeated.

Ranks are hashes, named alike in every task, so no round renumbers them: two of 64 bits
decide each equality. Counts are aggregated before any shuffle, joins can be split by
adaptive execution. A rank with more surroundings than GROUP_ROWS is not brought together:
its strings are dealt out one by one, by rank, distance and pair, so that a task takes a share
of the rank's strings and reads equal ones as they stream by, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, keeps_names, stage, table
from .words import slices, tidy
from .xxh import xxh64_ranges

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_VALUES = np.random.default_rng(64_200).integers(0, 2**64, 256, dtype=np.uint64)
#: Surroundings of one rank that one task compares; the strings of larger ranks are dealt out.
GROUP_ROWS = 20_000
#: Surroundings that one row of the table of texts carries.
_ROW_ASKS = 4_096
_PIECE = 1 << 20
#: Strings compared at once within the groups that a task holds.
_WINDOWS = 250_000
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _BASE), np.full(size, np.uint64(pow(int(_BASE), -1, 2**64)))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from each position; positions without so many are left out."""
    n = len(data)
    if n < length:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
        return _mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def anchors(data: np.ndarray, bounds: np.ndarray, threshold: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all texts (bounds: where each begins, n + 1) and their ranks.

    Data of at most 2**24 bytes.
    """
    window = threshold - length + 1
    if len(data) < threshold:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    rank = ranks(data, length)
    key = (rank & ~np.uint64(0xFFFFFF)) | np.arange(len(rank), dtype=np.uint64)  # ties go to the left
    least, size = key, 1
    while size * 2 <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[: len(key) - window + 1], least[window - size : window - size + len(key) - window + 1])
    room = np.repeat(bounds[1:], np.diff(bounds))[: len(least)] - np.arange(len(least))
    least = (least[room >= threshold] & np.uint64(0xFFFFFF)).astype(np.int64)
    if not least.size:
        return least, np.empty(0, np.uint64)
    at = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return at, rank[at]


def _surroundings(bounds: np.ndarray, at: np.ndarray, threshold: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte + 1 of all strings whose anchor may be at `at`."""
    owner = np.searchsorted(bounds, at, side="right") - 1
    return np.maximum(bounds[owner], at - (threshold - length)), np.minimum(bounds[owner + 1], at + threshold)


def _pieces(sizes: np.ndarray, threshold: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) of up to about _PIECE bytes; long texts in overlapping parts."""
    held, total = [], 0
    for i, n in enumerate(sizes.tolist()):
        if n < threshold:
            continue
        for a in range(0, max(1, n - threshold + 1), _PIECE):
            b = min(n, a + _PIECE + threshold - 1)
            if held and total + b - a > _PIECE:
                yield held
                held, total = [], 0
            held.append((i, a, b))
            total += b - a
    if held:
        yield held


def _bytes_column(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def text_anchors(texts: pa.Array, threshold: int, length: int) -> tuple[np.ndarray, ...]:
    """(text, position, rank, rank of the surroundings) of all anchors of binary texts."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    for piece in _pieces(sizes, threshold):
        data = np.frombuffer(b"".join(texts[i].as_buffer()[a:b] for i, a, b in piece), np.uint8)
        bounds = np.concatenate(([0], np.cumsum([b - a for _, a, b in piece])))
        at, rank = anchors(data, bounds, threshold, length)
        part = np.searchsorted(bounds, at, side="right") - 1
        lo, hi = _surroundings(bounds, at, threshold, length)
        text, offset, end = (np.array(x, np.int64) for x in zip(*piece, strict=True))
        around = xxh64_ranges(data.tobytes(), lo, hi - lo, 200) ^ _mix((at - lo).astype(np.uint64))
        for k in np.flatnonzero((offset > 0) | (end < sizes[text])):  # parts of a long text: look beyond the part
            mine = np.flatnonzero(part == k)
            whole = texts[int(text[k])].as_buffer()
            full = np.array([0, sizes[text[k]]])
            a, b = _surroundings(full, at[mine] - bounds[k] + offset[k], threshold, length)
            view = bytes(whole[int(a.min()) : int(b.max())]) if len(mine) else b""
            if len(mine):
                around[mine] = xxh64_ranges(view, a - a.min(), b - a, 200) ^ _mix((at[mine] - bounds[k] + offset[k] - a).astype(np.uint64))
        where = at - bounds[part] + offset[part]
        out.append((text[part], where, rank, around))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    text, where, rank, around = (np.concatenate(x) for x in zip(*out, strict=True))
    once = np.unique(np.stack([text, where]), axis=1, return_index=True)[1] if len(text) and (sizes > _PIECE).any() else slice(None)
    return text[once], where[once], rank[once], around[once]


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of ranges as maximal runs."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    return list(zip(start[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def repeated_pairs(group: np.ndarray, left: np.ndarray, around: pa.Array, threshold: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset in its surroundings) of every string that also occurs at the same distance from an anchor of its group."""
    sizes = pc.binary_length(around).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(around.to_pylist()), np.uint8)
    begin = np.cumsum(sizes) - sizes
    parts = (ranks(data[a : a + _PIECE // 2 + length - 1], length) for a in range(0, max(1, len(data)), _PIECE // 2))
    rank = np.concatenate([*parts, np.empty(0, np.uint64)])
    n = np.maximum(sizes - threshold + 1, 0)
    rows, offsets = [], []
    step = max(1, _WINDOWS // max(1, len(sizes)))
    for d in range(0, threshold - length + 1, step):  # strings at different distances are never compared
        distance = np.arange(d, min(d + step, threshold - length + 1))
        at = left[:, None] - distance
        row, k = np.nonzero((at >= 0) & (at < n[:, None]))
        offset = at[row, k]
        first, second = rank[begin[row] + offset], rank[begin[row] + offset + threshold - length]
        scope = _mix(group[row].astype(np.uint64) * np.uint64(1 << 20) + distance[k].astype(np.uint64))
        order = np.lexsort((second, first ^ scope))
        a, b, s = first[order], second[order], scope[order]
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (s[1:] == s[:-1])
        found = order[same[1:] | same[:-1]]
        rows.append(row[found])
        offsets.append(offset[found])
    return np.concatenate(rows), np.concatenate(offsets)


def _spans_by_row(row: np.ndarray, offset: np.ndarray, base: np.ndarray, n_rows: int, threshold: int) -> list[list[tuple[int, int]]]:
    order = np.argsort(row, kind="stable")
    cuts = np.searchsorted(row[order], np.arange(n_rows + 1))
    out = []
    for i in range(n_rows):
        at = base[i] + offset[order[cuts[i] : cuts[i + 1]]]
        out.append(merge_spans(at, at + threshold))
    return out


_SPANS = "array<struct<start: bigint, end: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _span_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32)
    flat = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
    both = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at), both)


@keeps_names
def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 200, group_rows: int = GROUP_ROWS, readable: bool = False) -> DataFrame:
    """docs with kept (binary: the text's bytes without repeated ones) and removed (spans of bytes, by start).

    A byte is removed if a string of `threshold` bytes around it also starts anywhere else
    in any text, its own included; the first occurrence is no exception. Rows are texts of
    their own even if they are equal in all columns. Null and empty texts, and texts shorter
    than the threshold, keep all their bytes; no rows give no rows. readable adds kept_text,
    the kept bytes as a string without characters of which a cut has taken some bytes.
    Columns named kept, removed and kept_text are replaced, others stay.
    """
    spark = docs.sparkSession
    length = threshold // 2
    docs = docs.drop("kept", "removed", "kept_text").withColumn("_d", F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long"))).withColumn("_r", F.xxhash64(text))

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_column(batch.column(2))
            for a, b in slices(texts, _PIECE):
                row, at, rank, around = text_anchors(texts[a:b], threshold, length)
                pick = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at.astype(np.int32)), pa.array(rank.view(np.int64)), pa.array(around.view(np.int64))], ["_d", "_r", "_at", "_h", "_c"])

    found, found_path = stage(docs.select("_d", "_r", text).mapInArrow(find, "_d bigint, _r bigint, _at int, _h bigint, _c bigint"), "anchors")
    # written first: a join of two plain exchanges can be split where one rank has many anchors
    again, again_path = stage(found.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"), "ranks")
    live, live_path = stage(found.join(again, "_h", "left_semi"), "anchors")
    discard(spark, found_path, again_path)

    # by surroundings: how often, one that stands for all, and which ranks have a lone one
    kinds = live.groupBy("_h", "_c").agg(F.count("*").alias("_n"), F.min(F.struct("_d", "_r", "_at")).alias("_one"))
    kinds, kinds_path = stage(kinds, "surroundings")
    mixed, mixed_path = stage(kinds.groupBy("_h").agg(F.count("*").alias("_kinds"), F.min("_n").alias("_least")).filter("_least = 1"), "mixed")
    whole = live.join(kinds.filter("_n > 1").select("_h", "_c"), ["_h", "_c"], "left_semi")
    asked = kinds.join(mixed, "_h").select("_one.*", "_h", "_n", (F.col("_kinds") > group_rows).alias("_hot"))
    none = F.lit(None)
    marks = whole.select("_d", "_r", "_at", none.cast("long").alias("_h"), F.lit(0).cast("long").alias("_n"), F.lit(False).alias("_hot")).unionByName(asked)
    marks = marks.groupBy("_d", "_r").agg(F.collect_list(F.struct("_at", "_h", "_n", "_hot")).alias("_marks"))

    rest = [f for f in docs.schema.fields]
    names = [f.name for f in rest]
    ask_type = pa.list_(pa.struct([("h", pa.int64()), ("base", pa.int64()), ("left", pa.int32()), ("lone", pa.bool_()), ("hot", pa.bool_()), ("around", pa.binary())]))
    ask_ddl = "array<struct<h: bigint, base: bigint, left: int, lone: boolean, hot: boolean, around: binary>>"
    base_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    @tidy
    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_column(batch.column(names.index(text)))
            for a, b in slices(texts, _PIECE):
                spans, asks, owner = [], [], []
                for i, marks_of in enumerate(batch.column(len(names))[a:b].to_pylist(), a):
                    raw = texts[i].as_buffer()
                    at = np.array([m["_at"] for m in marks_of or ()], np.int64)
                    lo, hi = _surroundings(np.array([0, len(raw)]), at, threshold, length)
                    sure = np.array([m["_h"] is None for m in marks_of or ()], bool)
                    spans.append(merge_spans(lo[sure], hi[sure]))
                    own = [
                        {"h": m["_h"], "base": int(lo[k]), "left": int(at[k] - lo[k]), "lone": m["_n"] == 1, "hot": m["_hot"], "around": bytes(raw[int(lo[k]) : int(hi[k])])}
                        for k, m in enumerate(marks_of or ()) if m["_h"] is not None
                    ]
                    for k in range(0, max(1, len(own)), _ROW_ASKS):  # a long text's surroundings go on in rows without the text
                        asks.append(own[k : k + _ROW_ASKS])
                        owner.append((i, k == 0))
                pick = pa.array([i for i, _ in owner], pa.int64())
                whole = pa.array([first for _, first in owner], pa.bool_())
                columns = [c.take(pick) if n in ("_d", "_r") else c.take(pc.if_else(whole, pick, None)) for n, c in zip(names, batch.columns)]
                sure_of = _span_array(spans).take(pc.subtract(pick, a))
                yield pa.RecordBatch.from_arrays([*columns, sure_of, pa.array(asks, ask_type), whole], [*names, "_sure", "_asks", "_whole"])

    laid, _ = stage(docs.join(marks, ["_d", "_r"], "left").select(*names, "_marks").mapInArrow(lay_out, f"{base_ddl}, _sure {_SPANS}, _asks {ask_ddl}, _whole boolean"), "laid-out")
    discard(spark, live_path, kinds_path, mixed_path)

    asks = laid.filter(F.size("_asks") > 0).select("_d", "_r", F.explode("_asks").alias("_a")).select("_d", "_r", "_a.*")
    spans, _ = stage(_resolve(asks, threshold, length).groupBy("_d", "_r").agg(F.flatten(F.collect_list("_spans")).alias("_more")), "spans")
    open_ = laid.filter((F.size("_asks") > 0) & F.col("_whole")).drop("_asks").join(spans, ["_d", "_r"], "left").select(*names, "_sure", "_more")
    done = laid.filter(F.size("_asks") == 0).select(*names, "_sure", F.lit(None).cast(_SPANS).alias("_more"))
    out_names = [n for n in names if n not in ("_d", "_r")]
    out_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest if f.name in out_names)

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes_column(batch.column(names.index(text)))
            for a, b in slices(texts, _PIECE):
                kept, removed = [], []
                both_lists = (batch.column(len(names) + k)[a:b].to_pylist() for k in range(2))
                for i, (sure, more) in enumerate(zip(*both_lists, strict=True), a):
                    both = np.array([(s["start"], s["end"]) for s in [*sure, *(more or [])]], np.int64).reshape(-1, 2)
                    runs = merge_spans(both[:, 0], both[:, 1])
                    raw, at, parts = texts[i].as_buffer(), 0, []
                    for start, end in runs:
                        parts.append(bytes(raw[at:start]))
                        at = end
                    parts.append(bytes(raw[at : len(raw)]))
                    kept.append(b"".join(parts))
                    removed.append(runs)
                made = [pa.array(kept, pa.binary()), _span_array(removed)]
                if readable:
                    made.append(pa.array([k.decode(errors="ignore") for k in kept], pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(n))[a:b] for n in out_names), *made], [*out_names, "kept", "removed", *["kept_text"] * readable])

    return done.unionByName(open_).mapInArrow(cut, f"{out_ddl}, kept binary, removed {_SPANS}" + ", kept_text string" * readable)


def _resolve(asks: DataFrame, threshold: int, length: int) -> DataFrame:
    """(_d, _r, _spans) of the surroundings that occur once but hold strings that do not."""

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            group, left, base = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("h", "left", "base"))
            row, offset = repeated_pairs(group, left.astype(np.int64), rows.column("around").combine_chunks(), threshold, length)
            lone = rows.column("lone").to_numpy(zero_copy_only=False)
            keep = lone[row]
            spans = _span_array(_spans_by_row(row[keep], offset[keep], base, len(base), threshold))
            out = pa.table([rows.column("_d"), rows.column("_r"), spans], ["_d", "_r", "_spans"])
            yield from out.filter(pc.greater(pc.list_value_length(spans), 0)).combine_chunks().to_batches()

    plain = asks.filter("NOT hot").drop("hot").repartition("h").sortWithinPartitions("h")
    small = plain.mapInArrow(compare, f"_d bigint, _r bigint, _spans {_SPANS}")

    @tidy
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                rows = batch.slice(a, 1_000)
                h, left, base = (rows.column(n).to_numpy().astype(np.int64) for n in ("h", "left", "base"))
                row, offset, first, second = string_ranks(rows.column("around"), threshold, length)
                near = _mix(_mix(h[row].view(np.uint64)) ^ (left[row] - offset).astype(np.uint64))
                pick = pa.array(row)
                made = [pa.array(base[row] + offset), rows.column("lone").take(pick), pa.array(_mix(near ^ first).view(np.int64)), pa.array(second.view(np.int64))]
                yield pa.RecordBatch.from_arrays([rows.column("_d").take(pick), rows.column("_r").take(pick), *made], ["_d", "_r", "at", "lone", "first", "second"])

    @tidy
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again = None, False  # the row that waits for the next one, and whether it equals the one before it
        for batch in batches:
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            first, second = (batch.column(n).to_numpy() for n in ("first", "second"))
            same = np.zeros(batch.num_rows + 1, bool)
            same[0] = again
            same[1:-1] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
            keep = (same[1:] | same[:-1])[:-1] & batch.column("lone").to_numpy(zero_copy_only=False)[:-1]
            yield spans_of(batch.slice(0, batch.num_rows - 1).filter(pa.array(keep)))
            last, again = pa.RecordBatch.from_arrays([c.take(pa.array([batch.num_rows - 1])) for c in batch.columns], batch.schema.names), bool(same[-2])
        if again and last is not None and last.column("lone")[0].as_py():
            yield spans_of(last)

    def spans_of(rows: pa.RecordBatch) -> pa.RecordBatch:
        at = rows.column("at").to_numpy()
        spans = pa.StructArray.from_arrays([pa.array(at), pa.array(at + threshold)], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), spans)
        return pa.RecordBatch.from_arrays([rows.column("_d"), rows.column("_r"), lists], ["_d", "_r", "_spans"])

    hot = asks.filter("hot")
    if not hot.limit(1).count():
        return small
    each = hot.mapInArrow(strings, "_d bigint, _r bigint, at bigint, lone boolean, first bigint, second bigint")
    dealt = each.repartition("first").sortWithinPartitions("first", "second")
    return small.unionByName(dealt.mapInArrow(repeated, f"_d bigint, _r bigint, _spans {_SPANS}"))


def string_ranks(around: pa.Array, threshold: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, ranks of both halves) of every string of `threshold` bytes in the surroundings."""
    sizes = pc.binary_length(around).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    rank = ranks(np.frombuffer(b"".join(around.to_pylist()), np.uint8), length)
    n = np.maximum(sizes - threshold + 1, 0)
    row = np.repeat(np.arange(len(sizes)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[row] + offset
    return row, offset, rank[at], rank[at + threshold - length]


def _by_group(batches: Iterator[pa.RecordBatch], rows: int = 5_000) -> Iterator[pa.Table]:
    """Rows sorted by h in tables of about `rows` rows that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held)
        h = t.column("h").to_numpy()
        new = np.flatnonzero(h[1:] != h[:-1])
        if new.size:
            end = int(new[-1]) + 1
            yield t.slice(0, end)
            held = t.slice(end).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def op2_suffix(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 200-byte strings, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
