"""Byte-level BPE, encoded through a pair occurrence index.

Texts are cut into words by array operations over code points. A partition is read in
slices; the distinct words of a slice that the partition has not shown yet are encoded
together: the index maps the rank of every mergeable pair to the positions where it occurs
in any of them. Active ranks are applied in ascending order, each to all its positions at
once, and only the lists of the neighbouring pairs are updated. Since a rank's merges are
applied in every word before a higher rank is looked at, every word ends as if it had been
merged on its own, lowest rank first. The ids of short words are kept, up to a bound, for
the partition's later slices; a slice is done and passed on before the next one is read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, table
from .words import slices, texts_of, tidy

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_NONE = np.int32(2**31 - 1)
SLICE_BYTES = 4_000_000
#: Words of up to KEPT_BYTES whose ids a task keeps from slice to slice; beyond KEPT_WORDS it starts anew.
KEPT_WORDS, KEPT_BYTES = 262_144, 48
#: Ids that are decoded at a time.
_DECODED_IDS = 1 << 17


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _SPACE
    return out


def word_starts(cp: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Mask of the code points at which a word begins; opens: where each text begins.

    Words are contractions ('s 't 're 've 'm 'll 'd), runs of letters, of numbers or of other
    characters with the one space before them, and white space, of which the last character
    before anything else stands apart.
    """
    n = len(cp)
    kind = _classes()[cp]
    begins = np.zeros(n + 1, bool)
    begins[opens] = True
    begins[n] = True
    white = kind == _SPACE
    changed = np.ones(n, bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed |= begins[:n]
    start = changed.copy()
    # the last white space before something else stands apart
    before_other = np.zeros(n, bool)
    before_other[:-1] = white[:-1] & ~white[1:] & ~begins[1:n]
    start |= before_other
    # a space goes with what follows it
    joined = np.zeros(n, bool)
    joined[1:] = before_other[:-1] & (cp[:-1] == 32)
    start &= ~joined
    for q in np.flatnonzero((cp == 39) & start).tolist():
        end = q + 1
        if end < n and not begins[end]:
            c = chr(cp[end])
            if c in "stmd":
                end += 1
            elif end + 1 < n and not begins[end + 1] and (c, chr(cp[end + 1])) in (("r", "e"), ("v", "e"), ("l", "l")):
                end += 2
        if end > q + 1:
            start[q + 1 : end] = False
            if end < n:
                start[end] = True
    return start


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts as byte strings, and each text's first word."""
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2])[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else b""
    cp = np.frombuffer(bytes(data).decode().encode("utf-32-le"), np.uint32)
    at_byte = np.empty(len(cp) + 1, np.int32)
    at_byte[0] = 0
    if len(cp) == len(data):
        at_byte[1:] = np.arange(1, len(cp) + 1)
    else:
        np.cumsum(1 + (cp > 0x7F).view(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF), out=at_byte[1:])
    text_at = np.searchsorted(at_byte, offsets - offsets[0])
    if not len(cp):
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    start = np.flatnonzero(word_starts(cp, text_at[:-1][np.diff(text_at) > 0]))
    bounds = np.append(at_byte[start], np.int32(len(data)))
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(bytes(data))])
    return words, np.searchsorted(start, text_at)


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        symbol = _byte_symbols()
        back = {c: b for b, c in symbol.items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        bytes_of = [b""] * size
        for token, i in vocab.items():
            bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            bytes_of[i] = token.encode()
        self.byte_id = np.array([vocab[symbol[b]] for b in range(256)], np.int32)
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.size, self._keys, self._ranks = size, keys[order], order.astype(np.int32)
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._same = np.array([a == b for a, b in pairs])
        lengths = np.array([len(b) for b in bytes_of], np.int64)
        self._token_at, self._token_size = np.cumsum(lengths) - lengths, lengths
        self._token_data = np.frombuffer(b"".join(bytes_of), np.uint8)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], _NONE)

    def encode_words(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the bytes of all words, sizes: of each -> all ids, and the number of ids of each word."""
        n = len(data)
        sym = self.byte_id[data]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(sizes)
        full = sizes > 0
        nxt[ends[full] - 1] = -1
        prv[(ends - sizes)[full]] = -1
        rank = np.full(n, _NONE, np.int32)
        open_ = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank[open_] = self._rank(sym[open_], sym[open_ + 1])
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._list(index, active, open_, rank[open_])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[rank[at] == r]
            if not at.size:
                continue
            if len(lists) > 1 or self._same[r]:
                at = np.unique(at)
            if self._same[r] and len(at) > 1:  # overlapping pairs: every other one of a run, from the left
                fresh = np.ones(len(at), bool)
                fresh[1:] = nxt[at[:-1]] != at[1:]
                run = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self._merged[r]
            alive[gone] = False
            rank[gone] = _NONE
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            touched = np.concatenate([at[has], before[before >= 0]])
            rank[at] = _NONE
            if touched.size:
                if self._same[r]:
                    touched = np.unique(touched)
                new = self._rank(sym[touched], sym[nxt[touched]])
                rank[touched] = new
                self._list(index, active, touched, new)
        kept = np.flatnonzero(alive)
        counts = np.diff(np.searchsorted(kept, np.concatenate(([0], ends))))
        return sym[kept], counts

    @staticmethod
    def _list(index: dict, active: list[int], at: np.ndarray, ranks: np.ndarray) -> None:
        some = ranks != _NONE
        at, ranks = at[some], ranks[some]
        if not at.size:
            return
        if at.size > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            parts, names = np.split(at, cuts), ranks[np.concatenate(([0], cuts))].tolist()
        else:
            parts, names = [at], ranks.tolist()
        for r, part in zip(names, parts, strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    def encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (binary), one after another, and the number of each word's."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        return self.encode_words(np.frombuffer(b"".join(words.to_pylist()), np.uint8), sizes)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes begin (n + 1 offsets)."""
        at = np.concatenate(([0], np.cumsum(self._token_size[ids])))
        out = np.empty(at[-1], np.uint8)
        for a in range(0, len(ids), _DECODED_IDS):
            part = ids[a : a + _DECODED_IDS]
            size = self._token_size[part]
            begin = np.cumsum(size) - size
            out[at[a] : at[a + len(part)]] = self._token_data[np.repeat(self._token_at[part] - begin, size) + np.arange(size.sum())]
        return out, at


def _check(spec: dict, path: str) -> None:
    """Raise unless the file asks for nothing but byte-level BPE as it is done here."""
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    wrong = [
        what
        for what, bad in (
            ("model", model.get("type") != "BPE"),
            ("model options", any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))),
            ("pre_tokenizer", cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False),
            ("normalizer", spec.get("normalizer")),
            ("decoder", (spec.get("decoder") or {}).get("type") != "ByteLevel"),
            ("added_tokens", any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip", "normalized"))),
        )
        if bad
    ]
    if wrong:
        raise ValueError(f"{path} is not plain byte-level BPE: {', '.join(wrong)}")


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start[i] : start[i] + size[i]] one after another, and where each begins (n + 1)."""
    at = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


def encode_batch(texts: pa.Array, bpe: Bpe, kept: dict[bytes, bytes] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, ids of these texts, where each text's ids begin) for slices of the batch.

    kept: ids of words that earlier slices have shown, for later ones.
    """
    kept = {} if kept is None else kept
    for a, b in slices(texts, SLICE_BYTES):
        segments, owner = _segments(texts[a:b], bpe)
        words, first = cut_words(segments)
        coded = words.dictionary_encode()
        ids, counts = _ids_of(coded.dictionary, bpe, kept)
        word = coded.indices.to_numpy(zero_copy_only=False)
        flat, word_at = gather(ids, (np.cumsum(counts) - counts)[word], counts[word])
        at = word_at[first]
        if owner is not None:
            flat, at = _with_special(flat, at, owner, b - a)
        yield a, b, flat, at


def _ids_of(words: pa.Array, bpe: Bpe, kept: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after another, and the number of each word's."""
    names = words.to_pylist()
    held = [kept.get(w) for w in names]
    new = [i for i, h in enumerate(held) if h is None]
    if new:
        ids, counts = bpe.encode_distinct(words.take(pa.array(new)))
        raw, ends = ids.astype(np.int32).tobytes(), np.cumsum(counts) * 4
        if len(kept) + len(new) > KEPT_WORDS:
            kept.clear()
        for i, size, end in zip(new, (counts * 4).tolist(), ends.tolist(), strict=True):
            held[i] = raw[end - size : end]
            if len(names[i]) <= KEPT_BYTES and len(kept) < KEPT_WORDS:
                kept[names[i]] = held[i]
    counts = np.fromiter(map(len, held), np.int64, len(held)) // 4
    return np.frombuffer(b"".join(held), np.int32), counts


def _segments(texts: pa.Array, bpe: Bpe) -> tuple[pa.Array, np.ndarray | None]:
    """Texts cut at special tokens; owner: (text, special id after the segment or -1), None if nothing is cut."""
    has = [s for s in bpe.special if pc.any(pc.match_substring(texts, s)).as_py()]
    if not has:
        return texts, None
    import re

    cut = re.compile("|".join(map(re.escape, sorted(has, key=len, reverse=True))))
    out, owner = [], []
    for i, t in enumerate(texts.to_pylist()):
        at = 0
        for m in cut.finditer(t):
            out.append(t[at : m.start()])
            owner.append((i, bpe.special[m[0]]))
            at = m.end()
        out.append(t[at:])
        owner.append((i, -1))
    return pa.array(out, pa.string()), np.array(owner, np.int64)


def _with_special(flat: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    follow = owner[:, 1] >= 0
    out = np.insert(flat, at[1:][follow], owner[follow, 1].astype(flat.dtype))
    sizes = np.diff(at) + follow
    return out, np.concatenate(([0], np.cumsum(np.bincount(owner[:, 0], sizes, n).astype(np.int64))))


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Byte strings data[at[i] : at[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, text: str = "text", tokenizer: str | None = None, decoded: bool = False) -> DataFrame:
    """docs without its text, with token_ids (little-endian unsigned 32-bit ids, binary) and n_tokens.

    decoded adds decoded_text, the text decoded from these ids. Special tokens that stand in
    a text are one id each. A null or empty text has no ids. Columns of these names are
    replaced; other columns, repeated rows and empty tables stay as they are.
    """
    path = tokenizer or default_tokenizer()
    bound_batches(docs.sparkSession)
    docs = docs.drop("token_ids", "n_tokens", "decoded_text")
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["token_ids binary", "n_tokens bigint"] + ["decoded_text string"] * decoded)
    columns = [*names, "token_ids", "n_tokens", *["decoded_text"] * decoded]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, kept = load(path), {}
        for batch in batches:
            for a, b, ids, at in encode_batch(texts_of(batch.column(len(names))), bpe, kept):
                made = [_binary(ids.astype("<u4").view(np.uint8), at * 4), pa.array(np.diff(at))]
                if decoded:
                    made.append(_decoded(bpe, ids, at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(names))), *made], columns)

    return docs.select(*names, text).mapInArrow(run, schema)


def _decoded(bpe: Bpe, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    data, token_at = bpe.decode_bytes(ids)
    raw = _binary(data, token_at[at])
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:  # ids that do not spell UTF-8
        return pa.array([x.decode(errors="replace") for x in raw.to_pylist()], pa.string())


def decode(tokens: DataFrame, ids: str = "token_ids", tokenizer: str | None = None) -> DataFrame:
    """tokens with decoded_text; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""
    path = tokenizer or default_tokenizer()
    bound_batches(tokens.sparkSession)
    tokens = tokens.drop("decoded_text")
    names = tokens.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields] + ["decoded_text string"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            column = pc.fill_null(batch.column(names.index(ids)), b"")
            for a, b in slices(column, 4 * SLICE_BYTES):
                part = column[a:b]
                flat = np.frombuffer(b"".join(part.to_pylist()), "<u4").astype(np.int64)
                at = np.concatenate(([0], np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False) // 4)))
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns), _decoded(bpe, flat, at)], [*names, "decoded_text"])

    return tokens.mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256")
    )
