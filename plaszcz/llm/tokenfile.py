"""Token ids in files of fixed-width packed bits.

A file holds the ids of consecutive documents. Ids take the fewest bits that the vocabulary
needs and are packed, most significant bit first, in blocks of BLOCK_IDS ids, each of which
begins at a byte. Between them stand blocks of the documents' ids and first tokens, of
BLOCK_DOCS documents each, so neither writer nor reader holds the documents of a whole file.
The file ends in a JSON footer with the offsets of all blocks, its length in bytes (four
bytes, little endian) and the magic word. Any token is found by its block's offset alone,
and a block is unpacked by array operations.

Documents are dealt over files by ranges of doc_id, so that the files in their order hold
all documents in ascending order. The number of files follows from the texts' bytes.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Bpe, default_tokenizer, encode_batch, gather
from .store import bound_batches, filesystem, new_path, stage, table
from .words import texts_of, tidy

MAGIC = b"PLTOKEN2"
BLOCK_IDS = 1 << 16
BLOCK_DOCS = 1 << 16
#: Words that go to the library as one text, and first bytes of characters that may be white space.
_JOINED_WORDS, _MAY_BE_WHITE = 2_000, frozenset((0xC2, 0xE1, 0xE2, 0xE3))
#: Bytes of text that a file is to hold at most, and that justify a file of their own where cores wait.
FILE_BYTES, LEAST_FILE_BYTES = 128 << 20, 1 << 20


def bits_for(n_ids: int) -> int:
    return max(1, (n_ids - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as `bits` bits each, most significant first, padded with zero bits to a byte."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> shifts & 1).astype(np.uint8)).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a packed block."""
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits).astype(np.uint32)
    return flat @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class Writer:
    """Writes one file; it appears under its name only when close() ends, so a lost attempt leaves nothing behind."""

    def __init__(self, path: str, n_ids: int, attempt: str = ""):
        self.fs, self.path = filesystem(path)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{attempt or os.getpid()}.part"
        self.out = self.fs.open_output_stream(self.own)
        self.bits, self.n_tokens, self.n_docs = bits_for(n_ids), 0, 0
        self.held: list[np.ndarray] = []
        self.held_ids = 0
        self.blocks: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held_docs = 0
        self.doc_blocks: list[tuple[int, int, int]] = []  # offset, documents, first token
        self.at = self.out.write(MAGIC)

    def add(self, doc_ids: list, ids: np.ndarray, at: np.ndarray) -> None:
        """Documents, all their ids, and where each one's ids begin (n + 1)."""
        known = np.array([d is not None for d in doc_ids], np.uint8)
        self.docs.append((np.array([0 if d is None else d for d in doc_ids], "<i8"), (self.n_tokens + at[:-1]).astype("<i8"), known))
        self.held_docs += len(doc_ids)
        self.n_docs += len(doc_ids)
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.held_ids += len(ids)
        if self.held_ids >= BLOCK_IDS:
            self._flush(BLOCK_IDS)
        if self.held_docs >= BLOCK_DOCS:
            self._flush_docs()

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held)
        while len(ids) >= max(least, 1):
            block, ids = ids[:BLOCK_IDS], ids[BLOCK_IDS:]
            self.blocks.append(self.at)
            self.at += self.out.write(pack(block, self.bits))
        self.held, self.held_ids = [ids.copy()], len(ids)

    def _flush_docs(self) -> None:
        doc_ids, starts, known = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        self.doc_blocks.append((self.at, len(doc_ids), int(starts[0])))
        self.at += self.out.write(doc_ids.tobytes() + starts.tobytes() + known.tobytes())
        self.docs, self.held_docs = [], 0

    def close(self) -> None:
        if self.held_ids:
            self._flush(1)
        if self.held_docs:
            self._flush_docs()
        footer = json.dumps({"bits": self.bits, "block_ids": BLOCK_IDS, "n_tokens": self.n_tokens, "n_docs": self.n_docs, "blocks": self.blocks, "documents": self.doc_blocks}).encode()
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        self.fs.move(self.own, self.path)


class Reader:
    """Reads a file; any range of tokens or of documents costs only its blocks."""

    def __init__(self, path: str):
        store, at = filesystem(path)
        self.file = store.open_input_file(at)
        size = self.file.size()
        (n,) = struct.unpack("<I", self._at(size - 12, 4))
        if self._at(size - 8, 8) != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError(f"{path} is no token file")
        meta = json.loads(self._at(size - 12 - n, n))
        self.bits, self.block_ids, self.blocks, self.n_tokens, self.n_docs = (meta[k] for k in ("bits", "block_ids", "blocks", "n_tokens", "n_docs"))
        self.doc_blocks = meta["documents"]
        self._first_doc = np.cumsum([0, *(b[1] for b in self.doc_blocks)])

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def documents(self, k: int) -> tuple[list, np.ndarray]:
        """The doc_ids of a block of documents, and where their tokens begin (n + 1)."""
        where, d, _ = self.doc_blocks[k]
        raw = self._at(where, 17 * d)
        known = np.frombuffer(raw, np.uint8, d, 16 * d)
        doc_ids = [i if k else None for i, k in zip(np.frombuffer(raw, "<i8", d).tolist(), known, strict=True)]
        end = self.doc_blocks[k + 1][2] if k + 1 < len(self.doc_blocks) else self.n_tokens
        return doc_ids, np.append(np.frombuffer(raw, "<i8", d, 8 * d), end)

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file."""
        if b <= a:
            return np.empty(0, np.uint32)
        first, last = a // self.block_ids, (b - 1) // self.block_ids
        out = []
        for k in range(first, last + 1):
            n = min(self.block_ids, self.n_tokens - k * self.block_ids)
            out.append(unpack(self._at(self.blocks[k], -(-n * self.bits // 8)), n, self.bits))
        return np.concatenate(out)[a - first * self.block_ids : b - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        k = int(np.searchsorted(self._first_doc, i, side="right")) - 1
        starts, at = self.documents(k)[1], i - int(self._first_doc[k])
        return self.tokens(int(starts[at]), int(starts[at + 1]))


class Library(Bpe):
    """The vocabulary of a file whose words the tokenizers library encodes.

    Bpe refuses files that cut texts in any other way than the library's byte-level rule,
    which never looks beyond a word, so a text's ids are those of its words, and each
    distinct word needs to be encoded once. Where ids end is checked against the bytes.
    """

    def __init__(self, path: str):
        super().__init__(path)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # special tokens are cut out before

    def encode_distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words after a space go to the library many at a time, as the text that they make; the others one by one."""
        names = words.to_pylist()
        size = np.fromiter(map(len, names), np.int64, len(names))
        joined = np.fromiter((len(w) > 1 and w[0] == 32 and w[1] > 32 and w[1] not in _MAY_BE_WHITE for w in names), bool, len(names))
        together, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        cuts = range(0, len(together), _JOINED_WORDS)
        texts = [b"".join([names[i] for i in together[a : a + _JOINED_WORDS].tolist()]).decode() for a in cuts] + [names[i].decode() for i in alone.tolist()]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(lists), np.int32)
        # ids spell their words' bytes, so the bytes tell where a word's ids end
        order = np.concatenate([together, alone])
        ends, wanted = np.cumsum(self._token_size[flat]), np.cumsum(size[order])
        last = np.searchsorted(ends, wanted)
        if len(flat) and not (ends[np.minimum(last, len(ends) - 1)] == wanted).all():
            raise ValueError("the library cut a text at other places")
        counts = np.empty(len(names), np.int64)
        counts[order] = np.diff(last + 1, prepend=0)
        start = np.empty(len(names), np.int64)
        start[order] = np.concatenate(([0], last[:-1] + 1)) if len(order) else start[order]
        return gather(flat, start, counts)[0], counts


def files_for(n_bytes: int, cores: int) -> int:
    """Files for texts of n_bytes: none above FILE_BYTES, and enough for all cores as long as these get LEAST_FILE_BYTES each."""
    return max(1, -(-n_bytes // FILE_BYTES), min(4 * cores, -(-n_bytes // LEAST_FILE_BYTES)))


def write_tokens(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Write all documents in ascending order of doc_id; return (file, docs, tokens, path) in file order.

    Nulls of doc_id come first; rows with one doc_id are ordered by a hash of their text.
    end_id is appended to each document, so a null or empty text has one id. An empty table
    gives no file. Files are ranges of doc_id; each is written by one task as it streams by.
    """
    path = tokenizer or default_tokenizer()
    bound_batches(docs.sparkSession)
    if not files:
        n_bytes = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0]
        files = files_for(n_bytes or 0, docs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col(doc_id).asc_nulls_first(), F.xxhash64(text)]
    dealt = docs.select(doc_id, text).repartitionByRange(files, *order).sortWithinPartitions(*order)

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, out, kept = TaskContext.get(), None, {}
        bpe = _library(path)
        name = f"{folder}/tokens-{context.partitionId():06d}.bin"
        for batch in batches:
            ids_list = batch.column(0).to_pylist()
            for a, b, ids, at in encode_batch(texts_of(batch.column(1)), bpe, kept):
                out = out or Writer(name, bpe.size, str(context.taskAttemptId()))
                ends = np.insert(ids, at[1:], end_id)
                out.add(ids_list[a:b], ends, at + np.arange(len(at)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([context.partitionId()], pa.int32()), "docs": [out.n_docs], "tokens": [out.n_tokens], "path": [name]})

    written, _ = stage(dealt.mapInArrow(write, "file int, docs bigint, tokens bigint, path string"), "token-files")
    return written.orderBy("file")


@lru_cache(maxsize=1)
def _library(path: str) -> Library:
    return Library(path)


def read_tokens(written: DataFrame) -> DataFrame:
    """written -> (doc_id, start, n_tokens, token_ids) of every document, read back from the files.

    start counts the ids of all documents before it, over all files in order.
    """
    rows = written.orderBy("file").collect()  # one row a file; their number is a parameter of the writer
    starts = np.cumsum([0, *(r.tokens for r in rows)])
    spark = written.sparkSession
    plan = spark.createDataFrame([(r.path, int(s)) for r, s in zip(rows, starts, strict=False)], "path string, base bigint")
    plan = plan.repartition(max(1, len(rows)), "path")

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                for k in range(len(file.doc_blocks)):
                    doc_ids, starts = file.documents(k)
                    a = 0
                    while a < len(doc_ids):
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 8 * BLOCK_IDS, side="right")) - 1)
                        ids = file.tokens(int(starts[a]), int(starts[b])).astype("<u4")
                        at = starts[a : b + 1] - starts[a]
                        raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], pa.int64()), pa.array(base + starts[a:b]), pa.array(np.diff(at)), raw], ["doc_id", "start", "n_tokens", "token_ids"])
                        a = b

    return plan.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, token_ids binary")


def op5_tokenfile(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the token files and the checksum of its ids."""
    docs = table(spark, sf_dir, "documents")
    written = write_tokens(docs, new_path(spark, "tokens"))
    return read_tokens(written).select("doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))
