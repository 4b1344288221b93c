"""Sharding, fingerprints, BPE and token files against brute force and the libraries."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plaszcz.llm import bpe, sharding, simhash, tokenfile, words, xxh

LONG = "słowo " * 20_000
TEXTS = [None, "", "   ", "a", "it's I'll we've 'sabc's's !'s  'x \n\n a  b\t c 12'3 ", "<|endoftext|>a<|endoftext|><|endoftext|>", "'", "'re", "  ", "émoji😀👍🏽 aaaaaaaaaaaaa", "don't DON'T 'S 'LL'll", "日本語 テスト ²³ ½", "\n \n", LONG, "a", "x y z"]
SCHEMA = "doc_id bigint, text string, n_tokens string, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i else None, t, "clash", "clash") for i, t in enumerate(TEXTS)] + [(3, "a", "clash", "clash")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_definition_and_moves_only_into_the_new_shard():
    keys = np.concatenate([np.arange(-50, 2000), np.array([2**63 - 1, -(2**63)])])
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k) % 2**64, n) for k in keys]
    a, b = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    assert set(b[a != b]) <= {24}
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_slots_are_gapless_and_equal_keys_share_a_shard(spark, docs):
    out = sharding.assign_shards(docs.withColumnRenamed("n_tokens", "slot"), "doc_id", 3, rows_per_bucket=1).collect()
    assert len(out) == len(TEXTS) + 1
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    by_key = {}
    for r in out:
        by_key.setdefault(r.doc_id, set()).add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_key.values())
    assert sharding.assign_shards(empty(spark), "doc_id", 3).count() == 0


def test_xxh64_of_ranges():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    start = rng.integers(0, 4000, 400)
    size = rng.integers(0, 900, 400)
    for seed in (0, 42):
        assert xxh.xxh64_ranges(data, start, size, seed).tolist() == [xxhash.xxh64_intdigest(data[a : a + n], seed) for a, n in zip(start, size)]


def brute_fingerprint(text: str, n: int = 4) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))] if found else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def test_fingerprints():
    texts = [t or "" for t in TEXTS] + ["A b\x0bC\x0cd\x1ce f g ÀB", "one two three four five " * 7]
    assert simhash.fingerprints(pa.array(texts), 4, 42).tolist() == [brute_fingerprint(t) for t in texts]


def brute_components(fps: list[int], ids: list, reach: int = 4) -> list:
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_components_of_near_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = []
    for b in base.tolist():
        for _ in range(int(rng.integers(1, 30))):
            for bit in rng.integers(0, 64, int(rng.integers(0, 4))).tolist():
                b ^= 1 << bit
            fps.append(b)
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in distinct], "_fp bigint")
    for slab_rows in (4096, 8):  # whole buckets, and buckets cut by pivot distance
        links = simhash.near_links(df, slab_rows=slab_rows)
        roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
        got = [roots.get(r._fp, r._fp) for r in df.collect()]
        want = brute_components(distinct, list(range(len(distinct))))
        assert len({(a, b) for a, b in zip(got, want)}) == len(set(got)) == len(set(want))


def test_near_classes_of_odd_documents(spark, docs):
    out = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_classes(docs).collect()}
    fps = {(i if i else None): brute_fingerprint(t) for i, t in enumerate(TEXTS)}
    want = brute_components(list(fps.values()), list(fps))
    assert [out[d, f"{f:016x}"] for d, f in fps.items()] == want
    assert simhash.near_classes(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe_equals_the_library(spark, docs, library):
    for r in bpe.encode(docs, decoded=True).collect():
        want = library.encode(TEXTS[r.doc_id or 0] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == want
        assert r.n_tokens == len(want)
        assert r.decoded_text == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty(spark)).count() == 0


def test_decode_round_trip_and_broken_ids(spark):
    df = spark.createDataFrame([(1, np.array([127, 220], "<u4").tobytes()), (2, None), (3, b"")], "i int, token_ids binary")
    out = {r.i: r.decoded_text for r in bpe.decode(df).collect()}
    assert "�" in out[1] and out[2] == "" and out[3] == ""


@pytest.mark.parametrize("kept_words", [bpe.KEPT_WORDS, 20])
def test_random_text_against_the_library(library, monkeypatch, kept_words):
    monkeypatch.setattr(bpe, "KEPT_WORDS", kept_words)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 500)
    rng = np.random.default_rng(1)
    alphabet = list("abcdefgh  \n\t'’ABC012.,!-éß中😀  ") + ["'s", "'re", " the", "ing", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 60)))) for _ in range(400)]
    model = bpe.load(bpe.default_tokenizer())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for one in (model, tokenfile.Library(bpe.default_tokenizer())):
        got, kept = [], {}
        for k in range(0, 400, 40):
            for _, _, ids, at in bpe.encode_batch(pa.array(texts[k : k + 40]), one, kept):
                got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert got == want


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 31])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003)
    data = tokenfile.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (tokenfile.unpack(data, 1003, bits) == ids).all()


def test_files_follow_the_bytes():
    assert [tokenfile.files_for(n, 8) for n in (0, 10, 3 << 20, 1 << 30, 100 << 40)] == [1, 1, 3, 32, 100 << 13]


def test_unsupported_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError, match="pre_tokenizer"):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("block_docs", [1 << 16, 2])
def test_random_access_in_a_token_file(tmp_path, monkeypatch, block_docs):
    monkeypatch.setattr(tokenfile, "BLOCK_DOCS", block_docs)
    rng = np.random.default_rng(3)
    lengths = [0, 1, 70_000, 5, 200_000, 0]
    ids = rng.integers(0, 50_257, sum(lengths)).astype(np.int32)
    at = np.concatenate(([0], np.cumsum(lengths)))
    w = tokenfile.Writer(str(tmp_path / "t.bin"), 50_257)
    w.add([10, None], ids[: at[2]], at[:3])
    w.add([12, 13, 14, 15], ids[at[2] :], at[2:] - at[2])
    assert not (tmp_path / "t.bin").exists()
    w.close()
    r = tokenfile.Reader(str(tmp_path / "t.bin"))
    assert [d for k in range(len(r.doc_blocks)) for d in r.documents(k)[0]] == [10, None, 12, 13, 14, 15] and r.bits == 16 and r.n_docs == 6
    for i in range(6):
        assert (r.document(i) == ids[at[i] : at[i + 1]]).all()
    assert (r.tokens(65_530, 131_080) == ids[65_530:131_080]).all()
    with pytest.raises(ValueError):
        (tmp_path / "x.bin").write_bytes(b"0" * 100)
        tokenfile.Reader(str(tmp_path / "x.bin"))


def test_token_files_in_order(spark, docs, library, tmp_path):
    written = tokenfile.write_tokens(docs, str(tmp_path / "tokens"), files=4)
    out = sorted(tokenfile.read_tokens(written).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 2, 3, 3, *range(4, len(TEXTS))]
    start = 0
    for r in out:
        ids = library.encode(TEXTS[r.doc_id or 0] or "", add_special_tokens=False).ids + [0]
        assert r.start == start and r.n_tokens == len(ids)
        assert zlib.crc32(bytes(r.token_ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokenfile.read_tokens(tokenfile.write_tokens(empty(spark), str(tmp_path / "none"))).count() == 0


def test_words_split_at_ascii_white_space_only():
    flat, first = words.split_words(pa.array(["  a\x0bb\x0c ", "", "x\x1cy z", " "]))
    assert flat.to_pylist() == ["a", "b", "x\x1cy", "z"] and first.tolist() == [0, 2, 2, 4, 4]
