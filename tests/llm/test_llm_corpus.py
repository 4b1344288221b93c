"""Repeated passages, retrieval, search, language, pages and toxicity against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import html as html_lib
import math
import os
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaszcz.llm import components, decontam, langid, nearcopies, queries, simhash, suffix, topk, toxicity, wrappers

DATA = Path(os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001"))

SCHEMA = "doc_id bigint, text string, kept string, leaks string, lang_pred string, toxic string, main_text string"
RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnopéß"), int(RNG.integers(2, 9)))) for _ in range(900)]


def prose(n: int, rng=RNG) -> str:
    return " ".join(rng.choice(WORDS, n))


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, "c", "c", "c", "c", "c") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def brute_removed(texts: list, t: int) -> list[bytearray]:
    raw = [(x or "").encode() for x in texts]
    seen = Counter(b[p : p + t] for b in raw for p in range(len(b) - t + 1))
    marks = [bytearray(len(b)) for b in raw]
    for b, m in zip(raw, marks):
        for p in range(len(b) - t + 1):
            if seen[b[p : p + t]] > 1:
                m[p : p + t] = b"\1" * t
    return marks


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_repeated_passages(spark, group_rows, monkeypatch):
    monkeypatch.setattr(suffix, "_ROW_ASKS", min(group_rows, 4_096))
    a, b, c = prose(60), prose(45), prose(12)
    texts = [None, "", prose(200), a, a, prose(30) + a + prose(30), prose(20) + b + prose(9) + b, "ab" * 400, "x" * 700, prose(5), a[:199], a[:200], c + prose(40), prose(33) + c]
    texts += [prose(20) + b[k : k + 205] + prose(20) for k in range(0, 60, 7)] + [prose(15) + a[3:260] + prose(15) for _ in range(6)]
    docs = frame(spark, texts)
    docs = docs.unionByName(docs.filter("doc_id = 9"))
    out = suffix.remove_repeats(docs, group_rows=group_rows).collect()
    assert len(out) == len(texts) + 1
    marks = brute_removed([*texts, texts[9]], 200)
    for r in out:
        raw, mark = (texts[r.doc_id or 0] or "").encode(), marks[r.doc_id or 0]
        assert bytes(r.kept) == bytes(x for x, m in zip(raw, mark) if not m), r.doc_id
        runs = [(s.start, s.end) for s in r.removed]
        assert sum(e - s for s, e in runs) == sum(mark)
        assert all(x[1] < y[0] for x, y in zip(runs, runs[1:]))
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_other_threshold(spark):
    texts = ["abcdefghij" * 3, "zzabcdefghijabzz", "abcde", prose(30)]
    out = {r.doc_id: bytes(r.kept) for r in suffix.remove_repeats(frame(spark, texts), threshold=10).collect()}
    for (i, t), mark in zip(enumerate(texts), brute_removed(texts, 10)):
        assert out[i or None] == bytes(x for x, m in zip(t.encode(), mark) if not m)


def test_anchors_of_a_text_in_parts(monkeypatch):
    texts = pa.array([prose(900).encode(), (prose(30) * 40).encode(), b"short"], pa.large_binary())
    whole = {tuple(int(x) for x in r) for r in zip(*suffix.text_anchors(texts, 200, 100))}
    monkeypatch.setattr(suffix, "_PIECE", 700)
    parts = {tuple(int(x) for x in r) for r in zip(*suffix.text_anchors(texts, 200, 100))}
    assert whole == parts and whole


def test_connected_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (10, 11), (11, 10), (5, 4)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 501 + i) for i in range(30)]
    df = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)} | {500 + i: 500 for i in range(31)}
    assert components.connected_components(df.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(2)
    base = [prose(150, rng) for _ in range(12)]
    texts, family = [], []
    for i, b in enumerate(base):
        for _ in range(5):
            w = b.split()
            w[int(rng.integers(0, len(w)))] = "changed"
            texts.append(" ".join(w))
            family.append(i)
    texts += ["", None, "   ", "one", "one"]
    kept = nearcopies.drop_near_copies(frame(spark, texts)).collect()
    left = [r.doc_id or 0 for r in kept]
    assert Counter(family[i] for i in left if i < len(family)) == {i: 1 for i in range(12)}
    assert sum(not (r.text or "").strip() for r in kept) <= 3 and sum(r.text == "one" for r in kept) == 1
    assert kept[0].asDict().keys() == {"doc_id", "text", "kept", "leaks", "lang_pred", "toxic", "main_text"}
    assert nearcopies.drop_near_copies(frame(spark, texts).limit(0)).count() == 0


def test_least_hashes_of_repeated_lines():
    rng = np.random.default_rng(3)
    texts = ["\n".join([prose(12, rng)] * 60 + [prose(40, rng)]) for _ in range(40)]
    hashes, base = simhash.shingle_hashes(pa.array(texts), nearcopies.WORDS, 42)
    keys = nearcopies._least(hashes, base, nearcopies.SKETCH).to_pylist()
    for k, a, b in zip(keys, base[:-1], base[1:]):
        assert [x % 2**64 for x in k] == sorted(set(hashes[a:b].tolist()))[: nearcopies.SKETCH]


@pytest.mark.parametrize("slab_rows", [4096, 20])
def test_near_copies_by_jaccard_of_shingles(spark, slab_rows):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(40):  # pairs from about 0.45 to 0.95, some of repeated lines
        w = prose(120, rng).split()
        v = list(w)
        for at in range(2, 2 + 12 * (1 + k % 5) // 2, 6):
            v[at] = "other"
        lines = " ".join(w[:30])
        texts += [" ".join(w), " ".join(v)] if k % 4 else [" ".join(w), " ".join(w) + (" " + lines) * 40]
    texts += [prose(60, rng) + " " + " ".join(WORDS[:60]) for _ in range(60)]  # a common passage, a large bucket
    texts += [" ".join([*WORDS[100 + i : 104 + i]]) for i in range(3)] + ["", "  "]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))
    for i, j in sorted(similar):
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    marked = docs.select("doc_id", F.xxhash64("text").alias("_node"), "text")
    ids = {r._node: r.doc_id for r in marked.collect()}
    links = nearcopies._links(nearcopies.sketches(marked, "_node", "text"), marked, "text", slab_rows)
    got = {tuple(sorted((ids[r.u], ids[r.v]), reverse=True)) for r in links.collect()}
    assert got == similar
    assert {r.doc_id for r in nearcopies.drop_near_copies(docs).collect()} == set(root)


def bm25_brute(index_texts: list[str], passage: list[str]) -> list[float]:
    docs = [decontam.tokens(t) for t in index_texts]
    mean = sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    out = []
    for d in docs:
        tf = Counter(d)
        w = {t: math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, f in tf.items()}
        out.append(sum(x for t, x in w.items() if t in set(passage)) / sum(w.values()))
    return out


def test_retrieval_is_complete(monkeypatch):
    rng = np.random.default_rng(4)
    items = [prose(int(rng.integers(5, 40)), rng) for _ in range(70)]
    index = decontam.build_index(list(range(70)), items)
    passages = [items[i].split()[: int(rng.integers(3, 40))] + prose(60, rng).split() for i in range(70)]
    vocabulary = {t: i for i, t in enumerate(index.terms.to_pylist())}
    pairs = sorted({(p, vocabulary[w]) for p, ws in enumerate(passages) for w in ws if w in vocabulary})
    once = decontam.retrieve(index, np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]), 70, 0.4)
    monkeypatch.setattr(decontam, "CELLS", 12)
    p, i, s = decontam.retrieve(index, np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]), 70, 0.4)
    assert all((x == y).all() for x, y in zip(once, (p, i, s)))
    got = {(int(a), int(b)): float(c) for a, b, c in zip(p, i, s)}
    want = {(k, j): x for k, ws in enumerate(passages) for j, x in enumerate(bm25_brute(items, ws)) if x >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_leaks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    items = [prose(20, rng).capitalize() + ". " + prose(10, rng).capitalize() + "." for _ in range(8)] + ["", "  ", None]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, items[0])], "item_id bigint, text string")
    texts = [None, "", prose(300, rng), prose(900, rng) + " " + items[3] + " " + prose(500, rng), items[5].split(". ")[0], "!!" + items[6].replace("a", "A").replace(" ", "  ") + "##", items[0]]
    for per_index in (20_000, 3):
        monkeypatch.setattr(decontam, "ITEMS_PER_INDEX", per_index)
        out = {r.doc_id: r.leaks for r in decontam.find_leaks(frame(spark, texts), benchmark).collect()}
        assert {d for d, found in out.items() if found} == {3, 5, 6}
        assert [x.item_id for x in out[3]] == [3] and {x.item_id for x in out[6]} == {0, None}
    assert decontam.find_leaks(frame(spark, texts).limit(0), benchmark).count() == 0
    assert all(not r.leaks for r in decontam.find_leaks(frame(spark, texts), benchmark.limit(0)).collect())


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    rng = np.random.default_rng(61)
    items = [prose(int(rng.integers(8, 40)), rng) + ". " + prose(6, rng) + "." for _ in range(30)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    texts = [None] + [prose(50, rng) + " " + " ".join(x.split()[: len(x.split()) - k % 4]) + " " + prose(9, rng) for k, x in enumerate(items)]
    found = []
    for per_index in (20_000, 4):
        monkeypatch.setattr(decontam, "ITEMS_PER_INDEX", per_index)
        found.append({(r.doc_id, x.item_id, x.score) for r in decontam.find_leaks(frame(spark, texts), benchmark).collect() for x in r.leaks})
    assert found[0] and found[0] == found[1]


def test_leaks_among_free_standing_punctuation(spark):
    rng = np.random.default_rng(71)
    item = prose(190, rng) + ". " + prose(12, rng).capitalize() + "."
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    texts = [None, "! ? " + prose(100, rng) + " " + item.replace(" ", " - \u2013 ** ") + " " + prose(40, rng), item.replace(" ", "\u2003"), "- - -"]
    out = {r.doc_id: r.leaks for r in decontam.find_leaks(frame(spark, texts), benchmark).collect()}
    assert {d: [x.item_id for x in found] for d, found in out.items()} == {None: [], 1: [1], 2: [1], 3: []}
    assert out[1][0].answer_overlap == 1 and out[1][0].first_word == 2


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = [rng.normal(0, 0.3, 16).round(2).tolist() for _ in range(300)] + [[0.5] * 16] * 80
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000, None), (1001, [0.1] * 15 + [None]), (1002, [float("nan")] * 16), (1003, [float("inf")] * 16), (None, [0.1] * 16), (1004, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    q = topk.quantise(df, "vec_id", "embedding")
    for k, block in ((20, 4096), (7, 64)):
        got = {}
        for r in topk.top_k(q.filter("vec_id % 20 = 0"), q, k, block_rows=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        m = np.floor(64 * np.array(vectors)).astype(int)
        for i in range(0, len(vectors), 20):
            s = m @ m[i]
            want = sorted(((-int(s[j]), j) for j in range(len(vectors)) if j != i))[:k]
            assert [got[i][n + 1] for n in range(k)] == [(j, -x) for x, j in want]
    with pytest.raises(ValueError, match="differ in length"):
        topk.top_k(q, topk.quantise(spark.createDataFrame([(1, [0.5] * 3), (2, [0.5] * 5)], "vec_id bigint, embedding array<double>"), "vec_id", "embedding")).collect()
    assert topk.top_k(q.filter("vec_id = 0"), q.limit(0)).count() == 0
    few = topk.top_k(q.filter("vec_id = 0"), q.filter("vec_id < 5"), 20).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in langid.init(3, hidden=4).items()}
    x, y = rng.integers(97, 101, (5, 6)), np.array([0, 1, 2, 1, 0])

    def loss(n):
        p = langid.position_probabilities(n, x)
        return -np.log(p[:, np.arange(5), y]).mean()

    grad = langid.gradients(net, x, y)
    for name, g in grad.items():
        for at in [tuple(rng.integers(0, s) for s in g.shape) if name[0] != "x" else (98, int(rng.integers(0, g.shape[1]))) for _ in range(3)]:
            up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - g[at]) < 2e-4


def language_rows():
    rng = np.random.default_rng(8)
    stems = {"aa": ["tha", "ing", "ough", "wh"], "bb": ["sch", "keit", "ung", "zü"], "cc": ["eau", "oux", "ié", "que"]}
    make = lambda s: " ".join("".join(rng.choice(s, int(rng.integers(1, 4)))) for _ in range(60))
    return [(i, make(stems[lang]), lang) for i in range(150) for lang in [["aa", "bb", "cc"][i % 3]]]


def test_languages_of_held_out_rows(spark):
    rows = language_rows() + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 ?!", "bb"), (1003, "schkeitung " * 9000, None), (1004, "x" * 5000, None), (None, "thaing ough", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    languages, net = langid.fit(docs)
    assert languages == ["aa", "bb", "cc"]
    out = {r.doc_id: r for r in langid.predict(docs, languages, net).withColumn("held", langid.fold() == 0).collect()}
    held = [(out[i].lang_pred, lang) for i, _, lang in rows[:150] if out[i].held]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "bb"
    assert all(0 <= r.lang_score <= 1 for r in out.values())
    none = docs.limit(0)
    languages, net = langid.fit(none)
    assert languages == [] and {r.lang_pred for r in langid.predict(docs, languages, net).collect()} == {"und"}
    assert langid.predict(none, languages, net).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    rng = np.random.default_rng(31)
    han, kana = [chr(x) for x in range(0x4E00, 0x4E40)], [chr(x) for x in range(0x3041, 0x3081)]
    unbroken = [(i, "".join(rng.choice(signs, 90)), lang) for i, (signs, lang) in enumerate([(han, "zh"), (kana, "ja")] * 60)]
    rows = unbroken + [(1000 + 8 * k + i, f"word{k} lang{k} more{k}", f"l{k:02}") for k in range(70) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    monkeypatch.setattr(langid, "TRAIN_DOCS", 150)
    languages, _ = langid.fit(docs)
    assert languages == sorted({lang for *_, lang in rows})
    docs = spark.createDataFrame(unbroken, "doc_id bigint, text string, lang string").repartition(3)
    languages, net = langid.fit(docs)
    out = langid.predict(docs, languages, net).filter(langid.fold() == 0).collect()
    assert languages == ["ja", "zh"] and out and all(r.lang_pred == r.lang for r in out)
    data, start, size, owner = langid._pieces(pa.array(["a" + "ż" * 40, "", "b"]))
    assert [(bytes(data[a : a + n]).decode(), w) for a, n, w in sorted(zip(start.tolist(), size.tolist(), owner.tolist()))] == [("a" + "ż" * 15, 0), ("ż" * 16, 0), ("ż" * 9, 0), ("b", 2)]


def brute_segments(s: list[float]) -> list[tuple[int, int]]:
    """Ruzzo and Tompa by definition: the best segment, the least of equals from the left, then either side of it."""

    def go(a: int, b: int) -> list[tuple[int, int]]:
        best = max(((sum(s[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        i, j = best[3], best[4]
        return go(a, i) + [(i, j)] + go(j, b)

    return go(0, len(s))


def test_maximal_segments():
    rng = np.random.default_rng(12)
    assert [(a, b) for a, b, _ in toxicity.maximal_segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5])] == [(0, 1), (2, 3), (4, 11)]
    for _ in range(60):
        s = rng.normal(-0.2, 1, int(rng.integers(0, 14))).tolist()
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute_segments(s)


def toxic_rows():
    rng = np.random.default_rng(13)
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(400):
        w = prose(80, rng).split()
        t = int(i % 5 == 0)
        for _ in range(4 * t):
            w[int(rng.integers(0, 80))] = str(rng.choice(bad)) + str(rng.choice(["", "!", "er"]))
        rows.append((i, " ".join(w)))
        labels.append((i, t))
    return rows, labels


def test_toxicity_of_held_out_rows(spark):
    rows, labels = toxic_rows()
    more = [(None, "vile nasty"), (900, None), (901, ""), (902, prose(20_000) + " vile rotten nasty" * 4 + " " + prose(9)), (0, rows[0][1])]
    docs = spark.createDataFrame(rows + more, "doc_id bigint, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (0, 1), (None, 1), (7, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"vile", "nasty", "rott*"} & set(model.tokens)
    out = toxicity.score_documents(docs, model).withColumn("held", toxicity.fold() == 0).collect()
    assert len(out) == len(rows) + len(more)
    by = {r.doc_id: r for r in out}
    held = [(by[i].toxic, bool(t)) for i, t in labels if by[i].held]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r.toxic_score <= 1 and r.toxic == (r.toxic_score >= 0.5) for r in out)
    assert not by[900].toxic and not by[901].toxic
    assert any(20_000 <= s.start < 20_003 for s in by[902].toxic_spans)
    nothing = toxicity.fit(docs, marks.limit(0))
    assert not any(r.toxic for r in toxicity.score_documents(docs, nothing).collect())
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_evidence_follows_the_number_of_toxic_texts():
    words = {d: 4000 // d**2 for d in range(1, 40)}
    small, large = (toxicity.least_evidence({d: n * k for d, n in words.items()}, 10 * k, 60 * k) for k in (1, 100))
    assert 4 * math.log(7) > small > 3 * math.log(7) and large > small + math.log(100)
    assert toxicity.least_evidence({1: 1000}, 5, 50) == math.inf


def test_toxic_texts_that_share_a_passage_count_each(spark):
    rng = np.random.default_rng(21)
    shared = prose(60, rng)
    bad = [shared + " vile " + prose(9, rng) for _ in range(14)]
    rows = [*bad, *(shared + " " + prose(10, rng) for _ in range(20)), *(prose(70, rng) for _ in range(120))]
    rows += [bad[0]] * 30 + [rows[20]] * 30 + [bad[1]]  # copies, which count once in a label
    labels = [(i, int(i < 14 or t == bad[0])) for i, t in enumerate(rows)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    kept, path = [], toxicity.stage
    try:
        toxicity.stage = lambda df, label: kept.append(path(df, label)) or kept.append(kept[-1][0].collect()) or kept[-2]  # the table itself goes after the fit
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    finally:
        toxicity.stage = path
    assert "vile" in model.tokens
    known = {(t, y) for (i, t), (_, y) in zip(enumerate(rows), labels, strict=True) if zlib.crc32(str(i).encode()) % 5}
    assert Counter((r._text, r._toxic) for r in kept[1]) == Counter(known)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies</div>
<nav><ul>{menu}</ul></nav><div class="ad">Buy {n}</div><article><h1>Head {n}</h1>{body}<div class="share-box">Share</div></article><aside><p>Side</p></aside>
<section id="comments"><p>First! {n}</p></section><form><p>Mail</p><input name=x></form><footer>&copy; {n}</footer></body></html>"""


def page(n: int, blocks: list[str]) -> str:
    return PAGE.format(n=n, menu="".join(f"<li><a href=/{i}>m{i}</a></li>" for i in range(n % 4)), body="".join(blocks))


def test_main_text(spark):
    rows = [(i, f"https://a.example/{i}", page(i, [f"<p>one &amp;   two\n{i}<p>x <b>y</b>z &lt;3"] + ["<p>more</p>"] * (i % 3))) for i in range(12)]
    rows += [(100, "http://b.example/x", None), (101, None, ""), (102, "http://c.example", "<p>alone</p>" * 3000), (103, "http://c.example", "no tags at all & more"), (104, "http://d.example", "<div>" * 5000 + "deep"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, main_text string").repartition(3)
    out = wrappers.extract_main_text(pages).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r.main_text for r in out}
    for i in range(12):
        assert by[i] == "\n".join([f"Head {i}", f"one & two {i}", "x yz <3"] + ["more"] * (i % 3))
    assert by[100] == "" and by[101] == "" and by[102] == "\n".join(["alone"] * 3000) and by[103] == "no tags at all & more" and by[104] == "deep"
    assert wrappers.extract_main_text(pages.limit(0)).count() == 0


def test_wrapper_of_two_pages():
    a = "<div><h1>A</h1><ul><li>1</li><li>2</li><li>3</li></ul><p>same</p></div>"
    b = "<div><h1>B</h1><img src=x><table><tr><td>t</td></tr></table><ul><li>4</li></ul><p>same</p></div>"
    w = wrappers.infer([a, b])
    assert wrappers.expression(w) == '<html> <div> <h1> #text </> ( <table> <tr> <td> "t" </> </> </> )? <ul> ( <li> #text </> )+ </> <p> "same" </> </> </>'


def test_long_lists_are_aligned_whole():
    rng = np.random.default_rng(51)
    name = lambda k: wrappers.Part(f"div.c{k}", weight=1)
    a, b = rng.integers(0, 40, 620).tolist(), rng.integers(0, 40, 560).tolist()
    best = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(best[j] + 1 if x == y else max(best[j + 1], now[j]))
        best = now
    out = wrappers.align([name(k) for k in a], [name(k) for k in b])
    assert sum(p.weight == 2 for p in out) == best[-1] and sum(p.weight for p in out) == len(a) + len(b)
    out = wrappers.pairs([p.key() for p in map(name, a)], [p.key() for p in map(name, b)])
    assert len(out) == best[-1] and all(a[i] == b[j] for i, j in out) and out == sorted(set(out)) and len({j for _, j in out}) == len(out)
    page = lambda n: "".join(f"<div class=x{n * k}><i>{k}</i></div>" for k in range(600)) + f"<article><p>main {n}</p></article>"
    assert any(p.label == "article" for p in wrappers.infer([page(1), page(-1)]).children)


def templates_of(pages):
    host = wrappers.Host()
    for p in pages:
        host.add(wrappers.parse(p))
    return host.templates()


def test_main_region_without_an_article():
    pages = [f"<div class=wrap><div class=menu><p>Home</p></div><div class=body><p>{prose(30)}</p><p>Read more</p><p>{prose(20)}</p><p>{prose(9)}</p></div></div>" for _ in range(5)]
    wrapper = wrappers.infer(pages)
    (at,) = wrappers.main_region(wrapper, True)
    labels = []
    for k in at:
        wrapper = wrapper.children[k]
        labels.append(wrapper.label)
    assert labels[:2] == ["div.wrap", "div.body"]
    assert "Home" not in wrappers.extract(pages[0], templates_of(pages))[0]


def test_only_the_alignment_of_pages_can_find_the_text():
    rng = np.random.default_rng(81)
    fixed = [prose(60, rng) for _ in range(4)]  # more text than any page's own
    rows = []
    for n in range(9):
        menu = "".join(f"<li>{w}</li>" for w in prose(4, rng).split())
        own = [prose(6, rng), *(prose(12, rng) for _ in range(1 + n % 3))]
        body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{t}</p>" for t in own[1:]) + f"<h4>{fixed[3][:40]}</h4>"
        extra = f"<div><table><tr><td>{prose(3, rng)}</td></tr></table></div>" if n % 2 else ""
        rows.append((f"<div class=q1><ul>{menu}</ul>{fixed[0]}</div><div class=q7><p>{fixed[1]}</p></div>{extra}<div class=z3>{body}</div><div class=k9><p>{fixed[2]}</p></div>", own))
    templates = templates_of([h for h, _ in rows])
    assert len(templates) == 2
    for html, own in rows:
        assert wrappers.extract(html, templates) == ("\n".join(own), True)
        assert wrappers.extract(html, None)[0] != "\n".join(own)  # one page alone does not show it


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article>one<hr>two</article>", "one\ntwo"), ('<div class="content-sidebar-wrap"><article><p>a</p></article></div><p>outside</p>', "a"), ('<article class="post category-search"><p>body</p></article><p>x</p>', "body"),
        ('<article><p>see <span class="ad-hoc">this</span> now</p></article>', "see this now"), ("<article><p><a title=don't href=/x>link</a> lost text</p><p>it's more</p></article>", "link lost text\nit's more"),
        ("<div><article>" + "<div>" * 130 + "deep<nav>menu</nav>" + "</div>" * 130 + "<p>after</p></article></div>", "deep\nafter"), ("<article><header><h1>Head</h1></header><p>t</p></article>", "Head\nt"),
        ('<article class="comment"><p>c</p></article><article class="post"><p>body</p></article>', "body"), ("<p a='x>y' b=\"1>2\">hi</p>", "hi"), ('<div class="sidebarLeft"><p>' + "s " * 90 + "</p></div><div><p>text</p></div>", "text"), ("<p>a<br>b<wbr>c</p>", "a bc"),
    ],
)
def test_markup(html, text):
    assert wrappers.extract(html, None)[0] == text


def test_repeated_groups_of_any_length():
    unit = "".join(f"<div class=c{k}>x</div>" for k in range(7))
    w = wrappers.infer([unit * 3, unit * 2])
    assert [(c.label, c.repeated, len(c.children)) for c in w.children] == [("()", True, 7)]


def test_wide_lists_are_generalised(monkeypatch):
    monkeypatch.setattr(wrappers, "WIDEST", 200)
    around = "".join(f"<div class=x{k}><i>{k}</i></div>" for k in range(300))
    pages = [f"{around}<article><p>main {n}</p></article>{around}" for n in range(3)]
    assert [c.label for c in wrappers.infer(pages).children] == ["*", "article", "*"]
    assert [wrappers.extract(p, templates_of(pages)) for p in pages] == [(f"main {n}", True) for n in range(3)]
    rng = np.random.default_rng(7)
    page = lambda: "<article>" + "".join(f"<{rng.choice(['p', 'h3', 'ul', 'dl', 'pre', 'h5'])}>{prose(3, rng)}</>" for _ in range(700)) + "</article>"
    pages = [page() for _ in range(4)]
    templates = templates_of(pages)
    for p in pages:
        assert wrappers.extract(p, templates)[0] == wrappers.extract(p, None)[0] and wrappers.extract(p, templates)[0].count("\n") > 500


def article_text(html: str) -> str:
    """A second way for the test tables' pages, whose text is their only article's, in blocks and without markup."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    plain = (re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b))).strip() for b in blocks)
    return "\n".join(b for b in plain if b)


@pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
def test_pages_of_the_test_tables(spark):
    got = {r.page_id: r for r in queries.op8_wrappers(spark, str(DATA)).collect()}
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article_text(r.html) and got[r.page_id].n_chars == len(article_text(r.html)) and got[r.page_id].url == r.url


def test_wrappers_see_all_pages_of_a_host(spark):
    rng = np.random.default_rng(41)
    body = "<div class=wrap><div class=body><p>{}</p><h2>{}</h2><p>{}</p></div></div>".format
    copy = body(prose(30, rng), "said once", prose(20, rng))
    texts = [prose(30, rng) for _ in range(40)]
    rows = [(i, "http://h.example/c", copy) for i in range(60)] + [(100 + i, "http://h.example/p", body(t, "boilerplate", t[::-1])) for i, t in enumerate(texts)]
    rows += [(200 + i, "http://k.example/", body(t, "boilerplate", "and " + t)) for i, t in enumerate(texts)]
    other = "<div class=wrap><div class=body><div class=inner><p>short</p></div></div><section><p>{}</p><h2>{}</h2></section></div>"
    rows += [(300 + i, "http://k.example/o", other.format(t, "boilerplate")) for i, t in enumerate(texts[:2])]
    out = {r.page_id: r.main_text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    assert all("said once" in out[i] for i in range(60))
    assert all(out[100 + i].split("\n") == [t, "boilerplate", t[::-1]] for i, t in enumerate(texts))  # not on all pages
    assert all(out[200 + i].split("\n") == [t, "and " + t] for i, t in enumerate(texts))
    assert all(texts[i] in out[300 + i] for i in range(2))


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    rows, labels = toxic_rows()
    item = prose(25, rng).capitalize() + ". " + prose(8, rng).capitalize() + "."
    shared = prose(70, rng)
    clean = [prose(90, rng) for _ in range(6)]
    extra = [clean[0], clean[0], clean[0] + " end", f"{clean[1]} {shared} {clean[2]}", f"{clean[3]} {shared} {clean[4]}", f"{clean[5]} {item} {prose(40, rng)}", None]
    docs = [(i, t, "en", "s", len(t)) for i, t in rows] + [(1000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(extra)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert len(corpus_pipeline.STAGES) == 5
    good = [i for i, t in labels if not t]
    assert sum(i in out for i in good) >= 0.97 * len(good) and sum(i in out for i, t in labels if t) <= 4
    assert sorted(i for i in out if i >= 1000) == [1000, 1003, 1004, 1006]
    assert shared not in out[1003].text and out[1003].text.startswith(clean[1][:300])
    assert all(np.frombuffer(bytes(r.token_ids), "<u4").size == r.n_tokens for r in out.values())
    assert hashlib.sha256(out[1000].text.encode()).digest() == hashlib.sha256(clean[0].encode()).digest()


def tables_of(spark, folder, docs, labels, items):
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint, token_ids string, _node string, shard string"
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash", "clash", "clash") for d, t in docs], extra).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_pipeline_over_odd_tables(spark, tmp_path):
    import corpus_pipeline

    tables_of(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rng = np.random.default_rng(91)
    long = prose(60_000, rng)
    docs = [(1, None), (1, ""), (None, prose(50, rng)), (2, prose(60, rng)), (2, prose(60, rng)), (3, long), (4, prose(40, rng) + " " + long[:300] + " " + prose(40, rng))]
    docs += [docs[3]] * 3
    tables_of(spark, tmp_path / "odd", docs, [(None, 1, 1), (2, None, None), (9, 1, 1)], [(None, None), (1, ""), (2, "   ")])
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 2, 2, 3, 4]  # one blank text, one of the equal rows
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == 0 and by[1].text == "" and by[3].text == long[300:] and long[:300] not in by[4].text
    assert set(out[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "text"}


@pytest.mark.parametrize("operator", ["sharding", "suffix", "nearcopies", "simhash", "toxicity", "decontam", "wrappers"])
def test_columns_of_the_operators_own_names(spark, operator):
    from plaszcz.llm import sharding

    rows = [(i, prose(40), *["mine"] * 12) for i in range(6)]
    names = ("_d", "_r", "_key", "_row", "_bucket", "_text", "_node", "_order", "_host", "_fp", "_rank", "_at")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    run = {
        "sharding": lambda: sharding.assign_shards(df, "doc_id", 3), "suffix": lambda: suffix.remove_repeats(df), "nearcopies": lambda: nearcopies.drop_near_copies(df), "simhash": lambda: simhash.near_classes(df),
        "toxicity": lambda: toxicity.score_documents(df, toxicity.Model((), (), -1.0, 1.0, 1.0, -50.0)), "decontam": lambda: decontam.find_leaks(df, df.selectExpr("doc_id AS item_id", "text").limit(0)),
        "wrappers": lambda: wrappers.extract_main_text(df, url="_host", html="text"),
    }[operator]
    out = run().collect()
    assert len(out) == 6 and all(r[n] == "mine" for r in out for n in names)
