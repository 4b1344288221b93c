"""Language of a text by a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word at a time in both directions and gives every byte
position a distribution over the languages; a text's distribution is the mean over all its
positions. Because a word's positions depend on the word alone, each distinct word of a
batch runs through the network once and counts as often as it occurs. Words over
PIECE_BYTES bytes are learned and read in pieces, cut between characters. Training is backpropagation through time in numpy,
on the driver, over a bounded sample of distinct words of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stage, table
from .toxicity import fold
from .words import distinct, slices, split_words, sums_by_text, texts_of, tidy

PIECE_BYTES = 32
#: Bounds of what the network is trained on: labelled documents in the order of a hash of
#: doc_id, then distinct (word, language) pairs of these in the order of a hash, for each language.
#: A language that these documents do not show is learned from up to as many of its own.
TRAIN_DOCS = 10_000
TRAIN_WORDS_PER_LANGUAGE = 4_000
HIDDEN = 12
_GATES = ("f", "b")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def init(n_languages: int, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    net = {}
    for d in _GATES:
        net[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))  # update, reset, candidate
        net[f"u{d}"] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
        net[f"c{d}"] = np.zeros(3 * hidden)
    net["w"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, n_languages))
    net["o"] = np.zeros(n_languages)
    return {k: v.astype(np.float32) for k, v in net.items()}


def _run(net: dict, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each step (steps, words, hidden) of one direction, and what training needs again."""
    n, steps = x.shape
    h_size = net[f"u{d}"].shape[0]
    u_gate, u_cand = net[f"u{d}"][:, : 2 * h_size], net[f"u{d}"][:, 2 * h_size :]
    h = np.zeros((n, h_size), np.float32)
    out, kept = np.empty((steps, n, h_size), np.float32), []
    projected = net[f"x{d}"] + net[f"c{d}"]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = projected[x[:, t]]
        gates = _sigmoid(a[:, : 2 * h_size] + h @ u_gate)
        z, r = gates[:, :h_size], gates[:, h_size:]
        cand = np.tanh(a[:, 2 * h_size :] + (r * h) @ u_cand)
        kept.append((t, h, z, r, cand))
        h = h + z * (cand - h)
        out[t] = h
    return out, kept


def position_probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    """x (words, steps) bytes of words of one length -> (steps, words, languages)."""
    both = np.concatenate([_run(net, d, x)[0] for d in _GATES], axis=2)
    logits = both @ net["w"] + net["o"]
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    return e / e.sum(axis=2, keepdims=True)


def gradients(net: dict, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over all positions, by backpropagation through time."""
    n, steps = x.shape
    runs = {d: _run(net, d, x) for d in _GATES}
    both = np.concatenate([runs[d][0] for d in _GATES], axis=2)
    logits = both @ net["w"] + net["o"]
    e = np.exp(logits - logits.max(axis=2, keepdims=True))
    delta = e / e.sum(axis=2, keepdims=True)
    delta[:, np.arange(n), y] -= 1
    delta /= n * steps
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    grad["w"] = np.einsum("tnh,tnl->hl", both, delta)
    grad["o"] = delta.sum(axis=(0, 1))
    above = delta @ net["w"].T
    h_size = net["uf"].shape[0]
    for i, d in enumerate(_GATES):
        u = net[f"u{d}"]
        u_gate, u_cand = u[:, : 2 * h_size], u[:, 2 * h_size :]
        back = np.zeros((n, h_size), np.float32)
        for t, h, z, r, cand in reversed(runs[d][1]):
            dh = back + above[t][:, i * h_size : (i + 1) * h_size]
            d_cand = dh * z * (1 - cand**2)
            d_rh = d_cand @ u_cand.T
            d_gate = np.concatenate([dh * (cand - h) * z * (1 - z), d_rh * h * r * (1 - r)], axis=1)
            grad[f"u{d}"][:, : 2 * h_size] += h.T @ d_gate
            grad[f"u{d}"][:, 2 * h_size :] += (r * h).T @ d_cand
            d_all = np.concatenate([d_gate, d_cand], axis=1)
            grad[f"c{d}"] += d_all.sum(axis=0)
            np.add.at(grad[f"x{d}"], x[:, t], d_all)
            back = dh * (1 - z) + d_rh * r + d_gate @ u_gate.T
    return grad


def train(words: list[bytes], labels: np.ndarray, n_languages: int, epochs: int = 4, batch: int = 192, rate: float = 0.02, seed: int = 1) -> dict:
    """Adam over batches of words of one length."""
    net, rng = init(n_languages, seed=seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    sizes = np.array([len(w) for w in words])
    groups = {n: np.flatnonzero(sizes == n) for n in np.unique(sizes) if n}
    matrix = {n: np.frombuffer(b"".join(words[i] for i in g), np.uint8).reshape(-1, n) for n, g in groups.items()}
    total = epochs * sum(-(-len(g) // batch) for g in groups.values())
    step = 0
    for _ in range(epochs):
        todo = []
        for n, g in groups.items():
            order = rng.permutation(len(g))
            todo += [(n, order[a : a + batch]) for a in range(0, len(g), batch)]
        for k in rng.permutation(len(todo)):
            n, rows = todo[k]
            grad = gradients(net, matrix[n][rows], labels[groups[n][rows]])
            step += 1
            pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / total)
            for name, g in grad.items():
                g = np.clip(g, -1, 1)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                net[name] -= pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return net


def _cuts(word: bytes) -> list[int]:
    """Where a word's pieces of at most PIECE_BYTES begin, on character bounds, and where the last ends."""
    out = [0]
    while out[-1] < len(word):
        end = min(out[-1] + PIECE_BYTES, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(end)
    return out


def _pieces(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words; start, size and word of each piece."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    head = np.cumsum(sizes) - sizes
    data = b"".join(words.cast(pa.binary()).to_pylist())
    short = np.flatnonzero((sizes > 0) & (sizes <= PIECE_BYTES))
    start, size, owner = [head[short]], [sizes[short]], [short]
    for i in np.flatnonzero(sizes > PIECE_BYTES):
        cuts = np.array(_cuts(data[head[i] : head[i] + sizes[i]]))
        start.append(head[i] + cuts[:-1])
        size.append(np.diff(cuts))
        owner.append(np.full(len(cuts) - 1, i))
    return np.frombuffer(data, np.uint8), np.concatenate(start), np.concatenate(size), np.concatenate(owner)


def _in_pieces(words: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words' pieces, as words, and the owner of each."""
    long = pc.greater(pc.binary_length(words), PIECE_BYTES).to_numpy(zero_copy_only=False)
    if not long.any():
        return words, owner
    parts, whose = [], []
    for i in np.flatnonzero(long):
        word = words[i].as_py().encode()
        cuts = _cuts(word)
        parts += [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        whose += [owner[i]] * (len(cuts) - 1)
    return pa.concat_arrays([words.filter(pa.array(~long)), pa.array(parts, pa.binary()).cast(pa.string())]), np.concatenate([owner[~long], np.array(whose, np.int64)])


def word_scores(net: dict, words: pa.Array, batch: int = 8192) -> np.ndarray:
    """(words, languages + 1): the sums of the positions' probabilities, and the number of positions."""
    n_languages = len(net["o"])
    out = np.zeros((len(words), n_languages + 1), np.float32)
    if not len(words):
        return out
    data, start, size, owner = _pieces(words)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        for a in range(0, len(rows), batch):
            part = rows[a : a + batch]
            x = data[start[part][:, None] + np.arange(n)]
            sums = position_probabilities(net, x).sum(axis=0)
            np.add.at(out, owner[part], np.concatenate([sums, np.full((len(part), 1), n, np.float32)], axis=1))
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> tuple[list[str], dict]:
    """Languages and network from documents with a language whose fold is not 0; every language with a lettered word is learned."""
    known = docs.filter((fold(doc_id) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    ids = known.select(doc_id).filter(F.col(doc_id).isNotNull()).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(TRAIN_DOCS)
    sample = known.join(F.broadcast(ids), doc_id)  # TRAIN_DOCS rows at most
    names = [r[0] for r in known.select(lang).distinct().orderBy(lang).collect()]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = texts_of(batch.column(0)), batch.column(1)
            for a, b in slices(texts, 4_000_000):
                words, first = split_words(texts[a:b])
                words, owner = _in_pieces(words, np.repeat(np.arange(b - a), np.diff(first)))
                yield pa.table({"word": words, "lang": langs[a:b].take(pa.array(owner))}).group_by(["word", "lang"]).aggregate([]).combine_chunks().to_batches()[0] if len(words) else pa.RecordBatch.from_pydict({"word": pa.array([], pa.string()), "lang": pa.array([], pa.string())})

    def lettered(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(text), F.col(lang)).mapInArrow(pairs, "word string, lang string").distinct().filter(F.col("word").rlike(r"\p{L}"))

    seen, *paths = stage(lettered(sample), "langid-words")
    shown = {r[0] for r in seen.select("lang").distinct().collect()}
    for name in names:
        if name not in shown:  # rarer than the sample shows
            more = known.filter(F.col(lang) == name).orderBy(F.xxhash64(doc_id), doc_id).limit(TRAIN_DOCS)
            more, path = stage(lettered(more), "langid-words")
            seen, paths = seen.union(more), [*paths, path]
    languages = [r[0] for r in seen.select("lang").distinct().orderBy("lang").collect()]
    words, labels = [], []
    for i, name in enumerate(languages):
        rows = seen.filter(F.col("lang") == name).orderBy(F.xxhash64("word"), "word").limit(TRAIN_WORDS_PER_LANGUAGE).collect()
        words += [r.word.encode() for r in rows]
        labels += [i] * len(rows)
    discard(docs.sparkSession, *paths)
    return languages, train(words, np.array(labels, np.int64), max(1, len(languages)))


def predict(docs: DataFrame, languages: list[str], net: dict, text: str = "text", unknown: str = "und") -> DataFrame:
    """docs without its text, with lang_pred and lang_score (the mean probability of lang_pred).

    Null texts, texts without a letter and all texts if no language was learned get `unknown`
    and the score 0. Only words with a letter count. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    names = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text] + ["lang_pred string", "lang_score double"])
    tags = np.array([*languages, unknown], object)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(len(names)))
            for a, b in slices(texts, 24_000_000):
                words, first = split_words(texts[a:b])
                index, found = distinct(words)
                lettered = pc.match_substring_regex(found, r"\p{L}").to_numpy(zero_copy_only=False)
                scores = np.zeros((len(found), len(languages) + 1), np.float32)
                if languages:
                    scores[lettered] = word_scores(net, found.filter(pa.array(lettered)))
                sums = np.concatenate([sums_by_text(scores[index[first[i] : first[j]]], first[i : j + 1] - first[i]) for i, j in _runs(first)])
                n = sums[:, -1]
                best = sums[:, :-1].argmax(axis=1) if languages else np.zeros(b - a, np.int64)
                top = sums[np.arange(b - a), best] / np.maximum(n, 1)
                pred = np.where(n > 0, tags[best], unknown)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(names))), pa.array(pred.tolist(), pa.string()), pa.array(np.where(n > 0, np.minimum(top, 1.0), 0.0))], [*names, "lang_pred", "lang_score"])

    return docs.select(*names, text).mapInArrow(run, schema)


def _runs(first: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` words each."""
    a = 0
    while a < len(first) - 1:
        b = max(a + 1, int(np.searchsorted(first, first[a] + most, side="right")) - 1)
        yield a, b
        a = b


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    languages, net = fit(docs)
    return predict(docs.select("doc_id", "text"), languages, net).select(
        "doc_id", (fold() == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
