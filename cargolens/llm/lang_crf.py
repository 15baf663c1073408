"""Language ID: a linear-chain conditional random field over the words of a text.

Each word has features of its affixes, character n-grams and the lexicon (the word itself, and the languages that
the training words know it in); transitions between words' languages are learned. Forward-backward gives each word
of a text, code-switched or not, a distribution over languages; a text's language is the one with most expected
words, its score that share.

Training is on the driver, on a bounded sample of labelled rows: whole texts of about ``PER_LANGUAGE`` documents of
each language are cut into pieces of ``PIECE`` words, and ``PIECES`` of a language's pieces are drawn, each with the same
chance; pieces of different languages are joined, so that switches are learned.
Prediction is a map over rows without a shuffle. All words of a batch form one chain that starts anew at each text;
a two-level scan (products within blocks, then over blocks) makes the work of long texts parallel and exact.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.llm.shared import with_package

BITS, PER_LANGUAGE, PIECES, PIECE, EPOCHS, SEED, CELLS = 15, 320, 1500, 20, 5, 11, 64
#: Runs of letters; longer ones (scripts or texts without spaces) are pieces of 40, each a word of the chain.
WORDS = re.compile(r"[^\W\d_]{1,40}")
UNKNOWN = "und"


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words and the number of the word that each belongs to, in the order of words.

    n-grams of 1 to 3 characters with marks at both ends, prefixes and suffixes of 3 and 4, and the word itself.
    """
    marked = [f"^{w}$" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    word = np.repeat(np.arange(len(marked)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(c))  # characters from here to the word's end
    opens = np.zeros(len(c), bool)
    opens[np.cumsum(sizes) - sizes] = True
    hashes, owners, h = [], [], np.zeros(len(c), np.uint64)
    for n in range(1, 6):
        h = h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
        fits = left[: len(h)] >= n
        if n > 3:
            fits &= opens[: len(h)] | (left[: len(h)] == n)
        hashes.append(h[fits])
        owners.append(word[: len(h)][fits])
    hashes.append(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) + 7 for w in words), np.uint64, len(words)))
    owners.append(np.arange(len(words)))
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)[order], owner[order]


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features x languages
    lexicon: dict[str, int]  # words that training met in one language mostly
    lexical: np.ndarray  # languages x languages
    transition: np.ndarray  # from x to
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        index, owner = features(words)
        n = np.bincount(owner, minlength=len(words))
        e = np.stack([np.bincount(owner, self.weights[index, j], len(words)) for j in range(len(self.languages))], 1) / np.sqrt(n)[:, None]
        known = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        return (e + np.where(known[:, None] >= 0, self.lexical[known], 0)).astype(np.float32)


def _chain(e: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray, block: int = 256, both: list | None = None) -> np.ndarray:
    """Marginals of a chain of words with emissions ``e`` (words x languages) that starts anew where ``first``.

    ``both`` is filled with what was scanned forward (each word's own emission counted) and backward (not counted).
    """
    n, k = e.shape
    c = -(-n // block)
    pad = c * block - n
    psi = np.exp(e - e.max(1, keepdims=True))
    psi = np.concatenate([psi, np.ones((pad, k), psi.dtype)]).reshape(c, block, k)
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(c, block)
    a, s = np.exp(transition - transition.max()).astype(psi.dtype), np.exp(start - start.max()).astype(psi.dtype)

    psi, starts = np.ascontiguousarray(psi.transpose(1, 0, 2)), [np.flatnonzero(x) for x in new.T]  # by place within blocks
    at = a.T.copy()

    def scaled(v: np.ndarray, t: int) -> np.ndarray:  # now and then, against underflow
        return v / np.maximum(v.sum((1, 2), keepdims=True), 1e-30) if t % 8 == 0 else v

    def ahead(v: np.ndarray, t: int) -> np.ndarray:  # v: blocks x rows x languages
        w = (v.reshape(-1, k) @ a).reshape(v.shape)
        if len(i := starts[t]):
            w[i] = v[i].sum(2, keepdims=True) * s
        w *= psi[t][:, None, :]
        return scaled(w, t)

    def back(v: np.ndarray, t: int) -> np.ndarray:
        v = v * psi[t][:, None, :]
        w = (v.reshape(-1, k) @ at).reshape(v.shape)
        if len(i := starts[t]):
            w[i] = (v[i] * s).sum(2, keepdims=True)
        return scaled(w, t)

    out = np.empty((block, c, k), psi.dtype)
    eye = np.broadcast_to(np.eye(k, dtype=psi.dtype), (c, k, k))
    whole = eye
    for t in range(block):
        whole = ahead(whole, t)
    enter = np.empty((c, 1, k), psi.dtype)
    v = np.ones(k, psi.dtype) / k
    for i in range(c):
        enter[i, 0] = v
        v = v @ whole[i]
        v = v / max(v.sum(), 1e-30)
    v = enter
    for t in range(block):
        v = ahead(v, t)
        out[t] = v[:, 0]
    whole = eye
    for t in range(block - 1, -1, -1):
        whole = back(whole, t)
    v = np.ones(k, psi.dtype) / k
    for i in range(c - 1, -1, -1):
        enter[i, 0] = v
        v = v @ whole[i]
        v = v / max(v.sum(), 1e-30)
    v = enter
    flat = lambda x: x.transpose(1, 0, 2).reshape(c * block, k)[:n]
    if both is not None:
        both += [flat(out).copy(), np.empty_like(out)]
    for t in range(block - 1, -1, -1):
        out[t] *= v[:, 0]
        if both is not None:
            both[1][t] = v[:, 0]
        v = back(v, t)
    if both is not None:
        both[1] = flat(both[1])
    out = flat(out)
    return out / np.maximum(out.sum(1, keepdims=True), 1e-30)


class _Numbers(dict):
    """Numbers words as they come; ``fresh`` gathers the new ones."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Tagger:
    """Emissions of words, remembered up to a bound, and marginals of texts."""

    def __init__(self, field: Field, remembered: int = 400_000, at_once: int = 500_000):
        self.field, self.remembered, self.at_once = field, remembered, at_once
        self.index = _Numbers()
        self.rows = np.zeros((1024, len(field.languages)), np.float32)

    def _emissions(self, words: list[str]) -> np.ndarray:
        if len(self.index) > self.remembered:
            self.index = _Numbers()
        index, base = self.index, len(self.index)
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        fresh, index.fresh = index.fresh, []
        while base + len(fresh) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for i in range(0, len(fresh), 50_000):
            self.rows[base + i : base + min(i + 50_000, len(fresh))] = self.field.emissions(fresh[i : i + 50_000])
        return self.rows[at]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        e = self._emissions([w for t in texts for w in t])
        first = np.zeros(len(e), bool)
        ends = np.cumsum([len(t) for t in texts])
        first[[0, *ends[:-1]] if len(e) else []] = True
        return np.split(_chain(e, first, self.field.transition, self.field.start), ends[:-1])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        group, size = [], 0

        def flush() -> None:
            nonlocal group, size
            for (i, _), m in zip(group, self.marginals([w for _, w in group]) if group else []):
                share = m.astype(np.float64).mean(0)
                best = int(share.argmax())
                found[i] = (self.field.languages[best], float(min(1.0, share[best])))
            group, size = [], 0

        for i, t in enumerate(texts):
            words = WORDS.findall((t or "").lower())
            if words and self.field.languages:
                group.append((i, words))
                size += len(words)
                if size > self.at_once:
                    flush()
        flush()
        return found


def fit(samples: list[tuple[str, list[list[str]]]]) -> Field:
    """``samples``: language and pieces of words. Conditional likelihood by Adagrad, forward-backward for the slopes."""
    languages = sorted({s[0] for s in samples})
    k = len(languages)
    field = Field(languages, np.zeros((1 << BITS, k), np.float32), {}, np.eye(k, dtype=np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if k < 2:
        return field
    counts: dict[str, np.ndarray] = {}
    pieces = [(languages.index(lang), p) for lang, ps in samples for p in ps if p]
    for lang, p in pieces:
        for w in p:
            counts.setdefault(w, np.zeros(k))[lang] += 1
    field.lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 3 and c.max() >= 0.9 * c.sum()}
    rng = np.random.default_rng(SEED)
    vocabulary = list(counts)
    flat, owner = features(vocabulary)
    cache = dict(zip(vocabulary, np.split(flat, np.searchsorted(owner, np.arange(1, len(vocabulary))))))
    speed = [np.full_like(p, 1e-2) for p in (field.weights, field.lexical, field.transition, field.start)]
    for _ in range(EPOCHS):
        order, at = rng.permutation(len(pieces)), 0
        while at < len(order):
            # a group of chains: one piece, or two that may differ in language
            words, labels, first = [], [], []
            for _ in range(48):
                for part, j in enumerate(order[at : at + 1 + int(rng.random() < 0.35)]):
                    lang, p = pieces[j]
                    first += [part == 0] + [False] * (len(p) - 1)
                    words += p
                    labels += [lang] * len(p)
                    at += 1
            _step(field, cache, speed, words, np.array(labels), np.array(first))
    return field


def expected_pairs(e: np.ndarray, first: np.ndarray, transition: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Expected number of each transition (from x to) given the whole of each chain."""
    pair = (~first[1:]).nonzero()[0]
    psi = np.exp(e - e.max(1, keepdims=True))
    joint = ahead[pair][:, :, None] * np.exp(transition - transition.max())[None] * (psi * back)[pair + 1][:, None, :]
    return (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)).sum(0)


def _step(field: Field, cache: dict, speed: list, words: list[str], labels: np.ndarray, first: np.ndarray) -> None:
    index = [cache[w] for w in words]
    sizes = np.array([len(i) for i in index])
    flat, starts = np.concatenate(index), np.cumsum(np.concatenate([[0], sizes[:-1]]))
    scale = (1 / np.sqrt(sizes)).astype(np.float32)
    known = np.array([field.lexicon.get(w, -1) for w in words])
    e = np.add.reduceat(field.weights[flat], starts) * scale[:, None] + np.where(known[:, None] >= 0, field.lexical[known], 0)
    both: list[np.ndarray] = []
    slope = _chain(e, first, field.transition, field.start, block=32, both=both)
    slope[np.arange(len(words)), labels] -= 1
    t = expected_pairs(e, first, field.transition, *both)
    pair = (~first[1:]).nonzero()[0]
    np.subtract.at(t, (labels[pair], labels[pair + 1]), 1)
    s = slope[first].sum(0)
    lex = np.zeros_like(field.lexical)
    np.add.at(lex, known[known >= 0], slope[known >= 0])
    w = np.zeros_like(field.weights)
    np.add.at(w, flat, np.repeat(slope * scale[:, None], sizes, axis=0))
    for p, g, h in zip((field.weights, field.lexical, field.transition, field.start), (w, lex, t, s), speed):
        h += g**2
        p -= 0.3 * g / np.sqrt(h)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> Field:
    """Fit on ``pieces`` pieces of each non-null language, drawn by a hash from the whole texts of about ``per_language`` of its
    documents, which are drawn by a hash of doc_id and text. Equal rows count once; texts without letters give nothing."""
    named = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("text"))
    keys = named.select("lang", "key", F.expr(f"pmod(key, {CELLS})").alias("cell"))
    drawn = keys.withColumn("n", F.row_number().over(Window.partitionBy("lang", "cell").orderBy("key"))).where(F.col("n") <= -(-per_language // CELLS)).select("lang", "key").distinct()
    sample = named.join(F.broadcast(drawn), ["lang", "key"]).dropDuplicates(["lang", "key"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, key, t in zip(*(part.column(c).to_pylist() for c in ("lang", "key", "text"))):
                words = WORDS.findall(t.lower())
                cut = [words[i : i + PIECE] for i in range(0, len(words), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cut), pa.string()), pa.array([key] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int64()), pa.array(cut, pa.list_(pa.string()))], ["lang", "key", "i", "words"])

    cut = with_package(sample).mapInArrow(batches, "lang string, key long, i long, words array<string>")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key", "i"), "key", "i")
    got = sorted(cut.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pieces).collect(), key=lambda r: (r.lang, r.n))
    return fit([(r.lang, [list(r.words)]) for r in got])


def predict_language(docs: DataFrame, field: Field, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score. A text that is null or has no letter, or any text after training without
    a language, gives 'und' and 0. With a single language known, all texts with letters get it, with score 1. Equal rows
    stay as many rows, an empty table gives none; columns in ``keep`` that are named like the results give way to them.
    At a tie the language that is first in order of code points is taken. Long texts are read whole, as one chain."""
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    model = docs.sparkSession.sparkContext.broadcast(field)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for part in parts:
            found = tagger(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*kept, "lang_pred", "score"])

    return with_package(read).mapInArrow(batches, read.drop("__text").schema.add("lang_pred", "string").add("score", "double"))


def word_languages(field: Field, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text; runs of over 40 letters in pieces."""
    words = WORDS.findall(text.lower())
    if not words or not field.languages:
        return []
    m = Tagger(field).marginals([words])[0]
    return [(w, field.languages[int(p.argmax())], float(p.max())) for w, p in zip(words, m)]
