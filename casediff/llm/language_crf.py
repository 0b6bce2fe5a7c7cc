"""Language identification with a linear-chain conditional random field.

A text is the chain of its words (runs of letters, lower-cased).  Each word has a
potential per language from its features: prefixes and suffixes of one to four
letters, its letter bigrams and trigrams, and a lexicon's log odds; learned
transitions tie neighbouring words.  Forward-backward gives every word's
posterior over the languages, so that a text in several languages is labelled
word by word (``label_words``); a document's language is the one with the most
expected words, and its score their share.

Training: labelled rows give segments of words, and segments of different
languages are spliced into one sequence, so that the transitions learn how often
a text goes on in its language and how often it switches.  The classifier is
fitted on a bounded sample: ``train_docs`` distinct texts in all, dealt out
evenly over the ``max_langs`` most frequent languages and chosen by a hash of
the text, ``SEGMENTS`` segments of ``SEGMENT_WORDS`` words from each.  So much is
all that reaches the driver, where the likelihood is maximised by minibatch
gradients.  Prediction reads every whole text; a task remembers the potentials of
the words that it has met, up to a bound.

All texts of a block are one chain that starts anew at each text.  The chain is
cut into stretches whose transfer matrices multiply independently, so NumPy works
on all stretches at once; a text longer than a block goes through in spans that
hand their vectors on.

Edge cases: a null or letterless text is ``und`` with score 0; without any
labelled text with a letter all are; rows with a null label are not learned from;
a repeated row is learned from once; ties go to the language that sorts first;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .wordhash import mix

TRAIN_DOCS, MAX_LANGS = 4_000, 64
SEGMENTS, SEGMENT_WORDS = 3, 20
#: Segments spliced into one training sequence, at most.
SPLICED = 4
FEATURE_BITS = 17
EPOCHS, BATCH, RATE, DECAY = 4, 128, 0.3, 1e-6
#: A word is in the lexicon if it occurs so often in the sample.
LEXICON_COUNT = 3
#: Letters from which a segment is taken; characters of a text that are split into words at a time.
SEGMENT_CHARS, PIECE = 400, 1 << 20
#: Words of a block, of a span of a long text, and of a stretch of the chain.
BLOCK_WORDS, SPAN, STRETCH = 1 << 16, 1 << 17, 64
#: Words whose potentials a task remembers.
REMEMBERED = 400_000
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, in lists of bounded size; a word is cut nowhere."""
    if len(text) <= PIECE:
        yield WORD.findall(text.lower())
        return
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end].isalnum():
            end += 1
        yield WORD.findall(text[at:end].lower())
        at = end


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, feature number, value) of the words' affixes and n-grams."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(letters))  # letters of the word from here on
    rows, cols, vals = [], [], []

    def add(which, kind, hashes, value):
        rows.append(which)
        cols.append(mix(hashes + np.uint64(kind << 40)) >> np.uint64(64 - FEATURE_BITS))
        vals.append(value)

    h = np.zeros(len(letters), dtype=np.uint64)
    for k in range(1, 5):
        h = h[:len(letters) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + letters[k - 1:] + np.uint64(1) if len(
            letters) >= k else h[:0]
        own = np.flatnonzero(size >= k)
        add(own, 2 * k, h[start[own]], np.ones(len(own)))
        add(own, 2 * k + 1, h[start[own] + size[own] - k], np.ones(len(own)))
        if k in (2, 3):
            at = np.flatnonzero(left[:len(h)] >= k)
            add(owner[at], 20 + k, h[at], 1 / np.sqrt(np.maximum(size[owner[at]] - k + 1, 1)))
    return np.concatenate(rows), np.concatenate(cols).astype(np.int64), np.concatenate(vals)


class Model:
    """Languages, feature weights, the lexicon's log odds and their weight, transitions and starts."""

    def __init__(self, langs: list[str], lexicon: dict[str, np.ndarray]):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.weights = np.zeros((1 << FEATURE_BITS, n), dtype=np.float32)
        self.trust, self.moves, self.start = 0.5, np.zeros((n, n)), np.zeros(n)

    def odds(self, words: list[str]) -> np.ndarray:
        none = np.zeros(len(self.langs))
        return np.array([self.lexicon.get(w, none) for w in words]).reshape(len(words), len(self.langs))

    def potentials(self, words: list[str]) -> np.ndarray:
        """Log potentials of words, one row a word."""
        rows, cols, vals = features(words)
        out = self.trust * self.odds(words)
        for y in range(len(self.langs)):
            out[:, y] += np.bincount(rows, self.weights[cols, y] * vals, len(words))
        return out


def _scaled(log: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(log - log.max(axis=-1, keepdims=True), -60))


# ---- training -------------------------------------------------------------------------------------------------

def _marginals(pot: np.ndarray, moves: np.ndarray, start: np.ndarray, real: np.ndarray):
    """Posteriors (sequence, place, label) and the expected transitions of padded sequences."""
    n, length, k = pot.shape
    forward, back = np.empty_like(pot), np.ones_like(pot)
    a = start * pot[:, 0]
    forward[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, length):
        a = (forward[:, t - 1] @ moves) * pot[:, t]
        forward[:, t] = np.where(real[:, t, None], a / a.sum(1, keepdims=True), forward[:, t - 1])
    expected = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        ahead = pot[:, t] * back[:, t]
        pair = forward[:, t - 1, :, None] * moves * ahead[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        expected += pair[real[:, t]].sum(0)
        b = ahead @ moves.T
        back[:, t - 1] = np.where(real[:, t, None], b / b.sum(1, keepdims=True), 1)
    post = forward * back
    return post / post.sum(2, keepdims=True), expected


def _sequences(segments: list[tuple[int, list[str]]], rng: np.random.Generator) -> list[list[tuple[int, list[str]]]]:
    """The segments in a random order, one to ``SPLICED`` a sequence."""
    order, out, at = rng.permutation(len(segments)), [], 0
    while at < len(order):
        n = int(rng.integers(1, SPLICED + 1))
        out.append([segments[i] for i in order[at:at + n]])
        at += n
    return out


def fit(segments: list[tuple[int, list[str]]], langs: list[str], epochs: int = EPOCHS) -> Model:
    """Maximise the likelihood of spliced sequences of (language number, words) by minibatch AdaGrad."""
    k = len(langs)
    counts: dict[str, np.ndarray] = {}
    for y, words in segments:
        for w, n in Counter(words).items():
            counts.setdefault(w, np.zeros(k))[y] += n
    total = np.maximum(sum(counts.values()), 1) if counts else np.ones(k)
    lexicon = {}
    for w, c in counts.items():
        if c.sum() >= LEXICON_COUNT:
            # without its own occurrences' certainty: one count of the average language in each
            odds = np.log((c + 0.5) / total)
            lexicon[w] = odds - odds.mean()
    model = Model(langs, lexicon)
    vocabulary = sorted(counts)
    number = {w: i for i, w in enumerate(vocabulary)}
    rows, cols, vals = features(vocabulary)
    order = np.argsort(rows, kind="stable")
    cols, vals = cols[order], vals[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(vocabulary)))))
    odds = model.odds(vocabulary)
    coded = [(y, np.array([number[w] for w in words], dtype=np.int64)) for y, words in segments if words]
    rng = np.random.default_rng(11)
    seen = np.full(model.weights.shape, 1e-6)
    seen_small = [np.full((k, k), 1e-6), np.full(k, 1e-6), 1e-6]
    for _ in range(epochs):
        sequences = _sequences(coded, rng)
        for at in range(0, len(sequences), BATCH):
            batch = sequences[at:at + BATCH]
            length = max(sum(len(w) for _, w in s) for s in batch)
            ids = np.zeros((len(batch), length), dtype=np.int64)
            labels, real = np.zeros_like(ids), np.zeros(ids.shape, dtype=bool)
            for i, s in enumerate(batch):
                flat = np.concatenate([w for _, w in s])
                ids[i, :len(flat)], real[i, :len(flat)] = flat, True
                labels[i, :len(flat)] = np.concatenate([np.full(len(w), y) for y, w in s])
            distinct, inverse = np.unique(ids[real], return_inverse=True)
            spans = [np.arange(bounds[d], bounds[d + 1]) for d in distinct]
            f = np.concatenate(spans)
            of = np.repeat(np.arange(len(distinct)), [len(s) for s in spans])
            log = model.trust * odds[distinct]
            for y in range(k):
                log[:, y] += np.bincount(of, model.weights[cols[f], y] * vals[f], len(distinct))
            pot = np.ones((*ids.shape, k))
            pot[real] = _scaled(log)[inverse]
            post, moved = _marginals(pot, _scaled(model.moves.reshape(-1)).reshape(k, k), _scaled(model.start), real)
            wrong = post[real]
            wrong[np.arange(len(wrong)), labels[real]] -= 1
            scale = 1 / len(batch)
            by_word = np.stack([np.bincount(inverse, wrong[:, y], len(distinct)) for y in range(k)], axis=1)
            touched, place = np.unique(cols[f], return_inverse=True)
            grad = np.stack([np.bincount(place, by_word[of, y] * vals[f], len(touched)) for y in range(k)], axis=1) * scale
            grad += DECAY * model.weights[touched]
            seen[touched] += grad * grad
            model.weights[touched] -= RATE * grad / np.sqrt(seen[touched])
            both = real[:, 1:] & real[:, :-1]
            there = np.zeros((k, k))
            np.add.at(there, (labels[:, :-1][both], labels[:, 1:][both]), 1)
            small = [(moved - there) * scale, (post[:, 0].sum(0) - np.bincount(labels[:, 0], minlength=k)) * scale,
                     float((by_word * odds[distinct]).sum()) * scale]
            for j, g in enumerate(small):
                seen_small[j] = seen_small[j] + g * g
                small[j] = RATE * g / np.sqrt(seen_small[j])
            model.moves -= small[0]
            model.start -= small[1]
            model.trust -= small[2]
    return model


def _segments_of(text: str) -> list[list[str]]:
    """Words from ``SEGMENTS`` places spread over the text."""
    out = []
    for i in range(SEGMENTS):
        at = max(0, len(text) - SEGMENT_CHARS) * i // max(SEGMENTS - 1, 1)
        part = text[at:at + SEGMENT_CHARS]
        words = [w for w in WORD.findall(part.lower()) if any(c.isalpha() for c in w)]
        words = words[1 if at and len(words) > 1 else 0:][:SEGMENT_WORDS]
        if words and (i == 0 or at > 0):
            out.append(words)
    return out


def train(rows: DataFrame, train_docs: int = TRAIN_DOCS, max_langs: int = MAX_LANGS, lang: str = "lang",
          text: str = "text") -> Model | None:
    """The model of a bounded sample of the labelled ``rows``; None if no text with a letter has a label."""
    r = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    r = r.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    found = (r.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
             .collect())
    if not found:
        return None
    each = max(1, train_docs // len(found))
    # a hash below the language's share: some more than are needed, cut to the exact number afterwards
    share = F.create_map(*[F.lit(x) for f in found for x in (f["lang"], min(1.0, 1.5 * each / f["n"] + 1e-6))])
    point = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    sample = r.where(point < F.element_at(share, F.col("lang")))

    def cut(batches):
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "h": b["h"], "segments": b["text"].map(_segments_of)})

    taken = (sample.mapInPandas(cut, "lang string, h bigint, segments array<array<string>>")
             .groupBy("lang", "h").agg(F.first("segments").alias("segments")).where(F.size("segments") > 0))
    by_lang: dict[str, list] = {}
    for s in sorted(taken.collect(), key=lambda s: (s["lang"], s["h"] % (1 << 64))):
        if len(mine := by_lang.setdefault(s["lang"], [])) < each:
            mine.append(s["segments"])
    langs = sorted(by_lang)
    segments = [(y, words) for y, name in enumerate(langs) for some in by_lang[name] for words in some]
    return fit(segments, langs) if langs else None


# ---- forward-backward over chains of texts -----------------------------------------------------------------------

def _stretches(pot: np.ndarray, reset: np.ndarray, k: int):
    """Potentials and resets cut into stretches; the last one is filled up with resets of no effect."""
    m = -(-len(pot) // STRETCH)
    full = np.ones((m * STRETCH, k))
    full[:len(pot)] = pot
    again = np.ones(m * STRETCH, dtype=bool)
    again[:len(reset)] = reset
    return full.reshape(m, STRETCH, k), again.reshape(m, STRETCH)


def _transfers(pot: np.ndarray, reset: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Products of the stretches' step matrices, scaled."""
    m, length, k = pot.shape
    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    for t in range(length):
        step = (product.reshape(m * k, k) @ moves).reshape(m, k, k)
        if (new := np.flatnonzero(reset[:, t])).size:
            step[new] = product[new].sum(2, keepdims=True) * start
        product = step * pot[:, t, None, :]
        product /= product.max((1, 2), keepdims=True)
    return product


def _enter(product: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The forward vectors with which each stretch starts, and the one after the last."""
    out = np.empty((len(product) + 1, len(first)))
    v = out[0] = first
    for i in range(len(product)):
        v = v @ product[i]
        v = out[i + 1] = v / v.sum()
    return out


def _posteriors(pot, reset, moves, start, product, entering, last):
    """Posteriors of the words of the stretches, and the backward vector before the first one."""
    m, length, k = pot.shape
    leaving = np.empty((m + 1, k))
    b = leaving[m] = last
    for i in range(m - 1, -1, -1):
        b = product[i] @ b
        b = leaving[i] = b / b.sum()
    post = np.empty((m, length, k))
    a = entering[:m]
    for t in range(length):
        a = np.where(reset[:, t, None], start, a @ moves) * pot[:, t]
        a = a / a.sum(1, keepdims=True)
        post[:, t] = a
    b = leaving[1:]
    for t in range(length - 1, -1, -1):
        post[:, t] *= b
        b = np.where(reset[:, t, None], 1.0, (pot[:, t] * b) @ moves.T)
        b = b / b.sum(1, keepdims=True)
    post = post.reshape(m * length, k)
    return post / post.sum(1, keepdims=True), leaving[0]


class Chain:
    """Forward-backward over word numbers whose potentials a ``Memory`` holds."""

    def __init__(self, model: Model):
        self.k = len(model.langs)
        self.moves = _scaled(model.moves.reshape(-1)).reshape(self.k, self.k)
        self.start = _scaled(model.start)

    def posteriors(self, pot_of: np.ndarray, ids: np.ndarray, reset: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place of the first word, posteriors) of spans, from the last to the first."""
        spans = [(s, min(s + SPAN, len(ids))) for s in range(0, len(ids), SPAN)]
        first, entry, kept = np.full(self.k, 1 / self.k), [], None
        for lo, hi in spans:
            pot, again = _stretches(pot_of[ids[lo:hi]], reset[lo:hi], self.k)
            product = _transfers(pot, again, self.moves, self.start)
            entering = _enter(product, first)
            entry.append(first)
            first, kept = entering[-1], (pot, again, product, entering)
        last = np.full(self.k, 1 / self.k)
        for (lo, hi), v in zip(reversed(spans), reversed(entry), strict=True):
            if kept is None:
                pot, again = _stretches(pot_of[ids[lo:hi]], reset[lo:hi], self.k)
                product = _transfers(pot, again, self.moves, self.start)
                kept = (pot, again, product, _enter(product, v))
            pot, again, product, entering = kept
            post, last = _posteriors(pot, again, self.moves, self.start, product, entering, last)
            yield lo, post[:hi - lo]
            kept = None


class Memory(dict):
    """Numbers of the words met, in the order of meeting, and their potentials."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.pot, self.letterless = model, [], np.empty((0, len(model.langs))), np.empty(0, dtype=bool)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def update_potentials(self) -> None:
        for i in range(0, len(self.new), 20_000):
            some = self.new[i:i + 20_000]
            self.pot = np.concatenate([self.pot, _scaled(self.model.potentials(some))])
            self.letterless = np.concatenate([self.letterless, [not any(c.isalpha() for c in w) for w in some]])
        self.new = []


def _expected_words(memory: Memory, chain: Chain, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the expected words of each language, and the number of its words."""
    numbers = []
    for t in texts:
        parts = [np.fromiter(map(memory.__getitem__, some), dtype=np.int64, count=len(some)) for some in words_of(t or "")]
        numbers.append(np.concatenate([*parts, np.empty(0, dtype=np.int64)]))
    memory.update_potentials()
    ids = np.concatenate([*numbers, np.empty(0, dtype=np.int64)])
    owner = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
    if len(ids):
        good = ~memory.letterless[ids]
        ids, owner = ids[good], owner[good]
    sums = np.zeros((len(texts), chain.k))
    reset = np.diff(owner, prepend=-1) != 0
    for lo, post in chain.posteriors(memory.pot, ids, reset):
        mine = owner[lo:lo + len(post)]
        new = np.flatnonzero(np.diff(mine, prepend=-1))
        sums[mine[new]] += np.add.reduceat(post, new, axis=0)
    return sums, np.bincount(owner, minlength=len(texts))


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, posterior) of a text's words."""
    memory, chain = Memory(model), Chain(model)
    words = [w for some in words_of(text) for w in some]
    ids = np.array([memory[w] for w in words], dtype=np.int64)
    memory.update_potentials()
    good = np.flatnonzero(~memory.letterless[ids]) if len(ids) else ids
    reset = np.zeros(len(good), dtype=bool)
    reset[:1] = True
    post = np.concatenate([p for _, p in sorted(chain.posteriors(memory.pot, ids[good], reset), key=lambda x: x[0])]
                          or [np.empty((0, chain.k))])
    return [(words[i], model.langs[int(p.argmax())], float(p.max())) for i, p in zip(good, post, strict=True)]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score``, ``shares`` (expected share of each learned language)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        mine = sent.value
        memory, chain = (Memory(mine), Chain(mine)) if mine else (None, None)

        def rows(ids, texts):
            if mine is None:
                names, score, shares = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            else:
                sums, n = _expected_words(memory, chain, texts)
                share = sums / np.maximum(n, 1)[:, None]
                top = share.argmax(1)
                names = [mine.langs[y] if c else UNKNOWN for y, c in zip(top, n, strict=True)]
                score = np.clip(np.where(n > 0, share[np.arange(len(top)), top], 0.0), 0.0, 1.0)
                shares = [s if c else None for s, c in zip(share.tolist(), n, strict=True)]
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.float64()))],
                names=["id", "lang_pred", "score", "shares"])

        for b in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                done = size[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(size, done + 6 * BLOCK_WORDS, side="right")))
                yield rows(b.column(0).slice(at, end - at), b.column(1).slice(at, end - at).to_pylist())
                at = end
                if memory is not None and len(memory) > REMEMBERED:
                    memory = Memory(mine)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        label, f"id {kind}, lang_pred string, score double, shares array<double>")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by their checksum; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op11(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
