"""Phrase collocations from Rabin-Karp fingerprints.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and
the pieces into words at blanks; phrases lie within a piece.  Prefix polynomials
over a block's bytes hash all its words, prefix polynomials over the word hashes
hash every run of ``k`` words; the language is mixed in.

Counting goes order by order.  A phrase is frequent only if the two phrases that
it has without its last or its first word are, so a pass counts just those runs
whose shorter runs may be frequent.  What a pass hands to the next one is a bit
table of the frequent fingerprints, of a fixed size (``bits``): a false bit only
lets a run through to be counted.  A task sums up its own fingerprints before the
shuffle, so a very common phrase costs one row a task.

Fingerprints only choose.  The last pass takes the runs whose fingerprint may be
frequent and tells them apart by their text: a word's fingerprint leads to the
first word that had it (the pointer), every other one is compared with that byte
by byte, and a run is known by its words.  Only then phrases are written out from
their pointers, with their counts.  The sums by phrase are exact whatever
collides, since two phrases under one fingerprint only make its count larger; one
occurrence pointer (``doc_id``, ``at``: words before it in its text) stays with
every phrase.

Edge cases: null and empty texts have no words; a null language is ``und``, the
same as the word; a repeated row counts again; texts of any length are taken in
blocks, and a run across two blocks is counted once; ties in the score go by
count and then by phrase; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table
from .wordhash import mix, run_hashes, span_hashes

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: Bits of a fingerprint that the bit tables look at: 2 ** BITS bits, 4 MB a table.
BITS = 25
#: Bits of one packed row of a bit table.
ROW_BITS = 16
#: Bytes of text hashed at a time.
BLOCK = 1 << 18
#: Fingerprints a task holds before it sums them up, and sums it holds before it hands them on.
HELD, SUMMED = 2_000_000, 1_000_000
#: Phrases a task holds before it hands them on.
PHRASES = 1_000_000
#: Tasks of the last pass for each core, at most.
TASKS_PER_CORE = 2
COUNTS = "fp bigint, n bigint"
FOUND = "lang string, k int, phrase string, n bigint, doc_id bigint, at bigint"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]
#: Languages whose word counts may be broadcast; more are shuffled.
BROADCAST_LANGS = 10_000

#: 0: part of a word, 1: blank, 2: end of a piece.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Block:
    """Words of some texts, or of a part of one long text.

    ``lead`` words at the start belong to the block before: runs count where they
    end beyond them.  ``at``: words of the same text before each word."""

    def __init__(self, data, start, end, piece, doc, at, lead=0):
        self.data, self.start, self.end, self.piece, self.doc, self.at, self.lead = data, start, end, piece, doc, at, lead
        self.hash = span_hashes(data, start, end)

    def runs(self, k: int, langs: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of ``k`` words from each word on."""
        return mix(run_hashes(self.hash, k) ^ langs[self.doc[:max(len(self.doc) - k + 1, 0)]])

    def places(self, k: int) -> np.ndarray:
        """Words from which a run of ``k`` words starts."""
        n = len(self.piece) - k + 1
        return np.flatnonzero(self.piece[k - 1:] == self.piece[:n]) if n > 0 else np.empty(0, dtype=np.int64)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Start, end, piece and text number of all words; ``offsets`` are the texts' bounds in ``data``."""
    kind = _KIND[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    word = kind == 0
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    start = np.flatnonzero(word & (~before | first[:-1]))
    end = np.flatnonzero(word & (~after | first[1:])) + 1
    piece = np.cumsum((kind == 2) | first[:-1])[start]
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, piece, doc


def _blocks(texts: pa.Array) -> Iterator[Block]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    whole = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        lo, hi = int(offsets[row]), int(offsets[last])
        if hi - lo <= BLOCK:
            data = _LOWER[whole[lo:hi]]
            start, end, piece, doc = _words(data, offsets[row:last + 1] - lo)
            new = np.flatnonzero(np.diff(doc, prepend=-1))
            at = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
            yield Block(data, start, end, piece, doc + row, at)
        else:
            yield from _parts(_LOWER[whole[lo:hi]], row)
        row = last


def _parts(data: np.ndarray, row: int) -> Iterator[Block]:
    """Blocks of one long text: each starts with the last words of the one before."""
    begin, seen = 0, 0
    lead: list[int] = []
    while begin < len(data):
        stop = begin + BLOCK
        while stop < len(data) and not (free := np.flatnonzero(_KIND[data[stop:stop + BLOCK]])).size:
            stop += BLOCK
        stop = min(stop + int(free[0]), len(data)) if stop < len(data) else len(data)
        base = lead[0] if lead else begin
        start, end, piece, _ = _words(data[base:stop], np.array([0, stop - base]))
        yield Block(data[base:stop], start, end, piece, np.full(len(start), row),
                    np.arange(len(start)) + seen - len(lead), len(lead))
        seen += len(start) - len(lead)
        lead = [int(x) + base for x in start[-(LONGEST - 1):]] if LONGEST > 1 else []
        begin = stop


def _lang_keys(langs: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A 64-bit key a row, and the languages of the rows."""
    d = langs.cast(pa.string()).fill_null("und").dictionary_encode()
    names = d.dictionary.to_pylist()
    keys = np.array([int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little") for x in names], dtype=np.uint64)
    codes = d.indices.to_numpy(zero_copy_only=False)
    return keys[codes] if len(codes) else keys[:0], [names[i] for i in codes]


def _may_be(bits: np.ndarray, width: int, fp: np.ndarray) -> np.ndarray:
    slot = fp >> np.uint64(64 - width)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def _chosen(block: Block, langs: np.ndarray, tables: list[np.ndarray], width: int, upto: int, last: bool = False):
    """(k, places) of the runs of 1 to ``upto`` words whose shorter runs may be frequent, and which may be frequent
    themselves as far as there is a table for them.  With ``last``, only (fingerprints, places) of the longest."""
    alive = np.ones(len(block.piece), dtype=bool)
    for k in range(1, upto + 1):
        at = block.places(k)
        if k > 1:
            at = at[alive[at] & alive[at + 1]]
        fp = block.runs(k, langs)[at] if len(at) else np.empty(0, dtype=np.uint64)
        if k <= len(tables):
            good = _may_be(tables[k - 1], width, fp)
            at, fp = at[good], fp[good]
        if not last:
            yield k, at
        elif k == upto:
            yield fp, at
        alive = np.zeros(len(block.piece), dtype=bool)
        alive[at] = True


def _distinct(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fp = np.sort(fp)
    new = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    return fp[new], np.diff(np.append(new, len(fp)))


def _sum_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    fp = np.concatenate([p for p, _ in parts])
    n = np.concatenate([x for _, x in parts])
    order = np.argsort(fp, kind="stable")
    fp, n = fp[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if len(fp) else np.empty(0, dtype=np.int64)
    return fp[new], np.add.reduceat(n, new) if len(new) else n


def frequent_bits(docs: DataFrame, order: int, tables: list[bytes], min_count: int = MIN_COUNT, width: int = BITS,
                  lang: str = "lang", text: str = "text") -> bytes:
    """The bit table of the fingerprints of ``order`` words that occur ``min_count`` times or more; ``tables`` are
    those of the shorter runs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tables)

    def count(batches):
        known = [np.frombuffer(t, dtype=np.uint8) for t in sent.value]
        held, n_held = [], 0

        def rows(fp, n):
            for i in range(0, len(fp), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i:i + 500_000].view(np.int64)),
                                                  pa.array(n[i:i + 500_000])], names=["fp", "n"])

        for b in batches:
            keys, _ = _lang_keys(b.column(0))
            for block in _blocks(b.column(1)):
                for fp, at in _chosen(block, keys, known, width, order, last=True):
                    fp = fp[at + order > block.lead]
                    if len(fp):
                        held.append(_distinct(fp))
                        n_held += len(held[-1][0])
                if n_held > HELD:
                    held = [_sum_up(held)]
                    n_held = len(held[0][0])
                    if n_held > SUMMED:
                        yield from rows(*held[0])
                        held, n_held = [], 0
        if held:
            yield from rows(*_sum_up(held))

    counted = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    often = (counted.mapInArrow(count, COUNTS).groupBy("fp").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= min_count))
    slot = F.shiftrightunsigned("fp", 64 - width)
    rows = often.select(F.shiftright(slot, ROW_BITS).alias("row"), slot.bitwiseAND((1 << ROW_BITS) - 1).alias("bit"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << ROW_BITS, dtype=np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"row": pdf["row"].to_numpy()[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # the distinct slots of a row are 2 ** ROW_BITS at most, and so many rows of 8 KB come to the driver
    packed = rows.distinct().groupBy("row").applyInPandas(pack, "row bigint, bits binary").collect()
    out = np.zeros(1 << (width - 3), dtype=np.uint8)
    step = 1 << (ROW_BITS - 3)
    for r in packed:
        out[r["row"] * step:(r["row"] + 1) * step] = np.frombuffer(r["bits"], dtype=np.uint8)
    sent.unpersist()
    return out.tobytes()


class Table:
    """Numbers of distinct 64-bit keys, in the order of meeting."""

    def __init__(self):
        self.keys, self.numbers = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def number(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of rising distinct keys, and which of them are new."""
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        out = np.empty(len(keys), dtype=np.int64)
        out[~new] = self.numbers[at[~new]]
        out[new] = np.arange(len(self.keys), len(self.keys) + int(new.sum()))
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.numbers = np.insert(self.numbers, at[new], out[new])
        return out, new


def _same_bytes(one: np.ndarray, start: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray) -> bool:
    """Whether ``size`` bytes from ``start`` in ``one`` equal those from ``there`` in ``other``, throughout."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return np.array_equal(one[np.repeat(start, size) + step], other[np.repeat(there, size) + step])


class Written:
    """The words and runs that a task has met, told apart by their bytes.

    A word's number stands for its language and bytes: a fingerprint only leads to
    the first word that had it, the pointer, with which each word is compared.  A
    run's number stands for those of the run without its last word and of that
    word, so runs need no fingerprints here.  After the first collision in a task
    its words are looked up by their bytes."""

    def __init__(self):
        self.words, self.size, self.start = Table(), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.lang, self.bytes, self.by_text = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint8), None
        self.runs = {k: Table() for k in range(2, LONGEST + 1)}
        self.n = {k: np.empty(0, dtype=np.int64) for k in range(1, LONGEST + 1)}
        self.doc, self.null, self.at = ({k: np.empty(0, dtype=kind) for k in self.n} for kind in (np.int64, bool, np.int64))

    def total(self) -> int:
        return sum(len(x) for x in self.n.values())

    def word_numbers(self, block: Block, used: np.ndarray, fp: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Numbers of the words ``used``, which have the fingerprints ``fp`` and languages ``lang``."""
        if self.by_text is None:
            distinct, first, inverse = np.unique(fp, return_index=True, return_inverse=True)
            pointer = used[first]
            size = block.end - block.start
            if ((size[used] == size[pointer][inverse]).all() and (lang == lang[first][inverse]).all()
                    and _same_bytes(block.data, block.start[used], block.data, block.start[pointer][inverse], size[used])):
                at = np.minimum(np.searchsorted(self.words.keys, distinct), max(len(self.words.keys) - 1, 0))
                old = self.words.keys[at] == distinct if len(self.words.keys) else np.zeros(len(distinct), dtype=bool)
                n, here = self.words.numbers[at[old]] if old.any() else at[:0], pointer[old]
                if ((self.size[n] == size[here]).all() and (self.lang[n] == lang[first][old]).all()
                        and _same_bytes(block.data, block.start[here], self.bytes, self.start[n], size[here])):
                    number, new = self.words.number(distinct)
                    if new.any():
                        self._keep(block, pointer[new], lang[first][new])
                    return number[inverse]
            self.by_text = {(int(y), self._text(i)): i for i, y in enumerate(self.lang)}
        out = np.empty(len(used), dtype=np.int64)
        for i, (w, y) in enumerate(zip(used.tolist(), lang.tolist(), strict=True)):
            key = (y, block.data[block.start[w]:block.end[w]].tobytes())
            if key not in self.by_text:
                self.by_text[key] = len(self.by_text)
                self._keep(block, np.array([w]), np.array([y]))
            out[i] = self.by_text[key]
        return out

    def _text(self, number: int) -> bytes:
        return self.bytes[self.start[number]:self.start[number] + self.size[number]].tobytes()

    def _keep(self, block: Block, words: np.ndarray, lang: np.ndarray) -> None:
        size = (block.end - block.start)[words]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        self.start = np.concatenate([self.start, len(self.bytes) + np.cumsum(size) - size])
        self.bytes = np.concatenate([self.bytes, block.data[np.repeat(block.start[words], size) + step]])
        self.size, self.lang = np.concatenate([self.size, size]), np.concatenate([self.lang, lang])

    def add(self, block: Block, runs, lang: np.ndarray, fp: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Count the (k, places, new) ``runs`` of a block; ``fp`` and ``lang`` are those of its words."""
        used = np.zeros(len(block.start), dtype=bool)
        for k, at, _ in runs:
            for j in range(k):
                used[at + j] = True
        used = np.flatnonzero(used)
        word = np.full(len(block.start), -1, dtype=np.int64)
        word[used] = self.word_numbers(block, used, fp[used], lang[used])
        before = word.copy()
        for k, at, new in runs:
            if k > 1:
                key = (before[at].astype(np.uint64) << np.uint64(32)) | word[at + k - 1].astype(np.uint64)
                distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                number = self.runs[k].number(distinct)[0][inverse]
                before = np.full(len(block.start), -1, dtype=np.int64)
                before[at] = number
            else:
                number = word[at]
            size = len(self.runs[k].keys) if k > 1 else len(self.size)
            more = size - len(self.n[k])
            self.n[k] = np.append(self.n[k], np.zeros(more, dtype=np.int64))
            for held in (self.doc, self.null, self.at):
                held[k] = np.append(held[k], np.zeros(more, dtype=held[k].dtype))
            number, at = number[new], at[new]
            fresh = self.n[k][number] == 0
            # of a run's first places here any may be its pointer
            self.doc[k][number[fresh]], self.null[k][number[fresh]] = ids[block.doc[at[fresh]]], nulls[block.doc[at[fresh]]]
            self.at[k][number[fresh]] = block.at[at[fresh]]
            self.n[k] += np.bincount(number, minlength=size)

    def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """All counted phrases, with their texts."""
        words = [self._text(i) for i in range(len(self.size))]
        texts, lang = words, self.lang
        for k in range(1, LONGEST + 1):
            if k > 1:
                by_number = np.empty(len(self.runs[k].keys), dtype=np.uint64)
                by_number[self.runs[k].numbers] = self.runs[k].keys
                last = (by_number & np.uint64(0xFFFFFFFF)).astype(np.int64)
                rest = (by_number >> np.uint64(32)).astype(np.int64)
                texts = [texts[a] + b" " + words[b] for a, b in zip(rest.tolist(), last.tolist(), strict=True)]
                lang = self.lang[last]
            for i in range(0, len(self.n[k]), 100_000):
                part = np.flatnonzero(self.n[k][i:i + 100_000]) + i
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[y] for y in lang[part].tolist()], pa.string()), pa.array(np.full(len(part), k, np.int32)),
                     pa.array([texts[j] for j in part.tolist()], pa.binary()).cast(pa.string()), pa.array(self.n[k][part]),
                     pa.array(self.doc[k][part], mask=self.null[k][part]), pa.array(self.at[k][part])], names=FOUND_NAMES)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, bits: int = BITS,
                  id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``n``, ``doc_id``, ``at``: all phrases of 1 to ``longest`` words that occur
    ``min_count`` times or more, and as ``k`` = 0 the number of all words."""
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"longest must be 1 to {LONGEST}")
    spark = docs.sparkSession
    tables: list[bytes] = []
    for k in range(1, longest + 1):
        tables.append(frequent_bits(docs, k, tables, min_count, bits, lang, text))
    sent = spark.sparkContext.broadcast(tables)

    def write_out(batches):
        known = [np.frombuffer(t, dtype=np.uint8) for t in sent.value]
        written, total = Written(), {}
        langs: dict[str, int] = {}
        for b in batches:
            keys, names = _lang_keys(b.column(0))
            lang = np.array([langs.setdefault(x, len(langs)) for x in names], dtype=np.int64)
            nulls = b.column(2).is_null().to_numpy(zero_copy_only=False)
            ids = b.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            for block in _blocks(b.column(1)):
                for y, n in zip(*np.unique(lang[block.doc[block.lead:]], return_counts=True), strict=True):
                    total[y] = total.get(y, 0) + int(n)
                # runs of the words before the block are needed for those that go on into it
                runs = [(k, at, at + k > block.lead) for k, at in _chosen(block, keys, known, bits, longest) if len(at)]
                if runs:
                    written.add(block, runs, lang[block.doc], block.runs(1, keys), ids, nulls)
                if written.total() > PHRASES:
                    yield from written.rows(list(langs))
                    written = Written()
        yield from written.rows(list(langs))
        if total:
            names = list(langs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[y] for y in total], pa.string()), pa.array([0] * len(total), pa.int32()),
                 pa.array([""] * len(total), pa.string()), pa.array(list(total.values()), pa.int64()),
                 pa.array([None] * len(total), pa.int64()), pa.array([None] * len(total), pa.int64())], names=FOUND_NAMES)

    read = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"),
                       F.col(id_col).cast("bigint").alias("doc_id"))
    # Each task writes every frequent phrase that it meets once, so fewer and longer tasks write fewer rows; what a
    # task holds is bounded all the same.
    read = read.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    pointer = F.min(F.struct("doc_id", "at"))
    return (read.mapInArrow(write_out, FOUND).groupBy("lang", "k", "phrase")
            .agg(F.sum("n").alias("n"), pointer.alias("p")).where((F.col("n") >= min_count) | (F.col("k") == 0))
            .select("lang", "k", "phrase", "n", "p.doc_id", "p.at"))


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scores(counts: DataFrame) -> DataFrame:
    """Phrases of two words or more of ``phrase_counts`` with the lowest-scoring cut: ``lang``, ``k``, ``phrase``,
    ``a``, ``l``, ``r``, ``n``, ``score``."""
    total = counts.where("k = 0").select(F.col("lang").alias("total_lang"), F.col("n").alias("n"))
    known = counts.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    cand = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), "doc_id", "at",
                                        F.split("phrase", " ").alias("w"))
    cuts = cand.select("lang", "k", "phrase", "a", "doc_id", "at", "w",
                       F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "k", "phrase", "a", "doc_id", "at", "cut", _part(F.lit(1), F.col("cut")).alias("left"),
                       _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    if total.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS:
        total = F.broadcast(total)
    cuts = cuts.join(total, F.col("lang") == F.col("total_lang"))
    # products of 38 digits at most: decimals hold them exactly
    wide = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    up = (F.lit(1000).cast("decimal(4,0)") * wide("a", 15)) * wide("n", 17)
    score = F.call_function("div", up, wide("l", 18) * wide("r", 18))
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r", "n")).alias("b")
    return (cuts.groupBy("lang", "k", "phrase", "a", "doc_id", "at").agg(best)
            .select("lang", "k", "phrase", "a", "b.l", "b.r", "b.n", "b.score", "doc_id", "at"))


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP,
                 bits: int = BITS, **columns) -> DataFrame:
    """The ``top`` phrases of each language by score, without those that a longer phrase explains."""
    from .common import materialise
    counts = materialise(phrase_counts(docs, longest, min_count, bits, **columns), "phrase-counts")
    scored = scores(counts)
    # all shorter runs of a longer phrase that may be candidates, with the count of the longer one
    longer = counts.where("k > 2").select("lang", F.col("n").alias("f"), "k", F.split("phrase", " ").alias("w"))
    size = F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")
    longer = longer.select("lang", "f", "k", "w", size)
    longer = longer.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("i"))
    inside = (longer.select("lang", _part(F.col("i"), F.col("size")).alias("phrase"), "f")
              .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.col("f").isNull() | (F.col("f") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score",
                    "doc_id", "at"))


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("doc_id", "at")


OP12_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS f FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) o(k) WHERE len(w) >= k)
      GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.k, x.phrase, a, cut, l.f AS l, r.f AS r, t.n, (1000 * a * t.n) // (l.f * r.f) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[1:cut], ' ')
      JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
g AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (
        SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, {LONGEST}) o(m) WHERE m < k)),
z AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = b.lang AND g.phrase = b.phrase AND g.a >= b.a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
       score::BIGINT AS score FROM q WHERE rank <= {TOP}"""
