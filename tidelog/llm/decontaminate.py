"""Benchmark decontamination by latent semantic retrieval.

1. Terms: every word counts, the words of the items each by itself, all others of the corpus
   by hash in ``BUCKETS`` terms.  One pass over all documents counts in how many documents
   each occurs (an item's word in a run of ``RUN`` words that an item holds too is not counted,
   or an item that many documents repeat would lose its weight; tasks sum before the shuffle).
2. Latent space: a randomised singular value decomposition of the TF-IDF matrix whose rows
   are all passages of all documents and the items' passages.  Its rank is half the number of
   items' passages and ``RANK`` at most, so words that occur together share directions, words
   that no item holds among them.  The range finder begins with the items' own directions.  A
   second pass multiplies them by the passages' Gram matrix, a matrix of terms by rank that
   tasks sum before the shuffle; by that product (Nystroem's form of the Gram matrix, exact on
   the directions it was taken of) every step weighs all passages without reading them again.
3. Search: a third pass finds every exact occurrence of an item's words, whatever they
   weigh (by hashes of ``GRAM`` words, then word by word), and projects every passage
   (overlapping windows of words) of every document.  A passage is a candidate for an item if
   in the latent space their cosine reaches ``COSINE`` and the passage covers ``COVER`` of the
   item's length along it.
4. Check: the words around a candidate must hold ``LCS`` of the item's weight as a longest
   common subsequence, of the whole item or, where sentences change places, of its sentences
   one by one (those that are held by half at least); and ``ANSWER`` of the weight of the item's
   answer, its last ``ANSWER_WORDS`` weighty words.  Texts whose words, in any order, cannot
   reach ``LCS`` are left before that, exactly.

Items go in blocks of ``BLOCK_WINDOWS`` passages, which bounds what is broadcast and costs three
passes each; usual benchmarks are one block.  Every term has a positive weight, however many
documents hold it, and every item is searched for.

Defined results: null or empty texts and items match nothing, so do empty tables; repeated
rows each get their links; a link appears once for a row and item, with the best of its
passages, the first of equal ones; an exact occurrence has cosine, lcs and answer 1; a text of
any length is searched whole; extra columns are ignored, whatever their names; an item of
fewer than ``GRAM`` words that are all common (``COMMON``) matches exactly or not at all, as its
words in order, with others between, say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ids_and_texts, read_table, release, small_batches, texts_of, written
from .textvec import _MULT, slices, word_hashes

STEP, WINDOW = 32, 64  # words
BUCKETS_BITS = 13
BUCKETS = 1 << BUCKETS_BITS
#: Items' passages searched at once, the most directions kept, and steps of the range finder
#: over items and documents, and before over the items alone.
BLOCK_WINDOWS, RANK, POWER_STEPS, ITEM_STEPS = 8192, 128, 2, 6
#: Weight of all passages of the documents together, as a share of the items'.
SAMPLE_SHARE = 1 / 2
COSINE, COVER, LCS, ANSWER, ANSWER_WORDS = 0.55, 0.25, 0.5, 0.35, 8
#: Terms in more than this share of all documents are common: an answer is looked for by others.
COMMON = 0.2
#: Words whose hash an exact search begins with; words in order that a copy is known by.
GRAM, RUN = 8, 3
_BITS = 22


class Terms:
    """Numbers of known words; -1 for all others."""

    def __init__(self, words: np.ndarray):
        self.words = np.unique(words)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.words & np.uint64((1 << _BITS) - 1)] = True

    def __len__(self) -> int:
        return len(self.words)

    def of(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), -1, dtype=np.int32)
        maybe = np.flatnonzero(self.seen[words & np.uint64((1 << _BITS) - 1)])
        if len(maybe) and len(self.words):
            w = words[maybe]
            i = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            hit = self.words[i] == w
            out[maybe[hit]] = i[hit]
        return out


def _windows(n: int) -> list[tuple[int, int]]:
    """An item's passages: windows of WINDOW words, the last one ending with the item."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STEP)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def _sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?:])\s+|\n+", text) if s.strip()]


def _by_term(t: np.ndarray, width: int) -> np.ndarray:
    """The stable order of term numbers; those of 16 bits are sorted in linear time."""
    return np.argsort(t.astype(np.uint16) if width <= 1 << 16 else t, kind="stable")


def _counts(docs: DataFrame, index: Index) -> DataFrame:
    """Rows (term, n): documents that hold the term, by task; and the passages as term -1."""
    sent = docs.sparkSession.sparkContext.broadcast(index)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        total = np.zeros(x.width, dtype=np.int64)
        passages = 0
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                words, at = word_hashes(texts[a:b])
                pos = np.flatnonzero(~_copied(words, at, x.runs))
                t = x.numbers_of(words)[pos]
                owner = np.searchsorted(at, pos, side="right") - 1
                order = _by_term(t, x.width)
                t, owner = t[order], owner[order]
                new = (np.diff(t, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)
                total += np.bincount(t[new], minlength=x.width)
                passages += int((-(-np.diff(at) // STEP)).sum())
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([*some.tolist(), -1], pa.int32()), pa.array([*total[some].tolist(), passages], pa.int64())], names=["term", "n"])

    return ids_and_texts(docs).mapInArrow(run, "term int, n long")


def _laid(t: np.ndarray, at: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grid, start, owner): terms in blocks of STEP words of one text, short ones filled up with
    ``blank``; each block's first word and its text.  A passage is a block and the next one of
    its text."""
    counts = np.diff(at)
    blocks = -(-counts // STEP)
    to = np.concatenate([[0], np.cumsum(blocks)])
    start = np.repeat(at[:-1] - to[:-1] * STEP, blocks) + np.arange(to[-1]) * STEP
    grid = np.full(to[-1] * STEP, blank, dtype=np.intp)
    grid[np.repeat(to[:-1] * STEP - at[:-1], counts) + np.arange(len(t))] = t
    return grid.reshape(-1, STEP), start, np.repeat(np.arange(len(counts)), blocks)


def _block_sums(grid: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The sum of each block's vectors; the last vector is the blank's, zero."""
    out = np.empty((len(grid), vectors.shape[1]), dtype=np.float32)
    ones, room = np.ones((1, STEP), dtype=np.float32), np.empty((64 * STEP, vectors.shape[1]), dtype=np.float32)
    for a in range(0, len(grid), 64):
        some = grid[a : a + 64]
        own = np.take(vectors, some.ravel(), axis=0, out=room[: some.size], mode="clip")
        np.matmul(ones, own.reshape(*some.shape, -1), out=out[a : a + 64, None])
    return out


def _add_by_term(term: np.ndarray, place: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds rows[place] to out[term], for sorted terms: those of many places as a matrix product,
    all others by their first place, their second and so on."""
    count = np.bincount(term, minlength=len(out))
    begin = np.cumsum(count) - count
    own = np.flatnonzero(count)
    own = own[np.argsort(-count[own], kind="stable")]
    many = int(np.searchsorted(-count[own], -24, side="left"))
    if many:
        number = np.full(len(out), -1)
        number[own[:many]] = np.arange(many)
        hit = np.flatnonzero(number[term] >= 0)
        held = np.bincount(number[term[hit]] * len(rows) + place[hit], minlength=many * len(rows))
        out[own[:many]] += held.reshape(many, -1).astype(np.float32) @ rows
    own = own[many:]
    if len(own):
        total = rows[place[begin[own]]]
        for j in range(1, int(count[own[0]])):
            some = own[: int(np.searchsorted(-count[own], -j, side="left"))]
            total[: len(some)] += rows[place[begin[some] + j]]
        out[own] += total


def add_products(t: np.ndarray, at: np.ndarray, weight: np.ndarray, vectors: np.ndarray, out: np.ndarray) -> None:
    """Adds what, times the terms' weights, is A' A m for the matrix A of the unit TF-IDF rows of
    all passages of some texts; vectors holds m times the weights, and a row of zeros."""
    grid, start, owner = _laid(t, at, len(weight))
    n = len(grid)
    if not n:
        return
    more = np.append(owner[1:] == owner[:-1], False)  # a block of the same text follows
    size = np.diff(np.append(start, len(t)))
    own, cross = np.zeros(n), np.zeros(n)
    parts = []
    for a in range(0, n, 2048):  # so that a long text takes time in proportion to it
        b = min(a + 2048, n)
        end = min(b + 1, n)  # the last passage needs one block more
        term = t[start[a] : start[end - 1] + size[end - 1]]
        order = _by_term(term, len(weight))
        term, place = term[order], np.repeat(np.arange(end - a), size[a:end])[order]
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0))
        u, p = term[new], place[new]
        v = np.diff(np.append(new, len(term))) * weight[u]
        own[a:end] = np.bincount(p, weights=v * v, minlength=end - a)
        k = np.flatnonzero((u[1:] == u[:-1]) & (p[1:] == p[:-1] + 1))
        cross[a:b] = np.bincount(p[k], weights=v[k] * v[k + 1], minlength=b - a)
        mine = place < b - a
        parts.append((a, b, term[mine], place[mine]))
    squares = own + np.where(more, np.append(own[1:], 0.0) + 2 * cross, 0.0)
    sums = _block_sums(grid, vectors)
    next_of = np.flatnonzero(more) + 1
    passage = sums.copy()
    passage[next_of - 1] += sums[next_of]
    passage /= np.maximum(squares, 1e-24).astype(np.float32)[:, None]
    rows = passage.copy()  # what each block's words get: of its passage and of the one before
    rows[next_of] += passage[next_of - 1]
    for a, b, term, place in parts:
        _add_by_term(term, place, rows[a:b], out)


def _unit_rows(rows: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value, size) of unit TF-IDF rows of term numbers; size is each one's length
    before."""
    at = np.cumsum([0] + [len(r) for r in rows])
    pair, n = np.unique(np.repeat(np.arange(len(rows)), np.diff(at)) * len(weight) + (np.concatenate(rows) if rows else np.zeros(0, np.int64)), return_counts=True)
    row, term = pair // len(weight), pair % len(weight)
    value = n * weight[term]
    size = np.sqrt(np.bincount(row, weights=value * value, minlength=len(rows)))
    return row, term, (value / np.maximum(size[row], 1e-12)).astype(np.float32), size


def _times(row: np.ndarray, term: np.ndarray, value: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """The sparse matrix (row, term, value) of n rows, sorted by row, times m."""
    out = np.zeros((n, m.shape[1]), dtype=np.float32)
    for a in range(0, len(row), 1 << 13):
        r = row[a : a + (1 << 13)]
        begin = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[begin]] += np.add.reduceat(m[term[a : a + (1 << 13)]] * value[a : a + (1 << 13), None], begin, axis=0)
    return out


def _normal(rows: tuple, m: np.ndarray, n: int) -> np.ndarray:
    """A' A m for the matrix A of n sparse rows."""
    row, term, value = rows[:3]
    left = _times(row, term, value, m, n)
    order = np.argsort(term, kind="stable")
    return _times(term[order], row[order], value[order], left, len(m))


def _sketch(docs: DataFrame, index: Index, right: np.ndarray, passages: int) -> np.ndarray:
    """A' A right for the matrix A of the unit TF-IDF rows of all passages of all documents.
    Tasks are as many as write a quarter of the texts' size at most, or two a core; their
    sums are added in one order, whichever comes first."""
    spark, rank, piece = docs.sparkSession, right.shape[1], 128
    vectors = np.vstack([index.idf[:, None] * right, np.zeros((1, rank))]).astype(np.float32)
    sent = spark.sparkContext.broadcast((index, vectors))
    tasks = max(2 * spark.sparkContext.defaultParallelism, passages * STEP * 6 // (4 * 4 * right.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, m = sent.value
        out = np.zeros((x.width, rank), dtype=np.float32)
        for batch in batches:
            texts = texts_of(batch)
            for a, b in slices(texts):
                words, at = word_hashes(texts[a:b])
                add_products(x.numbers_of(words), at, x.idf, m, out)
        own = TaskContext.get().partitionId()
        for a in range(0, x.width, piece):
            some = out[a : a + piece]
            if some.any():
                some = (some * x.idf[a : a + piece, None]).astype(np.float32)
                yield pa.record_batch([pa.array([a], pa.int32()), pa.array([own], pa.int32()), pa.array([some.tobytes()], pa.binary())], names=["first", "task", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                m = np.frombuffer(raw.as_buffer(), dtype=np.float32).astype(np.float64)
                total[first] = total[first] + m if first in total else m
        for first, m in total.items():
            yield pa.record_batch([pa.array([first], pa.int32()), pa.array([m.astype(np.float32).tobytes()], pa.binary())], names=["first", "m"])

    parts = ids_and_texts(docs).coalesce(tasks).mapInArrow(run, "first int, task int, m binary")
    sums = parts.repartition("first").sortWithinPartitions("first", "task").mapInArrow(add, "first int, m binary")
    out = np.zeros(right.shape, dtype=np.float32)
    for r in sums.toLocalIterator():  # a matrix of terms by rank
        m = np.frombuffer(r["m"], dtype=np.float32).reshape(-1, rank)
        out[r["first"] : r["first"] + len(m)] = m
    sent.destroy()
    return out


def latent_space(docs: DataFrame, index: Index, items: tuple, passages: int, rank: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (term, rank) of the items' rows on top of those of all the documents'
    passages, which weigh ``SAMPLE_SHARE`` of the items' together."""
    n = len(index.windows)
    right = np.linalg.qr(np.random.default_rng(seed).normal(size=(index.width, rank)))[0].astype(np.float32)
    for _ in range(ITEM_STEPS):  # the shift keeps directions beyond the items' number apart
        right = np.linalg.qr(_normal(items, right, n) + np.float32(0.01) * right)[0].astype(np.float32)
    far = _sketch(docs, index, right, passages) if passages else np.zeros_like(right)
    core = right.T.astype(np.float64) @ far
    core = np.linalg.pinv((core + core.T) / 2, rcond=1e-6, hermitian=True)
    share = SAMPLE_SHARE * n / max(1, passages)
    for _ in range(POWER_STEPS):
        step = far @ (share * (core @ (far.T @ right))).astype(np.float32)
        right = np.linalg.qr(step + _normal(items, right, n))[0].astype(np.float32)
    return right


class Index:
    """What a worker needs to search for one block of items."""

    def __init__(self, items: list[tuple[int, str]], terms: Terms, words: np.ndarray, at: np.ndarray):
        self.terms, self.ids, self.words, self.at = terms, np.array([i for i, _ in items], dtype=np.int64), words, at
        self.width = len(terms) + BUCKETS
        self.numbers = terms.of(words)
        self.windows = [(i, a, b) for i in range(len(items)) for a, b in _windows(int(at[i + 1] - at[i])) if b]
        self.runs = Terms(np.concatenate([_gram_hashes(words[a:b], RUN) for a, b in zip(at, at[1:], strict=False)]))
        # each item's sentences, as ranges of its words
        self.sentences = []
        for _, text in items:
            cut = np.cumsum([0] + np.diff(word_hashes(_sentences(text))[1]).tolist()).tolist()
            self.sentences.append([(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a])
        # by number of words: hashes of items' first words, and the items of each
        self.grams: dict[int, tuple[Terms, list[list[int]]]] = {}
        sizes = np.minimum(np.diff(at), GRAM)
        for m in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == m)
            h = np.concatenate([_gram_hashes(words[at[i] : at[i] + m], m) for i in own])
            heads = Terms(h)
            holders: list[list[int]] = [[] for _ in range(len(heads))]
            for i, k in zip(own.tolist(), heads.of(h).tolist(), strict=True):
                holders[k].append(i)
            self.grams[m] = heads, holders

    def numbers_of(self, words: np.ndarray) -> np.ndarray:
        """A term for every word: the items' words, then buckets of all others."""
        t = self.terms.of(words).astype(np.int64)
        return np.where(t >= 0, t, len(self.terms) + (words >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64))

    def weigh(self, idf: np.ndarray) -> tuple:
        """Sets term weights; returns the windows' unit TF-IDF rows."""
        self.idf = idf + 1e-6
        weighty = idf[: len(self.terms)] > np.log(1 / COMMON)
        spans = list(zip(self.at.tolist(), self.at[1:].tolist(), strict=False))
        self.loose = np.array([b - a >= GRAM or bool(weighty[self.numbers[a:b]].any()) for a, b in spans])
        rows = _unit_rows([self.numbers[self.at[i] + a : self.at[i] + b].astype(np.int64) for i, a, b in self.windows], self.idf)
        self.size = rows[3]
        # the answer: the last ANSWER_WORDS weighty words; without any, the last words
        self.answers = []
        for a, b in spans:
            own = self.numbers[a:b][::-1]
            some = own[weighty[own]] if weighty[own].any() else own
            self.answers.append(np.array(list(dict.fromkeys(some.tolist()))[:ANSWER_WORDS], dtype=np.int64))
        return rows

    def project(self, rows: tuple, space: np.ndarray) -> None:
        self.vectors = np.vstack([self.idf[:, None] * space, np.zeros((1, space.shape[1]))]).astype(np.float32)  # of a term, once; then of none
        q = _times(*rows[:3], space, len(self.windows))
        norm = np.sqrt((q**2).sum(axis=1))
        self.q = (q / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)
        # coverage: 1 for a passage with the window's own terms
        keep = self.loose[[i for i, _, _ in self.windows]] & (norm > 0)
        self.cover = np.where(keep, 1 / np.maximum(self.size * norm, 1e-12), 0.0).astype(np.float32)


def _gram_hashes(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m words from each on."""
    n = max(0, len(words) - m + 1)
    h = words[:n].copy()
    for j in range(1, m):
        h = h * _MULT + words[j : n + j]
    return h


def occurrences(words: np.ndarray, at: np.ndarray, x: Index) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(item, texts, places) of every exact occurrence of an item."""
    out = []
    for m, (heads, holders) in x.grams.items():
        k = heads.of(_gram_hashes(words, m))
        hits = np.flatnonzero(k >= 0)
        for g in np.unique(k[hits]).tolist():
            begin = hits[k[hits] == g]
            text = np.searchsorted(at, begin, side="right") - 1
            for i in holders[g]:
                item = x.words[x.at[i] : x.at[i + 1]]
                same = begin + len(item) <= at[text + 1]
                place, owner = begin[same], text[same]
                for j, w in enumerate(item):
                    same = words[place + j] == w
                    if not same.all():
                        place, owner = place[same], owner[same]
                if len(place):
                    out.append((i, owner, place))
    return out


def _copied(words: np.ndarray, at: np.ndarray, runs: Terms) -> np.ndarray:
    """Which words lie in a run of RUN words that an item holds too."""
    out = np.zeros(len(words), dtype=bool)
    place = np.flatnonzero(runs.of(_gram_hashes(words, RUN)) >= 0)
    place = place[place + RUN <= at[np.searchsorted(at, place, side="right")]]
    for j in range(RUN):
        out[place + j] = True
    return out


def _lcs(item: np.ndarray, weight: np.ndarray, text: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two word sequences."""
    best = np.zeros(len(item) + 1)
    for w in text:
        hit = item == w
        if hit.any():
            best[1:] = np.maximum(best[1:], np.where(hit, best[:-1] + weight, 0.0))
            np.maximum.accumulate(best, out=best)
    return float(best[-1])


def _held(i: int, region: np.ndarray, x: Index) -> float:
    """Share of item i's weight that a common subsequence of the region holds: of the whole
    item, or of its sentences one by one."""
    item, weight = x.words[x.at[i] : x.at[i + 1]], x.idf[x.numbers[x.at[i] : x.at[i + 1]]]
    there = np.isin(item, region)
    if weight[there].sum() < LCS * weight.sum():  # in no order
        return 0.0
    region = region[np.isin(region, item)]
    best = _lcs(item, weight, region)
    if best < weight.sum() and len(x.sentences[i]) > 1:
        parts = [(_lcs(item[a:b], weight[a:b], region), weight[a:b].sum()) for a, b in x.sentences[i]]
        best = max(best, sum(got for got, full in parts if got >= full / 2))
    return best / weight.sum()


def search(texts: list[str | None], x: Index) -> list[tuple[int, int, float, float, float, int, int]]:
    """(text, item, cosine, lcs, answer, first word, last word + 1) of every confirmed link."""
    words, at = word_hashes(texts)
    t = x.numbers_of(words)
    grid, start, owner = _laid(t, at, x.width)
    if not len(grid):
        return []
    stop = np.minimum(start + WINDOW, at[1:][owner])
    exact: dict[tuple[int, int], int] = {}  # the first place of each
    for i, text, place in occurrences(words, at, x):
        for d, first in zip(*np.unique(text, return_index=True), strict=True):
            exact[int(d), i] = int(place[first] - at[d])
    z = _block_sums(grid, x.vectors)
    more = np.flatnonzero(owner[:-1] == owner[1:])
    passage = z.copy()  # a passage is a block and the next one of its text
    passage[more] += z[more + 1]
    out: dict[tuple[int, int], list] = {}
    for a in range(0, len(grid), 512):
        some = passage[a : a + 512]
        s = some @ x.q.T
        cosine = s / np.maximum(np.sqrt((some**2).sum(axis=1)), 1e-12)[:, None]
        for r, k in np.argwhere((cosine >= COSINE) & (s * x.cover >= COVER)):
            key = (int(owner[a + r]), x.windows[k][0])
            if key not in exact:
                out.setdefault(key, []).append((float(cosine[r, k]), int(start[a + r]), int(stop[a + r])))
    found = [(d, i, 1.0, 1.0, 1.0, a, a + int(x.at[i + 1] - x.at[i])) for (d, i), a in exact.items()]
    marked = np.zeros(x.width, dtype=bool)
    for (d, i), spots in out.items():
        n = int(x.at[i + 1] - x.at[i])
        own = x.numbers[x.at[i] : x.at[i + 1]]
        weight = x.idf[own]
        least = LCS * weight.sum()
        best: tuple | None = None
        done = -1
        for cosine, a, b in sorted(spots, key=lambda c: c[1]):
            if a < done:  # the region of the spot before held this passage
                continue
            lo, hi = max(int(at[d]), a - n), min(int(at[d + 1]), b + n)
            marked[t[lo:hi]] = True
            most = weight[marked[own]].sum()
            marked[t[lo:hi]] = False
            if most < least:  # in no order, as _held finds more slowly
                continue
            region = words[lo:hi]
            share = _held(i, region, x)
            if share >= LCS:
                want = x.answers[i]
                there = np.isin(want, x.terms.of(region))
                answer = float(x.idf[want][there].sum() / x.idf[want].sum())
                if answer >= ANSWER and (best is None or share > best[3]):
                    best = (d, i, cosine, share, answer, lo - int(at[d]), hi - int(at[d]))
            done = hi - STEP if share >= LCS else done
        if best:
            found.append(best)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word, end_word), one row for each row of
    docs and item that it repeats."""
    return _links(ids_and_texts(docs), benchmark)


def _links(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same for docs of (doc_id, text, ...); further columns are carried along."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    schema = ", ".join(["doc_id long, item_id long, cosine double, lcs double, answer double, first_word long, end_word long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema[2:])])
    out = None
    size = docs.count()
    block: list[tuple[int, str]] = []
    room = BLOCK_WINDOWS
    for r in [*items.orderBy("item_id", "text").toLocalIterator(), None]:  # a block at a time on the driver
        need = len(_windows(len(word_hashes([r["text"]])[0]))) if r else 0
        if block and (r is None or need > room):
            found = _block(docs, block, size, schema)
            if found is not None:
                out = found if out is None else out.unionByName(found)
            block, room = [], BLOCK_WINDOWS
        if r:
            block.append((r["item_id"], r["text"]))
            room -= need
    return out if out is not None else spark.createDataFrame([], schema)


def _block(docs: DataFrame, block: list[tuple[int, str]], size: int, schema: str) -> DataFrame | None:
    words, at = word_hashes([t for _, t in block])
    if not len(words):
        return None
    index = Index(block, Terms(words), words, at)
    df, passages = np.zeros(index.width), 0
    for r in _counts(docs, index).groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():  # a row for each term of the block
        if r["term"] < 0:
            passages = r["n"]
        else:
            df[r["term"]] = r["n"]
    rows = index.weigh(np.log((size + 1) / (df + 1)))
    rank = int(min(RANK, max(8, len(index.windows) // 2), index.width))
    index.project(rows, latent_space(docs, index, rows, passages, rank))
    sent = docs.sparkSession.sparkContext.broadcast(index)
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        for batch in batches:
            texts, found = texts_of(batch), []
            for a, b in slices(texts):
                found += [(d + a, *rest) for d, *rest in search(texts[a:b], x)]
            if found:
                d, i, *rest = zip(*found, strict=True)
                more = [c.take(pa.array(d)) for c in batch.columns[2:]]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(d)), pa.array(x.ids[list(i)]), *(pa.array(c) for c in rest), *more],
                    names=["doc_id", "item_id", "cosine", "lcs", "answer", "first_word", "end_word", *batch.schema.names[2:]],
                )

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that repeat an item; of rows that share an id, null or not, only
    those whose own text does."""
    name, mark = fresh(docs, "_id", "_text")
    digest = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    found = _links(rows, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name), F.col("digest").alias(mark)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (digest == F.col(mark))
    return docs.join(written(found, "leaks"), same, "left_anti")
