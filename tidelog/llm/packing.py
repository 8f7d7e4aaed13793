"""Best-fit packing with large-item matching, planned on the histogram of lengths.

Every piece of at most ``CAPACITY`` tokens has an integer length, so a plan needs only how
many pieces have each length: at most ``CAPACITY`` numbers, whatever the corpus holds.
Pieces above a third of the capacity go at most two to a bin; a greedy matching pairs
each, largest first, with the largest that still fits.  Smaller pieces then go, largest
first, into the fullest bin that still takes them (best fit); only if none does, a bin
is opened.  Bins with equal contents are handled as one run, so the plan is a list of
placements "the r-th to r'-th piece of length n lie in bins b to b' at offset o".

Pieces then look up their place by length and rank.  Ranks come from counts by (partition,
length), so no piece is sorted or gathered, and no driver or task holds more than the
histogram, the plan and its own batch.

Texts are tokenised once with the public byte-level vocabulary; 0 ends each document.
The ids are those of the ``tokenizers`` file (``TOKENIZER``); the ``tiktoken`` file of the same
vocabulary gives them about five times faster.  Before any text is read, the driver compares
the two over strings that part tokenisers (``HARD``) and stops if one differs; tests compare
them over whole tables.  The former's one added token, ``END``, is a token wherever a text
holds it.

Defined results: null text counts as empty (one piece, the closing 0 alone); repeated rows,
null ids among them, are packed each; pieces of equal length take places in the order of
their partitions; only texts longer than the capacity are cut, however long; extra columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ids_and_texts, map_batches, read_table, small_batches, texts_of, written

CAPACITY = 2048
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Strings that tokenisers of one vocabulary tend to split differently.
HARD = (
    "", " ", "  \n\n \t x", "<|endoftext|>", "a<|endoftext|> b", "<|endoftext|", "don't I'LL we've", "3.14159 1,000,000", "naïve café ÅÄÖ", "\u00a0\u2003 wide\u3000", "\U0001f600\U0001f468\u200d\U0001f469",
    "\u4f60\u597d\u4e16\u754c", "\u0645\u0631\u062d\u0628\u0627", "x" * 300, "=" * 77, "\r\n\r\n", "snake_case camelCase", "\x00\x01\x7f", "e\u0301 \ufb01 \ufeff", "trailing   ", "12345678901234567890",
)
END, END_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: END_ID})


@lru_cache(maxsize=1)
def check_ids() -> None:
    """Compares the ids with those of the tokenizer's own file; an error if any differ."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    for text in HARD:
        if token_ids(text)[:-1].tolist() != own.encode(text, add_special_tokens=False).ids:
            raise RuntimeError(f"{VOCABULARY} and {TOKENIZER} give other ids for {text!r}")


def token_ids(text: str | None, path: str = "") -> np.ndarray:
    """The text's ids and a closing 0, as little-endian 32-bit numbers."""
    e = _encoder(path)
    ids = e.encode(text or "", allowed_special={END}, disallowed_special=())
    out = np.zeros(len(ids) + 1, dtype="<u4")
    out[:-1] = ids
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter than the rest."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def _pieces_of(capacity: int, path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        rows: list[tuple] = []
        for i, t in zip(ids, texts_of(batch), strict=True):
            tokens = token_ids(t, path)
            for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                rows.append((i, k, s, n, zlib.crc32(tokens[s : s + n])))
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


_PIECES = T.StructType([T.StructField(c, T.IntegerType() if c == "piece" else T.LongType()) for c in ("doc_id", "piece", "start", "length", "ids_crc32")])


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = "") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    return map_batches(ids_and_texts(docs), _pieces_of(capacity, path), _PIECES)


def _ranked(batches: Iterator[pa.RecordBatch], capacity: int, part_name: str, rank_name: str) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and, by length, the rank of each row in the task."""
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    for batch in batches:
        own = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
        order = np.argsort(own, kind="stable")
        rank = np.zeros(len(own), dtype=np.int64)
        rank[order] = np.arange(len(own)) - np.searchsorted(own[order], own[order]) + seen[own[order]]
        seen += np.bincount(own, minlength=capacity + 1)
        yield batch.append_column(part_name, pa.array(np.full(len(own), part, dtype=np.int64))).append_column(rank_name, pa.array(rank))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = "") -> DataFrame:
    """The pieces of all rows with their places; tokens and ranks come from one pass."""
    small_batches(docs.sparkSession)
    cut_up = _pieces_of(capacity, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _ranked((cut_up(b) for b in batches if b.num_rows), capacity, "_part", "_rank")

    kinds = T.StructType([*_PIECES.fields, T.StructField("_part", T.LongType()), T.StructField("_rank", T.LongType())])
    return _placed(written(ids_and_texts(docs).mapInArrow(run, kinds), "pieces"), _PIECES.names, "_part", "_rank", capacity)


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """counts[n]: how many pieces have length n.  Placements (length, first rank, ranks,
    first bin, pieces of this length in each bin, offset), by length and first rank."""
    left = counts.astype(np.int64).copy()
    taken = np.zeros(capacity + 1, dtype=np.int64)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (first, how many)
    bins = 0

    def place(n: int, bin_: int, many: int, each: int, offset: int) -> None:
        out.append((n, int(taken[n]), many * each, bin_, each, offset))
        taken[n] += many * each
        left[n] -= many * each

    def leave(gap: int, bin_: int, many: int) -> None:
        if gap and many:
            gaps.setdefault(gap, []).append((bin_, many))

    third = capacity // 3
    big = [n for n in range(capacity, third, -1) if left[n]]
    for n in big:
        while left[n]:
            fits = next((m for m in range(min(n, capacity - n), third, -1) if left[m] - (m == n)), 0)
            many = int(left[n]) if not fits else int(left[n] // 2) if fits == n else int(min(left[n], left[fits]))
            place(n, bins, many, 1, 0)
            if fits:
                place(fits, bins, many, 1, n)
            leave(capacity - n - fits, bins, many)
            bins += many
    for n in range(third, 0, -1):
        while left[n]:
            gap = min((g for g in gaps if g >= n), default=0)
            if gap:
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                gap, first, many = capacity, bins, int(-(-left[n] // (capacity // n)))
                bins += many
            each = gap // n
            full = int(min(many, left[n] // each))
            if full:
                place(n, first, full, each, capacity - gap)
                leave(gap - each * n, first, full)
            if full < many:
                rest = int(min(each - 1, left[n]))
                if rest:
                    place(n, first + full, 1, rest, capacity - gap)
                    leave(gap - rest * n, first + full, 1)
                    full += 1
                leave(gap, first + full, many - full)
    table = np.array(out, dtype=np.int64).reshape(-1, 6)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with a ``length`` column (1 to capacity)."""
    names = [c for c in found.columns if c.lower() not in ("sequence_id", "offset")]  # given anew
    found = found.select(*names)
    part, rank = fresh(found, "_part", "_rank")
    kinds = T.StructType([*found.schema.fields, T.StructField(part, T.LongType()), T.StructField(rank, T.LongType())])
    ranked = found.mapInArrow(lambda batches: _ranked(batches, capacity, part, rank), kinds)
    return _placed(written(ranked, "pieces"), names, part, rank, capacity)


def _placed(placed: DataFrame, names: list[str], part: str, rank: str, capacity: int) -> DataFrame:
    """Looks up the places of written rows by length and rank."""
    (before,) = fresh(placed, "_before")
    by = placed.groupBy(part, "length").agg(F.count("*").alias(before))
    tally = np.zeros(capacity + 1, dtype=np.int64)
    for row in by.groupBy("length").agg(F.sum(before).alias("n")).collect():  # capacity rows at most
        tally[row["length"]] = row["n"]
    sent = placed.sparkSession.sparkContext.broadcast(plan(tally, capacity))
    earlier = F.sum(before).over(W.partitionBy("length").orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    ranks = by.select(part, "length", F.coalesce(earlier, F.lit(0)).alias(before))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = sent.value
        length, first, place = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", before, rank))
        place = place + first
        hit = t[np.searchsorted(t[:, 0] << 44 | t[:, 1], length << 44 | place, side="right") - 1]
        inside = place - hit[:, 1]
        seq, off = hit[:, 3] + inside // hit[:, 4], hit[:, 5] + inside % hit[:, 4] * length
        return pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    kinds = T.StructType([*(placed.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return map_batches(placed.join(ranks, [part, "length"]), run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    check_ids()
    return pack_documents(read_table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row of docs with its place; null texts, null ids, repeated rows and
    empty tables as above."""
    check_ids()
    return pack_documents(docs)
