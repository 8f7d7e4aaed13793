"""N-gram Jaccard join: all pairs of texts whose word-shingle sets are 0.8 alike or more.

1. Texts with the same words are one class (a 128-bit hash of the word sequence; a text
   without words is in the class of the texts equal to it).  Everything after this works
   on one text of each class, so exact copies are never compared.
2. MinHash signatures of the shingle sets are cut into bands; ``choose_bands`` takes the
   band and row counts that reach the target recall at the threshold.  Texts that share
   a band's hash are linked to the least of them: candidates, in stars.
3. Components of the candidates get each member's full shingle set once, and every pair
   inside is verified exactly.  A large component is cut into blocks; each pair of blocks
   is a task's work, so no task holds more than two blocks and no pair is listed.
4. Result: one row per document with its class, its number of links (documents whose
   text is at least ``threshold`` alike, its own copies included) and its group, the
   component under exact links.

Keys that hold many rows (a text with many copies, a hub of candidates, a large component)
are joined by ``join_by_key``: their rows stay where they are.  Verifying a component of k
different texts costs k * k / 2 comparisons, spread over its pairs of blocks, and its sets
are sent once to each of its k / ``BLOCK_TEXTS`` blocks; exact copies cost nothing there.

Defined results: null text counts as empty; texts of fewer than ``size`` words have one
shingle of all their words; repeated rows are copies of each other; a null id stays null;
of equal candidates for a name the least id counts, nulls last; a long text has one set of
all its shingles; only doc_id and text are read, so other columns' names don't matter;
no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ids_and_texts, map_batches, read_table, texts_of, written
from .components import connected_components, hot_above, join_by_key
from .textvec import mix, shingles, word_hashes

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Shingles and texts that one block of a large component holds.
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 400
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, with which
    pairs at the threshold meet in some band with probability ``recall``."""
    for rows in range(8, 0, -1):
        for bands in range(1, most_hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    return most_hashes, 1


def class_keys(texts: list[str | None], words: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes that equal word sequences share."""
    out = []
    for i, t in enumerate(texts):
        if at[i + 1] > at[i]:
            h = hashlib.blake2b(words[at[i] : at[i + 1]].tobytes(), digest_size=16)
        else:
            h = hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16, key=b"no words")
        out.append(h.digest())
    return out


def band_hashes(sets: np.ndarray, at: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """(text, band) hashes of MinHash signatures; 0 for a text without shingles."""
    out = np.zeros((len(at) - 1, bands), dtype=np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    if not len(full):
        return out.view(np.int64)
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    starts = at[:-1][full]
    for b in range(bands):
        h = np.full(len(full), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            h = h * _A + np.minimum.reduceat((sets ^ plus[r]) * mult[r], starts)
        out[full, b] = mix(h)
    return out.view(np.int64)


def alike(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of ``sets``, the indexes of the texts of ``other`` (of the later texts
    of ``sets``, where None) whose Jaccard similarity is at least the threshold.

    What two texts share is counted over an inverted index.  Where texts are near copies of
    the first one, they are held as their differences from it (what they lack and what they
    add), which gives the same counts from far shorter lists."""
    both = sets if other is None else [*sets, *other]
    sizes = np.array([len(s) for s in both])
    ids, index = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    base, lack = 0, np.zeros(len(both), dtype=np.int64)
    pivot = index[: sizes[0]]
    of_pivot = np.zeros(len(ids), dtype=bool)
    of_pivot[pivot] = True
    kept = np.bincount(owner[of_pivot[index]], minlength=len(both))
    if 2 * int((sizes + len(pivot) - 2 * kept).sum()) < int(sizes.sum()):
        base, lack = len(pivot), len(pivot) - kept
        lists, at = [], np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(both)):
            mine = index[at[i] : at[i + 1]]
            had = of_pivot[mine]
            lists.append(np.concatenate([mine[~had], np.setdiff1d(pivot, mine[had], assume_unique=True)]))
        lengths = np.array([len(x) for x in lists])
        index, owner = np.concatenate(lists), np.repeat(np.arange(len(both)), lengths)
    else:
        lengths = sizes
    order = np.argsort(index, kind="stable")
    holders, begin = owner[order], np.searchsorted(index[order], np.arange(len(ids) + 1))
    at = np.concatenate([[0], np.cumsum(lengths)])
    low = 0 if other is None else len(sets)
    deg = np.diff(begin)
    for i in range(len(sets)):
        mine = index[at[i] : at[i + 1]]
        n = deg[mine]
        to = np.cumsum(n)
        where = np.repeat(begin[mine] - (to - n), n) + np.arange(to[-1] if len(to) else 0)
        common = np.bincount(holders[where], minlength=len(both)) + (base - lack[i] - lack)
        j = np.arange(i + 1 if other is None else low, len(both))
        share = common[j]
        found = j[share >= threshold * (sizes[i] + sizes[j] - share) - 1e-9]
        yield i, found - low


def _verified(groups: Iterator[tuple], threshold: float) -> Iterator[pa.RecordBatch]:
    """Counts and a spanning forest of the links in each block pair."""
    nodes, counts, parents = [], [], []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.int64()) for x in (nodes, counts, parents)], names=["node", "links", "parent"])

    for node, copies, sets, block, a, b in groups:
        root = np.arange(len(node))

        def find(x: int, root: np.ndarray = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = np.zeros(len(node), dtype=np.int64)
        left, right = (np.arange(len(node)), None) if a == b else (np.flatnonzero(block == a), np.flatnonzero(block == b))
        if len(left) and (right is None or len(right)):
            to = left if right is None else right
            for i, found in alike([sets[x] for x in left], None if right is None else [sets[x] for x in right], threshold):
                if len(found):
                    i, found = left[i], to[found]
                    links[i] += copies[found].sum()
                    links[found] += copies[i]
                    for j in found:
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
        for i in np.flatnonzero(links):
            nodes.append(node[i])
            counts.append(links[i])
            parents.append(node[find(i)])
        if len(nodes) > 20_000:
            yield batch()
            nodes, counts, parents = [], [], []
    yield batch()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of each (root, a, b), which the sorted partition holds together."""
    last, rows = None, []

    def unpacked() -> tuple:
        numbers = np.array([r[3:6] for r in rows], dtype=np.int64)
        return (numbers[:, 0], numbers[:, 1], [np.frombuffer(r[6], np.uint64) for r in rows], numbers[:, 2], last[1], last[2])

    for batch in batches:
        for r in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if r[:3] != last and rows:
                yield unpacked()
                rows = []
            last = r[:3]
            if not rows or rows[-1][3] != r[3]:  # repeated rows of one text come once
                rows.append(r)
    if rows:
        yield unpacked()


def keyed_rows(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, key, n, bands) of every row: the text's MD5, the class's key, the number
    of shingles and the hashes of the bands."""

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts_of(batch)
        words, at = word_hashes(t)
        sets, to = shingles(words, at, size)
        b = band_hashes(sets, to, bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * bands), pa.array(b.ravel()))
        digest = pa.array([hashlib.md5((x or "").encode()).digest() for x in t], pa.binary())
        return pa.record_batch([batch.column(0), digest, pa.array(class_keys(t, words, at), pa.binary()), pa.array(np.diff(to)), lists], names=["doc_id", "digest", "key", "n", "bands"])

    return map_batches(ids_and_texts(docs), signed, "doc_id long, digest binary, key binary, n long, bands array<long>")


def classes_and_rows(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, keep_rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """Classes (key, copy_class, copies, others, class_id, keeper) and rows (doc_id, key).
    keeper marks the class of each group that holds its least doc_id.  Rows that are not
    kept are not stored, and reading them would compute them again."""
    bands, rows = choose_bands(threshold, recall)
    signed = keyed_rows(docs, size, bands, rows)
    if keep_rows:
        signed = written(signed, "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    classes = signed.groupBy("key").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "key", "first.doc_id", "first.digest", "copies", "n", "bands")
    classes = written(classes, "classes")
    in_band = classes.where("n > 0").select("node", F.posexplode("bands").alias("band", "hash"))
    least = in_band.groupBy("band", "hash").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").drop("most")
    stars = in_band.join(least, ["band", "hash"]).where("node != v").select(F.col("node").alias("u"), "v")
    candidates = connected_components(stars, "candidates")
    member = written(candidates.join(classes.select("node", "key", "doc_id", "digest", "copies", "n"), "node"), "members")
    most = hot_above(member.count())
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int")
    member = join_by_key(member, member.groupBy("root").agg(blocks.alias("blocks"), F.count("*").alias("_size")), "root", "_size", most)
    member = member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumnRenamed("doc_id", "_id").withColumnRenamed("digest", "_digest")
    names = ["root", "node", "copies", "blocks", "block"]

    def with_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts_of(batch)
        words, at = word_hashes(t)
        sets, to = shingles(words, at, size)
        packed = pa.array([np.unique(sets[to[i] : to[i + 1]]).tobytes() for i in range(len(t))], pa.binary())
        return pa.record_batch([batch.column(batch.schema.get_field_index(c)) for c in names] + [packed], names=[*names, "shingles"])

    # members grow with the corpus: always shuffled, never broadcast
    text = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (text == F.col("_digest"))
    chosen = ids_and_texts(docs).join(member.hint("merge"), same).select("text", *names)
    sets = map_batches(chosen, with_sets, "root long, node long, copies long, blocks int, block int, shingles binary")
    # a block meets every block of its component, itself included
    paired = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("root", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "node", "copies", "block", "shingles")
    dealt = paired.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _verified(_groups(batches), threshold)

    found = written(dealt.mapInArrow(verify, "node long, links long, parent long"), "verified")
    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("parent").alias("v")), "groups")
    tied = written(groups.join(classes.select("node", "doc_id"), "node"), "tied")
    least = tied.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"), F.count("*").alias("_size"))
    named = join_by_key(tied, least, "root", "_size", most).select("node", F.col("m.doc_id").alias("class_id"), (F.col("m.node") == F.col("node")).alias("keeper"))
    info = classes.select("node", "key", F.col("doc_id").alias("copy_class"), "copies").join(counts, "node", "left").join(named, "node", "left")
    info = info.select("key", "copy_class", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("class_id", "copy_class").alias("class_id"), F.coalesce("keeper", F.lit(True)).alias("keeper"))
    return info, signed.select("doc_id", "key")


def links(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, copy_class, copies, links) of every row of docs; class_id is the
    least doc_id of the group of linked documents, copy_class that of its equal texts."""
    info, rows = classes_and_rows(docs, size, threshold, recall)
    info = written(info, "info")
    info = info.withColumn("_size", F.col("copies"))
    return join_by_key(rows, info, "key", "_size", hot_above(rows.count())).select("doc_id", "class_id", "copy_class", "copies", (F.col("others") + F.col("copies") - 1).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(read_table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id (of rows that share id and words the
    one with the least text, of repeated rows one; of a group whose ids are all null, one).
    All columns stay."""
    info, _ = classes_and_rows(docs, keep_rows=False)
    key, row, n = fresh(docs, "_key", "_row", "_n")
    named = lambda k, doc_id: F.concat(k, F.coalesce(doc_id.cast("long").cast("string"), F.lit("null")).cast("binary"))
    kept = info.where("keeper").select(named(F.col("key"), F.col("copy_class")).alias(row))

    def with_key(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = texts_of(batch)
        return batch.append_column(key, pa.array(class_keys(t, *word_hashes(t)), pa.binary()))

    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])
    keyed = map_batches(docs, with_key, schema).withColumn(row, named(F.col(key), F.col("doc_id")))
    once = keyed.join(kept, row, "left_semi").withColumn(n, F.row_number().over(W.partitionBy(row).orderBy("text")))
    return once.where(F.col(n) == 1).select(docs.columns)
