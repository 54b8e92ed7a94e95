"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.hashing import U64, WordHasher, segments, shingles, utf8
from folio.llm.runtime import free_columns

#: Words of a seed; words of test items that one pass holds; share of an item's n-grams that are rare.
GRAM, BLOCK_WORDS, SEED_SHARE = 3, 1 << 18, 0.5
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Alignment score, as a share of the item's words, from which a passage is a copy.
THRESHOLD = 0.5
#: Score from which a passage is a copy however long the item is.
LONG = 40


def word_hasher() -> WordHasher:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; texts come lower-cased."""
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return WordHasher(np.arange(256, dtype=np.uint8), word)


def _words(texts: pa.Array, hasher: WordHasher):
    """For runs of texts: the first one's number and each one's word hashes."""
    offsets, data = utf8(pc.utf8_lower(texts))
    for first, last in segments(offsets):
        at = offsets[first : last + 1]
        _, _, hashes, word = hasher.words(at - at[0], data[at[0] : at[-1]])
        yield first, [hashes[a:b] for a, b in zip(word[:-1], word[1:], strict=True)]


class Lookup:
    """Which of a sorted array's entries values are; a bitmap turns most others away first."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(20, int(len(known)).bit_length() + 5)
        self.shift = U64(64 - bits)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(known >> self.shift).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``values`` of those known, and their places among the known."""
        at = np.flatnonzero(self.bitmap[(values >> self.shift).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.known, values[at]), len(self.known) - 1)
        hit = self.known[place] == values[at]
        return at[hit], place[hit]


def _count(batches, grams):
    """(place, n): how many texts have each n-gram of the test items."""
    hasher, find = word_hasher(), Lookup(grams.value)
    counts = np.zeros(len(grams.value), np.int64)
    for batch in batches:
        for _, texts in _words(batch.column(0), hasher):
            for words in texts:
                if len(words) >= GRAM:
                    counts[np.unique(find(shingles(words, GRAM))[1])] += 1
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["place", "n"])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment score of two word sequences, and where in ``passage`` it ends (exclusive)."""
    best, end = 0.0, 0
    row = np.zeros(len(passage) + 1)
    slope = GAP * np.arange(len(passage) + 1)
    for word in item:
        new = np.maximum(row + GAP, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - slope) + slope
        at = int(row.argmax())
        if row[at] > best:
            best, end = float(row[at]), at
    return best, end


def windows(hits: list[tuple[int, int, bool]], item: int, words: int):
    """Where to align, from hits (diagonal, place in the item, whether rare).

    Hits whose diagonals lie closer than half an item apart are one run; it counts if it holds a
    rare n-gram, or two different common ones.
    """
    hits = sorted(hits)
    cuts = [k for k in range(1, len(hits)) if hits[k][0] - hits[k - 1][0] > item // 2]
    for a, b in zip([0, *cuts], [*cuts, len(hits)], strict=True):
        run = hits[a:b]
        if any(rare for *_, rare in run) or len({q for _, q, _ in run}) > 1:
            yield max(0, run[0][0] - item // 2 - 1), min(words, run[-1][0] + item + item // 2 + 1)


def _find(batches, seeds, threshold: float):
    hasher = word_hasher()
    grams, owners, items, names = seeds.value
    find = Lookup(grams)
    for batch in batches:
        rows = []
        for first, texts in _words(batch.column(1), hasher):
            for i, words in enumerate(texts):
                if len(words) < GRAM:
                    continue
                at, place = find(shingles(words, GRAM))
                hits: dict[int, list[tuple[int, int, bool]]] = {}
                for p, g in zip(at.tolist(), place.tolist(), strict=True):
                    for item, q, rare in owners[g]:
                        hits.setdefault(item, []).append((p - q, q, rare))
                for item, own in hits.items():
                    target, best = items[item], (0.0, 0, 0)
                    for a, b in windows(own, len(target), len(words)):
                        score, end = align(target, words[a:b])
                        if score > best[0]:
                            back = align(target[::-1], words[a : a + end][::-1])
                            best = (score, a + end - back[1], a + end)
                    if best[0] >= min(threshold * len(target), LONG):
                        rows.append((first + i, names[item], best[0] / len(target), *best[1:]))
        picked = pa.array([r[0] for r in rows], pa.int64())
        columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), *columns], ["id", "item", "score", "first_word", "end_word"])


def _seeds(items: list[np.ndarray], grams: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, bool]]]:
    """For each n-gram the items that have it: item, place, and whether it is of the item's rarer half.

    Rare by the number of texts, against the item's other n-grams: an item that a third of all
    texts copy has its rare n-grams, too.
    """
    owners: list[list[tuple[int, int, bool]]] = [[] for _ in grams]
    for k, words in enumerate(items):
        own = np.searchsorted(grams, shingles(words, GRAM))
        most = np.quantile(counts[own], SEED_SHARE, method="lower")
        for q, g in enumerate(own.tolist()):
            owners[g].append((k, q, bool(counts[g] <= most)))
    return owners


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id_col, item_col, score, first_word, end_word): each text with each test item it holds a copy of.

    Words are lower-cased runs of letters and digits.  ``score`` is the Smith-Waterman score of the
    best passage over the item's words: 1 for a verbatim copy, less with each word changed, added or
    left out; pairs below ``threshold`` are left out, unless the passage alone scores LONG words.  A passage is aligned where it has one of the
    item's rare 3-grams (the rarer half, by the number of texts that have them, counted over all of
    ``docs``) or two of its common ones close together.

    The test items are held in blocks of about ``block_words`` words, each of which takes two passes
    over ``docs``; nothing of ``docs`` is shuffled but its finds.  Null texts and items and items of
    fewer than three words match nothing; equal items are each found; rows of a repeated id count
    as one with the best score; null ids are kept together as one id.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    words = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(words) // (6 * block_words)))
    found = None
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        hashes = [h for _, texts in _words(pa.array([r["text"] for r in part], pa.string()), word_hasher()) for h in texts]
        names = [r["item"] for r, h in zip(part, hashes, strict=True) if len(h) >= GRAM]
        items = [h for h in hashes if len(h) >= GRAM]
        if not items:
            continue
        grams = np.unique(np.concatenate([shingles(h, GRAM) for h in items]))
        known = spark.sparkContext.broadcast(grams)
        counted = source.select("text").mapInArrow(partial(_count, grams=known), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        counts = np.zeros(len(grams), np.int64)
        for row in counted.collect():
            counts[row["place"]] = row["n"]
        seeds = spark.sparkContext.broadcast((grams, _seeds(items, grams, counts), items, names))
        more = source.mapInArrow(partial(_find, seeds=seeds, threshold=threshold), "id long, item long, score double, first_word int, end_word int")
        found = more if found is None else found.unionByName(more)
    if found is None:
        found = spark.createDataFrame([], "id long, item long, score double, first_word int, end_word int")
    best = found.groupBy("id", "item").agg(F.max(F.struct("score", -F.col("first_word"), "end_word", "first_word")).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.score", "b.first_word", "b.end_word")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a copy of a test item; told apart by text, whatever their ids."""
    (gone,) = free_columns(docs, "gone_text")
    hashed = F.xxhash64(docs[text_col].cast("string"))
    texts = docs.select(hashed.alias("id"), F.col(text_col).alias("text"))
    out = contaminated(texts, benchmark, "id", **options).select(F.col("id").alias(gone)).distinct()
    return docs.join(out, hashed == out[gone], "left_anti")
