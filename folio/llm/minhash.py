"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import connected_components
from folio.llm.hashing import U64, ascii_words, fmix, segments, shingles, utf8
from folio.llm.linkage import first_pairs, open_blocks, shared_buckets
from folio.llm.runtime import Scratch, free_columns

#: Bands and rows of a signature: a pair at a similarity of 0.85 shares no band once in four million
#: times, one at 0.8 six times in a hundred thousand.
BANDS, ROWS = 32, 6
#: Bits of a bitmap for each shingle of the largest set that it holds, and at most.
SPREAD, BITS = 16, 1 << 16
#: Bytes of bitmaps that are compared at once, and of members' sets that are held.
AT_ONCE, HELD = 1 << 24, 1 << 25


def densify(values: np.ndarray, filled: np.ndarray) -> None:
    """Optimal densification: an empty bin takes the value of the first filled bin of its own random sequence."""
    bins = np.arange(values.shape[1], dtype=U64)
    row, bin_ = np.nonzero(~filled)
    own = filled[row].any(axis=1) if len(row) else np.zeros(0, bool)
    row, bin_, attempt = row[own], bin_[own], 0
    while len(row):
        attempt += 1
        source = (fmix(bins * U64(0x9E3779B97F4A7C15) + U64(attempt)) % U64(len(bins))).astype(np.int64)[bin_]
        found = filled[row, source]
        values[row[found], bin_[found]] = values[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A key for each set and band. One permutation: the sorted hashes fall into bins, each keeps its least."""
    bins = bands * rows
    values, filled = np.zeros((len(sets), bins), U64), np.zeros((len(sets), bins), bool)
    for i, xs in enumerate(sets):
        at = ((xs >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        values[i, at[first]] = xs[first]
        filled[i, at[first]] = True
    densify(values, filled)
    keys = np.arange(1, bands + 1, dtype=U64)[None, :].repeat(len(sets), axis=0)
    for r in range(rows):
        keys = fmix(keys * U64(0x9E3779B97F4A7C15) + values[:, r::rows])
    return keys


def _sets(texts: pa.Array, hasher, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For runs of texts: the first one's number, and each one's sorted distinct shingle hashes."""
    offsets, data = utf8(texts)
    for first, last in segments(offsets):
        at = offsets[first : last + 1]
        _, _, hashes, word = hasher.words(at - at[0], data[at[0] : at[-1]])
        yield first, [np.unique(fmix(shingles(hashes[a:b], words))) for a, b in zip(word[:-1], word[1:], strict=True)]


def _signatures(batches, words: int, bands: int, rows: int):
    hasher = ascii_words()
    for batch in batches:
        for first, sets in _sets(batch.column(1), hasher, words):
            keys = band_keys(sets, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sets)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(np.array([x.sum(dtype=U64) for x in sets], U64).view(np.int64)),
                    pa.array(np.array([fmix(x ^ U64(0xA5A5A5A5)).sum(dtype=U64) for x in sets], U64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64))),
                ],
                ["id", "n", "s1", "s2", "keys"],
            )


def _full_sets(batches, words: int):
    hasher = ascii_words()
    for batch in batches:
        for first, sets in _sets(batch.column(1), hasher, words):
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "xs"])


def similar(xs: np.ndarray, ys: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    common = len(np.intersect1d(xs, ys, assume_unique=True))
    return 100 * common >= percent * (len(xs) + len(ys) - common)


def bitmaps(sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bitmap for each set and how many of its members found their bit taken."""
    maps = np.zeros((len(sets), bits), bool)
    for i, xs in enumerate(sets):
        maps[i, xs & (bits - 1)] = True
    packed = np.packbits(maps, axis=1).view(U64)
    return packed, np.array([len(x) for x in sets]) - maps.sum(axis=1)


def joining(outside: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """Links (id, id) of an outsider and a member, each (id, component, set), that join two components; those joined by
    earlier links are not compared.

    No pair is lost to the bitmaps: common members that share a bit are at most as many as found it taken.
    """
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    out_sizes, sizes = (np.array([len(x) for _, _, x in some]) for some in (outside, members))
    bits = min(BITS, max(256, 1 << int(SPREAD * max(out_sizes.max(), sizes.max()) - 1).bit_length()))
    out_maps, out_taken = bitmaps([x for _, _, x in outside], bits)
    step = max(1, AT_ONCE // (bits // 8 * len(outside)))
    for first in range(0, len(members), step):
        some = members[first : first + step]
        maps, taken = bitmaps([x for _, _, x in some], bits)
        common = np.bitwise_count(out_maps[:, None, :] & maps[None, :, :]).sum(axis=2, dtype=np.int64) + np.minimum(out_taken[:, None], taken[None, :])
        union = out_sizes[:, None] + sizes[None, first : first + len(some)] - common
        for i, j in np.argwhere(100 * common >= percent * union).tolist():
            (a, home, xs), (b, other, ys) = outside[i], some[j]
            x, y = find(home), find(other)
            if x != y and similar(xs, ys, percent):
                root[max(x, y)] = min(x, y)
                yield a, b


def _compare_blocks(batches, percent: int):
    """Rows sorted by block, those outside first: a block is held, its members are compared as they come."""
    held, key, members, weight = [], None, [], 0

    def done():
        found = list(joining(held, members, percent)) if held and members else []
        members.clear()
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])

    for batch in batches:
        sets = batch.column(6)
        offsets, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for n, (k, block, chunk, role, i, home) in enumerate(zip(*columns, strict=True)):
            if (k, block, chunk) != key or weight > HELD:
                yield done()
                weight = 0
                if (k, block, chunk) != key:
                    held, key = [], (k, block, chunk)
            (members if role else held).append((i, home, flat[offsets[n] : offsets[n + 1]].copy()))
            weight += role * 8 * int(offsets[n + 1] - offsets[n])
    yield done()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of ``docs``.

    Texts are linked where 100 * intersection >= percent * union of their sets of ``words``-word
    shingles (words between ASCII white space, A-Z lower-cased; fewer words: the whole sequence).
    Signatures only propose; each link is confirmed on the full sets.  Equal sets collapse into one
    class first, so a group of exact copies costs one row however large it is.  Small buckets give
    all their pairs, a large one a star around its most central member; what of it is outside its main
    component then is compared with the whole bucket in bounded blocks, so no pair of a bucket
    that could join two components is lost.

    Null or wordless texts have an empty set and are linked with nothing.  Rows that share an id are
    one document.  Rows with a null id keep their n_shingles, have a null component and are kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(source.mapInArrow(partial(_signatures, words=words, bands=bands, rows=rows), "id long, n long, s1 long, s2 long, keys array<long>"), "signatures")
    full = signed.where("n > 0 and id is not null")
    classes = scratch.save(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.min("keys").alias("keys")), "classes")
    buckets = classes.select(F.explode("keys").alias("key"), F.col("rep").alias("id")).distinct() if bands > 1 else classes.select(F.col("keys")[0].alias("key"), F.col("rep").alias("id"))

    shared = scratch.save(shared_buckets(buckets), "buckets")
    pairs = scratch.save(first_pairs(shared, lambda x, y: "true", []), "pairs")
    scratch.tidy()
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    # The same plan at every size: texts are dealt by id once; only candidates' texts become sets.
    sets = scratch.save(source.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(partial(_full_sets, words=words), "id long, xs array<long>"), "sets")
    of = lambda c, x: sets.select(F.col("id").alias(c), F.col("xs").alias(x))
    na, nb = F.size("xa"), F.size("xb")
    both = pairs.join(of("b", "xb"), "b").join(of("a", "xa"), "a").where(100 * F.least(na, nb) >= percent * F.greatest(na, nb))
    common = F.size(F.array_intersect("xa", "xb"))
    links = scratch.save(both.where(100 * common >= percent * (na + nb - common)).select("a", "b").distinct(), "links")
    scratch.tidy()
    components = connected_components(links, scratch)
    outside, members, placed = open_blocks(shared, components, [], scratch)
    deal = lambda df, role: df.select("key", "block", "chunk", F.lit(role).alias("role"), "x.home", "x.id").join(sets, "id").select("key", "block", "chunk", "role", "id", "home", "xs")
    dealt = deal(outside, 0).unionByName(deal(members, 1)).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk", "role", "id")
    more = scratch.save(dealt.mapInArrow(partial(_compare_blocks, percent=percent), "a long, b long"), "links")
    scratch.drop(placed)
    scratch.tidy()
    components = connected_components(links.unionByName(more), scratch)
    found = classes.join(components.select(F.col("id").alias("rep"), "component"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    named = signed.select("id", "n", "s1", "s2").join(found, ["s1", "s2", "n"], "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; columns and values unchanged."""
    (gone,) = free_columns(docs, "gone_id")
    out = near_duplicates(docs, id_col, **options).where(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(out, docs[id_col].cast("long") == out[gone], "left_anti")
