"""Language identification with hyperdimensional letter-trigram profiles."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.hashing import U64, fmix, segments, utf8
from folio.llm.runtime import released

#: Dimensions of a vector.
DIMENSIONS = 1024
#: Languages that are learned at most: their profiles come to the driver and go to every task.
LANGUAGES = 4096
#: Bytes of texts, and different trigrams, that a worker bundles at once.
RUN, AT_ONCE = 1 << 18, 2048
#: Fixed point of the profiles: sums are of integers, so the order of tasks doesn't show.
UNIT = 1 << 20


def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    known = np.zeros(0x110000, bool)
    known[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return known


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A random vector of -1 and 1 for each code point, a function of the code point alone."""
    words = fmix((codes.astype(U64)[:, None] << U64(16)) + np.arange(1, dimensions // 64 + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15))
    return (np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def bundles(texts: list[str], letters: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled trigram vectors of each text, and its number of trigrams (0 without letters).

    Runs of other characters count as one blank, also before and after a text.  The letters of a
    trigram are bound by multiplication, each permuted by its place.
    """
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes)
    code = np.where(letters[code], code, 0)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0) | (doc[1:] != doc[:-1])
    code, doc = code[keep], doc[keep]
    whole = np.flatnonzero((doc[2:] == doc[:-2]) & ((code[2:] > 0) | (code[1:-1] > 0) | (code[:-2] > 0)))
    alphabet, small = np.unique(code, return_inverse=True)
    n = len(alphabet)
    grams = (small[whole] * n + small[whole + 1]) * n + small[whole + 2]
    if n**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(grams, minlength=1))
        place = np.zeros(n**3, np.int64)
        place[used] = np.arange(len(used))
        at = place[grams]
    else:
        used, at = np.unique(grams, return_inverse=True)
    vectors = letter_vectors(alphabet, dimensions)
    out = np.zeros((len(texts), dimensions), np.float32)
    total = np.bincount(doc[whole], minlength=len(texts))
    order = np.unique(doc[whole] * np.int64(max(1, len(used))) + at, return_counts=True)
    cell, count = order
    row, col = np.divmod(cell, max(1, len(used)))
    for first in range(0, len(used), AT_ONCE):  # so that a text of many letters takes bounded memory
        g = used[first : first + AT_ONCE]
        bound = np.roll(vectors[g // (n * n)], 2, axis=1) * np.roll(vectors[g // n % n], 1, axis=1) * vectors[g % n]
        part = (col >= first) & (col < first + AT_ONCE)
        counts = np.zeros((len(texts), len(g)), np.float32)
        counts[row[part], col[part] - first] = count[part]
        out += counts @ bound.astype(np.float32)
    return out, total


def _runs(column: pa.Array, letters: np.ndarray, dimensions: int):
    offsets, data = utf8(column)
    for first, last in segments(offsets, RUN):
        raw = data[offsets[first] : offsets[last]].tobytes()
        texts = [raw[offsets[i] - offsets[first] : offsets[i + 1] - offsets[first]].decode("utf-8", "replace") for i in range(first, last)]
        yield first, *bundles(texts, letters, dimensions)


def _learn(batches, dimensions: int):
    letters, sums = _letters(), {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, vectors, total in _runs(batch.column(1), letters, dimensions):
            share = np.rint(vectors * (UNIT / np.maximum(total, 1))[:, None]).astype(np.int64)
            for i in np.flatnonzero(total):
                sums.setdefault(langs[first + i], np.zeros(dimensions, np.int64))[:] += share[i]
    released()
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "profile"])


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit vectors by language, from every row with a language and a letter; each text counts alike.

    Each task bundles what it reads; the driver gets one vector for each language.  More than
    LANGUAGES labels are an error: such a column doesn't hold languages.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    parts = known.mapInArrow(partial(_learn, dimensions=dimensions), "lang string, profile array<long>")
    sums = parts.select("lang", F.posexplode("profile").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("p")).select("lang", F.col("p.v").alias("p"))
    rows = whole.limit(LANGUAGES + 1).collect()
    if len(rows) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages in {lang_col}")
    profiles = {r["lang"]: np.array(r["p"], np.float64) for r in rows}
    return {k: v / (np.linalg.norm(v) or 1) for k, v in sorted(profiles.items())}


def _predict(batches, langs: list[str], profiles: np.ndarray, dimensions: int):
    letters = _letters()
    for batch in batches:
        for first, vectors, total in _runs(batch.column(1), letters, dimensions):
            norm = np.linalg.norm(vectors, axis=1)
            known = (total > 0) & (norm > 0) & bool(langs)
            cosine = vectors.astype(np.float64) @ profiles.T / np.maximum(norm, 1e-9)[:, None] if langs else np.zeros((len(total), 1))
            best = cosine.argmax(axis=1)
            names = [langs[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(total)), pa.array(names, pa.string()), pa.array(score)], ["record", "lang_pred", "score"])
    released()


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", carried: Column | None = None) -> DataFrame:
    """(record, lang_pred, score): ``carried`` (all columns of ``docs``, unless given), the nearest language, its cosine.

    Whole texts, null texts and texts without letters: ``und`` with a score of 0, as is everything
    if no language was learned.  Equal cosines go to the first language by name.  Columns of any
    name are carried; an empty table gives an empty result.
    """
    carried = F.struct("*") if carried is None else carried
    source = docs.select(carried.alias("record"), F.col(text_col).cast("string").alias("text"))
    vectors = np.array(list(profiles.values())) if profiles else np.zeros((0, DIMENSIONS))
    run = partial(_predict, langs=list(profiles), profiles=vectors, dimensions=vectors.shape[1])
    schema = T.StructType([source.schema["record"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return source.mapInArrow(run, schema)
