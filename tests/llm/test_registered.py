"""The registered queries themselves on the smallest data: contracts, SQL where there is some, brute force where there is none."""

import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm.oracles import ORACLE
from folio.llm.queries import QUERIES
from tests.test_queries import TABLES, canonical

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


def test_shards(spark, documents):
    rows = QUERIES["op2_sharding"](spark, FOLDER).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, crc(t)) for i, t, _ in documents)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_nearest(spark, duck):
    rows = QUERIES["op3_nearest_neighbours"](spark, FOLDER).collect()
    vectors = {i: np.array(v, float) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()}
    hits = total = 0
    for q in [i for i in vectors if i % 100 == 0]:
        d = {i: float(np.sqrt(((v - vectors[q]) ** 2).sum())) for i, v in vectors.items() if i != q}
        best = sorted(d, key=lambda i: (d[i], i))[:10]
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(best)), total + len(best)
    assert hits >= 0.9 * total


def test_lines(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op4_line_dedup"](spark, FOLDER).collect()}
    for i, text, _ in documents:
        lines = text.split("\n") if text is not None else []
        kept = "\n".join(x for k, x in enumerate(lines) if k not in rows[i].removed)
        assert rows[i].n_lines == len(lines) and rows[i].kept_crc32 == zlib.crc32(kept.encode())


def test_contaminated(spark, documents, duck):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontamination"](spark, FOLDER).collect()}
    items = duck.execute("SELECT item_id, text FROM benchmark WHERE text IS NOT NULL").fetchall()
    verbatim = {(i, k) for i, t, _ in documents for k, item in items if t and item and item in t}
    assert verbatim <= found


def test_packed(spark, documents):
    rows = QUERIES["op6_best_fit_packing"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == {i for i, *_ in documents}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own[:-1])])) and sum(n for _, n in own) <= 2048
    matrix = QUERIES["op7_token_matrices"](spark, FOLDER).collect()
    assert sum(r.n_tokens for r in matrix) == sum(r.length for r in rows)


def test_quality(spark, duck):
    rows = {r.doc_id: r for r in QUERIES["op9_quality"](spark, FOLDER).collect()}
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels").fetchall())
    out = [i for i in labels if i in rows and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out for i in out) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert sum(rows[i].predicted == labels[i] for i in out) >= 0.85 * len(out)


def test_languages(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, FOLDER).collect()}
    out = [(i, lang) for i, t, lang in documents if lang and t and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(rows[i].held_out for i, _ in out) and sum(rows[i].lang_pred == lang for i, lang in out) >= 0.95 * len(out)


def test_scratch_without_a_shared_folder(spark, monkeypatch):
    """A local session without the setting gets a folder of its own; a cluster's is an error."""
    from folio.llm import runtime

    class Unset:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Unset()
        sparkContext = spark.sparkContext

    assert runtime.shared_folder(Session()).startswith("file:/") and runtime.shared_folder(Session()) == runtime.shared_folder(Session())

    class Cluster:
        master, applicationId = "spark://host:7077", "other"

    Session.sparkContext = Cluster
    with pytest.raises(ValueError):
        runtime.shared_folder(Session())
    assert spark.range(1).select(F.lit(1)).count() == 1
