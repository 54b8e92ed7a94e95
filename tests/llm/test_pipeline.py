"""The pipeline's stages against plain versions, and its rows as a whole."""

import random
import re

import corpus_pipeline
from tests.llm.test_dedup import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(2000)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(30)).capitalize() + "."
    items = [line() for _ in range(5)]
    texts = ["\n".join(line() for _ in range(4)) for _ in range(60)]
    texts += [texts[3], texts[4].replace(texts[4].split()[7], "changed"), "header shared by all\n" + texts[5].replace("\n", " "), "header shared by all\n" + line()]
    texts += [line() + "\n" + items[2] + "\n" + line(), None, "", "12 34 !!", "one"]
    return items, [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def plain_lines(text):
    return [" ".join(re.findall(r"[^\W_]+", x.lower())) for x in text.split("\n")]


def test_stages(spark, tmp_path):
    items, rows = corpus(random.Random(2))
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), [dict((r[0], r[1]) for r in rows)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if name != "packing":
            assert docs.columns == columns
            kept.append({r.doc_id: r.text for r in docs.collect()})
    raw, named, lined, near, clean = kept
    assert named == {i: t for i, t in raw.items() if t and re.search(r"[^\W\d_]", t)}
    first = {}
    for i, t in sorted(named.items()):
        for n, x in enumerate(plain_lines(t)):
            if x:
                first.setdefault(x, (i, n))
    for i, t in named.items():
        survivors = [x for n, x in enumerate(t.split("\n")) if first.get(plain_lines(t)[n]) in (None, (i, n))]
        expected = "\n".join(survivors)
        # A line within the permitted edits of an earlier one goes as well.
        assert lined.get(i, "") == expected or set(lined.get(i, "").split("\n")) <= {*survivors, ""}
    assert 60 not in lined and set(range(60)) <= set(lined)
    truth = brute(lined.items(), 5, 80)
    assert near == {i: t for i, t in lined.items() if truth[i][1] == i}
    leak = next(i for i, t in raw.items() if t and items[2] in t)
    assert clean == {i: t for i, t in near.items() if i != leak}
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(clean) and all(r.length <= 2048 for r in pieces)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect()) == sorted(tuple(r)[:5] for r in pieces)


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(4)
    some = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    vocab = some("aeioustnrlh", 150).split(" ")
    docs = [(i, " ".join(rng.choices(vocab, k=80)), "en") for i in range(20)] + [(20, vocab[0], "en")]
    docs += [(100 + i, some("αβγδεζηθικλμνξοπρστυφχψω", 80), None) for i in range(20)]
    docs += [(200 + i, some("abcdefghijklmnopqrstuvwxyz", 80), None) for i in range(20)]
    docs += [(21, " ".join(rng.choices(vocab, k=80)), None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), "").collect()
    assert {r.doc_id for r in kept} == set(range(22)) and {r.lang for r in kept} == {"en"}


def test_repeated_ids_ties_and_clashing_names(spark, tmp_path):
    """Rows of one id are one document's or several, equal rows go together, and names of helper columns are the caller's."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    text = "a plain sentence of some ten different words stands here once"
    rows = [(1, text, "en", 0, 0, 0), (1, text, "en", 0, 0, 0), (2, text, "en", 1, 1, 1), (3, "another line with words of its own in it", "en", 2, 2, 2), (3, None, None, 3, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, removed int, gone_id int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == columns, name
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, text), (1, text), (3, "another line with words of its own in it")]


def test_contaminated_rows_go_alone(spark, tmp_path):
    item = "one two three four five six seven eight nine ten eleven twelve"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = [(None, item), (None, "clean"), (None, None), (5, f"so {item}"), (5, "clean as well")]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}").collect()
    assert {tuple(r) for r in kept} == {(None, "clean"), (None, None), (5, "clean as well")}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_tokenizing_gives_memory_back(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from folio.llm import tokens

    calls = []
    monkeypatch.setattr(tokens, "released", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], ["id", "text"])
    (out,) = tokens._pieces(iter([batch]), public_tokenizers.path("byte_bpe_50k.json"), 2048)
    assert out.column(0).to_pylist() == [1, 2] and out.column(3).to_pylist()[1] == 1
    assert len(calls) == 2
