import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm import ann, chat
from folio.llm.ann import search
from folio.llm.decontam import align, contaminated, without_contaminated
from folio.llm.langid import identify, learn_profiles
from folio.llm.packing import exact_complements, pack, plan
from folio.llm.quality import learn, score_quality
from folio.llm.sharding import shard_by_key, write_shards
from folio.llm.tokens import END, ByteTokenizer, best_fit_decreasing, packed_matrices, pieces_of, token_pieces, write_matrices

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
AWKWARD = [(1, None), (2, ""), (3, "same"), (3, "same"), (None, "no id"), (None, None), (4, "x" * 200_000), (5, "<|endoftext|> é漢字 \u0085  \n\n a1²٣")]


def encoder():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_remembered_pre_tokens_give_the_tokenizer_s_ids(text):
    assert np.frombuffer(TOKENS(text), "<u4").tolist() == ENCODE(text)


TOKENS, ENCODE = ByteTokenizer(PATH), encoder()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x" * 5000, "é" * 3000 + "<|endoftext|>"])
def test_strings_of_added_tokens_are_the_tokenizer_s_own(text):
    assert np.frombuffer(TOKENS(text), "<u4").tolist() == ENCODE(text)


def test_files_that_split_otherwise_go_whole():
    for name in ("word_bpe_49k", "byte_bpe_50k"):
        path = public_tokenizers.path(f"{name}.json")
        own, plain = ByteTokenizer(path), Tokenizer.from_file(path)
        for text in ("It's 12 o'clock,  no?", "\u0085 ünd 漢字\n\n x"):
            assert np.frombuffer(own(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    rng = random.Random(1)
    docs = AWKWARD + [(i, " ".join(rng.choice(["the", "of", "zebra", "ünder"]) for _ in range(rng.randint(1, 900)))) for i in range(10, 60)]
    df = spark.createDataFrame(docs, DOCS)
    rows = pack(token_pieces(df, PATH, 512), 512).select("record.*", "sequence_id", "offset").collect()
    assert sum(r.length for r in rows) == sum(len(ENCODE(t or "")) + 1 for _, t in docs)
    ids = {i: ENCODE(t or "") + [0] for i, t in docs if i is not None}
    for r in rows:
        if r.doc_id is not None:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for sequence in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 512
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 512) + 2
    assert pack(token_pieces(df.limit(0), PATH), 2048).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for parts, times in plan(histogram, 64):
        assert sum(parts) <= 64
        for n in parts:
            used[n] = used.get(n, 0) + times
    assert used == histogram


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=10))
def test_no_filling_of_up_to_three_is_overlooked(histogram):
    """What the index leaves could not be filled beside its longest piece, by trying every combination."""
    count = np.zeros(25, np.int64)
    for n, c in histogram.items():
        count[n] = c
    exact_complements(count, 24)
    left = [n for n in range(1, 25) for _ in range(count[n])]
    longest = set(left)
    for n in longest:
        rest = list(left)
        rest.remove(n)
        some = [x for x in rest if x <= n]
        for k in (1, 2, 3):
            assert all(sum(c) != 24 - n for c in itertools.combinations(some, k))


def test_plan_finds_exact_complements():
    assert sum(t for _, t in plan({60: 3, 4: 1, 1: 1, 3: 1, 2: 1, 30: 1}, 64)) == 4  # 60+4, 60+3+1, 60+2, 30
    assert plan({32: 4}, 64) == [((32, 32), 2)]
    assert plan({40: 2, 12: 4}, 64) == [((40, 12, 12), 2)]
    assert plan({34: 1, 15: 1, 10: 1, 5: 1}, 64) == [((34, 15, 10, 5), 1)]


@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_decreasing_with_the_capacity_tree(lengths):
    bins = best_fit_decreasing(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 50 for b in bins)
    plain = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(plain) if room >= n]
        if fits:
            plain[min(fits, key=lambda k: plain[k])] -= n
        else:
            plain.append(50 - n)
    assert len(bins) == len(plain)


def test_matrices_hold_every_document(spark):
    df = spark.createDataFrame(AWKWARD, DOCS)
    rows = packed_matrices(df, PATH, width=256, window=1000, pad=7).collect()
    parts = {}
    for r in rows:
        ids, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(places) == 256 and (ids[r.cu_seqlens[-1] :] == 7).all()
        for doc, piece, start, a, b in zip(r.docs, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, piece, ids[a:b].tolist()))
    for i in (1, 2, 4, 5):
        whole = [x for _, _, ids in sorted(parts[i]) for x in ids]
        assert whole == ENCODE(dict(AWKWARD)[i] or "") + [0]
    assert len(parts[3]) == 2 and len(parts[None]) == 2
    assert packed_matrices(df.limit(0), PATH).collect() == []


def test_pieces():
    assert pieces_of(5, 10) == [(0, 5)] and pieces_of(20, 10) == [(0, 10), (10, 10)] and pieces_of(23, 10) == [(0, 3), (3, 10), (13, 10)]
    assert END == bytes(4)


def test_sharding(spark):
    docs = AWKWARD + [(i, "t" * (i % 50)) for i in range(100, 700)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], f"{DOCS}, shard string, slot int").repartition(5)
    for size in (1 << 20, 500):
        rows = shard_by_key(df, 24, bucket_bytes=size).collect()
        key = lambda r: (r[0] or -1, r[1] or "")
        assert sorted(map(key, (r.record for r in rows))) == sorted(map(key, docs))
        for s in range(24):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert all(r.grown_shard in (r.shard, 24) for r in rows)
        again = shard_by_key(df.select("text", "doc_id"), 25).collect()
        assert {r.record.doc_id: r.shard for r in again} == {r.record.doc_id: r.grown_shard for r in rows}
    own = [r.record.doc_id for r in sorted((r for r in rows if r.shard == 3), key=lambda r: r.slot)]
    assert own != sorted(own, key=lambda i: i or -1)
    assert shard_by_key(df.limit(0), 24).collect() == []


@given(st.text(alphabet="<|\\>abturnbody/sINST[] \n"))
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    turn = chat.render(text, [{"kind": "text", "text": text, "ref": None, "units": None}])
    assert chat.read_turn(turn["chunk"]) == (text, text)


def test_typed_parts():
    part = lambda kind, text=None, ref=None, units=None: {"kind": kind, "text": text, "ref": ref, "units": units}
    got = chat.render("assistant", [part("text", "see <"), part("text", "|end|>"), part("image", ref="a.png", units=2), part("audio", ref="b", units=1.5), part("text", "done"), part("document", ref="c")])
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 512), ("audio", "b", 38), ("document", "c", 512)]
    assert got["attachment_tokens"] == 1062
    assert [chat.unescape(got["chunk"][s["start"] : s["end"]]) for s in got["loss"]] == ["see <|end|>", "done"]
    assert all(got["chunk"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in got["attachments"])
    assert chat.read_turn(got["chunk"]) == ("assistant", "see <|end|>done")
    # A kind that isn't known is kept as an attachment; one such part doesn't stop a job.
    other = chat.render("user", [part("text", "a"), part("vi|deo", ref="v", units=3), part(None, "b")])
    assert [(a["kind"], a["ref"], a["tokens"]) for a in other["attachments"]] == [("vi|deo", "v", 3)] and chat.read_turn(other["chunk"]) == ("user", "ab")
    escaped = chat.render("user", [part("text", "<|turn|><|other|>")])
    assert chat.read_turn(escaped["chunk"]) == ("user", "<|turn|><|other|>") and escaped["attachments"] == []


def test_conversations_read_back(spark):
    turns = [(1, 1, "assistant", "b<|end|>"), (1, 0, "user", "a"), (2, 0, None, None), (None, None, "assistant", ""), (3, 0, "user", "t"), (3, 0, "user", "t")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, chunk int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (got[1].turns_sha256, got[1].loss_sha256, got[1].loss_chars, got[1].n_turns) == (sha("user\na\nassistant\nb<|end|>\n"), sha("b<|end|>"), 8, 2)
    assert got[2].turns_sha256 == sha("\n\n") and got[3].n_turns == 2 and got[None].loss_chars == 0
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


def test_language_identification(spark):
    words = {"aa": ["lorem", "dolor", "amet"], "bb": ["krzy", "szcz", "wski"]}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    df = spark.createDataFrame([*rows, (100, None, "aa"), (101, "123 !?", "bb"), (102, "lorem", None)], "doc_id long, text string, lang string")
    got = {r.record.doc_id: r for r in identify(df, learn_profiles(df)).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[102].lang_pred == "aa"
    assert {r.lang_pred for r in identify(df, {}).collect()} == {"und"}
    assert learn_profiles(df.limit(0)) == {} and identify(df.limit(0), learn_profiles(df)).collect() == []


def test_quality_separates_and_survives_odd_rows(spark):
    rng = random.Random(6)
    good = lambda: " ".join(rng.choice(["plain", "words", "of", "prose"]) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW$$", "###", "click"]) for _ in range(40))
    docs = [(i, good() if i % 2 else bad()) for i in range(120)]
    df = spark.createDataFrame([*docs, *((i and i + 1000, t) for i, t in AWKWARD)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.record.doc_id: r.score for r in score_quality(df, learn(df, labels)).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(80, 120)) and all(0 <= s <= 1 for s in got.values())
    assert learn(df, labels.limit(0)) is None
    assert {r.score for r in score_quality(df, None).collect()} == {1.0} and score_quality(df.limit(0), None).collect() == []


def test_alignment():
    item = np.arange(20, dtype=np.uint64)
    passage = np.concatenate([np.full(5, 99, np.uint64), item, np.full(5, 98, np.uint64)])
    assert align(item, passage) == (20.0, 25)
    changed = passage.copy()
    changed[[8, 12, 16]] = 77
    assert align(item, changed)[0] == 17 - 1.5
    assert align(item, np.delete(passage, 10))[0] == 19 - 0.5


def test_decontamination_finds_edited_copies_and_spares_clean_texts(spark):
    rng = random.Random(7)
    vocab = ["the", "of", "and"] * 20 + [f"word{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [text(rng.randint(15, 40)) for _ in range(12)]
    docs, truth = [], set()
    for i in range(150):
        words = text(rng.randint(30, 200))
        if i % 3 == 0:
            k = rng.randrange(12)
            copy = [w if rng.random() > 0.12 else rng.choice(vocab) for w in items[k]] if i % 2 else items[k]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in copy]
            truth.add((i, k))
        docs.append((i, " ".join(words)))
    benchmark = spark.createDataFrame([*((k, " ".join(w)) for k, w in enumerate(items)), (50, None), (51, ""), (52, "the of")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (900, None), (901, "")], DOCS)
    for block in (1 << 21, 40):
        got = {(r.doc_id, r.item_id) for r in contaminated(df, benchmark, block_words=block).collect()}
        assert got == truth
    kept = {r.doc_id for r in without_contaminated(df, benchmark).collect()}
    assert kept == {i for i, _ in docs if i % 3} | {900, 901}
    assert contaminated(df, benchmark.limit(0)).collect() == [] == contaminated(df.limit(0), benchmark).collect()


def test_a_long_passage_of_a_longer_item_is_found(spark):
    rng = random.Random(17)
    item = [f"w{rng.randrange(5000)}" for _ in range(300)]
    docs = [(1, " ".join(["x"] * 20 + item[100:160] + ["y"] * 20)), (2, " ".join(item[:20])), (None, " ".join(item[200:250])), (1, "again"), (3, "a b c " * 40_000)]
    df = spark.createDataFrame([(*d, 0) for d in docs], f"{DOCS}, gone_text int")
    benchmark = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(300 * r.score)) for r in contaminated(df, benchmark).collect()}
    assert got == {(1, 7, 60), (None, 7, 50)}
    kept = without_contaminated(df, benchmark)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3} and kept.count() == 3


def test_search_splits_large_cells_and_walks_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 100)
    monkeypatch.setattr(ann, "SAMPLE", 64)
    rng = np.random.default_rng(18)
    x = rng.standard_normal((600, 8))
    df = spark.createDataFrame([(i, v.tolist(), 1.0, 2) for i, v in enumerate(x)] + [(3, x[5].tolist(), 0.0, 0)], "vec_id long, embedding array<double>, vec double, id int")
    rows = search(df, df.where("vec_id % 60 = 1")).collect()
    hits = 0
    for q in range(1, 600, 60):
        d = ((x - x[q]) ** 2).sum(axis=1)
        best = [i for i in np.argsort(d) if i != q][:10]
        hits += len({r.vec_id for r in rows if r.query_id == q} & set(best))
    assert hits >= 90


def test_shards_are_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, f"t{i}") for i in range(200)] + [(7, "hot")] * 300, DOCS)
    write_shards(shard_by_key(df, 5, bucket_bytes=400), f"file://{tmp_path}/s")
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 500 and back.select("shard").distinct().count() <= 5
    assert sorted(r.slot for r in back.where("record.doc_id = 7").collect()) == sorted(r.slot for r in shard_by_key(df, 5, bucket_bytes=400).collect() if r.record.doc_id == 7)


def test_matrices_are_written(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, DOCS)
    write_matrices(packed_matrices(df, PATH, width=256), f"file://{tmp_path}/m")
    rows = spark.read.parquet(f"file://{tmp_path}/m").collect()
    assert all(len(r.ids) == 1024 for r in rows) and sum(r.cu_seqlens[-1] for r in rows) == sum(len(ENCODE(t or "")) + 1 for _, t in AWKWARD)


def test_quality_of_conflicting_and_repeated_labels(spark):
    docs = [(i, "plain words of prose" if i % 2 else "BUY!! NOW$$ BUY!!") for i in range(60)] + [(1, "another text"), (1, "plain words of prose")]
    df = spark.createDataFrame([(*d, 5, "x") for d in docs], f"{DOCS}, y int, record string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, 1), (1, 1), (None, 0)], "doc_id long, quality int")
    one, two = learn(df, labels), learn(df.repartition(7), labels.repartition(3))
    assert (one[0] == two[0]).all() and one[1] == two[1]
    got = {r.record.doc_id: r.score for r in score_quality(df, one).collect()}
    assert got[3] > 0.3 > got[4] and got[2] < 0.3


def test_language_of_long_texts_and_ties(spark):
    rows = [(1, "lorem dolor amet " * 60_000, "aa", 1), (2, "krzy szcz wski", "bb", 2), (3, "krzy szcz wski", "cc", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.record.doc_id: r.lang_pred for r in identify(df, learn_profiles(df)).collect()}
    assert got == {1: "aa", 2: "bb", 3: "bb"}


def test_search_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[700:1100] = x[699]
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0, None]), (2004, [1.0] * 3), (2005, [float("inf")] * 24)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<float>")
    rows = search(df, df.where("vec_id % 100 = 0 or vec_id = 2001")).collect()
    assert {r.query_id for r in rows} == set(range(0, 1500, 100)) and len(rows) == 150
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = sorted(range(1500), key=lambda i: (d[i], i))[:10]
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(best))
    assert hits >= 0.9 * 150
    assert [r.vec_id for r in sorted((r for r in rows if r.query_id == 800), key=lambda r: r.rank)] == list(range(699, 709))
    few = df.where("vec_id < 3")
    assert len(search(few, few).collect()) == 6 and search(df.limit(0), df).collect() == []


def test_words_are_merged_without_the_tokenizers_own_splitting():
    """Once made, the tokenizer isn't asked for words of a BPE vocabulary; the ids are its own, for any character of the basic plane and beyond."""
    import public_tokenizers

    from folio.llm.tokens import ByteTokenizer

    rng = random.Random(71)
    odd = [chr(c) for c in (*range(256), 0x301, 0x661, 0x2019, 0x2028, 0x2177, 0x3000, 0x4E2D, 0xAC00, 0xE000, 0xFFFF, 0x1F600, 0x20000)]
    texts = ["It's plain text, 12 words or so!  And more\n\n", *("".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(500))]
    mine = ByteTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    plain, mine.tokenizer = mine.tokenizer, None
    assert not mine.whole
    for text in texts:
        assert memoryview(mine(text)).cast("I").tolist() == plain.encode(text, add_special_tokens=False).ids
        if max(text, default="") <= "￿" and not text.isascii():
            assert mine.split(text) == mine.split_any(text)
