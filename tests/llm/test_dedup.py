import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm.components import connected_components
from folio.llm.linkage import BLOCK, SMALL, open_pairs
from folio.llm.lines import dedup_lines, keys_of, lines_of, near_by_more, parities, word_string
from folio.llm.minhash import band_keys, keep_one, near_duplicates
from folio.llm.runtime import Scratch

DOCS = "doc_id long, text string"


def brute(docs, words, percent):
    """Components by comparing every pair of shingle sets."""
    sets = {}
    for i, text in docs:
        w = (text or "").translate({a: a + 32 for a in range(65, 91)})
        for c in "\t\n\r\v\f":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants(rng, vocab, originals, copies, edits):
    docs, k = [], 0
    for _ in range(originals):
        base = [rng.choice(vocab) for _ in range(80)]
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits) if c else 0):
                words[rng.randrange(80)] = rng.choice(vocab)
            docs.append((k, " ".join(words)))
            k += 1
    return docs


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rng = random.Random(words)
    docs = variants(rng, [f"w{i}" for i in range(500)], 6, 30, 6)
    docs += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "two words"), (1006, "two\nwords"), (1007, "É x"), (1008, "é x"), (1009, docs[0][1].upper())]
    rng.shuffle(docs)
    rows = near_duplicates(spark.createDataFrame(docs, DOCS), words=words, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_links_through_others_than_the_leader(spark):
    """A chain of texts, each close to the next only, in a group much larger than a small bucket."""
    words = [f"w{i}" for i in range(400)]
    docs = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(4 * SMALL)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, DOCS), words=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in brute(docs, 3, 85).items()}


def test_large_group_of_near_copies_that_the_leader_doesnt_hold_together(spark):
    """More members outside the main component than a block holds; some are linked with each other only, most with nothing."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for k in range(1, 2 * BLOCK, 2):
        words = list(base)
        for at in rng.sample(range(60), 3):
            words[at] = f"x{k}-{at}"
        docs.append((k, " ".join(words)))
        if k % 4 == 1:
            words[rng.randrange(60)] += "y"
            docs.append((k + 1, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, DOCS), words=3, percent=85).collect()}
    assert got == brute(docs, 3, 85) and len({c for _, c in got.values()}) > 50


def test_a_long_chain_of_ids_in_one_bucket(spark):
    """All texts share most of their words, so every bucket is large; each is close to its neighbours only."""
    words = [f"w{i}" for i in range(700)]
    docs = [(k, " ".join(words[2 * k : 2 * k + 100])) for k in range(300)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, DOCS), words=3, percent=85).collect()}
    assert set(got.values()) == {0}


def test_null_ids_repeats_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (None, "a b c d", 2), (5, "a b c d", 3), (5, "a b c d", 4)], "doc_id long, text string, gone_id int")
    rows = near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, -1, True), (5, 5, True), (5, 5, True)]
    assert keep_one(df).columns == df.columns and keep_one(df).count() == 4
    assert near_duplicates(df.limit(0)).collect() == []


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = near_duplicates(spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2 w3 w4 w5")], DOCS)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64) << np.uint64(1))
    a, b = pool[:50], pool[10:]
    keys = band_keys([a, b], 2000, 1)
    assert abs((keys[0] == keys[1]).mean() - 40 / 60) < 0.05


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1001 + i) for i in range(30)] + [(7, 7), (2000, 2000)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(1000, 1031), 1000), 2000: 2000}


def test_lines_fuzzy_and_equal(spark):
    long = "the quick brown elephant carries seventeen enormous suitcases across the crowded railway platform every single morning"
    docs = [
        (1, f"{long}\nsome other line here\n\n---"),
        (2, f"{long.replace('morning', 'mornings')}\nSome OTHER line, here!\n\n---\nonly in two"),
        (3, None),
        (4, ""),
        (5, "entirely different words stand upon this line without any resemblance"),
    ]
    got = {r.record.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1].text == docs[0][1] and got[1].removed == []
    assert got[2].text == "\n---\nonly in two" and got[2].removed == [0, 1] and got[2].n_lines == 5
    assert got[3].text is None and got[3].n_lines == 0 and got[4].text == "" and got[5].removed == []


def test_lines_against_brute_force(spark):
    """Groups are those of all pairs that the operator's own criteria link, whatever the bucket sizes."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 10))) for _ in range(300)]
    base = [[rng.choice(vocab) for _ in range(40)] for _ in range(8)]
    docs = []
    for k in range(60):
        lines = []
        for b in rng.sample(base, 3):
            w = list(b)
            if rng.random() < 0.6:
                w[rng.randrange(40)] = rng.choice(vocab)
            lines.append(" ".join(w))
        docs.append((k, "\n".join(lines)))

    def close(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return 10 * row[-1] <= max(len(x), len(y))

    got = {r.record.doc_id: r for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    kept = [(i, line) for i, text in docs for k, line in enumerate(text.split("\n")) if k not in got[i].removed]
    gone = [(i, line) for i, text in docs for k, line in enumerate(text.split("\n")) if k in got[i].removed]
    for line in {line for _, line in gone}:
        assert any(close(line, other) for _, other in kept) or any(close(line, other) for _, other in gone if other != line)
    assert len({line for _, line in kept}) == len(kept) <= 16


def test_lines_equal_all_pairs(spark):
    """Every line within the permitted edits of another goes: one word or the most allowed, in a large bucket, short, or without blanks."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    lines, gone = [], 0
    for n, copies in ((60, 12), (20, 6), (8, 3)):
        for _ in range(3):
            base = [word() for _ in range(n)]
            lines.append(" ".join(base))
            for c in range(copies):
                copy = list(base)
                for k in rng.sample(range(n), n * 15 // 100 if c else 1):
                    copy[k] = word() + "x"
                lines.append(" ".join(copy))
                gone += 1
    lines += ["to be or not so", "to be or not sa", "一二三四五六七八九十甲乙丙丁", "一二三四五六七八九十甲乙丙戊", "of it", "of us"]
    docs = [(1, "\n".join(lines))]
    removed = dedup_lines(spark.createDataFrame(docs, DOCS)).first().removed
    assert len(removed) == gone + 2 and not {len(lines) - 1, len(lines) - 2} & set(removed)


def plain_groups(lines):
    """Components over all pairs of lines by the operator's definition, from plain edit distances."""
    words = [re.findall(r"[^\W_]+", x.lower()) for x in lines]
    parent = list(range(len(lines)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, b in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
        return row[-1]

    for i, x in enumerate(words):
        for j, y in enumerate(words[:i]):
            n = max(len(x), len(y))
            if x != y:
                if n < 4 or abs(len(x) - len(y)) > max(1, n * 15 // 100) or distance(x, y) > max(1, n * 15 // 100):
                    continue
                a, b = " ".join(x), " ".join(y)
                if n < 32 and 100 * distance(a, b) > (10 if n < 6 else 25) * max(len(a), len(b)):
                    continue
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(lines))]


def test_lines_groups_equal_all_pairs(spark):
    """Of each group of all pairs the first line stays: 3 to 60 words, one word replaced, added or left out, or several replaced."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    lines = []
    for n in (3, 4, 5, 6, 9, 12, 13, 14, 16, 19, 20, 27, 33, 60):
        for _ in range(4):
            base = [word() for _ in range(n)]
            lines.append(" ".join(base))
            for edit in range(6):
                copy, at = list(base), rng.randrange(n)
                if edit < 2:
                    copy[at] = word()
                elif edit == 2:
                    copy.insert(at, word())
                elif edit == 3:
                    del copy[at]
                else:
                    for k in rng.sample(range(n), max(1, n * 15 // 100)):
                        copy[k] = word()
                lines.append(" ".join(copy))
    removed = dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], DOCS)).first().removed
    assert removed == [i for i, r in enumerate(plain_groups(lines)) if r != i]


def test_one_edited_word_in_plain_vocabulary_is_found(spark):
    """Lines of few different words, 6 to 60 of them, one word replaced: nine in ten go at the least, and no other line."""
    rng = random.Random(22)
    vocab = "the of and to in was for that with his not had from her they were which their been one all there when would said what into more some could time only very like then other than".split()
    for n in (6, 12, 20, 60):
        bases = [[rng.choice(vocab) for _ in range(n)] for _ in range(60)]
        copies = [list(b) for b in bases]
        for c in copies:
            at = rng.randrange(n)
            c[at] = rng.choice([v for v in vocab if v != c[at]])
        lines = [" ".join(x) for x in bases + copies]
        removed = dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], DOCS)).first().removed
        assert removed == [i for i, r in enumerate(plain_groups(lines)) if r != i] and len(removed) >= 54


def test_long_lines_in_a_large_bucket(spark):
    """Long lines that end alike are one bucket; those within the edits go, the others and lines of few different words are told apart."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    end = [word() for _ in range(12)]
    bases = [[word() for _ in range(rng.randint(90, 200))] for _ in range(14)] + [["of"] * 100, ["of", "the"] * 60]
    lines = []
    for base in bases:
        lines.append(" ".join(base + end))
        copy = list(base)
        for at in rng.sample(range(len(copy)), (len(copy) + 12) * 15 // 100):
            copy[at] = word()
        lines.append(" ".join(copy + end))
    removed = dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], DOCS)).first().removed
    assert removed == [i for i, r in enumerate(plain_groups(lines)) if r != i] == list(range(1, len(lines), 2))


def test_long_lines_that_only_end_alike_are_no_candidates(spark, monkeypatch):
    """A large bucket of long lines without links: its pairs are ruled out where they meet and never become rows."""
    rng = random.Random(32)
    end = [f"e{k}" for k in range(12)]
    lines = [" ".join([f"{rng.randrange(10**6)}w" for _ in range(200)] + end) for _ in range(40)]
    rows, save = [], Scratch.save

    def counted(self, df, name="table"):
        out = save(self, df, name)
        rows.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    assert dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], DOCS)).first().removed == []
    assert len(rows) == 2 and rows[1] == 0


def test_very_long_lines(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, text), (2, text.replace("w77 ", "other ")), (3, text[: len(text) // 2])]
    got = {r.record.doc_id: r.removed for r in dedup_lines(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: [], 2: [0], 3: []}


def test_lines_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b\nc", 1, 2), (None, "a b", 3, 4), (2, "a b", 5, 6)], "doc_id long, text string, id int, removed int")
    rows = {r.record.doc_id: r.text for r in dedup_lines(df).collect()}
    assert rows == {None: "a b", 1: "c", 2: ""}
    assert dedup_lines(df.limit(0)).collect() == []


def test_lines_main_path_is_native(spark, capsys):
    df = spark.createDataFrame([(1, "a b\nc"), (2, "a b")], DOCS)
    dedup_lines(df).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def test_a_pair_of_many_common_buckets_meets_once(spark, monkeypatch):
    """Members of twelve common buckets: each pair becomes a row in one of them, and none is missing."""
    shared = spark.createDataFrame([(k, i, 20) for k in range(12) for i in range(20)], "key long, id long, n long")
    none, scratch, rows = spark.createDataFrame([], "id long, component long"), Scratch(spark), []
    distinct = type(shared).distinct
    monkeypatch.setattr(type(shared), "distinct", lambda self: rows.append(self.count()) or distinct(self))
    pairs = open_pairs(shared, none, lambda x, y: "true", [], lambda ids: scratch.save(ids.withColumn("more", F.lit(0))), scratch)
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(20) for a in range(b)}
    assert rows[-1] <= 19 * 19


def test_parities_and_sizes_rule_out_no_permitted_edit(spark):
    """Lines within the edits always pass; a line of more words that has too many others is told by its size as well."""
    rng = random.Random(41)
    rows = []
    for k in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 160))]
        copy, left = list(base), len(base) * 15 // 100
        for _ in range(left):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice(([], [copy[at], f"x{rng.randrange(400)}"], [f"x{rng.randrange(400)}"]))
        rows += [(2 * k, base), (2 * k + 1, copy)]
    end = [f"e{k}" for k in range(60)]
    rows += [(120, [f"a{k}" for k in range(12)] + end), (121, [f"b{k}" for k in range(8)] + end)]
    lines = spark.createDataFrame(rows, "id long, words array<string>").withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))
    bits = F.expr("aggregate(h, 0L, (s, x) -> s ^ shiftleft(1L, CAST(x & 63 AS INT)))")
    traits = lines.select("id", F.size("words").cast("long").alias("size"), bits.alias("bits"), F.lit(None).cast("string").alias("norm"))
    both = traits.join(parities(lines.select("id", word_string(F.col("h")).alias("code"))), "id")
    of = lambda name, odd: both.where(F.col("id") % 2 == odd).select(F.expr("id DIV 2").alias("pair"), F.struct("*").alias(name))
    found = {r.pair: r.near for r in of("x", 0).join(of("y", 1), "pair").select("pair", F.expr(near_by_more("x", "y")).alias("near")).collect()}
    assert all(found[k] for k in range(60)) and not found[60]


def test_links_of_open_buckets_are_one_row_for_each_member_and_component(spark, monkeypatch):
    """Members of a bucket in four components, each linked with all but one of the component beside: a row for each member and component."""
    shared = spark.createDataFrame([(1, i, 40) for i in range(40)], "key long, id long, n long")
    components = spark.createDataFrame([(i, i // 10 * 10) for i in range(40)], "id long, component long")
    scratch, rows = Scratch(spark), []
    distinct = type(shared).distinct
    monkeypatch.setattr(type(shared), "distinct", lambda self: rows.append(self.count()) or distinct(self))
    told = lambda ids: scratch.save(ids.withColumn("more", F.col("id") % 10))
    beside = lambda x, y: f"abs({x}.home - {y}.home) = 10 AND {x}.more <> {y}.more"
    links = open_pairs(shared, components, lambda x, y: "true", [], told, scratch, beside)
    assert {(r.a, r.b) for r in links.collect()} == {(0, 10), (10, 20), (20, 30)}
    assert rows[-1] <= 40 * 2


def test_two_components_of_a_bucket_are_compared_until_one_link_is_found(spark):
    """All of 20 and 5 members are linked: one pair decides, the exact test sees no other."""
    scratch, seen = Scratch(spark), "folio.test.compared."
    ids = [*range(20), *range(100, 105)]
    shared = scratch.save(spark.createDataFrame([(7, k, len(ids)) for k in ids], "key long, id long, n long"))
    components = spark.createDataFrame([(k, k // 100 * 100) for k in ids], "id long, component long")
    told = lambda ids: scratch.save(ids.withColumn("more", F.lit(0)))
    linked = lambda x, y: f"length(java_method('java.lang.System', 'setProperty', concat('{seen}', {x}.id, '-', {y}.id), '1')) >= 0"
    exact = lambda x, y: f"coalesce({linked(x, y)}, true)"
    links = open_pairs(shared, components, lambda x, y: "true", [], told, scratch, exact)
    assert [tuple(r) for r in links.collect()] == [(0, 100)]
    assert sum(str(k).startswith(seen) for k in spark._jvm.System.getProperties().stringPropertyNames()) == 1


def test_components_that_one_bucket_joins_are_linked_once(spark):
    """Of a bucket of twenty that are all alike nineteen links are found, not all pairs, and they hold it together."""
    shared = spark.createDataFrame([(1, i, 20) for i in range(20)], "key long, id long, n long")
    none, scratch = spark.createDataFrame([], "id long, component long"), Scratch(spark)
    alike = lambda x, y: "true"
    pairs = open_pairs(shared, none, alike, [], lambda ids: scratch.save(ids.withColumn("more", F.lit(0))), scratch, alike)
    assert pairs.count() == 19 and {r.component for r in connected_components(pairs, scratch).collect()} == {0}


def test_lines_and_keys_are_computed_once(spark):
    """What is exploded isn't computed once more by a filter that Spark infers from it."""
    docs = spark.createDataFrame([(1, "a b c d\ne f"), (2, None), (3, "")], "id long, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    lines = lines_of(docs)
    assert plan(lines).count("split(") == 1 and [(r.id, r.number, r.norm) for r in lines.collect()] == [(1, 0, "a b c d"), (1, 1, "e f")]
    keys = keys_of(lines.select("id", "norm")).collect()
    assert sorted(len(r["keys"]) for r in keys) == [0, 5]
