"""Fuzzy line deduplication in DataFrame operations only: pigeonhole blocks of words, edit similarity, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.components import connected_components
from folio.llm.linkage import first_pairs, open_pairs, shared_buckets
from folio.llm.runtime import Scratch

#: Percent of the longer line's words that may be edited (replaced, added or left out), one at least; shorter lines than LEAST are equal or not.
EDITS, LEAST = 15, 4
#: (words, percent): in lines of fewer words no more of the longer line's characters may be edited, either.
LETTERS = ((6, 10), (32, 25))
#: (words, length): from so many words on, a line's keys are blocks of so many words; below, it leaves out a word each time.
BLOCKS = ((14, 4), (20, 5))
#: Blocks that are counted from the end of the line as well.
BACK = 2
#: What a bucket's rows have of a line.
TRAITS = ["size", "bits", "norm"]
#: Longs of parities that lines have where whole buckets are compared: 64 bits say nothing of lines of a hundred words.
WIDE = 8
#: Letters of scripts that have no blanks between words: each is a word.
UNSPACED = r"฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"


def words_of(line: Column, unspaced: bool = True) -> Column:
    """The line's runs of letters and digits, lower-cased; letters of scripts without blanks one by one.

    ASCII lines have the same words by a pattern that costs a fraction.
    """
    pattern = rf"[{UNSPACED}]|[\p{{L}}\p{{N}}&&[^{UNSPACED}]]+" if unspaced else r"[\p{L}\p{N}]+"
    found = lambda by: F.regexp_extract_all(F.lower(line), F.lit(by), F.lit(0))
    return F.when(F.octet_length(line) == F.length(line), found("[a-z0-9]+")).otherwise(found(pattern))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, body, number, norm) of each line with a word: its words with a blank between them; ``body`` tells rows of one id apart.

    What belongs to a document is computed before its lines are dealt out, and no text is copied for
    every line.  Lines without a word are told by a pattern, so that no line is cut into words twice.
    The slower patterns are tried only where the text needs them.  Of an explode that isn't an outer
    one Spark infers a filter that computes what is exploded once more; here and below outer ones avoid that.
    """
    unspaced = (F.octet_length("text") > F.length("text")) & F.rlike("text", F.lit(f"[{UNSPACED[0]}-{UNSPACED[-1]}]")) & F.rlike("text", F.lit(f"[{UNSPACED}]"))
    each = docs.select("id", F.xxhash64("text").alias("body"), unspaced.alias("unspaced"), "text")
    each = each.select("id", "body", "unspaced", F.posexplode_outer(F.split("text", "\n", -1)).alias("number", "line")).where(F.rlike("line", F.lit(rf"[\p{{L}}\p{{N}}{UNSPACED}]")))
    line = F.col("line")
    words = F.when(F.col("unspaced"), words_of(line)).otherwise(words_of(line, False))
    return each.select("id", "body", "number", F.array_join(words, " ").alias("norm"))


def edits_of(size: Column) -> Column:
    """Words that may be edited where the longer line has ``size``."""
    return F.when(size < LEAST, 0).otherwise(F.greatest(F.lit(1), F.floor(size * EDITS / 100)))


def block_keys(length: int) -> str:
    """SQL for the hashes of a line's blocks of ``length`` words: one more than may be edited from its start, BACK from its end.

    Blocks are cut by one pattern (each where the last one ended, so that no place is tried twice) and hashed as strings.
    """
    blocks = rf"regexp_extract_all(concat(norm, ' '), '\\G{'[^ ]++ ' * length}', 0)"
    front = f"transform(slice({blocks}, 1, CAST(edits AS INT) + 1), (s, b) -> xxhash64({length}, b, s))"
    back = ", ".join(f"xxhash64({length}, {-b}, substring_index(substring_index(norm, ' ', {-length * b}), ' ', {length}))" for b in range(1, BACK + 1))
    return f"concat({front}, array({back}))"


def keys_of(lines: DataFrame) -> DataFrame:
    """(id, keys): the keys of each line of (id, norm).

    Where one edit is permitted, a line's keys are its words whole and without each word in turn:
    lines one edit apart share one.  Longer lines are cut into blocks, one more than the edits, so
    with words replaced one block at least stays as it is, at its place.  A word added or left out
    moves what comes after it; so blocks are counted from the end of the line, too.  A line whose
    partner may have more words gives that one's kind of keys as well.
    """
    sized = lines.withColumn("size", F.size(F.split("norm", " ")))
    # The longest partner of a line of n words: n' - n <= edits of n'.
    sized = sized.withColumns({"most": F.greatest(F.col("size") + 1, F.floor(F.col("size") * 100 / (100 - EDITS))), "edits": edits_of(F.col("size"))})
    one_less = "trim(concat(substring_index(norm, ' ', i), ' ', substring_index(norm, ' ', i + 1 - size)))"
    without = f"array_distinct(concat(array(xxhash64(0, norm)), transform(sequence(0, size - 1), i -> xxhash64(0, {one_less}))))"
    (few, short), (many, long) = BLOCKS
    kinds = [(f"size BETWEEN {LEAST - 1} AND {few - 1}", without), (f"most >= {few} AND size < {many}", block_keys(short)), (f"most >= {many}", block_keys(long))]
    keys = F.expr(f"concat({', '.join(f'IF({when}, {keys}, array())' for when, keys in kinds)})")
    return sized.select("id", keys.alias("keys"))


def letters_within(x: str, y: str, longer: str) -> str:
    """SQL for whether two lines' characters are within what lines of ``longer`` words allow."""
    percent = "CASE " + " ".join(f"WHEN {longer} < {below} THEN {some}" for below, some in LETTERS) + " END"
    return f"({longer} >= {LETTERS[-1][0]} OR levenshtein({x}, {y}, CAST(greatest(length({x}), length({y})) * {percent} DIV 100 AS INT)) >= 0)"


def near(x: str, y: str) -> str:
    """SQL for whether lines can be within the permitted edits; never false if they are.

    A word replaced changes two parities at most; one added or left out changes one, and the size.
    Lines of few words have their words with them: many such lines differ in one word, few of them
    as little as is permitted.
    """
    longer = f"greatest({x}.size, {y}.size)"
    edits = f"greatest(1, {longer} * {EDITS} DIV 100)"
    letters = letters_within(f"{x}.norm", f"{y}.norm", longer)
    return f"(abs({x}.size - {y}.size) <= {edits} AND bit_count({x}.bits ^ {y}.bits) + abs({x}.size - {y}.size) <= 2 * {edits} AND ({x}.norm IS NULL OR {y}.norm IS NULL OR {letters}))"


def word_string(hashes: Column) -> Column:
    """One character for each word (by its hash, to 40,000 of them), so that Levenshtein distances count words."""
    code = F.transform(hashes, lambda h: F.hex(F.pmod(h, F.lit(40_000)) + 0x1000))
    return F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE")


def parities(coded: DataFrame) -> DataFrame:
    """(id, w0, w1, ...) of (id, code): WIDE longs, for each of whose bits whether an odd number of the line's words has it by hash."""
    hashed = coded.select("id", F.transform(F.split("code", ""), lambda w: F.xxhash64(w)).alias("h"))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    mine = lambda i: F.filter("h", lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(WIDE - 1)) == i)
    return hashed.select("id", *[F.aggregate(mine(i), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(one(x))).alias(f"w{i}") for i in range(WIDE)])


def near_by_more(x: str, y: str) -> str:
    """``near`` with the lines' further parities; never false for lines within the permitted edits, either."""
    edits = f"greatest(1, greatest({x}.size, {y}.size) * {EDITS} DIV 100)"
    parted = " + ".join(f"bit_count({x}.w{i} ^ {y}.w{i})" for i in range(WIDE))
    return f"({near(x, y)} AND {parted} + abs({x}.size - {y}.size) <= 2 * {edits})"


def within_edits(x: str, y: str, x_norm: str, y_norm: str) -> str:
    """SQL for whether lines, by their words as characters and the words themselves, are within the permitted edits."""
    longer = f"greatest(length({x}), length({y}))"
    words = f"levenshtein({x}, {y}, CAST(greatest(1, {longer} * {EDITS} DIV 100) AS INT)) >= 0"
    return f"IF({words}, {letters_within(x_norm, y_norm, longer)}, false)"


def traits_of(lines: DataFrame) -> DataFrame:
    """(key, size, bits, code, norm) of lines (key, norm): the number of words, 64 parities of their hashes, the words as
    characters, and, where characters count, the words themselves."""
    hashed = lines.select("key", "norm", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)).alias("h"))
    hashed = hashed.withColumn("size", F.size("h").cast("long"))
    bits = F.expr("aggregate(h, 0L, (s, x) -> s ^ shiftleft(1L, CAST(x & 63 AS INT)))")
    return hashed.select("key", "size", bits.alias("bits"), word_string(F.col("h")).alias("code"), F.when(F.col("size") < LETTERS[-1][0], F.col("norm")).alias("norm"))


def line_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, body, number, stays): each line that occurs again or resembles another, and the place (id, body, number) of the
    one that stays of its group.

    ``docs`` has id and text.  Lines belong together if they are equal when normalised, or, from LEAST
    words on, if at most EDITS percent of the longer line's words are edited, one at least (in lines of
    few words also at most so many of its characters as LETTERS says); and so do groups that such
    pairs connect.  Pairs are those that share a key; see ``keys_of``.  Of each group the first
    occurrence by (id, body, number) stays.  Lines are told apart by a 64-bit hash, words in edit
    distances by one of 40,000 characters.
    """
    whole = scratch.save_texts(lines_of(docs).select("id", "body", "number", F.xxhash64("norm").alias("key"), "norm"), "lines")
    place = F.struct("id", "body", "number")
    wide = scratch.save_texts(whole.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.any_value("norm").alias("norm")), "classes")
    lines = scratch.save_hashes(whole.select("id", "body", "number", "key"), "places")
    scratch.drop(whole)  # so that no line is held twice
    scratch.tidy()
    keys = keys_of(wide.select(F.col("key").alias("id"), "norm")).select(F.explode_outer("keys").alias("key"), "id").where("key IS NOT NULL")
    rows = scratch.save_hashes(shared_buckets(keys), "keys")
    scratch.tidy()
    # Most keys are one line's alone; only the lines that share one are prepared for all that comparisons ask for.
    wanted = rows.select(F.col("id").alias("key")).distinct()
    texts = scratch.save(traits_of(wide.select("key", "norm").join(wanted.hint("shuffle_hash"), "key", "left_semi")), "texts")
    classes = scratch.save_hashes(wide.drop("norm"), "classes")
    scratch.drop(wide)
    scratch.tidy()
    traits = texts.select(F.col("key").alias("id"), "size", "bits", F.when(F.col("size") < BLOCKS[0][0], F.col("norm")).alias("norm"))
    shared = scratch.save(rows.join(traits.hint("merge"), "id").select("key", "id", "n", "size", "bits", "norm"), "buckets")
    scratch.drop(rows)

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) within the permitted edits."""
        side = lambda c, x: texts.select(F.col("key").alias(c), F.col("code").alias(x), F.col("norm").alias(f"{x}_norm"))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        return scratch.save(both.where(within_edits("x", "y", "x_norm", "y_norm")).select("a", "b"), "links")

    def told(ids: DataFrame) -> DataFrame:
        """(id, w0, w1, ..., least_size, most_size, code, letters): the lines' further parities, their partners' sizes, and what decides."""
        size = F.col("size")
        reach = [(size - F.greatest(F.lit(1), F.floor(size * EDITS / 100))).alias("least_size"), F.greatest(size + 1, F.floor(size * 100 / (100 - EDITS))).alias("most_size")]
        mine = scratch.save(texts.select(F.col("key").alias("id"), *reach, "code", F.col("norm").alias("letters")).join(ids, "id", "left_semi"), "told")
        return scratch.save(parities(mine).join(mine, "id"), "parities")

    links = verify(scratch.save(first_pairs(shared, near, TRAITS), "pairs"))
    scratch.tidy()
    components = connected_components(links, scratch)
    exact = lambda x, y: within_edits(f"{x}.code", f"{y}.code", f"{x}.letters", f"{y}.letters")
    # Most pairs differ in size by more than is permitted; two comparisons say so.
    close = lambda x, y: f"({y}.size >= {x}.least_size AND {y}.size <= {x}.most_size AND {near_by_more(x, y)})"
    left = open_pairs(shared, components, close, TRAITS, told, scratch, exact)
    if not left.isEmpty():
        components = connected_components(links.unionByName(left), scratch)
    scratch.drop(shared, texts)
    scratch.tidy()
    named = classes.join(components.select(F.col("id").alias("key"), "component"), "key", "left").select("key", "first", "n", "component")
    # Only lines that occur again, or resemble another, can go.
    stays = named.where("component is not null").groupBy("component").agg(F.min("first").alias("stays"))
    again = named.where("component is null and n > 1").select("key", F.col("first").alias("stays"))
    again = again.unionByName(named.where("component is not null").join(stays, "component").select("key", "stays"))
    return lines.join(again, "key").select("id", "body", "number", "stays")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(record, text, n_lines, removed): the row whole, its text without the lines that occurred before, and those lines' numbers.

    Lines end at ``\\n``; those without a letter or digit always stay.  Null texts stay null, with
    no lines; empty ones stay empty.  Rows with equal id and text are one occurrence, so both keep
    their lines; null ids come first.  Columns of any name are carried in ``record``.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    groups = line_groups(source, scratch)
    gone = groups.where(F.col("stays") != F.struct("id", "body", "number"))
    gone = scratch.save(gone.groupBy("id", "body").agg(F.array_sort(F.collect_set("number")).alias("removed")), "gone")
    whole = docs.select(F.struct("*").alias("record"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("body"))
    gone = gone.select(F.col("id").alias("gone_id"), F.col("body").alias("gone_body"), "removed")
    both = whole.join(gone.hint("shuffle_hash"), (F.col("body") == F.col("gone_body")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    text = F.col("record")[text_col].cast("string")
    both = both.withColumn("lines", F.when(F.col("removed").isNotNull(), F.split(text, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    left = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    n = F.when(text.isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return both.select("record", left.alias("text"), n.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
