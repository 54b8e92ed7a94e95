"""Joins that are more than an equality: positions, patterns, nearest times, differences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_works(records: DataFrame, works: DataFrame, fill: bool = False) -> DataFrame:
    """Records with what an external source knows of them, by pmid.

    Citation counts come from the source; without a match they are unknown, unless ``fill`` takes
    the second source's.  Authors are matched by position; unequal lengths are fine.
    """
    found = works.where("found").select("pmid", F.struct("*").alias("w"))
    both = records.join(found, "pmid", "left")
    hit = F.col("w").isNotNull()
    authors = F.transform(
        "authors",
        lambda a, i: a.withField("oa_id", F.get(F.col("w.authors"), i)["id"]).withField("oa_countries", F.get(F.col("w.authors"), i)["countries"]).withField("oa_insts", F.get(F.col("w.authors"), i)["insts"]),
    )
    second = F.col("citation_count_crossref") if fill else F.lit(None).cast("int")
    return both.withColumns({
        "oa_matched": hit,
        "citation_count": F.when(hit, F.col("w.cited_by")).otherwise(second),
        "citation_source": F.when(hit, "works").when(second.isNotNull(), "crossref"),
        "authors": F.when(hit, authors).otherwise(F.transform("authors", lambda a: a.withField("oa_insts", F.lit(None).cast("array<struct<ror: string, name: string, cc: string>>")))),
        "institutions_oa": F.when(hit, F.array_distinct(F.filter(F.flatten(F.transform("w.authors", lambda a: F.transform(a["insts"], lambda x: x["name"]))), lambda n: n.isNotNull()))),
    }).drop("w")


def with_citations(records: DataFrame, counts: DataFrame, exact_case: bool = True) -> DataFrame:
    """Citation counts by DOI; ``exact_case`` False compares lower-cased DOIs."""
    fold = (lambda c: F.col(c)) if exact_case else (lambda c: F.lower(c))
    known = counts.select(fold("doi").alias("_doi"), "citations").where("_doi <> ''").groupBy("_doi").agg(F.max("citations").alias("citation_count_crossref"))
    return records.drop("citation_count_crossref").withColumn("_doi", fold("doi")).join(known, "_doi", "left").drop("_doi")


def zipped(a: DataFrame, b: DataFrame, key: str, pos: str, same_length: bool = False) -> DataFrame:
    """Rows of ``a`` with those of ``b`` at the same position; ``same_length``: only where both have as many."""
    if same_length:
        n = a.groupBy(key).agg(F.count("*").alias("_na")).join(b.groupBy(key).agg(F.count("*").alias("_nb")), key).where("_na = _nb").select(key)
        b = b.join(n, key, "left_semi")
    return a.join(b, [key, pos], "left")


#: Aliases that one expression may hold.
ALIASES = 10_000


def best_alias(text: Column, aliases: DataFrame) -> Column:
    """struct(canonical, parent, cluster, tier, pattern) of the best alias that a text contains; null without one.

    The least tier wins, then the longest match, then the first alias listed.  The aliases (pattern,
    is_regex, tier, seq, ...) are a curated list of bounded size, so they are literals of one
    expression that moves no row; a text without any of a tier's aliases is passed over at once.
    """
    rows = aliases.orderBy("seq").limit(ALIASES + 1).collect()
    if len(rows) > ALIASES:
        raise ValueError(f"more than {ALIASES} aliases: split the list")
    lower = F.lower(text)
    fields = ("canonical", "parent", "cluster", "tier", "pattern")
    is_regex = lambda r: str(r["is_regex"]).lower() in ("1", "true", "yes")

    def candidate(r) -> Column:
        hit = F.regexp_extract(lower, f"(?U)({r['pattern']})", 0) if is_regex(r) else F.when(F.contains(lower, F.lit(r["pattern"].lower())), F.lit(r["pattern"].lower())).otherwise("")
        named = F.struct(*[F.lit(r[c]).alias(c) for c in fields])
        return F.when(hit != "", F.struct(F.length(hit).alias("n"), F.lit(-r["seq"]).alias("s"), named.alias("a")))

    tiers = {}
    for r in rows:
        tiers.setdefault(r["tier"], []).append(r)
    best = []
    for tier in sorted(tiers):
        any_ = "|".join(f"(?:{r['pattern']})" if is_regex(r) else re.escape(r["pattern"].lower()) for r in tiers[tier])
        best.append(F.when(F.rlike(lower, F.lit(f"(?U){any_}")), F.array_max(F.array(*[candidate(r) for r in tiers[tier]]))["a"]))
    return F.coalesce(*best) if best else F.lit(None).cast("struct<canonical: string, parent: string, cluster: string, tier: int, pattern: string>")


def resolve_by_pattern(texts: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """(text, canonical, parent, cluster, tier, pattern): the best alias of each different text, which is resolved once."""
    once = texts.select(text).where(F.col(text).isNotNull()).distinct()
    return once.select(text, best_alias(F.col(text), aliases).alias("a")).select(text, "a.*")


def at_level(level: str) -> Column:
    """A resolved name at canonical, parent (else canonical) or cluster (else parent, else canonical) level."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    order = {"canonical": ["canonical"], "parent": ["parent", "canonical"], "cluster": ["cluster", "parent", "canonical"]}[level]
    return F.coalesce(*[filled(c) for c in order])


def impute_nearest(slots: DataFrame, known: DataFrame, by: str, time: str, order: tuple[str, ...], slot: tuple[str, ...], within: int) -> DataFrame:
    """Each slot with the nearest known row of the same ``by``, at most ``within`` away; null without one.

    Equally near ones: the later, then the first in ``order``.  Times are cut into bins as wide as
    the reach, so a slot meets the known rows of three bins and not all of its group.
    """
    width = max(1, within)
    bins = F.floor(F.col(time) / width)
    left = slots.withColumn("_bin", F.explode(F.array(bins - 1, bins, bins + 1)))
    right = known.select(F.col(by), bins.alias("_bin"), F.struct("*").alias("donor"))
    gap = F.abs(F.col(time) - F.col(f"donor.{time}"))
    near = left.join(right, [by, "_bin"]).where(gap <= within)
    key = F.struct(gap.alias("gap"), (-F.col(f"donor.{time}")).alias("late"), *[F.col(f"donor.{c}").alias(f"o{i}") for i, c in enumerate(order)])
    best = near.groupBy(*slot).agg(F.min_by("donor", key).alias("donor"))
    return slots.join(best, list(slot), "left")


def impute_affiliations(authorship: DataFrame, within: int = 2) -> DataFrame:
    """Authorships with affiliations filled in from the same author's nearest year; filled ones are never donors."""
    has = F.coalesce(F.size("affils") > 0, F.lit(False))
    donors = authorship.where(has & F.col("author_id").isNotNull() & (F.coalesce("affil_source", F.lit("")) != "imputed")).select("author_id", "year_int", "rec_seq", "pos", "affils")
    slots = authorship.where(~has & F.col("author_id").isNotNull()).select("author_id", "year_int", "rec_seq", "pos")
    filled = impute_nearest(slots, donors, "author_id", "year_int", ("rec_seq", "pos"), ("rec_seq", "pos"), within).where("donor is not null").select("rec_seq", "pos", "donor")
    both = authorship.join(filled, ["rec_seq", "pos"], "left")
    done = F.col("donor").isNotNull()
    return both.withColumns({
        "affils": F.when(done, F.col("donor.affils")).otherwise(F.col("affils")),
        "affil_source": F.when(done, "imputed").otherwise(F.col("affil_source")),
        "affil_imputed_from": F.when(done, F.col("donor.year_int").cast("int")).otherwise(F.col("affil_imputed_from")),
    }).drop("donor")


def imputation_summary(before: DataFrame, after: DataFrame, within: int = 2) -> DataFrame:
    """Window, slots without affiliation, slots filled and records touched."""
    blank = before.where(F.col("author_id").isNotNull() & ~F.coalesce(F.size("affils") > 0, F.lit(False))).agg(F.count("*").alias("author_slots_without_affiliation"))
    filled = after.where("affil_source = 'imputed'")
    return blank.crossJoin(filled.agg(F.count("*").alias("author_slots_imputed"))).crossJoin(filled.select("rec_seq").distinct().agg(F.count("*").alias("records_touched"))).withColumn("window_years", F.lit(within))


def correct_institutions(resolved: DataFrame, authorship: DataFrame, corrections: DataFrame) -> DataFrame:
    """Curated institutions of (pmid, author_id) go first and supersede guesses of the fallback.

    ``resolved`` has a row for each institution of an author, in ``order`` from 0, with ``matched_by``;
    several corrections of one author are several institutions, in order of name.
    """
    key = ["pmid", "author_id"]
    fixed = corrections.groupBy(*key).agg(F.array_sort(F.collect_set("institution")).alias("_fixed"))
    both = resolved.join(fixed, key, "left")
    kept = both.where(F.col("_fixed").isNull() | (F.coalesce("matched_by", F.lit("")) != "fallback")).withColumn("order", F.col("order") + F.coalesce(F.size("_fixed"), F.lit(0)))
    curated = authorship.join(fixed, key).select("*", F.posexplode("_fixed").alias("order", "canonical")).withColumn("matched_by", F.lit("curated"))
    return kept.drop("_fixed").unionByName(curated.drop("_fixed"), allowMissingColumns=True)


def delta(current: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """(key, status): added, removed or unchanged against a reference list."""
    a, b = current.select(key).distinct().withColumn("a", F.lit(True)), reference.select(key).distinct().withColumn("b", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("unchanged").alias("status"))


def recall_gate(positives: DataFrame, corpus: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Known positives: whether the corpus has them and, if not, the rule that dropped them."""
    inside = corpus.select(key).distinct().withColumn("found", F.lit(True))
    both = positives.join(inside, key, "left").join(dropped.select(key, F.col("rule").alias("_rule")), key, "left")
    found = F.coalesce("found", F.lit(False))
    return both.withColumns({"found": found, "reason": F.when(found, None).otherwise(F.coalesce("_rule", F.lit("not retrieved")))}).drop("_rule")


def metric_diff(old: DataFrame, new: DataFrame, *others: tuple[str, DataFrame]) -> DataFrame:
    """(metric, old, new, others..., delta) of all metrics that any snapshot has."""
    out = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric", "full_outer")
    for name, frame in others:
        out = out.join(frame.select("metric", F.col("value").alias(name)), "metric", "full_outer")
    number = lambda c: F.col(c).try_cast("double")
    return out.withColumn("delta", F.bround(number("new") - number("old"), 6))


def yearly_diff(ours: DataFrame, theirs: DataFrame, year: str, large: int = 20) -> DataFrame:
    """Per year: both counts (0 where missing), their difference, and whether it is large."""
    both = ours.join(theirs, year, "full_outer").fillna(0, ["ours", "theirs"])
    return both.withColumn("difference", F.col("ours") - F.col("theirs")).withColumn("large", F.abs("difference") >= large)


def modal_of_other_run(a: DataFrame, b: DataFrame, key: tuple[str, str], name: str) -> DataFrame:
    """For each label of run ``a``: how many authorships, and the commonest label of run ``b`` on the same ones."""
    both = a.select(*key, F.col(name).alias("label")).join(b.select(*key, F.col(name).alias("other")), list(key))
    counts = both.groupBy("label", "other").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "other"))
    best = counts.withColumn("nth", nth).where("nth = 1").select("label", "other", F.col("n").alias("shared"))
    return both.groupBy("label").agg(F.count("*").alias("n")).join(best, "label")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Tables of different columns, one below the other."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows at random without replacement, the same for the same seed: those of least hash."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def stratified_sample(df: DataFrame, reference: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """(stratum, ...): ``n`` rows of the whole corpus and ``n`` of those that a reference list doesn't have."""
    added = df.join(reference.select(key).distinct(), key, "left_anti")
    return sample(df, key, n, seed).withColumn("stratum", F.lit("corpus")).unionByName(sample(added, key, n, seed).withColumn("stratum", F.lit("added")))


def comparable_journal(name: Column) -> Column:
    """A journal's name as two sources may both write it: lower case, cut at a bracket, without a last point."""
    return F.rtrim(F.trim(F.substring_index(F.lower(F.coalesce(name, F.lit(""))), "(", 1)), F.lit("."))


def ranked_side_by_side(ours: DataFrame, theirs: DataFrame, k: int) -> DataFrame:
    """(rank, ours, n_ours, theirs, n_theirs): the first ``k`` values of two counts (value, n), by rank."""

    def first(df: DataFrame, name: str) -> DataFrame:
        best = df.orderBy(F.desc("n"), "value").limit(k)
        return best.select(F.row_number().over(Window.orderBy(F.desc("n"), "value")).alias("rank"), F.col("value").alias(name), F.col("n").alias(f"n_{name}"))

    return first(ours, "ours").join(first(theirs, "theirs"), "rank", "full_outer")
