"""Screening by ordered rules, each decision with the rule that made it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import rules as R


def rx(pattern: str) -> Column:
    return F.lit("(?iU)" + pattern)


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def many(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def first_rule(value: Column, rules: list[tuple]) -> Column:
    """The id of the first rule whose pattern the value has; null if none.

    A rule is (id, pattern) or (id, pattern, text that every match has), which is looked for first.
    """

    def applies(pattern: str, must: str | None = None) -> Column:
        has = F.rlike(value, rx(pattern))
        return has if must is None else F.contains(value, F.lit(must)) & has

    return F.coalesce(*[F.when(applies(*rest), F.lit(rule)) for rule, *rest in rules])


def any_matches(values: Column, pattern: str) -> Column:
    return F.exists(values, lambda v: F.rlike(v, rx(pattern)))


def first_rule_of_any(values: Column, rules: list[tuple[str, str]]) -> Column:
    """As ``first_rule``, where any of an array's values may have the pattern."""
    return F.coalesce(*[F.when(any_matches(values, p), F.lit(rule)) for rule, p in rules])


def classify(records: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Adds ``relevance``: struct(keep, stage, rule, detail, flags). The first rule that applies decides.

    Manual decisions go first, then notices, the journal and heading stop-lists (unless the journal is
    of the field or the title names a procedure), the procedure and field terms, the therapeutic
    procedure, and screening of what other journals say without naming a procedure.
    """
    title, both = text("title"), F.concat_ws(" ", text("title"), text("abstract"))
    journal, mesh = F.concat_ws(" ", text("journal"), text("journal_abbr")), many("mesh")
    words = F.concat_ws(" ", F.concat(many("keywords"), many("keywords_nlm")))
    has = lambda value, pattern: F.rlike(value, rx(pattern))
    any_ = lambda pattern: F.exists(mesh, lambda m: F.rlike(m, rx(pattern)))
    hit = lambda value, pattern: F.regexp_extract(value, "(?iU)" + pattern, 0)
    allowed = has(journal, R.ALLOWED_JOURNAL) | F.coalesce(F.nullif(text("issn_linking"), F.lit("")), text("issn")).isin(R.ALLOWED_ISSN)
    if manual is None:
        out = records.withColumn("_manual", F.lit(None).cast("struct<decision: string, detail: string>"))
    else:
        detail = F.concat(F.coalesce("reason", F.lit("")), F.lit(" ["), F.coalesce("screened_by", F.lit("")), F.lit(" "), F.coalesce("date", F.lit("")), F.lit("]"))
        out = records.join(manual.select("pmid", F.struct(F.lower("decision").alias("decision"), F.trim(detail).alias("detail")).alias("_manual")), "pmid", "left")
    out = out.withColumns({
        "_notice": F.array_sort(F.array_intersect(many("pub_types"), F.array(F.lit("Published Erratum"), F.lit("Retraction of Publication")))),
        "_named": has(title, R.NAMED_PROCEDURE), "_allowed": allowed, "_ocular": any_(R.OCULAR_MESH),
        "_journal": first_rule(journal, R.JOURNAL_STOPS), "_mesh": first_rule_of_any(mesh, R.MESH_STOPS),
        "_text_signal": hit(both, R.SIGNAL), "_word_signal": hit(words, R.SIGNAL), "_mesh_signal": F.get(F.filter(mesh, lambda m: F.rlike(m, rx(R.MESH_SIGNAL))), F.lit(0)),
        "_field": hit(both, R.FIELD_TERM), "_word_field": has(words, R.FIELD_TERM),
    })
    named, allow, ocular = F.col("_named"), F.col("_allowed"), F.col("_ocular")
    no_text, in_words = F.col("_text_signal") == "", F.col("_word_signal") != ""
    in_mesh = (allow | ocular) & F.col("_mesh_signal").isNotNull()
    signal = F.when(~no_text, F.col("_text_signal")).when(in_words, F.col("_word_signal")).when(in_mesh, F.col("_mesh_signal"))
    no_field = F.col("_field") == ""
    flag = lambda condition, name: F.when(condition, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    early = F.concat(flag(named, "disease_in_title"), flag(allow, "ophthalmology_journal"))
    found = F.concat(early, flag(~F.coalesce("has_abstract", text("abstract") != ""), "no_abstract"))
    signalled = F.concat(found, flag(no_text & in_words, "procedure_signal_in_keywords_only"), flag(no_text & ~in_words & in_mesh, "no_procedure_signal_in_text"), flag(no_text & ~in_words & in_mesh, "procedure_signal_in_mesh_only"))
    vouched = F.when(named, "ophthalmic_term_absent_title_names_procedure").when(allow, "ophthalmic_term_absent_journal_vouches").when(ocular, "ophthalmic_term_absent_mesh_vouches").when(F.col("_word_field"), "ophthalmic_term_in_keywords_only")
    full = F.concat(signalled, F.when(no_field & vouched.isNotNull(), F.array(vouched)).otherwise(F.array().cast("array<string>")))
    screen = F.array(F.lit("screen"))

    def decide(keep: bool | Column, stage: str, rule: Column, detail: Column, flags: Column) -> Column:
        return F.struct((F.lit(keep) if isinstance(keep, bool) else keep).alias("keep"), F.lit(stage).alias("stage"), rule.alias("rule"), detail.alias("detail"), flags.alias("flags"))

    chosen = F.col("_manual.decision").isin("include", "keep", "in")
    none = F.array().cast("array<string>")
    queue = ~allow & ~has(both, R.NAMED_PROCEDURE)
    relevance = (
        F.when(F.col("_manual").isNotNull(), decide(chosen, "manual", F.when(chosen, "manual.include").otherwise("manual.exclude"), F.col("_manual.detail"), none))
        .when(F.size("_notice") > 0, decide(False, "content", F.lit("content.notice_not_publication"), F.array_join("_notice", "; "), none))
        .when(~allow & ~named & F.col("_journal").isNotNull(), decide(False, "screen", F.concat(F.lit("screen.stoplist_"), F.col("_journal")), journal, F.concat(early, screen)))
        .when(~named & ~ocular & F.col("_mesh").isNotNull(), decide(False, "screen", F.concat(F.lit("screen.stoplist_"), F.col("_mesh")), F.array_join(mesh, "; "), F.concat(early, screen)))
        .when(signal.isNull(), decide(False, "content", F.lit("content.no_procedure_signal"), F.lit("no laser refractive procedure term in title, abstract or keywords"), found))
        .when(no_field & vouched.isNull(), decide(False, "content", F.lit("content.no_ophthalmic_term"), F.lit("no ophthalmic term in title, abstract, keywords or MeSH"), signalled))
        .when(has(title, R.THERAPEUTIC) & ~has(both, R.REFRACTIVE), decide(False, "content", F.lit("content.ptk_only"), F.lit("phototherapeutic keratectomy with no refractive procedure or refractive error term"), full))
        .when(queue, decide(True, "screen", F.lit("screen.non_ophth_journal_no_disease_term"), F.concat(F.lit("signal='"), signal, F.lit("' ophth='"), F.col("_field"), F.lit("'")), F.concat(full, screen)))
        .otherwise(decide(True, "keep", F.lit("keep"), F.concat(F.lit("signal='"), signal, F.lit("' ophth='"), F.col("_field"), F.lit("'")), full))
    )
    return out.withColumn("relevance", relevance).select(*records.columns, "relevance")


def exclusion_log(classified: DataFrame) -> DataFrame:
    """One row for each record: its decision and the rule behind it."""
    r = "relevance"
    return classified.select("pmid", "year", "journal", F.left("title", F.lit(200)).alias("title"), F.when(F.col(f"{r}.keep"), "include").otherwise("exclude").alias("decision"), f"{r}.stage", F.col(f"{r}.rule").alias("rule_id"), f"{r}.detail", F.array_join(f"{r}.flags", "|").alias("flags"))


def tally(log: DataFrame) -> DataFrame:
    return log.groupBy("decision", "stage", "rule_id").agg(F.count("*").alias("n"))


def screening_queue(log: DataFrame) -> DataFrame:
    return log.where(F.array_contains(F.split("flags", r"\|"), "screen"))


def kept(classified: DataFrame) -> DataFrame:
    return classified.where("relevance.keep")


def procedure_families(records: DataFrame) -> DataFrame:
    """Adds ``families``: which procedure families a record names; ambiguous words count in context only."""
    whole = F.concat_ws(" ", text("title"), text("abstract"), F.concat_ws(" ", many("keywords")), F.concat_ws(" ", many("mesh")))

    def named(family: str, pattern: str) -> Column:
        hit = F.rlike(whole, rx(pattern))
        if family != "Lenticule extraction":
            return hit
        words = F.transform(F.regexp_extract_all(whole, rx(pattern), F.lit(0)), lambda w: F.lower(w))
        context = F.rlike(whole, rx(R.LENTICULE_CONTEXT))
        smile = F.forall(words, lambda w: w == "smile") & ~(F.contains(whole, F.lit("SMILE")) | context)
        return hit & ~smile & ~(F.forall(words, lambda w: w.isin("flex", "silk")) & ~context)

    tags = [F.when(named(f, p), F.lit(f)) for f, p in R.FAMILIES.items()]
    return records.withColumn("families", F.filter(F.array(*tags), lambda t: t.isNotNull()))


def family_mix(tagged: DataFrame, by: tuple[str, ...], families: list[str] | None = None) -> DataFrame:
    """Records, number and percent of each family, and those of none, by year or window."""
    names = families or list(R.FAMILIES)
    n = lambda f: F.count_if(F.array_contains("families", f))
    columns = [c for f in names for c in (n(f).alias(f"n_{f}"), F.bround(100 * n(f) / F.count("*"), 1).alias(f"pct_{f}"))]
    return tagged.groupBy(*by).agg(F.count("*").alias("records"), *columns, F.count_if(F.size("families") == 0).alias("none"))


def query_arms(records: DataFrame, arms: list[tuple[str, str]] = R.QUERY_ARMS, weak: str = R.WEAK_ARM, strong: list[str] = R.STRONG_ARMS, mesh: tuple[str, str] | None = R.MESH_ARM) -> DataFrame:
    """Adds ``arm``: the parts of the search that a record answers to, joined by "|"; the weak one only where no strong one does."""
    whole = F.concat_ws(" ", text("title"), text("abstract"), F.concat_ws(" ", many("keywords")))
    tags = [F.when(F.rlike(whole, rx(p)), F.lit(name)) for name, p in arms]
    if mesh:
        tags.append(F.when(F.array_contains(many("mesh"), mesh[1]), F.lit(mesh[0])))
    hits = F.filter(F.array(*tags), lambda t: t.isNotNull())
    said = F.arrays_overlap(hits, F.array(*[F.lit(s) for s in strong]))
    kept = F.when(said, F.array_except(hits, F.array(F.lit(weak)))).otherwise(hits)
    return records.withColumn("arm", F.when(F.size(kept) > 0, F.array_join(kept, "|")).otherwise("none_in_text"))
