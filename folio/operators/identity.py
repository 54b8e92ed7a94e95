"""Author identity: constrained clustering of name occurrences, as edges between occurrences.

Whatever may link two occurrences is found by equi-joins: an id, a name, a shared co-author.  Where
the components of those links hold no contradiction they are the clusters.  Only in components
with one (two names of one paper, or first forenames that disagree) does the order of the links
matter; there they are taken one by one, a component a task, and those that contradict are left out.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import names as N
from folio.functions.rules import COMMON_SURNAMES
from folio.operators.graphs import components
from folio.operators.lineage import cut

#: Shared co-authors that merge; similarity of affiliations that merges with one shared co-author.
SHARED_COAUTHORS, AFFILIATION_JACCARD = 2, 0.35
COLLECTIVE = "__collective__"
#: Authors that a record has at most: an occurrence's number is its record's times this, and its place.
PLACES = 1 << 20
#: The order in which links are taken where it matters.
BY_ORCID, BY_ID, ACROSS_NAMES, WITHIN_NAME = range(4)
NAME_GROUP = ("last_norm", "letter", "form", "junior")
#: Groups that are Python objects at once.
GROUPS = 256


class Safelist:
    """Names known to be different people, as conditions; the lists are curated by hand, so they are literals of a plan.

    ``distinct``: (surname, form, form); ``juniors``: (surname, forename) of a father and a child;
    ``marked``: (surname, forename, words of an affiliation) that set one namesake apart.
    """

    def __init__(self, distinct: Iterable[tuple[str, str, str]] = (), juniors: Iterable[tuple[str, str]] = (), marked: Iterable[tuple[str, str, str]] = ()):
        self.distinct, self.juniors, self.marked = list(distinct), list(juniors), list(marked)

    @staticmethod
    def any_of(conditions: Iterable[Column]) -> Column:
        out = F.lit(False)
        for c in conditions:
            out = out | c
        return F.coalesce(out, F.lit(False))

    def apart(self, last: Column, a: Column, a_init: Column, b: Column, b_init: Column) -> Column:
        """Whether two forms of a surname (with their initials) are listed as two people."""
        is_form = lambda form, init, listed: (form == listed) | (init == listed)
        both = lambda x, y: (is_form(a, a_init, x) & is_form(b, b_init, y)) | (is_form(a, a_init, y) & is_form(b, b_init, x))
        return self.any_of((last == name) & both(x.lower(), y.lower()) for name, x, y in self.distinct)

    def is_junior(self, last: Column, fore: Column, init: Column, suffix: Column) -> Column:
        """An explicit junior suffix on a name that is listed as a father's and a child's."""
        name = F.array_join(N.without_suffixes(F.coalesce(fore, F.lit(""))), " ")
        listed = self.any_of((last == surname) & ((name == given.lower()) | (init == "".join(w[0] for w in given.lower().split()))) for surname, given in self.juniors)
        return N.says_junior(suffix) & listed

    def is_marked(self, last: Column, full: Column, affils: Column) -> Column:
        said = F.lower(F.array_join(affils, "\n"))
        return self.any_of((last == surname) & (full == given) & F.contains(said, F.lit(word)) for surname, given, word in self.marked)


def occurrences(records: DataFrame) -> DataFrame:
    """(rec_seq, pos, pmid, names, affils, orcid, oa_id, coauthors) of every author with a surname.

    Co-authors are the different (surname, initials) of the record but for the author's own.
    """
    each = records.select("rec_seq", "pmid", F.posexplode("authors").alias("pos", "a")).select("rec_seq", "pmid", "pos", "a.*").where("coalesce(last, '') <> ''")
    # Dealt out before names are taken apart: a file of few bytes may hold many records, and it is one task's.
    named = each.repartition("rec_seq").withColumns({
        "last_norm": N.surname(F.col("last")),
        "init": N.initials(F.col("fore"), F.col("initials")),
        "full": N.forename(F.col("fore")),
        "form": N.name_form(F.col("fore"), F.col("initials")),
        "affils": F.coalesce("affils", F.array().cast("array<string>")),
    })
    own = F.concat_ws("\t", "last_norm", "init")
    all_ = F.collect_set(own).over(Window.partitionBy("rec_seq"))
    columns = ("rec_seq", "pos", "pmid", "last", "fore", "initials", "suffix", "last_norm", "init", "full", "form", "affils", "orcid", "oa_id")
    return named.select(*columns, F.array_sort(F.array_except(all_, F.array(own))).alias("coauthors"))


def first_fit(parts: DataFrame, group: tuple[str, ...], held: str) -> DataFrame:
    """(node, to): of each group's parts (in order of ``node``) the later ones with the first earlier one they fit.

    A part that fits none is one that later parts may fit.  ``held`` names the rule: "id" needs
    surnames that agree, equal flags, names not known as different people's (``known``, numbers of
    the safelist's entries of either side) and for common surnames places that don't conflict;
    "place" only the latter, and a part without a place takes the place of what joins it.
    Parts are the different spellings of one id or places of one name, not its occurrences.  Groups
    are small and many, so they go to Python many at once, not by a call each.
    """

    def fits(a: dict, b: dict) -> bool:
        clash = a["common"] and a["place"] and b["place"] and a["place"] not in b["place"] and b["place"] not in a["place"]
        if held == "place":
            return not clash
        names = a["last_norm"].endswith(b["last_norm"]) or b["last_norm"].endswith(a["last_norm"])
        known = {tuple(sorted((x, y))) for x in a["known"] for y in b["known"] if x != y and x // 2 == y // 2}
        return bool(names and a["junior"] == b["junior"] and a["marked"] == b["marked"] and not known and not clash)

    def one(rows: list[dict]) -> list[tuple[int, int]]:
        kept, out = [], []
        for part in sorted(rows, key=lambda r: r["node"]):
            home = next((k for k in kept if fits(part, k)), None)
            if home is None:
                kept.append(part)
            else:
                out.append((part["node"], home["node"]))
                home["place"] = home["place"] or (part["place"] if held == "place" else None)
        return out

    def links(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = [link for at in range(0, batch.num_rows, GROUPS) for rows in batch.column(0).slice(at, GROUPS).to_pylist() for link in one(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["node", "to"])

    columns = [c for c in parts.columns if c not in group or c == "last_norm"]
    gathered = parts.groupBy(*group).agg(F.collect_list(F.struct(*columns)).alias("parts")).where(F.size("parts") > 1)
    return gathered.select("parts").mapInArrow(links, "node long, to long")


def star(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``to``, the first node of those that agree in ``keys`` (nulls are alike)."""
    return rows.withColumn("to", F.min("node").over(Window.partitionBy(*keys)))


def id_links(here: DataFrame, column: str, kind: int, strict: bool) -> DataFrame:
    """(kind, node, to) by a common id: what is spelled alike with the first such, and spellings by ``first_fit``."""
    alike = (column, "last_norm", "junior") + (("form", "marked", "place") if strict else ())
    spelled = star(here.where(F.coalesce(F.col(column), F.lit("")) != ""), alike)
    parts = spelled.where("node = to").select(column, "node", "last_norm", "junior", *(("marked", "place", "common", "known") if strict else (F.lit(False).alias("marked"), F.lit(None).cast("string").alias("place"), F.lit(False).alias("common"), F.array().cast("array<int>").alias("known"))))
    links = spelled.where("node <> to").select("node", "to").unionByName(first_fit(parts, (column,), "id"))
    return links.select(F.lit(kind).alias("kind"), "node", "to")


def name_groups(here: DataFrame) -> DataFrame:
    """A row for each surname, first letter, form and junior flag: its first occurrence and what its first affiliation says."""
    known = F.when(F.size("affils") > 0, F.struct("node", "affils", "place"))
    groups = here.groupBy(*NAME_GROUP).agg(F.min("node").alias("first"), F.min_by("node", F.struct("marked", "node")).alias("plain"), F.min("init").alias("init"), F.first("full").alias("full"), F.min(known).alias("own"), F.bool_and("marked").alias("only_marked"), F.first("common").alias("common"))
    return groups.select(*NAME_GROUP, "first", "plain", "init", "full", "only_marked", "common", N.affiliation_words(F.col("own.affils")).alias("words"), F.col("own.place").alias("place"))


def name_links(here: DataFrame, rules: Safelist) -> DataFrame:
    """(kind, node, to): pairs of name groups of one surname and letter that are one person's, by their first plain occurrences.

    Full forenames merge if one abbreviates the other; what they have in common then is the join's
    key.  Initials merge with what agrees with them and shares co-authors, which are the key.
    """
    groups = cut(name_groups(here))
    block = ("last_norm", "letter", "junior")
    side = lambda df, p: df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])
    same = lambda extra=(): [F.col(f"a_{c}") == F.col(f"b_{c}") for c in (*block, *extra)]

    def allowed(pairs: DataFrame) -> DataFrame:
        c = F.col
        apart = rules.apart(c("a_last_norm"), c("a_form"), c("a_init"), c("b_form"), c("b_init"))
        return pairs.where(~apart & ~N.institutions_conflict(c("a_place"), c("b_place")) & ~c("a_only_marked") & ~c("b_only_marked"))

    full = groups.where("full is not null").withColumn("outline", N.outline(F.col("full")))
    alike = side(full, "a").join(side(full, "b"), same(("outline",))).where("a_first < b_first")
    alike = allowed(alike.where(N.abbreviates(F.col("a_full"), F.col("b_full"))))
    with_ = here.select(*NAME_GROUP, F.explode("coauthors").alias("coauthor")).distinct()
    met = side(with_, "a").join(side(with_, "b"), same(("coauthor",))).where("a_form <> b_form and (a_form like '.%' or b_form like '.%')")
    met = met.groupBy(*[f"{p}_{c}" for p in "ab" for c in NAME_GROUP]).agg(F.count("*").alias("shared"))
    met = met.join(side(groups, "a"), [f"a_{c}" for c in NAME_GROUP]).join(side(groups, "b"), [f"b_{c}" for c in NAME_GROUP]).where("a_first < b_first")
    near = (F.col("shared") >= SHARED_COAUTHORS) | (~F.col("a_common") & (N.jaccard(F.col("a_words"), F.col("b_words")) >= AFFILIATION_JACCARD))
    met = allowed(met.where(N.initials_agree(F.col("a_init"), F.col("b_init")) & near))
    both = alike.select("a_plain", "b_plain").unionByName(met.select("a_plain", "b_plain"))
    return both.select(F.lit(ACROSS_NAMES).alias("kind"), F.col("b_plain").alias("node"), F.col("a_plain").alias("to"))


def group_links(here: DataFrame) -> DataFrame:
    """(kind, node, to) within a name group: one person, but for common surnames where places conflict, and but for marked ones."""
    keys = (*NAME_GROUP, "marked")
    split = F.when(F.col("common"), F.col("place"))
    placed = star(here.withColumn("spot", split), (*keys, "spot"))
    parts = placed.where("node = to and common").select(*keys, "node", "common", F.col("spot").alias("place"))
    links = placed.where("node <> to").select("node", "to").unionByName(first_fit(parts, keys, "place"))
    return links.select(F.lit(WITHIN_NAME).alias("kind"), "node", "to")


def settle(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """One component's clusters: its links in order, but those that put two names of a paper, or two first forenames, into one."""
    of = {n: n for n in rows["node"]}
    held = {n: ({n}, {p}, {f} - {""}) for n, p, f in zip(rows["node"], rows["pmid"], rows["given"], strict=True)}
    groups = rows.groupby("name")["node"].apply(list).to_dict()
    plain = dict(zip(rows["node"], rows["name"], strict=True))
    marked = set(rows["node"][rows["marked"]])
    block = rows.groupby("block")["node"].min().to_dict()
    spot = {n: block[b] for n, b in zip(rows["node"], rows["block"], strict=True)}

    def join(x: int, y: int) -> None:
        x, y = of[x], of[y]
        if x == y or held[x][1] & held[y][1]:
            return
        if any(not (a.startswith(b) or b.startswith(a)) for a in held[x][2] for b in held[y][2]):
            return
        if len(held[x][0]) > len(held[y][0]):
            x, y = y, x
        for some, more in zip(held[y], held.pop(x), strict=True):
            some |= more
        for n in held[y][0]:
            of[n] = y

    def order(link) -> tuple:
        return (link.kind, link.later, link.earlier) if link.kind < ACROSS_NAMES else (ACROSS_NAMES, spot[link.later], link.kind, link.earlier, link.later)

    for link in sorted(links.itertuples(index=False), key=order):
        if link.kind != ACROSS_NAMES:
            join(link.later, link.earlier)
            continue
        tops = lambda n: {of[k]: k for k in reversed(groups[plain[n]]) if k not in marked}.values()
        for x in tops(link.earlier):
            for y in tops(link.later):
                join(x, y)
    least = {c: min(members) for c, (members, _, _) in held.items()}
    return pd.DataFrame({"node": list(of), "least": [least[c] for c in of.values()]})


def clusters(occ: DataFrame, safelist: Safelist | None = None, common: Iterable[str] = COMMON_SURNAMES) -> DataFrame:
    """(rec_seq, pos, cluster, junior) of all occurrences; a cluster is named after its first one's place."""
    rules = safelist or Safelist()
    known = F.array(*[F.when((F.col("last_norm") == name) & ((F.col("form") == form.lower()) | (F.col("init") == form.lower())), F.lit(2 * i + side)) for i, (name, *two) in enumerate(rules.distinct) for side, form in enumerate(two)])
    here = occ.withColumns({
        "node": F.col("rec_seq") * PLACES + F.col("pos"),
        "letter": F.left("init", F.lit(1)),
        "junior": rules.is_junior(F.col("last_norm"), F.col("fore"), F.col("init"), F.col("suffix")),
        "marked": rules.is_marked(F.col("last_norm"), F.col("full"), F.col("affils")),
        "place": N.institution_key(F.col("affils")),
        "given": N.first_forename(F.col("full")),
        "common": F.col("last_norm").isin(list(common)),
        "known": F.array_compact(known).cast("array<int>"),
    })
    here = cut(here.withColumn("given", F.coalesce("given", F.lit(""))))
    links = id_links(here, "orcid", BY_ORCID, False).unionByName(id_links(here, "oa_id", BY_ID, True))
    links = cut(links.unionByName(name_links(here, rules)).unionByName(group_links(here)))
    home = components(links.select(F.col("node").alias("a"), F.col("to").alias("b")))
    placed = cut(here.join(home.select(F.col("id").alias("node"), "component"), "node").select("rec_seq", "pos", "node", "component", "pmid", "given", "marked", F.concat_ws("\t", *NAME_GROUP).alias("name"), F.concat_ws("\t", "last_norm", "letter").alias("block")))
    given = F.collect_set(F.when(F.col("given") != "", F.col("given")))
    per = placed.groupBy("component").agg(F.count("*").alias("n"), F.count_distinct("pmid").alias("papers"), F.min("node").alias("least"), given.alias("all"))
    longest = F.element_at(F.array_sort(F.transform("all", lambda g: F.struct(F.length(g).alias("n"), g.alias("g")))), -1)["g"]
    # One name is the start of the other for any two, if it is for each and the longest.
    sound = (F.col("n") == F.col("papers")) & ((F.size("all") == 0) | F.forall("all", lambda g: F.startswith(longest, g)))
    verdict = cut(per.select("component", "least", sound.alias("sound")))
    open_ = verdict.where(~F.col("sound")).select("component")
    # All members of two linked names are in one component, so a task has what it needs of both.
    inner = links.join(placed.select("node", "component"), "node").join(open_, "component").select(F.col("component").alias("home"), "kind", F.col("node").alias("later"), F.col("to").alias("earlier"))
    members = placed.join(open_, "component")
    settled = members.groupBy("component").cogroup(inner.groupBy("home")).applyInPandas(lambda m, k: settle(m, k), "node long, least long")
    least = placed.join(verdict.where("sound"), "component").select("node", "least").unionByName(settled)
    cluster = F.concat_ws(":", F.floor(F.col("least") / PLACES).cast("string"), (F.col("least") % PLACES).cast("string"))
    out = here.select("rec_seq", "pos", "node", "junior").join(least, "node", "left").withColumn("least", F.coalesce("least", "node"))
    return out.select("rec_seq", "pos", cluster.alias("cluster"), "junior")


def labels(occ: DataFrame, clustered: DataFrame, common: Iterable[str] = COMMON_SURNAMES) -> DataFrame:
    """(cluster, author_id): a name for each cluster, no two alike.

    The commonest surname with the initials of the longest forename that occurs twice with it, "Jr"
    for a junior, the institution for common surnames; of clusters that would share a name the
    largest keeps it and the others get their institution, forename or a number.
    """
    seq = F.struct("rec_seq", "pos")
    rows = occ.join(clustered, ["rec_seq", "pos"]).withColumn("seq", seq)
    given = F.coalesce(F.nullif(F.col("fore"), F.lit("")), "initials", F.lit(""))
    counts = rows.groupBy("cluster", "last", given.alias("given")).agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.first("last_norm").alias("last_norm"))
    by_n = Window.partitionBy("cluster").orderBy(F.desc("n"), "first")
    ranked = counts.withColumn("at", F.row_number().over(by_n))
    modal = ranked.where("at = 1").select("cluster", F.col("last").alias("best_last"), F.col("given").alias("best_given"), F.col("last_norm").alias("best_norm"))
    twice = F.max(F.col("n") >= 2).over(Window.partitionBy("cluster"))
    suffix = r"(?iu)\b(j[uú]nior|jr|filho|neto|sobrinho|senior|sr)\b"
    usable = ranked.withColumn("twice", twice).where("n >= 2 or not twice").join(modal, "cluster").where((F.col("last") == F.col("best_last")) & (F.col("given") != "") & ~F.rlike("given", F.lit(suffix)))
    longest = usable.groupBy("cluster").agg(F.max_by("given", F.struct(F.length("given"), -F.col("at"))).alias("long"))
    places = rows.where(F.size("affils") > 0).select("cluster", "seq", N.institution_key(F.slice("affils", 1, 1)).alias("place")).where("place is not null")
    spot = places.groupBy("cluster", "place").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))
    spot = spot.withColumn("at", nth).where("at = 1").select("cluster", F.initcap("place").alias("place"))
    size = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.min("seq").alias("first"), F.max("junior").alias("junior"))
    each = modal.join(longest, "cluster", "left").join(spot, "cluster", "left").join(size, "cluster")
    name = N.display_name(F.col("best_last"), F.col("long"), F.col("best_given"))
    name = F.concat(name, F.when(F.col("junior"), " Jr").otherwise(""))
    placed = F.col("best_norm").isin(list(common)) & F.col("place").isNotNull()
    each = each.withColumn("name", F.when(placed, F.concat(name, F.lit(" ("), "place", F.lit(")"))).otherwise(name))
    order = Window.partitionBy("name").orderBy(F.desc("size"), "first")
    each = each.withColumn("k", F.row_number().over(order))
    label = F.coalesce("place", F.concat(F.lit("#"), F.col("k").cast("string")))
    again = F.endswith("name", F.concat(F.lit("("), label, F.lit(")"))) | (F.row_number().over(Window.partitionBy("name", label).orderBy("k")) > F.when(F.min("k").over(Window.partitionBy("name", label)) == 1, 2).otherwise(1))
    fore = F.coalesce(F.nullif(F.col("best_given"), F.lit("")), F.concat(F.lit("#"), F.col("k").cast("string")))
    second = F.when(again, F.when(F.endswith("name", F.lit(")")), F.concat(F.expr("left(name, length(name) - 1)"), F.lit(", "), fore, F.lit(")"))).otherwise(F.concat("name", F.lit(" ("), fore, F.lit(")")))).otherwise(F.concat("name", F.lit(" ("), label, F.lit(")")))
    each = each.withColumn("candidate", F.when(F.col("k") == 1, F.col("name")).otherwise(second))
    still = F.row_number().over(Window.partitionBy("candidate").orderBy("k", "first"))
    return each.withColumn("still", still).select("cluster", F.when(F.col("still") > 1, F.concat("candidate", F.lit(" #"), F.col("k").cast("string"))).otherwise(F.col("candidate")).alias("author_id"))


def assign_author_ids(records: DataFrame, safelist: Safelist | None = None, common: Iterable[str] = COMMON_SURNAMES) -> DataFrame:
    """Records whose authors have an ``author_id``; those without a surname have the collective one."""
    occ = cut(occurrences(records))
    clustered = cut(clusters(occ, safelist, common))
    ids = clustered.join(labels(occ, clustered, common), "cluster").groupBy("rec_seq").agg(F.map_from_entries(F.collect_list(F.struct("pos", "author_id"))).alias("_ids"))
    both = records.join(ids, "rec_seq", "left")
    named = F.transform("authors", lambda a, i: a.withField("author_id", F.coalesce(F.element_at("_ids", i), F.lit(COLLECTIVE))))
    return both.withColumn("authors", named).drop("_ids")


def rule_off_comparison(records: DataFrame, safelist: Safelist | None = None) -> DataFrame:
    """What becomes of each author if no surname counts as common: authorships, and the commonest label then."""
    from folio.operators.joins import modal_of_other_run

    runs = []
    for common in (COMMON_SURNAMES, ()):
        named = assign_author_ids(records, safelist, common).select("rec_seq", F.posexplode("authors").alias("pos", "a"))
        runs.append(named.select("rec_seq", "pos", F.col("a.author_id").alias("author_id")).where(F.col("author_id") != COLLECTIVE))
    return modal_of_other_run(runs[0], runs[1], ("rec_seq", "pos"), "author_id")


def disagreements(authorship: DataFrame) -> DataFrame:
    """Identity against external ids: agree, split (one id, several people here) or merged (several ids, one person)."""
    both = authorship.where("author_id is not null and oa_id is not null").groupBy("author_id", "oa_id").agg(F.count("*").alias("n"))
    ids = both.groupBy("author_id").agg(F.count("*").alias("n_ids"))
    people = both.groupBy("oa_id").agg(F.count("*").alias("n_people"))
    verdict = F.when((F.col("n_ids") == 1) & (F.col("n_people") == 1), "agree").when(F.col("n_people") > 1, "split").otherwise("merged")
    return both.join(ids, "author_id").join(people, "oa_id").select("author_id", "oa_id", "n", "n_ids", "n_people", verdict.alias("verdict"))
