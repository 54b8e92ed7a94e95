"""Report tables as files: one folder a window, one CSV a table."""

from __future__ import annotations

import html
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.ranks import top
from folio.operators import graphs, terms
from folio.plans import analysis as A

# Publication types that are study designs.
FIGURE_TYPES = ["Journal Article", "Case Reports", "Comparative Study", "Review", "Letter", "Comment", "Observational Study", "Multicenter Study", "Randomized Controlled Trial", "Clinical Trial", "Systematic Review", "Meta-Analysis", "Editorial"]

#: Table, order, limit and columns of each report.
REPORTS = {
    "temporal": ("temporal", ["year_int"], None),
    "authors_top": ("authors", ["-publications", "author_id"], A.TOP_AUTHORS),
    "journals_top": ("journals", ["-publications", "journal"], A.TOP_JOURNALS),
    "bradford_zones": ("bradford_zones", ["zone"], None),
    "bradford_curve": ("bradford_curve", ["rank"], None),
    "countries_top": ("countries", ["-publications", "country"], A.TOP_COUNTRIES),
    "keywords_top": ("keywords", ["-n", "term"], A.TOP_KEYWORDS),
    "mesh_top": ("mesh", ["-n", "term"], A.TOP_KEYWORDS),
    "institutions_top": ("institutions", ["-publications", "institution"], A.TOP_INSTITUTIONS),
    "languages": ("languages", ["-n", "code"], None),
    "pub_types": ("pub_types", ["-n", "publication_type"], None),
    "summary_stats": ("summary", ["metric"], None),
}


def report(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """One report: the table's first rows in a total order, numbered where it is cut."""
    table, order, limit = REPORTS[name]
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    df = tables[table]
    rows = df.orderBy(*columns) if limit is None else top(df.drop("rank"), limit, *columns)
    if {"citation_total", "publications"} <= set(rows.columns):
        known = F.col("n_cited_known") if "n_cited_known" in rows.columns else F.col("publications")
        rows = rows.withColumn("cites_per_pub", F.when(known > 0, F.bround(F.col("citation_total") / known, 1)))
    return rows.withColumnRenamed("year_int", "year")


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by semicolons, as CSV files need."""
    return df.select(*[F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_reports(tables: dict[str, DataFrame], folder: str, names: list[str] | None = None) -> None:
    """Small tables, one file each."""
    for name in names or list(REPORTS):
        flat(report(tables, name)).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Large tables stay Parquet, by window where they have one."""
    (df.write.mode("overwrite").partitionBy(by) if by else df.write.mode("overwrite")).parquet(path)


def write_manifest(spark: SparkSession, path: str, values: dict) -> None:
    """One JSON row of schema, query, window and counts; readers see the old one or the new one, never a part."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target, draft = jvm_path(path), jvm_path(f"{path}.{uuid.uuid4().hex}")
    spark.createDataFrame([(json.dumps(values, sort_keys=True, default=sorted),)], "value string").coalesce(1).write.text(draft.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    fs.rename(draft, target)


def comparison_markdown(tables: dict[str, DataFrame], limit: int = 20) -> str:
    """Two sources side by side, one section a table."""
    return "\n".join(markdown(df, name.capitalize(), limit) for name, df in tables.items())


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report's table as Markdown; ``limit`` rows are written, as the report says."""
    rows = df.limit(limit).collect()
    cells = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([f"# {title}", "", cells(df.columns), cells(["---"] * len(df.columns)), *map(cells, rows), ""])


def workbook(tables: dict[str, DataFrame], path: str, limit: int = 1000) -> None:
    """Sheets of the report tables in one file that spreadsheets open (XML spreadsheet), on the driver."""
    sheets = []
    for name in REPORTS:
        df = flat(report(tables, name)).limit(limit)
        line = lambda xs: "<Row>" + "".join(f'<Cell><Data ss:Type="String">{html.escape("" if x is None else str(x))}</Data></Cell>' for x in xs) + "</Row>"
        sheets.append(f'<Worksheet ss:Name="{name[:31]}"><Table>{line(df.columns)}{"".join(map(line, df.collect()))}</Table></Worksheet>')
    with open(path, "w", encoding="utf-8") as file:
        file.write('<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet">' + "".join(sheets) + "</Workbook>")


def figure(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The relation behind a figure; drawing is left to others."""
    order = lambda df, column, label, k: top(df.drop("rank"), k, F.desc_nulls_last(column), F.asc(label))
    figures = {
        "fig1": lambda: tables["temporal"].orderBy("year_int"),
        "fig2": lambda: order(tables["journals"], "publications", "journal", 20),
        "fig3_volume": lambda: order(tables["countries"], "publications", "country", 15),
        "fig3_citations": lambda: order(order(tables["countries"], "publications", "country", 15), "citation_total", "country", 15),
        "fig3_median": lambda: order(order(tables["countries"], "publications", "country", 15), "citations_median", "country", 15),
        "fig3_per_capita": lambda: tables["per_capita"],
        "fig4_volume": lambda: order(tables["authors"], "publications", "author_id", 20),
        "fig4_citations": lambda: order(order(tables["authors"], "publications", "author_id", 20), "citation_total", "author_id", 20),
        "fig5": lambda: order(tables["keywords"], "n", "term", 50),
        "fig6": lambda: order(tables["pub_types"].where(F.col("publication_type").isin(FIGURE_TYPES)), "n", "publication_type", len(FIGURE_TYPES)),
        "fig7": lambda: graphs.matrix(tables["country_nodes"], tables["country_edges"], "country", 20),
        "fig8": lambda: terms.trend_start(tables["keyword_trends"], tables["keyword_coverage"], "year_int", A.TREND_FLOOR),
        "fig4_median": lambda: order(order(tables["authors"], "publications", "author_id", 20), "citations_median", "author_id", 20),
        "fig10_nodes": lambda: graphs.figure_graph(tables["author_nodes"], tables["author_edges"], "author_id")[0].join(tables["authors"].select("author_id", "citation_total"), "author_id", "left").fillna(0, ["citation_total"]),
        "fig10_edges": lambda: graphs.figure_graph(tables["author_nodes"], tables["author_edges"], "author_id")[1],
        "fig12": lambda: tables["comparison"].orderBy("win_start"),
        "manuscript_yearly": lambda: tables["temporal"].select("year_int", "publications", "cumulative").orderBy("year_int"),
        "manuscript_families": lambda: tables["family_mix"].orderBy("year_int"),
        "manuscript_countries": lambda: order(tables["countries"].where("country <> 'Unknown'"), "publications", "country", 15),
        "fig9": lambda: order(tables["institutions"], "publications", "institution", 15).withColumn("mean_citations", F.bround(F.col("citations") / F.col("publications"), 2)),
        "fig11": lambda: tables["bradford_curve"],
    }
    return figures[name]()
