"""Command line: ``python -m folio COMMAND ...`` screens, analyses and compares corpora of records."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import config, serve
from folio.operators import joins, screening
from folio.plans import analysis, reports, sensitivity
from folio.plans.windows import in_windows, inside
from folio.sources import dims
from folio.sources.records import read_ids, read_stage, read_works, read_xml, with_year, write_stage


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folio", description=__doc__)
    top.add_argument("--config", help="JSON file of settings")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict], help: str) -> None:
        sub = commands.add_parser(name, help=help)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    stage = ("--stages", {"required": True, "help": "folder of stage tables"})
    window = (("--start-year", {"type": int}), ("--end-year", {"type": int}), ("--period", {"default": "all_time", "help": "a window's name, or all"}))
    command("ingest", ("--xml", {"required": True}), stage, ("--ids", {"help": "keep only these ids"}), help="parse XML batches into the raw stage")
    command("screen", stage, ("--manual", {}), ("--out", {}), ("--strict", {"action": "store_true", "help": "exit 2 while records wait for screening"}), help="apply the screening rules")
    command("enrich", stage, ("--works", {}), ("--countries", {"required": True}), ("--citations", {"help": "CSV of doi, citations"}), ("--no-imputation", {"action": "store_true"}), help="identity, places and external data")
    lists = (("--aliases", {"required": True}), ("--populations", {"required": True}), ("--population-column", {"default": "population"}), ("--corrections", {"help": "CSV of pmid, author_id, institution"}), ("--out", {"required": True}))
    command("analyse", stage, *lists, ("--synonyms", {"help": "CSV of variant, canonical"}), *window, help="all tables of one or all windows")
    command("sensitivity", stage, *lists, ("--group", {"help": "CSV of author_id"}), ("--audit", {"help": "CSV of author_id"}), help="supplementary tables, for all years and a recent window")
    command("snapshot", stage, *lists, ("--synonyms", {"help": "CSV of variant, canonical"}), help="the numbers of a run as (metric, value)")
    command("delta", stage, ("--reference", {"required": True}), ("--out", {"required": True}), help="records added and removed against an id list")
    command("sample", stage, ("--size", {"type": int}), ("--seed", {"type": int}), ("--reference", {"help": "id list; also sample what it doesn't have"}), ("--out", {"required": True}), help="a random sample for hand screening")
    command("serve", ("--out", {"required": True, "help": "folder of results"}), ("--port", {"type": int, "default": 8765}), help="results and runs over HTTP, on this machine alone")
    command("diff", ("--old", {"required": True}), ("--new", {"required": True}), ("--out", {"required": True}), help="compare two snapshots of metrics")
    return top


def csv(df: DataFrame, path: str) -> None:
    reports.flat(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """0, or 2 if ``screen --strict`` leaves a queue."""
    settings = config.load(spark, args.config)
    if args.command == "serve":
        serve.server(serve.Service(spark, args.out, lambda argv: run(spark, parser().parse_args(argv))), args.port).serve_forever()
    if args.command == "diff":
        csv(joins.metric_diff(dims.read_csv(spark, args.old), dims.read_csv(spark, args.new)), args.out)
        return 0
    if args.command == "ingest":
        records = read_xml(spark, args.xml)
        write_stage(records.join(read_ids(spark, args.ids), "pmid", "left_semi") if args.ids else records, args.stages, "raw")
        reports.write_manifest(spark, f"{args.stages}/manifest", {"source": args.xml, "ids": args.ids, "settings": json.loads(settings.to_json()), "records": read_stage(spark, args.stages, ["raw"]).count()})
        return 0
    if args.command == "screen":
        manual = dims.manual_decisions(spark, args.manual) if args.manual else None
        done = screening.classify(read_stage(spark, args.stages, ["raw"]), manual).persist()
        write_stage(screening.kept(done).drop("relevance"), args.stages, "screened", "raw")
        log = screening.exclusion_log(done)
        if args.out:
            csv(log, f"{args.out}/exclusion_log")
            csv(screening.tally(log), f"{args.out}/exclusion_summary")
            csv(screening.screening_queue(log), f"{args.out}/screening_queue")
        return 2 if args.strict and not screening.screening_queue(log).isEmpty() else 0
    if args.command == "enrich":
        records = read_stage(spark, args.stages, ["raw", "screened"])
        works = read_works(spark, args.works) if args.works else None
        citations = dims.read_csv(spark, args.citations, "doi string, citations int") if args.citations else None
        ready = analysis.prepared(records, dims.gazetteer(spark, args.countries), impute_within=None if args.no_imputation else settings.impute_within, works=works, citations=citations)
        write_stage(ready, args.stages, "enriched", "screened")
        return 0
    records = with_year(read_stage(spark, args.stages, ["raw", "screened", "enriched"]))
    if args.command == "delta":
        csv(joins.delta(records, read_ids(spark, args.reference), "pmid"), args.out)
    elif args.command == "sample":
        tagged = screening.query_arms(records).select("pmid", "year", "journal", F.left("title", F.lit(200)).alias("title"), F.left("abstract", F.lit(300)).alias("abstract"), "arm")
        reference = read_ids(spark, args.reference) if args.reference else None
        chosen = settings.with_values(sample_size=args.size, seed=args.seed)
        csv(joins.sample(tagged, "pmid", chosen.sample_size, chosen.seed) if reference is None else joins.stratified_sample(tagged, reference, "pmid", chosen.sample_size, chosen.seed), args.out)
    else:
        lists = {"population": dims.populations(spark, args.populations, args.population_column), "aliases": dims.aliases(spark, args.aliases), "corrections": dims.corrections(spark, args.corrections) if args.corrections else None}
        if args.command == "sensitivity":
            named = {k: dims.author_group(spark, path) for k, path in (("group", args.group), ("audit", args.audit)) if path}
            sensitivity.write_all(records, args.out, settings.recent, **lists, **named)
            return 0
        lists["synonyms"] = dims.synonyms(spark, args.synonyms) if args.synonyms else None
        if args.command == "snapshot":
            csv(analysis.snapshot(analysis.run_analysis(records, **lists), windows=analysis.run_all_windows(records)["comparison"], provenance=analysis.provenance(records)), args.out)
            return 0
        rows = settings.with_values(start_year=args.start_year, end_year=args.end_year).windows()
        for name, start, end in rows if args.period == "all" else [r for r in rows if r[0] == args.period]:
            reports.write_reports(analysis.run_analysis(inside(records, "year_int", start, end), **lists), f"{args.out}/{name}")
        csv(analysis.run_all_windows(records, rows)["comparison"], f"{args.out}/period_comparison")
        csv(in_windows(records, "year_int", rows).groupBy("window").agg(F.count("*").alias("records")), f"{args.out}/windows")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return run(SparkSession.builder.appName("folio").getOrCreate(), args)


if __name__ == "__main__":
    raise SystemExit(main())
