"""Command line: ``spark-submit -m seqstats --root DATA JOB --name NAME ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from seqstats.operators.filters import ALPHA, MIN_DEV, MIN_GAMES, MIN_PLAYERS
from seqstats.operators.ks import EXACT_LIMIT
from seqstats.plans import jobs
from seqstats.sources.ledger import BUCKETS
from seqstats.sources.openings import read_openings
from seqstats.sources.stages import write_csv


def parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="seqstats")
    parser.add_argument("--root", required=True, help="data folder shared by all executors")
    sub = parser.add_subparsers(dest="job", required=True)
    for job in ("games", "players", "new-players", "probabilities", "countries", "distributions", "ks", "significant",
                "known-countries", "enrich", "opening-profile"):
        sub.add_parser(job).add_argument("--name", required=True)
    choose = sub.choices
    choose["games"].add_argument("--pgn", required=True)
    choose["games"].add_argument("--n", type=int, default=10, help="half-moves to match")
    for job in ("countries", "distributions", "ks"):
        choose[job].add_argument("--min-games", type=int, default=MIN_GAMES)
    choose["ks"].add_argument("--method", choices=("auto", "exact", "finite", "asymp"), default="auto")
    choose["ks"].add_argument("--exact-limit", type=int, default=EXACT_LIMIT)
    choose["significant"].add_argument("--alpha", type=float, default=ALPHA)
    choose["significant"].add_argument("--min-dev", type=float, default=MIN_DEV)
    choose["significant"].add_argument("--min-players", type=int, default=MIN_PLAYERS)
    choose["known-countries"].add_argument("--iso", required=True, help="CSV with ISO_A2, country, ISO_A3")
    choose["enrich"].add_argument("--features", required=True)
    choose["enrich"].add_argument("--out", required=True)
    choose["enrich"].add_argument("--moments")
    choose["enrich"].add_argument("--document", action="store_true", help="one document instead of lines")
    choose["new-players"].add_argument("--out", required=True, help="CSV folder for the schedule")
    choose["opening-profile"].add_argument("--opening", required=True)
    choose["opening-profile"].add_argument("--out", required=True, help="CSV folder for the points")
    merge = sub.add_parser("merge")
    merge.add_argument("--start", required=True)
    merge.add_argument("--end")
    for job in ("add-months", "withdraw-months"):
        sub.add_parser(job, help="keep the ledger of months").add_argument("--start", required=True)
        choose[job].add_argument("--end", help="last month, by default the first")
    choose["add-months"].add_argument("--buckets", type=int, default=BUCKETS, help="of the ledger's state, fixed by its first change")
    sub.add_parser("ledger-table", help="write the ledger's sums as a players' table").add_argument("--name", required=True)
    sub.add_parser("merge-profiles").add_argument("--responses", required=True, help="JSON lines with id and profile")
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(sys.argv[1:] if arguments is None else arguments)
    spark = SparkSession.builder.appName(f"seqstats {args.job}").getOrCreate()
    root = args.root

    def openings():
        return read_openings(spark, f"{root}/openings")

    if args.job == "games":
        jobs.run_games(spark, root, args.name, args.pgn, openings(), args.n)
    elif args.job == "players":
        jobs.run_player_openings(spark, root, args.name, openings())
    elif args.job == "merge":
        jobs.run_merge_months(spark, root, args.start, args.end)
    elif args.job == "add-months":
        jobs.run_add_months(spark, root, args.start, args.end, args.buckets)
    elif args.job == "withdraw-months":
        jobs.run_withdraw_months(spark, root, args.start, args.end)
    elif args.job == "ledger-table":
        jobs.run_ledger_table(spark, root, args.name)
    elif args.job == "new-players":
        write_csv(jobs.run_new_player_batches(spark, root, args.name), args.out)
    elif args.job == "merge-profiles":
        jobs.run_merge_profiles(spark, root, spark.read.json(args.responses))
    elif args.job == "probabilities":
        jobs.run_player_probabilities(spark, root, args.name)
    elif args.job == "countries":
        jobs.run_country_probabilities(spark, root, args.name, args.min_games)
    elif args.job == "distributions":
        jobs.run_distributions(spark, root, args.name, args.min_games)
    elif args.job == "ks":
        jobs.run_ks_test(spark, root, args.name, args.min_games, args.method, args.exact_limit)
    elif args.job == "significant":
        jobs.run_significant(spark, root, args.name, openings(), args.alpha, args.min_dev, args.min_players)
    elif args.job == "known-countries":
        jobs.run_known_countries(spark, root, args.name, spark.read.option("header", True).csv(args.iso))
    elif args.job == "enrich":
        jobs.run_feature_enrichment(spark, root, args.name, openings(), args.features, args.out, args.moments, args.document)
    elif args.job == "opening-profile":
        write_csv(jobs.run_opening_profile(spark, root, args.name, openings(), args.opening), args.out)
    if arguments is None:
        spark.stop()


if __name__ == "__main__":
    main()
