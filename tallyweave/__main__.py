"""Command line: list the queries, run one, list profiles, show or check a rule file."""

from __future__ import annotations

import argparse
import sys

from .operators.rules import enabled_rules, rule_faults
from .session import local_session
from .sources.files import read_rules
from .sources.profiles import list_profiles


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyweave")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("target", help="folder for the result, as parquet")
    check = commands.add_parser("check", help="report faults of a rule file")
    check.add_argument("rules")
    show = commands.add_parser("rules", help="show the enabled rules of a rule file")
    show.add_argument("rules")
    profiles = commands.add_parser("profiles", help="names of the profiles in a folder")
    profiles.add_argument("root")
    args = parser.parse_args(argv)
    if args.command == "profiles":
        print("\n".join(list_profiles(args.root)))
        return 0
    from .plans import catalog

    queries = dict(catalog.QUERIES)
    if args.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    spark = local_session("*")
    if args.command == "run":
        if args.query not in queries:
            print(f"no query {args.query}", file=sys.stderr)
            return 2
        queries[args.query](spark, args.tables).write.mode("overwrite").parquet(args.target)
        return 0
    if args.command == "rules":
        for rule in enabled_rules(read_rules(spark, args.rules)).orderBy("rule_key").collect():
            print(f"{rule.id}\t{rule.name}")
        return 0
    faults = rule_faults(read_rules(spark, args.rules)).collect()
    for fault in faults:
        print(f"{fault.rule_key}: {fault.fault}")
    return 1 if faults else 0


if __name__ == "__main__":
    sys.exit(main())
