"""Command line: generate, publish, load, consume, check, contracts, build, query, status, acceptance.

    python -m millrace.cli generate --out DIR [--seed N --days N --scenario FILE --mode sequence|scale]
    python -m millrace.cli check EVENTS            exit 2 if a message breaks its contract
    python -m millrace.cli publish EVENTS TOPIC [--brokers SERVERS]      TOPIC is a folder without brokers
    python -m millrace.cli load EVENTS MANIFEST ROOT
    python -m millrace.cli consume TOPIC ROOT [--brokers SERVERS --group NAME --follow --latest]
    python -m millrace.cli contracts [--folder DIR]   versions and their compatibility, from JSON Schema files if given
    python -m millrace.cli build ROOT [--as-of TIME --strict]
    python -m millrace.cli query ROOT SQL          rows as JSON lines
    python -m millrace.cli status ROOT --out FILE   exit 1 if a window is broken
    python -m millrace.cli acceptance EVENTS MANIFEST ROOT --out FILE [--as-of TIME]   exit 1 if a rebuild grades differently
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from millrace.session import get_session


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="millrace")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, **options) -> None:
        made = sub.add_parser(name)
        for place in places:
            made.add_argument(place)
        for option, how in options.items():
            made.add_argument(f"--{option.replace('_', '-')}", **how)

    flag, needed = {"action": "store_true"}, {"required": True}
    command("generate", out=needed, seed={"type": int}, days={"type": int}, scenario={}, mode={"choices": ["sequence", "scale"]})
    command("check", "events")
    command("publish", "events", "topic", brokers={})
    command("load", "events", "manifest", "root")
    command("consume", "topic", "root", brokers={}, group={"default": "bronze"}, follow=flag, latest=flag)
    command("contracts", folder={})
    command("build", "root", as_of={}, strict=flag)
    command("query", "root", "sql")
    command("status", "root", out=needed)
    command("acceptance", "events", "manifest", "root", out=needed, as_of={})
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if args.command == "contracts":
        from millrace.operators import contracts

        print(contracts.report(contracts.read_folder(args.folder) if args.folder else None))
        return 0

    from millrace.plans import build as building
    from millrace.plans import ledger as led
    from millrace.sources import lake

    spark = get_session()
    if args.command == "generate":
        from millrace.plans.generate import SEQUENCE_DAYS, write_run
        from millrace.sources.plant import Scenario, load_scenario

        scenario = load_scenario(args.scenario) if args.scenario else Scenario()
        changes = {k: v for k, v in (("seed", args.seed), ("days", args.days)) if v is not None}
        scenario = dataclasses.replace(scenario, **changes)
        mode = args.mode or ("sequence" if scenario.days <= SEQUENCE_DAYS else "scale")
        print(json.dumps(write_run(spark, scenario, args.out, mode == "sequence")))
    elif args.command == "check":
        from millrace.operators.contracts import contract_check

        result = contract_check(lake.read_lines(spark, args.events))
        print(json.dumps(result))
        return 0 if result["ok"] else 2
    elif args.command == "publish":
        print(json.dumps(lake.publish(spark, args.events, args.topic, args.brokers)))
    elif args.command == "load":
        print(json.dumps(lake.load(spark, args.events, args.manifest, args.root)))
    elif args.command == "consume":
        from millrace.streaming import consumer

        if args.brokers:
            messages = consumer.kafka_topic(spark, args.brokers, args.topic, earliest=not args.latest)
        else:
            bound = consumer.BATCH_BYTES if args.follow else None
            messages = consumer.file_topic(spark, args.topic, max_bytes=bound, earliest=not args.latest)
        query = consumer.start(messages, args.root, args.group, bounded=not args.follow)
        consumer.run_until_signal(query)
        print(json.dumps(consumer.stats(query)))
    elif args.command == "query":
        lake.register_views(spark, args.root)
        for line in spark.sql(args.sql).toJSON().toLocalIterator():
            print(line)
    elif args.command == "acceptance":
        report = building.acceptance(spark, lambda to: lake.load(spark, args.events, args.manifest, to), args.root, args.as_of)
        with open(args.out, "w", encoding="utf-8") as f:
            json.dump(report, f, indent=1, default=str)
        print(json.dumps({"identical": report["identical"], "seconds": report["seconds"]}))
        return 0 if report["identical"] and not report["after"]["broken"] else 1
    elif args.command == "build":
        made = building.build(spark, args.root, args.as_of, strict=args.strict)
        print(json.dumps(led.grade(made["completeness_ledger"]).first().asDict()))
    else:
        data = building.gather(spark.read.parquet(f"{args.root}/warehouse/completeness_ledger"))
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(building.render(data))
        return 1 if data["by_status"].get("broken") else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
