"""All analyses over a campaign's exports, each written as a parquet table."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from datetime import date
from hashlib import sha256
from typing import Any

from pyspark.sql import SparkSession

from streakline.plans.catalog import analyses
from streakline.plans.tables import CampaignTables, ExportTables
from streakline.plans.workspace import Workspace, shared_root
from streakline.sources import plan, readers, schemas
from streakline.sources.cleaning import null_scrub
from streakline.spec import CampaignSpec, PeriodSpec, numbered_tiers


def read_exports(
    spark: SparkSession,
    paths: dict[str, str],
    campaign: CampaignSpec,
    periods: PeriodSpec,
    id_prefix: str = "",
    fmt: str = "csv",
    multi_line: bool = False,
    space: Workspace | None = None,
    **own: Any,
) -> ExportTables:
    """Tables over the exports ``log``, ``coupons``, ``transactions`` and ``customers``.

    ``own`` holds what ``ExportTables`` takes of the campaign's own plan: reward_plan,
    check_days and margin_days.

    With a workspace, each export is parsed once and kept there with its types, the dated
    ones by day; without one, each report parses what it reads.
    """
    dated = {"log": "timestamp", "coupons": "timestamp", "transactions": "order_local_timestamp"}
    exports = {}
    for name in schemas.EXPORTS:
        kept = f"{name}_export"
        parse = space is None or kept not in space.done
        frame = readers.read_checked(spark, paths[name], name, fmt, multi_line) if parse else None
        if space is None:
            exports[name] = frame
        elif name in dated:
            exports[name] = space.by_day(kept, frame, dated[name])
        else:
            exports[name] = space.once(kept, frame)
    typed = {name: df.drop(readers.REJECTS, readers.RECORD, readers.FILE) for name, df in exports.items()}
    return ExportTables(
        spark=spark,
        log=readers.clean_log(typed["log"]),
        raw_log=typed["log"],
        coupons=null_scrub(typed["coupons"]),
        transactions=typed["transactions"],
        raw_customers=typed["customers"],
        campaign=campaign,
        periods=periods,
        id_prefix=id_prefix,
        space=space,
        exports=exports,
        **own,
    )


def write_reports(
    tables: CampaignTables, out: str, names: Iterable[str] = (), space: Workspace | None = None
) -> None:
    """Runs the named analyses, by default all, and writes each under its name.

    Reports that the workspace has as finished are not run again.
    """
    every = analyses()
    for name in names or every:
        if space is None or f"report_{name}" not in space.done:
            every[name](tables).write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
            if space is not None:
                space.record(f"report_{name}")


def run_name(argv: Iterable[str]) -> str:
    """The name of a run: the same arguments go on with what a failed run has finished."""
    return sha256("\0".join(sorted(argv)).encode()).hexdigest()[:16]


def main(argv: list[str] | None = None) -> None:
    day = date.fromisoformat
    parser = argparse.ArgumentParser(prog="streakline", description=__doc__)
    for name in ("log", "coupons", "transactions", "customers", "out"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("start", "end", "pre-start", "post-end"):
        parser.add_argument(f"--{name}", type=day, required=True)
    parser.add_argument("--format", default="csv")
    parser.add_argument("--id-prefix", default="")
    parser.add_argument("--reward-code", required=True, help="text that all reward codes hold")
    parser.add_argument("--tiers", help="CSV of code, tier, value; else the standard tiers, numbered")
    parser.add_argument("--rewards", help="CSV of date, type, code and amounts; else the standard calendar")
    parser.add_argument("--check-days", type=day, nargs="*", default=[], help="days whose hours are checked")
    parser.add_argument("--margin-days", type=int, default=13, help="days of orders around the campaign")
    parser.add_argument("--timezone", default="Europe/Amsterdam")
    parser.add_argument("--only", nargs="*", default=[])
    parser.add_argument("--multi-line", action="store_true", help="quoted values hold line breaks")
    parser.add_argument("--fresh", action="store_true", help="start over after a failed run")
    argv = sys.argv[1:] if argv is None else argv
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("streakline").getOrCreate()
    campaign = CampaignSpec(
        start=args.start,
        end=args.end,
        timezone=args.timezone,
        tiers=plan.read_tiers(spark, args.tiers) if args.tiers else numbered_tiers(args.reward_code),
        code_marker=args.reward_code,
    )
    periods = PeriodSpec(args.pre_start, args.start, args.end, args.post_end)
    paths = {name: getattr(args, name) for name in ("log", "coupons", "transactions", "customers")}
    root = shared_root(spark, f"{args.out.rstrip('/')}/_shared")
    run = run_name(a for a in argv if a != "--fresh")
    if args.fresh:
        Workspace(spark, root, run).close()
    space = Workspace(spark, root, run)
    tables = read_exports(
        spark,
        paths,
        campaign,
        periods,
        args.id_prefix,
        args.format,
        args.multi_line,
        space,
        reward_plan=plan.read_reward_days(spark, args.rewards) if args.rewards else (),
        check_days=tuple(args.check_days),
        margin_days=args.margin_days,
    )
    write_reports(tables, args.out, args.only, space)
    space.close()


if __name__ == "__main__":
    main()
