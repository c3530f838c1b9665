"""Run the reports over your own six tables.

    python -m clickpath.run --csv /data/extracts --out /data/reports            # every report
    python -m clickpath.run --parquet /lake/funnel --out /lake/reports --key q04_2_landing_funnel

CSV extracts are ingested like the original notebook (NULL markers, typed
casts, traffic channel before the 'none' fill, page name, gross profit);
Parquet folders are the six tables as written by
:func:`clickpath.sources.ingest.write_tables`. Each report is written to
``<out>/<key>`` as Parquet (or CSV with ``--format csv``); nothing is collected
to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from clickpath.plans import REGISTRY
from clickpath.plans.context import Funnel
from clickpath.plans.registry import ordered
from clickpath.sources.ingest import clean_tables, load_csv_tables
from clickpath.sources.tables import load_funnel_tables
from clickpath.spec import DEFAULT_SPEC, FunnelSpec


def report_keys() -> list[str]:
    """One key per report (fixture variants such as ``_b`` / ``_c`` are the same report)."""
    return sorted(k for k in REGISTRY if not (k[-2:] in ("_a", "_b", "_c") and k[:-2] in REGISTRY))


def run_reports(tables: dict, keys=None, spec: FunnelSpec = DEFAULT_SPEC, views: str | None = None) -> dict[str, DataFrame]:
    """Lazy report DataFrames over ``tables`` (six cleaned tables, plus optional ``raw_*``).

    With ``views``, a folder, the shared views are written there once and every report reads them.
    """
    if not any(k.startswith("raw_") for k in tables):
        tables = {**tables, **{f"raw_{k}": v for k, v in tables.items()}}
    funnel = Funnel(tables, spec)
    if views:
        funnel = funnel.materialize(views)
    return {k: ordered(k, REGISTRY[k][1](funnel)) for k in (keys or report_keys())}


def load_tables(spark: SparkSession, csv_dir: str | None = None, parquet_dir: str | None = None,
                case_insensitive: bool = False) -> dict:
    if csv_dir:
        raw = load_csv_tables(spark, csv_dir)
        out = clean_tables(raw, case_insensitive=case_insensitive)
        out.update({f"raw_{k}": v for k, v in raw.items()})
        return out
    return load_funnel_tables(spark, parquet_dir)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="folder with the six CSV extracts")
    src.add_argument("--parquet", help="folder with the six tables as Parquet sub-folders")
    ap.add_argument("--out", required=True, help="output folder, one sub-folder per report")
    ap.add_argument("--key", action="append", help="report key (repeatable); default: every report")
    ap.add_argument("--views", help="folder to store the shared views in, once, before the reports run")
    ap.add_argument("--input-bytes", type=int, help="size of the input; sets the settings for large inputs")
    ap.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    ap.add_argument("--case-insensitive", action="store_true", help="fold URL / UTM text case at ingest")
    args = ap.parse_args(argv)

    from clickpath.session import configure_for_scale, get_spark
    spark = get_spark()
    if args.input_bytes:
        configure_for_scale(spark, args.input_bytes)
    tables = load_tables(spark, args.csv, args.parquet, args.case_insensitive)
    for key, df in run_reports(tables, args.key, views=args.views).items():
        w = df.write.mode("overwrite").format(args.format)
        if args.format == "csv":
            w = w.option("header", True)
        w.save(f"{args.out.rstrip('/')}/{key}")


if __name__ == "__main__":
    main()
