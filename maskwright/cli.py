"""Masks a folder of Parquet documents: ``spark-submit -m maskwright.cli INPUT -o OUT --key KEY``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from . import __version__
from .config import Config
from .plans.pipeline import Masker
from .operators.report import batch_summary, console, failures
from .sources import blocks, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright")
    p.add_argument("input", help="Parquet table with doc_id and text")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-c", "--config", help="file of settings, a name: value each line")
    p.add_argument("--key", help="the key that replacements depend on")
    p.add_argument("--dry-run", action="store_true", help="report what would be masked and stop")
    p.add_argument("--no-review", action="store_true", help="mask what needs review without asking")
    p.add_argument("--decisions", metavar="PATH", help="Parquet table of a reviewer's answers: doc_id, page, src_ord, answer (Y, N, A or S)")
    p.add_argument("--no-verify", action="store_true")
    p.add_argument("--save-registry", metavar="PATH")
    p.add_argument("--load-registry", metavar="PATH")
    how = p.add_mutually_exclusive_group()
    how.add_argument("-v", "--verbose", action="store_true", help="Spark's log from INFO on")
    how.add_argument("-q", "--quiet", action="store_true", help="print nothing but errors")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    # Without answers all fields that need review are masked: nothing stays in the open because nobody was asked.
    over = {"auto_approve": True, "verify": not a.no_verify} | ({"key": a.key} if a.key else {})
    masker = Masker(Config.load(a.config, **over) if a.config else Config(**over))
    spark = SparkSession.builder.getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.verbose else "ERROR" if a.quiet else "WARN")
    decisions = spark.read.parquet(a.decisions) if a.decisions and not a.no_review else None
    table = blocks.from_lines(spark.read.parquet(a.input))
    if a.dry_run:
        store.save_reports(masker.dry_run(table), a.output)
        return 0
    if decisions is None and not a.no_review:
        # What a reviewer may want to look at before the answers' table is made.
        masker.detect(table).filter("review_status = 'needs_review'").write.mode("overwrite").parquet(f"{a.output}/review")
    result = masker.run(table, decisions=decisions, known=store.load_registry(spark, a.load_registry) if a.load_registry else None)
    result.masked.write.mode("overwrite").parquet(f"{a.output}/masked")
    store.save_reports(result.reports, a.output)
    store.save_summary(batch_summary(result.reports, failures(spark.createDataFrame([], "document string, error string"))), a.output)
    result.verification.write.mode("overwrite").json(f"{a.output}/logs/verification")
    if a.save_registry:
        store.save_registry(result.registry, a.save_registry)
    if not a.quiet:
        print(console(result.reports, result.verification))
    return int(result.verification.filter(F.col("status") == "failed").limit(1).count() > 0)


if __name__ == "__main__":
    raise SystemExit(main())
