"""``python -m ledgerline inspect PATH`` and ``retain PATH --keep N``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import retain, views
from .schema import LogError
from .sources import seglog


def inspect(spark: SparkSession, path: str) -> list[str]:
    """Lines of the report: the summary, every key of the index, and records of keys beyond it."""
    log = seglog.open_log(spark, path)
    rows = log.select("seq", "partition_key", "seg_base")
    s = views.summary(rows).first()
    torn = seglog.summaries(spark, path).agg(F.max("torn")).first()[0]
    out = [f"segments {s.segments} records {s.records} first {s.first_seq or 0} last {s.last_seq or 0}" + " torn tail" * bool(torn)]
    for r in views.capped_index(rows).orderBy("first_seq").collect():  # the index's cap bounds this
        if r.first_seq is not None:
            out.append(f"key {r.partition_key} first {r.first_seq} last {r.last_seq} records {r.records}")
        elif r.records:
            out.append(f"unknown {r.records}")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ledgerline")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("inspect").add_argument("path")
    keep = verbs.add_parser("retain")
    keep.add_argument("path")
    keep.add_argument("--keep", type=int, required=True, help="segments to keep")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("ledgerline").getOrCreate()
    try:
        if a.verb == "inspect":
            print("\n".join(inspect(spark, a.path)))
        else:
            limit = retain.mark(seglog.summaries(spark, a.path), a.keep).first().keep_from
            print(f"removed {seglog.retain(a.path, limit)}")
    except LogError as e:
        print(f"error {e.code}: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
