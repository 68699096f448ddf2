"""Command line: python -m linkwright --csv FILE --ats FILE --resume DIR --profiles FILE --store DIR --out DIR.

Exit codes: 0 if every entity is valid, 1 if one isn't, 2 if the run failed or
no source was named.  --out gets the folders candidates, possible_duplicates
(best first) and run_metadata, as JSON lines.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators.checkpoint import saved
from linkwright.operators.project import project
from linkwright.operators.store import Store
from linkwright.operators.suggest import ordered
from linkwright.plans.pipeline import all_records, run
from linkwright.sources.files import read_ats_json, read_profiles, read_recruiter_csv, read_resumes


def in_order(rows: DataFrame) -> DataFrame:
    """rows with ext_seq, gapless from 0 in the order read; the driver sees one count a partition."""
    kept = saved(rows.withColumn("_at", F.monotonically_increasing_id()), "read")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before[r["part"]], total = total, total + r["n"]
    base = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])[part] if before else F.lit(0)
    return kept.withColumn("ext_seq", base + place).drop("_at")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="linkwright", description="Link person records from several sources into entities.")
    for name, what in (("csv", "recruiter CSV"), ("ats", "ATS JSON"), ("resume", "folder of resume texts"), ("profiles", "fetched profiles, JSON lines"), ("config", "projection, a JSON file"), ("store", "folder where entities persist"), ("out", "folder for the results")):
        parser.add_argument(f"--{name}", help=what)
    parser.add_argument("--threshold", type=float, default=0.6, help="least score of a suggested duplicate")
    args = parser.parse_args(argv)
    if not (args.csv or args.ats or args.resume or args.profiles):
        print("name at least one source", file=sys.stderr)
        return 2
    try:
        spark = SparkSession.builder.getOrCreate()
        read = lambda f, path: in_order(f(spark, path)) if path else None
        csv = read(read_recruiter_csv, args.csv)
        if csv is None and not (args.ats or args.resume):
            csv = in_order(read_recruiter_csv(spark, "/nowhere"))
        records = saved(all_records(csv, read(read_ats_json, args.ats), read(read_resumes, args.resume), read_profiles(spark, args.profiles) if args.profiles else None), "records")
        result = run(records, Store(spark, args.store) if args.store else None, args.threshold)
        entities = saved(result.entities, "entities")
        output = saved(result.output, "output")
        invalid = output.filter(~F.col("valid")).count()
        stats = result.stats.first().asDict() | {"warnings": invalid}
        if args.out:
            config = None
            if args.config:
                config = json.loads("\n".join(r.value for r in spark.read.text(args.config, wholetext=True).collect()))
            (project(entities, config) if config else output).write.json(f"{args.out}/candidates", mode="overwrite")
            ordered(result.suggestions).write.json(f"{args.out}/possible_duplicates", mode="overwrite")
            spark.createDataFrame([stats]).coalesce(1).write.json(f"{args.out}/run_metadata", mode="overwrite")
        print(f"processed {stats['processed']}, entities {stats['merged']}, invalid {invalid}")
        return 1 if invalid else 0
    except Exception as e:  # the exit code tells; the message goes to the user
        print(f"failed: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
