"""python -m tidewatch.cli --stage STAGE|all --root FOLDER --category NAME [--source PATH] [--labels PATH] [--start DAY] [--end DAY] [--no-texts]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewatch.plans import pipeline
from tidewatch.sources.reviews import Audit


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--stage", choices=[*pipeline.STAGES, "all"], required=True)
    p.add_argument("--root", required=True)
    p.add_argument("--category", required=True)
    for name in ("--source", "--labels", "--start", "--end"):
        p.add_argument(name)
    p.add_argument("--no-texts", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tidewatch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s = pipeline.Settings(a.root, a.category, a.start, a.end, not a.no_texts)
    for stage in pipeline.STAGES if a.stage == "all" else (a.stage,):
        if stage == "preprocess":
            audit = Audit()
            pipeline.run_preprocess(spark, s, a.source, audit)
            audit.write(s.path("audit.jsonl"))
        elif stage == "evaluate":
            if a.labels:
                pipeline.run_evaluate(spark, s, spark.read.parquet(a.labels)).show()
        else:
            getattr(pipeline, f"run_{stage}")(spark, s)
        print(f"{stage}: done")


if __name__ == "__main__":
    main()
