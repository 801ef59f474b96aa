"""python -m recordloom STAGE ROOT [--split S] [--config FILE] [--blockers LIST] [--score FEATURE] [--sample F] and others.

Exit codes: 0 done, 1 an input is missing or doesn't fit, 2 wrong arguments, 3 a submission that doesn't hold what it must."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import load_config
from .plans.jobs import Run, SubmissionError
from .sources.files import markdown_table

STAGES = ("prepare", "manifest", "postings", "candidates", "evaluate", "analyze", "calibrate", "statistics", "features", "train", "compare", "predict")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="recordloom")
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("root")
    parser.add_argument("--split")
    parser.add_argument("--config")
    parser.add_argument("--score", help="a feature to use as the score, instead of trees")
    parser.add_argument("--sample", type=float, default=1.0, help="share of entities to extract features for")
    parser.add_argument("--entities", default="auto", choices=("auto", "val", "all"), help="whose candidates to extract features for")
    parser.add_argument("--blockers", help="a comma list, over that of the settings")
    parser.add_argument("--kind", default="char", choices=("char", "token"), help="the blocker to calibrate")
    parser.add_argument("--budget", type=int, help="candidate rows beyond which a cell isn't retrieved")
    parser.add_argument("--against", action="append", default=[], metavar="NAME=ROOT", help="a run to compare with")
    parser.add_argument("--format", default="parquet", choices=("parquet", "tsv"), help="of the prepared table")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("recordloom").getOrCreate()
    over = {"blockers": [b.strip() for b in given.blockers.split(",") if b.strip()]} if given.blockers else {}
    run = Run(spark, given.root, load_config(given.config, over), given.format)
    split = given.split or ("test" if given.stage == "predict" else "train")
    more = {"features": {"sample": given.sample, "entities": given.entities}, "calibrate": {"kind": given.kind} | ({"budget": given.budget} if given.budget else {}), "train": {"score": given.score}, "predict": {"score": given.score}}.get(given.stage, {})
    try:
        if given.stage == "prepare":
            out = run.prepare((split,))
        elif given.stage == "manifest":
            out = run.manifest()
        elif given.stage == "compare":
            out = run.compare(dict(a.split("=", 1) for a in given.against), split)
        else:
            out = getattr(run, given.stage)(split, **more)
    except SubmissionError as e:
        print(e, file=sys.stderr)
        return 3
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    print(markdown_table(out) if isinstance(out, DataFrame) else out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
