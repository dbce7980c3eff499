"""python -m proofmill.cli FILE... [outputs]: compile a database and write it."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .database import build, dump_program, load_program, read_replacements
from .plans.errors import ValidationError
from .plans.ir import Program
from .plans.parser import load_file


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="proofmill", description=__doc__)
    p.add_argument("inputs", nargs="+", help="source files; the first may be a dumped program (*.program)")
    p.add_argument("--parquet-output-directory")
    p.add_argument("--python-output-file", help="a typed module that reads the Parquet output")
    p.add_argument("--json-output-directory")
    p.add_argument("--sqlite-output-file")
    p.add_argument("--replacements-file")
    p.add_argument("--dump-source-file", help="writes the first input as parsed, before the others are added")
    p.add_argument("--show", action="store_true")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("proofmill").getOrCreate()
    try:
        first, *rest = args.inputs
        program = load_program(first) if first.endswith(".program") else load_file(Path(first), Program())
        if args.dump_source_file:
            dump_program(program, args.dump_source_file)
        for path in rest:
            load_file(Path(path), program)
        read_replacements(program, args.replacements_file)
        db = build(spark, program)
    except ValidationError as err:
        print(err, file=sys.stderr)
        return 1
    if db.edits:
        db.write_sources()
    if args.parquet_output_directory:
        db.write_parquet(args.parquet_output_directory)
    if args.python_output_file:
        db.write_module(args.python_output_file)
    if args.json_output_directory:
        db.write_json(args.json_output_directory)
    if args.sqlite_output_file:
        db.write_sqlite(args.sqlite_output_file)
    if args.show:
        db.show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
