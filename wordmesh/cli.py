"""Commands: lexicon, validatelexicon, truncate, stringcompare. ``python -m wordmesh.cli COMMAND --key value ...``"""

from __future__ import annotations

import logging
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordmesh.functions.hashing import name_hash
from wordmesh.operators import lexicon
from wordmesh.sources import dumps

COLLECTION = "wikipedia"


def parse_args(args: list[str]) -> dict[str, str]:
    """--key value pairs behind the command; a key that another key or nothing follows is 'true'."""
    out: dict[str, str] = {}
    rest = list(args[1:])
    while rest:
        key = rest.pop(0)
        if not key.startswith("--"):
            raise ValueError(f"a --key was expected, not {key}")
        out[key[2:]] = rest.pop(0) if rest and not rest[0].startswith("--") else "true"
    return out


def _path(args: dict[str, str]) -> str:
    return f"{args['dir'].rstrip('/')}/{name_hash(args.get('collection', COLLECTION))}"


def _sample(spark: SparkSession, args: dict[str, str]):
    field = args.get("field", "text")
    rows = dumps.read(spark, args["source"], [field], skip=int(args.get("skip", 0)))
    rows = rows.filter(F.trim(field) != "").select(F.col("line").alias("doc_id"), F.col(field).alias("text"))
    return rows.orderBy("doc_id").limit(int(args["take"])) if "take" in args else rows


def _drop(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))


def build_lexicon(spark: SparkSession, args: dict[str, str]) -> str:
    path = _path(args)
    if args.get("truncate") == "true":
        _drop(spark, path)
    lexicon.save(lexicon.build(_sample(spark, args)), path)
    return f"{lexicon.load(spark, path).count()} keys"


def validate_lexicon(spark: SparkSession, args: dict[str, str]) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(_path(args))
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no lexicon at {_path(args)}")
    stored = lexicon.load(spark, _path(args))
    good = lexicon.validate(_sample(spark, args), stored)
    gaps = lexicon.missing_angles(stored, lexicon.sample_angles(spark, 32)).count()
    made = lexicon.synthesize(spark, max(8, gaps)).select(F.col("id").alias("doc_id"), F.col("label").alias("text"))
    return f"valid {good.valid}, collisions {good.collisions}, lowest {good.lowest}; gaps {gaps} of 32; made-up words valid {lexicon.validate(made, stored).valid}"


def truncate(spark: SparkSession, args: dict[str, str]) -> str:
    return f"removed {_drop(spark, _path(args))}"


def string_compare(spark: SparkSession, args: dict[str, str]) -> str:
    rows = spark.createDataFrame([(0, args["string1"]), (1, args["string2"])], "id int, text string")
    found = {r.id: r.score for r in lexicon.compare_unit(rows, "id").collect()}
    return f"{found[0]} {found[1]}"


COMMANDS = {"lexicon": build_lexicon, "validatelexicon": validate_lexicon, "truncate": truncate, "stringcompare": string_compare}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    name = argv[0].lower() if argv else ""
    if name not in COMMANDS:
        print(f"unknown command {name!r}; there are {', '.join(COMMANDS)}", file=sys.stderr)
        return 2
    args = parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if "debug" in args else logging.WARNING)
    began = time.time()
    print(COMMANDS[name](spark or SparkSession.builder.appName(name).getOrCreate(), args))
    print(f"{time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
