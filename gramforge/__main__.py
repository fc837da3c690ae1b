"""``python -m gramforge [FILE] [--out FOLDER] [--known TERM ...] [--setting value ...]``

Mines phrases from a file with one text per line, or from a random corpus if
none is named, and prints the leading rows or writes all of them. ``--positive``
and ``--negative`` replace the pattern sets, by name=expression, or choose one of
``SETS``; ``--removes`` and ``--unnecessary`` replace what is left out.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import patterns
from .plans.miner import PhraseMiner, ranked_order
from .sources import texts

SETTINGS = {"min_count": int, "min_length": int, "max_length": int, "weight_freq": float, "weight_len": float, "threshold_originality": float, "size_sentence": int, "selection": int, "verbose": int, "removes": str}
SETS = {
    "positive": {"default": patterns.positive_patterns, "documented": patterns.documented_positive, "notebook": patterns.notebook_positive},
    "negative": {"default": patterns.negative_patterns, "documented": patterns.documented_negative, "notebook": patterns.notebook_negative},
}


def pattern_set(kind: str, given: list[str]) -> dict[str, str]:
    """Patterns by name, of known sets and name=expression items, in their order."""
    out: dict[str, str] = {}
    for item in given:
        name, found, expression = item.partition("=")
        if not found and name not in SETS[kind]:
            raise SystemExit(f"--{kind} {item}: neither name=expression nor one of {', '.join(SETS[kind])}")
        out |= {name: expression} if found else SETS[kind][name]()
    return out


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gramforge", description=__doc__)
    parser.add_argument("file", nargs="?")
    parser.add_argument("--out", help="folder for the phrase table, as Parquet")
    parser.add_argument("--known", action="append", default=[], help="a known term; may be repeated")
    parser.add_argument("--rows", type=int, default=20)
    for name, kind in SETTINGS.items():
        parser.add_argument("--" + name.replace("_", "-"), type=kind)
    parser.add_argument("--unnecessary", action="append", help="an expression of junk, in place of the default ones; may be repeated")
    for kind, sets in SETS.items():
        parser.add_argument("--" + kind, action="append", help=f"{', '.join(sets)}, or name=expression; may be repeated")
    args = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("gramforge").getOrCreate()
    settings = {k: getattr(args, k) for k in SETTINGS if getattr(args, k) is not None}
    if args.unnecessary is not None:
        settings["unnecessary"] = tuple(args.unnecessary)
    for kind in SETS:
        if getattr(args, kind):
            settings[kind] = pattern_set(kind, getattr(args, kind))
    if settings.get("verbose"):
        logging.basicConfig(level=logging.INFO, format="%(message)s")
    if args.file:
        corpus = texts.read_tsv(spark, args.file).select(F.monotonically_increasing_id().alias("doc_id"), F.col("sentence").alias("text"))
    else:
        corpus = texts.random_corpus(spark)
    phrases = PhraseMiner(knowns=tuple(args.known), **settings).transform(corpus)
    if args.out:
        texts.write_phrases(phrases, args.out)
    else:
        ranked_order(phrases).select(*phrases.columns[:8]).show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
