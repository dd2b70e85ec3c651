"""python -m strandloom.cli count | histo | dump"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .params import COUNT_LIMIT, CountParams
from .plans import count, dump, histo


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    top.add_argument("-V", "--version", action="version", version="strandloom 0.1")
    top.add_argument("--log", help="write the log to this file, not to stderr")
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("count", help="count k-mers of FASTA or FASTQ files")
    c.add_argument("files", nargs="+")
    c.add_argument("-k", "--kmer-len", type=int, required=True)
    c.add_argument("-o", "--out", default="./kmers.bin")
    kind = c.add_mutually_exclusive_group(required=True)
    kind.add_argument("--fa", dest="format", action="store_const", const="fasta")
    kind.add_argument("--fq", dest="format", action="store_const", const="fastq")
    c.add_argument("--gz", dest="compression", action="store_const", const="gzip", default="none")
    c.add_argument("--count-max", type=int, default=255)
    c.add_argument("--filter-min", type=int, default=2)
    c.add_argument("--filter-max", type=int, default=COUNT_LIMIT)
    c.add_argument("--strict", dest="mode", action="store_const", const="strict", default="compat")
    c.add_argument("-t", "--threads", default="*", help="cores of a local master")
    c.add_argument("-m", "--mem", help="driver memory, as Spark writes it; spilling is Spark's")
    c.add_argument("--bs", dest="piece_len", type=int, default=1000, help="bases in a piece of a long record")
    c.add_argument("--rt", help="accepted and not used: Spark schedules the readers")
    for name, what in (("histo", "histogram of a result"), ("dump", "text of a result")):
        p = commands.add_parser(name, help=what)
        p.add_argument("result")
        p.add_argument("-o", "--out", default=f"./{name}.txt")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(arguments)
    logging.basicConfig(filename=args.log, level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    if spark is None:
        builder = SparkSession.builder.appName("strandloom")
        if args.command == "count":
            builder = builder.master(f"local[{args.threads}]") if args.threads != "*" else builder
            builder = builder.config("spark.driver.memory", args.mem) if args.mem else builder
        spark = builder.getOrCreate()
    if args.command == "count":
        params = CountParams(args.kmer_len, args.filter_min, args.filter_max, args.count_max, args.piece_len)
        counted = count(spark, args.files, params, args.format, args.compression, args.mode)
        counted.raw.persist()
        from .sources import write_result

        write_result(counted.result, args.out, params, overwrite=True)
        for name, value in counted.stats.first().asDict().items():
            logging.info("%s: %d", name, value)
        counted.raw.unpersist()
    elif args.command == "histo":
        histo(spark, args.result, args.out)
    else:
        dump(spark, args.result, args.out)


if __name__ == "__main__":
    main()
