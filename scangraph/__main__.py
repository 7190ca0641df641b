"""Command line: flatten resolver output, build a graph, score it from blocklists."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scangraph.functions.suffixes import SuffixRules
from scangraph.plans.build import build_graph
from scangraph.plans.rank import run_experiment
from scangraph.sources.experiment import Experiment
from scangraph.sources.graph_files import write_graph
from scangraph.sources.resolver import flatten_answers, read_resolver_lines
from scangraph.sources.scans import DnsScan, TlsScan, ingest_scans
from scangraph.storage import Workspace, file_states, fingerprint


def _flag(text: str) -> bool:
    return text.lower() in ("1", "true", "yes")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scangraph", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    dns = jobs.add_parser("flatten-dns", help="resolver JSON lines to ip,domain pairs")
    dns.add_argument("--output", required=True)
    dns.add_argument("input")

    build = jobs.add_parser("build", help="scans to a graph")
    build.add_argument("--tls-scan", nargs=2, action="append", required=True, metavar=("DATE", "DIR"))
    build.add_argument("--dns-scan", nargs=3, action="append", required=True, metavar=("TYPE", "DATE", "FILE"))
    build.add_argument("--parsed-certs", nargs=2, action="append", default=[], metavar=("DATE", "FILE"),
                       help="certificates of a scan that were decoded before")
    build.add_argument("--suffix-list", required=True, help="the list of publicsuffix.org, as a file")
    build.add_argument("--url-lists", type=_flag, default=False, help="URLs of redirects also as lists of their edges")

    rank = jobs.add_parser("propagate", help="graph and blocklists to scores")
    rank.add_argument("--input-dir", required=True)
    rank.add_argument("--bidirectional", type=_flag, default=False)
    rank.add_argument("--epsilon", type=float, default=0.01)
    rank.add_argument("--degree", choices=["parallel", "distinct"], default="parallel", help="edges or neighbours to divide by")
    rank.add_argument("--max-iter", type=int, default=100)

    for job in (build, rank):
        job.add_argument("--cache-dir", required=True, help="folder for intermediate tables, shared by all executors")
        job.add_argument("--out", required=True)
        job.add_argument("--overwrite", type=_flag, default=False)
        job.add_argument("--parallelization", type=int, default=0, help="shuffle partitions, 0 for the session's")
        job.add_argument("--output-type", choices=["csv", "parquet"], default="parquet")
    return top


def main(arguments: list[str] | None = None) -> None:
    options = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"scangraph {options.job}").getOrCreate()
    if getattr(options, "parallelization", 0):
        spark.conf.set("spark.sql.shuffle.partitions", options.parallelization)

    if options.job == "flatten-dns":
        pairs = flatten_answers(read_resolver_lines(spark, options.input))
        pairs.select(F.col("ip"), "domain", "type").write.partitionBy("type").csv(options.output)
    elif options.job == "build":
        parsed = dict(options.parsed_certs)
        days = [day for day, _ in options.tls_scan]
        if len(parsed) < len(options.parsed_certs) or any(days.count(day) > 1 for day in parsed):
            raise SystemExit("--parsed-certs is told by its day: give one for a day with one scan")
        tls = [TlsScan(day, folder, parsed.get(day)) for day, folder in options.tls_scan]
        dns = [DnsScan(*scan) for scan in options.dns_scan]
        scans = ingest_scans(spark, tls, dns, options.cache_dir, options.overwrite)
        rules = SuffixRules.from_file(spark, options.suffix_list)
        sources = [options.suffix_list, *parsed.values(), *(d for _, d in options.tls_scan), *(f for *_, f in options.dns_scan)]
        states = [file_states(spark, source) for source in sources]
        run = fingerprint(options.tls_scan, parsed, options.dns_scan, states, options.url_lists)
        work = Workspace(spark, f"{options.cache_dir}/graph-{run}", resume=not options.overwrite)
        graph = build_graph(spark, scans, rules, work, options.url_lists)
        write_graph(graph, options.out, options.output_type, options.overwrite, made_from=run)
    else:
        experiment = Experiment.from_dir(spark, options.input_dir, options.bidirectional)
        run = fingerprint(options.input_dir, options.bidirectional, options.epsilon, options.max_iter, options.degree)
        work = Workspace(spark, f"{options.cache_dir}/propagation-{run}", resume=not options.overwrite)
        run_experiment(
            spark,
            experiment,
            options.out,
            epsilon=options.epsilon,
            max_iter=options.max_iter,
            degree=options.degree,
            output_type=options.output_type,
            overwrite=options.overwrite,
            work=work,
        )


if __name__ == "__main__":
    main()
