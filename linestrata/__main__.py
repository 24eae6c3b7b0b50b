"""Command line: ``python -m linestrata --input='/var/log/*.log' --support=100``."""

from __future__ import annotations

import argparse
import logging
import logging.handlers
import sys

from pyspark.sql import SparkSession

from linestrata import __version__
from linestrata.functions.facilities import facility_number
from linestrata.operators.report import candidates_listed, report_lines, words_listed
from linestrata.plans.config import DEFAULT_SEPARATOR, ConfigError, MinerConfig
from linestrata.plans.miner import mine
from linestrata.plans.progress import Progress

log = logging.getLogger("linestrata")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("linestrata", description="Find patterns of words in log lines.", allow_abbrev=False)
    p.add_argument("--input", action="append", default=[], metavar="GLOB", help="files to read; may be repeated")
    p.add_argument("-s", "--support", default="0", help="lines that a pattern must cover; with %% at its end a share of all lines")
    p.add_argument("--rsupport", type=float, default=0.0, help="the support in percent of all lines, unless one is given as a number")
    p.add_argument("-d", "--separator", default=DEFAULT_SEPARATOR, help="regular expression between words")
    p.add_argument("-b", "--byteoffset", type=int, default=0, help="bytes to drop at the start of each line")
    p.add_argument("-f", "--lfilter", help="only lines in which this is found have words")
    p.add_argument("-t", "--template", action="append", help="what a filtered line is rewritten to; $n is a group")
    p.add_argument("-v", "--wsize", type=int, default=0, help="slots of the word sketch")
    p.add_argument("-c", "--csize", type=int, default=0, help="slots of the candidate sketch")
    p.add_argument("-w", "--wtablesize", type=int, default=100_000, help="accepted, without effect")
    p.add_argument("-i", "--initseed", type=int, default=1, help="seed of the sketches' hash")
    p.add_argument("--wfilter", help="words that also count in a derived form")
    p.add_argument("--wsearch", help="what is replaced in them")
    p.add_argument("--wreplace", help="what it is replaced by")
    p.add_argument("-a", "--aggrsup", action="store_true", help="patterns take over the lines of more specific ones")
    p.add_argument("--wweight", type=float, default=0.0, help="join patterns at words of less weight")
    p.add_argument("--weightf", type=int, default=1, help="weight function, 1 or 2")
    p.add_argument("--detailtoken", action="store_true", help="brackets around single alternatives too")
    p.add_argument("-o", "--outliers", metavar="PATH", help="write lines without a pattern here")
    p.add_argument("--outputmode", type=int, nargs="?", const=1, default=0, help="1: sort by the number of constants")
    p.add_argument("--debug", type=int, nargs="?", const=1, default=0, help="1: print words and candidates; 2, 3: progress by tenths of a stage or every five seconds")
    p.add_argument("--syslog", nargs="?", const="local2", help="messages go to syslog too")
    p.add_argument("--version", action="version", version=__version__)
    return p


def to_config(a: argparse.Namespace) -> MinerConfig:
    relative = a.support.endswith("%")
    return MinerConfig(
        inputs=tuple(a.input),
        support=0 if relative else int(a.support),
        rsupport=float(a.support[:-1]) if relative else a.rsupport,
        separator=a.separator,
        byteoffset=a.byteoffset,
        lfilter=a.lfilter,
        template=tuple(a.template) if a.template else None,
        word_sketch_size=a.wsize,
        cluster_sketch_size=a.csize,
        wtablesize=a.wtablesize,
        initseed=a.initseed,
        wfilter=a.wfilter,
        wsearch=a.wsearch,
        wreplace=a.wreplace,
        aggrsup=a.aggrsup,
        wweight=a.wweight,
        weightf=a.weightf,
        detailtoken=a.detailtoken,
        outliers=a.outliers,
        outputmode=a.outputmode,
        debug=a.debug,
        syslog=a.syslog,
    )


def set_up_log(syslog: str | None) -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.WARNING, format="%(asctime)s %(message)s")
    log.setLevel(logging.INFO)
    if syslog:
        facility = facility_number(syslog)
        if facility is None:
            raise ConfigError(f"unknown syslog facility {syslog}")
        try:
            log.addHandler(logging.handlers.SysLogHandler("/dev/log", facility=facility))
        except OSError as e:
            log.warning("no syslog: %s", e)


def run(spark: SparkSession, config: MinerConfig, out=sys.stdout) -> int:
    progress = Progress(spark, config.debug)
    with mine(spark, config) as result:
        with progress.phase("reading") as found:
            found |= {"lines": result.line_count, "support": result.support}
        with progress.phase("vocabulary") as found:
            found |= result.word_histogram.first().asDict()
        with progress.phase("frequent words") as found:
            found["frequent words"] = result.frequent_words.count()
        if not found["frequent words"]:
            return 0
        with progress.phase("candidates") as found:
            found["candidates"] = result.candidates.count()
        with progress.phase("clusters") as found:
            found["clusters"] = result.clusters.count()
        if config.debug == 1:
            for dump in (words_listed(result.frequent_words), candidates_listed(result.candidates)):
                for row in dump.toLocalIterator():
                    log.info("%s", row["value"])
        with progress.phase("report"):
            for row in report_lines(result.report.coalesce(1)).toLocalIterator():
                print(row["value"], file=out)
        if config.outliers:
            with progress.phase("outliers"):
                result.outliers.select("value").write.mode("overwrite").text(config.outliers)
        if config.debug:
            log.info("%s", result.stats())
    return 0


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a, unknown = p.parse_known_args(argv)
    for option in unknown:
        if not option.startswith("-"):
            p.error(f"unexpected argument {option}")
        print(f"unknown option {option}, ignored", file=sys.stderr)
    try:
        if not a.input:
            raise ConfigError("no input")
        config = to_config(a)
        set_up_log(config.syslog)
    except ValueError as e:
        p.print_usage(sys.stderr)
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("linestrata").getOrCreate()
    return run(spark, config)


if __name__ == "__main__":
    sys.exit(main())
