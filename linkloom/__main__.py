"""Commands: scan, fix and cache. Exit codes: 0 clean, 1 findings or refusals, 2 usage, 3 environment."""

from __future__ import annotations

import argparse
import os
import sys
import time

CLEAN, FOUND, USAGE, ENVIRONMENT = 0, 1, 2, 3
#: What --min-confidence, --fail-on and --min-fix-confidence take.
CONFIDENCES = ("dead-certain", "likely-dead", "outdated", "auth-walled", "suspect")


class Usage(ValueError):
    """A setting that can't be used."""


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linkloom")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--verbose", action="count", default=0)
    p.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "fix"):
        c = commands.add_parser(name)
        c.add_argument("paths", nargs="*")
        c.add_argument("--stdin", action="store_true", help="more paths, one a line")
        c.add_argument("--include", action="append", default=[])
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--exclude-url", action="append", default=[])
        c.add_argument("--exclude-domain", action="append", default=[])
        c.add_argument("--no-local", action="store_true")
        c.add_argument("--observations", help="a Parquet table of recorded requests; without it URLs are requested")
        c.add_argument("--offline", action="store_true", help="judges local links only")
        c.add_argument("--max-concurrency", type=int)
        c.add_argument("--per-host", type=int)
        c.add_argument("--timeout")
        c.add_argument("--retries", type=int)
        c.add_argument("--user-agent")
        c.add_argument("--cache-ttl")
        c.add_argument("--no-cache", action="store_true")
        c.add_argument("--refresh", action="store_true")
        c.add_argument("--cookies", help="a JSON file of cookies")
        c.add_argument("--auth", choices=("off", "cookies", "browser"))
        if name == "scan":
            c.add_argument("--format", choices=("table", "json", "sarif"), default="table")
            c.add_argument("--json", action="store_true")
            c.add_argument("-o", "--output")
            c.add_argument("--min-confidence", default="suspect", choices=CONFIDENCES)
            c.add_argument("--fail-on", choices=CONFIDENCES)
        else:
            c.add_argument("--write", action="store_true")
            c.add_argument("--backup", action="store_true")
            c.add_argument("--copy", action="store_true")
            c.add_argument("--fix-exclude", action="append", default=[], choices=("pdf", "redirect", "url-upgrade"))
            c.add_argument("--min-fix-confidence", default="dead-certain", choices=CONFIDENCES)
    c = commands.add_parser("cache")
    c.add_argument("what", choices=("stats", "clear"))
    return p


def _settings(args):
    from linkloom.plans import config

    flags = {"network_max_concurrency": args.max_concurrency, "network_per_host": args.per_host, "network_timeout": args.timeout, "network_retries": args.retries, "network_user_agent": args.user_agent, "cache_ttl": args.cache_ttl, "auth_auth": args.auth, "ignore_exclude": args.exclude, "ignore_exclude_url": args.exclude_url, "ignore_exclude_domain": args.exclude_domain}
    if args.no_local:
        flags["ignore_local_links"] = True
    if args.command == "scan":
        flags["output_fail_on"] = args.fail_on
    return config.load(flags, args.paths[0] if args.paths else ".")


def cache_folder(settings=None) -> str:
    """The configured folder, or the user's."""
    own = (settings.cache_dir if settings else "") or os.environ.get("LINKLOOM_CACHE_DIR", "")
    return own or os.path.join(os.environ.get("XDG_CACHE_HOME", os.path.expanduser("~/.cache")), "linkloom")


def _checked(spark, settings) -> None:
    """Raises Usage at a pattern that is none, and at limits of nothing."""
    from pyspark.errors import IllegalArgumentException

    for pattern in settings.ignore_exclude_url:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as e:
            raise Usage(f"--exclude-url {pattern!r}: {str(e).splitlines()[0]}") from None
    for name in ("network_max_concurrency", "network_per_host"):
        if getattr(settings, name) < 1:
            raise Usage(f"{name.replace('_', '.', 1)} must be at least 1")


def _scanned(spark, args, settings, own):
    """(docs, scan) of the paths; raises OSError at one that is not there. Tables belong to ``own``."""
    from linkloom.operators import cache as cx
    from linkloom.operators import probe
    from linkloom.plans import frontier
    from linkloom.plans import scan as sx
    from linkloom.sources import cookies as jar
    from linkloom.sources import files, listing

    paths = [*args.paths, *([x.strip() for x in sys.stdin if x.strip()] if args.stdin else [])] or ["."]
    if lost := [x for x in paths if not os.path.exists(x)]:
        raise OSError(f"no such path: {', '.join(lost)}")
    walked = listing.listed(spark, paths, args.include, list(settings.ignore_exclude))
    docs = files.detected(files.contents(spark, walked))
    links = sx.read(docs, own)
    cache = None if args.no_cache else cx.load(spark, cache_folder(settings))
    seen = spark.read.parquet(args.observations) if args.observations else None
    if seen is None and not args.offline:
        limits = frontier.Limits(tuple(settings.ignore_exclude_url), tuple(settings.ignore_exclude_domain), cache, int(settings.cache_ttl), args.refresh)
        held = jar.read(spark, args.cookies) if args.cookies else None
        ask = lambda wanted: probe.probe(wanted, settings.network_per_host, settings.network_max_concurrency, settings.network_timeout, settings.network_retries, settings.network_user_agent, cookies=held)
        seen, _ = frontier.observed(sx.web_urls(links), ask, own, limits, auth=settings.auth_auth, cookies=held is not None)
    out = sx.scan(docs, seen, settings.ignore_exclude_url, settings.ignore_exclude_domain, check_local=not settings.ignore_local_links, auth=settings.auth_auth, cache=cache, ttl=int(settings.cache_ttl), refresh=args.refresh, files=walked, own=own, links=links)
    if out.cache is not None:
        cx.update(own.settle(out.cache, "cache"), cache_folder(settings), out.stale)
    return docs, out


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else CLEAN
    if args.command == "fix" and (args.backup and not args.write or args.copy and args.write):
        print("error: --backup needs --write, and --copy goes without it", file=sys.stderr)
        return USAGE
    from pyspark.errors import PySparkException
    from pyspark.sql import SparkSession

    from linkloom.operators import cache as cx
    from linkloom.operators import commit, fixes
    from linkloom.plans import report
    from linkloom.plans.scan import flat
    from linkloom.tables import Scratch

    spark = spark or SparkSession.builder.appName("linkloom").getOrCreate()
    try:
        if args.command == "cache":
            if args.what == "clear":
                cx.clear(spark, cache_folder())
            else:
                print(f"entries: {cx.load(spark, cache_folder()).count()}\nsize: {cx.size(spark, cache_folder())}")
            return CLEAN
        settings = _settings(args)
        _checked(spark, settings)
        began = time.time()
        with Scratch(spark) as own:
            docs, out = _scanned(spark, args, settings, own)
            findings = own.settle(out.findings, "findings")
            if args.command == "fix":
                asked, refused = fixes.plan(findings, docs, args.min_fix_confidence, tuple(args.fix_exclude))
                results = own.settle(fixes.run(docs, asked), "fixed")
                written = commit.write(results.filter("content is not null"), own, args.copy, args.backup) if args.write or args.copy else None
                if written is None:
                    for r in results.filter("diff is not null").orderBy("path").toLocalIterator():
                        print(r.diff, end="")
                for r in refused.orderBy("path").toLocalIterator():
                    print(f"refused {r.path}: {r.reason}", file=sys.stderr)
                done = results.filter("error is not null" if written is not None else "true").select("path", "error")
                done = done if written is None else done.unionByName(written.select("path", "error"))
                for r in done.filter("error is not null").orderBy("path").toLocalIterator():
                    print(f"failed {r.path}: {r.error}", file=sys.stderr)
                return FOUND if commit.outcome(done, refused).first()["exit_code"] else CLEAN
            rows = flat(findings)
            code = report.exit_code(rows, settings.output_fail_on).first()[0]
            shown = findings.filter(report.rank(findings["verdict.confidence"]) >= report.RANK[args.min_confidence])
            if args.json or args.format == "json":
                whole = report.json_document(shown, out.run.first().asDict(), int((time.time() - began) * 1000))
            else:
                whole = report.sarif_document(shown, code) if args.format == "sarif" else report.table_document(flat(shown))
            whole.write(args.output) if args.output else whole.show(sys.stdout)
            return FOUND if code else CLEAN
    except Usage as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except (OSError, ValueError, KeyError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return ENVIRONMENT


if __name__ == "__main__":
    sys.exit(main())
