"""Commands: scan, generate, update, watch, serve. `python -m strataloom.cli COMMAND --root DIR`."""

from __future__ import annotations

import argparse
import importlib
import os
import sys
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import generate, protocol
from .sources import config as settings
from .sources import files, git_log
from .sources.documents import state
from .streaming import feed

HASHES = "path string, hash string"
#: How a report names figures of a kind.
SHOWN = {"untested": "untested: files", **{f"divergences_{s}": f"divergences: {s}" for s in ("error", "warn", "info")}}


def _session() -> SparkSession:
    return SparkSession.builder.appName("strataloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strataloom")
    commands = out.add_subparsers(dest="command", required=True)
    for name, said in (("scan", "list the files of a repository"), ("generate", "make all tables and notes"), ("update", "make stale notes anew"), ("watch", "make notes anew as files change"), ("serve", "answer requests, a line each")):
        own = commands.add_parser(name, help=said)
        own.add_argument("--root", default=".")
        own.add_argument("--language")
        if name == "scan":
            own.add_argument("--format", choices=("table", "json"), default="table")
        if name in ("generate", "update"):
            own.add_argument("--diff", action="store_true", help="report what notes gained and lost")
            own.add_argument("--provider", help="module:callable that is given a prompt and replies; asked about the files that matter")
            own.add_argument("--model", help="the name that notes with its replies carry")
            own.add_argument("--premium", help="module:callable for files of a high score")
            own.add_argument("--premium-model")
            own.add_argument("--verbose", action="store_true")
        if name == "generate":
            own.add_argument("--force", action="store_true")
            own.add_argument("--filter", help="write only notes of paths that match a glob")
            own.add_argument("--dry-run", action="store_true")
            own.add_argument("--diff-base", help="a revision; added and modified files are favoured")
            own.add_argument("--new-source-quota", type=int)
        if name == "watch":
            own.add_argument("--rounds", type=int, help="stop after so many looks")
            own.add_argument("--seconds", type=float, default=2.0)
        if name == "serve":
            own.add_argument("--roots", help="alias=folder, comma-separated")
    return out


def _config(args) -> settings.Config:
    own = settings.load_config(args.root)
    own = replace(own, language=args.language) if args.language else own
    quota = getattr(args, "new_source_quota", None)
    return own if quota is None else replace(own, new_source_quota=quota)


def _out(config: settings.Config) -> str:
    return os.path.join(os.path.abspath(config.root), config.output, "tables")


def scan(spark: SparkSession, args, say) -> None:
    config = _config(args)
    found = files.scan_repository(spark, config.root, config.include, config.exclude)
    rows = files.listing(found).collect() if args.format == "json" else files.by_path(found.select("path", "size")).select(F.format_string("%10d  %s", "size", "path").alias("value")).collect()
    for r in rows:
        say(r["value"])


def provider_of(args, config: settings.Config) -> generate.Provider | None:
    """Who the command names; never who a repository's own settings name, since its code is run."""

    def named(spec: str, model: str | None) -> generate.Provider:
        module, _, name = spec.partition(":")
        if not name:
            raise SystemExit(f"not module:callable: {spec!r}")
        return generate.Provider(getattr(importlib.import_module(module), name), model or spec, context=settings.load_context(config.root))

    if not args.provider:
        return None
    first = named(args.provider, args.model)
    return replace(first, premium=named(args.premium, args.premium_model)) if args.premium else first


def made_by(spark: SparkSession, config: settings.Config, earlier: generate.Run | None, chosen: generate.Chosen, **more) -> generate.Run:
    """A run over a repository; what an earlier one stored is used for files that are as they were."""
    return generate.run_repository(spark, config, F.current_timestamp(), earlier=earlier, chosen=chosen, **more)


def run(spark: SparkSession, args, say) -> None:
    config = _config(args)
    out = _out(config)
    earlier = generate.stored(spark, out)
    changes = git_log.changes(spark, config.root, args.diff_base) if args.diff_base else spark.createDataFrame([], "path string, edit string")
    provider = provider_of(args, config)
    made = made_by(spark, config, earlier, generate.Chosen(args.force, args.filter), provider=None if args.dry_run else provider, changes=changes)
    if args.dry_run:
        counts = generate.incremental.dry_run(generate.plan(made, earlier, changes, config, provider=provider is not None, force=args.force)).first()
        say(f"{counts['write']} to write, {counts['skip']} to skip, {counts['llm']} for a model")
        return
    _written(made, earlier, out, args, say)


def _written(made: generate.Run, earlier: generate.Run | None, out: str, args, say) -> None:
    if args.diff and earlier is not None:
        for r in generate.notes.diff_texts(earlier.notes, made.notes).orderBy("file_path").collect():
            say(r["text"])
    done = generate.write(made, out)
    say(f"{done.figures['made']} of {done.figures['notes']} notes made, in {done.folder}")
    if args.verbose:
        for name, value in done.figures.items():
            say(f"{SHOWN.get(name, name + ':')} {value:g}")
        for r in generate.first_files(made).collect():
            say(f"top: {r['path']} {r['score']:g}")


def update(spark: SparkSession, args, say) -> None:
    """Makes the stale notes anew, and only them."""
    config = _config(args)
    earlier = generate.stored(spark, _out(config))
    if earlier is None:
        raise SystemExit(f"no notes in {_out(config)}; run generate first")
    old = generate.saved(generate.incremental.update_set(generate.restaled(earlier.index, F.current_timestamp(), config.stale_days)), "stale")
    stale = old.count()
    say(f"{stale} stale notes")
    if stale:
        _written(made_by(spark, config, earlier, generate.Chosen(paths=old), provider=provider_of(args, config)), earlier, _out(config), args, say)


def watch(spark: SparkSession, args, say) -> None:
    """What has changed since the last run is applied, by hashes; then changes are applied as they come, or with --rounds looked for so many times."""
    config, rounds = _config(args), 1
    caught_up(spark, config, say)
    while args.rounds is not None and rounds < args.rounds:
        time.sleep(args.seconds)
        caught_up(spark, config, say)
        rounds += 1
    if args.rounds is None:
        watching(spark, config, say, args.seconds).awaitTermination()


def _scanned(spark: SparkSession, config: settings.Config):
    return generate.saved(files.scan_repository(spark, config.root, ("**/*",), ("**/.git/**", "**/node_modules/**", f"{config.output}/**")), "files")


def caught_up(spark: SparkSession, config: settings.Config, say) -> None:
    """A micro-batch of the files whose hash is not that of the current version."""
    all_files = _scanned(spark, config)
    moved = generate.saved(generate.incremental.status(all_files.select("path", "hash"), _parsed(spark, _out(config))).where("status != 'unchanged'"), "moved")
    if n := moved.count():
        _applied(spark, config, all_files, moved.select(F.col("path").alias("filename")))
        say(f"{n} files changed")


def _applied(spark: SparkSession, config: settings.Config, all_files, changed) -> None:
    commits = generate.saved(git_log.history(spark, config.root), "commits")
    generate.apply_changes(spark, _out(config), changed, all_files, commits, generate.coverage.coverage(all_files, config.root), config, F.current_timestamp(), in_part=True)


def watching(spark: SparkSession, config: settings.Config, say, seconds: float = 2.0):
    """The running query that applies settled changes; its looks and checkpoint are in the output folder, so it goes on where it ended."""

    def apply(batch, number: int) -> None:
        own = [(r["filename"],) for r in batch.select("filename").distinct().collect()]  # of a listing that the driver has
        _applied(spark, config, _scanned(spark, config), spark.createDataFrame(own, "filename string"))
        say(f"{len(own)} files changed")

    folder = os.path.join(os.path.dirname(_out(config)), "watch")
    return feed.start(spark, os.path.abspath(config.root), folder, apply, every=f"{int(seconds * 1000)} milliseconds", skip=config.output.split("/")[0])


def _parsed(spark: SparkSession, out: str):
    folder = generate.current(spark, out)
    if folder is None:
        raise SystemExit(f"no notes in {out}; run generate first")
    if len(generate.chain(spark, folder)) > 1:
        return generate.read_version(spark, folder).parsed
    return state(spark, f"{folder}/parsed", HASHES)


def serve(spark: SparkSession, args, say, lines=sys.stdin) -> None:
    roots = settings.repositories(args.roots or args.root)
    outs = {alias: _out(settings.load_config(root)) for alias, root in roots.items()}
    held: dict[str, tuple[str, generate.Run]] = {}

    def newest(alias: str) -> generate.Run:
        """The current version; a run that has ended since the last request is seen by the next."""
        folder = generate.current(spark, outs[alias])
        if folder is None:
            raise SystemExit(f"no notes of {alias}; run generate first")
        if alias not in held or held[alias][0] != folder:
            held[alias] = folder, generate.stored(spark, outs[alias])
        return held[alias][1]

    def remade(root: str):
        def work(log) -> None:
            own = settings.load_config(root)
            earlier = generate.stored(spark, _out(own))
            done = generate.write(made_by(spark, own, earlier, generate.Chosen()), _out(own))
            log(f"{done.figures['made']} of {done.figures['notes']} notes made, in {done.folder}")

        return work

    runs = {alias: (protocol.Job(), remade(root)) for alias, root in roots.items()}
    for line in lines:
        if (reply := protocol.answered({alias: (root, newest(alias)) for alias, root in roots.items()}, line, runs)) is not None:
            say(reply)


COMMANDS = {"scan": scan, "generate": run, "update": update, "watch": watch, "serve": serve}


def main(arguments: list[str] | None = None, say=print) -> None:
    args = _parser().parse_args(arguments)
    COMMANDS[args.command](_session(), args, say)


if __name__ == "__main__":
    main()
