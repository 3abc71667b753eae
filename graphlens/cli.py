"""Command line: unpack a dump, ask one question, or open a session."""

from __future__ import annotations

import argparse
import shutil
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .formats import render
from .plans.parser import parse
from .session import ErrorResult, Session
from .sources.hprof import ingest


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="graphlens")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("unpack", "write the tables of a dump"), ("query", "answer one command"), ("open", "start a session")):
        own = commands.add_parser(name, help=text)
        own.add_argument("dump")
        own.add_argument("-d", "--heap-dir", help="folder of the tables (default: <dump>.d)")
        own.add_argument("--clean", action="store_true", help="make the tables anew")
        own.add_argument("--output", choices=("human", "jsonl", "json"), default="human")
        if name == "query":
            own.add_argument("text", nargs="+")
    return parser.parse_args(argv)


def completed(line: str, word: str) -> list[str]:
    """What may follow a line, or complete its last word."""
    parsed = parse(line)
    more = getattr(parsed, "completions", ())
    if not more and word:
        more = getattr(parse(line[: len(line) - len(word)]), "completions", ())
    return sorted(m for m in more if m.upper().startswith(word.upper()))


def offer_completions() -> None:
    """Tab completes in sessions, where the terminal's library is there."""
    try:
        import readline
    except ImportError:
        return

    def complete(word: str, state: int) -> str | None:
        found = completed(readline.get_line_buffer()[: readline.get_endidx()], word)
        return f"{found[state]} " if state < len(found) else None

    readline.set_completer(complete)
    readline.parse_and_bind("tab: complete")


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = SparkSession.builder.appName("graphlens").getOrCreate()
    folder = args.heap_dir or f"{args.dump}.d"
    if args.clean:
        shutil.rmtree(folder, ignore_errors=True)
    heap = ingest(spark, args.dump, folder)
    if args.command == "unpack":
        print(folder)
        return 0
    session = Session(heap, f"{folder}/session")
    if args.command == "query":
        result = session.execute(" ".join(args.text))
        print(render(result, args.output))
        return int(isinstance(result, ErrorResult))
    offer_completions()
    while True:
        try:
            line = input(f"{Path(args.dump).name} {session.prompt} ")
        except EOFError:
            return 0
        if line.strip().lower() in ("exit", "quit"):
            return 0
        if line.strip().lower() in ("help", "?"):
            print("source, filters, terminal: e.g. CLASS java.lang.String RETAINING > 1000 TOP 5; SQL: SELECT ...")
            continue
        print(render(session.execute(line), args.output))


if __name__ == "__main__":
    sys.exit(main())
