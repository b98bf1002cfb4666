"""The command line: a prompt, or a script file. Rows print one to a line, and other statements print their status."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row

from tessera.dialect import tree
from tessera.dialect.parser import parse_script
from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.sources.scripts import complete

QUIT = {".quit", ".exit", ".q", "\\q", "quit"}
HELP = "\n".join(
    (
        ".tables  list tables",
        ".schema  show the columns of each table",
        ".help    show this",
        ".quit    leave (also .exit, .q, \\q, quit)",
        "A statement ends with a semicolon and may go over several lines.",
    )
)


def value(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:f}"
    return f"'{v}'" if isinstance(v, str) else str(v)


def row_text(row: Row) -> str:
    return ", ".join(map(value, row))


def print_rows(rows: DataFrame, out: Callable[[str], object]) -> None:
    """All rows, fetched a partition at a time."""
    n = 0
    for row in rows.toLocalIterator():
        out(row_text(row))
        n += 1
    out(f"({n} row{'' if n == 1 else 's'})")


def run_text(engine: Engine, text: str, out: Callable[[str], object]) -> bool:
    """Run the statements of a text; False as soon as one fails."""
    try:
        for stmt in parse_script(text):
            rows = engine.execute(stmt)
            if isinstance(stmt, tree.Select):
                print_rows(rows, out)
            else:
                out("OK")
    except EngineError as e:
        out(f"Status: {e.status.name} ({e})")
        return False
    return True


def command(engine: Engine, line: str, out: Callable[[str], object]) -> None:
    match line:
        case ".help":
            out(HELP)
        case ".tables":
            for r in engine.list_tables().collect():
                out(r["table_name"])
        case ".schema":
            shown: dict[str, list[str]] = {}
            for r in engine.table_schema().collect():
                shown.setdefault(r["table_name"], []).append(f"{r['column_name']} {r['type_name']}" + " PRIMARY KEY" * r["is_pk"])
            for name, columns in shown.items():
                out(f"{name}({', '.join(columns)});")
        case _:
            out(f"no command {line} (try .help)")


def repl(engine: Engine, lines: Iterable[str], out: Callable[[str], object] = print) -> None:
    held = ""
    for line in lines:
        text = line.rstrip("\n")
        if not held and text.strip() in QUIT:
            return
        if not held and text.strip().startswith("."):
            command(engine, text.strip(), out)
            continue
        held = f"{held}\n{text}" if held else text
        if not held.strip():
            held = ""
        elif complete(held):
            run_text(engine, held, out)
            held = ""
    if held.strip():
        run_text(engine, held, out)


def main(args: list[str]) -> int:
    """[--root FOLDER] [--data FOLDER OF PARQUET TABLES] [SCRIPT]"""
    import argparse
    from pathlib import Path

    from tessera.session import get_session

    parser = argparse.ArgumentParser(prog="tessera", description=main.__doc__)
    parser.add_argument("script", nargs="?")
    parser.add_argument("--root", default="./tessera-data")
    parser.add_argument("--data")
    asked = parser.parse_args(args)
    engine = Engine(get_session(), asked.root)
    for found in sorted(Path(asked.data).glob("*.parquet")) if asked.data else ():
        engine.register(found.stem, str(found))
    if asked.script:
        return int(not run_text(engine, Path(asked.script).read_text(encoding="utf-8"), print))
    repl(engine, sys.stdin)
    return 0
