"""A prompt for statements, and the text form of results."""

from __future__ import annotations

import sys
from typing import Any

from pyspark.sql import DataFrame

from lodestar.engine import Affected, Engine
from lodestar.plans.errors import EngineError

_NUMBERS = ("int", "bigint", "double")


def shown(value: Any, remote: bool = False) -> str:
    """A value as text: NULL, TRUE and FALSE; for a remote prompt nothing, t and f."""
    if value is None:
        return "" if remote else "NULL"
    if isinstance(value, bool):
        return ("t" if value else "f") if remote else str(value).upper()
    return str(value)


def table(df: DataFrame, most: int = 1000, remote: bool = False) -> str:
    """An aligned table of at most `most` rows with a count below; numbers to the right for a remote prompt."""
    kinds = [k for _, k in df.dtypes]
    rows = [[shown(v, remote) for v in r] for r in df.limit(most).collect()]
    widths = [max(map(len, [name, *(r[i] for r in rows)])) for i, name in enumerate(df.columns)]

    def line(cells: list[str], head: bool = False) -> str:
        return " | ".join(c.rjust(w) if remote and k in _NUMBERS and not head else c.ljust(w) for c, w, k in zip(cells, widths, kinds, strict=True)).rstrip()

    return "\n".join([line(df.columns, True), "-+-".join("-" * w for w in widths), *map(line, rows), f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])


def answer(engine: Engine, text: str, remote: bool = False) -> str:
    """What the prompt prints for a line."""
    body = text.strip()
    if body == r"\dt":
        body = "SHOW TABLES"
    elif body.startswith(r"\d "):
        body = f"SHOW COLUMNS FROM {body[3:]}"
    try:
        out = engine.sql(body)
    except EngineError as e:
        return str(e)
    if isinstance(out, Affected):
        changed = body.split(None, 1)[0].lower() in ("insert", "update", "delete", "vacuum")
        return f"{out.rows} row{'' if out.rows == 1 else 's'} affected" if changed else "OK"
    return table(out, remote=remote)


def main() -> None:
    from lodestar.session import make

    engine = Engine.open(make(), sys.argv[1] if len(sys.argv) > 1 else "lodestar-data")
    held = ""
    while True:
        try:
            line = input("...> " if held else "sql> ")
        except EOFError:
            break
        if not held and line.strip() in (r"\q", "exit", "quit"):
            break
        held += line + "\n"
        if line.rstrip().endswith(";") or line.startswith("\\"):
            print(answer(engine, held))
            held = ""


if __name__ == "__main__":
    main()
