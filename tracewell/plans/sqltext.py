"""The SQL of a recorded pipeline, as one statement with common table expressions or as a script of views."""

from __future__ import annotations

from enum import Enum


class Mode(Enum):
    CTE = "CTE"
    VIEW = "VIEW"


def steps(frame) -> list[tuple[str, str]]:
    """(name, query) of all operators that ``frame`` depends on, in order."""
    needed, todo = set(), [frame.node]
    while todo:
        node = todo.pop()
        if node not in needed:
            needed.add(node)
            todo += frame.session.dag.parents(node)
    frames = [frame.session.frames[n] for n in frame.session.dag.topological() if n in needed]
    if unknown := [f.node for f in frames if f.sql is None]:
        raise ValueError("SQL cannot express: " + ", ".join(f"{n.function} ({n.description})" for n in unknown))
    return [(f._name(), f.sql) for f in frames]


def to_sql(frame, mode: Mode = Mode.CTE, materialize: bool = False) -> str:
    """The statement(s) that give the visible columns of ``frame``. Only views can be materialised: they are cached in that case
    where more than one operator reads them."""
    if mode is Mode.CTE and materialize:
        raise ValueError("common table expressions cannot be materialised")
    parts = steps(frame)
    last = f"SELECT {', '.join('`' + c.replace('`', '``') + '`' for c in frame.columns)} FROM {parts[-1][0]}"
    if mode is Mode.CTE:
        return "WITH " + ",\n".join(f"{name} AS (\n  {query}\n)" for name, query in parts) + f"\n{last}"
    shared = {f._name() for f in frame.session.frames.values() if len(frame.session.dag.children(f.node)) > 1} if materialize else set()
    out = []
    for name, query in parts:
        out.append(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS\n  {query};")
        if name in shared:
            out.append(f"CACHE LAZY TABLE {name};")
    return "\n".join([*out, last])


def table_script(frame, prefix: str = "") -> str:
    """Statements that make a table of each source of ``frame``, named as the pipeline's text names it."""
    named = [(name, query) for name, query in steps(frame) if not frame.session.dag.parents(next(n for n, f in frame.session.frames.items() if f._name() == name))]
    return "\n".join(f"CREATE TABLE IF NOT EXISTS {prefix}{name} AS\n  {query};" for name, query in named)
