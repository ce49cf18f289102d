"""Source texts with their actions taken out: a preview of what a dry run would evaluate.

The syntax tree says where an action stands, so calls spliced into other calls, f-strings, dictionary values, conditions and chains over many
lines are all one case: the call's span is replaced by ``_capture(frame)``. Lines keep their numbers.
"""

from __future__ import annotations

import ast
import re

#: Calls that run a job, by name, and the methods that end a write.
ACTIONS = set("collect count show toPandas to_pandas_on_spark toLocalIterator foreach foreachPartition first head take tail isEmpty".split())
CAPTURE = "_capture"
SEPARATOR = re.compile(r"^#\s*COMMAND\s*-+\s*$")
MAGIC = re.compile(r"^\s*(?:#\s*MAGIC\s*)?%(\w+)")
SKIPPED = "# [skipped] "


def cells(source: str) -> str:
    """Notebook text as plain Python: magics and shell lines become comments, with the rest of a cell of another language; ``%python`` goes."""
    out, foreign = [], False
    for line in source.split("\n"):
        if SEPARATOR.match(line):
            foreign = False
            out.append(line)
            continue
        m = MAGIC.match(line)
        if m and m[1] == "python":
            out.append("")
            continue
        if m:
            foreign |= m[1] in ("sh", "sql", "md", "scala", "r", "fs")
        skip = bool(m) or foreign or line.lstrip().startswith("!")
        out.append(SKIPPED + re.sub(r"^\s*#\s*MAGIC\s*", "", line).replace("%", "% ") if skip else line)
    return "\n".join(out)


def _frame(node: ast.Call) -> ast.expr | None:
    """The frame that a call acts on, if it is an action."""
    f = node.func
    if isinstance(f, ast.Name) and f.id == "display" and node.args:
        return node.args[0]
    if not isinstance(f, ast.Attribute):
        return None
    chain = f
    while isinstance(chain, (ast.Attribute, ast.Call)):
        if isinstance(chain, ast.Attribute):
            if chain.attr in ("write", "writeStream"):
                return chain.value
            chain = chain.value
        else:
            chain = chain.func
    return f.value if f.attr in ACTIONS else None


def neutralised(source: str) -> str:
    """``source`` with each outermost action replaced; waits on streams become nothing. Text that is no Python comes back with its magics out."""
    text = cells(source)
    try:
        tree = ast.parse(text)
    except SyntaxError:
        return text
    raw = text.encode()
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    at = lambda line, col: starts[line - 1] + col
    edits: list[tuple[int, int, bytes]] = []

    def visit(node: ast.AST) -> None:
        if isinstance(node, ast.Call):
            waits = isinstance(node.func, ast.Attribute) and node.func.attr in ("awaitTermination", "awaitAnyTermination", "processAllAvailable")
            frame = None if waits else _frame(node)
            a, b = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            if waits:
                edits.append((a, b, b"None"))
                return
            if frame is not None:
                own = raw[at(frame.lineno, frame.col_offset) : at(frame.end_lineno, frame.end_col_offset)]
                lost = raw[a:b].count(b"\n") - own.count(b"\n")
                edits.append((a, b, f"{CAPTURE}(".encode() + own + b"\n" * lost + b")"))
                return
        for child in ast.iter_child_nodes(node):
            visit(child)

    visit(tree)
    for a, b, new in sorted(edits, reverse=True):
        raw = raw[:a] + new + raw[b:]
    return raw.decode()


def broadcast_hint(source: str, frame: str) -> str:
    """K1, K2, K5: joins with ``frame`` take it broadcast, with the import that this needs."""
    out = re.sub(rf"\.join\(\s*{re.escape(frame)}\b", f".join(broadcast({frame})", source)
    if out != source and "import broadcast" not in source:
        out = "from pyspark.sql.functions import broadcast\n" + out
    return out


def persisted(source: str, frame: str) -> str:
    """K2: the frame is kept right after it is assigned."""
    return re.sub(rf"(?m)^(\s*)({re.escape(frame)}\s*=\s*.+)$", rf"\1\2\n\1{frame}.persist()", source, count=1)


def watermarked(source: str, column: str = "event_time", delay: str = "10 minutes") -> str:
    """K5: stream aggregates get a watermark before the grouping."""
    return re.sub(r"(?<!withWatermark)\.groupBy\(", f".withWatermark('{column}', '{delay}').groupBy(", source, count=1) if "withWatermark" not in source else source


def suppressed(source: str, line: int, marker: str = "# noqa: plumbline") -> str:
    """K1: a line is exempted."""
    lines = source.split("\n")
    lines[line] = f"{lines[line]}  {marker}"
    return "\n".join(lines)
