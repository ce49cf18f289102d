"""Plan text, as event logs and other people's clusters have it, to ``plan_nodes`` rows. Tree and formatted text are told apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .walk import WRAPPERS, label, short

MARKER = re.compile(r"^((?:[ |│]|:(?!- ))*)([+:]- )?(?:\*?\s*\(\d+\)\s*)?(?:\*\s*)?(\S.*)$")


def sections(text: str) -> list[str]:
    """Lines of the plan that ran: with both a final and an initial one, the final; before execution, the initial."""
    lines = text.split("\n")
    out, skipping, seen = [], False, False
    for line in lines:
        bare = line.strip(" :+-")
        if bare.startswith("== Initial Plan"):
            skipping = seen
            continue
        if bare.startswith("== Final Plan") or re.match(r"\+?-?\s*== Current Plan", bare):
            skipping = False
            continue
        if bare.startswith("== Physical Plan"):
            out, seen, skipping = [], False, False
            continue
        if bare.startswith("== "):
            if seen:
                break
            continue
        if re.match(r"^\(\d+\) ", line):
            break  # the detail blocks of formatted text repeat each operator
        if not skipping and line.strip():
            out.append(line)
            name = short(MARKER.match(line)[3]) if MARKER.match(line) else ""
            seen |= bool(name) and name not in WRAPPERS
    return out


def parse(text: str, plan_id: str = "plan") -> list[tuple]:
    """Rows of ``plan_nodes``: depth from the tree's marks, three characters a level; wrappers are left out."""
    rows: list[tuple] = []
    stack: list[tuple[int, int | None, int]] = []  # raw depth, node id or the parent's for wrappers, depth shown
    details = dict(re.findall(r"^\((\d+)\) [^\n]*\n((?:(?!^\(\d+\) |^\s*$)[^\n]*\n?)*)", text, re.M))
    for line in sections(text):
        m = MARKER.match(line)
        if not m:
            continue
        raw = (len(m[1]) + 3) // 3 if m[2] else 0
        name = short(m[3])
        if not re.match(r"[A-Z]\w+$", name):
            continue
        while stack and stack[-1][0] >= raw:
            stack.pop()
        parent, depth = (stack[-1][1], stack[-1][2] + 1) if stack else (None, 0)
        if name in WRAPPERS:
            stack.append((raw, parent, depth - 1 if parent is not None or stack else -1))
            continue
        own = len(rows)
        number = re.search(r"\((\d+)\)\s*$", m[3])
        detail = m[3] + (" " + " ".join(details.get(number[1], "").split()) if number else "")
        rows.append((plan_id, own, parent, max(0, depth), name, label(name), detail))
        stack.append((raw, own, max(0, depth)))
    return rows


def size_in_bytes(detail: Column) -> Column:
    """``sizeInBytes=1.5 MiB`` and the like as bytes; units in any case."""
    number = F.regexp_extract(detail, r"(?i)sizeInBytes=([0-9.]+(?:E\+?[0-9]+)?)\s*([KMGT]?i?B)", 1)
    unit = F.upper(F.regexp_extract(detail, r"(?i)sizeInBytes=[0-9.]+(?:E\+?[0-9]+)?\s*([KMGT]?i?B)", 1))
    power = F.when(unit.startswith("K"), 1).when(unit.startswith("M"), 2).when(unit.startswith("G"), 3).when(unit.startswith("T"), 4).otherwise(0)
    return F.when(number != "", number.cast("double") * F.pow(F.lit(1024.0), power))


def memory_bytes(text: str) -> int:
    """``28g`` or ``512m`` as bytes."""
    m = re.match(r"(?i)\s*([0-9.]+)\s*([kmgt]?)b?\s*$", text)
    return int(float(m[1]) * 1024 ** " kmgt".index((m[2] or " ").lower())) if m else 0


def human(size: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if size < 1024:
            return f"{size:.1f} {unit}"
        size /= 1024
    return f"{size:.1f} TiB"
