"""Runs scripts of the sqllogictest kind against a session.

Records are parted by blank lines: ``statement ok`` or ``statement error`` with a
statement; ``query <types> [nosort|rowsort|valuesort]`` with a query, ``----`` and the
values expected, one per line. Types are T (text), I (integer) and R (real, three
decimals). ``skipif``, ``onlyif`` and ``halt`` are understood; ``hash-threshold`` is
accepted, and an expectation may be ``<n> values hashing to <md5>``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from ..session import EngineSession

ENGINE = "sparkloom"


@dataclass
class Report:
    passed: int = 0
    skipped: int = 0
    failures: list[str] = field(default_factory=list)


def _shown(value, kind: str) -> str:
    if value is None:
        return "NULL"
    if kind == "I":
        return str(int(value))
    if kind == "R":
        return f"{float(value):.3f}"
    return str(value).lower() if isinstance(value, bool) else str(value) or "(empty)"


def run(session: EngineSession, script: str) -> Report:
    report = Report()
    for number, record in enumerate(re.split(r"\n\s*\n", script)):
        lines = [line for line in record.strip("\n").splitlines() if not line.startswith("#")]
        skip = False
        while lines and (m := re.match(r"(skipif|onlyif)\s+(\w+)", lines[0])):
            skip |= (m[1] == "skipif") == (m[2] == ENGINE)
            lines.pop(0)
        if not lines or lines[0].startswith("hash-threshold"):
            continue
        if lines[0].startswith("halt"):
            break
        if skip:
            report.skipped += 1
            continue
        problem = _record(session, lines)
        if problem is None:
            report.passed += 1
        else:
            report.failures.append(f"record {number}: {problem}")
    return report


def _record(session: EngineSession, lines: list[str]) -> str | None:
    """What is wrong with a record's outcome, or None."""
    head, *body = lines
    words = head.split()
    if words[0] == "statement":
        try:
            session.exec("\n".join(body))
        except Exception as e:  # any refusal counts as an error of the statement
            return None if words[1] == "error" else str(e)[:200]
        return "no error" if words[1] == "error" else None
    if words[0] != "query":
        return f"unknown record {head}"
    at = body.index("----") if "----" in body else len(body)
    kinds, order = words[1], words[2] if len(words) > 2 else "nosort"
    try:
        rows = [[_shown(v, k) for v, k in zip(r, kinds, strict=True)] for r in session.sql("\n".join(body[:at])).collect()]
    except Exception as e:
        return str(e)[:200]
    values = [v for r in (sorted(rows) if order == "rowsort" else rows) for v in r]
    if order == "valuesort":
        values.sort()
    want = body[at + 1 :]
    if len(want) == 1 and (m := re.fullmatch(r"(\d+) values hashing to ([0-9a-f]{32})", want[0])):
        found = hashlib.md5("".join(v + "\n" for v in values).encode()).hexdigest()
        return None if (len(values), found) == (int(m[1]), m[2]) else f"{len(values)} values hashing to {found}"
    return None if values == want else f"{values} instead of {want}"
