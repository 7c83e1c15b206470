"""Small Datalog programs over named tables.

A rule is ``head(X, Y) :- body(X, Z), other(Z, Y), Z > 3, X != Y.``: variables start
with a capital letter, ``_`` is ignored, everything else is a constant.  Rules with
one head are a union; recursive ones are evaluated semi-naively: each round joins
only the rows that the round before found.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import Scratch

_ATOM = re.compile(r"\s*([a-z_]\w*)\(([^)]*)\)\s*$")
_TEST = re.compile(r"\s*([A-Z]\w*)\s*(!=|<=|>=|=|<|>)\s*(\S+)\s*$")
MAX_ROUNDS = 200


def parse(program: str) -> list[tuple[str, list[str], list[tuple[str, list[str]]], list[tuple[str, str, str]]]]:
    """Rules as (head name, head terms, body atoms, comparisons)."""
    rules = []
    for text in filter(None, (x.strip() for x in re.split(r"\.\s*(?:\n|\Z)", program))):
        head, _, body = text.partition(":-")
        name, terms = _ATOM.match(head).groups()
        atoms, tests = [], []
        for part in re.findall(r"\s*[a-z_]\w*\([^)]*\)|[^,]+", body):
            if m := _ATOM.match(part):
                atoms.append((m[1], [t.strip() for t in m[2].split(",")]))
            elif m := _TEST.match(part):
                tests.append(m.groups())
            else:
                raise ValueError(f"not an atom: {part.strip()}")
        rules.append((name, [t.strip() for t in terms.split(",")], atoms, tests))
    return rules


def _constant(t: str):
    return F.lit(t.strip("'\"") if t[:1] in "'\"" else float(t) if "." in t else int(t))


def _atom(df: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of a table as bindings of the variables of an atom."""
    seen: dict[str, str] = {}
    for column, t in zip(df.columns, terms, strict=True):
        if t[0].isupper():
            if t in seen:
                df = df.filter(F.col(column) == F.col(seen[t]))
            seen.setdefault(t, column)
        elif t != "_":
            df = df.filter(F.col(column) == _constant(t))
    return df.select(*[F.col(c).alias(v) for v, c in seen.items()])


def _body(tables: dict[str, DataFrame], head: list[str], atoms, tests) -> DataFrame:
    out = None
    for name, terms in atoms:
        step = _atom(tables[name], terms)
        shared = [] if out is None else [c for c in step.columns if c in out.columns]
        out = step if out is None else out.join(step, shared) if shared else out.crossJoin(step)
    for left, op, right in tests:
        r = F.col(right) if right[0].isupper() else _constant(right)
        a = F.col(left)
        out = out.filter({"=": a == r, "!=": a != r, "<": a < r, ">": a > r, "<=": a <= r, ">=": a >= r}[op])
    return out.select(*[(F.col(t) if t[0].isupper() else _constant(t)).alias(f"c{i}") for i, t in enumerate(head)]).distinct()


def run(program: str, tables: dict[str, DataFrame], wanted: str) -> DataFrame:
    """The rows (c0, c1, ...) of a relation that a program derives from tables."""
    rules = parse(program)
    derived = {name for name, *_ in rules}
    if wanted not in derived:
        raise ValueError(f"no rule for {wanted}")
    scratch = Scratch(next(iter(tables.values())).sparkSession, "datalog")
    full: dict[str, DataFrame] = {}
    fresh: dict[str, DataFrame] = {}
    for name in derived:
        parts = [_body(tables, h, a, t) for n, h, a, t in rules if n == name and not any(x in derived for x, _ in a)]
        rows = parts[0] if parts else None
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if rows is not None:
            full[name] = fresh[name] = scratch.table(rows.distinct(), name)
    for _ in range(MAX_ROUNDS):
        found: dict[str, DataFrame] = {}
        for name, head, atoms, tests in rules:
            places = [i for i, (x, _) in enumerate(atoms) if x in derived]
            if not places or any(atoms[i][0] not in full for i in places):
                continue
            for i in places:  # one occurrence reads only what the last round found
                if atoms[i][0] not in fresh:
                    continue
                marked = [("\0new" if k == i else x, ts) for k, (x, ts) in enumerate(atoms)]
                rows = _body({**tables, **full, "\0new": fresh[atoms[i][0]]}, head, marked, tests)
                found[name] = rows if name not in found else found[name].unionByName(rows)
        fresh = {}
        for name, rows in found.items():
            new = rows.distinct()
            if name in full:
                new = new.join(full[name], full[name].columns, "left_anti")
            new = scratch.table(new, name)
            if not new.isEmpty():
                fresh[name] = new
        for name, new in fresh.items():
            full[name] = full[name].unionByName(new) if name in full else new
        if not fresh:
            return full[wanted]
    raise RuntimeError("the program did not settle")


class Rules:
    """Named programs whose results are kept as written tables until they are invalidated."""

    def __init__(self) -> None:
        self._programs: dict[str, tuple[str, str, frozenset[str]]] = {}
        self._kept: dict[str, DataFrame] = {}

    def define(self, name: str, program: str, wanted: str, labels: list[str] = ()) -> None:
        self._programs[name] = (program, wanted, frozenset(labels))
        self._kept.pop(name, None)

    def run(self, name: str, tables: dict[str, DataFrame]) -> DataFrame:
        if name not in self._kept:
            program, wanted, _ = self._programs[name]
            out = run(program, tables, wanted)
            self._kept[name] = Scratch(out.sparkSession, "rules").table(out, name)
        return self._kept[name]

    def invalidate(self, name: str | None = None, label: str | None = None) -> list[str]:
        """Drops kept results by name or by any label; returns the names dropped."""
        gone = [n for n in self._kept if n == name or (label is not None and label in self._programs[n][2])]
        for n in gone:
            del self._kept[n]
        return gone
