"""Measures over a model of tables with declared many-to-one relationships.

A relationship is an edge from the many side to the one side. A filter on a table reaches the tables from which a
path of edges leads to it; it reaches them as a semi-join on the keys, so rows are kept or dropped and never
multiplied. Paths must be unique, and edges that a model leaves out on purpose are refused by name.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Edge(NamedTuple):
    """Many side, its column, one side, its key."""

    many: str
    column: str
    one: str
    key: str


class RelationshipError(ValueError):
    """A path that does not exist, is not unique, or is left out on purpose."""


class Model:
    """Tables, edges and the pairs that are left out, with the reason."""

    def __init__(self, tables: dict[str, DataFrame], edges: list[Edge], absent: dict[tuple[str, str], str] | None = None) -> None:
        self.tables, self.edges, self.absent = tables, edges, absent or {}
        for e in edges:
            if e.many not in tables or e.column not in tables[e.many].columns or e.one not in tables or e.key not in tables[e.one].columns:
                raise RelationshipError(f"no such column: {e.many}.{e.column} or {e.one}.{e.key}")
        for start in tables:
            self._walk(start, ())

    def _walk(self, at: str, seen: tuple[str, ...]) -> None:
        if at in seen:
            raise RelationshipError(f"relationships go round: {' -> '.join((*seen, at))}")
        for e in self.edges:
            if e.many == at:
                self._walk(e.one, (*seen, at))

    def paths(self, many: str, one: str) -> list[list[Edge]]:
        """All paths of edges from many to one."""
        if many == one:
            return [[]]
        return [[e, *rest] for e in self.edges if e.many == many for rest in self.paths(e.one, one)]

    def path(self, many: str, one: str) -> list[Edge]:
        """The only path; a pair that is left out, that no path joins, or that several do, is refused."""
        if (many, one) in self.absent:
            raise RelationshipError(f"{many} and {one} are not related: {self.absent[many, one]}")
        found = self.paths(many, one)
        if len(found) != 1:
            raise RelationshipError(f"{len(found)} paths from {many} to {one}" + "".join("; " + " -> ".join([many, *(e.one for e in p)]) for p in found))
        return found[0]

    def broken(self) -> DataFrame:
        """(many, one, duplicate_keys, orphan_rows) of every edge: keys that the one side has twice, and rows of the many side without one."""
        rows = []
        for e in self.edges:
            keys = self.tables[e.one].groupBy(F.col(e.key).alias("__key")).agg(F.count("*").alias("__n"))
            twice = keys.where("__key IS NOT NULL AND __n > 1").agg(F.count("*").alias("duplicate_keys"))
            many = self.tables[e.many].select(F.col(e.column).alias("__of")).where("__of IS NOT NULL")
            orphans = many.join(keys, F.col("__of") == F.col("__key"), "left_anti").agg(F.count("*").alias("orphan_rows"))
            rows.append(twice.crossJoin(orphans).select(F.lit(e.many).alias("many"), F.lit(e.one).alias("one"), "duplicate_keys", "orphan_rows"))
        return reduce(DataFrame.unionByName, rows)

    def filtered(self, fact: str, filters: dict[str, Column]) -> DataFrame:
        """The rows of a table under filters on tables, each of which follows its path, from the far end, as semi-joins."""
        rows = self.tables[fact]
        for name, condition in filters.items():
            steps = self.path(fact, name)
            if not steps:
                rows = rows.where(condition)
                continue
            keys = self.tables[name].where(condition)
            for e in reversed(steps):
                mine = rows if e.many == fact and e is steps[0] else self.tables[e.many]
                keys = mine.join(keys.select(F.col(e.key).alias("__key")), F.col(e.column) == F.col("__key"), "left_semi")
            rows = keys
        return rows

    def related(self, fact: str, columns: dict[str, list[str]]) -> DataFrame:
        """A table with columns of related ones, along their paths; rows without a partner have nulls, and none is multiplied if keys are unique."""
        rows, known = self.tables[fact], {fact: {}}
        for name, wanted in columns.items():
            for step in self.path(fact, name):
                if step.one in known:
                    continue
                theirs = self.tables[step.one]
                known[step.one] = {c: f"{step.one}.{c}" for c in theirs.columns}
                mine = known[step.many].get(step.column, step.column)
                theirs = theirs.select(*[F.col(c).alias(known[step.one][c]) for c in theirs.columns])
                rows = rows.join(theirs, F.col(f"`{mine}`") == F.col(f"`{step.one}.{step.key}`"), "left")
        return rows.select(*self.tables[fact].columns, *[F.col(f"`{name}.{c}`").alias(c) for name, wanted in columns.items() for c in wanted])

    def measures(self, fact: str, by: dict[str, list[str]], filters: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
        """All measures of one context, from one pass over the fact's rows that the filters leave, by columns of related tables."""
        model = Model(self.tables | {fact: self.filtered(fact, filters)}, self.edges, self.absent)
        rows = model.related(fact, by)
        return rows.groupBy(*[c for wanted in by.values() for c in wanted]).agg(*[m.alias(n) for n, m in measures.items()])
