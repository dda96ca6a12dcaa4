"""A set of tables, each with its own recipe.

Switching between tables loses nothing, because a table's state is its recipe: the raw table
stays as it was read and any version of it is a prefix of the recipe.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from sparkscrub.operators.tables import tables_overview
from sparkscrub.plans.recipe import Recipe
from sparkscrub.sinks.writers import write_table_set


@dataclass(frozen=True)
class Workbook:
    tables: Mapping[str, DataFrame]
    recipes: Mapping[str, Recipe] = field(default_factory=dict)
    active: str | None = None

    def switch(self, name: str) -> Workbook:
        """The same workbook with another active table."""
        if name not in self.tables:
            raise ValueError(f"no table {name!r}")
        return Workbook(self.tables, self.recipes, name)

    def add(self, op: str, column: str | None = None, **options: Any) -> Workbook:
        """One more step for the active table."""
        name = self._active()
        return self._with(name, self._recipe(name).add(op, column, **options))

    def undo(self) -> Workbook:
        """The active table without its last step."""
        name = self._active()
        recipe = self._recipe(name)
        return self._with(name, Recipe(recipe.steps[:-1], recipe.index))

    def reset(self) -> Workbook:
        """The active table as it was read."""
        name = self._active()
        return self._with(name, Recipe(index=self._recipe(name).index))

    def current(self, name: str | None = None) -> DataFrame:
        """The active (or named) table with its steps applied."""
        name = name or self._active()
        return self._recipe(name).replay(self.tables[name])

    def audit(self, name: str | None = None) -> DataFrame:
        name = name or self._active()
        return self._recipe(name).audit(self.tables[name])

    def overview(self) -> DataFrame:
        """One row per table: rows, columns, whether active, whether cleaned, steps taken."""
        steps = {n: len(self._recipe(n).steps) for n in self.tables}
        return tables_overview({n: self.current(n) for n in self.tables}, steps, self._active())

    def write(self, directory: str, fmt: str = "parquet", mode: str = "errorifexists") -> dict[str, str]:
        """Every table with its steps applied, each into its own sub-directory."""
        return write_table_set({n: self.current(n) for n in self.tables}, directory, fmt, mode)

    def _active(self) -> str:
        return self.active or next(iter(self.tables))

    def _recipe(self, name: str) -> Recipe:
        return self.recipes.get(name, Recipe())

    def _with(self, name: str, recipe: Recipe) -> Workbook:
        return Workbook(self.tables, {**self.recipes, name: recipe}, self.active)
