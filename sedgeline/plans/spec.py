"""The declarative query: what a caller writes, validated, before any DataFrame exists."""

from __future__ import annotations

from dataclasses import dataclass, field

MAX_ROWS, DEFAULT_ROWS = 1000, 10


class SpecError(ValueError):
    """A query names what does not exist or asks for what is not offered."""


@dataclass(frozen=True)
class Filter:
    key: str
    operator: str = ""
    value: str = ""


@dataclass(frozen=True)
class Group:
    """Members joined by ``any`` (or) or by anything else (and); an empty group holds."""

    operator: str = "all"
    filters: tuple[Filter, ...] = ()
    groups: tuple[Group, ...] = ()


@dataclass(frozen=True)
class Sort:
    key: str
    ascending: bool = True


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str = ""
    alias: str = ""

    @property
    def name(self) -> str:
        """Alias, else ``count`` for a bare count, else function_column."""
        if self.alias:
            return self.alias
        return "count" if not self.column else f"{self.function.lower()}_{self.column}"


@dataclass(frozen=True)
class DatasetQuery:
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group: Group | None = None
    sorts: tuple[Sort, ...] = ()
    group_by: str = ""
    aggregates: tuple[Aggregate, ...] = ()
    limit: int = DEFAULT_ROWS
    offset: int = 0

    @property
    def page(self) -> tuple[int, int]:
        """(limit, offset) within bounds: at most ``MAX_ROWS``, the default for less than one, no negative offset."""
        return (min(self.limit, MAX_ROWS) if self.limit > 0 else DEFAULT_ROWS), max(0, self.offset)


def parse(spec: dict) -> DatasetQuery:
    """A query from its JSON form."""

    def filters(items: list[dict]) -> tuple[Filter, ...]:
        return tuple(Filter(f["key"], f.get("operator", ""), str(f.get("value", ""))) for f in items)

    def group(g: dict | None) -> Group | None:
        return None if g is None else Group(g.get("operator", "all"), filters(g.get("filters", [])), tuple(group(x) for x in g.get("groups", [])))

    return DatasetQuery(
        tuple(spec.get("columns", [])),
        filters(spec.get("filters", [])),
        group(spec.get("filter_group")),
        tuple(Sort(s["key"], s.get("ascending", True)) for s in spec.get("sorts", [])),
        spec.get("group_by", ""),
        tuple(Aggregate(a["function"], a.get("column", ""), a.get("as", "")) for a in spec.get("aggregates", [])),
        spec.get("limit", DEFAULT_ROWS),
        spec.get("offset", 0),
    )


@dataclass
class Schema:
    """Declared types of a dataset: number, date, datetime, checkbox, text or list; row order is that of ``key``."""

    types: dict[str, str]
    key: str
    aliases: dict[str, str] = field(default_factory=dict)

    def column(self, name: str) -> str:
        name = name.strip()
        if name in ("identity", "_identity", "_key"):
            return self.key
        if name not in self.types:
            raise SpecError(f'dataset column "{name}" not found')
        return name

    def type(self, name: str) -> str:
        return self.types.get(name, "text") or "text"
