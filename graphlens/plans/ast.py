"""What a parsed command is."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Source:
    #: all, class, that, object, name, set
    kind: str
    name: str = ""
    ids: tuple[int, ...] = ()


@dataclass(frozen=True)
class Filter:
    #: in, not_in, retained_by, retaining, sized, sized_between, of_type, of_type_exactly,
    #: referencing, referenced_by, reachable_from, where_number, where_text, follow, unfollow, duplicates
    kind: str
    source: Source | None = None
    name: str = ""
    op: str = ""
    value: float | int | str = 0
    value2: int = 0


@dataclass(frozen=True)
class Terminal:
    #: none, top, show, bottom, sample, count, sum, max, group
    kind: str = "none"
    n: int = 10
    by: str = "retainedSize"


@dataclass(frozen=True)
class Pipeline:
    source: Source
    filters: tuple[Filter, ...] = ()
    terminal: Terminal = field(default_factory=Terminal)


@dataclass(frozen=True)
class Command:
    #: summary, classes, explain, explain_name, inspect, read, history, names, call_that, call, forget, undo, that, recall
    kind: str
    name: str = ""
    n: int = 0


@dataclass(frozen=True)
class Complete:
    query: Pipeline | Command
    completions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Incomplete:
    completions: tuple[str, ...]


@dataclass(frozen=True)
class Invalid:
    message: str
