"""Queries as data: predicates, rankings and the tree of query operators.

All are frozen, so equal queries are equal and can be used as keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

OPERATORS = ("=", "!=", "<", ">", "<=", ">=", "like", "rlike", "in", "not in")


@dataclass(frozen=True)
class Predicate:
    attribute: str
    operator: str = "="
    values: tuple = ()


@dataclass(frozen=True)
class Ranking:
    """k nearest neighbours of `query` by `attribute`."""

    attribute: str
    query: tuple
    k: int
    distance: str = "euclidean"
    weights: tuple | None = None
    options: tuple = ()
    index_only: bool = False
    partitions: frozenset | None = None

    def option(self, name: str, default: Any = None) -> Any:
        return dict(self.options).get(name, default)


class Node:
    """A query operator."""


@dataclass(frozen=True)
class Scan(Node):
    """Exact: filter, then rank. Neither is needed; without both it is the entity."""

    entity: str
    where: tuple[Predicate, ...] = ()
    ranking: Ranking | None = None
    prefilter: Node | None = None
    filter_method: str = "semijoin"
    id: str | None = None


@dataclass(frozen=True)
class IndexScan(Node):
    """Candidates of an index, ranked exactly afterwards unless index_only."""

    index: str
    ranking: Ranking
    where: tuple[Predicate, ...] = ()
    prefilter: Node | None = None
    id: str | None = None


@dataclass(frozen=True)
class HintScan(Node):
    """The access path is picked by hints."""

    entity: str
    where: tuple[Predicate, ...] = ()
    ranking: Ranking | None = None
    hints: tuple[str, ...] = ()
    fallback: bool = True
    id: str | None = None


@dataclass(frozen=True)
class StochasticScan(Node):
    """Several indexes vote; the more of them list a tuple, the nearer it is."""

    indexes: tuple[str, ...]
    ranking: Ranking
    id: str | None = None


@dataclass(frozen=True)
class SubQuery(Node):
    """Filter and rank the result of another query."""

    source: Node
    where: tuple[Predicate, ...] = ()
    ranking: Ranking | None = None
    id: str | None = None


@dataclass(frozen=True)
class Combine(Node):
    """union, intersect, except, fuzzyunion, fuzzyintersect, join; order parallel, left or right."""

    how: str
    left: Node
    right: Node
    order: str = "parallel"
    options: tuple = ()
    id: str | None = None


@dataclass(frozen=True)
class Project(Node):
    """Attributes first, then one of count, exists, distinct."""

    source: Node
    attributes: tuple[str, ...] = ()
    op: str | None = None
    id: str | None = None


@dataclass(frozen=True)
class Timed(Node):
    """Alternatives side by side; the best that is ready when time is up."""

    alternatives: tuple[Node, ...]
    seconds: float
    id: str | None = None


@dataclass(frozen=True)
class External(Node):
    """A search that is not a filter or ranking: `text` or `geo`."""

    handler: str
    entity: str
    params: tuple = ()
    id: str | None = None


@dataclass(frozen=True)
class Cached(Node):
    """Result kept under the id of the query."""

    source: Node
    use: bool = True
    put: bool = True
    id: str | None = None


@dataclass(frozen=True)
class Empty(Node):
    id: str | None = None
