"""Query trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from spindex.schema import WORD_LENGTH


class Node:
    """A query; combine with &, | and ~."""

    def __and__(self, other: Node) -> Node:
        return And(self, other)

    def __or__(self, other: Node) -> Node:
        return Or(self, other)

    def __invert__(self) -> Node:
        return Not(self)

    def children(self) -> tuple[Node, ...]:
        return ()

    def words(self) -> list[str]:
        """Distinct leaf words, in order of appearance."""
        return list(dict.fromkeys(n.word for n in self.walk() if isinstance(n, Kw)))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()

    def matches_nothing_present(self) -> bool:
        """Whether a document with none of the words matches."""
        return False

    def to_dict(self) -> dict:
        raise NotImplementedError

    @staticmethod
    def from_dict(d: dict) -> Node:
        (kind, value), *more = d.items()
        if more or kind not in _KINDS:
            raise ValueError(f"not a query node: {d!r}")
        if kind == "kw":
            return Kw(value)
        if kind == "not":
            return Not(Node.from_dict(value))
        parts = [Node.from_dict(v) for v in value]
        if kind in ("and", "or"):
            if len(parts) != 2:
                raise ValueError(f"{kind} takes two nodes")
            return _KINDS[kind](*parts)
        return _KINDS[kind](tuple(parts))


def _checked(*nodes: object) -> None:
    for n in nodes:
        if not isinstance(n, Node):
            raise ValueError(f"not a query node: {n!r}")


@dataclass(frozen=True)
class Kw(Node):
    """Documents with a word."""

    word: str

    def __post_init__(self):
        if not isinstance(self.word, str) or not self.word or "/" in self.word or len(self.word) >= WORD_LENGTH:
            raise ValueError(f"not a word: {self.word!r}")

    def to_dict(self) -> dict:
        return {"kw": self.word}


@dataclass(frozen=True)
class _Pair(Node):
    left: Node
    right: Node

    def __post_init__(self):
        _checked(self.left, self.right)

    def children(self) -> tuple[Node, ...]:
        return self.left, self.right

    def to_dict(self) -> dict:
        return {type(self).__name__.lower(): [c.to_dict() for c in self.children()]}


class And(_Pair):
    """Both; relevances multiply."""

    def matches_nothing_present(self) -> bool:
        return self.left.matches_nothing_present() and self.right.matches_nothing_present()


class Or(_Pair):
    """Either; relevances of both add up."""

    def matches_nothing_present(self) -> bool:
        return self.left.matches_nothing_present() or self.right.matches_nothing_present()


@dataclass(frozen=True)
class Not(Node):
    """Every other document, with relevance 1."""

    node: Node

    def __post_init__(self):
        _checked(self.node)

    def children(self) -> tuple[Node, ...]:
        return (self.node,)

    def matches_nothing_present(self) -> bool:
        return not self.node.matches_nothing_present()

    def to_dict(self) -> dict:
        return {"not": self.node.to_dict()}


@dataclass(frozen=True)
class _Positional(Node):
    nodes: tuple[Node, ...]

    def __post_init__(self):
        object.__setattr__(self, "nodes", tuple(self.nodes))
        _checked(*self.nodes)
        if len(self.nodes) < 2:
            raise ValueError(f"{type(self).__name__} takes two nodes at least")
        for n in self.nodes:
            if any(not isinstance(x, (Kw, Or)) for x in n.walk()):
                raise ValueError(f"{type(self).__name__} takes words and Or of words, not {n!r}")

    def children(self) -> tuple[Node, ...]:
        return self.nodes

    def to_dict(self) -> dict:
        return {type(self).__name__.lower(): [n.to_dict() for n in self.nodes]}


class Exact(_Positional):
    """The words one after another."""


class Approx(_Positional):
    """All words; the nearer to each other and in order, the more relevant."""

    def __post_init__(self):
        super().__post_init__()
        seen: set[str] = set()
        for n in self.nodes:
            own = set(n.words())
            if own & seen:
                raise ValueError(f"Approx with a word twice: {sorted(own & seen)}")
            seen |= own


_KINDS = {"kw": Kw, "and": And, "or": Or, "not": Not, "exact": Exact, "approx": Approx}
