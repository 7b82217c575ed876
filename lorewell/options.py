"""Query options with their defaults and ranges."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Any


class OptionError(ValueError):
    pass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise OptionError(what)


def _count(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 1


def _number(x: Any, low: float = 0.0, high: float = math.inf) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and low <= x <= high


def _names(x: Any, what: str) -> tuple[str, ...]:
    if x is None:
        return ()
    x = (x,) if isinstance(x, str) else x
    _need(isinstance(x, (list, tuple)) and all(isinstance(v, str) for v in x), f"{what} must be a string or a list of strings")
    return tuple(x)


@dataclass(frozen=True)
class Expansion:
    enabled: bool = True
    docs: int = 3
    terms: int = 4
    weight: float = 0.35
    min_term_length: int = 3

    def __post_init__(self) -> None:
        _need(isinstance(self.enabled, bool), "expansion.enabled must be a boolean")
        _need(_count(self.docs), "expansion.docs must be an integer of at least 1")
        _need(_count(self.terms), "expansion.terms must be an integer of at least 1")
        _need(_number(self.weight), "expansion.weight must be a finite number of at least 0")
        _need(_count(self.min_term_length), "expansion.min_term_length must be an integer of at least 1")
        object.__setattr__(self, "min_term_length", max(2, self.min_term_length))


@dataclass(frozen=True)
class Graph:
    expand: bool = False
    max_extra_terms: int = 12
    predicates: tuple[str, ...] = ("defined_as", "is", "mentions", "ref")

    def __post_init__(self) -> None:
        _need(isinstance(self.expand, bool), "graph.expand must be a boolean")
        _need(_count(self.max_extra_terms), "graph.max_extra_terms must be an integer of at least 1")
        object.__setattr__(self, "predicates", _names(self.predicates, "graph.predicates"))


@dataclass(frozen=True)
class Semantic:
    enabled: bool = False
    mode: str = "rerank"
    top_n: int = 50
    min_lex_confidence: float = 0.35
    blend: bool = True
    w_lex: float = 0.75
    w_sem: float = 0.25
    min_semantic_score: float = 0.0
    force: bool = False

    def __post_init__(self) -> None:
        _need(self.mode == "rerank", 'semantic.mode must be "rerank"')
        _need(_count(self.top_n), "semantic.top_n must be an integer of at least 1")
        _need(_number(self.min_lex_confidence, 0, 1), "semantic.min_lex_confidence must be between 0 and 1")
        _need(_number(self.min_semantic_score, 0, 1), "semantic.min_semantic_score must be between 0 and 1")
        _need(_number(self.w_lex) and _number(self.w_sem), "semantic weights must be finite numbers of at least 0")
        _need(all(isinstance(x, bool) for x in (self.enabled, self.blend, self.force)), "semantic switches must be booleans")


@dataclass(frozen=True)
class Ranking:
    """Constants of the score, and a hook: ``proximity(span)`` gives a Column of at least 1 and at most ``1 + proximity_weight``."""

    k1: float = 1.5
    b: float = 0.75
    phrase_boost: float = 0.6
    heading_boost: float = 0.3
    proximity_weight: float = 0.15
    proximity: Any = None

    def __post_init__(self) -> None:
        _need(_number(self.k1) and _number(self.b, 0, 1), "ranking.k1 must be at least 0, ranking.b between 0 and 1")
        _need(all(_number(x) for x in (self.phrase_boost, self.heading_boost, self.proximity_weight)), "ranking boosts must be finite numbers of at least 0")
        _need(self.proximity is None or callable(self.proximity), "ranking.proximity must be callable")


@dataclass(frozen=True)
class Options:
    top_k: int = 10
    min_score: float = 0.0
    namespace: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    require_phrases: tuple[str, ...] = ()
    expansion: Expansion = field(default_factory=Expansion)
    graph: Graph = field(default_factory=Graph)
    semantic: Semantic = field(default_factory=Semantic)
    ranking: Ranking = field(default_factory=Ranking)
    diversify: bool = True
    compat: str = "default"

    def __post_init__(self) -> None:
        _need(_count(self.top_k), "top_k must be an integer of at least 1")
        _need(_number(self.min_score), "min_score must be a finite number of at least 0")
        for name in ("namespace", "source", "require_phrases"):
            object.__setattr__(self, name, _names(getattr(self, name), name))
        _need(self.compat in ("default", "reference"), 'compat must be "default" or "reference"')

    def merged(self, **changes: Any) -> Options:
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


#: Lexical search alone, as the small runtimes do it.
LEXICAL = Options(expansion=Expansion(enabled=False), diversify=False)
