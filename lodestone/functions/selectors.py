"""The column-selection language of select, rename, relocate, distinct and across."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from lodestone.functions.expr import Expr


class Selector:
    """pick(names, kinds) gives the chosen names in order; `-s` is the complement."""

    def __init__(self, pick: Callable[[list[str], dict[str, str]], list[str]], drop: bool = False):
        self.pick, self.drop = pick, drop

    def __neg__(self) -> Selector:
        return Selector(self.pick, not self.drop)

    __invert__ = __neg__

    def __and__(self, other: Selector) -> Selector:
        return Selector(lambda n, k: [x for x in resolve([self], n, k) if x in resolve([other], n, k)])

    def __or__(self, other: Selector) -> Selector:
        return Selector(lambda n, k: list(dict.fromkeys(resolve([self], n, k) + resolve([other], n, k))))


def _by_name(test: Callable[[str], bool]) -> Selector:
    return Selector(lambda names, _: [x for x in names if test(x)])


def _fold(ignore_case: bool) -> Callable[[str], str]:
    return str.lower if ignore_case else str


def _any(prefix: str | Iterable[str]) -> list[str]:
    return [prefix] if isinstance(prefix, str) else list(prefix)


def starts_with(prefix: str | Iterable[str], ignore_case: bool = True) -> Selector:
    fold = _fold(ignore_case)
    return _by_name(lambda x: any(fold(x).startswith(fold(p)) for p in _any(prefix)))


def ends_with(suffix: str | Iterable[str], ignore_case: bool = True) -> Selector:
    fold = _fold(ignore_case)
    return _by_name(lambda x: any(fold(x).endswith(fold(p)) for p in _any(suffix)))


def contains(part: str | Iterable[str], ignore_case: bool = True) -> Selector:
    fold = _fold(ignore_case)
    return _by_name(lambda x: any(fold(p) in fold(x) for p in _any(part)))


def matches(pattern: str, ignore_case: bool = True) -> Selector:
    found = re.compile(pattern, re.IGNORECASE if ignore_case else 0)
    return _by_name(lambda x: bool(found.search(x)))


def everything() -> Selector:
    return _by_name(lambda x: True)


def last_col(offset: int = 0) -> Selector:
    return Selector(lambda names, _: [names[-1 - offset]])


def all_of(names: Iterable[str]) -> Selector:
    wanted = list(names)

    def pick(have: list[str], _: dict[str, str]) -> list[str]:
        for x in wanted:
            if x not in have:
                raise KeyError(f"column not found: {x}")
        return wanted

    return Selector(pick)


def any_of(names: Iterable[str]) -> Selector:
    wanted = list(names)
    return Selector(lambda have, _: [x for x in wanted if x in have])


def where(test: Callable[[str], bool] | str) -> Selector:
    """Columns by type: a type's name, or a predicate on it."""
    ok = test if callable(test) else lambda kind: kind == test
    return Selector(lambda names, kinds: [x for x in names if ok(kinds[x])])


def cols_between(first: str, last: str) -> Selector:
    """All columns from first to last, in either direction."""

    def pick(names: list[str], _: dict[str, str]) -> list[str]:
        a, b = names.index(first), names.index(last)
        return names[a : b + 1] if a <= b else names[b : a + 1][::-1]

    return Selector(pick)


def _one(item: Any, names: list[str], kinds: dict[str, str]) -> list[str]:
    if isinstance(item, Selector):
        return item.pick(names, kinds)
    if isinstance(item, (list, tuple)):
        return resolve(item, names, kinds)
    if isinstance(item, int) and not isinstance(item, bool):
        if not 1 <= item <= len(names):
            raise KeyError(f"no column at position {item}")
        return [names[item - 1]]
    name = item.name if isinstance(item, Expr) else item
    if not isinstance(name, str):
        raise TypeError(f"not a column selection: {item!r}")
    if name not in names:
        raise KeyError(f"column not found: {name}")
    return [name]


def resolve(items: Iterable[Any], names: list[str], kinds: dict[str, str]) -> list[str]:
    """Names chosen by the items, left to right. A string "-x" drops x; a first item that drops starts from all."""
    chosen: list[str] = []
    for i, item in enumerate(items):
        drop = isinstance(item, Selector) and item.drop
        if isinstance(item, str) and item.startswith("-") and item not in names:
            item, drop = item[1:], True
        found = _one(Selector(item.pick) if isinstance(item, Selector) else item, names, kinds)
        if drop:
            chosen = [x for x in (chosen if i else names) if x not in found]
        else:
            chosen += [x for x in found if x not in chosen]
    return chosen
