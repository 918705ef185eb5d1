"""Regular expressions of others in time that grows with pattern times text: all ways are followed at once, none is tried again."""

from __future__ import annotations

import functools
import re
from re import _constants as K
from re import _parser

#: Steps of a compiled pattern, and results remembered for each.
STEPS, REMEMBERED = 20_000, 20_000
_KINDS = {
    K.CATEGORY_DIGIT: str.isdecimal, K.CATEGORY_NOT_DIGIT: lambda c: not c.isdecimal(), K.CATEGORY_SPACE: str.isspace, K.CATEGORY_NOT_SPACE: lambda c: not c.isspace(),
    K.CATEGORY_WORD: lambda c: c.isalnum() or c == "_", K.CATEGORY_NOT_WORD: lambda c: not (c.isalnum() or c == "_"),
}
_PLACES = (K.AT_BEGINNING, K.AT_BEGINNING_STRING, K.AT_END, K.AT_END_STRING, K.AT_BOUNDARY, K.AT_NON_BOUNDARY)


class Unsupported(ValueError):
    """What can't be followed this way: back references, looking around, flags, possessive parts, or too many steps."""


def _takes(op: object, value: object, c: str) -> bool:
    if op is K.LITERAL:
        return ord(c) == value
    if op is K.NOT_LITERAL:
        return ord(c) != value
    if op is K.ANY:
        return c != "\n"
    negated, hit = False, False
    for kind, v in value:
        if kind is K.NEGATE:
            negated = True
        elif kind is K.LITERAL:
            hit |= ord(c) == v
        elif kind is K.RANGE:
            hit |= v[0] <= ord(c) <= v[1]
        else:
            hit |= _KINDS[v](c)
    return hit != negated


class Pattern:
    """The steps of a pattern: ("take", op, value), ("go", places), ("at", place) and ("end",)."""

    def __init__(self, pattern: str):
        tree = _parser.parse(pattern)
        if tree.state.flags & ~re.UNICODE.value:
            raise Unsupported("flags")
        self.steps: list[tuple] = []
        self._add(tree)
        self._put("end")
        self._closed: dict[tuple, tuple[frozenset, bool]] = {}
        self._next: dict[tuple, frozenset] = {}

    def _put(self, *step: object) -> int:
        if len(self.steps) >= STEPS:
            raise Unsupported("too many steps")
        self.steps.append(step)
        return len(self.steps) - 1

    def _add(self, tree) -> None:
        for op, value in tree:
            if op in (K.LITERAL, K.NOT_LITERAL, K.ANY, K.IN):
                self._put("take", op, value)
            elif op is K.AT and value in _PLACES:
                self._put("at", value)
            elif op is K.SUBPATTERN and not value[1] and not value[2]:
                self._add(value[3])
            elif op is K.BRANCH:
                fork, ends = self._put("go", ()), []
                starts = []
                for part in value[1]:
                    starts.append(len(self.steps))
                    self._add(part)
                    ends.append(self._put("go", ()))
                self.steps[fork] = ("go", tuple(starts))
                for e in ends:
                    self.steps[e] = ("go", (len(self.steps),))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                self._repeat(*value)
            else:
                raise Unsupported(str(op).lower())

    def _repeat(self, least: int, most: int, part) -> None:
        for _ in range(least):
            self._add(part)
        if most is K.MAXREPEAT:
            start = self._put("go", ())
            self._add(part)
            self._put("go", (start,))
            self.steps[start] = ("go", (start + 1, len(self.steps)))
        else:
            forks = []
            for _ in range(most - least):
                forks.append(self._put("go", ()))
                self._add(part)
            for f in forks:
                self.steps[f] = ("go", (f + 1, len(self.steps)))

    def _closure(self, starts: frozenset, places: frozenset) -> tuple[frozenset, bool]:
        """Steps that take a character and are reached from these without one, and whether the end is."""
        found = self._closed.get((starts, places))
        if found is None:
            seen, todo = set(starts), list(starts)
            while todo:
                step = self.steps[at := todo.pop()]
                onward = step[1] if step[0] == "go" else (at + 1,) if step[0] == "at" and step[1] in places else ()
                fresh = [x for x in onward if x not in seen]
                seen.update(fresh)
                todo += fresh
            found = frozenset(x for x in seen if self.steps[x][0] == "take"), any(self.steps[x][0] == "end" for x in seen)
            if len(self._closed) >= REMEMBERED:
                self._closed.clear()
            self._closed[starts, places] = found
        return found

    def found_in(self, text: str) -> bool:
        """Whether the pattern matches anywhere in the text."""
        word = _KINDS[K.CATEGORY_WORD]
        now, before = frozenset(), False
        for at in range(len(text) + 1):
            after = at < len(text) and word(text[at])
            places = {K.AT_BOUNDARY if before != after else K.AT_NON_BOUNDARY} if text else set()  # an empty text has neither
            if at == 0:
                places |= {K.AT_BEGINNING, K.AT_BEGINNING_STRING}
            if at == len(text):
                places |= {K.AT_END, K.AT_END_STRING}
            elif at == len(text) - 1 and text[at] == "\n":
                places.add(K.AT_END)
            takers, ended = self._closure(now | {0}, frozenset(places))
            if ended:
                return True
            if at < len(text):
                key = takers, text[at]
                now = self._next.get(key)
                if now is None:
                    now = frozenset(x + 1 for x in takers if _takes(*self.steps[x][1:], text[at]))
                    if len(self._next) >= REMEMBERED:
                        self._next.clear()
                    self._next[key] = now
            before = after
        return False


@functools.lru_cache(256)
def pattern_of(pattern: str) -> Pattern:
    return Pattern(pattern)
