"""Patterns of schemas in bounded time, against the standard library, and equality of JSON values."""

import random
import re
import time

import pytest

from ledgerlake.llm import chat_format
from ledgerlake.llm.linear_match import Pattern, Unsupported


def _random_pattern(rng, depth=3):
    kind = rng.randrange(9 if depth else 4)
    if kind < 3:
        return rng.choice(["a", "b", "c", ".", r"\d", r"\w", r"\s", "[ab]", "[^a]", "[a-c1-3]", "1", r"\W", r"[^\d\s]", "é"])
    if kind == 3:
        return rng.choice(["^", "$", r"\b", r"\B", r"\A", r"\Z", ""])
    if kind < 6:
        return _random_pattern(rng, depth - 1) + _random_pattern(rng, depth - 1)
    if kind == 6:
        return f"(?:{_random_pattern(rng, depth - 1)}|{_random_pattern(rng, depth - 1)})"
    return f"({_random_pattern(rng, depth - 1)}){rng.choice(['*', '+', '?', '*?', '{2}', '{1,3}', '{0,2}?', '{2,}'])}"


def test_same_as_the_standard_library():
    rng = random.Random(3)
    for _ in range(3000):
        pattern, text = _random_pattern(rng), "".join(rng.choice("abc1 é_\n") for _ in range(rng.randint(0, 8)))
        assert Pattern(pattern).found_in(text) == bool(re.search(pattern, text)), (pattern, text)


@pytest.mark.parametrize("pattern", [r"^(a+)+$", r"(a|a)*b", r"(a|aa)+$", r"^(a?){40}a{40}$", r"(.*)*x", r"a*a*a*a*a*b"])
def test_hostile_patterns_cost_little(pattern):
    began = time.perf_counter()
    for n in (40, 2000):
        chat_format.violations("a" * n + "!", {"pattern": pattern})
    assert time.perf_counter() - began < 1
    began = time.perf_counter()
    assert chat_format.violations("a" * 40 + "!", {"pattern": r"^(a+)+$"}) == ["$: pattern"] and time.perf_counter() - began < 0.1


def test_what_cant_be_followed_is_told():
    for pattern in (r"(a)\1", "(?=a)", "(?<!a)b", "(?i)a", "(?>a)b", "a*+b", "(a{1000}){1000}"):
        with pytest.raises(Unsupported):
            Pattern(pattern)
        assert chat_format.violations("a", {"pattern": pattern})[0].startswith("$: pattern unsupported")
    with pytest.raises(re.error):
        Pattern("(")


def test_equality_of_values():
    told = lambda v, schema: bool(chat_format.violations(v, schema))
    assert not told(1, {"enum": [1.0]}) and not told(1.0, {"const": 1}) and not told([{"a": 2}], {"const": [{"a": 2.0}]})
    assert told(True, {"enum": [1]}) and told(1, {"const": True}) and told(0, {"enum": [False, None, ""]}) and told("1", {"enum": [1]})
    assert not told(True, {"const": True}) and not told(None, {"enum": [None]}) and told([1], {"const": [1, 1]}) and told({"a": 1}, {"const": {"b": 1}})
    big = 2**53 + 1
    assert told(big, {"const": float(2**53)}) and not told(big, {"const": big})


def test_numbers_are_written_alike():
    assert chat_format.canonical({"b": 1.0, "a": [1e2, -0.0, 2.5, 1, True, 1e300]}) == '{"a":[100,0,2.5,1,true,1e+300],"b":1}'
