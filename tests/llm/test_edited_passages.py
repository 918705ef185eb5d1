"""Decontamination against all item-sized windows, on passages with edits."""

import collections
import random

from ledgerlake.llm import decontaminate


def test_edited_passages_by_all_windows():
    rng = random.Random(3)
    bag = lambda w: collections.Counter(zip(*(w[k:] for k in range(5))))
    found = collections.Counter()
    for n in (20, 40, 80):
        for _ in range(60):
            item = [f"w{rng.randrange(300)}" for _ in range(n)]
            passage = list(item)
            for _ in range(rng.randrange(4)):
                passage[rng.choice([0, 1, n // 2, n - 1])] = f"x{rng.randrange(300)}"
            words = [f"y{rng.randrange(300)}" for _ in range(30)] + passage + [f"z{rng.randrange(300)}" for _ in range(30)]
            mine = bag(item)
            want = any((mine & w).total() >= 0.8 * (mine | w).total() for w in (bag(words[k : k + n]) for k in range(len(words) - n + 1)))
            got = bool(decontaminate.ItemIndex([" ".join(item)]).matches(" ".join(words)))
            assert got == want
            found[want] += 1
    assert found[True] > 30 and found[False] > 30
