"""Prefix tries against a plain version."""

import collections
import hashlib
import random
import zlib

import pytest

from ledgerlake.llm import prefix_trie


def _plain(rows):
    h = lambda x: hashlib.md5(x.encode()).hexdigest()
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, h(h(role or "") + h(text or "")), (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(turns):
        head = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        path = tuple(turns.get(base, [])[:head] + turns[c][head:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), below[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def _got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, a int, depth string").repartition(5)
    out = prefix_trie.prefix_nodes(df, **more)
    assert [(n, t) for n, t in out.dtypes if t != "bigint"] == [("ends_sha256", "string")]
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


def _rows(seed, n=120, words=("a", "é", "ccc")):
    """Conversations of few texts, so that they share turns; a third are the same one; ties, repeats, nulls and gaps in the ids."""
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-20, 3 * n), n):
        if c % 3 == 0:
            out += [(c, t, "user", "always the same") for t in range(5)]
        else:
            out += [(c, rng.choice([None, t, t, t, 2]), rng.choice(["user", "user", None]), rng.choice([*words, None, ""])) for t in range(rng.randint(1, 12))]
    return out + [(None, 1, "user", "of none"), (7, 1, "user", "a"), (7, 1, "user", "a")]


@pytest.mark.parametrize("more", [{}, {"most": 12, "block": 3, "bits": 2}, {"most": 1, "block": 2, "bits": 1}])
def test_equals_plain_version(spark, more):
    rows = _rows(1, 40 if more.get("most") == 1 else 120)
    assert _got(spark, rows, **more) == _plain(rows)


def test_one_long_conversation_and_many_copies_of_a_short_one(spark):
    """The long one is a subtrie over the bound without a fork: it needs no task of its own."""
    rows = [(1_000_003, t, "user", f"turn {t}") for t in range(900)] + [(c, t, "user", f"turn {t}") for c in range(0, 300, 5) for t in range(3)]
    assert _got(spark, rows, most=50, block=16) == _plain(rows)


def test_no_conversation(spark):
    assert _got(spark, []) == [] and _got(spark, [(None, 1, "user", "x")]) == []
    assert _got(spark, [(0, None, None, None)]) == _plain([(0, None, None, None)])
