import random
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import pytest
from oracle import differences

from folioscan.llm import prefix_trie as T
from folioscan.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, Depth string, owner long"


def plain(rows):
    """Nodes straight from the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in children
            saved[s[:d]] += (len(m) - 1) * (len(s[-1][1]) if s else 0)
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(children[s]) if s in children else 0, leaves[s], saved[s], sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(s)).encode()).hexdigest())
        for s, m in members.items()
    )


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(tuple(-1 if v is None else v for v in r) for r in T.build(df, **more).collect())


def random_rows(seed, n, convs, turns):
    r = random.Random(seed)
    return [(r.choice(convs), r.choice([None, *range(turns)]), r.choice(["a", "b", None, ""]), r.choice([None, "", "x", "yé", "zzz"])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "convs", "turns", "stretch"), [(1, 900, [None, *range(0, 260)], 4, 1024), (2, 900, [*range(-120, 130), 10**12], 9, 2), (3, 600, [5, 100, 105, 200], 300, 16)])
def test_equals_the_definition(spark, seed, n, convs, turns, stretch):
    rows = random_rows(seed, n, convs, turns)
    assert found(spark, rows, stretch=stretch) == plain(rows)


def test_copies_a_long_one_and_turnless_conversations(spark):
    rows = [(c, t, "u", f"m{t}") for c in range(1000, 1300) for t in range(7)]  # copies of one another
    rows += [(c, 0, "u", "only") for c in range(2050, 2090)]  # no base: most are left without turns
    rows += [(50, t, "u", "again") for t in range(700)]  # no base, equal turns
    got = found(spark, rows, stretch=64)
    assert got == plain(rows)
    assert any(r[1] == 0 and r[7] != sha256(b"").hexdigest() for r in got)


def test_many_light_levels(spark):
    rows = []
    for c in range(128):  # a full binary tree: every node has a light child
        rows += [(100 * c + 1, 10 + t, "u", str(c >> t & 1)) for t in range(7)]
    keep = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6 == 0] or rows
    assert found(spark, rows) == plain(rows) and found(spark, keep) == plain(keep)


def test_empty(spark):
    assert found(spark, []) == []


def test_pieces_of_a_hash(spark):
    df = spark.createDataFrame([(1, 2, i) for i in range(5000)] + [(1, 3, -7)], "k1 long, k2 long, conv_id long").repartition(5)
    got = {(r[0], r[1]): r[2] for r in T.joined_hash(df, 100).collect()}
    assert got == {(1, 2): sha256(",".join(map(str, range(5000))).encode()).hexdigest(), (1, 3): sha256(b"-7").hexdigest()}


def test_query_equals_sql(spark, sf):
    assert differences(QUERIES["op12_prefix_trie"](spark, sf), ORACLE_SQL["op12_prefix_trie"], sf) is None
