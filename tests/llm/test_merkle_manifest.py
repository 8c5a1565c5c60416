import random
import zlib
from hashlib import sha256

import pytest
from oracle import differences

from folioscan.llm import merkle_manifest as M
from folioscan.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, place long, Tree string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, at):
    """(top, siblings from the bottom up, folded function) of one node, straight from the definition."""
    proof = []
    while len(nodes) > 1:
        lo = at // 16 * 16
        proof.append((nodes[lo:at], nodes[at + 1 : lo + 16]))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], at // 16
    return nodes[0], proof


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r[:5]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in by[s]], 0)[0] for s in order]
    out = []
    for k, s in enumerate(order):
        leaves = [x[2] for x in by[s]]
        for i, x in enumerate(by[s]):
            root, upper = climb(subroots, k)
            proof = climb(leaves, i)[1] + upper
            r = x[3]
            low = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            cur = leaf_of((*r[:4], r[4].translate(str.maketrans(M.UPPER, M.LOWER)))) if low else x[2]
            for left, right in proof:
                cur = h(*left, cur, *right)
            out.append((r[0], x[2], subroots[k], root, h(*[d for a, b in proof for d in a + b]), cur, cur == root))
    return sorted(out, key=repr)


def rows_of(n, sources, seed):
    r = random.Random(seed)
    return [(r.choice([None, *range(4 * n)]), r.choice(sources), r.choice([None, "de"]), r.choice([None, 3]), r.choice([None, "", "Äb C", "plain", "X" * r.randrange(3000)]), 0, "t") for _ in range(n)]


@pytest.mark.parametrize(("depth", "top", "n", "sources"), [(3, 1 << 14, 400, [None, "", "a", "ä", "Z"]), (1, 4, 700, [None, "a"]), (1, 4, 300, [str(i) for i in range(90)] + [None]), (1, 1, 40, ["a"]), (1, 2, 600, ["a"] * 500 + [str(i) for i in range(60)])])
def test_equals_the_definition_with_any_number_of_rounds(spark, depth, top, n, sources):
    rows = rows_of(n, sources, n)
    found = M.prove(M.build(spark.createDataFrame(rows, SCHEMA), M.lower_fifth, depth=depth, top=top))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain(rows)


def test_copies_of_one_row_and_a_lone_row(spark):
    rows = [(7, "a", None, 1, "Copy", 0, "")] * 300 + [(1, "b", None, None, None, 0, "")]
    got = M.prove(M.build(spark.createDataFrame(rows, SCHEMA), M.lower_fifth, depth=1, top=3)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    (one,) = M.prove(M.build(spark.createDataFrame(rows[-1:], SCHEMA)), siblings=True).collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["siblings"] == [] and one["proof_sha256"] == h()


def test_siblings_verify(spark):
    rows = [(i, "a" if i % 3 else "b", "x", i, f"t{i}", 0, "") for i in range(70)]
    for r in M.prove(M.build(spark.createDataFrame(rows, SCHEMA), depth=1, top=2), siblings=True).collect():
        assert h(*[d for level in r["siblings"] for d in level]) == r["proof_sha256"] and r["verified"]


@pytest.mark.parametrize("top", [2, 1 << 14])
def test_every_row_is_folded(spark, top):
    """Against a root that is not the table's own no row verifies, and what the rows fold to is the table's."""
    manifest = M.build(spark.createDataFrame([(i, "a" if i % 3 else "b", "x", i, f"T{i}", 0, "") for i in range(70)], SCHEMA), depth=1, top=top)
    found = M.prove(manifest._replace(top=manifest.top | {"root": h("other")})).collect()
    assert {r["folded_root"] for r in found} == {manifest.root} and not any(r["verified"] for r in found) and len(found) == 70


def test_empty(spark):
    manifest = M.build(spark.createDataFrame([], SCHEMA))
    assert manifest.root is None and M.prove(manifest).count() == 0


def test_query_equals_sql(spark, sf):
    assert differences(QUERIES["op13_merkle_manifest"](spark, sf), ORACLE_SQL["op13_merkle_manifest"], sf) is None
