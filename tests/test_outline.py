import random

from folioscan.operators import outline as O
from folioscan.operators import tree_match as T

SCHEMA = "doc_id long, seq int, title string, level int"


def parents(levels):
    """The stack rule, straight."""
    out, stack = [], []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        out.append(list(stack))
        stack.append(i)
    return out


def test_levels_of_any_size_equal_the_stack(spark):
    r = random.Random(4)
    docs = {d: [r.randrange(10) for _ in range(r.randrange(1, 40))] for d in range(60)} | {99: [7, 8, 0, 1], 100: [-3, 12, 500, 12]}
    rows = [(d, i, f"t{i}", level) for d, levels in docs.items() for i, level in enumerate(levels)]
    r.shuffle(rows)
    got = {(x["doc_id"], x["seq"]): x for x in O.build_outline(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, levels in docs.items():
        chains = parents(levels)
        for i, chain in enumerate(chains):
            x = got[d, i]
            assert [a["seq"] for a in x["ancestors"]] == chain and x["parent_seq"] == (chain[-1] if chain else None)
            assert x["path"] == " > ".join(f"t{k}" for k in chain) and x["depth"] == len(chain) and x["pre"] == i
            assert x["end"] == max([k for k, c in enumerate(chains) if i in c], default=i)
    assert len(got) == len(rows)


def test_null_titles_and_levels_gaps_and_one_document_with_most_rows(spark):
    rows = [(1, 5, None, 2), (1, 9, "a", None), (1, 11, "b", 1), (None, 0, "x", 1), (None, 3, "y", 2)] + [(2, i, "t", i % 7) for i in range(3000)]
    got = {(x["doc_id"], x["seq"]): x for x in O.build_outline(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 9]["parent_seq"] is None and got[1, 11]["parent_seq"] == 9 and got[1, 11]["pre"] == 2
    assert got[None, 3]["parent_seq"] == 0
    chains = parents([i % 7 for i in range(3000)])
    assert all(got[2, i]["parent_seq"] == (c[-1] if c else None) for i, c in enumerate(chains))
    assert O.build_outline(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_descent(left, right):
    """left, right: (title, level) lists; the recursion on both trees."""
    def kids(rows, chains, p):
        return [i for i, c in enumerate(chains) if (c[-1] if c else None) == p]

    lc, rc, out = parents([x[1] for x in left]), parents([x[1] for x in right]), {}

    def go(a, b):
        for i in kids(left, lc, a):
            m = next((j for j in kids(right, rc, b) if left[i][0] in right[j][0] or right[j][0] in left[i][0]), None)
            out[i] = m
            if m is not None:
                go(i, m)

    go(None, None)
    return out


def test_descent_of_one_template_that_serves_all_pairs(spark):
    r = random.Random(8)
    words = ["aa", "bb", "aabb", "cc", "c", "abba", ""]
    docs = {d: [(r.choice(words), r.randrange(0, 9)) for _ in range(r.randrange(0, 25))] for d in range(1, 80)}
    docs[0] = [(r.choice(words), r.randrange(0, 9)) for _ in range(60)]
    rows = [(d, i, t, level) for d, doc in docs.items() for i, (t, level) in enumerate(doc)]
    outline = O.build_outline(spark.createDataFrame(rows, SCHEMA))
    pairs = spark.createDataFrame([(d, 0, d) for d in range(1, 80)], "pair_id long, template_doc_id long, target_doc_id long")
    got = {(x["pair_id"], x["seq"]): x["match"] for x in T.tree_descent(pairs, outline, "template_doc_id", "target_doc_id").collect()}
    want = {(d, i): m for d in range(1, 80) for i, m in plain_descent(docs[0], docs[d]).items()}
    assert got == want
    extra = sorted((x["pair_id"], x["seq"]) for x in T.tree_extra(pairs, outline).collect())
    more = []
    for d in range(1, 80):
        found, chains = plain_descent(docs[d], docs[0]), parents([x[1] for x in docs[d]])
        for i in range(len(docs[d])):
            if any(found.get(k, 0) is None and k in found for k in [*chains[i], i]):
                more.append((d, next(k for k in range(len(docs[d])) if docs[d][k][0] == docs[d][i][0])))
    assert extra == sorted(more)
    share = {x["pair_id"]: x["similarity"] for x in T.tree_similarity(pairs, outline).collect()}
    assert share == {d: sum(m is not None for m in plain_descent(docs[0], docs[d]).values()) / 60 for d in range(1, 80)}


def test_similar_titles_of_large_families_equal_the_plain_search():
    r = random.Random(2)
    for _ in range(300):
        left, right = (["".join(r.choice("ab ") for _ in range(r.randrange(5))) for _ in range(r.choice([3, 40]))] for _ in range(2))
        assert T.first_similar(left, right) == [next((j for j, y in enumerate(right) if x in y or y in x), None) for x in left]


def test_one_descent_has_few_exchanges(spark):
    rows = spark.createDataFrame([(d, i, f"t{i}", 1 + i % 3) for d in range(9) for i in range(5)], SCHEMA)
    pairs = spark.createDataFrame([(d, 0, d) for d in range(1, 9)], "pair_id long, template_doc_id long, target_doc_id long")
    plan = T.tree_missing(pairs, O.build_outline(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20 and "MapInArrow" in plan
