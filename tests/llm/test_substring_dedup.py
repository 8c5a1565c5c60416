import random

import pytest

from folioscan.llm import substring_dedup as D
from folioscan.llm.common import table
from folioscan.llm.suffix_groups import suffix_array

SCHEMA = "doc_id long, text string, batch string, kind int"


def test_suffix_array_against_sorting():
    r = random.Random(1)
    for _ in range(2000):
        a = r.choice([1, 2, 3, 8])
        s = [r.randrange(1, a + 1) for _ in range(r.randrange(60))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array([]) == []


def compared(spark, rows, length, batch_bytes):
    df = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    found = D.remove_repeats(df, length, batch_bytes, max(200, batch_bytes // 2)).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=str)
    assert got == sorted(D.plain(rows, length), key=str)
    assert all(sum(s["end"] - s["start"] for s in r.spans) == r.n_removed for r in found)
    return found


@pytest.mark.parametrize(("length", "batch_bytes"), [(50, 1 << 20), (50, 700), (30, 900), (9, 400), (5, 400)])
def test_against_plain_form(spark, length, batch_bytes):
    r = random.Random(length + batch_bytes)
    letters = "abcdé "
    parts = ["".join(r.choice(letters) for _ in range(r.randrange(2, 3 * length))) for _ in range(12)] + ["a" * 3 * length, "ab" * 2 * length]
    rows = []
    for i in range(70):
        t = "".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(r.randrange(5)))
        rows.append((i if r.random() < 0.9 else r.choice([None, 3, 5]), t))
        if r.random() < 0.3:
            k = r.randrange(len(t) + 1)
            rows.append((200 + i, t[:k] + r.choice(letters) + t[k + r.randrange(2) :]))
    rows += [(900, None), (901, ""), (None, parts[0]), (None, parts[0]), (7, parts[1] * 2), (7, parts[1] * 2)]
    compared(spark, rows, length, batch_bytes)


def test_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    found = compared(spark, rows, 50, 60_000)
    assert sum(r.n_removed for r in found) > 0


def test_empty(spark):
    assert D.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_empty_texts_are_many_batches(spark):
    rows = [(i, "") for i in range(300)] + [(i, "x" * (i % 3)) for i in range(300, 400)]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert D.remove_repeats(df, 50, 2000, 2000).count() == 400


def test_keys_of_96_bits():
    import numpy as np

    high, low = np.array([5, 5, 7, 9, 1], np.uint64), np.array([1, 2, 3, 4, 5], np.uint32)
    some = np.array([5, 5, 5, 9], np.uint64), np.array([7, 2, 3, 0], np.uint32)
    assert D.among_full(high, low, some).tolist() == [False, True, False, False, False]
    assert not D.among_full(high, low, (some[0][:0], some[1][:0])).any()


def test_wider_symbols_keep_the_order():
    import numpy as np

    from folioscan.llm.suffix_groups import widened

    r = random.Random(2)
    for _ in range(500):
        s = [r.randrange(1, r.choice([2, 4, 200])) for _ in range(r.randrange(60))] + [0]
        wide = widened(np.array(s, np.int64))
        assert suffix_array(wide) == suffix_array(s) and len(set(wide.tolist())) >= len(set(s))


def test_ranges_are_joined_within_a_document():
    import numpy as np

    first, end, owner = np.array([9, 0, 3, 7, 12, 13]), np.array([12, 3, 5, 8, 14, 15]), np.array([0, 0, 0, 0, 1, 1])
    assert [x.tolist() for x in D.joined(first, end, owner)] == [[0, 7, 9, 12], [5, 8, 12, 15], [0, 0, 0, 1]]
    assert [len(x) for x in D.joined(first[:0], end[:0], owner[:0])] == [0, 0, 0]
