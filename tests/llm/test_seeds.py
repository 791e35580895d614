"""The masks of decontamination reach every pattern of substitutions that counts."""

from itertools import combinations

import numpy as np
import pytest

from leadspark.llm import decontaminate


@pytest.mark.parametrize("n", range(1, 21))
def test_every_pattern_has_a_hit(n):
    """All stretches of n tokens with equal ends and at most a fifth substituted; items below 13 tokens with any tokens substituted."""
    table = decontaminate.Table([(0, " ".join(f"w{k}" for k in range(n)))])
    width = max(map(len, table.masks))
    for count in range(n // 5 + 1):
        for changed in combinations(range(n) if n < decontaminate.LEAST else range(1, n - 1), count):
            ids = np.concatenate([np.zeros(width, dtype=np.uint64), table.items[0], np.zeros(width, dtype=np.uint64)])
            ids[np.array(changed, dtype=int) + width] = 1
            hits = table.enough(ids, table.hits(ids), decontaminate.LEAST)
            assert [0, width] in hits.tolist(), changed
            assert table.agreed(ids, 0, width, decontaminate.LEAST) == n


def test_short_items_with_one_changed_word(spark):
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(5, 13)]
    rows = [(100 * n + k, "some words " + " ".join("other" if i == k else t for i, t in enumerate(text.split())) + " and more")
            for n, text in items for k in range(n)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.item_ids == [r.doc_id // 100] for r in got)


def test_two_changed_words_in_a_short_item_are_too_many(spark):
    items = [(7, "a b c d e f g")]
    rows = [(1, "x b c d e f y"), (2, "x b c d e f g"), (3, "b c d e f g"), (4, "c d e f g"), (5, "a b c d e f"), (6, None)]
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id for r in got if r.contaminated} == {2, 3, 5}


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{k}" for k in range(8 + i))) for i in range(12)]
    rows = [(i, "start " + " ".join(t for _, t in items[i:i + 3]) + " end") for i in range(12)] + [(50, None), (51, "clean words"), (None, items[3][1]), (None, items[3][1])]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    read = lambda: (sorted(map(str, decontaminate.contamination(docs, tests).collect())), sorted(map(str, decontaminate.drop_contaminated(docs, tests).collect())))
    whole = read()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert decontaminate._blocks(tests)[0] > 4 and read() == whole
