import hashlib
from collections import Counter

import pytest

from rotapanel.llm import sharding


def by_hand(shards, slots):
    def h(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)

    order = [(h(f"shard-{i}|offset") % slots, h(f"shard-{i}|skip") % (slots - 1) + 1) for i in range(shards)]
    owner, nxt, left, i = [None] * slots, [0] * shards, slots, 0
    while left:
        offset, skip = order[i % shards]
        while owner[(offset + nxt[i % shards] * skip) % slots] is not None:
            nxt[i % shards] += 1
        owner[(offset + nxt[i % shards] * skip) % slots] = i % shards
        left, i = left - 1, i + 1
    return owner


def owners(spark, shards, slots):
    return [r.shard for r in sharding.lookup_table(spark, shards, slots).orderBy("slot").collect()]


@pytest.mark.parametrize("shards, slots", [(1, 2), (3, 7), (7, 7), (16, 503), (5, 1009)])
def test_table_is_filled_in_turns(spark, shards, slots):
    assert owners(spark, shards, slots) == by_hand(shards, slots)


def test_slots_are_even_and_stay(spark):
    before, after = owners(spark, 16, 503), owners(spark, 15, 503)
    assert max(Counter(before).values()) - min(Counter(before).values()) <= 1
    moved = sum(a != b for a, b in zip(before, after) if a != 15)
    assert moved < 0.25 * 503  # hashing modulo the number of shards would move 15 of 16


@pytest.mark.parametrize("shards, slots", [(3, 8), (0, 7), (11, 7)])
def test_wrong_sizes(spark, shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, shards, slots)


def test_odd_rows(odd, no_rows):
    rows = sharding.place(odd, instead="text", slots=503).collect()
    assert len(rows) == odd.count() and all(0 <= r.shard < 16 and 0 <= r.slot < 503 for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 2}) == 1
    assert set(odd.columns) <= set(rows[0].asDict()) and rows[0].h == "z"
    assert sharding.place(no_rows, slots=503).count() == 0
