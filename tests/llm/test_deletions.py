"""Line dedup's filters after keys come and go, over many tables of a shard."""

import numpy as np
import pytest

from panelspark.llm import linededup
from panelspark.llm.linededup import Cuckoo, changed_tables


def some_keys(rng, n):
    return rng.integers(-(1 << 62), 1 << 62, (n, 2))


NONE = np.zeros((0, 2), dtype=np.int64)


def held(tables, keys):
    return np.array([t.lookup(keys[:, 0], keys[:, 1]) for t in tables]).any(axis=0)


@pytest.mark.parametrize("narrow", [False, True])
def test_no_key_is_lost_when_others_go(narrow):
    """1,260 keys stay while 40,000 others come and go in batches; ``narrow``: few fingerprints, so that many are equal."""
    rng = np.random.default_rng(4)
    stay, come = some_keys(rng, 1260), some_keys(rng, 40_000)
    if narrow:
        stay[:, 1], come[:, 1] = stay[:, 1] % 50, come[:, 1] % 50
    tables = changed_tables([], NONE, stay)
    for batch in np.split(come, 8):
        tables = changed_tables(tables, NONE, batch)
        assert held(tables, stay).all() and held(tables, batch).all()
    assert len(tables) > 3 and len({len(t.table) for t in tables}) == 1
    order = rng.permutation(len(come))
    for part in np.split(order, 8):
        tables = changed_tables(tables, come[part], NONE)
        assert held(tables, stay).all()
    assert sum(int((t.table > 0).sum()) for t in tables) == len(stay)
    tables = changed_tables(tables, stay[:1000], come[:5000])
    assert held(tables, stay[1000:]).all() and held(tables, come[:5000]).all()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 900])
def test_few_keys_make_a_table(n):
    keys = some_keys(np.random.default_rng(n), n)
    tables = changed_tables([], NONE, keys)
    assert held(tables, keys).all() and not sum(int((t.table > 0).sum()) for t in changed_tables(tables, keys, NONE))


def test_tables_are_read_back_as_they_were():
    rng = np.random.default_rng(5)
    tables = changed_tables(changed_tables([], NONE, some_keys(rng, 100)), NONE, some_keys(rng, 9000))
    again = [Cuckoo.from_bytes(t.to_bytes()) for t in tables]
    assert all((a.table == b.table).all() for a, b in zip(tables, again, strict=True))


def test_lines_to_drop_are_the_same_after_a_batch_came_and_went(spark, monkeypatch):
    monkeypatch.setattr(linededup, "LEAST_SHARDS", 1)
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(d, "\n".join(f"a line that three hold, number {k:05d}" for k in range(60))) for d in range(3)], schema)
    batch = spark.createDataFrame([(10 + d, "\n".join(f"another line of the batch {k:06d}" for k in range(20_000))) for d in range(3)], schema)
    one, two = linededup.document_keys(first, 20), linededup.document_keys(batch, 20)
    state = linededup.inserted(linededup.empty_state(spark, 10), one)
    dropped = sorted(map(tuple, linededup.dropped_keys(one, state).collect()))
    assert len(dropped) == 120
    grown = linededup.inserted(state, two)
    assert linededup.dropped_keys(one.unionByName(two), grown).count() == 120 + 40_000
    after = linededup.deleted(grown, two, one)
    assert sorted(map(tuple, linededup.dropped_keys(one, after).collect())) == dropped
