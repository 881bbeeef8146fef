from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagebundle.llm.sharding import SHARDS, TABLE_SIZE, fill_table, with_shard


def test_the_table_is_even_and_moves_little():
    full = fill_table(SHARDS, TABLE_SIZE)
    sizes = Counter(full)
    assert set(sizes) == set(SHARDS) and max(sizes.values()) - min(sizes.values()) <= 1
    less = fill_table(SHARDS[:-1], TABLE_SIZE)
    gone = sizes[SHARDS[-1]]
    moved = sum(a != b for a, b in zip(full, less))
    assert gone <= moved < 3 * gone
    weighted = Counter(fill_table({"a": 3, "b": 1}, 401))
    assert weighted["a"] in (300, 301, 302)


def test_bad_layouts_are_refused():
    for shards, size in ((["a", "a"], 7), ([], 7), (["a"], 8), ({"a": 0}, 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill_table(shards, size)


def test_rows_keep_their_columns_and_equal_keys_share_a_shard(spark):
    rows = [(1, "x"), (1, "y"), (None, "z"), (2, None)]
    df = spark.createDataFrame(rows, "k long, _slot_ string")
    placed = with_shard(df, "k", ["a", "b", "c"], 7).collect()
    assert len(placed) == 4 and all(r["shard"] in "abc" for r in placed)
    assert len({r["shard"] for r in placed if r["k"] == 1}) == 1
    assert sorted(str(r["_slot_"]) for r in placed) == ["None", "x", "y", "z"]
    assert with_shard(df.limit(0), F.col("k"), ["a"], 2).count() == 0
