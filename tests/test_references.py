"""Deletes follow every declared reference."""

import datetime as dt

from vantage.operators import references as R

T0 = dt.datetime(2024, 1, 1)


def tables(spark):
    return {
        "streamers": spark.createDataFrame([(1, "a"), (2, "b")], "streamer_id long, username string"),
        "categories": spark.createDataFrame([(7,), (8,)], "category_id long"),
        "broadcasts": spark.createDataFrame([(10, 1, 7), (11, 2, 7), (12, 2, 8), (13, 2, None)], "broadcast_id long, streamer_id long, primary_category_id long"),
        "broadcast_snapshots": spark.createDataFrame(
            [(10, 1, T0, 7), (11, 2, T0, 8), (12, 2, T0, 7), (10, 2, T0, 8), (99, None, T0, None)],
            "broadcast_id long, streamer_id long, snapshot_timestamp timestamp_ntz, category_id long",
        ),
        "streamer_statistics": spark.createDataFrame(
            [(1, dt.date(2024, 1, 1), 7), (2, dt.date(2024, 1, 1), 7)], "streamer_id long, calculation_date date, top_category_id long"
        ),
    }


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_cascade(spark):
    marked = R.delete_rows(tables(spark), "streamers", spark.createDataFrame([(1,), (1,), (None,)], "streamer_id long"))
    assert list(marked) == ["streamers", "broadcasts", "streamer_statistics", "broadcast_snapshots"] or set(marked) == {
        "streamers", "broadcasts", "broadcast_snapshots", "streamer_statistics",
    }
    left = {n: R.remaining(df) for n, df in marked.items()}
    assert rows(left["streamers"], "streamer_id") == [(2,)]
    assert rows(left["broadcasts"], "broadcast_id") == [(11,), (12,), (13,)]
    # a snapshot of a deleted session goes although its own entity stays
    assert rows(left["broadcast_snapshots"], "broadcast_id", "category_id") == [(11, 8), (12, 7), (99, None)]
    assert rows(left["streamer_statistics"], "streamer_id", "top_category_id") == [(2, 7)]
    assert rows(R.touched_keys(marked), "table_name", "effect", "id") == [
        ("broadcast_snapshots", "deleted", 10), ("broadcast_snapshots", "deleted", 10), ("broadcasts", "deleted", 10),
        ("streamer_statistics", "deleted", 1), ("streamers", "deleted", 1),
    ]


def test_set_null(spark):
    marked = R.delete_rows(tables(spark), "categories", spark.createDataFrame([(7,)], "category_id long"))
    left = {n: R.remaining(df) for n, df in marked.items()}
    assert set(left) == {"categories", "broadcasts", "broadcast_snapshots", "streamer_statistics"}
    assert rows(left["categories"], "category_id") == [(8,)]
    assert rows(left["broadcasts"], "broadcast_id", "primary_category_id") == [(10, None), (11, None), (12, 8), (13, None)]
    assert rows(left["broadcast_snapshots"], "category_id") == [(8,), (8,), (None,), (None,), (None,)]
    assert rows(left["streamer_statistics"], "top_category_id") == [(None,), (None,)]
    assert rows(R.touched_keys(marked), "table_name", "effect", "id") == [
        ("broadcast_snapshots", "category_id", 10), ("broadcast_snapshots", "category_id", 12), ("broadcasts", "primary_category_id", 10),
        ("broadcasts", "primary_category_id", 11), ("categories", "deleted", 7), ("streamer_statistics", "top_category_id", 1),
        ("streamer_statistics", "top_category_id", 2),
    ]


def test_session_delete_and_no_ids(spark):
    marked = R.delete_rows(tables(spark), "broadcasts", spark.createDataFrame([(10,)], "broadcast_id long"))
    assert rows(R.touched_keys(marked), "table_name", "id") == [("broadcast_snapshots", 10), ("broadcast_snapshots", 10), ("broadcasts", 10)]
    none = R.delete_rows(tables(spark), "streamers", spark.createDataFrame([], "streamer_id long"))
    assert R.touched_keys(none).count() == 0 and R.remaining(none["broadcasts"]).count() == 4
