import pathlib

from tekstra.llm import common


def test_stored_tables_are_read_again_and_forgotten(spark):
    df = common.stored(spark.range(5))
    assert df.count() == 5
    path = pathlib.Path(common._STORED[-1].removeprefix("file:"))
    assert path.exists()
    common.forget(spark)
    assert not path.exists()


def test_slices_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * (4 << 20)] * 9})
    parts = list(common.slices(batch))
    assert sum(p.num_rows for p in parts) == 9 and max(p.num_rows for p in parts) <= 2
    assert list(common.slices(batch.slice(0, 0))) == []


def test_claims_drop_the_caches_of_other_operators(monkeypatch):
    monkeypatch.setattr(common, "_CACHES", {})
    dropped = []
    common.claim("a", lambda: dropped.append("a"))
    common.claim("a", lambda: dropped.append("a"))
    assert dropped == []
    common.claim("b", lambda: dropped.append("b"))
    assert dropped == ["a"] and set(common._CACHES) == {"b"}
