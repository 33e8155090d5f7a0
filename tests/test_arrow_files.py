"""Arrow files as a data source: both formats, nested fields, batches as partitions, order, and what raises."""

import json

import pyarrow as pa
import pytest

from quarry.sources import arrow_files, readers

KIND = pa.schema([("id", pa.string()), ("n", pa.int64()), ("qas", pa.list_(pa.struct([("question", pa.large_string()), ("spans", pa.list_(pa.string()))])))])


def _rows(first, last):
    return [{"id": str(k), "n": k if k % 5 else None, "qas": None if k % 7 == 0 else [{"question": f"é{k}", "spans": ["a"] * (k % 3)}]} for k in range(first, last)]


def _write(path, rows, batch, stream):
    with pa.OSFile(str(path), "wb") as out, (pa.ipc.new_stream if stream else pa.ipc.new_file)(out, KIND) as sink:
        for b in pa.Table.from_pylist(rows, KIND).to_batches(max_chunksize=batch):
            sink.write_batch(b)


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "a b%é"
    at.mkdir()
    _write(at / "data-0.arrow", _rows(0, 100), 7, False)
    _write(at / "data-1.arrow", _rows(100, 150), 20, True)
    _write(at / "data-2.arrow", [], 20, True)
    _write(at / "data-3.arrow", [], 20, False)
    return at


def _read(spark, path, **options):
    arrow_files.register(spark)
    return spark.read.format("arrow_ipc").options(**options).load(str(path))


def test_both_formats_in_order(spark, folder):
    rows = _read(spark, folder, position="p").collect()
    ordered = sorted(rows, key=lambda r: r.p)
    assert len({r.p for r in rows}) == 150
    assert [r.asDict(recursive=True) for r in ordered] == [{**r, "p": o.p} for r, o in zip(_rows(0, 150), ordered)]


def test_batches_are_partitions(spark, folder):
    parts = arrow_files.ArrowReader(str(folder), None, None, None, 1).partitions()
    assert [(p.number, p.first, p.end) for p in parts] == [(0, k, k + 1) for k in range(15)] + [(1, 0, None), (2, 0, None)]
    assert _read(spark, folder, partitionBytes=1).rdd.getNumPartitions() == 17 and _read(spark, folder, partitionBytes=1).count() == 150


def test_columns(spark, folder):
    df = _read(spark, folder, columns="n, id")
    assert df.columns == ["n", "id"] and sorted(r.id for r in df.collect()) == sorted(str(k) for k in range(150))
    with pytest.raises(Exception, match="lack"):
        _read(spark, folder, columns="id,other").collect()


def test_the_list_of_a_stored_dataset(spark, folder):
    _write(folder / "cache-1.arrow", _rows(900, 950), 20, True)
    (folder / "state.json").write_text(json.dumps({"_data_files": [{"filename": "data-1.arrow"}, {"filename": "data-0.arrow"}]}))
    ordered = [int(r.id) for r in sorted(_read(spark, folder, position="p").collect(), key=lambda r: r.p)]
    assert ordered == [*range(100, 150), *range(100)]
    assert _read(spark, folder / "data-1.arrow").count() == 50
    assert _read(spark, "file://" + str(folder).replace("%", "%25").replace(" ", "%20")).count() == 150


def test_what_raises(spark, folder, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception, match="no Arrow files"):
        _read(spark, tmp_path / "none").collect()
    with pa.OSFile(str(folder / "data-4.arrow"), "wb") as out, pa.ipc.new_stream(out, pa.schema([("other", pa.int64())])) as sink:
        sink.write_table(pa.table({"other": [1]}))
    with pytest.raises(Exception, match="lacks"):
        _read(spark, folder).collect()
    with pytest.raises(ValueError, match="parquet or arrow"):
        readers.papers(spark, str(folder), "csv")
