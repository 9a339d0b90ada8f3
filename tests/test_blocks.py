"""Array blocks in row ranges: types, shapes, folders, and files that can't be read."""

import os

import numpy as np
import pytest

from scorelake.sources import blocks as B


def save(path, array):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    np.save(path, array)


def rows_of(df):
    return sorted((r["file"], r["row_idx"], tuple(r["values"])) for r in df.collect())


def test_one_block_is_read_by_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    arrays = {"a/one.npy": rng.normal(size=(1000, 6)).astype("f4"), "b/two.npy": rng.integers(-5, 5, (7, 2, 3)).astype(">i2"), "three.npy": rng.random((3, 6)) > 0.5, "none.npy": np.zeros((0, 6))}
    for name, array in arrays.items():
        save(f"{tmp_path}/{name}", array)
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "_part.npy").write_bytes(b"x")
    df = B.read_blocks(spark, str(tmp_path), 6, range_bytes=100 * 24)
    assert df.rdd.getNumPartitions() == 12
    want = sorted((n, i, tuple(row.ravel().astype("f4").tolist())) for n, a in arrays.items() for i, row in enumerate(a))
    assert rows_of(df) == want
    assert rows_of(B.read_blocks(spark, f"file://{tmp_path}", 6)) == want


def test_a_task_reads_its_own_bytes_only(tmp_path):
    """A block of 3 GB with holes: a range near its end is read alone."""
    path, rows = f"{tmp_path}/large.npy", 50_000_000
    with open(path, "wb") as f:
        np.lib.format.write_array_header_2_0(f, {"descr": "<f4", "fortran_order": False, "shape": (rows, 16)})
        start = f.tell()
        f.seek(start + (rows - 1) * 64)
        f.write(np.arange(16, dtype="<f4").tobytes())
    assert os.path.getsize(path) > 2 << 30 and os.stat(path).st_blocks * 512 < 1 << 20
    reader = B._Reader({"path": str(tmp_path), "dims": "16"})
    ranges = reader.partitions()
    assert len(ranges) > 40 and sum(r.rows for r in ranges) == rows
    last = list(reader.read(ranges[-1]))
    assert max(b.nbytes for b in last) < 10 << 20
    assert last[-1].column("row_idx")[-1].as_py() == rows - 1 and last[-1].column("values")[-1].as_py() == list(range(16))


def test_empty_folder(spark, tmp_path):
    assert B.read_blocks(spark, str(tmp_path), 4).collect() == []


@pytest.mark.parametrize("array, message", [(np.zeros((3, 5)), "expected 4"), (np.asfortranarray(np.ones((3, 4))), "by columns"), (np.array([["a"] * 4]), "no numbers"), (np.array(1.0), "no rows")])
def test_unreadable_blocks_are_errors(spark, tmp_path, array, message):
    save(f"{tmp_path}/x.npy", array)
    with pytest.raises(Exception, match=message):
        B.read_blocks(spark, str(tmp_path), 4).collect()


def test_cut_off_block(spark, tmp_path):
    save(f"{tmp_path}/x.npy", np.zeros((100, 4)))
    with open(f"{tmp_path}/x.npy", "r+b") as f:
        f.truncate(500)
    with pytest.raises(Exception, match="ends before its last row"):
        B.read_blocks(spark, str(tmp_path), 4).collect()
