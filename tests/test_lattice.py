"""The lattice source against plain arrays."""

import numpy as np
import pytest

from arbora.sources import lattice


def table(spark, volume):
    rows = []
    for z in range(volume.shape[0]):
        rows += [tuple(r.values()) for r in lattice._runs(volume[z], z).to_pylist()]
    return spark.createDataFrame(rows, lattice.SCHEMA).repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def volume():
    rng = np.random.default_rng(2)
    v = np.zeros((23, 17, 41), np.uint8)
    v[3:9, 2:12, 5:33] = 7
    v[10:12] = rng.integers(0, 3, (2, 17, 41))
    v[12] = 255
    v[22, 16, 40] = 1
    return v


def test_packets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 127, 128, 300, 5000):
        for high in (2, 3, 250):
            x = np.repeat(rng.integers(0, high, n), rng.integers(1, 5, n)).astype(np.uint8)
            cut = np.flatnonzero(np.diff(x)) + 1
            raw = lattice.encode([(int(p[0]), len(p)) for p in np.split(x, cut) if len(p)])
            assert (lattice.decode(raw, 0, len(x)) == x).all()
            assert len(raw) <= len(x) + len(x) // 127 + 2
            if len(x) > 20:
                assert (lattice.decode(raw, 13, 5) == x[13:18]).all()


def test_round_trip(spark, volume, tmp_path):
    df, path = table(spark, volume), str(tmp_path / "mask.am")
    lattice.write(df, path, (41, 17, 23), (0.0, 4.0, 0.0, 1.6, -1.0, 1.2), materials=("Exterior", "Vessel"), slices=4)
    head = lattice.read_header(path)
    assert head[:4] == (41, 17, 23, (0.0, 4.0, 0.0, 1.6, -1.0, 1.2)) and head.materials == ("Exterior", "Vessel")
    back = lattice.read(spark, path, slices=5)
    assert back.rdd.getNumPartitions() == 5 and rows(back) == rows(df)
    # header and parts, one after another, are one file
    whole = tmp_path / "whole.am"
    whole.write_bytes(b"".join((tmp_path / "mask.am" / n).read_bytes() for n in ["header", *(f"part-{k:05d}" for k in range(6))]))
    assert rows(lattice.read(spark, str(whole), slices=7)) == rows(df)
    assert rows(lattice.read(spark, f"file://{whole}", slices=100)) == rows(df)
    with pytest.raises(FileExistsError):
        lattice.write(df, path, (41, 17, 23))


def test_packets_across_slices_and_plain_bytes(spark, volume, tmp_path):
    """Files of other writers: one stream, packets that run over slices; or no packets at all."""
    flat = volume.ravel()
    packed = lattice.encode([(int(p[0]), len(p)) for p in np.split(flat, np.flatnonzero(np.diff(flat)) + 1)])
    text = lattice.header_text(41, 17, 23, (0, 1, 0, 1, 0, 1), len(packed))
    one, plain = tmp_path / "one.am", tmp_path / "plain.am"
    one.write_bytes(text.encode() + packed + b"\n@2\nrest")
    plain.write_bytes(text.replace(f"({lattice.PACKED},{len(packed)})", "").encode() + flat.tobytes())
    want = rows(table(spark, volume))
    for path in (one, plain):
        for step in (1, 3, 64):
            assert rows(lattice.read(spark, str(path), slices=step)) == want


def test_slices_are_pushed(spark, volume, tmp_path):
    path = str(tmp_path / "m")
    lattice.write(table(spark, volume), path, (41, 17, 23), slices=4)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = lattice.read(spark, path, slices=1).where("z >= 10 and z < 12 and y > 3")
        assert some.rdd.getNumPartitions() == 2
        assert rows(some) == rows(table(spark, volume).where("z >= 10 and z < 12 and y > 3"))
        assert rows(lattice.read(spark, path).where("z in (3, 22) and z <> 3")) == rows(table(spark, volume).where("z = 22"))
        assert lattice.read(spark, path).where("z = 99").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_what_is_refused(spark, volume, tmp_path):
    df = table(spark, volume)
    for bad in ("z + 5 as z", "z - 4 as z"):
        with pytest.raises(ValueError):
            lattice.write(df.selectExpr(bad, "y", "x0", "x1", "value"), str(tmp_path / "bad"), (41, 17, 23))
    with pytest.raises(ValueError):
        lattice.slice_bytes([(0, 0, 5, 1), (0, 3, 6, 2)], 9, 2)
    with pytest.raises(ValueError):
        lattice.slice_bytes([(0, 0, 10, 1)], 9, 2)
    assert lattice.slice_bytes([(0, 0, 5, 1), (0, 3, 6, 1)], 9, 1) == lattice.slice_bytes([(0, 0, 6, 1)], 9, 1)
    text = lattice.header_text(4, 4, 2, (0, 1, 0, 1, 0, 1), 2)
    for broken in (text.replace("define", "x"), text.replace("byte Labels", "float Labels"), text.replace('"uniform"\n}', '"other"\n}'), text.replace("@1\n", "")):
        with pytest.raises(ValueError):
            lattice.parse_header(broken.encode())
    short = tmp_path / "short.am"
    short.write_bytes(text.encode() + bytes([16, 1]))
    with pytest.raises(Exception, match="ends after 16"):
        lattice.read(spark, str(short)).count()


def test_empty_lattice(spark, tmp_path):
    none = spark.createDataFrame([], lattice.SCHEMA)
    lattice.write(none, str(tmp_path / "e"), (5, 4, 3))
    assert lattice.read(spark, str(tmp_path / "e")).count() == 0


def test_pieces(spark, tmp_path):
    """Runs far from one another come back from pieces as wide as they are, where the whole lattice would take gigabytes."""
    rng = np.random.default_rng(5)
    want = []
    for k in range(6):
        for i in rng.choice(5000, 300, replace=False):
            want.append((k * 9 + int(i) % 9, int(i) // 9 % 40, k * 100_000 + int(i) * 3, k * 100_000 + int(i) * 3 + 1 + int(i) % 3 // 2, 1 + int(i) % 250))
    runs = spark.createDataFrame(want, "z long, y long, x0 long, x1 long, value int")
    lattice.write_pieces(runs, str(tmp_path / "p"), (600_000, 40, 60), slices=9)
    files = list((tmp_path / "p").glob("piece-*"))
    assert len(files) == 6 and sum(f.stat().st_size for f in files) < 1_000_000  # whole: 600,000 * 40 * 60 / 127 * 2 = 22 MB
    assert sorted(map(tuple, lattice.read_pieces(spark, str(tmp_path / "p")).collect())) == sorted(want)
    with pytest.raises(ValueError, match="outside"):
        lattice.write_pieces(runs, str(tmp_path / "q"), (600_000, 40, 50), slices=9)
    lattice.write_pieces(runs.limit(0), str(tmp_path / "e"), (10, 10, 10))
    assert lattice.read_pieces(spark, str(tmp_path / "e")).count() == 0


def test_pieces_of_runs_spread_over_the_whole_lattice(spark, tmp_path):
    """Runs with far more empty columns, rows and slices between them than they fill; files follow the runs, not the boxes round them."""
    rng = np.random.default_rng(6)
    n = 4000
    rows = {(int(z), int(y), int(x)): (1 + int(v), int(w)) for z, y, x, v, w in zip(rng.integers(0, 90, n), rng.integers(0, 400, n), rng.integers(0, 1_000_000, n) * 4, rng.integers(0, 255, n), rng.integers(1, 4, n))}
    want = sorted((z, y, x, x + w, v) for (z, y, x), (v, w) in rows.items())
    # a row of runs that touch, of one value and of others, and one that two runs overlap in
    touching = [(7, 3, 10 * k, 10 * k + 10, 1 + k % 2) for k in range(3000)]
    twice = [(8, 1, 50, 60, 9), (8, 1, 55, 70, 9), (8, 1, 70, 80, 9)]
    runs = spark.createDataFrame(want + touching + twice, "z long, y long, x0 long, x1 long, value int").repartition(3)
    lattice.write_pieces(runs, str(tmp_path / "p"), (4_000_010, 400, 90), slices=16)
    files = list((tmp_path / "p").glob("piece-*"))
    assert len(files) == 6 and sum(f.stat().st_size for f in files) < 1_000_000  # boxes: 90 * 400 * 4,000,000 / 127 * 2 = 2.3 GB
    assert sorted(map(tuple, lattice.read_pieces(spark, str(tmp_path / "p")).collect())) == sorted([*want, *touching, (8, 1, 50, 80, 9)])
