"""Archives by an index of their members: ranges, wanted names, damage and large files."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F

from gaugeframe.sources import members


def archive(files, form=tarfile.PAX_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as tar:
        for n, c in files:
            info = tarfile.TarInfo(n)
            info.size = len(c)
            tar.addfile(info, io.BytesIO(c))
    return out.getvalue()


def walked(data):
    return list(members.walk(io.BytesIO(data), len(data)))


LONG = "d/" * 80 + "é.txt"
FILES = [("a.txt", b"one"), (LONG, b"x" * 3000), ("empty", b""), ("inner.tar", archive([("hidden", b"no member of the outer one")])), ("a.txt", b"again")]


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_walk_finds_the_bytes_of_each_file(form):
    data = archive(FILES, form)
    assert [(n, data[s : s + k]) for n, s, k, _ in walked(data)] == FILES
    assert walked(archive([])) == [] and walked(b"") == []


def test_walk_goes_on_after_damage():
    data = bytearray(archive([(f"f{i}", bytes([65 + i]) * 700) for i in range(4)], tarfile.GNU_FORMAT))
    (_, start, _, _) = walked(bytes(data))[1]
    data[start - 512 : start - 412] = b"?" * 100
    found = walked(bytes(data))
    assert [n or "gap" for n, *_ in found] == ["f0", "gap", "f2", "f3"]
    assert found[1][1] == start - 512 and found[1][1] + found[1][2] == found[2][1] - 512
    cut_off = walked(archive(FILES)[: 512 * 8])
    assert [bool(g) for *_, g in cut_off].count(True) == 1 and cut_off[-1][3] == "a member is cut off"
    assert walked(b"nonsense" * 200)[0][0] is None


def test_contents_by_pieces_and_wanted_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(members, "PIECE", 1000)
    monkeypatch.setattr(members, "SPAN", 2048)
    (tmp_path / "one.tar").write_bytes(archive(FILES))
    (tmp_path / "two.tar").write_bytes(archive([("b.txt", b"y" * 2000), ("a.txt", b"two")])[:3074])
    (tmp_path / "three.tar").write_bytes(b"\x1f\x8b rest")
    (tmp_path / "none.tar").write_bytes(b"")
    wanted = spark.createDataFrame([("a.txt",), ("a.txt",), (LONG,), ("empty",), ("b.txt",), ("hidden",), (None,)], "name string")
    rows = members.wanted_contents(spark, str(tmp_path), wanted).collect()
    whole = {}
    for r in sorted((r for r in rows if r.gap is None), key=lambda r: r.piece):
        assert len(r.content) <= 1000
        whole.setdefault((r.archive.rsplit("/", 1)[1], r.name, r.size), []).append(bytes(r.content))
    assert {k: b"".join(v) for k, v in whole.items() if k[1] != "a.txt"} == {("one.tar", LONG, 3000): b"x" * 3000, ("one.tar", "empty", 0): b"", ("two.tar", "b.txt", 2000): b"y" * 2000}
    assert sorted(c for k, v in whole.items() if k[1] == "a.txt" for c in v) == [b"again", b"one"]
    assert sorted(r.archive.rsplit("/", 1)[1] for r in rows if r.gap) == ["three.tar", "two.tar"]


def test_written_archives_come_back(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 3).alias("a"), F.concat(F.lit("n"), "id").alias("n"), F.repeat(F.lit("z"), F.col("id").cast("int")).alias("c"))
    rows = rows.unionByName(spark.createDataFrame([(1, None, "c"), (None, "n", "c")], "a long, n string, c string"))
    done = members.write_archives(rows, F.concat(F.col("a").cast("string"), F.lit(".tar")), F.col("n"), F.col("c"), str(tmp_path / "out"))
    assert {r.archive: r.members for r in done.collect()} == {"0.tar": 17, "1.tar": 17, "2.tar": 16}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0.tar", "1.tar", "2.tar"]
    assert all((tmp_path / "out" / r.archive).stat().st_size == r.bytes for r in done.collect())
    got = members.contents(members.member_index(spark, str(tmp_path / "out"))).collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.name, bytes(r.content)) for r in got) == sorted((f"{i % 3}.tar", f"n{i}", b"z" * i) for i in range(50))
