"""Files are read in ranges, of any size; what is read is counted."""

import hashlib
import os

from driftmend.operators.inventory import manifest_diff, source_unchanged
from driftmend.sources.directories import FAN, dir_manifest, header_check, open_file, ranges, read_ranges, tree_hash

LARGE = (1 << 31) + 5


def named(found):
    return found.selectExpr("regexp_extract(path, '([^/]*)$', 1) path", "size", "hash", "problem")


def test_files_past_two_gigabytes(spark, tmp_path):
    """Sparse files: each is hashed in pieces, and those that differ in one late byte are told apart."""
    for folder, tail in (("a", b"x"), ("b", b"y")):
        (tmp_path / folder).mkdir()
        for name in ("same.bin", "other.bin"):
            with open(tmp_path / folder / name, "wb") as f:
                f.write(b"MAGIC" if name == "same.bin" else b"xAGIC")
                f.truncate(LARGE)
                f.seek(LARGE - 2)
                f.write(b"x" if name == "same.bin" else tail)
        (tmp_path / folder / "small").write_bytes(b"MAGIC")
        (tmp_path / folder / "short").write_bytes(b"MA")
    found = {r["path"].rsplit("/", 1)[1]: r["ok"] for r in header_check(spark, str(tmp_path / "a"), b"MAGIC").collect()}
    assert found == {"same.bin": True, "other.bin": False, "small": True, "short": False}
    one, two = (named(dir_manifest(spark, str(tmp_path / f), piece=64 << 20)) for f in "ab")
    rows = {r["path"]: r for r in one.collect()}
    assert rows["small"]["hash"] == hashlib.sha256(b"MAGIC").hexdigest() and all(r["hash"] and r["problem"] is None for r in rows.values()) and rows["same.bin"]["size"] == LARGE
    assert {tuple(r) for r in manifest_diff(one, two).collect()} == {("other.bin", "changed")}
    assert not source_unchanged(one, two).first()["unchanged"]
    same = one.filter("path = 'same.bin'")
    assert source_unchanged(same, two.filter("path = 'same.bin'")).first()["unchanged"]


def test_pieces_and_tree(spark, tmp_path):
    data = os.urandom(10_007)
    (tmp_path / "f").write_bytes(data)
    (tmp_path / "none").write_bytes(b"")
    sizes = spark.createDataFrame([(f"file:{tmp_path}/f", len(data)), (f"file:{tmp_path}/none", 0)], "path string, size long")
    cut = ranges(sizes, 100)
    assert sorted((r["offset"], r["length"]) for r in cut.collect() if r["path"].endswith("/f")) == [(i, min(100, 10_007 - i)) for i in range(0, 10_007, 100)]
    assert [(r["offset"], r["length"]) for r in cut.collect() if r["path"].endswith("none")] == [(0, 0)]
    big = ranges(spark.createDataFrame([("x", 100 * FAN * 3 + 1)], "path string, size long"), 100)
    assert big.count() == 3 * FAN + 1 and big.agg({"length": "sum"}).first()[0] == 100 * FAN * 3 + 1
    digest = lambda b: hashlib.sha256(b).hexdigest()
    level = [digest(data[i : i + 100]) for i in range(0, len(data), 100)]
    while len(level) > 1:
        groups = [level[i : i + 7] for i in range(0, len(level), 7)]
        level = [g[0] if len(g) == 1 else digest(("tree:" + "".join(g)).encode()) for g in groups]
    told = {r["path"].rsplit("/", 1)[1]: r["hash"] for r in tree_hash(read_ranges(cut), 100, 7).collect()}
    assert told == {"f": level[0], "none": digest(b"")}


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"0123456789")
    wanted = spark.createDataFrame([(f"file:{tmp_path}/f", 0, 5), (f"file:{tmp_path}/f", 5, 50), (f"file:{tmp_path}/gone", 0, 5)], "path string, offset long, length long")
    rows = {(r["path"].rsplit("/", 1)[1], r["offset"]): r for r in read_ranges(wanted, hashed=False).collect()}
    assert bytes(rows["f", 0]["content"]) == b"01234" and rows["f", 5]["content"] is None and rows["f", 5]["problem"] == "ends 45 bytes early" and rows["gone", 0]["problem"]
    whole = {r["path"].rsplit("/", 1)[1]: r for r in tree_hash(read_ranges(wanted), 5).collect()}
    assert whole["f"]["hash"] is None and whole["f"]["problem"] == "ends 45 bytes early"


def test_a_header_check_reads_headers_only(spark, tmp_path):
    """Through an opener that writes down what is read."""
    for i in range(5):
        (tmp_path / f"f{i}").write_bytes((b"MAGIC" if i % 2 else b"magic") + bytes(100_000))
    log = str(tmp_path) + ".log"

    def counted(path):
        file = open_file(path)

        class Counting:
            def seek(self, at):
                return file.seek(at)

            def read(self, n):
                data = file.read(n)
                with open(log, "a") as f:
                    f.write(f"{len(data)}\n")
                return data

            def close(self):
                file.close()

        return Counting()

    found = {r["path"].rsplit("/", 1)[1]: r["ok"] for r in header_check(spark, str(tmp_path), b"MAGIC", counted).collect()}
    assert found == {f"f{i}": bool(i % 2) for i in range(5)}
    assert sum(map(int, open(log))) == 5 * len(b"MAGIC")
