import gzip
import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from guidepost.llm import warc as W
from guidepost.llm.zip_reader import Archive, BadArchive, Writer

SCHEMA = "page_id long, url string, html string"


def written(path, members):
    w = Writer(str(path))
    for name, parts in members:
        w.begin(name)
        for p in parts:
            w.write(p)
        w.end()
    assert w.close() == path.stat().st_size
    return str(path)


def test_written_archives_are_zip_files_and_read_back(tmp_path):
    members = [("a.bin", [b"x" * 70_000, b"", b"yz"]), ("ünï/leer.txt", []), ("b", [bytes(range(256))])]
    path = written(tmp_path / "a.zip", members)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        assert {i.filename: z.read(i) for i in z.infolist()} == {n: b"".join(p) for n, p in members}
    with Archive(path) as a:
        got = {m.name: a.read(a.data_at(m), m.size) for m in a.members()}
        assert all(m.stored and m.packed == m.size for m in a.members())
    assert got == {n: b"".join(p) for n, p in members}


def test_archives_of_others(tmp_path, monkeypatch):
    """Plain ZIP without ZIP64, comments that hold signatures, packed and locked members,
    ZIP64 numbers for one field only, and directories longer than one read."""
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored", b"s" * 500)
        z.writestr(zipfile.ZipInfo("packed"), b"p" * 500, zipfile.ZIP_DEFLATED)
        for i in range(300):
            z.writestr(f"m{i}", str(i))
        z.comment = b"PK\x05\x06 in a comment " + b"c" * 900
    for step in (1 << 20, 64):
        monkeypatch.setattr("guidepost.llm.zip_reader.DIRECTORY_STEP", step)
        with Archive(f"file://{path}") as a:
            got = {m.name: m for m in a.members()}
            assert len(got) == 302 and got["stored"].stored and not got["packed"].stored
            assert a.read(a.data_at(got["m299"]), got["m299"].size) == b"299"
    wide = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 400)
    with zipfile.ZipFile(wide, "w") as z:
        z.writestr("first", b"f" * 390)
        z.writestr("second", b"g" * 390)  # its position is beyond the lowered limit, its size is not
        z.writestr("third", b"h" * 900)
    (tmp_path / "c.zip").write_bytes(wide.getvalue())
    with Archive(str(tmp_path / "c.zip")) as a:
        assert [a.read(a.data_at(m), m.size)[:1] * m.size for m in a.members()] == [b"f" * 390, b"g" * 390, b"h" * 900]


def test_damaged_archives_are_told(tmp_path):
    good = written(tmp_path / "d.zip", [("a", [b"abc"])])
    data = open(good, "rb").read()
    for name, bad in (("none", b""), ("text", b"no archive at all"), ("cut", data[:-30]), ("shifted", data[10:])):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(BadArchive), Archive(str(tmp_path / name)) as a:
            for m in a.members():
                a.data_at(m)


def pages():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh <>") for _ in range(3_000_000))
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>{rng.random()}</p>" * rng.randint(0, 30)) for i in range(300)]
    rows += [(1000 + i, "http://copy.example/", "the same payload again " * 10) for i in range(900)]
    rows += [(3000, "u\r\nX: y\xe9 z", "small"), (3001, None, "small"), (3002, "u", None), (3003, "u", ""), (3004, "u", long), (3005, "u", long)]
    rows += [(3006, "u", "é" * 49), (3007, "u", "é" * 49), (3008, "u", "é" * 50), (3009, "u", "é" * 50), (3010, "u", "HTTP/1.1 200\r\n\r\nWARC/1.1\r\n" * 9)]
    rows += [(None, "u", "without an id " * 20), (None, "u", "without an id " * 20), (None, "u", long), (3011, "u", "twice " * 40), (3011, "u", "twice " * 40), (3012, "u", "twice " * 40)]
    return rows


def expected(rows):
    by: dict = {}
    for i, _, h in rows:
        if i is not None:
            by[h or ""] = min(by.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = by.get(h or "")
        again = len(b) >= 100 and first is not None and first != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    df = spark.createDataFrame(pages(), SCHEMA).repartition(5).select("*", *[F.lit("x").alias(c) for c in ("digest", "first", "payload", "path", "key", "n")])
    got = sorted((tuple(r) for r in W.round_trip(df).collect()), key=repr)
    assert got == expected(pages())
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_addresses_and_small_archives(spark, tmp_path):
    """Whole payloads come back; archives of others without an index give the same records."""
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    archives = W.write(df, f"file://{tmp_path}/out", archive_bytes=20_000)
    assert archives.count() > 5 and archives.agg(F.sum("records")).first()[0] == len(pages())
    got = W.read(archives).where("record_type = 'response'").collect()
    assert all(r.intact for r in got)
    have = {(i, (h or "").encode()) for i, _, h in pages()}
    assert {(int(r.name) if r.name else None, bytes(r.payload)) for r in got} <= have
    assert {r.url for r in got if r.name == "3000"} == {"u%0D%0AX:%20y%C3%A9%20z"} and {r.url for r in got if r.name == "3001"} == {"urn:page:3001"}
    bare = []
    for k, r in enumerate(archives.collect()):
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z, zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as out:
            out.writestr(W.DATA, z.read(W.DATA))
            assert sum(1 for x in gzip.decompress(z.read(W.DATA)).split(b"WARC/1.1\r\nWARC-Type") if x) >= r.records
        bare.append((str(tmp_path / f"{k}.zip"),))
    cols = ["record_type", "name", "url", "payload_bytes", "payload_digest", "refers_to"]
    walked = W.read(spark.createDataFrame(bare, "path string"), with_payload=False).select(*cols)
    assert walked.exceptAll(W.read(archives).select(*cols)).isEmpty() and walked.count() == len(pages())


def test_hot_and_rare_payloads_take_different_ways(spark):
    """One payload of a third of the rows and pairs of copies, beside 2,400 single pages."""
    rows = [(i, "u", f"{'x' * 100}{i}") for i in range(2400)] + [(5000 - i, "u", "hot " * 30) for i in range(1200)] + [(9000 + i, "u", "pair " * 30) for i in range(2)]
    got = sorted((tuple(r) for r in W.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == expected(rows)
