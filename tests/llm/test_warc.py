import gzip
import hashlib
import random

import pytest
from support import SF, same

from pixelframe.llm import warc as w
from pixelframe.llm.queries import ORACLE_SQL, op9_warc

LONG = "<p>" + "long enough to be worth a revisit " * 40 + "</p>"
ROWS = [
    (1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, LONG), (4, "http://c/", "short"), (5, "http://c/", "short"), (6, "http://d/", None), (7, "http://e/", ""), (2, "http://b/", LONG),
    (None, "http://f/", LONG), (8, "http://g/ x\r\ny", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60), (9, "http://é/", "é" * 600), (10, "http://h/", "x" * 2_000_000), (3, None, LONG),
]
DDL = "page_id bigint, url string, html string, digest string, refers_to string"


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)


def records(n=12, plain=False, seed=0):
    r = random.Random(seed)
    made = [w.record_bytes(k, f"http://x/{k}", bytes(r.choice(b"abcdef \n") for _ in range(r.randrange(50, 4000))), None) for k in range(n)]
    return made if plain else [w.member(m) for m in made]


def ids(found):
    return [int(x.headers["x-page-id"]) for x in found if isinstance(x, w.Record)]


def gaps(found):
    return [(x.offset, x.offset + x.length) for x in found if isinstance(x, w.Gap)]


@pytest.mark.parametrize("plain", [False, True])
def test_whole_archives(plain):
    made = records(plain=plain)
    found = list(w.salvage(b"".join(made)))
    assert ids(found) == list(range(12)) and not gaps(found)
    assert [f.length for f in found] == [len(m) for m in made]


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("hurt", ["flip", "cut", "junk", "zero", "tail", "head"])
def test_damage_costs_only_what_it_touches(plain, hurt):
    made = records(plain=plain, seed=3)
    start = sum(map(len, made[:5]))
    data = bytearray(b"".join(made))
    lost = [5]
    if hurt == "flip":
        data[start + len(made[5]) // 2] ^= 0x10
    elif hurt == "cut":
        del data[start + len(made[5]) // 2 : start + len(made[5])]
    elif hurt == "junk":
        data[start:start] = b"\x1f\x8b\x08junk WARC/1.1 \x1f\x8b\n"
        lost = []
    elif hurt == "zero":
        data[start + 20 : start + 60] = bytes(40)
    elif hurt == "tail":
        del data[-10:]
        lost = [11]
    else:
        del data[:15]
        lost = [0]
    found = list(w.salvage(bytes(data)))
    assert ids(found) == [k for k in range(12) if k not in lost]
    assert len(gaps(found)) == 1
    # Records and gaps cover the file without overlap.
    at = 0
    for x in found:
        assert x.offset == at
        at += x.length
    assert at == len(data)


def test_random_damage_is_always_accounted_for():
    for seed in range(60):
        r = random.Random(seed)
        made = records(8, plain=seed % 2 == 0, seed=seed)
        data = bytearray(b"".join(made))
        for _ in range(r.randrange(1, 4)):
            a = r.randrange(len(data))
            kind = r.randrange(3)
            if kind == 0:
                data[a] ^= 1 << r.randrange(8)
            elif kind == 1:
                del data[a : a + r.randrange(1, 600)]
            else:
                data[a:a] = bytes(r.randrange(256) for _ in range(r.randrange(1, 50)))
        found = list(w.salvage(bytes(data)))
        assert len(ids(found)) >= 2
        assert sum(x.length for x in found if isinstance(x, w.Gap)) + sum({x.offset: x.length for x in found if isinstance(x, w.Record)}.values()) == len(data)
        # A plain record's headers have no checksum; its payload has, and so has all of a member.
        payloads = [w.payload_of(*w.read_record(m, 0)[:2])[0] for m in records(8, plain=True, seed=seed)]
        for x in found:
            if isinstance(x, w.Record):
                body = w.payload_of(x.headers, x.block)[0]
                assert any(body.endswith(p) for p in payloads) if seed % 2 == 0 else body == payloads[int(x.headers["x-page-id"])]


def test_members_of_many_records_and_empty_files():
    data = gzip.compress(b"".join(records(4, plain=True)))
    assert ids(w.salvage(data)) == [0, 1, 2, 3]
    assert list(w.salvage(b"")) == [] and gaps(w.salvage(b"nothing here")) == [(0, 12)]


@pytest.mark.parametrize("whole", [64 << 20, 100])
@pytest.mark.parametrize("hurt", ["none", "digest", "length", "cut", "trailer", "flip"])
def test_damage_in_a_member_of_many_records(monkeypatch, hurt, whole):
    monkeypatch.setattr(w, "MOST_WHOLE", whole, raising=False)
    made = records(30, plain=True, seed=5)
    if hurt == "digest":
        made[7] = made[7][:-20] + b"?" + made[7][-19:]
    elif hurt == "length":
        made[7] = made[7].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9999", 1).replace(b"Content-Length: 99999999", b"Content-Length: 9999")
    data = bytearray(gzip.compress(b"".join(made)))
    if hurt == "cut":
        del data[len(data) // 2 :]
    elif hurt == "trailer":
        data[-6] ^= 1
    elif hurt == "flip":
        data[len(data) // 2] ^= 0x10
    after = records(2, seed=6)
    found = list(w.salvage(bytes(data) + b"".join(after)))
    assert ids(found)[-2:] == [0, 1]
    got, lost = ids(found)[:-2], [x for x in found if isinstance(x, w.Gap)]
    if hurt in ("none", "digest", "length", "trailer"):
        assert got == [k for k in range(30) if k != 7 or hurt in ("none", "trailer")] and len(lost) == (hurt != "none")
    else:
        assert got[:8] == list(range(8)) and lost
    if hurt in ("digest", "length"):
        assert (lost[0].offset, lost[0].inflated_offset, lost[0].inflated_length) == (0, sum(map(len, made[:7])), len(made[7]))


def by_hand(rows):
    out, kept = [], {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            kept[raw] = max(i, kept.get(raw, i))
    for i, _, h in rows:
        raw = (h or "").encode()
        to = kept.get(raw) if i is not None and kept.get(raw) != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("gzip_", [True, False])
def test_round_trip(spark, tmp_path, gzip_):
    folder = f"file://{tmp_path}/w"
    written = w.write_archives(pages(spark), folder, gzip=gzip_, most_bytes=1000).collect()
    assert sum(r.n_records for r in written) == len(ROWS)
    read = w.read_archives(spark.read.format("binaryFile").load(folder)).where("type is not null").collect()
    number = lambda r, k: int(r.headers[k]) if k in r.headers else None
    got = sorted(((number(r, "x-page-id"), r.payload_bytes, r.payload_digest, r.type, number(r, "x-refers-to-page")) for r in read), key=str)
    assert got == by_hand(ROWS)
    texts = {(i, (h or "").encode()) for i, _, h in ROWS}
    assert all((number(r, "x-page-id"), bytes(r.payload)) in texts for r in read if r.type == "response")


def test_empty_table(spark):
    assert w.round_trip(spark, pages(spark, [])).count() == 0
    assert w.read_archives(spark.createDataFrame([("a", None), ("b", b"")], "path string, content binary")).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_query(spark, duck):
    same(op9_warc(spark, str(SF)), duck, ORACLE_SQL["op9_warc"])


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    """A writer that dies between two files and runs again leaves a whole archive behind; each page still has one record."""
    folder = f"file://{tmp_path}/w"
    rows = pages(spark, [(i, f"http://x/{i}", f"page {i} " * 40) for i in range(20)])
    written = w.write_archives(rows, folder, most_bytes=400)
    names = [r.archive for r in written.collect()]
    assert len(names) > 5 and all(len(n.split("-")) == 4 for n in names)
    lost = sorted((tmp_path / "w").iterdir())[0].read_bytes()
    (tmp_path / "w" / "part-000000-999-00000.warc.gz").write_bytes(lost)
    (tmp_path / "w" / "part-000001-999-00000.warc.gz").write_bytes(lost[: len(lost) // 2])
    got = w.read_archives(w.listed(written, folder)).collect()
    assert sorted(r.headers["x-page-id"] for r in got) == sorted(str(i) for i in range(20))


def test_writer_that_fails_after_a_file_is_run_again(spark, tmp_path, monkeypatch):
    """The first attempt of every task closes a file and breaks off (the test session retries nothing, so by hand)."""
    import pyarrow as pa

    class Task:
        attempt = 7

        def partitionId(self):  # noqa: N802
            return 3

        def taskAttemptId(self):  # noqa: N802
            return Task.attempt

    monkeypatch.setattr(w, "TaskContext", type("T", (), {"get": staticmethod(lambda: Task())}))
    batch = pa.RecordBatch.from_pydict({"page_id": [1, 2, 3], "url": ["a", "b", "c"], "html": [b"x" * 300, b"y" * 300, b"z" * 300], "refers_to": pa.array([None] * 3, pa.int64())})
    run = w._writer(f"file://{tmp_path}/w", False, 600)
    next(run(iter([batch])))
    Task.attempt = 8
    reordered = batch.take(pa.array([2, 1, 0]))
    names = [b.column(0)[0].as_py() for b in run(iter([reordered]))]
    assert len({p.name for p in (tmp_path / "w").iterdir()}) == len(names) + 1
    written = spark.createDataFrame([(n,) for n in names], "archive string")
    got = w.read_archives(w.listed(written, f"file://{tmp_path}/w")).collect()
    assert sorted(r.headers["x-page-id"] for r in got) == ["1", "2", "3"]
