"""Files that expressions put together: right to the byte, and without a step for every byte of them."""

import zlib

import duckdb
import pytest
from support import SF, same

from pixelframe.plans import built, synth
from pixelframe.plans.queries import ORACLE_SQL

needs_data = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(text, samples):
    b = text.encode()
    rounds = -(-len(b) // samples)
    return [sum(b[(j + i * samples) % len(b)] for i in range(rounds)) % 256 for j in range(samples)]


def test_folded_texts_take_every_byte_and_keep_other_columns(spark):
    texts = ["x", "a" * 64, "ab" * 32 + "c", "żółć " * 40, "\0\x7f", "é" * 31 + "z" * 70000]
    rows = [(i, t, f"k{i}") for i, t in enumerate(texts)] + [(None, "no id", None)]
    out = synth.folded(spark.createDataFrame(rows, "image_id bigint, text string, other string"), 64)
    assert out.columns == ["image_id", "other", "samples"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, k, brute(t, 64)) for i, t, k in rows), key=repr)
    assert "aggregate(" not in planned(out)


@needs_data
def test_png16_has_the_bytes_of_the_pixels_and_no_step_for_every_byte(spark):
    files = built._png16(spark, str(SF))
    assert "aggregate(" not in planned(files)
    want = {r.doc_id: r.text for r in built._docs(spark, str(SF)).select("doc_id", "text").collect() if r.text}
    got = {r.image_id: bytes(r.content) for r in files.collect()}
    assert set(got) == set(want)
    for key, text in want.items():
        s = brute(text, synth.SAMPLES)
        lines = [b"\0" + b"".join(bytes((v, v)) for p in range(16 * y, 16 * y + 16) for v in (*s[3 * p : 3 * p + 3], 255 - (s[7 * p % 576] & 192))) for y in range(12)]
        raw = b"".join(lines)
        body = b"\x78\x01\x01" + len(raw).to_bytes(2, "little") + (65535 - len(raw)).to_bytes(2, "little") + raw + zlib.adler32(raw).to_bytes(4, "big")
        chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
        head = (16).to_bytes(4, "big") + (12).to_bytes(4, "big") + bytes((16, 6, 0, 0, 0))
        assert got[key] == b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@needs_data
def test_measure_built_makes_the_pixels_once(spark):
    plan = planned(built.q_measure_built(spark, str(SF)))
    assert plan.count("Relation [") == plan.count("collect_list(") == plan.count("crc32(") == 1


@needs_data
def test_png_chunks_packs_and_sums_a_file_once(spark):
    plan = planned(built.q_png_chunks(spark, str(SF)))
    assert plan.count("collect_list(") == plan.count("crc32(") == 1
    assert "aggregate(" not in plan


@needs_data
def test_png_chunks_has_no_row_for_every_pixel(spark):
    plan = planned(built.q_png_chunks(spark, str(SF)))
    assert "explode(" not in plan and "transform(" not in plan


def test_png_chunks_of_every_document_whatever_its_id(spark, tmp_path):
    texts = ["x", "é" * 700, "x", "", None, "y" * 5000, "z", "ab" * 288]
    docs = spark.createDataFrame(list(zip([1, 1, 1, 1, 2, None, None, 3], texts, strict=True)), "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    same(built.q_png_chunks(spark, str(tmp_path)), con, ORACLE_SQL["q_png_chunks"])
