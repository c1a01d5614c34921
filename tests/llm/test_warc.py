import hashlib
import io

import pytest
import zstandard

from tidemark.llm import warc


def expected(pages):
    """Brute force over all rows."""
    out = []
    for page_id, _, html in pages:
        payload = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == payload and p is not None]
        least = min(same) if len(payload) >= 100 and same else None
        first = least if least is not None and page_id is not None and page_id != least else None
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, small_sf):
    from tidemark.llm.queries import QUERIES

    pages = [tuple(r) for r in spark.read.parquet(f"{small_sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op5_warc"](spark, small_sf).collect()), key=str) == expected(pages)


def test_edges(spark, tmp_path):
    long = "x\r\n\r\né" * 60
    rows = [
        (5, "http://a", long, 1), (2, "http://b", long, 1), (2, "http://b", long, 1), (None, "http://c", long, 2), (9, None, None, 2),
        (8, "", "", 2), (7, "bad\r\nurl", "short", 2), (6, "http://d", "short", 2), (4, "http://big", "<p>" + "word " * 400_000, 3),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = sorted(map(tuple, warc.archived_pages(df).collect()), key=str)
    assert got == expected([r[:3] for r in rows])
    assert warc.archived_pages(df.limit(0)).count() == 0

    folder = f"file://{tmp_path}/archives"
    back = warc.read_archives(warc.write_archives(df, folder), folder).collect()
    assert {(r.page_id, (r.payload or b"").decode()) for r in back if r.record_type == "response"} == {(r[0], r[2] or "") for r in rows if r[0] != 5}


def test_dictionary_frame_and_separate_records(spark, small_sf, tmp_path):
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_archives(spark.read.parquet(f"{small_sf}/pages.parquet").coalesce(1), folder).collect()
    assert sum(m.n_records for m in manifest) == 50
    for m in manifest:
        data = open(m.path, "rb").read()
        assert len(data) == m.archive_bytes
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        kept = zstandard.ZstdCompressionDict(data[8 : 8 + size]) if size else None
        first = zstandard.ZstdDecompressor(dict_data=kept).decompressobj()  # a record opens without the others
        assert first.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\n")
        assert len(list(warc.read_archive(io.BytesIO(data)))) == m.n_records


def test_damage_is_found():
    raw = warc.record(1, "http://a", b"p" * 200, hashlib.sha256(b"p" * 200).hexdigest(), None)
    assert warc.parse(raw)["length"] == 200
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"ppp", b"qpp", 1))
