import glob
import hashlib

import numpy as np

from foldwise.llm import warc
from tests.llm.helpers import SF, awkward, empty, table

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    store = {}
    for i, _, t in rows:
        b = (t or "").encode()
        if len(b) >= 1000 and i is not None:
            store[b] = max(store.get(b, i), i)
    out = []
    for i, _, t in rows:
        b = (t or "").encode()
        keeper = store.get(b)
        keeper = None if keeper == i else keeper
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if keeper is None else "revisit", keeper))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in df.filter("reason is null").collect()), key=str)


def pages():
    big, other = "<p>é" + "x" * 2000, "y" * 1000
    return [(1, "http://a/", big), (5, "http://b/ü\r\nX: y", big), (3, None, big), (2, "u", other), (9, "u", other), (9, "u", other),
            (4, "u", "z" * 999), (6, "u", "z" * 999), (7, "u", None), (8, None, ""), (None, "u", big), (None, "u", None),
            (10, "u", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30)]


def test_round_trip(spark):
    rows = pages()
    assert got(warc.archive_pages(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    table_rows = [tuple(r) for r in table(spark, "pages", SF).select("page_id", "url", "html").collect()]
    assert got(warc.archive_pages(table(spark, "pages", SF))) == brute(table_rows)


def test_payloads_come_back(spark, tmp_path):
    for compress in (True, False):
        path = str(tmp_path / f"w{compress}")
        warc.write_warc(warc.plan_records(spark.createDataFrame(pages(), SCHEMA).repartition(3)), path, 4000, compress=compress)
        back = warc.read_warc(spark, path).collect()
        assert all(r.reason is None for r in back)
        want = sorted((t or "").encode() for i, _, t in pages())
        text = {r.page_id: bytes(r.payload) for r in back if r.record_type == "response"}
        assert sorted(bytes(r.payload) if r.record_type == "response" else text[r.refers_to] for r in back) == want


def test_awkward_and_empty(spark):
    df = awkward(spark).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("lang", "url")
    assert warc.archive_pages(df).filter("reason is null").count() == 15
    none = empty(spark).withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("lang", "url")
    assert warc.archive_pages(none).count() == 0


def members(n=12, compress=True):
    out = []
    for i in range(n):
        body = (f"page {i} " * 200).encode()
        record = warc.encode_record(i, "http://x/", body, hashlib.sha1(body).hexdigest(), None)
        out.append(warc.gzip_member(record) if compress else record)
    return out


def ids(buf):
    found = list(warc.salvage(buf))
    gaps = [(o, n) for o, n, reason, _ in found if reason]
    return [r["page_id"] for *_, r in found if r], gaps


def test_salvage_of_damaged_members():
    good = members()
    assert ids(b"".join(good)) == (list(range(12)), [])
    at = [sum(map(len, good[:i])) for i in range(13)]
    broken = good.copy()
    broken[4] = good[4][:20] + b"\x00" * 5 + good[4][25:]
    assert ids(b"".join(broken)) == ([i for i in range(12) if i != 4], [(at[4], len(good[4]))])
    cut = good[:5] + [good[5][:30]] + good[6:]
    assert ids(b"".join(cut)) == ([i for i in range(12) if i != 5], [(at[5], 30)])
    assert ids(b"".join(good)[:at[11] + 9]) == (list(range(11)), [(at[11], 9)])
    junk = b"".join(good[:3]) + b"junk \x1f\x8b\x08 more" + b"".join(good[3:])
    assert ids(junk) == (list(range(12)), [(at[3], len(b"junk \x1f\x8b\x08 more"))])


def test_salvage_of_damaged_plain_records():
    good = members(compress=False)
    at = [sum(map(len, good[:i])) for i in range(13)]
    bad = good.copy()
    bad[2] = good[2].replace(b"page 2 page", b"page 3 page", 1)               # payload digest
    bad[7] = good[7].replace(b"Content-Length: ", b"Content-Length: 9", 1)     # wrong length
    found, gaps = ids(b"".join(bad))
    assert found == [i for i in range(12) if i not in (2, 7)]
    assert [o for o, _ in gaps] == [at[2], at[7]]
    mixed = b"".join(members(3)) + b"\x00garbage" + b"".join(good[3:])
    assert ids(mixed)[0] == list(range(12))


def test_records_inside_a_member_are_recovered():
    plain = members(5, compress=False)
    bad = plain.copy()
    bad[2] = plain[2].replace(b"page 2 page", b"page 3 page", 1)
    whole = warc.gzip_member(b"".join(bad))
    found = list(warc.salvage(members(1)[0] + whole + members(1)[0]))
    assert [r["page_id"] for *_, r in found if r] == [0, 0, 1, 3, 4, 0]
    start, first = len(members(1)[0]), len(plain[0]) + len(plain[1])
    assert [x[:3] for x in found if x[2]] == [
        (start, len(whole), f"payload digest, bytes {first} to {first + len(bad[2])} of the member")]


def test_records_before_the_damage_are_recovered():
    draw = np.random.default_rng(1)
    bodies = [draw.integers(32, 127, 3000).astype(np.uint8).tobytes() for _ in range(9)]
    plain = [warc.encode_record(i, None, b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(bodies)]
    whole = warc.gzip_member(b"".join(plain))
    tail = members(2)
    for broken in (whole[:len(whole) // 2], whole[:len(whole) // 2] + b"\xff" * 40 + whole[len(whole) // 2 + 40:]):
        found, gaps = ids(tail[0] + broken + tail[1])
        assert found[0] == 0 and found[-1] == 1 and found[1:-1] == list(range(len(found) - 2)) and 3 <= len(found) - 2 <= 5
        assert gaps == [(len(tail[0]), len(broken))]


def test_zero_filled_records_leave_a_gap():
    for compress in (True, False):
        good = members(6, compress)
        at = len(good[0]) + len(good[1])
        lost = good[:2] + [bytes(len(good[2]))] + good[3:]
        assert ids(b"".join(lost)) == ([0, 1, 3, 4, 5], [(at, len(good[2]))])
        assert ids(b"".join(good[:2]) + b"\x00\x00\r\n" + b"".join(good[2:])) == (list(range(6)), [])
        assert ids(b"".join(good) + bytes(900)) == (list(range(6)), [(sum(map(len, good)), 900)])


def test_search_reads_a_file_once():
    buf = b"WARC/1.0 no record " * 20000 + members(1)[0]
    assert ids(buf) == ([0], [(0, 19 * 20000)])
    marks = warc.Marks(buf, True)
    assert [marks.after(p) for p in (0, 1, 19, len(buf) - 1)] == [19, 19, 38, len(buf)]


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_warc(warc.plan_records(table(spark, "pages", SF)), path)
    file = glob.glob(path + "/part*")[0]
    raw = bytearray(open(file, "rb").read())
    raw[len(raw) // 2] ^= 0xFF
    open(str(tmp_path / "damaged.warc.gz"), "wb").write(bytes(raw))
    n = warc.read_warc(spark, path).count() + 1
    back = warc.read_warc(spark, str(tmp_path / "damaged.warc.gz")).collect()
    gaps = [r for r in back if r.reason]
    assert len(gaps) == 1 and gaps[0].length > 0 and gaps[0].record_type is None
    assert gaps[0].offset <= len(raw) // 2 < gaps[0].offset + gaps[0].length
    whole = warc.read_warc(spark, file).count()
    assert sum(r.reason is None for r in back) == whole - 1 < n
