"""URL lists, WARC archives, token files."""

import base64
import gzip
import hashlib
import random
from datetime import date

import numpy as np
import pytest
from helpers import with_clashes

from kairosdf.llm import token_scan as T
from kairosdf.llm import url_filters as U
from kairosdf.llm import warc as W
from kairosdf.llm.store import Work, open_fs, qualify

LIST = [("bad.org", "2020-01-01", True), ("bad.org", "2020-06-01", False), ("bad.org", "2021-01-01", True), ("BAD.org.", "2021-01-01", True), ("x.com/ads", "2020-01-01", True), ("x.com/", "2021-01-01", True), (None, "2020-01-01", True), ("late.net", None, True)]
CAPTURES = [
    (1, "https://www.bad.org/a", "2019-12-31"), (2, "https://www.bad.org/a", "2020-01-01"), (3, "http://bad.org", "2020-05-31"), (4, "http://bad.org", "2020-06-01"), (5, "http://u:p@BAD.org:80/?q", "2022-01-01"),
    (6, "http://notbad.org/", "2022-01-01"), (7, "http://x.com/ads/1", "2020-02-01"), (8, "http://x.com/adsense", "2020-02-01"), (9, "http://www.x.com/ads?z", "2022-01-01"), (10, None, "2022-01-01"),
    (11, "no url", "2022-01-01"), (12, "http://bad.org/", None), (None, "http://bad.org/", "2022-01-01"), (13, "http://late.net/", "2022-01-01"), (5, "http://bad.org/", "2022-01-01"), (14, "", "2022-01-01"),
]


def day(x):
    return None if x is None else date.fromisoformat(x)


def judged(spark, captures=CAPTURES, entries=LIST):
    c = with_clashes(spark.createDataFrame([(i, u, day(t)) for i, u, t in captures], "cid long, url string, fetched_at date"))
    e = spark.createDataFrame([(p, day(t), s) for p, t, s in entries], "pattern string, at date, listed boolean")
    return U.judge_captures(c, e, id_col="cid").collect()


def test_lists_hold_from_listing_to_removal(spark):
    rows = judged(spark)
    got = {r.cid: (r.blocked, r.n_matches, r.pattern) for r in rows if r.cid not in (5, None)}
    assert {i for i, v in got.items() if v[0]} == {2, 3, 7, 9} and len(rows) == len(CAPTURES)
    assert got[9] == (True, 2, "x.com") and got[7] == (True, 1, "x.com/ads")
    assert not any(r.blocked for r in judged(spark, entries=[])) and judged(spark, captures=[]) == []


def test_every_capture_is_judged(spark):
    """Rows that repeat an id or have none are captures of their own, each at its time."""
    times = ["2019-06-01", "2020-02-01", "2020-02-01", "2020-07-01", None]
    captures = [(i, "http://bad.org/", t) for i in (5, None) for t in times]
    got = sorted((str(r.cid), r.blocked) for r in judged(spark, captures=captures))
    assert got == sorted((str(i), t == "2020-02-01") for i in (5, None) for t in times)


def test_paths_of_any_depth(spark):
    deep = "http://a.b.org" + "/x" * 5000
    entries = [("b.org/x/x", "2020-01-01", True), ("a.b.org/x/x/x/", "2020-01-01", True), ("b.org/x/y", "2020-01-01", True), ("b.org/x/x/x/x/x", "2020-01-01", True)]
    urls = [deep, "http://b.org/x", "http://b.org/x/xy", "http://b.org/x/x", "http://a.b.org/x/x/x", "http://b.org/x/x/"]
    got = {r.cid: r.n_matches for r in judged(spark, captures=[(i, u, "2021-01-01") for i, u in enumerate(urls)], entries=entries)}
    assert got == {0: 3, 1: 0, 2: 0, 3: 1, 4: 2, 5: 1}


def test_intervals(spark):
    e = spark.createDataFrame([("p", day("2020-01-01"), True), ("p", day("2020-02-01"), True), ("p", day("2020-03-01"), False), ("p", day("2020-03-01"), True), ("p", day("2020-04-01"), False), ("q", day("2020-01-01"), False)], "pattern string, at date, listed boolean")
    assert [tuple(map(str, r)) for r in U.validity_intervals(e).collect()] == [("p", "2020-01-01", "2020-04-01")]


def pages(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}\r\nX: y", f"<html>{i % 4}é</html>" if i % 5 else None) for i in range(40)]
    rows += [(None, None, "<html>1é</html>"), (39, "again", f"<html>{39 % 4}é</html>"), (100, None, "z" * 3_000_000), (101, "a", "")]
    return with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")), rows


def test_archives_round_trip(spark):
    df, rows = pages(spark)
    got = W.archive_round_trip(df).collect()
    largest = {}
    for i, _, h in rows:
        if i is not None:
            largest[h or ""] = max(largest.get(h or "", i), i)
    want = sorted(
        (str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if i is not None and largest[h or ""] != i else "response", str(largest[h or ""] if i is not None and largest[h or ""] != i else None))
        for i, _, h in rows
    )
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == want
    assert W.archive_round_trip(df.where("false")).collect() == []


def test_predicates_are_pushed_and_payloads_are_whole(spark):
    df, rows = pages(spark)
    path = qualify(spark, Work(spark, "t").folder("warc"))
    W.archive_pages(df, path, revisit_bytes=10)
    all_ = W.read_archives(spark, path)
    assert all_.count() == len(rows) and all_.where("record_type = 'revisit' and payload_digest is not null and target_uri like 'http://h1%'").count() < all_.where("record_type in ('revisit')").count()
    plan = all_.where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    bodies = {bytes(r.payload).decode() for r in all_.where("record_type = 'response'").select("payload").collect()}
    assert bodies == {h or "" for _, _, h in rows}
    no_payload = W.read_archives(spark, path, payload=False).where("record_type = 'response'").select("payload", "http_length").collect()
    assert all(r.payload is None for r in no_payload) and max(r.http_length for r in no_payload) == 3_000_000


def test_foreign_archives_are_read(spark):
    path = qualify(spark, Work(spark, "t").folder("foreign"))
    system, where = open_fs(path)
    system.create_dir(where)
    body = b"WARC/1.1\r\nnot a header\r\n\r\n" * 9
    records = [W.record_bytes({"WARC-Type": "warcinfo", "Content-Type": "text/plain"}, b"a: b"), W.record_bytes({"WARC-Type": "resource", "WARC-Target-URI": "urn:x", "Content-Type": "text/html"}, body), W.record_bytes({"WARC-Type": "metadata"}, b"")]
    for name, data in (("one.warc", b"".join(records)), ("two.warc.gz", b"".join(map(gzip.compress, records))), ("skip.txt", b"x")):
        with system.open_output_stream(f"{where}/{name}", compression=None) as out:
            out.write(data)
    got = W.read_archives(spark, path)
    assert got.count() == 6 and {bytes(r.payload) for r in got.where("target_uri = 'urn:x'").collect()} == {body}
    with system.open_output_stream(f"{where}/cut.warc") as out:
        out.write(records[1][:-60])
    with pytest.raises(Exception, match="ends within a record"):
        W.read_archives(spark, path).collect()


def test_token_counts(odd_docs, no_docs):
    got = sorted((str(r.doc_id), r.n_tokens) for r in T.token_counts(odd_docs, block_tokens=1000).collect())
    enc = T.encoding(T.TOKENIZER)
    assert got == sorted((str(r.doc_id), len(enc.encode_ordinary(r.text or ""))) for r in odd_docs.collect())
    assert T.token_counts(no_docs).collect() == []


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_separators_across_blocks(spark, block):
    rng = random.Random(block)
    work = Work(spark, "t")
    folder = qualify(spark, work.folder("tokens"))
    system, where = open_fs(folder)
    system.create_dir(where)
    want = []
    for f in range(5):
        lengths = [rng.choice([0, 0, 1, 3, 20]) for _ in range(rng.randint(0, 12))]
        ids, at = [], 0
        for k, n in enumerate(lengths):
            want.append((f"f{f}", k, at, n))
            ids += [5] * n + [9]
            at += n + 1
        if f == 2:  # no separator at the end
            want.append((f"f{f}", len(lengths), at, 4))
            ids += [5] * 4
        with system.open_output_stream(f"{where}/f{f}.bin") as out:
            out.write(np.array(ids, "<u4").tobytes())
    got = T.scan_token_files(spark, folder, work, end=9, width=4, block_tokens=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    with system.open_output_stream(f"{where}/bad.bin") as out:
        out.write(b"abc")
    with pytest.raises(ValueError, match="no whole number"):
        T.scan_token_files(spark, folder, work, end=9, width=4)


def _archive(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}/{name}"


def test_damaged_archives_raise(spark, tmp_path):
    whole = W.record_bytes({"WARC-Type": "response", "Content-Type": "text/plain"}, b"body")
    for name, data, says in (("cut.warc", whole + whole[:20], "within a record"), ("cut.warc.gz", gzip.compress(whole + whole[:-30]), "within a record"), ("size.warc", whole.replace(b"Content-Length: 4", b"Content-Length: x"), "no valid Content-Length")):
        with pytest.raises(Exception, match=says):
            W.read_archives(spark, _archive(tmp_path, name, data)).collect()


def test_padded_members_and_long_heads(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (k, b"y" * 500) for k in range(40)) + b"Content-Length: 5\r\n\r\n"
    records = [W.record_bytes({"WARC-Type": t, "Content-Type": "application/http; msgtype=response"}, head + b"hello") for t in ("response", "request")]
    path = _archive(tmp_path, "a.warc.gz", b"\0\0".join(map(gzip.compress, records)) + b"\0" * 600)
    full, bare = (W.read_archives(spark, path, payload=p).orderBy("offset").collect() for p in (True, False))
    assert [r.http_length for r in full] == [r.http_length for r in bare] == [5, 5] and [r.payload for r in full] == [b"hello"] * 2
    assert [r.offset for r in full] == [0, len(records[0])] and [r.payload for r in bare] == [None, None]
