"""WARC: round trips, revisits, and damaged input."""

import gzip
import hashlib
import zlib

import pytest

from topicloom.llm import warc

SCHEMA = "page_id long, url string, html string, payload string"


def test_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big, "x"), (2, None, big, "x"), (3, "http://a/\r\nX: y", "short", "x"), (4, "u", "short", "x"), (5, "", None, "x"), (None, "n", big, "x"), (2, "again", big, "x")]
    got = warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert sorted([tuple(r) for r in got if r.payload_bytes == 1200], key=str) == sorted(
        [(1, 1200, sha, "revisit", 2), (2, 1200, sha, "response", None), (2, 1200, sha, "response", None), (None, 1200, sha, "revisit", 2)], key=str
    )
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in got if r.payload_bytes < 1200) == [(3, 5, "response"), (4, 5, "response"), (5, 0, "response")]


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def records(n):
    return [warc.record(i, "u", b"x" * i * 1000, i * 1000, hashlib.sha1(b"x" * i * 1000).digest(), None) for i in range(n)]


@pytest.mark.parametrize("members", [1, 3])
def test_normalised_members_stand_alone(members):
    data = records(30)
    step = -(-len(data) // members)
    out, index = warc.normalise(b"".join(gzip.compress(b"".join(data[k : k + step])) for k in range(0, 30, step)))
    assert [zlib.decompress(out[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == data
    assert gzip.decompress(out) == b"".join(data)


def test_truncated_input_is_an_error():
    whole = gzip.compress(b"".join(records(5)))
    with pytest.raises(ValueError):
        warc.normalise(whole[:-20])
    with pytest.raises(ValueError):
        warc.normalise(gzip.compress(b"".join(records(5))[:-10]))
