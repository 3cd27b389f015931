"""WARC round trips with payloads that hold records themselves."""

from collections import Counter, defaultdict

import pytest

from aerolith.llm import warc


@pytest.mark.parametrize("compress, block", [(True, 4 << 20), (True, 1500), (False, 3000)])
def test_round_trip(spark, data, compress, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").limit(60).collect()]
    inner = warc.record(7, "http://x", b"inner payload", None, "1970-01-01T00:00:00Z", False).decode()
    member = warc.record(7, "http://x", b"inner", None, "1970-01-01T00:00:00Z", True).decode("latin1")
    rows += [(9000, "u", inner), (9001, "u", inner * 3), (9002, None, None), (9003, "", ""), (9004, "a b\r\n", inner), (9005, "u", rows[3][2]), (-5, "u", rows[3][2]), (None, "u", rows[4][2]), (None, "u", None),
             (9006, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (9006, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n"), (9007, "u", "é" * 200000 + inner), (9008, "u", member * 50)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    expected = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((x for x in groups[body] if x is not None), default=None) if len(groups[body]) > 1 else None
        again = first is not None and i != first
        expected[i, len(body), warc.digest(body), "revisit" if again else "response", first if again else None] += 1
    manifest = warc.write_warc(pages, compress=compress)
    assert Counter(tuple(r) for r in warc.read_warc(manifest, block).collect()) == expected


def test_broken_chain_and_empty_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").limit(5)
    manifest = warc.write_warc(pages)
    with pytest.raises(ValueError, match="breaks off"):
        warc.read_warc(manifest.selectExpr("path", "n_bytes - 7 as n_bytes", "n_records")).count()
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


class Counted:
    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.read_bytes += len(out)
        return out


@pytest.mark.parametrize("lure", [b"WARC/1.1\r\nno end", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 30000000\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999999999\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n"])
def test_lures_are_not_read_on(lure):
    """Magic inside payloads, without an end or with a huge length, costs a head at most."""
    data = warc.record(1, "u", lure + b"x" * 40_000_000, None, "d", False) + warc.record(2, "v", b"y", None, "d", False)
    at = data.find(lure)
    f = Counted(data)
    assert list(warc.candidates(f, len(data), at, at + 1000, False)) == []
    assert f.read_bytes < 3 << 20
    first = next(warc.candidates(Counted(data), len(data), 0, 10, False))
    assert first[2]["payload_bytes"] == len(lure) + 40_000_000 and next(warc.candidates(Counted(data), len(data), first[1], len(data), False))[2]["page_id"] == 2


def test_long_target_and_damaged_member():
    data = warc.record(1, "u" * (1 << 20), b"p", None, "d", True)
    assert [r[1] for r in warc.candidates(Counted(data), len(data), 0, len(data), True, 2 << 20)] == [len(data)]
    assert list(warc.candidates(Counted(data[:-3]), len(data) - 3, 0, len(data) - 3, True)) == []
    assert list(warc.candidates(Counted(data[:50] + b"!" + data[51:]), len(data), 0, len(data), True)) == []


@pytest.mark.parametrize("compress", [True, False])
def test_long_targets_are_written_whole(spark, compress):
    """Heads of more than a megabyte are found again, as the manifest says how long they get."""
    rows = [(1, "http://x/" + "é" * 700_000, "a" * 100), (2, "http://y/" + "u" * 1_200_000, "a" * 100), (3, None, "b")]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), compress=compress)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(manifest, block=1 << 20).collect()}
    assert got == {1: (100, "response", None), 2: (100, "revisit", 1), 3: (1, "response", None)}
    if not compress:
        assert spark.read.format("binaryFile").load([r.path for r in manifest.collect()]).selectExpr("length(content) n").first().n > 700_000 * 2 + 1_200_000
