"""Salvage inside gzip members of many records."""

from __future__ import annotations

import gzip
import hashlib
import random

from tarnspark.llm import warc
from tarnspark.llm.warc import read_archives, record, salvage


def _plain(i: int) -> bytes:
    payload = random.Random(i).randbytes(3000)
    return gzip.decompress(record(i, f"u{i}", payload, hashlib.sha256(payload).hexdigest(), None))


def _ids(found) -> list[str]:
    return [x["record_id"] for x in found if x["kind"] == "record"]


def test_a_damaged_middle_record(spark, tmp_path):
    a, b, c = map(_plain, range(3))
    b = b[:-100] + bytes(x ^ 255 for x in b[-100:-50]) + b[-50:]
    data = gzip.compress(a + b + c) + gzip.compress(_plain(3))
    found = list(salvage(data))
    assert [x["kind"] for x in found] == ["record", "gap", "record", "record"]
    assert _ids(found) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
    assert f"bytes {len(a)} to {len(a + b)} " in found[1]["reason"]
    (tmp_path / "x.warc.gz").write_bytes(data)
    assert sorted(r["kind"] for r in read_archives(spark, str(tmp_path)).collect()) == ["gap", "record", "record", "record"]


def test_a_member_cut_short():
    whole = gzip.compress(b"".join(map(_plain, range(3))))
    cut = whole[: len(whole) - 1500]
    found = list(salvage(cut + gzip.compress(_plain(3))))
    assert [x["kind"] for x in found] == ["record", "record", "gap", "record"]
    assert _ids(found) == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>"]
    assert _ids(salvage(cut)) == ["<urn:page:0>", "<urn:page:1>"]


def test_a_member_with_a_wrong_checksum_keeps_its_records():
    whole = gzip.compress(b"".join(map(_plain, range(3))))
    found = list(salvage(whole[:-8] + b"\0\0\0\0" + whole[-4:]))
    assert len(_ids(found)) == 3 and [x["kind"] for x in found].count("gap") == 1


def test_random_damage():
    """Archives of members of one or several records, damaged at random: exactly the records of undamaged bytes come back, and
    records and gaps cover the archive."""
    rng = random.Random(8)
    for _ in range(60):
        members, safe, number = [], set(), 0
        for _ in range(rng.randrange(2, 8)):
            inner = []
            for _ in range(rng.choice([1, 1, 3])):
                payload = bytes(rng.choices(b"abc \n", k=rng.randrange(1, 400)))
                inner.append((number, gzip.decompress(record(number, "u", payload, hashlib.sha256(payload).hexdigest(), None))))
                number += 1
            how = rng.randrange(4)
            if how == 0 and len(inner) > 1:  # the content of one record is damaged before compression
                n, raw = inner[1]
                at = raw.rindex(b"\r\n\r\n", 0, len(raw) - 4) + 4
                inner[1] = (n, raw[:at] + b"\x00" + raw[at + 1 :] if len(raw) - 4 > at else raw)
                safe |= {i for i, x in inner if i != n or x == raw}
                members.append(gzip.compress(b"".join(x for _, x in inner)))
            elif how == 1:  # the compressed member is damaged in its checksum: what has a digest is still taken
                data = gzip.compress(b"".join(x for _, x in inner))
                members.append(data[:-8] + bytes(4) + data[-4:])
                safe |= {i for i, _ in inner}
            elif how == 2:  # bytes that are no member
                members.append(bytes(rng.choices(range(1, 30), k=rng.randrange(1, 50))))
            else:
                members.append(gzip.compress(b"".join(x for _, x in inner)))
                safe |= {i for i, _ in inner}
        data = b"".join(members)
        found = list(salvage(data))
        got = [int(x["record_id"].split(":")[-1].rstrip(">")) for x in found if x["kind"] == "record"]
        assert len(got) == len(set(got)) and set(got) == safe
        reached = 0
        for start, end in sorted((x["start"], x["end"]) for x in found):
            assert start <= reached  # no byte between is left out
            reached = max(reached, end)
        assert reached == len(data)


def test_limits(monkeypatch):
    """A member whose content is over a record's limit gives all its records, and the next member is read."""
    monkeypatch.setattr(warc, "MAX_CONTENT", 200_000)
    big = [gzip.decompress(record(i, "u", b"x" * 90_000, hashlib.sha256(b"x" * 90_000).hexdigest(), None)) for i in range(5)]
    data = gzip.compress(b"".join(big)) + record(9, "u", b"end", hashlib.sha256(b"end").hexdigest(), None)
    found = list(salvage(data))
    got = [x["record_id"] for x in found if x["kind"] == "record"]
    assert got == [f"<urn:page:{i}>" for i in (0, 1, 2, 3, 4, 9)] and len(found) == 6
