"""Archives with damage are an error, the same one for every split size; an archive inside a record is none."""

import random

import pytest

from engram.llm.warc import members, read_warc, record

SPLITS = [1000, 60_000, 400_000, 1 << 30]


@pytest.fixture(scope="module")
def records():
    rng = random.Random(1)
    return [record(i, f"http://x/{i}", bytes(rng.choices(b"abcdefgh <>", k=rng.choice([10, 3000, 40_000]))), None) for i in range(200)]


def read(tmp_path, data, split):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    return [m for s in range(0, len(data), split) for m in members(str(path), s, min(len(data), s + split))]


@pytest.mark.parametrize("split", SPLITS)
def test_damage_is_an_error_that_names_its_place(tmp_path, records, split):
    good = b"".join(records)
    assert len(read(tmp_path, good, split)) == 200
    at = sum(map(len, records[:150]))
    flipped = bytearray(good)
    flipped[at + len(records[150]) // 2] ^= 4
    gone = good[:at] + good[at + 7 :]
    last = len(good) - len(records[-1])
    for data, place in ((bytes(flipped), at), (gone, at), (good[:-5], last), (good + b"junk", len(good)), (b"x" + good, 0), (good[: at + 3], at), (good[:at] + b"\0" * 100 + good[at:], at)):
        with pytest.raises(ValueError, match=f"no record at {place}$"):
            read(tmp_path, data, split)


@pytest.mark.parametrize("split", SPLITS)
def test_an_archive_inside_a_record_is_payload(tmp_path, records, split):
    inner = b"".join(record(1000 + i, None, b"q" * 500, None) for i in range(60))
    got = read(tmp_path, b"".join(records[:50]) + record(500, None, inner, None, level=0) + b"".join(records[50:]), split)
    assert len(got) == 201 and sum(b"page:1" in m[:80] and b"page:10" not in m[:80] for m in got) > 0


def test_a_damaged_archive_fails_the_job(spark, tmp_path, records):
    data = bytearray(b"".join(records))
    data[len(data) // 2] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(bytes(data))
    table = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "path string, n_bytes long")
    for split in (50_000, 1 << 30):
        with pytest.raises(Exception, match="no record at"):
            read_warc(table, split).count()
