"""Files' digests: the bytes of large files in pieces, over Spark's limit for one row."""

import hashlib
import random

import pytest

from layerroutes.sources import digests
from layerroutes.sources import tables as S


@pytest.fixture
def limits(spark):
    own = {"spark.sql.sources.binaryFile.maxLength": "5000", "spark.sql.files.maxPartitionBytes": "1500"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def files():
    r = random.Random(3)
    made = {"a one%20[x]{y}.bin": r.randbytes(20_001), "ends.bin": r.randbytes(9_000) + b"\n", "open.bin": b"\r\n" * 4_000 + b"x"}
    made |= {"mark.txt": digests.BOM + b"a,b\r\n" * 2_000, "mark open.txt": digests.BOM + b"a,b\n" * 2_000 + b"c", "breaks.txt": b"\n" * 7_000, "small.bin": r.randbytes(100), "long.txt": b"a" * 9_000 + b"\n" + b"b" * 9_000}
    return made


@pytest.mark.parametrize("handed", [True, False])
def test_files_over_the_limit(spark, tmp_path, limits, monkeypatch, handed):
    if not handed:
        monkeypatch.setattr(digests, "resumable", lambda: False)
    for name, content in files().items():
        (tmp_path / name).write_bytes(content)
    got = {r.name: (r.bytes, r.sha256) for r in S.inventory(spark, str(tmp_path), piece=2_000).collect()}
    assert got == {name: (len(c), hashlib.sha256(c).hexdigest()) for name, c in files().items()}


def test_a_resumed_digest():
    first = digests.Resumed()
    first.update(b"a" * 1000)
    second = digests.Resumed(first.state())
    second.update(b"b" * 77)
    assert digests.resumable() and second.hexdigest() == hashlib.sha256(b"a" * 1000 + b"b" * 77).hexdigest()
