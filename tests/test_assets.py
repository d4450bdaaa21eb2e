"""Photo-server assets: resolution matching, date from names, albums; file hashing."""

import hashlib
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from medialake import schema as S
from medialake.operators import assets as A
from medialake.operators import ingest as I
from medialake.plans import resolution_album as K8
from medialake.plans import name_dates as K7
from medialake.sources import landing


def _assets(spark):
    rows = [
        ("1", "IMAGE", False, "2018-03-10 21-30-06.JPG", (1179, 2556, "2025-10-17T19:34:56.9+00:00")),
        ("2", "IMAGE", False, "IMG_20180310_213006.jpg", (2556, 1179, "2025:01:01")),
        ("3", "IMAGE", True, "x.jpg", (1179, 2556, "2025-01-01T00:00:00+00:00")),
        ("4", "IMAGE", False, "img_20180310_213006.jpg", (1189, 2566, "2025-01-01T00:00:00+00:00")),
        ("5", "IMAGE", False, "DSC_1.jpg", (1190, 2556, "2024-01-01T00:00:00+00:00")),
        ("6", "VIDEO", False, "2021-01-05 12-22-19.MP4", (None, 1080, None)),
        ("7", "IMAGE", False, "2018-02-30 21-30-06.jpg", (None, None, "n/a")),
        ("8", "IMAGE", False, "2018-03-10_21-30-06.png", (1920, 1080, "")),
    ]
    return spark.createDataFrame(rows, S.ASSET_SCHEMA)


def _members(spark):
    return spark.createDataFrame([("a1", "Trip", str(i)) for i in range(1, 9)],
                                 "album_id string, albumName string, asset_id string")


def test_resolution_match(spark):
    got = {r.asset_id for r in K8.album_plan(_assets(spark), "1179x2556", "S").collect()}
    assert got == {"1", "2", "4"}          # 3 is trashed, 5 is 11 px off, 6 is a video
    exact = {r.asset_id for r in K8.album_plan(_assets(spark), " 1179 X 2556 ", "S", exact=True).collect()}
    assert exact == {"1", "2"}
    c = K8.match_counts(_assets(spark), "1179x2556").first()
    assert (c.scanned, c.matched, c.no_size) == (6, 3, 1)
    with pytest.raises(ValueError):
        K8.parse_resolution("1179x2556x3")
    with pytest.raises(ValueError):
        K8.parse_resolution("wide")


def test_date_from_name_plan(spark):
    plan = {r.asset_id: (r.status, r.new_date) for r in
            K7.date_from_name_plan(_members(spark), _assets(spark), "Trip", 2025).collect()}
    assert plan["1"] == ("update", "2018-03-10T21:30:06+00:00")
    assert plan["2"] == ("update", "2018-03-10T21:30:06+00:00")
    # the unanchored digits pattern finds the date before the IMG/VID pattern is tried
    assert plan["4"] == ("update", "2018-03-10T21:30:06+00:00")
    assert plan["5"][0] == "other_year"
    assert plan["6"][0] == "no_exif_date"
    assert plan["7"][0] == "bad_exif_year"
    assert plan["8"][0] == "no_exif_date"      # empty text counts as missing
    assert "3" not in plan                     # trashed
    with pytest.raises(ValueError):
        A.album_assets(_members(spark), _assets(spark), "Nope")


def test_asset_lines_keep_bad_ones_apart(spark, tmp_path):
    lines = ['{"id":"2","type":"IMAGE","isTrashed":null,"exifInfo":{"exifImageWidth":7},"more":[1]}', "",
             '{"id":"10","type":"IMAGE"', '{"id":"3","isTrashed":"yes?"}', "[]", "  ", '{"type":"IMAGE"}', "null",
             '{"id":"1","type":"IMAGE","exifInfo":null}', '{"id":"4","type":"VIDEO"}', '{"id":"5","type":"IMAGE","isTrashed":true}']
    (tmp_path / "part.json").write_text("\n".join(lines))
    read = A.asset_lines(spark, str(tmp_path))
    assert tuple(A.line_counts(read).first()) == (9, 4, 5)
    assert {r.bad for r in read.collect() if r.bad} == {lines[i] for i in (2, 3, 4, 6, 7)}
    assets = A.read_assets(spark, str(tmp_path))
    assert assets.schema.names == S.ASSET_SCHEMA.names
    assert {(r.id, r.exifInfo and r.exifInfo.exifImageWidth) for r in A.live_assets(assets, "IMAGE").collect()} == {
        ("2", 7), ("1", None)}
    assert [r.id for r in A.live_assets(assets, limit=2).collect()] == ["1", "2"]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "part.json").write_text("")
    assert tuple(A.line_counts(A.asset_lines(spark, str(empty))).first()) == (0, 0, 0)


def test_landed_files_are_hashed_back(spark, tmp_path):
    data = {"aa/f1": b"", "aa/f2": os.urandom(3000), "b/c/f3": "ü".encode()}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "name string, content binary")
    folder = str(tmp_path / "files")
    for _ in range(2):  # a second write of the same files changes nothing
        landing.write_files(rows, folder)
        names = spark.createDataFrame([(f"{folder}/{k}",) for k in [*data, "aa/absent"]] + [(None,)], "path string")
        got = {r.path and r.path.split(folder + "/")[1]: r.file_hash
               for r in I.hash_files(names, "path", chunk_bytes=1000).collect()}
        assert got == {**{k: hashlib.md5(v).hexdigest() for k, v in data.items()}, "aa/absent": None, None: None}


def test_binary_hashes_match_hashlib(spark):
    folder = tempfile.mkdtemp(prefix="ml-bin-", dir="/tmp")
    data = {"a.jpg": b"abc" * 100, "sub/b c%20.mp4": os.urandom(5000), "sub/_c.jpg": b""}
    for rel, content in data.items():
        os.makedirs(os.path.dirname(os.path.join(folder, rel)), exist_ok=True)
        with open(os.path.join(folder, rel), "wb") as fh:
            fh.write(content)
    got = {r.file_path.split(folder + "/")[1]: r.file_hash
           for r in I.read_binary_hashes(spark, folder, chunk_bytes=1024).collect()}
    # binaryFile hides files starting with '_' (documented); the big file takes five chunks
    assert got == {rel: hashlib.md5(data[rel]).hexdigest() for rel in ("a.jpg", "sub/b c%20.mp4")}
    df = spark.createDataFrame([("x", "héllo")], "file_path string, content string")
    assert I.content_hash(df).first().file_hash == hashlib.md5("héllo".encode()).hexdigest()


def test_with_file_hashes_prefers_bytes(spark):
    folder = tempfile.mkdtemp(prefix="ml-hash-", dir="/tmp")
    here, away = os.path.join(folder, "s.jpg"), "/nowhere/b.mp4"
    with open(here, "wb") as fh:
        fh.write(b"x" * 10)
    scan = spark.createDataFrame([(here, "stale"), (away, "from-scan")],
                                 "file_path string, content_md5 string")
    got = {r.file_path: r.content_md5 for r in I.with_file_hashes(scan, spark, folder).collect()}
    assert got == {here: hashlib.md5(b"x" * 10).hexdigest(), away: "from-scan"}


def test_first_album_of_a_name(spark):
    """Of two albums of one name only the first in listing order counts; an unknown name is an error."""
    albums = spark.createDataFrame([("z", "Trip", 1), ("a", "Trip", 2), ("b", "trip", 0)], "album_id string, albumName string, ordinal long")
    members = spark.createDataFrame([("z", "Trip", "1"), ("z", "Trip", "2"), ("a", "Trip", "3"), ("b", "trip", "1")],
                                    "album_id string, albumName string, asset_id string")
    assets = spark.createDataFrame([(str(i), "IMAGE", False) for i in range(1, 4)], "id string, type string, isTrashed boolean")
    assert A.first_album(albums, "Trip") == "z"
    assert {r["id"] for r in A.album_assets(members, assets, "Trip", albums=albums).collect()} == {"1", "2"}
    assert {r["id"] for r in A.album_assets(members, assets, "Trip").collect()} == {"1", "2", "3"}
    with pytest.raises(ValueError):
        A.album_assets(members, assets, "none", albums=albums)
