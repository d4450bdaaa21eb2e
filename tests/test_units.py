"""Operators against small brute-force versions of the same rules."""

import os
import random
import re
import tempfile
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from medialake.functions import dates as D
from medialake.functions import formats as FM
from medialake.functions import paths as P
from medialake.operators.ranking import global_row_number
from medialake.plans import flatten as K2
from medialake.sources import lists as L


# --- brute-force helpers (the rules as plain Python) ---------------------------------

def py_size(n, units=("B", "KB", "MB", "GB", "TB"), last="PB"):
    if n is None:
        return "N/A"
    v = float(n)
    for u in units:
        if v < 1024.0:
            return f"{v:.1f} {u}"
        v /= 1024.0
    return f"{v:.1f} {last}"


def py_duration(d):
    if d is None or d == 0:
        return "N/A"
    h, m, s = int(d // 3600), int((d % 3600) // 60), int(d % 60)
    return f"{h:02d}:{m:02d}:{s:02d}" if h > 0 else f"{m:02d}:{s:02d}"


def py_flatten(existing, moves):
    taken, out = set(existing), {}
    for src, name in sorted(moves):
        new = name
        if new in taken:
            dot = name.rfind(".")
            stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
            n = 1
            while f"{stem}_{n}{ext}" in taken:
                n += 1
            new = f"{stem}_{n}{ext}"
        taken.add(new)
        out[src] = new
    return out


# --- tests ------------------------------------------------------------------------------

def test_size_and_duration_labels(spark):
    rnd = random.Random(7)
    sizes = [0, 1, 1023, 1024, 1048570, 1048576, 256, 1536, 2560] + \
        [rnd.randrange(0, 1 << 45) for _ in range(300)] + [rnd.randrange(0, 5000) for _ in range(200)]
    durs = [None, 0.0, 0.5, 59.9, 60.0, 3599.5, 3600.0, 7199.5, 400000.0] + \
        [rnd.uniform(0, 100000) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in sizes], "s bigint")
    got = [r.l for r in df.select(FM.file_size_label(F.col("s")).alias("l")).collect()]
    assert got == [py_size(s) for s in sizes]
    got = [r.l for r in df.select(FM.plan_size_label(F.col("s")).alias("l")).collect()]
    assert got == [py_size(s, ("B", "KB", "MB", "GB"), "TB") for s in sizes]
    dd = spark.createDataFrame([(d,) for d in durs], "d double")
    got = [r.l for r in dd.select(FM.duration_label(F.col("d")).alias("l")).collect()]
    assert got == [py_duration(d) for d in durs]


def test_bitrate_label(spark):
    vals = [None, 0, 1, 999, 16400, 119300, 999999, 1000000, 15000000, 999999999, 2500000000]
    df = spark.createDataFrame([(v,) for v in vals], "b bigint")
    got = [r.l for r in df.select(FM.bitrate_label(F.col("b")).alias("l")).collect()]
    assert got == ["N/A", "N/A", "0.0 kbit/s", "1.0 kbit/s", "16.4 kbit/s", "119.3 kbit/s",
                   "1000.0 kbit/s", "1.0 Mbit/s", "15.0 Mbit/s", "1000.0 Mbit/s", "2.5 Gbit/s"]


def test_path_helpers(spark):
    cases = ["/a/b/c.jpg", "/a/.hidden", "/a/b.tar.gz", "/x.jpg", "rel.JPG", "/a/b/..x.y", "/a/b/a."]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    rows = df.select(P.dirname("p").alias("d"), P.basename("p").alias("b"), P.stem("p").alias("s"),
                     P.extension("p").alias("e")).collect()
    for c, r in zip(cases, rows):
        assert r.d == os.path.dirname(c)
        assert r.b == os.path.basename(c)
        assert (r.s, r.e) == os.path.splitext(os.path.basename(c))


# Path -> date read from it, worked out by hand.
PATH_DATES = [
    ("/x/2015-12-27 19-22-41.MP4", datetime(2015, 12, 27, 19, 22, 41)),
    ("/x/2015-12-27_19-22-41.jpg", datetime(2015, 12, 27, 19, 22, 41)),
    ("/x/20151227_192241.jpg", datetime(2015, 12, 27, 19, 22, 41)),
    ("/x/2015-12-27T19:22:41.mp4", datetime(2015, 12, 27, 19, 22, 41)),
    ("/2019/2015-12-27 19-22-41.MP4", datetime(2015, 12, 27, 19, 22, 41)),  # the name comes first
    ("/2019/2015-02-30 10-00-00.jpg", datetime(2019, 1, 1)),  # no such day: on to the folders
    ("/x/2015-12-27 24-00-00.jpg", None),
    ("/x/VID_20211305_122219_1.mp4", None),
    ("/2020.09.13-event/x.jpg", datetime(2020, 9, 13)),
    ("/2020.02.30 x/2018/x.jpg", datetime(2020, 2, 1)),  # no such day, but year.month.word
    ("/2013.06.xx - trip/x.jpg", datetime(2013, 6, 1)),
    ("/2019/2013.06.xx - trip/x.jpg", datetime(2013, 6, 1)),  # month folders before year folders
    ("/2013.06.xx/2020.09.13/x.jpg", datetime(2020, 9, 13)),  # day folders before month folders
    ("/2013.13.xx/x.jpg", None), ("/2019/x.jpg", datetime(2019, 1, 1)),
    ("/1899/x.jpg", None), ("/1900/x.jpg", datetime(1900, 1, 1)),
    ("/2030/x.jpg", datetime(2030, 1, 1)), ("/2031/x.jpg", None),
    ("/a2014b/x.jpg", None), ("/x/0000-01-01 00-00-00.jpg", None), ("/photos/IMG_001.jpg", None),
]

# File name -> date.
NAME_DATES = [
    ("2018-03-10 21-30-06.JPG", datetime(2018, 3, 10, 21, 30, 6)),
    ("2018-03-10_21-30-06.jpg", datetime(2018, 3, 10, 21, 30, 6)),
    ("20180310_213006.JPG", datetime(2018, 3, 10, 21, 30, 6)),
    ("2018-03-10T21:30:06.mp4", datetime(2018, 3, 10, 21, 30, 6)),
    ("2018-03-10t21:30:06.MP4", datetime(2018, 3, 10, 21, 30, 6)),
    ("2018-03-10 21:30:06.3gp", datetime(2018, 3, 10, 21, 30, 6)),
    ("2018-03-10 21-30-06.xyz", datetime(2018, 3, 10, 21, 30, 6)),
    ("IMG_20180310_213006.jpg", datetime(2018, 3, 10, 21, 30, 6)),
    ("img_20180310_213006.jpg", datetime(2018, 3, 10, 21, 30, 6)),
    ("VID_20211305_122219.mp4", None), ("2018-02-30 21-30-06.jpg", None), ("DSC_1.jpg", None),
    ("2021-01-05 12-22-19.MP4", datetime(2021, 1, 5, 12, 22, 19)),
]

# The lines of one suggestion list, and the (path, date) rows that it stands for.
SUGGESTION_LINES = [
    "/a/one.jpg", "CREATION_TIME 2016-01-02 03:04:05",
    "/a/two.jpg", "# note", "", "# note", "CREATION_TIME 2016-02-02 00:00:00",  # the fourth line after
    "/a/three.jpg", "# 1", "# 2", "# 3", "# 4", "CREATION_TIME 2016-03-02 00:00:00",  # one too late
    "/a/four.jpg", "/a/five.jpg", "CREATION_TIME 2016-04-02 00:00:00",  # a path between
    "/a/six.jpg", "# CREATION_TIME 2000-01-01 00:00:00",
    "", "CREATION_TIME 2016-05-02 00:00:00", "CREATION_TIME 2016-06-02 00:00:00",  # the first counts
    "/a/seven.jpg",
]
SUGGESTIONS = [
    ("/a/one.jpg", datetime(2016, 1, 2, 3, 4, 5)), ("/a/two.jpg", datetime(2016, 2, 2)),
    ("/a/three.jpg", None), ("/a/four.jpg", None), ("/a/five.jpg", datetime(2016, 4, 2)),
    ("/a/six.jpg", datetime(2016, 5, 2)), ("/a/seven.jpg", None),
]


def test_path_dates(spark):
    df = spark.createDataFrame([(p,) for p, _ in PATH_DATES], "p string")
    got = [r.d for r in df.select(D.datetime_from_path(F.col("p")).alias("d")).collect()]
    assert list(zip([p for p, _ in PATH_DATES], got)) == PATH_DATES


def test_name_dates(spark):
    df = spark.createDataFrame([(n,) for n, _ in NAME_DATES], "n string")
    got = [r.d for r in df.select(D.datetime_from_filename(F.col("n")).alias("d")).collect()]
    assert list(zip([n for n, _ in NAME_DATES], got)) == NAME_DATES


def test_exif_and_iso(spark):
    df = spark.createDataFrame([("2023:03:20 10:15:00",), ("2023:03:20 10:15:00.55+02:00",),
                                ("2023-03-20 10:15:00",), ("2023:02:30 10:15:00",), ("short",),
                                (None,)], "t string")
    got = [r.d for r in df.select(D.exif_datetime(F.col("t")).alias("d")).collect()]
    assert got == [datetime(2023, 3, 20, 10, 15), datetime(2023, 3, 20, 10, 15), None, None, None, None]
    iso = spark.createDataFrame([("2016-05-14T02:12:13.000000Z",), ("0000-00-00T00:00:00.000000Z",),
                                 ("2016-05-14 02:12:13",), ("2016-05-14T02:12:13Z",)], "t string")
    got = [r.d for r in iso.select(D.iso_creation_time(F.col("t")).alias("d")).collect()]
    assert got == [datetime(2016, 5, 14, 2, 12, 13), None, None, datetime(2016, 5, 14, 2, 12, 13)]
    fr = spark.createDataFrame([("30000/1001",), ("25/1",), ("0/0",), ("30",), (None,)], "r string")
    got = [r.f for r in fr.select(D.frame_rate(F.col("r")).alias("f")).collect()]
    assert got[0] == pytest.approx(30000 / 1001) and got[1:] == [25.0, 0.0, 0.0, 0.0]


def test_flatten_against_brute_force(spark):
    rnd = random.Random(11)
    names = ["a.jpg", "a_1.jpg", "a_2.jpg", "a_1_1.jpg", "b.jpg", "a.png", "c", "c_1", ".x", "a_10.jpg"]
    for trial in range(6):
        files = [(f"/t/s{rnd.randint(0, 5)}/{rnd.randint(0, 9)}/{rnd.choice(names)}", 1)
                 for _ in range(60)]
        files = list(dict(files).items())
        existing_files = [(f"/t/{n}", 1) for n in rnd.sample(names, rnd.randint(0, 4))]
        df = spark.createDataFrame(files + existing_files, "file_path string, file_size bigint")
        dirs = spark.createDataFrame([("/t/s0",), ("/t/s1",)], "dir_path string")
        plan = {r.source_path: r.target_name for r in K2.flatten_plan(df, "/t", dirs).collect()}
        existing = [p.rsplit("/", 1)[1] for p, _ in existing_files] + ["s0", "s1"]
        expect = py_flatten(existing, [(p, p.rsplit("/", 1)[1]) for p, _ in files])
        assert plan == expect, trial


def test_flatten_contested_slots_in_rounds(spark):
    """Names that are each other's numbered forms, asked for early and late, in chains of several levels."""
    rnd = random.Random(23)
    for trial in range(4):
        names = ["a.jpg"] + [f"a_{k}.jpg" for k in range(1, 9)] + [f"a_{k}_{j}.jpg" for k in (1, 2, 3) for j in (1, 2)] + \
            ["a_01.jpg", "a_.jpg", "_1.jpg", "a_1_1_1.jpg", "a._1.jpg", ".a_1", ".a", "a_99999999999999999999.jpg"]
        files = sorted({f"/t/{rnd.choice('pqrs')}{rnd.randint(0, 30):02d}/{rnd.choice(names[:1 + 6 * (trial + 1)])}"
                        for _ in range(90)})
        held = rnd.sample(names, trial * 2)
        df = spark.createDataFrame([(p, 1) for p in files] + [(f"/t/{n}", 1) for n in held], "file_path string, file_size bigint")
        plan = K2.flatten_plan(df, "/t")
        assert {r.source_path: r.target_name for r in plan.collect()} == \
            py_flatten(held, [(p, p.rsplit("/", 1)[1]) for p in files]), trial
        assert "Pandas" not in plan._jdf.queryExecution().executedPlan().toString()


def test_flatten_of_nothing(spark):
    none = spark.createDataFrame([], "file_path string, file_size bigint")
    assert K2.flatten_plan(none, "/t").count() == 0 and K2.move_totals(K2.flatten_plan(none, "/t")).first().moved == 0


def test_flatten_hot_name_stays_native(spark):
    files = [(f"/t/d{i:04d}/IMG_0001.jpg", 10) for i in range(500)]
    plan = K2.flatten_plan(spark.createDataFrame(files, "file_path string, file_size bigint"), "/t")
    got = {r.source_path: r.target_name for r in plan.collect()}
    assert got["/t/d0000/IMG_0001.jpg"] == "IMG_0001.jpg"
    assert got["/t/d0499/IMG_0001.jpg"] == "IMG_0001_499.jpg"
    assert K2.move_totals(plan).first().conflicts == 499


def test_suggestion_list(spark):
    folder = tempfile.mkdtemp(prefix="ml-sugg-", dir="/tmp")
    expect = []
    for f in range(3):
        with open(os.path.join(folder, f"list{f}.txt"), "w") as fh:
            fh.write("\n".join(x.replace("/a/", f"/lib{f}/") for x in SUGGESTION_LINES) + "\n")
        expect += [(p.replace("/a/", f"/lib{f}/"), d) for p, d in SUGGESTIONS]
    got = L.read_suggestion_list(spark, folder).collect()
    assert sorted((r.file_path, r.suggested) for r in got) == \
        sorted(expect, key=lambda t: (t[0], t[1] or datetime.min))


def test_suggestions_across_segments(spark):
    """Random lists cut into segments of any length against the rule line by line."""
    rnd = random.Random(31)
    lines = {f"l{f}": [rnd.choice(["/p", "/p", "CREATION_TIME 2016-01-0", "#", "", "CREATION_TIMES"]) for _ in range(rnd.choice([1, 40, 90]))]
             for f in range(4)}
    lines = {f: [x + (f"{i}.jpg" if x == "/p" else f"{1 + i % 9} 01:02:03" if x.endswith("-0") else "") for i, x in enumerate(v)]
             for f, v in lines.items()}
    want = set()
    for f, v in lines.items():
        for i, x in enumerate(v):
            if x.startswith("/p"):
                ahead = []
                for y in v[i + 1: i + 5]:
                    if y.startswith("/p"):
                        break
                    ahead.append(y)
                times = [y for y in ahead if y.startswith("CREATION_TIME ")]
                want.add((f, i, x, datetime.strptime(times[0][14:], "%Y-%m-%d %H:%M:%S") if times else None))
    df = spark.createDataFrame([(f, i, f"  {x}\t") for f, v in lines.items() for i, x in enumerate(v)], "file string, line_no long, value string")
    for segment in (1, 2, 3, 5, 16, 1 << 16):
        plan = L.attach_suggestions(df, 4, segment)
        assert {tuple(r) for r in plan.collect()} == want, segment
        assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_malformed_suggestion_raises(spark):
    folder = tempfile.mkdtemp(prefix="ml-bad-", dir="/tmp")
    with open(os.path.join(folder, "l.txt"), "w") as fh:
        fh.write("/a/b.jpg\nCREATION_TIME 2016-02-30 00:00:00\n")
    with pytest.raises(Exception):
        L.read_suggestion_list(spark, folder).collect()


def test_file_list_nfc_and_comments(spark):
    decomposed = "/lib/Café.jpg"
    df = spark.createDataFrame([(f"  {decomposed}\t",), ("# comment",), ("   ",), ("/lib/a.jpg",),
                                ("/lib/a.jpg",)], "value string")
    got = [r.file_path for r in L.parse_file_list(df).collect()]
    assert got == [unicodedata.normalize("NFC", decomposed), "/lib/a.jpg", "/lib/a.jpg"]


def test_global_row_number(spark):
    rnd = random.Random(2)
    vals = [(rnd.randint(0, 50), f"k{i}") for i in range(2000)]
    df = spark.createDataFrame(vals, "c int, k string").repartition(7)
    got = global_row_number(df, [F.col("c").desc(), F.col("k")], "n").collect()
    expect = sorted(vals, key=lambda t: (-t[0], t[1]))
    assert sorted((r.n, r.c, r.k) for r in got) == [(i + 1, c, k) for i, (c, k) in enumerate(expect)]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_global_row_number_wide_rows_small_partitions(spark, adaptive):
    n = 400_000
    conf = {"spark.sql.adaptive.enabled": adaptive,
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(n, numPartitions=7).select(
            ((F.col("id") * 7919) % n).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 4)
            .alias("payload"))
        got = global_row_number(df, [F.col("k")], "n").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") != F.col("k") + 1).alias("bad"))
        assert tuple(got.first()) == (n, 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_flatten_hot_name_with_collisions(spark):
    files = [(f"/t/d{i:04d}/a.jpg", 1) for i in range(300)]
    files += [("/t/d0100/x/a_1.jpg", 1), ("/t/d0200/a_5.jpg", 1), ("/t/d0250/a_5_1.jpg", 1),
              ("/t/e/a.png", 1)]
    existing = [("/t/a_3.jpg", 1), ("/t/a_2.jpg", 1)]
    df = spark.createDataFrame(files + existing, "file_path string, file_size bigint")
    plan = {r.source_path: r.target_name for r in K2.flatten_plan(df, "/t").collect()}
    expect = py_flatten(["a_3.jpg", "a_2.jpg"], [(p, p.rsplit("/", 1)[1]) for p, _ in files])
    assert plan == expect


def test_rank_within_hot_groups(spark):
    from medialake.operators import ranking
    rnd = random.Random(9)
    rows = [("hot", f"p{rnd.randrange(10**6):07d}") for _ in range(400)] + \
        [(f"g{i % 7}", f"p{i:04d}") for i in range(70)]
    df = spark.createDataFrame(rows, "k string, p string").dropDuplicates(["k", "p"])
    got = {(r.k, r.p): r.rank for r in ranking.rank_within(df, ["k"], ["p"]).collect()}
    expect = {}
    for k in {k for k, _ in got}:
        for i, (_, p) in enumerate(sorted(x for x in got if x[0] == k)):
            expect[(k, p)] = i
    assert got == expect


def test_flatten_hot_path(spark):
    files = [(f"/t/d{i:03d}/a.jpg", 1) for i in range(120)] + [("/t/d050/z/a_1.jpg", 1)]
    df = spark.createDataFrame(files + [("/t/a_2.jpg", 1)], "file_path string, file_size bigint")
    plan = {r.source_path: r.target_name for r in K2.flatten_plan(df, "/t").collect()}
    assert plan == py_flatten(["a_2.jpg"], [(p, p.rsplit("/", 1)[1]) for p, _ in files])


def test_date_texts_do_not_depend_on_the_session_zone(spark):
    from medialake.functions import dates as D
    texts = ["2018-03-11 02:30:00", "2018-11-04 01:30:00", "2018-03-25 02:30:00"]  # gap, overlap, gap
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", F.col("t").cast("timestamp_ntz").alias("ts"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/Los_Angeles", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", other)
            for r in rows.select("t", D.ts_text("ts").alias("a"), D.iso_with_offset("ts").alias("b")).collect():
                assert (r.a, r.b) == (r.t, r.t.replace(" ", "T") + "+00:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
