"""Property checks of the path helpers against os.path on random normalised paths."""

import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medialake.functions import paths as P

component = st.text(alphabet="ab. _-1", min_size=1, max_size=6).filter(lambda c: c not in (".", ".."))
paths = st.lists(component, min_size=1, max_size=5).map(lambda cs: "/" + "/".join(cs))


@settings(max_examples=5, deadline=None)
@given(st.lists(paths, min_size=200, max_size=200))
def test_path_helpers_match_os_path(spark, batch):
    df = spark.createDataFrame([(p,) for p in batch], "p string")
    rows = df.select("p", P.dirname("p").alias("d"), P.basename("p").alias("b"),
                     P.stem("p").alias("s"), P.extension("p").alias("e"),
                     P.depth(P.dirname("p")).alias("depth")).collect()
    for r in rows:
        assert r.d == os.path.dirname(r.p), r.p
        assert r.b == os.path.basename(r.p), r.p
        assert (r.s, r.e) == os.path.splitext(os.path.basename(r.p)), r.p
        assert r.depth == os.path.dirname(r.p).count("/")

def test_directory_tree_by_brute_force(spark):
    import random

    from medialake.operators.directories import directory_tree
    rng = random.Random(3)
    files = [("/lib/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) + f"/f{i}.jpg").replace("//", "/")
             for i in range(300)] + ["/lib/deep/x/y/z/only.mp4"]
    rows = [(p, i, "video" if p.endswith("mp4") else "image", i % 7 == 0) for i, p in enumerate(files)]
    got = {r.dir_path: r for r in directory_tree(spark.createDataFrame(
        rows, "file_path string, file_size long, media_type string, is_corrupted boolean")).collect()}
    dirs = {}
    for p, size, _, corrupted in rows:
        if not corrupted:
            own = d = p.rsplit("/", 1)[0]
            while d.startswith("/lib"):
                n = dirs.setdefault(d, [0, 0, 0, 0])
                n[0], n[1] = n[0] + 1, n[1] + size
                n[2], n[3] = n[2] + (d == own), n[3] + size * (d == own)
                d = d.rsplit("/", 1)[0]
    assert {d: [r.total_files, r.total_size, r.direct_files, r.direct_size] for d, r in got.items()} == dirs
    for d, r in got.items():
        assert r.parent_path == (None if d == "/lib" else d.rsplit("/", 1)[0])
        assert r.subdirs_count == sum(x.rsplit("/", 1)[0] == d for x in dirs if x != "/lib")
