"""Duplicate operators where one hash holds a third of all files: results and the split of its join."""

import collections

import pytest
from pyspark.sql import functions as F

from medialake.operators import duplicates as dup

N = 60_000
PATTERNS = ["copy", "backup"]
#: Small thresholds, so that the hot partition of a small table counts as skewed; no broadcast joins.
CONF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    i = F.col("id")
    yield spark.range(N).repartition(8).select(
        F.concat(F.lit("/lib/"), F.when(i % 7 == 0, "copy/").when(i % 5 == 0, "backup/").otherwise("a/"), i.cast("string"), F.lit(".jpg")).alias("file_path"),
        F.when(i % 3 == 0, "hot").otherwise(F.md5((F.floor(i / 4)).cast("string"))).alias("file_hash"),
        (i % 1000).alias("file_size"), F.lit(False).alias("is_corrupted"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _brute(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["file_hash"]].append((any(p in r["file_path"] for p in PATTERNS), r["file_path"], r["file_size"]))
    return {h: sorted(m) for h, m in groups.items() if len(m) > 1}


def test_join_of_a_hot_hash_is_split(hot):
    groups = _brute(hot.collect())
    roles = dup.classify_duplicates(hot, PATTERNS).select("file_path", "is_original")
    got = {r["file_path"] for r in roles.collect() if r["is_original"]}
    assert got == {m[0][1] for m in groups.values()}
    assert "skew=true" in _plan(roles)
    delete = dup.copies_to_delete(hot, PATTERNS)
    assert {r["file_path"] for r in delete.collect()} == {p for m in groups.values() for _, p, _ in m[1:] if "copy" in p}
    assert "skew=true" in _plan(delete)


def test_report_numbers_with_a_hot_hash(hot):
    groups = _brute(hot.collect())
    report = dup.duplicate_report(hot, PATTERNS).select("file_hash", "file_path", "group_no", "copy_no", "is_original")
    rows = report.collect()
    assert "skew=true" in _plan(report)
    order = {h: i for i, h in enumerate(sorted(groups, key=lambda h: (-len(groups[h]), h)), 1)}
    want = {(h, p, order[h], j, j == 0) for h, m in groups.items() for j, (_, p, _) in enumerate(m)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_wasted_space_needs_no_join(hot):
    groups = _brute(hot.collect())
    total = dup.wasted_space(hot, PATTERNS)
    row = total.first().asDict()
    waste = {h: max(s for _, _, s in m) * (len(m) - 1) for h, m in groups.items()}
    listed = {h: sum("copy" in p for _, p, _ in m[1:]) for h, m in groups.items()}
    assert row == {"duplicate_groups": len(groups), "copies": sum(len(m) - 1 for m in groups.values()),
                   "wasted_bytes": sum(waste.values()), "files_to_delete": sum(listed.values()),
                   "wasted_filtered": sum(waste[h] for h in groups if listed[h])}
    assert "Join" not in _plan(total)
