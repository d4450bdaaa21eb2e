"""The source divergence audit against the plain sums over all kept terms."""

import collections
import random
import re

import numpy as np
import pytest

from medialake.llm import common, divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, term string, path string"


def _brute(rows, top):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(r[1]))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in seen.items() if n >= 3]
        v = len(kept)
        count = collections.defaultdict(collections.Counter)
        whole = collections.Counter()
        for _, s, ts in mine:
            count[s].update(t for t in ts if seen[t] >= 3)
            whole.update(t for t in ts if seen[t] >= 3)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}
        p, q = {s: share(count[s]) for s in count}, share(whole)
        for s in count:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in count if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or i <= top:
                        out.append((lang, s, part, item, value, i))
    return sorted(out)


def _rows(n, seed):
    rng = random.Random(seed)
    words = ["the", "The", "a", "über", "naïve", "x1y", "tab\tbed", "日本", "né-e", "zz"] + [f"t{chr(97 + i)}" for i in range(26)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40]))), rng.choice(["en", "de", None]),
             rng.choice(["s1", "s2", "s3", "é", "z", None]), None, 1, "term", "p") for i in range(n)]
    return rows + [(None, None, None, None, None, None, None, None), (None, None, "fr", "alone", None, None, None, None),
                   (1, "rare words only", "xx", "u", 0, 0, "", ""), (1, "", "xx", "w", 0, 0, "", ""), rows[0], rows[0],
                   (2, "long " * 400_000, "en", "s1", 0, 0, "", "")]


@pytest.mark.parametrize("n, top", [(0, 5), (60, 4), (300, 200)])
def test_values_equal_plain_sums(spark, n, top):
    rows = _rows(max(n, 1), n)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = divergence.divergence_table(table, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == _brute(rows, top)


def test_empty_table(spark):
    assert divergence.divergence_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_corrections_of_random_rows():
    """Nodes, multiplicities and ancestors of sorted rows against the sum over the rows."""
    rng = np.random.default_rng(4)
    for many in (1, 40, 300):
        rows = sorted(tuple((s, int(rng.integers(1, 3))) for s in range(6) if rng.random() < 0.6) for _ in range(many))
        rows = [(r, int(rng.integers(1, 1000))) for r in rows if r]
        flat = [x for r, _ in rows for x in r]
        source, n = (np.array([x[i] for x in flat], dtype=np.int64) for i in (0, 1))
        p, p0 = 1000 + 37 * n + source, 500 + 11 * source
        length = np.array([len(r) for r, _ in rows])
        start = np.cumsum(length) - length
        got = collections.Counter()

        def add(a, b, ab, ba, times):
            for x, y, v, w, t in zip(a.tolist(), b.tolist(), ab.tolist(), ba.tolist(), times.tolist()):
                got[x, y] += v * t
                got[y, x] += w * t

        divergence._piece(source, n, p, p0, start, length, np.array([m for _, m in rows]), add)
        f = lambda x, y: (x - y) ** 2 // y
        want = collections.Counter()
        for r, m in rows:
            for s, c in r:
                for o, e in r:
                    if s != o:
                        ps, po, zs, zo = 1000 + 37 * c + s, 1000 + 37 * e + o, 500 + 11 * s, 500 + 11 * o
                        want[s, o] += m * (f(ps, po) - f(ps, zo) - f(zs, po) + f(zs, zo))
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_split_words_pieces():
    text = b"ab  cde f " * 50 + b"x" * 100
    for step in (1, 2, 7, 64, 10_000):
        assert [w for piece in common.split_words(text, step) for w in piece] == text.split()
    assert list(common.split_words(b"")) == []
