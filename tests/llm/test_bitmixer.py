"""Bit mixing: counts and base score against plain Python, spelling and token scores against loops."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from medialake.llm import bitmixer

SCHEMA = "doc_id long, text string, lang string, source string, row long, block long, word string, n long"


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]


def _held(i):
    return zlib.crc32(("null" if i is None else str(i)).encode()) % 10 == 0


def _rows(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "the", "a", "Größe", "日本", "x\0y", "q" * 40] + [f"w{rng.randrange(60)}" for _ in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60]))) + rng.choice(["", "\n", " \t new" + str(i)]),
             None, None, 1, 2, "w", 3) for i in range(n)]
    return rows + [(None, None, None, None, 0, 0, "", 0), (None, "null id", None, None, 0, 0, "", 0), (n, "", "", "", 0, 0, "", 0),
                   rows[0], rows[0], (n + 1, "b" * 5000 + " " + "c d " * 3000, "", "", 0, 0, "", 0)]


def test_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(bitmixer, "BLOCK", 2000)  # many blocks; the long text comes in parts
    rows = _rows(120)
    got = bitmixer.score_table(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    count = collections.Counter(w for r in rows if not _held(r[0]) for w in _words(r[1]))
    n, v = sum(count.values()), len(count)

    def told(r):
        ws = _words(r[1])
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        size = sum(len(w.encode()) + 1 for w in ws)
        return (str(r[0]), _held(r[0]), len(ws), sum(count[w] > 0 for w in ws), n, size, round(base, 6))

    assert sorted(told(r) for r in rows) == sorted(
        (str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["n_bytes"], round(r["base_score"], 6))
        for r in got)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 and math.isfinite(r["score"]) for r in got)
    same = {(r["doc_id"], r["n_tokens"]): r["score"] for r in got if r["doc_id"] == rows[0][0]}
    assert len(same) == 1  # repeated rows cost the same


def test_reruns_and_blocks_agree(spark, monkeypatch):
    rows = _rows(60, 2)
    table = spark.createDataFrame(rows, SCHEMA)
    a, b = ([round(r["score"], 4) for r in bitmixer.score_table(t).orderBy("doc_id", "n_tokens", "n_bytes", "score").collect()]
            for t in (table.coalesce(1), table.repartition(3)))
    assert a == b


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bitmixer.score_table(none).count() == 0
    held = next(i for i in range(100) if _held(i))
    rows = bitmixer.score_table(spark.createDataFrame([(held, "a b", "", "", 0, 0, "", 0)], SCHEMA)).collect()
    assert len(rows) == 1 and rows[0]["train_tokens"] == 0 and rows[0]["n_known"] == 0 and rows[0]["base_score"] == 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(5)
    count = collections.Counter(("".join(rng.choice("aeiou") + rng.choice("bdg") for _ in range(rng.randrange(1, 5)))).encode()
                                for _ in range(3000))
    count[b"\xc3\xa9t\xc3\xa9"] = 7
    batch = pa.record_batch({"word": pa.array(list(count), pa.binary()), "n": pa.array(list(count.values()), pa.int64())})
    node = np.zeros((len(bitmixer.ORDERS) * bitmixer.SLOTS, 512), dtype=np.int64)
    for r in bitmixer._context_counts([batch]):
        np.add.at(node, (r["slot"].to_numpy(), 256 + r["symbol"].to_numpy()), r["n"].to_numpy())
    for k in range(255, 0, -1):
        node[:, k] = node[:, 2 * k] + node[:, 2 * k + 1]
    pair = node.reshape(len(node), 256, 2)
    return count, bitmixer._logistic(pair[:, :, 1], pair[:, :, 0])


def _plain_bits(word, count, weights, shift):
    """The spelling cost of a word, context by context and bit by bit, from the words themselves."""
    total, written = 0.0, word + b"\0"
    for j, byte in enumerate(written):
        for i in range(8):
            s = 0.0
            for m, order in enumerate(bitmixer.ORDERS):
                past = written[max(0, j - order): j]
                ones = zeros = 0
                for w, n in count.items():
                    w += b"\0"
                    for k in range(len(w)):
                        if w[max(0, k - order): k] == past and w[k] >> (8 - i) == byte >> (8 - i):
                            one = w[k] >> (7 - i) & 1
                            ones, zeros = ones + n * one, zeros + n * (1 - one)
                step = max(-127, min(127, round(math.log((ones + 0.4) / (zeros + 0.4)) / 0.08)))
                s += weights[m, min(j, bitmixer.PLACES - 1), i] * step * 0.08
            s = max(-bitmixer.TOP, min(bitmixer.TOP - 1e-3, s))
            s += shift[i, int((s + bitmixer.TOP) * bitmixer.CELLS / (2 * bitmixer.TOP))]
            total += math.log10(1 / (1 + math.exp(-s if byte >> (7 - i) & 1 else s)))
    return total


def test_spelling_equals_plain_bits(model):
    count, hashed = model
    small = dict(list(count.items())[:60])
    batch = pa.record_batch({"word": pa.array(list(small), pa.binary()), "n": pa.array(list(small.values()), pa.int64())})
    rows = [r for b in bitmixer._context_counts([batch]) for r in b.to_pylist()]
    hashed = np.zeros((len(bitmixer.ORDERS) * bitmixer.SLOTS, 256), dtype=np.int8)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["slot"]].append(r)
    for slot, rs in slots.items():
        told = bitmixer._slot_logistics(pa.Table.from_pylist(rs, schema=pa.schema({"slot": pa.int64(), "symbol": pa.int32(), "n": pa.int64()})))
        hashed[slot] = np.frombuffer(told.column("nodes")[0].as_py(), dtype=np.int8)
    weights, shift = bitmixer.learn(pa.array(sorted(small), pa.binary()), hashed, lanes=4)
    words = [*list(small)[:4], b"zz", b"a", "été".encode()]
    got = bitmixer.spell(pa.array(words, pa.binary()), hashed, weights, shift)
    assert got == pytest.approx([_plain_bits(w, small, weights, shift) for w in words], rel=1e-3)


def test_learning_pays_and_bits_sum_to_one(model):
    count, hashed = model
    words = pa.array(sorted(count), pa.binary())
    learned = bitmixer.learn(words, hashed, lanes=16)
    first = (np.repeat(bitmixer.FIRST, bitmixer.PLACES * 8).reshape(len(bitmixer.ORDERS), bitmixer.PLACES, 8),
             np.zeros((8, bitmixer.CELLS)))
    assert bitmixer.spell(words, hashed, *learned).sum() > bitmixer.spell(words, hashed, *first).sum()
    # all texts of one byte and of two bytes that begin alike are apart: their chances add up to at most 1
    short = pa.array([bytes([b]) for b in range(1, 256)] + [b"a" + bytes([b]) for b in range(1, 256)], pa.binary())
    assert 0 < (10 ** bitmixer.spell(short, hashed, *learned)).sum() <= 1.0001


def _looped(text, hashed, weights, shift):
    """log10 of each word's bits in one text, bit after bit, and the state at its end."""
    weights, shift, out = weights.copy(), shift.copy(), []
    for word in text:
        written, total = word + b"\0", 0.0
        flat, depth = np.frombuffer(written, dtype=np.uint8), np.arange(len(written))
        features = bitmixer._features(flat, depth, hashed)
        for j, byte in enumerate(written):
            place = min(j, bitmixer.PLACES - 1)
            for i in range(8):
                x = np.array([f[j, i] * bitmixer.STEP for f in features])
                s = min(max(float(weights[:, place, i] @ x), -bitmixer.TOP), bitmixer.TOP - 1e-3)
                cell = int((s + bitmixer.TOP) * bitmixer.CELLS / (2 * bitmixer.TOP))
                p = 1 / (1 + math.exp(-min(max(s + shift[i, cell], -bitmixer.TOP), bitmixer.TOP)))
                bit = byte >> (7 - i) & 1
                total += math.log10(p if bit else 1 - p)
                shift[i, cell] += bitmixer.MAP_RATE * (bit - p)
                weights[:, place, i] += bitmixer.RATE * (bit - p) * x
        out.append(total)
    return out, weights, shift


def _three_texts(count):
    rng = random.Random(8)
    return [[*rng.choices(sorted(count), k=k), b"\n"] for k in (30, 1, 12)]


def test_texts_are_mixed_online(model):
    count, hashed = model
    texts = _three_texts(count)
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    ids, tokens = np.array([number[w] for t in texts for w in t]), np.array([len(t) for t in texts])
    begin = bitmixer._first_state()
    got, weights, shift = bitmixer.online(pa.array(number, pa.binary()), hashed, ids, tokens, *begin)
    want = [_looped(t, hashed, *begin) for t in texts]
    size = [sum(len(w) + 1 for w in t) for t in texts]
    assert got == pytest.approx([x for w in want for x in w[0]], rel=1e-3)
    assert weights == pytest.approx(sum(n * w[1] for n, w in zip(size, want)), rel=1e-2, abs=1e-2)
    assert shift == pytest.approx(sum(n * w[2] for n, w in zip(size, want)), rel=1e-2, abs=1e-1)
    still = bitmixer.online(pa.array(number, pa.binary()), hashed, ids, tokens, *begin, rate=0, map_rate=0)[0]
    assert still == pytest.approx(bitmixer.spell(pa.array(number, pa.binary()), hashed, *begin)[ids], rel=1e-4)
    assert got.sum() > still.sum()


def _online(texts, hashed):
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    return bitmixer.online(pa.array(number, pa.binary()), hashed, np.array([number[w] for t in texts for w in t]),
                           np.array([len(t) for t in texts]), *bitmixer._first_state())


def test_lanes_take_the_next_text_when_one_ends(model, monkeypatch):
    texts = [[b"ab"] * 32 + [b"abc"], *[[b"ab", b"abc", b"abc"]] * 90, *[[b"\n"]] * 5]  # 100, 11 and 2 bytes
    steps, exp = [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, **more: steps.append(len(x)) or exp(x, **more))
    monkeypatch.setattr(bitmixer, "SIDE", 8)
    got = _online(texts, model[1])[0]
    assert sum(steps) == 100 + 90 * 11 + 5 * 2 and len(steps) <= sum(steps) / 8 + 11  # a lane never waits for the longest text
    assert got[:33] == pytest.approx(_looped(texts[0], model[1], *bitmixer._first_state())[0], rel=1e-3)
    assert all((got[33 + 3 * i: 36 + 3 * i] == got[33:36]).all() for i in range(90))


def test_lanes_and_bytes_ahead_leave_results_alone(model, monkeypatch):
    count, hashed = model
    monkeypatch.setattr(bitmixer, "SEGMENT", 29)  # within words
    texts = [t for t in _three_texts(count) for _ in range(3)]
    found = []
    for side, ahead in ((1, 1), (3, 7), (1024, 32)):
        monkeypatch.setattr(bitmixer, "SIDE", side)
        monkeypatch.setattr(bitmixer, "AHEAD", ahead)
        found.append(_online(texts, hashed))
    for got in found[1:]:
        assert all(x == pytest.approx(y, rel=1e-6, abs=1e-6) for x, y in zip(got, found[0]))
    whole = texts[0][:next(i for i in range(9) if sum(len(w) + 1 for w in texts[0][:i + 1]) > 29)]
    assert found[0][0][:len(whole)] == pytest.approx(_looped(whole, hashed, *bitmixer._first_state())[0], rel=1e-3)


def test_scores_learn_within_the_text(model):
    count, hashed = model
    texts = _three_texts(count)
    parts = pa.table({"row": [1, 2, 3], "doc_id": [1, 2, 3], "held": [True] * 3,
                      "part": pa.array([b"".join(w + b"\0" for w in t) for t in texts], pa.binary())})
    none = pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    got = bitmixer._score_block(parts, none, (hashed, *bitmixer._first_state()), 0, 0, 0)["score"].to_pylist()
    for text, score in zip(texts, got):
        chance, seen, want = _looped(text, hashed, *bitmixer._first_state())[0], collections.Counter(), 0.0
        for i, (w, c) in enumerate(zip(text, chance)):
            p = math.log10(seen[w] + bitmixer.OWN * 10 ** c) if seen[w] else math.log10(bitmixer.OWN) + c
            want += p - math.log10(i + bitmixer.OWN)
            seen[w] += 1
        assert score == pytest.approx(want, rel=1e-4)


def test_mixer_learns_from_all_words_of_training_texts(spark, model):
    count, hashed = model
    texts = _three_texts(count)
    rows = [(h, bytearray(b"".join(w + b"\0" for w in t))) for h, t in zip((False, False, True), texts)]
    parts = spark.createDataFrame(rows, "held boolean, part binary").repartition(2)
    weights, shift = bitmixer.mixer(parts, spark.sparkContext.broadcast(hashed))
    size = np.array([sum(len(w) + 1 for w in t) for t in texts[:2]])
    want = [_looped(t, hashed, *bitmixer._first_state()) for t in texts[:2]]
    assert weights == pytest.approx(sum(n * w[1] for n, w in zip(size, want)) / size.sum(), abs=1e-3)
    assert shift == pytest.approx(sum(n * w[2] for n, w in zip(size, want)) / size.sum(), abs=1e-3)


def test_token_scores_equal_a_loop():
    rng = np.random.default_rng(2)
    owner = np.sort(rng.integers(0, 4, 200))
    ids = rng.integers(0, 9, 200)
    chance = np.log10(rng.dirichlet(np.ones(9)))
    chance[3] = -5000.0  # a word whose chance is below the smallest double
    want, seen, at = [], collections.Counter(), None
    for o, w in zip(owner, ids):
        if o != at:
            seen, at = collections.Counter(), o
        p = seen[w] + bitmixer.OWN * 10 ** chance[w]
        want.append((math.log10(p) if seen[w] or chance[w] > -300 else math.log10(bitmixer.OWN) + chance[w])
                    - math.log10(sum(seen.values()) + bitmixer.OWN))
        seen[w] += 1
    assert bitmixer.score_tokens(owner, ids, chance) == pytest.approx(want)


def test_parts_keep_all_words(monkeypatch):
    monkeypatch.setattr(bitmixer, "BLOCK", 64)
    for text in (b"", b" ", b"a", b"a b " * 70, b"x" * 500 + b" y", b"A\0B \t c\n\r\x0b\x0cd"):
        parts = list(bitmixer._parts(text))
        words = [w.replace(b"\0", b"\t") for w in text.lower().split()] + [b"\n"]
        assert b"".join(parts) == b"".join(w + b"\0" for w in words)
