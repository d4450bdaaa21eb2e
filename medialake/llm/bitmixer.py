"""Language-model scores by online logistic context mixing over bits.

Text.  A text is the sequence of its words (A-Z lower-cased) and one end; as bytes, every word and a
zero byte, last a line feed and a zero byte.  (No word holds a line feed; a zero byte inside a
word is written as a tab, which no word holds either, so the writing is one to one.)  Each byte
is eight bits, the highest first.

Bits.  Three hashed-context bit predictors count what the training words held after the two, three and four
bytes before (contexts end at the word's begin), in ``SLOTS`` contexts each, and hand on the logistic
of the frequency of a one.  A mixer adds them up under weights gated by the bit and the byte's
place in its word; an adaptive map, a shift per bit and value of the mixed logistic, refines the sum,
and its squashed value is the probability.  Weights and map are learned online, over the bits of the texts
as they stand: after every byte both move along the gradient of the coding cost (a byte's eight bits
read weights and cells of their own, so none waits for another).  Training runs over every
training text, and the states that the texts end with are averaged by bytes.  From that state every text
to be scored starts, and it goes on learning while its bits are scored, so a bit's probability
depends on training and on the bits before alone.  Texts run side by side; the state of a text beyond
``SEGMENT`` bytes begins anew after each of them, since a text's own run is sequential.

Words.  The mixed bits spell every word, also those that training never met.  A word that it met c
times in N has a second chance: P(w) = l * c / N + (1 - l) * product of its bits, where 1 - l is the share
of training tokens whose word occurs once (Good and Turing's estimate of the new); the bits are those of this
place in the text, as the mixer stands there.  Last, the text
itself refines: after i words, m of them this one, the word costs log10((m + A * P(w)) / (i + A)).
``score`` is the sum over the words and the end.  Each is a probability given training and the words
before, so the scores of all continuations sum up to 1; ``bits_per_byte`` divides by the bytes.

Gathering.  Tasks cut the texts into blocks of about ``BLOCK`` bytes (a text beyond that into parts, at
words, whose own counts begin anew), store them, and count the words of each block.  One exchange by
word gives every (block, word) its c; a word of a single block has its count there already, so only
the others go back.  That table, and with it N, V and every c, grows with the corpus; the predictors
have a fixed size (``SLOTS`` * 256 bytes each) and the mixer a few hundred numbers, so both
are handed to every task.

Scale.  One exchange of texts (by block), one of (block, word) rows by word and one back.  A word in every
block is one row per block.  A block is the largest group and its size is fixed; training reads
the stored blocks where they lie, without an exchange.  Lost executors cost their tasks.

Defined results.  NULL text counts as empty; an empty text is its end alone (n_tokens 1).  A NULL id is
the text 'null' for crc32, so it is held out or not like any other.  Repeated rows are scored and
learned from each.  Without training texts N and V are 0, every base term is log10(0.1 / 0.1) = 0, and
every text starts from even bits.  An empty table gives no row.  Only ``doc_id`` and ``text`` are read,
so further columns cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.session import cut_lineage

from .common import split_words

#: Bytes of a block, and of the parts of a text beyond it.
BLOCK = 6 << 20
#: Predictors (bytes before) and contexts of each.
ORDERS, SLOTS = (2, 3, 4), 1 << 16
#: Lanes that texts are mixed in side by side, and bytes of a text after which its weights and map begin anew.
SIDE, SEGMENT = 1024, 1 << 14
#: Bytes of a lane that are looked up at a time.
AHEAD = 16
#: Stretches of a single sequence of words that ``learn`` runs over.
LANES = 512
#: Words spelled, and bytes whose features are looked up, at a time.
SOME = 1 << 13
#: Learning rates of weights and map, cells of the map per bit, places of a byte in its word that count.
RATE, MAP_RATE, CELLS, PLACES = 0.02, 0.02, 24, 5
#: First weights of the predictors.
FIRST = (0.1, 0.3, 0.6)
#: One step of a stored logistic (a byte holds -127 to 127 of them), and the prior of a frequency.
STEP, PRIOR = 0.08, 0.4
#: Largest logistic that is squashed.
TOP = 11.5
#: Words that P(w) is worth beside the text's own.
OWN = 1500.0
BASE = 0.1
END = b"\n"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of a byte, highest first, and the node of the byte's binary tree that each bit is read at.
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.float32)
_AGAINST = 1 - 2 * _BITS
_NODE = (1 << np.arange(8)) | (np.arange(256)[:, None] >> np.arange(8, 0, -1))


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text as they are scored, in lists of bounded size; last the end."""
    for words in split_words(text.translate(_LOWER)):
        yield [w.replace(b"\0", b"\t") for w in words] if b"\0" in text else words
    yield [END]


def _parts(text: bytes) -> Iterator[bytes]:
    """The written text, cut before a word whenever ``BLOCK`` bytes are reached."""
    held, size = [], 0
    for words in words_of(text):
        for i in range(0, len(words), 1 << 16):
            some = words[i: i + (1 << 16)]
            held.append(b"\0".join(some) + b"\0")
            size += len(held[-1])
            if size >= BLOCK:
                yield b"".join(held)
                held, size = [], 0
    if held:
        yield b"".join(held)


def blocks(docs: DataFrame) -> DataFrame:
    """Stored rows (block, row, doc_id, held, part): the written texts in blocks of bounded size."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        block, size, row = first, 0, first
        for batch in batches:
            out = []
            for doc_id, held, text in zip(*(batch.column(i) for i in range(3))):
                for part in _parts(text.as_py()):
                    out.append((block, row, doc_id, held, part))
                    size += len(part)
                    if size >= BLOCK:
                        yield told(out)
                        out, size, block = [], 0, block + 1
                row += 1
            if out:
                yield told(out)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(rows: list) -> pa.RecordBatch:
        b, r, i, h, p = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int64()), pa.array(r, pa.int64()), pa.array(i, i[0].type), pa.array(h, h[0].type),
             pa.array(p, pa.binary())], names=["block", "row", "doc_id", "held", "part"])

    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 10 == 0
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return cut_lineage(docs.select("doc_id", held.alias("held"), text.alias("text")).mapInArrow(
        cut, f"block long, row long, doc_id {kind}, held boolean, part binary"), "bits-blocks")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, n): every word of a block with its count in training texts.  A block that two
    tasks read parts of gives a word twice."""
    block, parts = None, {False: [], True: []}

    def told() -> pa.RecordBatch:
        words = _split(parts[False] + parts[True])
        size = sum(part.count(b"\0") for part in parts[False])  # words of training texts, the first ones
        n = np.bincount(words.indices.to_numpy()[:size], minlength=len(words.dictionary))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, dtype=np.int64)), words.dictionary.cast(pa.binary()),
                                           pa.array(n, pa.int64())], names=["block", "word", "n"])

    for batch in batches:
        for b, held, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if b != block:
                if block is not None:
                    yield told()
                block, parts = b, {False: [], True: []}
            parts[held].append(part.as_py())
    if block is not None:
        yield told()


# --- the hashed predictors -------------------------------------------------------------------


def _logistic(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The logistic of a frequency in steps, as bytes."""
    return np.clip(np.rint(np.log((ones + PRIOR) / (zeros + PRIOR)) / STEP), -127, 127).astype(np.int8)


def _contexts(symbol: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """Per byte and predictor the hash of the bytes before; depth is the byte's place in the word,
    behind which nothing is seen."""
    x = symbol.astype(np.int64)
    seen, out = np.zeros_like(x), []
    for k in range(1, max(ORDERS) + 1):
        back = np.zeros_like(x)
        back[k:] = x[:-k]
        seen |= np.where(depth >= k, back, 0) << 8 * (k - 1)
        if k in ORDERS:
            out.append((seen * 0x9E3779B1 >> 12) % SLOTS)
    return out


def _written(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words one after the other, each with its zero byte; starts and lengths with it."""
    ended = pc.binary_join_element_wise(words, b"", b"\0")  # the last one is the separator
    size = pc.binary_length(ended).to_numpy().astype(np.int64)
    end = np.cumsum(size)
    flat = np.frombuffer(ended.buffers()[2], dtype=np.uint8, count=end[-1])
    return flat, end - size, size


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, symbol, n); a slot is a predictor's number times ``SLOTS`` and a context."""
    for batch in batches:
        if batch.num_rows:
            flat, start, size = _written(batch.column("word"))
            times = np.repeat(batch.column("n").to_numpy(), size)
            depth = np.arange(len(flat)) - np.repeat(start, size)
            for k, context in enumerate(_contexts(flat, depth)):
                key, back = np.unique((k * SLOTS + context) << 8 | flat, return_inverse=True)
                n = np.zeros(len(key), dtype=np.int64)
                np.add.at(n, back, times)
                yield pa.RecordBatch.from_arrays([pa.array(key >> 8), pa.array((key & 255).astype(np.int32)), pa.array(n)],
                                                 names=["slot", "symbol", "n"])


def _slot_logistics(slot: pa.Table) -> pa.Table:
    """The logistics of the 255 nodes of a context's byte tree."""
    node = np.zeros(512, dtype=np.int64)
    node[256 + slot.column("symbol").to_numpy()] = slot.column("n").to_numpy()
    for k in range(255, 0, -1):
        node[k] = node[2 * k] + node[2 * k + 1]
    pair = node.reshape(256, 2)
    return pa.table({"slot": slot.column("slot")[:1], "nodes": pa.array([_logistic(pair[:, 1], pair[:, 0]).tobytes()])})


def hashed_predictors(words: DataFrame) -> np.ndarray:
    """Bytes (len(ORDERS) * SLOTS, 256): the logistic of each context and node.  The size is fixed."""
    told = (words.where("n > 0").select("word", "n").mapInArrow(_context_counts, "slot long, symbol int, n long")
            .groupBy("slot", "symbol").agg(F.sum("n").alias("n"))
            .groupBy("slot").applyInArrow(_slot_logistics, "slot long, nodes binary"))
    out = np.zeros((len(ORDERS) * SLOTS, 256), dtype=np.int8)
    for row in told.toLocalIterator():  # at most len(ORDERS) * SLOTS rows of 256 bytes, a partition at a time
        out[row["slot"]] = np.frombuffer(row["nodes"], dtype=np.int8)
    return out


# --- mixing ----------------------------------------------------------------------------------


def _features(flat: np.ndarray, depth: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Each predictor's eight logistics (in steps) of every byte, ``SOME`` bytes at a time."""
    nodes, out = hashed.reshape(-1), np.empty((len(ORDERS), len(flat), 8), dtype=np.int8)
    for i in range(0, len(flat), SOME):
        lo, hi = max(0, i - max(ORDERS)), i + SOME  # contexts reach back into the stretch before
        node = _NODE.take(flat[i: hi], axis=0)
        for k, context in enumerate(_contexts(flat[lo: hi], depth[lo: hi])):
            out[k, i: hi] = nodes.take(((k * SLOTS + context[i - lo:]) << 8)[:, None] + node)
    return out


def _cell(s: np.ndarray) -> np.ndarray:
    return ((s + np.float32(TOP)) * np.float32(CELLS / (2 * TOP))).astype(np.int64)


def _places(depth: np.ndarray) -> np.ndarray:
    return np.minimum(depth, PLACES - 1)


def _lanes(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A lane and an offset in it for each piece, and the lanes' lengths, longest first.  The longest piece goes
    first, each to the shortest lane, so lanes end at about the same time."""
    order = np.argsort(-length, kind="stable")
    sizes = length[order].tolist()
    heap = [(0, i) for i in range(min(SIDE, len(sizes), -(-sum(sizes) // sizes[0])))]
    lane, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    for i, n in zip(order.tolist(), sizes):
        offset[i], lane[i] = heap[0]
        heapq.heapreplace(heap, (heap[0][0] + n, heap[0][1]))
    heap.sort(reverse=True)
    rank = np.argsort([j for _, j in heap])
    return rank[lane], offset, np.array([n for n, _ in heap])


def online(words: pa.Array, hashed: np.ndarray, ids: np.ndarray, tokens: np.ndarray, weights: np.ndarray, shift: np.ndarray,
           *, rate: float = RATE, map_rate: float = MAP_RATE, scored: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts mixed bit by bit: log10 of the product of each token's bits, and the sums of the weights and maps
    that the texts end with, each times its bytes.  ``ids`` number the tokens' words, the texts one after the
    other; ``tokens`` are their counts, none 0.  Every text starts from ``weights`` and ``shift``.  Without
    ``scored`` the first result is 0: training needs the states alone."""
    flat, start, size = _written(words)
    depth = np.arange(len(flat)) - np.repeat(start, size)
    features = _features(flat, depth, hashed).view(np.int64)[..., 0]  # a predictor's eight bytes as one item
    wide = size[ids]
    end = np.cumsum(wide)
    rows = np.repeat(np.append(start[ids] - end + wide, -end[-1]).astype(np.int32), np.append(wide, 1))
    rows += np.arange(len(rows), dtype=np.int32)
    last = end[np.cumsum(tokens) - 1]
    first = np.append(0, last[:-1])
    pieces = -(-(last - first) // SEGMENT)
    first = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(last, pieces) - first)
    lane, offset, total = _lanes(length)
    m, most = len(total), int(total[0])
    cost = np.zeros(len(rows) if scored else 0, dtype=np.float32)  # the last item is of lanes that ended
    weights, shift = weights.astype(np.float32), shift.astype(np.float32).ravel()
    weight_sum, shift_sum = np.zeros(weights.shape), np.zeros(shift.shape)
    least, most_s, most_p = (np.full((m, 8), x, dtype=np.float32) for x in (-TOP, TOP - 1e-3, TOP))
    step, top, one, per = np.float32(STEP), np.float32(TOP), np.float32(1), np.float32(CELLS / (2 * TOP))
    rate, map_rate = np.float32(rate), np.float32(map_rate)
    place, mine, home = _places(depth).astype(np.uint8), np.arange(m), np.arange(m * 8).reshape(m, 8) * CELLS
    moved = np.tile(shift, m)
    maps, held, n = moved.reshape(m, -1), np.zeros(m), PLACES * m
    # rows of weights, a row per place and lane: as they stood before the bytes ahead, as texts begin, and after each byte ahead
    table = np.empty((len(ORDERS), 2 * n + AHEAD * m, 8), dtype=np.float32)
    table[:, n: 2 * n] = np.repeat(weights, m, axis=1)
    latest = np.arange(n, 2 * n)
    latest_of = latest.reshape(PLACES, m)

    def ended(some: np.ndarray) -> None:
        nonlocal weight_sum, shift_sum
        weight_sum = weight_sum + np.einsum("pgmb,m->pgb", table.take(latest_of[:, some], axis=1), held[some])
        shift_sum = shift_sum + held[some] @ maps[some]

    running = np.searchsorted(-total, -np.arange(most), side="left").tolist()  # lanes still running
    by_offset = np.argsort(offset, kind="stable")
    turns, turned = np.unique(offset[by_offset], return_index=True)
    turns, begun = [*turns.tolist(), most], np.split(by_offset, turned[1:])  # where lanes begin a text, and the pieces
    begin, turn, read = np.zeros(m, dtype=np.int64), 0, 0
    chances = np.ones((AHEAD, m, 8), dtype=np.float32) if scored else None
    for since in range(0, most, AHEAD):
        steps = np.arange(since, min(since + AHEAD, most))[:, None]
        byte = steps + begin
        while turns[read] < since + len(steps) and read < len(begun):
            new = lane[begun[read]]
            begin[new] = first[begun[read]] - turns[read]
            byte[turns[read] - since:, new] = steps[turns[read] - since:] + begin[new]
            read += 1
        if total[-1] < since + len(steps):
            byte[steps >= total] = len(rows) - 1
        ahead = rows.take(byte)
        bits, ats, symbols = features.take(ahead, axis=1), place.take(ahead) * np.int64(m) + mine, flat.take(ahead)
        for i in range(len(steps)):
            if since + i == turns[turn]:
                new = lane[begun[turn]]
                if since + i:
                    ended(new)
                    latest_of[:, new] = np.arange(n, 2 * n).reshape(PLACES, m)[:, new]
                    maps[new] = shift
                held[new] = length[begun[turn]]
                turn += 1
            k = running[since + i]
            at, now = ats[i, :k], 2 * n + i * m
            w = table.take(latest.take(at), axis=1)
            latest[at] = mine[:k] + now
            x = bits[:, i, :k].view(np.int8).astype(np.float32).reshape(len(ORDERS), k, 8)
            x *= step
            against = _AGAINST.take(symbols[i, :k], axis=0)
            s, *others = w * x
            for other in others:
                s += other
            np.minimum(np.maximum(s, least[:k], out=s), most_s[:k], out=s)
            spot = s + top
            spot *= per
            spot = spot.astype(np.int64)
            spot += home[:k]
            shifted = moved.take(spot)
            s += shifted
            np.minimum(np.maximum(s, least[:k], out=s), most_p[:k], out=s)
            s *= against
            np.exp(s, out=s)
            q = np.add(s, one, out=chances[i, :k] if scored else None)  # one over the chance of the bit
            s /= q
            s *= against  # the probability of a one less the bit
            shifted -= s * map_rate
            moved[spot] = shifted
            s *= rate
            x *= s
            np.subtract(w, x, out=table[:, now: now + k])
        table[:, :n] = table.take(latest, axis=1)
        latest[:] = np.arange(n)
        if scored:
            q = np.log(chances[:len(steps)]).reshape(-1)
            for _ in range(3):  # a byte's eight bits
                q = q[0::2] + q[1::2]
            cost[byte] = q.reshape(byte.shape)
    ended(mine)
    if not scored:
        return np.zeros(len(ids)), weight_sum, shift_sum.reshape(8, CELLS)
    del rows, features  # room for the sums
    return -np.add.reduceat(cost[:-1], end - wide, dtype=np.float64) / np.log(10), weight_sum, shift_sum.reshape(8, CELLS)


def _first_state() -> tuple[np.ndarray, np.ndarray]:
    """The weights (predictor, place, bit) and the map (bit, cell) that training starts from."""
    return np.repeat(FIRST, PLACES * 8).reshape(len(ORDERS), PLACES, 8), np.zeros((8, CELLS))


def learn(words: pa.Array, hashed: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """The averaged state after an online run over one sequence of words, in ``lanes`` stretches."""
    lanes = min(lanes, len(words))
    tokens = np.diff(np.arange(lanes + 1) * len(words) // lanes)
    _, weights, shift = online(words, hashed, np.arange(len(words)), tokens, *_first_state(), scored=False)
    size = sum(map(len, words.to_pylist())) + len(words)
    return weights / size, shift / size


def spell(words: pa.Array, hashed: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """log10 of the product of each word's bits under weights that stand still, ``SOME`` words at a time:
    what ``online`` gives at rates 0."""
    weights, shift = weights.astype(np.float32) * np.float32(STEP), shift.astype(np.float32).ravel()
    home, sign = np.arange(8) * CELLS, 1 - 2 * _BITS
    out = [np.zeros(0)]
    for i in range(0, len(words), SOME):
        flat, start, size = _written(words[i: i + SOME])
        depth = np.arange(len(flat)) - np.repeat(start, size)
        place = _places(depth)
        s = np.zeros((len(flat), 8), dtype=np.float32)
        for w, f in zip(weights, _features(flat, depth, hashed)):
            s += w.take(place, axis=0) * f
        np.clip(s, -TOP, TOP - 1e-3, out=s)
        s += shift.take(home + _cell(s))
        np.clip(s, -TOP, TOP, out=s)
        s *= sign.take(flat, axis=0)
        np.exp(s, out=s)
        s += 1  # one over the chance of the bit, at most e ** TOP: four of them fit a float
        four = s[:, :4] * s[:, 4:]
        cost = np.log(four[:, 0] * four[:, 1]) + np.log(four[:, 2] * four[:, 3])
        out.append(-np.add.reduceat(cost.astype(np.float64), start) / np.log(10))
    return np.concatenate(out)


def _split(parts: list[bytes]) -> pa.DictionaryArray:
    """The words of the parts one after the other, with a number for each distinct one by its first place."""
    whole = pa.array([b"".join(parts)[:-1]], pa.large_binary())
    return pc.split_pattern(whole, pattern="\0").values.dictionary_encode()


def _numbered(parts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, the numbers of all parts' words, and each part's count of words."""
    words = _split(parts)
    return (words.dictionary.cast(pa.binary()), words.indices.to_numpy().astype(np.int64),
            np.array([part.count(b"\0") for part in parts]))


def mixer(parts: DataFrame, hashed) -> tuple[np.ndarray, np.ndarray]:
    """The averaged state (by bytes) after online runs over all training texts, word by word as they stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n, held, size = 0.0, 0, [], 0

        def told() -> np.ndarray:
            words, ids, tokens = _numbered(held)
            _, w, m = online(words, hashed.value, ids, tokens, *_first_state(), scored=False)
            return np.concatenate([w.ravel(), m.ravel()])

        for batch in batches:
            for part in batch.column(0):
                held.append(part.as_py())
                size += len(held[-1])
                if size >= BLOCK:
                    state, n, held, size = state + told(), n + size, [], 0
        if held:
            state, n = state + told(), n + size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(state))), pa.array(state), pa.array(np.full(len(state), n))],
                                             names=["i", "x", "n"])

    told = parts.where("not held").select("part").mapInArrow(run, "i long, x double, n long").groupBy("i").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    weights, shift = _first_state()
    cut = weights.size
    state = np.concatenate([weights.ravel(), shift.ravel()])
    for row in told:  # a few hundred rows; sums of doubles differ in their last bits between reruns
        state[row["i"]] = round(row["x"] / row["n"], 6)
    return state[:cut].reshape(weights.shape), state[cut:].reshape(shift.shape)


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a * np.log(10), b * np.log(10)) / np.log(10)


def score_tokens(owner: np.ndarray, ids: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token: owner is its part (ascending), chance[id] log10 of P."""
    return refine(owner, ids, chance[ids])


def refine(owner: np.ndarray, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token after its text's own words; p is log10 of its P."""
    first = np.searchsorted(owner, owner, side="left")
    before = np.arange(len(ids)) - first
    m = pd.Series(ids).groupby(owner * (ids.max(initial=0) + 1) + ids).cumcount().to_numpy()
    worth = np.where(m > 0, np.log10(np.maximum(m, 1) + OWN * 10.0 ** p), np.log10(OWN) + p)
    return worth - np.log10(before + OWN)


def _score_block(parts: pa.Table, shared: pa.Table, model, n: int, v: int, once: int) -> pa.Table:
    """Rows (row, doc_id, held, n_tokens, n_known, n_bytes, base, score) of the block's parts."""
    words, ids, tokens = _numbered(parts.column("part").to_pylist())
    held = np.array(parts.column("held").to_pylist())
    owner = np.repeat(np.arange(len(tokens)), tokens)
    count = np.bincount(ids[~held[owner]], minlength=len(words))
    known_here = pc.index_in(shared.column("word").combine_chunks().cast(pa.binary()), value_set=words)
    count[known_here.to_numpy(zero_copy_only=False).astype(np.int64)] = shared.column("n").to_numpy()
    bits = online(words, model[0], ids, tokens, *model[1:])[0]
    known = (n - once) / (n + 1)
    with np.errstate(divide="ignore"):
        chance = _log_sum(np.log10(known * count / max(n, 1))[ids], np.log10(1 - known) + bits)
    size = pc.binary_length(words).to_numpy() + 1
    base = np.log10((count + BASE) / (n + BASE * (v + 1)))
    total = lambda x: np.bincount(owner, weights=x, minlength=len(tokens))
    return pa.table({"row": parts.column("row"), "doc_id": parts.column("doc_id"), "held": parts.column("held"),
                     "n_tokens": pa.array(tokens), "n_known": pa.array(total((count > 0)[ids]).astype(np.int64)),
                     "n_bytes": pa.array(total(size[ids]).astype(np.int64)), "base": pa.array(total(base[ids])),
                     "score": pa.array(total(refine(owner, ids, chance)))})


def score_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and
    the bytes scored (n_bytes) and what a byte costs (bits_per_byte)."""
    spark = docs.sparkSession
    parts = blocks(docs)
    by_word = Window.partitionBy("word").orderBy("block")
    whole = by_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = cut_lineage(
        parts.select("block", "held", "part").mapInArrow(_count_words, "block long, word binary, n long")
        .select("block", "word", F.sum("n").over(whole).alias("n"), F.count(F.lit(1)).over(whole).alias("places"),
                F.row_number().over(by_word).alias("place")), "bits-found")
    words = found.where("place = 1").select("word", "n")
    trained = words.where("n > 0")
    n, v, once = trained.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("n") == 1)).first()
    hashed = spark.sparkContext.broadcast(hashed_predictors(trained))
    weights, shift = mixer(parts, hashed)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_block(left, right, (hashed.value, weights, shift), n, v, once)

    shared = found.where("places > 1").select("block", "word", "n")
    kind = docs.schema["doc_id"].dataType.simpleString()
    told = parts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        score, f"row long, doc_id {kind}, held boolean, n_tokens long, n_known long, n_bytes long, base double, score double")
    return (told.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"),
        F.sum("score").alias("score"), F.sum("n_bytes").alias("n_bytes"))
        .withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).drop("row"))
