"""Masked pseudo-likelihood: each token of a text predicted from the tokens on both sides of it.

A small network reads the SIDE tokens before and after a place (an embedding for each token and offset, summed, tanh) and
gives the token's probability in STEPS steps, each a choice among the classes of the one before; the last are the tokens. A
document's score is the sum of the log probabilities of all its tokens, each masked in turn.

Vocabulary: exact counts of all tokens of all documents; all tokens above a count have ids of their own. The count is the
lowest that leaves at most GROWTH times the square root of the number of all tokens, so the vocabulary grows with the text
and the network stays small beside it. The rest share HASHED ids by their first two bytes, and their probability is that of
the shared id times that of their spelling, a model of bytes (context of two, Witten-Bell) of the rest's full counts, so that
what the network gives for an id is shared out over all strings of it. (Strings that have ids of their own get a little of it.)

Each text is cut into tokens twice: to count them, and to write its ids, which training and scoring read.

Training: every place of every document is a target in each of ROUNDS rounds. Documents are dealt by a hash of the row into
shares of about equal numbers of places; the number of shares follows from the corpus and the network, not from the cluster or the
layout of the input. A share trains a copy of the network by numpy; copies are averaged in Spark, each row of parameters by the
number of places that it took part in, in fixed-point numbers so that the order of addition does not matter.

Defined cases: a null text, or one without tokens, has no tokens and score 0; repeated rows and null ids are rows of their
own; an empty table gives an empty result; other columns are ignored. A very long text is read in runs of BATCH places.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import written
from .common import column, map_batches, text_hash
from .ordered import map_rows

#: There are classes ** STEPS ids, of which HASHED are shared by tokens without an id of their own.
GROWTH, HASHED, HIDDEN, SIDE, STEPS = 2, 64, 16, 2, 3
ROUNDS, BATCH, RATE, SEED = 2, 16384, 0.25, 11
#: A share of the training has about so many places for each number of the network, whose gains it sends on.
PLACES_A_NUMBER = 4
#: Steps that a share makes in a round, at least: where it has few places, its batches are smaller, down to LEAST_BATCH places.
LEAST_STEPS, LEAST_BATCH = 64, 64
#: Places of a class, in one batch, from which their line is just as long as they are.
ALONE = 1024
#: Numbers that a step changes at a time, so that they stay near the processor.
STEP_NUMBERS = 1 << 15
#: Cells whose products are added at a time.
PIECE = 512
#: Numbers of a row of the averaging.
BLOCK = 4096
_MARKS = [bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and c != 95]
_WORD, _SPACE, _MARK = 0, 1, 2
_SPACES = bytes(c for c in range(256) if bytes([c]).isspace())
#: What each byte is to tokens().
_KINDS = bytes(_MARK if bytes([c]) in _MARKS else _SPACE if c in _SPACES else _WORD for c in range(256))
_SCALE = 1 << 20
#: Symbols beside the 256 bytes.
END, START = 256, 257
OFFSETS = tuple(o for o in range(-SIDE, SIDE + 1) if o)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words between white space; each ASCII mark is a token of its own."""
    if not text:
        return []
    data = text.lower().encode("utf-8", "surrogatepass")
    for mark in _MARKS:
        data = data.replace(mark, b" " + mark + b" ")
    return data.split()


def tokens_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What tokens() makes of all texts: the different tokens, each token's number among them, and how many each text has."""
    data = [t.lower().encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    row = b"\n".join([*data, b""])
    kind = np.frombuffer(row.translate(_KINDS), np.uint8)
    kept = kind != _SPACE
    # A token begins where the byte before it belongs to no word, and at each mark.
    begins = kind != _WORD
    begins[1:] |= begins[:-1].copy()
    begins[:1] = True
    begins &= kept
    row = row.translate(None, _SPACES)
    first = np.append(np.flatnonzero(begins[kept]), len(row)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first), pa.py_buffer(row)]).dictionary_encode()
    number = np.asarray(coded.indices)
    somewhere = np.empty(len(coded.dictionary), np.intp)
    somewhere[number] = np.arange(len(number))
    words = [row[a:b] for a, b in zip(first[somewhere].tolist(), first[somewhere + 1].tolist())]
    return words, number, np.diff(np.searchsorted(np.flatnonzero(begins), ends), prepend=0)


def count_tokens(texts: DataFrame) -> DataFrame:
    def run(cols: dict[str, list]) -> dict[str, list]:
        words, number, _ = tokens_of(cols["text"])
        return {"token": words, "n": np.bincount(number, minlength=len(words)).tolist()}

    return map_batches(texts.select("text"), run, "token binary, n bigint", heavy="text").groupBy("token").agg(F.sum("n").alias("n"))


def _bucket(first: int, second: int, hashed: int) -> int:
    """The shared id of tokens that begin with two bytes; END for the second of a single byte."""
    return zlib.crc32(bytes((first,)) if second == END else bytes((first, second))) % hashed


class Spelling:
    """Log probability of a token's bytes, given its shared id."""

    def __init__(self, grams: Iterable[tuple[int, int]] = (), hashed: int = HASHED):
        """Counts of grams: START, a token's first two symbols; or three symbols in a row. END ends a token."""
        grams = list(grams)
        gram, n = np.array([g for g, _ in grams], np.int64), np.array([k for _, k in grams], np.float64)
        first = gram >> 18 == START
        pair = np.ones((256, END + 1)) * 0.01
        np.add.at(pair, (gram[first] >> 9 & 511, gram[first] & 511), n[first])
        bucket = np.array([[_bucket(x, y, hashed) for y in range(END + 1)] for x in range(256)])
        self.pair = np.log(pair / np.bincount(bucket.ravel(), pair.ravel(), hashed)[bucket])
        # Bytes are numbered as far as they occur; all others share the last number.
        a, b, c, n = gram[~first] >> 18, gram[~first] >> 9 & 511, gram[~first] & 511, n[~first]
        used = np.unique(np.concatenate([a, b, c, np.array([END])]))
        self.code = np.full(END + 1, len(used))
        self.code[used] = np.arange(len(used))
        k = len(used) + 1
        # Of each order the shorter context's probabilities, repeated for every symbol before it, and the counts.
        p = np.full((1, k), 1.0 / (END + 1))
        for order, context in enumerate((np.zeros(len(a), np.int64), self.code[b], self.code[a] * k + self.code[b])):
            p = np.tile(p, (k if order else 1, 1))
            counts = np.zeros((k ** order, k))
            np.add.at(counts, (context, self.code[c]), n)
            kinds = np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
            p = (counts + kinds * p) / (counts.sum(axis=1, keepdims=True) + kinds)
        self.next = np.log(p).astype(np.float32)

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        size = np.array([len(w) + 1 for w in words])
        row = np.zeros(int(size.sum()), np.int64)
        ends = np.cumsum(size) - 1
        inside = np.ones(len(row), bool)
        inside[ends] = False
        row[inside], row[ends] = np.frombuffer(b"".join(words), np.uint8), END
        starts = ends - size + 1
        coded = self.code[row]
        logs = np.zeros(len(row))
        logs[2:] = self.next[coded[:-2] * self.next.shape[1] + coded[1:-1], coded[2:]]
        logs[starts + 1] = self.pair[row[starts], row[starts + 1]]
        logs[starts] = 0
        return np.add.reduceat(logs, starts)


def spelling_counts(counts: DataFrame) -> DataFrame:
    """Counts of the grams of all tokens of a table of counts."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        seen: Counter = Counter()
        for w, n in zip(cols["token"], cols["n"]):
            w = [*w, END]
            seen[START << 18 | w[0] << 9 | w[1]] += n
            for i in range(2, len(w)):
                seen[w[i - 2] << 18 | w[i - 1] << 9 | w[i]] += n
        return {"gram": list(seen), "n": list(seen.values())}

    return map_batches(counts, run, "gram bigint, n bigint", heavy="token").groupBy("gram").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Id of each token: its own if it is frequent, else one that it shares with others of its first two bytes."""

    def __init__(self, frequent: list[bytes], classes: int, hashed: int = HASHED, spelling: Spelling | None = None):
        #: The last id stands for places before and after the text.
        self.size, self.pad, self.hashed = classes ** STEPS, classes ** STEPS, hashed
        self.classes, self.spelling = classes, spelling or Spelling(hashed=hashed)
        self.ids = {w: i for i, w in enumerate(frequent[:self.size - hashed])}

    def encode(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int32, len(words))
        rare = np.nonzero(out < 0)[0]
        if len(rare):
            crc = np.fromiter((zlib.crc32(words[i][:2]) for i in rare.tolist()), np.int64, len(rare))
            out[rare] = self.size - self.hashed + crc % self.hashed
        return out

    def spelled(self, words: list[bytes], ids: np.ndarray) -> np.ndarray:
        """Log probability of each token given its id: 0 if the id is its own."""
        out = np.zeros(len(words))
        rare = np.nonzero(ids >= self.size - self.hashed)[0]
        out[rare] = self.spelling.log_probabilities([words[i] for i in rare.tolist()])
        return out


def vocabulary(texts: DataFrame, classes: int | None = None, hashed: int = HASHED) -> Vocabulary:
    """`classes`: None, and their number follows from that of all tokens."""
    counts = written(count_tokens(texts), "token-counts")
    # How many tokens occur how often: few rows, however many tokens there are.
    often = sorted(((r.n, r.tokens) for r in counts.groupBy("n").agg(F.count("*").alias("tokens")).collect()), reverse=True)
    room = classes ** STEPS - hashed if classes else int(GROWTH * sum(n * k for n, k in often) ** 0.5)
    least, held = often[0][0] + 1 if often else 1, 0
    for n, k in often:
        if held + k > room:
            break
        least, held = n, held + k
    top = sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.token))
    grams = [tuple(r) for r in spelling_counts(counts.filter(F.col("n") < least)).collect()]
    classes = classes or next(c for c in range(2, held + hashed + 3) if c ** STEPS >= held + hashed)
    return Vocabulary([bytes(r.token) for r in top], classes, hashed, Spelling(grams, hashed))


class Network:
    """Parameters: embeddings (id, offset, hidden), bias, and for each step the weights of its choices, by class so far; their last row
    are the biases."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden, self.size = classes, hidden, classes ** STEPS
        self.shapes = [(self.size + 1, len(OFFSETS), hidden), (hidden,), *((classes ** step, hidden + 1, classes) for step in range(STEPS))]
        self.p = [np.zeros(s, np.float32) for s in self.shapes]
        self.p[0][:] = rng.normal(0, 0.1, self.shapes[0])
        for w in self.p[2:]:
            w[:, :hidden] = rng.normal(0, 0.1, (len(w), hidden, classes))

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.p])

    def with_vector(self, x: np.ndarray) -> Network:
        at, out = 0, []
        for shape in self.shapes:
            n = int(np.prod(shape))
            out.append(x[at:at + n].reshape(shape).astype(np.float32))
            at += n
        self.p = out
        return self

    def by_id(self, row: np.ndarray) -> np.ndarray:
        """Places of a row in the order of their ids."""
        order = np.argsort((row & 0xFFFF).astype(np.uint16), kind="stable")
        if self.size > 0xFFFF:
            order = order[np.argsort((row >> 16)[order].astype(np.uint16), kind="stable")]
        return order

    def hidden_of(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each place, with a one behind it for the biases; the last row, zeros, stands for no place."""
        e, b = self.p[:2]
        e, first, n = e.reshape(-1, self.hidden), row.astype(np.intp) * len(OFFSETS), len(row) - 2 * SIDE
        total = e.take(first[:n], axis=0)
        for k in range(1, len(OFFSETS)):
            first += 1
            total += e.take(first[SIDE + OFFSETS[k]:][:n], axis=0)
        total += b
        h = np.ones((len(at) + 1, self.hidden + 1), total.dtype)
        h[:-1, :-1] = np.tanh(total, out=total).take(at - SIDE, axis=0)
        h[-1] = 0
        return h

    def choices(self, target: np.ndarray) -> Iterator[tuple[int, Lines, np.ndarray]]:
        """For sorted targets, each step's choices, from the last: the places in lines by the classes so far, and the ids chosen."""
        kinds, starts = distinct(target)
        for step in reversed(range(STEPS)):
            so_far = kinds // self.classes
            chosen = np.repeat(kinds - so_far * self.classes, np.diff(starts, append=len(target)))
            kinds, new = distinct(so_far)
            starts = starts[new]
            yield step, Lines(kinds, starts, len(target), ALONE), chosen

    def exponents(self, h: np.ndarray, w: np.ndarray, lines: Lines) -> np.ndarray:
        """Exponential of each choice's number: a line for each cell, of which the cells of no place are not to be used."""
        z = np.empty((lines.cells, self.classes), h.dtype)
        for kinds, cells, shape in lines.parts:
            np.matmul(h[cells].reshape(*shape, -1), w[kinds], out=z[cells].reshape(*shape, -1))
        return np.exp(z, out=z)

    def log_probabilities(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability (nats) of the ids of a row at some places."""
        out = np.zeros(len(row))
        wanted = np.zeros(len(row), bool)
        wanted[at] = True
        order = self.by_id(row)
        order = order[wanted[order]]
        h = self.hidden_of(row, order)
        logs = np.zeros(len(order))
        for step, lines, chosen in self.choices(row[order]):
            z = self.exponents(lines.dealt(h), self.p[2 + step].take(lines.kinds, axis=0), lines)
            of_all = z @ np.ones(self.classes, z.dtype)
            logs += np.log(z.reshape(-1).take(lines.cell * self.classes + chosen) / of_all.take(lines.cell))
        out[order] = logs
        return out[at]

    def train(self, row: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> np.ndarray:
        """One step of Adagrad on the places of a row; `squares` are the sums of squared gradients so far. How many places each
        row of parameters took part in."""
        self.step(row, at, squares)
        return self.taken(row, at)

    def step(self, row: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> None:
        n, unit = len(at), len(at) ** -0.5
        wanted = np.zeros(len(row), bool)
        wanted[at] = True
        every = self.by_id(row)
        order = every[wanted[every]]
        h = self.hidden_of(row, order)
        back = np.zeros_like(h[:-1])
        for step, lines, chosen in self.choices(row[order]):
            w, x = self.p[2 + step].take(lines.kinds, axis=0), lines.dealt(h)
            g = self.exponents(x, w, lines)
            of_all = g @ np.ones(self.classes, g.dtype)
            g.reshape(-1)[lines.cell * self.classes + chosen] -= of_all.take(lines.cell)
            g *= (unit / of_all)[:, None]
            to_h, to_w = np.empty_like(x), np.empty_like(w)
            for kinds, cells, shape in lines.parts:
                each = g[cells].reshape(*shape, -1)
                np.matmul(each, w[kinds].transpose(0, 2, 1), out=to_h[cells].reshape(*shape, -1))
                _products(x[cells].reshape(*shape, -1), each, to_w[kinds])
            back += to_h.take(lines.cell, axis=0)
            _step(self.p[2 + step], squares[2 + step], lines.kinds, to_w)
        h *= h
        back *= 1 - h[:-1]
        back = back[:, :-1]
        # What each place of the row was for those around it: the gradients of the places from SIDE before it to SIDE behind it
        # stand in a row, of which that of the place an offset before is taken. Behind the row stands a place without any.
        width = 2 * SIDE + 1
        at_place = np.zeros((len(row) + 2 * SIDE + 1, self.hidden), back.dtype)
        at_place[order + SIDE] = back
        at_place[len(row):] = 0
        around = np.lib.stride_tricks.sliding_window_view(at_place.ravel(), width * self.hidden)[::self.hidden]
        lines = Lines(*distinct(row[every]), len(every))
        total = np.empty((len(lines.kinds), len(OFFSETS), self.hidden), back.dtype)
        of = np.append(every, len(row))[lines.place]
        for kinds, cells, shape in lines.parts:
            part = around[of[cells]].reshape(*shape, -1)
            while part.shape[1] > 1:
                half = part.shape[1] // 2
                part = part[:, :half] + part[:, half:]
            part = part.reshape(-1, width, self.hidden)
            total[kinds, :SIDE], total[kinds, SIDE:] = part[:, :SIDE:-1], part[:, SIDE - 1::-1]
        _step(self.p[0], squares[0], lines.kinds, total)
        _step(self.p[1][None], squares[1][None], np.zeros(1, np.intp), back.sum(axis=0, keepdims=True))

    def taken(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the places each row of parameters takes part in."""
        seen = np.stack([np.bincount(row[at + o], minlength=self.size + 1) for o in OFFSETS], axis=1)
        chosen = np.bincount(row[at], minlength=self.size).reshape(-1, self.classes).sum(axis=1)
        by_step = [chosen]
        while len(by_step) < STEPS:
            by_step.insert(0, by_step[0].reshape(-1, self.classes).sum(axis=1))
        return np.concatenate([seen.ravel(), [len(at)], *by_step])

    def spread(self, taken: np.ndarray) -> np.ndarray:
        """The numbers that taken() returns, for each number of the vector."""
        v = len(OFFSETS) * (self.size + 1)
        return np.concatenate([np.repeat(taken[:v], self.hidden), np.full(self.hidden, taken[v]), np.repeat(taken[v + 1:], (self.hidden + 1) * self.classes)])

    def lines(self) -> int:
        """How many numbers taken() returns."""
        return len(OFFSETS) * (self.size + 1) + 1 + sum(self.classes ** s for s in range(STEPS))


def distinct(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a sorted row, and where each begins."""
    starts = np.append(0, np.flatnonzero(row[1:] != row[:-1]) + 1)
    return row[starts], starts


class Lines:
    """Places in the order of their kinds, dealt to cells: a line of cells for each kind, those of about as many places together.

    A line is as long as the next power of two; that of a kind of `alone` places and more is just as long as they are.
    """

    def __init__(self, kinds: np.ndarray, starts: np.ndarray, n: int, alone: int | None = None):
        counts = np.diff(starts, append=n)
        width = 1 << np.ceil(np.log2(counts)).astype(np.intp)
        if alone is not None:
            width = np.where(counts >= alone, counts, width)
        order = np.argsort(width, kind="stable")
        ends = np.cumsum(width[order])
        first = np.empty(len(order), np.intp)
        first[order] = ends - width[order]
        #: Kinds as their lines stand, number of cells, each place's cell, each cell's place (n: none).
        self.kinds, self.cells = kinds[order].astype(np.intp), int(ends[-1])
        self.cell = np.repeat(first - starts, counts) + np.arange(n)
        self.place = np.full(self.cells, n, np.intp)
        self.place[self.cell] = np.arange(n)
        #: Lines of one length: which kinds, which cells, number of lines and their length.
        self.parts, at, cells = [], 0, 0
        for w, k in sorted(Counter(width.tolist()).items()):
            self.parts.append((slice(at, at + k), slice(cells, cells + k * w), (k, w)))
            at, cells = at + k, cells + k * w

    def dealt(self, rows: np.ndarray) -> np.ndarray:
        """What each cell's place has; `rows` ends with what a cell of no place has."""
        return rows[:-1] if self.cells == len(self.cell) == len(rows) - 1 and len(self.kinds) == 1 else rows.take(self.place, axis=0)


def _products(x: np.ndarray, g: np.ndarray, out: np.ndarray) -> None:
    """For each line, the sum over its cells of all products of `x` and `g`. Long lines go in pieces, which suit the processor better."""
    k, w = x.shape[:2]
    if w == 1:
        np.multiply(x.transpose(0, 2, 1), g, out=out)
    elif w < 2 * PIECE:
        np.matmul(x.transpose(0, 2, 1), g, out=out)
    else:
        whole = w // PIECE * PIECE
        a, b = (y[:, :whole].reshape(k, -1, PIECE, y.shape[2]) for y in (x, g))
        np.sum(a.swapaxes(2, 3) @ b, axis=1, out=out)
        if whole < w:
            out += x[:, whole:].transpose(0, 2, 1) @ g[:, whole:]


def _step(p: np.ndarray, squares: np.ndarray, at: np.ndarray, g: np.ndarray) -> None:
    """`g`, which is used up: gradients of the rows `at`, each of which is named once."""
    rows = max(1, STEP_NUMBERS // max(1, g[0].size))
    for i in range(0, len(at), rows):
        some, x = at[i:i + rows], g[i:i + rows]
        q = x * x
        q += squares.take(some, axis=0)
        squares[some] = q
        np.sqrt(q, out=q)
        q += 1e-3
        x /= q
        x *= -RATE
        x += p.take(some, axis=0)
        p[some] = x


def encode(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (32-bit numbers), and the log probability of the spellings of its tokens without an id of their own."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), column(text_col).alias("text"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        words = shared.value
        different, number, n = tokens_of(cols.pop("text"))
        ids = words.encode(different)
        spelled = np.concatenate([[0.0], np.cumsum(words.spelled(different, ids).take(number))])
        ids, ends, n = ids.take(number), np.cumsum(n).tolist(), n.tolist()
        return cols | {"n_tokens": n, "spelled": [float(spelled[e] - spelled[e - k]) for e, k in zip(ends, n)],
                       "ids": [ids[e - k:e].astype("<i4").tobytes() for e, k in zip(ends, n)]}

    return map_batches(texts, run, f"doc_id {dict(texts.dtypes)['doc_id']}, thash bigint, n_tokens bigint, spelled double, ids binary", heavy="text")


def laid_out(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one row with SIDE pads before, between and after them, and the place of each token in it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.arange(sizes.sum()) + SIDE * (np.repeat(np.arange(len(texts)), sizes) + 1)
    row = np.full(int(sizes.sum()) + SIDE * (len(texts) + 1), pad, np.int32)
    if len(at):
        row[at] = np.concatenate(texts)
    return row, at


def runs(row: np.ndarray, at: np.ndarray, places: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of a row with about so many places each, and the places in them; what stands around them is in the piece too."""
    for i in range(0, len(at), places):
        part = at[i:i + places]
        first = part[0] - SIDE
        yield row[first:part[-1] + SIDE + 1], part - first


def train_round(coded: DataFrame, start: Network, shares: int, batch: int = BATCH) -> np.ndarray:
    """Average of the networks that the shares make from `start`, each row weighted by the places it took part in."""
    classes, hidden, vector = start.classes, start.hidden, start.vector()
    shared = coded.sparkSession.sparkContext.broadcast(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        net = Network(classes, hidden).with_vector(shared.value)
        squares, taken = [np.zeros_like(p) for p in net.p], np.zeros(net.lines(), np.int64)
        held, count = [], 0

        def learn() -> None:
            nonlocal taken
            row, at = laid_out(held, net.size)
            for part, places in runs(row, at, -(-len(at) // -(-len(at) // batch))):
                net.step(part, places, squares)
            taken += net.taken(row, at)

        for b in batches:
            for ids in b.column(0).to_pylist():
                held.append(np.frombuffer(ids, "<i4"))
                count += len(held[-1])
                if count >= batch:
                    learn()
                    held, count = [], 0
        if count:
            learn()
        if taken.any():
            gain = np.round((net.vector().astype(np.float64) - shared.value) * _SCALE).astype(np.int64)
            gain *= net.spread(taken)
            for first, numbers in ((0, gain), (len(gain), taken)):
                for at in range(0, len(numbers), BLOCK):
                    if (part := numbers[at:at + BLOCK]).any():
                        yield first + at, part.tobytes()

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in group.column("numbers").to_pylist())
        return pa.table({"first": group.column("first").slice(0, 1), "numbers": pa.array([total.tobytes()], pa.binary())})

    # A share is a partition, whatever number of partitions the session has: each sends as much as the network has numbers.
    share = F.pmod(F.col("dealt"), F.lit(shares)).cast("int")
    dealt = coded.filter("n_tokens > 0").repartitionById(shares, share).sortWithinPartitions("dealt").select("ids")
    made = map_rows(dealt, run, "first bigint, numbers binary", rows=64).groupBy("first").applyInArrow(added, "first bigint, numbers binary")
    total = np.zeros(len(vector) + start.lines(), np.int64)
    for r in made.toLocalIterator():
        part = np.frombuffer(r.numbers, np.int64)
        total[r["first"]:r["first"] + len(part)] = part
    return vector + total[:len(vector)] / np.maximum(start.spread(total[len(vector):]), 1) / _SCALE


def train(coded: DataFrame, words: Vocabulary, rounds: int = ROUNDS, hidden: int = HIDDEN, batch: int = BATCH) -> Network:
    """`coded`: what encode() makes, written."""
    net = Network(words.classes, hidden)
    places = coded.agg(F.sum("n_tokens")).first()[0] or 0
    shares = max(1, -(-places // (PLACES_A_NUMBER * len(net.vector()))))
    dealt = coded.withColumn("dealt", F.xxhash64("thash", "doc_id"))
    batch = min(batch, max(LEAST_BATCH, places // shares // LEAST_STEPS))
    for _ in range(rounds):
        net = net.with_vector(train_round(dealt, net, shares, batch))
    return net


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rounds: int = ROUNDS, classes: int | None = None, hashed: int = HASHED,
        hidden: int = HIDDEN, batch: int = BATCH) -> tuple[Vocabulary, Network, DataFrame]:
    """The vocabulary, the trained network, and the documents' ids."""
    words = vocabulary(docs.select(column(text_col).alias("text")), classes, hashed)
    coded = written(encode(docs, words, id_col, text_col), "token-ids")
    return words, train(coded, words, rounds, hidden, batch), coded


def score(coded: DataFrame, net: Network) -> DataFrame:
    """For each document of encode(): n_tokens, pll (sum of log probabilities) and pll_per_token."""
    shared = coded.sparkSession.sparkContext.broadcast(net)

    def run(cols: dict[str, list]) -> dict[str, list]:
        net, n = shared.value, cols["n_tokens"]
        row, at = laid_out([np.frombuffer(x, "<i4") for x in cols.pop("ids")], net.size)
        logs = np.concatenate([np.zeros(0), *(net.log_probabilities(*part) for part in runs(row, at, BATCH))])
        sums = [s + (float(logs[e - k:e].sum()) if k else 0.0) for s, k, e in zip(cols.pop("spelled"), n, np.cumsum(n).tolist())]
        return cols | {"pll": sums, "pll_per_token": [s / k if k else 0.0 for s, k in zip(sums, n)]}

    kind = dict(coded.dtypes)["doc_id"]
    return map_batches(coded.select("doc_id", "thash", "n_tokens", "spelled", "ids"), run,
                       f"doc_id {kind}, thash bigint, n_tokens bigint, pll double, pll_per_token double", heavy="ids")
