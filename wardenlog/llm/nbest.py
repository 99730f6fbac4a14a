"""Encoding with a piece vocabulary: the N best segmentations of a text, exactly, and decoding back.

A segmentation's score is the sum of its pieces' scores. Forward Viterbi gives the best score of reaching each position, and
is then the exact heuristic of a backward A* search, which so expands only prefixes of the N best. Two facts keep this short
without changing a result. Words (a run of spaces with what follows up to the next space) never share a piece, which is
verified on the vocabulary; so Viterbi runs once for each distinct word of a batch, for all of them together by array
operations, and gives the word's gap between its best and second-best path as well. And a segmentation among the N best of a
text can differ from the best one only in the N - 1 words of smallest gap; all other words are a single arc of the lattice.

Scores come from the model file, which is never trained here. Merge-ranked models carry ranks; these are read as
log-probabilities under Zipf's law. Characters without a piece, among them the space mark itself, fall back to bytes, so
decoding gives the text back.
Ties go to fewer pieces, then to the longer last piece of a word, then to the earlier word.

Defined cases: a null or empty text has no pieces and one segmentation of score zero; repeated rows and null ids are rows of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .common import column, map_batches, text_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
#: Words whose results a task keeps between batches.
KEPT_WORDS = 400_000
#: Pairs of positions, over all words of a batch, whose scores are held at once.
CELLS = 2_000_000
#: Cost that each piece has besides its own, so that ties go to fewer pieces; far below any difference of scores.
_PIECE_COST = 1e-9
#: Of scores in the search of a single word.
_UNIT = 1e-12
#: Characters of a word up to which its arcs are kept between the two passes.
HELD_ARCS = 1000


class Pieces:
    """Vocabulary of a piece model with scores, as arrays for lookups of many substrings at once."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        usual = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        raw = np.array([model.get_score(i) for i in usual])
        # Ranks are whole numbers from zero down to the vocabulary's size; log-probabilities are not.
        ranks = len(raw) and raw.min() < -1000
        harmonic = math.log(len(usual)) + 0.5772156649
        score = -np.log(1.0 - raw.clip(None, 0) + 1.0) - math.log(harmonic) if ranks else raw
        self.ids = {self.pieces[i].replace(SPACE, " "): i for i in usual}
        self.data = [bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.score = dict(zip(usual, score.tolist()))
        #: A byte costs more than any piece, so that bytes stand only where pieces cannot.
        self.byte_score = (min(score.tolist(), default=0.0) - 10.0)
        self.longest = max((len(p) for p in self.ids), default=1)
        #: Of each piece its score in units, and its ids as an arc has them.
        self.arc_of = {p: (round((self.score[i] - _PIECE_COST) / _UNIT), (i,)) for p, i in self.ids.items()}
        # Control characters without a piece cut words as well.
        used = {c for p in self.ids for c in p}
        cuts = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in used)
        self.word = re.compile(f"[{cuts}]| +[^ {cuts}]*|[^ {cuts}]+")
        self.by_word = not any(re.search("[^ ] ", p) for p in self.ids)

    def words(self, text: str) -> list[str]:
        """The text's words; joined they are the text with a space put in front."""
        if not text:
            return []
        return self.word.findall(" " + text) if self.by_word else [" " + text]

    def arcs(self, word: str, end: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """Arcs that end at a position: start, score, ids; the byte fallback where the last character has no piece."""
        out = []
        for start in range(max(0, end - self.longest), end):
            if (i := self.ids.get(word[start:end])) is not None:
                out.append((start, self.score[i] - _PIECE_COST, (i,)))
        if not out or out[-1][0] != end - 1:
            data = word[end - 1].encode()
            ids = tuple(self.bytes.get(b, self.unknown) for b in data)
            out.append((end - 1, len(data) * (self.byte_score - _PIECE_COST), ids))
        return out

    def unit_arcs(self, word: str, end: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """As arcs(), with scores in units of _UNIT: whole numbers, so that ties are ties."""
        get, out = self.arc_of.get, []
        for start in range(max(0, end - self.longest), end):
            if (found := get(word[start:end])) is not None:
                out.append((start, *found))
        if not out or out[-1][0] != end - 1:
            out += [(start, round(score / _UNIT), ids) for start, score, ids in self.arcs(word, end) if start == end - 1]
        return out

    def paths(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a word, best first: backward A* from the word's end, forward scores as heuristic.

        A position is expanded n times at most, as no more of its ways to the end can be among the n best; of equal entries the one
        nearest the start comes first. So the work is in proportion to the word's length, however many ties it has."""
        size = len(word)
        best, held = [0] * (size + 1), []
        for end in range(1, size + 1):
            arcs = self.unit_arcs(word, end)
            top = None
            for start, score, _ in arcs:
                total = best[start] + score
                if top is None or total > top:
                    top = total
            best[end] = top
            if size <= HELD_ARCS:  # arcs of longer words are found again
                held.append(arcs)
        # An entry: cost, position, number; by that number the score behind it, the ids of its arc, and the entry it came from.
        heap, behind, taken, came = [(-best[size], size, 0)], [0], [()], [0]
        out, expanded = [], [0] * (size + 1)
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(out) < n:
            negated, at, entry = pop(heap)
            if at == 0:
                ids: list[int] = []
                while entry:
                    ids.extend(taken[entry])
                    entry = came[entry]
                out.append((-negated * _UNIT, tuple(ids)))
                continue
            if expanded[at] == n:
                continue
            expanded[at] += 1
            so_far = behind[entry]
            for start, score, arc in held[at - 1] if held else self.unit_arcs(word, at):
                if expanded[start] < n:
                    total = so_far + score
                    push(heap, (-(best[start] + total), start, len(behind)))
                    behind.append(total)
                    taken.append(arc)
                    came.append(entry)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids; inverse of encoding."""
        return b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace")[1:]


class Encoder:
    """Best path and gap of many words at once, and from these the N best segmentations of texts."""

    def __init__(self, pieces: Pieces, n_best: int = N_BEST):
        self.p, self.n = pieces, n_best
        self.forget()
        chars = sorted({c for p in pieces.ids for c in p})
        self.codes = np.zeros(0x110001, np.int64)
        for i, c in enumerate(chars, 1):
            self.codes[ord(c)] = i
        # Pieces as paths of a trie: node * alphabet + character -> node, in one sorted array.
        self.width = len(chars) + 1
        nodes, edges, ids = {"": 0}, [], [-1]
        for piece, i in pieces.ids.items():
            for k in range(1, len(piece) + 1):
                head = piece[:k]
                if head not in nodes:
                    nodes[head] = len(nodes)
                    ids.append(-1)
                    edges.append((nodes[head[:-1]] * self.width + int(self.codes[ord(head[-1])]), nodes[head]))
            ids[nodes[piece]] = i
        edges.sort()
        self.edge, self.to = np.array([e for e, _ in edges]), np.array([t for _, t in edges])
        size = 1 << (2 * len(edges) - 1).bit_length()
        self.hashed, self.mask = np.full(size, -1, np.int64), size - 1
        place = self.hash(self.edge)
        left = np.arange(len(edges))
        while len(left):  # open addressing; a round places what finds its slot free
            free = self.hashed[place[left]] < 0
            slot, first = np.unique(place[left[free]], return_index=True)
            self.hashed[slot] = left[free][first]
            left = left[self.hashed[place[left]] != left]
            place[left] = place[left] + 1 & self.mask
        self.node_id = np.array(ids)
        self.node_score = np.array([pieces.score.get(i, -np.inf) for i in ids]) - _PIECE_COST

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys * 0x9E3779B97F4A7C1 >> 20) & self.mask

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next trie node of each, -1 where there is none."""
        keys = nodes * self.width + codes
        place, out = self.hash(keys), np.full(len(keys), -1, np.int64)
        open_ = np.nonzero(codes > 0)[0]
        while len(open_):
            found = self.hashed[place[open_]]
            open_, found = open_[found >= 0], found[found >= 0]
            same = self.edge[found] == keys[open_]
            out[open_[same]] = self.to[found[same]]
            open_ = open_[~same]
            place[open_] = place[open_] + 1 & self.mask
        return out

    def forget(self) -> None:
        """Start without words: number of each word, and by that number best score, gap, and place of its ids in `flat`."""
        self.number: dict[str, int] = {}
        self.value, self.gap = np.zeros(0), np.zeros(0)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.options: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def learn(self, words: list[str]) -> None:
        """Viterbi over all these words together, those of one length at a time."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        found = []
        for length, same in by_length.items():
            if length > 48:  # rare: long runs without a space
                found += [self.one(w) for w in same]
                continue
            step = max(1, min(8192, CELLS // (length * (length + 1))))
            for i in range(0, len(same), step):
                found.append(self.batch(length, same[i:i + step]))
        if not found:
            return
        names = [w for f in found for w in f[0]]
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names))))
        count = np.concatenate([f[3] for f in found])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count]).astype(np.int64)
        self.count = np.concatenate([self.count, count]).astype(np.int64)
        self.value = np.concatenate([self.value, *[f[1] for f in found]])
        self.gap = np.concatenate([self.gap, *[f[2] for f in found]])
        self.flat = np.concatenate([self.flat, *[f[4] for f in found]])

    def one(self, word: str) -> tuple[list[str], list[float], list[float], list[int], list[int]]:
        two = self.p.paths(word, 2)
        gap = two[0][0] - two[1][0] if len(two) > 1 else math.inf
        return [word], np.array([two[0][0]]), np.array([gap]), np.array([len(two[0][1])]), np.array(two[0][1], np.int32)

    def batch(self, length: int, words: list[str]) -> tuple:
        """Words, best scores, gaps, numbers of ids, ids."""
        n = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        codes = self.codes[points]
        size = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        # score[s][e]: of the piece from s to e, for each word; the byte fallback where a single character has none.
        score = np.full((length, length + 1, n), -np.inf)
        ids = np.full((length, length + 1, n), -1, np.int64)
        for s in range(length):
            live, node = np.arange(n), np.zeros(n, np.int64)
            for e in range(s + 1, min(length, s + self.p.longest) + 1):
                node = self.step(node, codes[live, e - 1])
                live, node = live[node >= 0], node[node >= 0]
                if not len(live):
                    break
                score[s, e, live] = self.node_score[node]
                ids[s, e, live] = self.node_id[node]
            bare = ids[s, s + 1] < 0
            score[s, s + 1, bare] = size[bare, s] * (self.p.byte_score - _PIECE_COST)
        forward, back = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int64)
        forward[0] = 0
        for e in range(1, length + 1):
            for s in range(max(0, e - self.p.longest), e):  # of ties the longest last piece, which begins first
                via = forward[s] + score[s, e]
                better = via > forward[e]
                forward[e][better] = via[better]
                back[e][better] = s
        behind = np.full((length + 1, n), -np.inf)
        behind[length] = 0
        for s in range(length - 1, -1, -1):
            for e in range(s + 1, min(length, s + self.p.longest) + 1):
                np.maximum(behind[s], score[s, e] + behind[e], out=behind[s])
        best, rows = forward[length], np.arange(n)
        # The second-best path takes some arc that the best one does not; the best path over each arc is known.
        at, path = np.full(n, length), np.full((length, n), -2, np.int64)
        via = score
        for s in range(length):
            via[s] += forward[s] + behind
        k = length
        while (live := rows[at > 0]).size:
            k -= 1
            s = back[at[live], live]
            path[k, live] = ids[s, at[live], live]
            via[s, at[live], live] = -np.inf
            at[live] = s
        gap = best - via.max(axis=(0, 1))
        bare = (path == -1).any(axis=0)
        path = path.T
        rest = [self.one(words[i]) for i in np.nonzero(bare)[0]]
        whole = np.nonzero(~bare)[0]
        path = path[whole]
        return (
            [words[i] for i in whole] + [r[0][0] for r in rest], np.concatenate([best[whole], *[r[1] for r in rest]]),
            np.concatenate([gap[whole], *[r[2] for r in rest]]), np.concatenate([(path >= 0).sum(axis=1), *[r[3] for r in rest]]),
            np.concatenate([path[path >= 0].astype(np.int32), *[r[4] for r in rest]]))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, list[float], list[dict[int, tuple[int, ...]]]]]:
        """For each text the ids of the best segmentation, the scores of the N best, and for those after the first the ids of
        the words (by number in the text) in which they differ from it."""
        return self.encode_words([self.p.words(t or "") for t in texts])

    def encode_words(self, split: list[list[str]]) -> list[tuple[np.ndarray, list[float], list[dict[int, tuple[int, ...]]]]]:
        """As encode(), of texts that are cut into words."""
        words_here = set().union(*split)
        new = words_here - self.number.keys()
        if len(self.number) + len(new) > KEPT_WORDS:
            self.forget()
            new = words_here
        self.learn(sorted(new))
        return [self.of_text(words) for words in split]

    def of_text(self, words: list[str]) -> tuple[np.ndarray, list[float], list[dict[int, tuple[int, ...]]]]:
        at = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        place = np.repeat(self.start[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        total, gaps = float(self.value[at].sum()), self.gap[at]
        scores, others = [total], []
        m = min(self.n - 1, len(gaps))
        if m:
            # All words but the m of smallest gap are single arcs: the search needs only these.
            near = sorted(int(i) for i in self.smallest(gaps, m) if gaps[i] < math.inf)
            options = [self.best_of(words[i]) for i in near]
            loss = [[o[0][0] - x[0] for x in o] for o in options]
            first = (0,) * len(near)
            heap, seen = [(0.0, first)], {first}
            while heap and len(scores) < self.n:
                lost, pick = heapq.heappop(heap)
                if any(pick):
                    scores.append(total - lost)
                    others.append({i: options[j][x][1] for j, (i, x) in enumerate(zip(near, pick)) if x})
                for j in range(len(near)):
                    if pick[j] + 1 < len(loss[j]):
                        nxt = pick[:j] + (pick[j] + 1,) + pick[j + 1:]
                        if nxt not in seen:
                            seen.add(nxt)
                            heapq.heappush(heap, (sum(loss[i][x] for i, x in enumerate(nxt)), nxt))
        return self.flat[place], scores, others

    def best_of(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        if word not in self.options:
            self.options[word] = self.p.paths(word, self.n)
        return self.options[word]

    @staticmethod
    def smallest(gaps: np.ndarray, m: int) -> np.ndarray:
        """The m smallest, of ties the earlier."""
        low = np.nonzero(gaps <= np.partition(gaps, m - 1)[m - 1])[0]
        return low[np.argsort(gaps[low], kind="stable")][:m]

    def same_words(self, words: list[str], others: list[dict[int, tuple[int, ...]]]) -> bool:
        """Whether the words in which the others differ decode to the same characters."""
        return all(b"".join(self.p.data[i] for i in ids).decode("utf-8", "replace") == words[k] for o in others for k, ids in o.items())

    def alternative(self, text: str, other: dict[int, tuple[int, ...]]) -> list[int]:
        """The ids of a segmentation after the first."""
        at = [self.number[w] for w in self.p.words(text)]
        return [i for k, a in enumerate(at) for i in other.get(k, self.flat[self.start[a]:self.start[a] + self.count[a]].tolist())]


_READY: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, n_best: int) -> Encoder:
    """One for each Python worker."""
    if (path, n_best) not in _READY:
        _READY[path, n_best] = Encoder(Pieces(path), n_best)
    return _READY[path, n_best]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_best: int = N_BEST, model: str = MODEL,
           with_ids: bool = True) -> DataFrame:
    """For each document its best segmentation (ids, and their digest), the scores of the N best, the words in which those
    after the first differ (`edits`: rank, number of the word, ids), and whether decoding each gives the text back."""
    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), column(text_col).alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, thash bigint, n_pieces bigint, ids_sha256 string, scores array<double>, "
              "edits array<struct<rank:int,word:int,ids:array<int>>>, round_trip boolean")

    def run(cols: dict[str, list]) -> dict[str, list]:
        enc = encoder(model, n_best)
        split = [enc.p.words(t or "") for t in cols["text"]]
        found = enc.encode_words(split)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "thash": cols["thash"]}
        out["n_pieces"] = [len(ids) for ids, _, _ in found]
        out["ids_sha256"] = [digest(ids) for ids, _, _ in found]
        out["scores"] = [[round(s, 6) for s in scores] for _, scores, _ in found]
        out["edits"] = [[{"rank": r, "word": w, "ids": list(ids)} for r, o in enumerate(others, 2) for w, ids in sorted(o.items())]
                        for _, _, others in found]
        out["round_trip"] = [enc.p.decode(ids.tolist()) == (t or "") and enc.same_words(words, others)
                             for t, words, (ids, _, others) in zip(cols["text"], split, found)]
        if with_ids:
            out["ids"] = [ids for ids, _, _ in found]
        return out

    return map_batches(texts, run, schema + ", ids array<int>" * with_ids, heavy="text")


def digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def decode(encoded: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """The column `text` that a column of ids stands for, beside the frame's other columns."""
    @pandas_udf("string")
    def text(ids):
        p = encoder(model, N_BEST).p
        return ids.map(lambda x: None if x is None else p.decode(list(x)))

    return encoded.withColumn("text", text(F.col(ids_col)))
