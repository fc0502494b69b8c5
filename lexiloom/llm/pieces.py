"""SentencePiece encoding by merges with seeded dropout, and decoding.

A text becomes the blank mark followed by the text with its spaces turned into blank marks; adjacent symbols are merged from an
agenda, best piece first and leftmost among equals, and what no piece covers falls back to bytes. When a candidate comes up it is
skipped if a hash keyed by the seed, the occurrence, the unit, its place and the piece falls below the dropout rate; a skipped candidate isn't
tried again. Whatever is skipped, the pieces spell the text, so decoding gives it back exactly.

No piece has a blank mark after another character, and some characters stand in no longer piece; merging therefore
never crosses the cuts made there, and the units in between are encoded apart. An occurrence is named by a hash of the seed, the text and its number
in the text, so each one is segmented by draws of its own, the same ones on every run. What is kept of a unit is a tree: its
segmentation without skips beside the candidates that come up on the way, and below it, by the first one that is skipped, the segmentation and
further candidates from there on. An occurrence draws for the candidates of a node, all occurrences of a slice at once, and goes
down at its first skip. Nodes are made when they are needed a second time; the first time the occurrence is merged by itself. All trees
lie in a few flat arrays of bounded size, so going down is array work too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, prepare, quoted, slices, unused

BLANK = "▁"
DROPOUT = 0.1
SEED = 20
#: Nodes and units kept, at some 100 to 200 bytes each; beyond them all are forgotten and made again when met.
NODES_KEPT = 300_000
#: Most characters of a unit that has a tree, and the most candidates that its paths tell apart; beyond them each occurrence is merged by itself.
SHORT_UNIT, MOST_DRAWN = 40, 64
TOGETHER = 4096
FULL, NEVER = (1 << 64) - 1, 1 << 30
BASE = 0x9E3779B97F4A7C15
#: Links that lead to no node: not met yet, met once, and of what has no tree.
NEW, MET, ALONE = 0, -1, -2
#: Characters, and units of a long text, that are encoded at once.
CHARS_AT_ONCE, UNITS_AT_ONCE = 1 << 18, 1 << 16
OF_OCCURRENCE, OF_SEED, OF_PLACE, OF_RANK = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Grown:
    """An array that grows."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1024, dtype), 0

    def put(self, values: np.ndarray) -> int:
        """Writes behind the end, without keeping; where it starts."""
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(len(values), len(self.data) // 2), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        return self.n

    def add(self, values: np.ndarray) -> int:
        start = self.put(values)
        self.n += len(values)
        return start


class _Numbers(dict):
    """Numbers of units in the order in which they are met; ``new`` has the links of those without a place among the roots yet."""

    def __init__(self):
        self.new: list[int] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(NEW if len(unit) <= SHORT_UNIT else ALONE)
        self[unit] = n = len(self)
        return n


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    return pool[_places(starts, sizes)]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Trees:
    """The trees of units, node by node: piece ids, drawn parts of the candidates' keys, a link for each candidate to the node where it is skipped, the mask
    of the candidates skipped above, and the depth, how many candidates lie above. Links and ``roots`` hold numbers of nodes from 1, or NEW, MET or ALONE."""

    def __init__(self):
        self.units = _Numbers()
        self.roots, self.links, self.ids = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self.draws, self.mask = _Grown(np.uint64), _Grown(np.uint64)
        self.ids_at, self.n_ids, self.draws_at, self.n_draws, self.depth = (_Grown(np.int64) for _ in range(5))
        nothing = np.zeros(1, np.int64)
        self.add(nothing[:0], nothing, nothing[:0], nothing, nothing, nothing)

    def add(self, ids: np.ndarray, n_ids: np.ndarray, draws: np.ndarray, n_draws: np.ndarray, masks: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The numbers of new nodes, whose ids and draws come one after the other."""
        first = self.n_ids.add(n_ids)
        self.ids_at.add(self.ids.add(ids) + np.cumsum(n_ids) - n_ids)
        self.n_draws.add(n_draws)
        self.draws_at.add(self.draws.add(draws) + np.cumsum(n_draws) - n_draws)
        self.links.add(np.zeros(len(draws), np.int32))
        self.mask.add(masks)
        self.depth.add(depths)
        return np.arange(first, first + len(n_ids), dtype=np.int32)

    def number(self, units: list[str]) -> np.ndarray:
        """The places of the units among the roots."""
        of = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        if self.units.new:
            self.roots.add(np.array(self.units.new, np.int32))
            self.units.new = []
        return of

    def size(self) -> int:
        return self.n_ids.n + len(self.units)


class Codec:
    """The vocabulary of a byte-fallback BPE model, with encoding and decoding."""

    def __init__(self, data: bytes, dropout: float = DROPOUT, seed: int = SEED):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        ids = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = {model.id_to_piece(i): n for n, i in enumerate(by_score)}
        self.text_of: list[str | bytes | None] = [None] * len(ids)
        for piece, i in self.id_of.items():
            self.text_of[i] = piece.replace(BLANK, " ")
        for b, i in self.bytes.items():
            self.text_of[i] = chr(b) if b < 128 else bytes([b])
        longer = [p for p in self.id_of if len(p) > 1]
        if any(BLANK in p.lstrip(BLANK) for p in longer):
            raise ValueError("a piece has a blank mark after another character")
        inner = set("".join(longer)) - {BLANK}
        letters = {c for c in inner if c.isalpha()}
        if any(len({c in letters for c in p.lstrip(BLANK)}) > 1 for p in longer):  # a piece mixes letters and others: no cut between them
            letters = inner
        classes = ["".join(map(re.escape, sorted(c))) for c in (letters, inner - letters) if c]
        self.units = re.compile("|".join([*(f" *[{c}]+" for c in classes), " +", "."]), re.DOTALL)
        self.dropout, self.bar, self.seed = dropout, int(dropout * 2**64), seed
        # Adjacent symbols that make a piece: both ids in one number, sorted, beside the piece's rank.
        self.by_rank = np.array(by_score + [-1], np.int64)
        parts = [(self.id_of[p[:i]], self.id_of[p[i:]], self.rank[p]) for p in longer for i in range(1, len(p)) if p[:i] in self.id_of and p[i:] in self.id_of]
        pairs = np.array(sorted((a << 32 | b, r) for a, b, r in parts), np.int64)
        self.pair_keys, self.pair_ranks = np.append(pairs[:, 0], 1 << 62), np.append(pairs[:, 1], NEVER).astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in {c for p in longer for c in p}:
            self.of_char[ord(c)] = self.id_of.get(c, -1)
        self.trees = Trees()

    def key(self, unit: str, occurrence: int) -> int:
        """A polynomial of the characters, so that it can be had for many units at once."""
        key = occurrence * OF_OCCURRENCE + self.seed * OF_SEED
        for i, c in enumerate(unit):
            key += ord(c) * pow(BASE, i + 1, 1 << 64)
        return key & FULL

    def skipped(self, key: int, left: int, rank: int) -> bool:
        x = (key + left * OF_PLACE + rank * OF_RANK) * 0xBF58476D1CE4E5B9 & FULL
        x = (x ^ (x >> 32)) * 0x94D049BB133111EB & FULL
        return x ^ (x >> 31) < self.bar

    def merge(self, unit: str, occurrence: int) -> list[str]:
        """The unit's symbols after the agenda is empty. Short units keep it as a plain list: its least entry is found faster than a heap is kept."""
        if len(unit) > SHORT_UNIT:
            return self._merge_long(unit, occurrence)
        rank, bar = self.rank.get, self.bar
        symbols, starts = list(unit), list(range(len(unit)))
        agenda = [rank(a + b, NEVER) for a, b in zip(unit, unit[1:])]
        key = self.key(unit, occurrence)
        while agenda and (r := min(agenda)) < NEVER:
            i = agenda.index(r)
            if bar and self.skipped(key, starts[i], r):
                agenda[i] = NEVER
                continue
            symbols[i] += symbols.pop(i + 1)
            del starts[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_long(self, unit: str, occurrence: int) -> list[str]:
        """The same with a heap and linked symbols."""
        symbols, rank = list(unit), self.rank
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank.get(unit[i : i + 2])) is not None]
        heapify(agenda)
        key = self.key(unit, occurrence)
        while agenda:
            r, i, size = heappop(agenda)
            j = after[i]
            # Stale: a side has been merged away or has grown.
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            if self.bar and self.skipped(key, i, r):
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (r := rank.get(symbols[i] + symbols[j])) is not None:
                    heappush(agenda, (r, i, len(symbols[i]) + len(symbols[j])))
            h = before[i]
            if h >= 0 and (r := rank.get(symbols[h] + symbols[i])) is not None:
                heappush(agenda, (r, h, len(symbols[h]) + len(symbols[i])))
        return [s for s in symbols if s]

    def spelt(self, unit: str, occurrence: int) -> tuple[int, ...]:
        """The piece ids of one unit; symbols without a piece are spelt in bytes."""
        # So is the blank mark itself, if a text has it: as a piece it would come back as a space.
        symbols = [unit] if unit == BLANK else self.merge(unit.replace(" ", BLANK), occurrence)
        ids = [self.id_of.get(s) if unit != BLANK else None for s in symbols]
        return tuple(chain.from_iterable([self.bytes[b] for b in s.encode()] if i is None else [i] for s, i in zip(symbols, ids)))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_ranks[at], np.int32(NEVER))

    def _together(self, units: list[str], masks: np.ndarray | None, base: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """For many short units in step, one agenda entry of each at a time: (piece ids, their numbers by unit, drawn parts, their numbers by unit, covered).

        The ids are those if the candidates in the mask are skipped, and the drawn parts those of the candidates after the last of these. Without masks
        skips are drawn, with ``base`` the keys without the unit's part. Units with a character that has no piece aren't covered and have nothing."""
        n, sizes = len(units), np.array([len(u) for u in units])
        width = int(sizes.max()) + 1
        chars = np.frombuffer("".join(units).replace(" ", BLANK).encode("utf-32-le"), np.uint32)
        symbol = np.full((n, width), -1, np.int64)
        inside = np.arange(width) < sizes[:, None]
        symbol[inside] = self.of_char[chars]
        covered = (symbol >= 0).sum(1) == sizes
        agenda = np.full((n, width), NEVER, np.int32)
        agenda[:, :-1] = self._ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, -1)
        agenda[~covered] = NEVER
        points = np.zeros((n, width), np.uint64)
        points[inside] = chars
        powers = np.cumprod(np.full(width, BASE, np.uint64))
        keys = (points * powers).sum(1, dtype=np.uint64)
        after, before = (np.tile(np.arange(width, dtype=np.int64) + d, (n, 1)) for d in (1, -1))
        s, nxt, prv, todo = symbol.ravel(), after.ravel(), before.ravel(), agenda.ravel()
        rows, left_to_skip = np.arange(n), masks
        if masks is None:
            keys += base
        else:
            left_to_skip = masks.copy()
        met: list[np.ndarray] = [np.zeros(0, np.int64)]
        draws: list[np.ndarray] = [np.zeros(0, np.uint64)]
        while len(rows):
            best = agenda[rows].argmin(1)
            at = rows * width + best
            rank = todo[at]
            busy = rank < NEVER
            rows, best, at, rank = rows[busy], best[busy], at[busy], rank[busy]
            drawn = keys[rows] + best.astype(np.uint64) * np.uint64(OF_PLACE) + rank.astype(np.uint64) * np.uint64(OF_RANK)
            if masks is None:
                skip = self._skips(drawn)
            else:
                open_ = left_to_skip[rows] == 0
                met.append(rows[open_])
                draws.append(drawn[open_])
                skip = (left_to_skip[rows] & np.uint64(1)) > 0
                left_to_skip >>= np.uint64(1)
            todo[at[skip]] = NEVER
            go = ~skip
            best, at, rank, base = best[go], at[go], rank[go], (rows * width)[go]
            gone = base + nxt[at]
            s[at] = self.by_rank[rank]
            s[gone] = -1
            todo[gone] = NEVER
            follower = nxt[gone]
            nxt[at] = follower
            there = follower < width
            prv[(base + follower)[there]] = best[there]
            right = np.where(there, s[np.where(there, base + follower, 0)], -1)
            todo[at] = self._ranks(s[at], right)
            has = prv[at] >= 0
            left = (base + prv[at])[has]
            todo[left] = self._ranks(s[left], s[at[has]])
        symbol[~covered] = -1
        of = np.concatenate(met)
        drawn = np.concatenate(draws)[np.argsort(of, kind="stable")]
        return s[s >= 0].astype(np.int32), (symbol >= 0).sum(1), drawn, np.bincount(of, minlength=n), covered

    def _skips(self, drawn: np.ndarray) -> np.ndarray:
        """``skipped`` for many candidates."""
        if not self.bar:
            return np.zeros(len(drawn), bool)
        x = drawn * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) <= np.uint64(self.bar - 1)

    def _alone(self, units: list[str], numbers: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids one after the other, their numbers) of ``spelt`` for each unit and number, without trees."""
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        first, last = (bisect_right(order, size, key=lambda i: len(units[i])) for size in (1, SHORT_UNIT))
        found, sizes, plain = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [*order[:first], *order[last:]]
        done: list[int] = []
        for i in range(first, last, TOGETHER):
            some = order[i : min(i + TOGETHER, last)]
            ids, n_ids, _, _, covered = self._together([units[j] for j in some], None, base[some])
            found.append(ids)
            sizes.append(n_ids[covered])
            done += [j for j, c in zip(some, covered.tolist()) if c]
            plain += [j for j, c in zip(some, covered.tolist()) if not c]
        made = [self.spelt(units[j], int(numbers[j])) for j in plain]
        found.append(np.array(list(chain.from_iterable(made)), np.int32))
        sizes.append(np.array(list(map(len, made)), np.int64))
        n = np.concatenate(sizes)
        back = np.argsort(np.array(done + plain, np.int64))
        return _gathered(np.concatenate(found), (np.cumsum(n) - n)[back], n[back]), n[back]

    def _grow(self, units: list[str], masks: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The numbers of new nodes for units whose candidates in the mask are skipped, ALONE for those that can't be kept so."""
        out = np.full(len(units), ALONE, np.int32)
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        first = bisect_right(order, 1, key=lambda i: len(units[i]))
        if first:  # one character is merged with nothing
            made = [self.spelt(units[i], 0) for i in order[:first]]
            sizes, none = np.array(list(map(len, made))), np.zeros(first, np.int64)
            out[order[:first]] = self.trees.add(np.array(list(chain.from_iterable(made)), np.int32), sizes, np.zeros(0, np.uint64), none, none.astype(np.uint64), none)
        for i in range(first, len(order), TOGETHER):
            some = np.array(order[i : i + TOGETHER])
            ids, n_ids, drawn, n_drawn, covered = self._together([units[j] for j in some], masks[some])
            out[some[covered]] = self.trees.add(ids, n_ids[covered], drawn, n_drawn[covered], masks[some][covered], depths[some][covered])
        return out

    def _follow(self, links: _Grown, slots: np.ndarray, units: list[str], who: np.ndarray, masks: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The nodes at the slots; 0 or less for occurrences that are merged by themselves. A slot that is met for the second time gets its node."""
        state = links.data[slots]
        open_ = np.flatnonzero((state == NEW) | (state == MET))
        if len(open_):
            kinds, first, of, times = np.unique(slots[open_], return_index=True, return_inverse=True, return_counts=True)
            source = open_[first]
            value = np.where(depths[source] > MOST_DRAWN, ALONE, MET).astype(np.int32)
            grows = (value == MET) & ((times > 1) | (state[source] == MET))
            source = source[grows]
            value[grows] = self._grow([units[i] for i in who[source].tolist()], masks[source], depths[source])
            links.data[kinds] = value  # after growing, which may have moved the links
            state[open_] = value[of]
        return state

    def spell(self, units: list[str], occurrences) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids one after the other, their numbers): ``spelt`` for each unit and the number of its occurrence (one for all, or an array)."""
        n, trees = len(units), self.trees
        numbers = np.broadcast_to(np.asarray(occurrences, np.uint64), n)
        base = numbers * np.uint64(OF_OCCURRENCE) + np.uint64(self.seed * OF_SEED & FULL)
        final, who, none = np.full(n, ALONE, np.int32), np.arange(n), np.zeros(n, np.int64)
        node = self._follow(trees.roots, trees.number(units), units, who, none.astype(np.uint64), none)
        while len(who):
            final[who] = node
            has = node > 0
            who, node = who[has], node[has]
            if not self.bar or not len(who):
                break
            sizes, starts = trees.n_draws.data[node], trees.draws_at.data[node]
            place, ends = _places(starts, sizes), np.cumsum(sizes)
            hits = np.flatnonzero(self._skips(np.repeat(base[who], sizes) + trees.draws.data[place]))
            of = np.searchsorted(ends, hits, "right")
            first = np.append(True, of[1:] != of[:-1])[: len(of)]
            of, slots = of[first], place[hits[first]]
            above = node[of]
            drawn = trees.depth.data[above] + slots - trees.draws_at.data[above]
            masks = trees.mask.data[above] | np.uint64(1) << np.minimum(drawn, 63).astype(np.uint64)
            who = who[of]
            node = self._follow(trees.links, slots, units, who, masks, drawn + 1)
        kept, sizes, starts = final > 0, np.zeros(n, np.int64), np.zeros(n, np.int64)
        sizes[kept], starts[kept] = trees.n_ids.data[final[kept]], trees.ids_at.data[final[kept]]
        alone = np.flatnonzero(~kept)
        if len(alone):
            ids, own = self._alone([units[i] for i in alone.tolist()], numbers[alone], base[alone])
            sizes[alone], starts[alone] = own, trees.ids.put(ids) + np.cumsum(own) - own
        out = _gathered(trees.ids.data, starts, sizes)
        if trees.size() > NODES_KEPT:
            self.trees = Trees()
        return out, sizes

    def occurrences(self, text: str, n: int) -> np.ndarray:
        """The numbers of the occurrences of a text's units, by which they draw."""
        key = np.uint64(xxhash.xxh3_64_intdigest(text, seed=self.seed))
        return mix64(key + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of whole texts; none for an empty one."""
        out: list[np.ndarray] = []
        for start, end in slices(texts, CHARS_AT_ONCE):
            if end - start == 1 and len(texts[start]) > CHARS_AT_ONCE:
                out.append(self._encode_long(texts[start]))
                continue
            units, numbers, ends = [], [np.zeros(0, np.uint64)], [0]
            for text in texts[start:end]:
                before = len(units)
                if text:
                    units += self.units.findall(" " + text)
                    numbers.append(self.occurrences(text, len(units) - before))
                ends.append(len(units))
            ids, sizes = self.spell(units, np.concatenate(numbers))
            stops = np.append(0, np.cumsum(sizes))[ends].tolist()
            out += [ids[a:b] for a, b in zip(stops, stops[1:])]
        return out

    def _encode_long(self, text: str) -> np.ndarray:
        """The same for one text, whose units are taken by blocks."""
        found = self.units.finditer(" " + text)
        key, done, out = np.uint64(xxhash.xxh3_64_intdigest(text, seed=self.seed)), 0, []
        while block := [m.group() for m in islice(found, UNITS_AT_ONCE)]:
            numbers = np.arange(done, done + len(block), dtype=np.uint64)
            out.append(self.spell(block, mix64(key + numbers * np.uint64(0x9E3779B97F4A7C15)))[0])
            done += len(block)
        return np.concatenate(out)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of piece ids; the first blank is the one that encoding adds."""
        parts = list(map(self.text_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        try:
            text = "".join(parts)
        except TypeError:  # bytes among them
            text = b"".join(p if isinstance(p, bytes) else p.encode() for p in parts).decode()
        return text[1:]


_codecs: dict[tuple, Codec] = {}


def codec(data: bytes, dropout: float = DROPOUT, seed: int = SEED) -> Codec:
    """One codec for each model, rate and seed in a process."""
    key = (hash(data), dropout, seed)
    if key not in _codecs:
        _codecs[key] = Codec(data, dropout, seed)
    return _codecs[key]


def _model(docs: DataFrame, path: str):
    """The model file, which has a fixed size, read by the driver and sent out."""
    with open(path, "rb") as f:
        return prepare(docs.sparkSession).sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "pieces", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with the piece ids of each whole text: none for an empty text, null for a null one. Equal texts have equal
    pieces; repeated rows, and all columns, are kept, but for one named as ``into``, which is replaced."""
    data = _model(docs, model_path)

    @F.pandas_udf("array<int>")
    def pieces(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        ids = codec(data.value, dropout, seed).encode_all([t or "" for t in texts])
        return pd.Series([None if t is None else x for t, x in zip(texts, ids)], dtype=object)

    return docs.withColumn(into, pieces(F.col(text_col).cast("string")))


def decode(pieces: DataFrame, model_path: str, pieces_col: str = "pieces", into: str = "decoded") -> DataFrame:
    """``pieces`` with the text that the ids spell; null for null. A column named as ``into`` is replaced, all others are kept."""
    data = _model(pieces, model_path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = codec(data.value)
        return pd.Series([None if x is None else own.decode(x) for x in ids], dtype=object)

    return pieces.withColumn(into, text(F.col(pieces_col)))


def round_trip(docs: DataFrame, model_path: str, text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """``docs`` with ``pieces``, as ``encode`` gives them, ``n_pieces`` and ``lossless``, whether decoding the ids gives the text back: both ways in one pass.

    A null text has null pieces, 0 of them, and comes back. All rows and columns are kept, but for columns of these three names, which are replaced.
    """
    data = _model(docs, model_path)
    made = ["pieces", "n_pieces", "lossless"]

    @F.pandas_udf("pieces array<int>, n_pieces long, lossless boolean")
    def both(text: pd.Series) -> pd.DataFrame:
        texts, own = text.tolist(), codec(data.value, dropout, seed)
        ids = own.encode_all([t or "" for t in texts])
        back = [t is None or own.decode(x) == t for t, x in zip(texts, ids)]
        return pd.DataFrame({"pieces": pd.Series([None if t is None else x for t, x in zip(texts, ids)], dtype=object), "n_pieces": list(map(len, ids)), "lossless": back}, columns=made)

    (whole,) = unused(docs, "both")
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in made]
    return docs.withColumn(whole, both(F.col(quoted(text_col)).cast("string"))).select(*kept, *[F.col(f"{quoted(whole)}.{c}") for c in made])


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_chars, n_pieces, pieces_sha256 (of the ids as four bytes each, the lowest first), decoded_sha256, lossless.

    Null texts count as empty. An empty table gives no rows; other columns are not read.
    """
    data = _model(docs, model_path)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    own = own.withColumn("id", F.col("id").cast("string"))  # beside nulls pandas would make numbers floats

    def run(batches):
        both = codec(data.value)
        for b in batches:
            rows, texts = [], b["text"].tolist()
            for text, ids in zip(texts, both.encode_all(texts)):
                decoded = both.decode(ids)
                rows.append((len(text), len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text))
            out = pd.DataFrame(rows, columns=["n_chars", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])
            out.insert(0, "id", pd.Series(b["id"].tolist(), dtype=object))
            yield out

    done = own.mapInPandas(run, "id string, n_chars long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")
    return done.select(F.col("id").cast(id_type).alias(id_col), *done.columns[1:])
