"""Token counts by a finite-state compilation of a BPE tokenizer.

The compiled machine reads characters. A state joins the state of the splitter (inside letters, inside other
marks, after an apostrophe, ...) with that of a merge automaton over bytes, and each transition carries the number of tokens that
it settles. The merge automaton rests on two facts of merge tables: the last token of every prefix is unique, and it is the one token
that ends there and is stable beside the last token of what precedes it. A state therefore keeps, for the positions at which a longer
token may still have begun, the last token and the count relative to the present one. States and transitions are made when first met and
are the same for every text; a table of bounded size keeps the net effect of whole words from the rest state.

A text is cut into chunks of characters and each chunk is turned into a state map without knowledge of what precedes: blanks bring every
state to rest, so the map is the characters before the first blank, the count after it and the state at the end. Maps compose
associatively, by a tree scan, to the map of the text.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

CHUNK = 1 << 15
#: Words are kept in two generations, states in one: beyond the bound all are forgotten, within a text too, and made again when met.
WORDS_KEPT, STATES_KEPT = 200_000, 150_000
#: Characters that the splitter's pattern lists.
MET = 1500
END = "</w>"
#: Splitter states: at rest, in letters, in other marks, after an apostrophe at a token's start, and after it and r, v or l.
REST, LETTERS, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
#: A state of the whole machine: the splitter's, the merge automaton's, and the byte that waits to be read.
AT_REST = (REST, 0, None)
LETTER, NUMBER, MARK, BLANK = range(4)
#: Fixed values of the tokenizer's splitting pattern: contractions of one letter, and of two by their first.
SHORT, LONG = "stmd", {"r": (QUOTE_R, "e"), "v": (QUOTE_V, "e"), "l": (QUOTE_L, "l")}
BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """Reads byte symbols, the last of a word with END, and says by how many the number of tokens changes."""

    def __init__(self, merges: list[tuple[str, str]], tokens: set[str]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = tokens
        self.prefixes = {t[:i] for t in tokens for i in range(len(t.removesuffix(END)))}
        self.stable = lru_cache(1 << 18)(self._stable)

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain merging, lowest rank first, leftmost among equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:]))))
            if best[0] == 1 << 60:
                break
            pair = (symbols[best[1]], symbols[best[1] + 1])
            out, i = [], 0
            while i < len(symbols):  # a merge applies to all its pairs at once
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) else list(token)

    def _stable(self, before: str | None, token: str) -> bool:
        """Whether the two tokens, or the one at a word's start, come out of merging as they are."""
        if (before, token) in self.rank:
            return False
        pair = [token] if before is None else [before, token]
        return self.merge([s for t in pair for s in self.symbols(t)]) == pair

    #: A state: the longest read suffix that begins some token, and for each position in it the last token and by how much the count grew there.
    START = ("", ((None, 0),))

    def step(self, state: tuple, symbol: str) -> tuple[tuple, int]:
        suffix, window = state
        read, end = suffix + symbol[0], symbol[1:]
        n, tokens, stable, change = len(read), self.tokens, self.stable, 1
        # From the longest token that may end here to the shortest; the window has an entry for each place where one may begin.
        later = [0]
        for _, grew in reversed(window[1:]):
            later.append(later[-1] + grew)
        for begin in range(n):
            token = read[begin:] + end
            if token in tokens and stable(window[begin][0], token):
                change -= later[n - 1 - begin]
                break
        else:
            raise ValueError(f"no token ends in {read!r}")
        begin = 0
        while read[begin:] not in self.prefixes:
            begin += 1
        return (read[begin:], (*window[begin:], (token, change))), change


class Machine:
    """The compiled tokenizer. ``run`` is its transition function; ``count`` reads a whole text."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        added = [t["content"] for t in spec["added_tokens"]]
        self.automaton = MergeAutomaton(merges, set(model["vocab"]) - set(added))
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.library = Tokenizer.from_str(data.decode())  # for its normaliser and its character classes, not for tokens
        self.of_byte = byte_symbols()
        self.kinds = {chr(c): LETTER if chr(c).isalpha() else NUMBER if chr(c).isdigit() else MARK for c in range(128)} | {c: BLANK for c in "\t\n\x0b\x0c\r "}
        self.met = set(self.kinds)
        self._split_by_met()
        self.words: dict[str, int] = {}
        self.words_before: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        """Forgets all states; they are made again when met."""
        self.merge_states: list[tuple] = [MergeAutomaton.START]
        self.merge_ids: dict[tuple, int] = {MergeAutomaton.START: 0}
        self.merge_moves: list[dict[str, tuple[int, int]]] = [{}]
        self.states: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.ids: dict[tuple, int] = {}
        self.ends: dict[int, int] = {}
        self.rest = self._id(AT_REST)

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return self.ids[state]

    def kind(self, ch: str) -> int:
        """The splitter's class of a character, asked of the library's splitter once for each that isn't ASCII."""
        if ch not in self.kinds:
            pieces = lambda s: [s[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(s)]
            with_letter, with_mark = pieces("a" + ch), pieces("!" + ch)
            self.kinds[ch] = LETTER if len(with_letter) == 1 and with_letter[0] != "a" else MARK if len(with_mark) == 1 and with_mark[0] != "!" else BLANK if with_letter == ["a"] else NUMBER
        return self.kinds[ch]

    def _split_by_met(self) -> None:
        """The splitter's pattern, with the classes of the characters met so far."""
        letters, numbers = ("".join(map(re.escape, sorted(c for c in self.met if self.kinds[c] == kind))) for kind in (LETTER, NUMBER))
        self.letters = {c for c in self.met if self.kinds[c] == LETTER}
        self.pieces = re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall

    def _merge_step(self, state: int, symbol: str) -> tuple[int, int]:
        move = self.merge_moves[state].get(symbol)
        if move is None:
            after, n = self.automaton.step(self.merge_states[state], symbol)
            at = 0 if len(symbol) > 1 else self._merge_id(after)  # a word's end: nothing follows
            move = self.merge_moves[state][symbol] = (at, n)
        return move

    def _merge_id(self, state: tuple) -> int:
        if (at := self.merge_ids.get(state)) is None:
            at = self.merge_ids[state] = len(self.merge_states)
            self.merge_states.append(state)
            self.merge_moves.append({})
        return at

    def _full(self) -> bool:
        return len(self.states) + len(self.merge_states) > STATES_KEPT

    def _left(self, at: int) -> tuple:
        """A state by its content, which outlives its number."""
        lex, merging, waiting = self.states[at]
        return lex, self.merge_states[merging], waiting

    def _entered(self, left: tuple) -> int:
        lex, merging, waiting = left
        return self._id((lex, self._merge_id(merging), waiting))

    def _piece(self, piece: str) -> int:
        """The tokens of one piece of the splitter."""
        symbols = piece if piece.isalpha() and piece.isascii() else [self.of_byte[b] for b in piece.encode()]
        state, total, moves = 0, 0, self.merge_moves
        for symbol in symbols[:-1]:
            state, n = moves[state].get(symbol) or self._merge_step(state, symbol)
            total += n
        symbol = symbols[-1] + END
        return total + (moves[state].get(symbol) or self._merge_step(state, symbol))[1]

    def _feed(self, state: tuple, chars: str) -> tuple[tuple, int]:
        """The token under construction takes more characters; its last byte waits, for it may be the word's last."""
        lex, merging, waiting = state
        settled = 0
        for byte in chars.encode():
            if waiting is not None:
                merging, n = self._merge_step(merging, waiting)
                settled += n
            waiting = self.of_byte[byte]
        return (lex, merging, waiting), settled

    def _close(self, state: tuple) -> int:
        """The tokens settled by the end of the token under construction."""
        lex, merging, waiting = state
        if lex >= QUOTE:
            letter = next((c for c, (q, _) in LONG.items() if q == lex), "")
            return self._piece("'") + (self._piece(letter) if letter else 0)
        return 0 if waiting is None else self._merge_step(merging, waiting + END)[1]

    def _begin(self, ch: str, kind: int) -> tuple[tuple, int]:
        if kind == BLANK:
            return AT_REST, 0
        if kind == NUMBER:
            return AT_REST, self._piece(ch)
        if ch == "'":
            return (QUOTE, 0, None), 0
        return self._feed((LETTERS if kind == LETTER else MARKS, 0, None), ch)

    def _step(self, state: tuple, ch: str) -> tuple[tuple, int]:
        lex, kind = state[0], self.kind(ch)
        if lex == QUOTE:
            if ch in SHORT:
                return AT_REST, self._piece("'" + ch)
            if ch in LONG:
                return (LONG[ch][0], 0, None), 0
            if kind == MARK:
                marks, n = self._feed((MARKS, 0, None), "'" + ch)
                return marks, n
        elif lex > QUOTE:
            first = next(c for c, (q, _) in LONG.items() if q == lex)
            if ch == LONG[first][1]:
                return AT_REST, self._piece("'" + first + ch)
            if kind == LETTER:
                letters, n = self._feed((LETTERS, 0, None), first + ch)
                return letters, n + self._piece("'")
        elif (lex, kind) in ((LETTERS, LETTER), (MARKS, MARK)):
            return self._feed(state, ch)
        closed = self._close(state)
        begun, n = self._begin(ch, kind)
        return begun, closed + n

    def run(self, at: int, chars: str) -> tuple[int, int]:
        """From a state over characters to (state, settled tokens)."""
        total = 0
        for ch in chars:
            move = self.moves[at].get(ch)
            if move is None:
                after, n = self._step(self.states[at], ch)
                move = self.moves[at][ch] = (self._id(after), n)
                if self._full():
                    left = self._left(move[0])
                    self._clear()
                    move = (self._entered(left), n)
            at, n = move
            total += n
        return at, total

    def close(self, at: int) -> int:
        if at not in self.ends:
            self.ends[at] = self._close(self.states[at])
        return self.ends[at]

    def word(self, word: str) -> int:
        """The tokens of a word between blanks: the net effect of running from rest to rest. Unless its characters are too many to list, the
        splitter's pieces are told by a pattern and the merge automaton reads them one by one; it takes the same moves."""
        n = self.words_before.get(word)
        if n is None:
            if self.letters.issuperset(word):
                n = self._piece(word) if word else 0
            elif self._listed(word):
                n = sum(map(self._piece, self.pieces(word)))
            else:
                at, n = self.run(self.rest, word)
                n += self.close(at)
        if len(word) <= 64:
            if len(self.words) >= WORDS_KEPT:
                self.words, self.words_before = {}, self.words
            self.words[word] = n
        return n

    def _listed(self, word: str) -> bool:
        new = set(word) - self.met
        if new and len(self.met) + len(new) > MET:
            return False
        if new:
            if BLANK in map(self.kind, new):
                return False
            self.met |= new
            self._split_by_met()
        return True

    def chunk_map(self, chunk: str) -> tuple:
        """(characters before the first blank, whether there is one, tokens after it, state at the end by its content)."""
        if self._full():
            self._clear()
        head, blank, after = chunk.partition(" ")
        if not blank:
            return head, False, 0, self._left(self.rest)
        words = after.split(" ")
        tail = words.pop()
        at, n = self.run(self.rest, tail)
        end = self._left(at)
        known = self.words.get
        counts = [known(w) for w in words]
        if None in counts:
            counts = [self.word(w) if c is None else c for w, c in zip(words, counts)]
        n += sum(counts)
        return head, True, n, end

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbours; associative."""
        if not a[1]:
            return a[0] + b[0], *b[1:]
        at, n = self.run(self._entered(a[3]), b[0])
        return (a[0], True, a[2] + n + self.close(at) + b[2], b[3]) if b[1] else (a[0], True, a[2] + n, self._left(at))

    def normal(self, text: str) -> str:
        """As the library has it: composed, blanks single, lower case. ASCII needs only the last; runs of blanks do no harm."""
        return text.translate(BLANKS).lower() if text.isascii() else self.library.normalizer.normalize_str(text)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; strings of special tokens in it are one token each."""
        segments = self.special.split(text)
        total = len(segments) - 1
        for segment in segments:
            segment = self.normal(segment)
            maps = [self.chunk_map(segment[i : i + chunk]) for i in range(0, len(segment), chunk)]
            while len(maps) > 1:
                maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
            for head, blank, n, end in maps:
                at, first = self.run(self.rest, head)
                total += first + self.close(at) + (n + self.close(self._entered(end)) if blank else 0)
        return total


_machines: dict[int, Machine] = {}


def machine(data: bytes) -> Machine:
    """One machine for each tokenizer and process."""
    key = hash(data)
    if key not in _machines:
        _machines[key] = Machine(data)
    return _machines[key]


def count(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per document row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer_path`` names a byte-level BPE with word ends; the driver reads it and sends it out, a file of fixed size. Null and empty texts
    have 0 bytes and 0 tokens. Texts of any length are read whole. An empty table gives no rows. Other columns are not read.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        data = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        own = machine(data.value)
        return pd.Series([own.count(x) if x else 0 for x in text], dtype="int64")

    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select(F.col("id").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
