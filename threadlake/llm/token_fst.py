"""A byte-level BPE tokenizer compiled to deterministic transducers that count tokens.

``Splitter`` finds where pre-tokens begin.  It reads classes of characters and has
13 states; a transition says whether a pre-token begins at the character
just read or, where that could only be known one character later, at the one
before.  Text is cut into chunks that run side by side: each gives a map from its
start state to its end state, a parallel prefix scan composes the maps, and a
second run with the start states known emits the boundaries.

``BytePairs`` counts the tokens of a pre-token, byte by byte.  Encoding by merges has
this property: a token sequence is the encoding of its bytes exactly if every two
neighbours are the encoding of theirs.  So the encoding of a prefix ends in one
known token, and reading on needs only, for each place in the prefix where a longer
token may still have begun, the token that ends there, the vocabulary's trie
node reached since, and the count of tokens up to there.  Those are the states; they
are determinised as the data needs them, counts are kept relative to the
least, and a transition is annotated with the number of tokens by which the
least rises.  Pre-tokens run side by side, a byte of each at a time.
"""

from __future__ import annotations

import json
from functools import lru_cache
from unicodedata import category

import numpy as np

# Character classes of the splitting pattern.
END, SPACE, OTHER_SPACE, LETTER, NUMBER, MARK, APOSTROPHE, STMD, R, V, L, E = range(12)
CLASSES = 12

#: The pattern that ``Splitter`` implements; fixed by the format of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of a chunk; chunks run side by side.
CHUNK = 256

#: Characters after which the states of a chunk have nearly always met.
WARM = 6

#: Compiled states and sets of tokens of a ``BytePairs`` before it starts anew.
MAX_STATES, MAX_VIEWS = 1 << 17, 1 << 18


@lru_cache(maxsize=1)
def _character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex
    from tokenizers import pre_tokenizers

    classes = np.full(0x110000, MARK, np.uint8)
    for point in range(0x110000):
        major = category(chr(point))[0]
        if major == "L":
            classes[point] = LETTER
        elif major == "N":
            classes[point] = NUMBER
    # Letters and numbers newer than this Python: as the library has them.
    library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    newer = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if category(chr(c)) == "Cn"))
    for character in newer:
        for probe, kind in (("a", LETTER), ("1", NUMBER)):
            if len(library.pre_tokenize_str(probe + character)) == 1:
                classes[ord(character)] = kind
    # The White_Space property; unlike str.isspace without the four separators of ASCII.
    classes[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = OTHER_SPACE
    for characters, kind in ((" ", SPACE), ("'", APOSTROPHE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in characters:
            classes[ord(c)] = kind
    return classes


class Splitter:
    """Deterministic transducer from character classes to pre-token starts."""

    HERE, BEFORE = 1, 2

    STATES = (
        "start", "letters", "numbers", "marks", "space", "other", "run_space", "run_other",
        "apostrophe", "after_r", "after_v", "after_l", "done",
    )

    def __init__(self) -> None:
        size = len(self.STATES)
        self._next = np.zeros((size, CLASSES), np.uint8)
        self._out = np.zeros((size, CLASSES), np.uint8)
        for state, name in enumerate(self.STATES):
            for kind in range(CLASSES):
                to, out = self._step(name, kind)
                # States are numbered by their row, so that adding a class gives an index.
                self._next[state, kind] = self.STATES.index(to) * CLASSES
                self._out[state, kind] = out
        self._next, self._out = self._next.ravel(), self._out.ravel()

    def _step(self, state: str, kind: int) -> tuple[str, int]:
        group = {SPACE: "space", OTHER_SPACE: "other", NUMBER: "numbers", MARK: "marks", APOSTROPHE: "marks", END: "start"}
        runs = group.get(kind, "letters")
        fresh = ("apostrophe" if kind == APOSTROPHE else runs, self.HERE)
        if state in ("after_r", "after_v", "after_l"):
            if kind == (L if state == "after_l" else E):
                return "done", 0
            # No contraction: the apostrophe stood alone and the letter began a word.
            to, out = self._step("letters", kind)
            return to, out | self.BEFORE
        if kind == END:
            return "start", self.HERE
        blank = kind in (SPACE, OTHER_SPACE)
        if state in ("letters", "numbers", "marks"):
            return (state, 0) if runs == state else fresh
        if state in ("space", "other", "run_space", "run_other") and blank:
            return ("run_space" if kind == SPACE else "run_other"), 0
        if state == "space":
            return runs, 0
        if state == "run_space":
            return runs, self.BEFORE
        if state == "run_other":
            return fresh[0], fresh[1] | self.BEFORE
        if state == "apostrophe":
            if kind in (STMD, R, V, L):
                return {STMD: "done", R: "after_r", V: "after_v", L: "after_l"}[kind], 0
            return ("marks", 0) if runs == "marks" else fresh
        return fresh

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Whether a pre-token, or an END, begins at each place; the last class is END."""
        n = len(classes)
        lanes = -(-n // CHUNK)
        padded = np.zeros(lanes * CHUNK, np.uint8)
        padded[:n] = classes
        columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        state = self._entry(columns, lanes)
        out = np.empty_like(columns)
        for j in range(CHUNK):
            index = state + columns[j]
            out[j] = self._out[index]
            state = self._next[index]
        flat = np.ascontiguousarray(out.T).ravel()[:n]
        begins = (flat & self.HERE).astype(bool)
        begins[:-1] |= (flat[1:] & self.BEFORE).astype(bool)
        return begins

    def _entry(self, columns: np.ndarray, lanes: int) -> np.ndarray:
        """The state in which each chunk begins."""
        size = len(self.STATES)
        every = np.arange(size, dtype=np.uint8) * CLASSES
        maps = np.repeat(every[:, None], lanes, axis=1)
        for j in range(WARM):
            maps = self._next[maps + columns[j]]
        apart = np.flatnonzero((maps != maps[0]).any(axis=0))
        one, full = maps[0], maps[:, apart]
        for j in range(WARM, CHUNK):
            one = self._next[one + columns[j]]
            if len(apart):
                full = self._next[full + columns[j][apart]]
        maps = np.repeat(one[:, None], size, axis=1)
        maps[apart] = full.T
        maps //= CLASSES
        # Prefix scan: after the round with step s, maps[i] spans the chunks i - 2s + 1 to i.
        step = 1
        while step < lanes:
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        begin = np.zeros(lanes, np.uint8)
        begin[1:] = maps[:-1, 0]
        return begin * CLASSES


#: A configuration is a trie node, what is known of the token before it, and a count.
State = tuple[tuple[int, int, int], ...]

#: Pre-tokens left to read together from which it pays to read them one by one.
FEW = 24

#: Pieces that open more merges than this have their crossings remembered.
OFTEN = 40


class _Table:
    """Growing hash table from (state, byte) to (state, count), read by whole arrays."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int = 12):
        self._bits, self._used = bits, 0
        self._keys = np.full(1 << bits, -1, np.int64)
        self._to = np.zeros(1 << bits, np.int32)
        self._count = np.zeros(1 << bits, np.int8)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> np.uint64(64 - self._bits)).astype(np.intp)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        mask = (1 << self._bits) - 1
        slots = self._slots(keys)
        held = self._keys[slots]
        away = np.flatnonzero(held != keys)
        while len(away):
            # An empty slot ends the search for a key, another key sends it on.
            missing = held[away] < 0
            slots[away[missing]] = -1
            away = away[~missing]
            slots[away] = (slots[away] + 1) & mask
            held[away] = self._keys[slots[away]]
            away = away[held[away] != keys[away]]
        return slots

    def put(self, key: int, to: int, count: int) -> None:
        if self._used * 3 > len(self._keys):
            old = self._keys >= 0
            keys, tos, counts = self._keys[old], self._to[old], self._count[old]
            self.__init__(self._bits + 1)
            for k, t, c in zip(keys.tolist(), tos.tolist(), counts.tolist()):
                self.put(k, t, c)
        slot = int(self._slots(np.array([key]))[0])
        while self._keys[slot] >= 0:
            slot = (slot + 1) & (len(self._keys) - 1)
        self._keys[slot], self._to[slot], self._count[slot] = key, to, count
        self._used += 1

    def read(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._to[slots], self._count[slots]


class BytePairs:
    """Transducer from the bytes of a pre-token to its number of tokens."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        # Tokens are numbered in the order of their bytes: those below a trie node are a range.
        order = sorted(vocabulary)
        number = {token: i for i, token in enumerate(order)}
        self._rank: dict[tuple[int, int], tuple[int, int]] = {}
        self._split: dict[int, tuple[int, int]] = {}
        opened: dict[int, list[tuple[int, int]]] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, whole = number[a], number[b], number[a + b]
            self._rank.setdefault((left, right), (rank, whole))
            self._split.setdefault(whole, (left, right))
            opened.setdefault(left, []).append((right, rank))
        self._opened = opened
        self._single = [number[bytes([b])] for b in range(256)]
        self._size = len(order)
        self._child: dict[int, int] = {}
        self._token, self._low, self._high = [-1], [0], [0]
        for i, token in enumerate(order):
            node = 0
            for byte in token:
                self._high[node] = i + 1
                key = node << 8 | byte
                if key not in self._child:
                    self._child[key] = len(self._token)
                    self._token.append(-1)
                    self._low.append(i)
                    self._high.append(i)
                node = self._child[key]
            self._token[node] = i
            # What is below a node starts behind the node's own token.
            self._low[node] = self._high[node] = i + 1
        self._sound = np.zeros(self._size, bool)
        starting: dict[int, list[tuple[int, float]]] = {}
        for token in sorted(range(self._size), key=lambda t: len(order[t])):
            if self._is_sound(token):
                self._sound[token] = True
                for piece, until in self._edge(token, 0):
                    starting.setdefault(piece, []).append((token, until))
        self._starting = {
            piece: (np.array([t for t, _ in found]), np.array([u for _, u in found])) for piece, found in starting.items()
        }
        self._kinds: dict[int, int] = {}
        self._kind_numbers: dict[tuple, int] = {}
        self._allowed: list[int] = []
        self._crossings: dict[int, np.ndarray] = {}
        self._kind(-1)
        self._reset()

    def _reset(self) -> None:
        self._view_numbers: dict[tuple[int, int], int] = {}
        self._views: list[int] = [0]
        self._states: list[State] = []
        self._numbers: dict[State, int] = {}
        self._table = _Table()
        self._steps: dict[int, tuple[int, int]] = {}
        self._final = np.zeros(1024, np.int8)
        # At the start nothing has been read and no token ends.
        self._number(((0, 0, 0),))

    def _number(self, state: State) -> int:
        """The number of a state, or -1 where it is new and there is no room."""
        number = self._numbers.get(state)
        if number is not None:
            return number
        number = len(self._states)
        if number >= MAX_STATES:
            return -1
        if number == len(self._final):
            self._final = np.concatenate([self._final, np.zeros(number, np.int8)])
        self._states.append(state)
        self._numbers[state] = number
        self._final[number] = state[-1][2]
        return number

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at one end of a token while it is being merged.

        Each with the rank of the merge that takes it up; the token itself is never.
        """
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self._split:
                return out
            until = self._rank[self._split[token]][0]
            token = self._split[token][side]

    def _is_sound(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token; shorter ones are known."""
        if token not in self._split:
            return True
        left, right = self._split[token]
        if not (self._sound[left] and self._sound[right]):
            return False
        last = self._rank[left, right][0]
        for piece, until in self._edge(left, 1):
            for other, until_other in self._edge(right, 0):
                merge = self._rank.get((piece, other))
                if merge is not None and merge[0] < min(until, last) and merge[0] <= until_other:
                    return False
        return True

    def _crossing(self, piece: int) -> np.ndarray:
        """For every token the rank of the first merge of ``piece`` with its beginning.

        Merges go by rank, and a pair's rank is above those of its parts.  So a pair
        across a border is merged if its rank comes before either piece is
        taken up by its own side; of two equal pairs the left one goes first.
        """
        known = self._crossings.get(piece)
        if known is None:
            known = np.full(self._size, np.inf, np.float32)
            for other, rank in self._opened[piece]:
                tokens, until = self._starting.get(other, (None, None))
                if tokens is not None:
                    there = tokens[until >= rank]
                    known[there] = np.minimum(known[there], rank)
            if len(self._opened[piece]) > OFTEN:
                self._crossings[piece] = known
        return known

    def _kind(self, token: int) -> int:
        """A number shared by tokens that allow the same ones to follow.

        ``_allowed`` has those as the bits of a number.
        """
        kind = self._kinds.get(token)
        if kind is None:
            edge = () if token < 0 else tuple(e for e in self._edge(token, 1) if e[0] in self._opened)
            kind = self._kind_numbers.get(edge)
            if kind is None:
                allowed = self._sound.copy()
                for piece, until in edge:
                    allowed &= ~(self._crossing(piece) < until)
                kind = self._kind_numbers[edge] = len(self._allowed)
                self._allowed.append(int.from_bytes(np.packbits(allowed, bitorder="little").tobytes(), "little"))
            self._kinds[token] = kind
        return kind

    def _view(self, bits: int, low: int, node: int) -> int | None:
        """A number for the allowed tokens below ``node``, or None for none.

        ``bits`` has the tokens from ``low`` on.  Equal sets are one, whatever the
        tokens before them were.
        """
        size = self._high[node] - self._low[node]
        mine = (bits >> (self._low[node] - low)) & ((1 << size) - 1)
        if not mine:
            return None
        number = self._view_numbers.setdefault((node, mine), len(self._views))
        if number == len(self._views):
            self._views.append(mine)
        return number

    def advance(self, state: State, byte: int) -> tuple[State, int]:
        """The state after a byte, and by how much the least count rose."""
        onward, ended = [], None
        for node, view, count in state:
            child = self._child.get(node << 8 | byte)
            if child is None:
                continue
            # At the root the view is the kind of the token that ended there.
            bits, low = (self._views[view], self._low[node]) if node else (self._allowed[view], 0)
            token = self._token[child]
            if ended is None and token >= 0 and bits >> (token - low) & 1:
                ended = (0, self._kind(token), count + 1)
            if self._high[child] > self._low[child]:
                below = self._view(bits, low, child)
                if below is not None:
                    onward.append((child, below, count))
        assert ended is not None, "every byte is a token"
        onward.append(ended)
        least = min(count for _, _, count in onward)
        return tuple((node, view, count - least) for node, view, count in onward), least

    def _compile(self, key: int) -> bool:
        state, rise = self.advance(self._states[key >> 8], key & 255)
        to = self._number(state)
        if to < 0:
            return False
        self._table.put(key, to, rise)
        self._steps[key] = (to, rise)
        return True

    def _walk(self, data: bytes, state: int) -> tuple[int, int, bool]:
        """Count of the bytes from a state on, the last state, and whether room ran out."""
        total = 0
        for byte in data:
            key = state << 8 | byte
            if key not in self._steps and not self._compile(key):
                return total, state, True
            state, rise = self._steps[key]
            total += rise
        return total, state, False

    def _slow(self, data: bytes) -> int:
        """The count of one pre-token, state by state, keeping none."""
        state: State = ((0, 0, 0),)
        total = 0
        for byte in data:
            state, rise = self.advance(state, byte)
            total += rise
        return total + state[-1][2]

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token ``data[start : start + length]``."""
        if len(self._states) > MAX_STATES * 7 // 8 or len(self._views) > MAX_VIEWS:
            self._reset()
        order = np.argsort(-lengths, kind="stable")
        first, size = starts[order], lengths[order]
        total = np.zeros(len(order), np.int64)
        state = np.zeros(len(order), np.int32)
        stuck = np.zeros(len(order), bool)
        running = len(order)
        shrinking = -size
        for j in range(int(size[0]) if running else 0):
            running = int(np.searchsorted(shrinking, -j, side="left"))
            if running <= FEW:
                break
            keys = (state[:running].astype(np.int64) << 8) | data[first[:running] + j]
            slots = self._table.find(keys)
            if (slots < 0).any():
                for key in np.unique(keys[slots < 0]).tolist():
                    self._compile(key)
                slots = self._table.find(keys)
                # Out of room: those are counted apart.
                stuck[:running] |= slots < 0
            to, rise = self._table.read(slots)
            lost = slots < 0
            if lost.any():
                to[lost] = 0
            total[:running] += rise
            state[:running] = to
        else:
            running = 0
        for i in range(running):
            # The longest few go on one by one, which costs less than arrays of a few.
            rest = data[first[i] + j : first[i] + size[i]].tobytes()
            more, state[i], lost = self._walk(rest, int(state[i]))
            total[i] += more
            stuck[i] |= lost
        total += self._final[state]
        for i in np.flatnonzero(stuck):
            total[i] = self._slow(data[first[i] : first[i] + size[i]].tobytes())
        out = np.empty_like(total)
        out[order] = total
        return out


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class TokenCounter:
    """Counts by a ``tokenizers`` file with a byte-level BPE vocabulary."""

    #: Characters handled at a time, which bounds memory.
    BLOCK = 1 << 21

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or not split["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normalizer is expected")
        alphabet = _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self._special = [t["content"] for t in spec["added_tokens"]]
        vocabulary = {
            raw(t): n for t, n in spec["model"]["vocab"].items() if t not in self._special
        }
        self._pairs = BytePairs(vocabulary, [(raw(a), raw(b)) for a, b in spec["model"]["merges"]])
        self._splitter = Splitter()
        self._classes = _character_classes()
        self._lead = " " if split["add_prefix_space"] else ""

    def _segments(self, text: str) -> tuple[list[str], int]:
        """What stands between special strings, and how many of those there are."""
        parts, special = [text], 0
        for token in self._special:
            cut = [p.split(token) for p in parts]
            special += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return [p for p in parts if p], special

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        totals = np.zeros(len(texts), np.int64)
        waiting: list[str] = []
        owners: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts, special = self._segments(text)
            totals[i] += special
            for part in parts:
                waiting.append(self._lead + part if self._lead and not part.startswith(" ") else part)
                owners.append(i)
                size += len(part)
            if size >= self.BLOCK:
                self._run(waiting, owners, totals)
                waiting, owners, size = [], [], 0
        self._run(waiting, owners, totals)
        return totals

    def _run(self, segments: list[str], owners: list[int], totals: np.ndarray) -> None:
        if not segments:
            return
        # A separator stands behind each segment and counts as END whatever it is.
        joined = "\n".join(segments) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        classes = self._classes[points]
        classes[ends] = END
        begins = np.flatnonzero(self._splitter.starts(classes))
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        places = begins
        if len(data) != len(points):
            widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            places = (np.cumsum(widths) - widths)[begins]
        lengths = np.diff(places, append=len(data))
        real = classes[begins] != END
        counts = self._pairs.counts(data, places[real], lengths[real])
        segment = np.searchsorted(ends, begins[real])
        np.add.at(totals, np.asarray(owners)[segment], counts)


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """This worker's compiled tokenizer for the file."""
    return TokenCounter(path)
