"""N-best segmentations of text into scored pieces.

The pieces of a SentencePiece model that match a text are the arcs of a lattice
over its characters, and the score of a path is the sum of its pieces' scores.
A forward Viterbi pass gives the best score of every prefix.  From the end
backwards, those are exact heuristics: a suffix whose score is g and which
begins at p can be completed to g plus the best score of the prefix up to p
and no better.  So A-star search from the end finds whole paths in
the order of their scores and expands only suffixes of the paths it returns.

A text is cut where no piece can stand across, and the n best segmentations of the text
are put together from the alternatives of the fragments that lose least.  What a fragment
loses by its second best segmentation is known once the Viterbi passes from both ends are:
it is that of the best path through an arc off the best one.  These passes run over many new
fragments at once, and their results are remembered; only the fragments that can
differ in the n best of a text are searched.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from heapq import heappop, heappush, nsmallest
from math import inf

import numpy as np

SPACE = "▁"

#: What an unknown character scores below the lowest piece; fixed by the library.
UNKNOWN_PENALTY = 10.0

#: Bytes of fragments a worker remembers, about, before it starts anew; lists of alternatives likewise.
CACHE_BYTES = 192 << 20

#: Characters of new fragments that the passes run over at a time.
SLICE = 1 << 19

#: Longer fragments are cut at every place that no piece stands across, not only at spaces.
LONG = 256

#: A line break, or the space before a word with the word, or space at the end.
_FRAGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

#: What remembering a fragment takes beside its characters and ids.
_ENTRY = 300

Path = tuple[float, tuple[int, ...]]


class PieceLattice:
    """Segmentation by the pieces and scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._score: dict[str, tuple[tuple[int, ...], float]] = {}
        self._byte = [0] * 256
        self._text: dict[int, bytes] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self._byte[value] = i
                self._text[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self._score[piece] = ((i,), float(model.get_score(i)))
                self._text[i] = piece.replace(SPACE, " ").encode("utf-8")
        self._longest = max(map(len, self._score))
        self._unknown = min(score for _, score in self._score.values()) - UNKNOWN_PENALTY
        inner = {pair for piece in self._score for pair in zip(piece, piece[1:])}
        # A cut is safe where no piece stands across.
        self._cuts = not any((b == SPACE and a != SPACE) or "\n" in (a, b) for a, b in inner)
        self._inner = inner
        self._lists: dict[tuple[str, int], list[Path]] = {}
        self._lists_bytes = 0
        self._forget()
        self._compile()

    def _forget(self) -> None:
        """Start without remembered fragments."""
        self._number: dict[str, int] = {}
        self._ids: list[bytes] = []
        # Fragments that decoding does not give back.
        self._odd: set[str] = set()
        self._best = np.zeros(1024)
        self._loss = np.zeros(1024)
        self._held = 0

    def _compile(self) -> None:
        """The pieces as a tree of characters: sorted ``state, character`` pairs and where they lead."""
        states = {"": 0}
        steps = []
        for piece in self._score:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(states)
                    steps.append((states[piece[: k - 1]] << 21 | ord(piece[k - 1]), states[piece[:k]]))
        steps.sort()
        self._steps = np.array([k for k, _ in steps], np.int64)
        self._leads = np.array([t for _, t in steps], np.int64)
        self._piece = np.full(len(states), -1, np.int64)
        self._worth = np.zeros(len(states))
        for piece, ((i,), score) in self._score.items():
            self._piece[states[piece]], self._worth[states[piece]] = i, score

    def search(self, text: str, most_paths: int) -> list[Path]:
        """The best segmentations of an escaped text with their scores, best first.

        Of equal scores the one that A-star reaches first, which is the same in
        every run.
        """
        n, piece_of, longest = len(text), self._score.get, self._longest
        ending: list[list[tuple[int, tuple[int, ...], float]]] = [[]]
        best = [0.0]
        for end in range(1, n + 1):
            arcs, most, last = [], -inf, -1
            for begin in range(end - longest if end > longest else 0, end):
                found = piece_of(text[begin:end])
                if found is not None:
                    pieces, score = found
                    arcs.append((begin, pieces, score))
                    last = begin
                    if best[begin] + score > most:
                        most = best[begin] + score
            if last != end - 1:
                # A character that is no piece is written as its bytes.
                data = text[end - 1].encode("utf-8", "surrogatepass")
                arcs.append((end - 1, tuple(self._byte[b] for b in data), self._unknown))
                most = max(most, best[-1] + self._unknown)
            ending.append(arcs)
            best.append(most)
        # Later entries first among equals, so that one path is followed to its end.
        heap: list[tuple[float, int, int, float, tuple | None]] = [(-best[n], 0, n, 0.0, None)]
        entry, found_paths = 0, []
        while heap and len(found_paths) < most_paths:
            _, _, place, behind, path = heappop(heap)
            if place == 0:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                found_paths.append((behind, tuple(ids)))
                continue
            for begin, pieces, score in ending[place]:
                entry -= 1
                total = behind + score
                heappush(heap, (-total - best[begin], entry, begin, total, (pieces, path)))
        return found_paths

    def _alternatives(self, fragment: str, n: int) -> list[Path]:
        key = (fragment, n)
        if key not in self._lists:
            if self._lists_bytes > CACHE_BYTES:
                self._lists.clear()
                self._lists_bytes = 0
            self._lists[key] = self.search(fragment, n)
            self._lists_bytes += _ENTRY + n * 32 * len(fragment)
        return self._lists[key]

    def _remember(self, fragment: str, score: float, loss: float, ids: bytes, same: bool) -> None:
        at = len(self._ids)
        if at == len(self._best):
            self._best, self._loss = np.resize(self._best, 2 * at), np.resize(self._loss, 2 * at)
        self._best[at], self._loss[at] = score, loss
        self._ids.append(ids)
        if not same:
            self._odd.add(fragment)
        self._number[fragment] = at
        self._held += _ENTRY + 4 * len(fragment) + len(ids)

    def _learn_by_search(self, fragment: str) -> None:
        first, *second = self.search(fragment, 2)
        same = self.decode(first[1]) == fragment.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        loss = first[0] - second[0][0] if second else inf
        self._remember(fragment, first[0], loss, array("I", first[1]).tobytes(), same)

    def _arcs(self, codes: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and state of every piece in the text, none of which passes its place's limit."""
        begin, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        for depth in range(self._longest):
            inside = begin + depth < limit[begin]
            begin, state = begin[inside], state[inside]
            step = state << 21 | codes[begin + depth]
            at = np.searchsorted(self._steps, step)
            at[at == len(self._steps)] = 0
            goes = self._steps[at] == step
            begin, state = begin[goes], self._leads[at[goes]]
            whole = self._piece[state] >= 0
            found.append((begin[whole], begin[whole] + depth + 1, state[whole]))
        return tuple(np.concatenate(part) for part in zip(*found))

    def _learn(self, fragments: list[str]) -> None:
        """Best score, loss of the second best and best ids of new, non-empty fragments."""
        lengths = np.fromiter(map(len, fragments), np.int64, len(fragments))
        codes = np.frombuffer("".join(fragments).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        stops = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(fragments)), lengths)
        begin, end, state = self._arcs(codes, stops[owner])
        single = np.zeros(len(codes), bool)
        single[begin[end == begin + 1]] = True
        # A fragment with a character that is no piece is searched.
        plain = np.ones(len(fragments), bool)
        plain[owner[~single]] = False

        # Every fragment has a node before each character and one at its end.
        whose = owner[begin]
        source, target, worth = begin + whose, end + whose, self._worth[state]
        heads = stops - lengths + np.arange(len(fragments))
        tails = heads + lengths

        def viterbi(near: np.ndarray, far: np.ndarray, start: np.ndarray, distance: np.ndarray) -> np.ndarray:
            """The best score from the nodes ``start`` to every node, in order of distance."""
            best = np.full(len(codes) + len(fragments), -inf)
            best[start] = 0.0
            order = np.lexsort((far, distance))
            near, far, worths = near[order], far[order], worth[order]
            edges = np.flatnonzero(np.diff(distance[order], prepend=-1, append=-1))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                values = best[near[low:high]] + worths[low:high]
                first = np.flatnonzero(np.diff(far[low:high], prepend=-1))
                best[far[low:high][first]] = np.maximum.reduceat(values, first)
            return best

        forward = viterbi(source, target, heads, target - heads[whose])
        backward = viterbi(target, source, tails, tails[whose] - source)
        reached = np.flatnonzero(forward[source] + worth == forward[target])
        into = np.zeros(len(forward), np.int64)
        into[target[reached[::-1]]] = reached[::-1]
        on_best = np.zeros(len(begin), bool)
        here = tails[plain]
        while len(here):
            arc = into[here]
            on_best[arc] = True
            here = source[arc]
            here = here[here != heads[whose[arc]]]
        through = forward[source] + worth + backward[target]
        second = np.full(len(fragments), -inf)
        np.maximum.at(second, whose[~on_best], through[~on_best])
        score = forward[tails]
        # Those with a character that is no piece have no score here; they are searched below.
        loss = np.full(len(fragments), inf)
        np.subtract(score, second, out=loss, where=plain & (second > -inf))

        path = np.flatnonzero(on_best)
        path = path[np.argsort(begin[path], kind="stable")]
        ids = self._piece[state[path]].astype("<u4").tobytes()
        offsets = (4 * np.cumsum(np.bincount(whose[path], minlength=len(fragments)))).tolist()
        low = 0
        for k, (fragment, high) in enumerate(zip(fragments, offsets)):
            # Where two are equally good, the search decides which comes first.
            if plain[k] and loss[k] > 1e-6:
                self._remember(fragment, float(score[k]), float(loss[k]), ids[low:high], True)
            else:
                self._learn_by_search(fragment)
            low = high

    def _fragments(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        if not self._cuts:
            return [escaped]
        parts = _FRAGMENT.findall(escaped)
        if len(escaped) > LONG and max(map(len, parts)) > LONG:
            return [piece for part in parts for piece in (self._pieces_apart(part) if len(part) > LONG else (part,))]
        return parts

    def _pieces_apart(self, part: str) -> list[str]:
        """A long fragment cut between characters that no piece joins."""
        cuts = [k for k, pair in enumerate(zip(part, part[1:]), 1) if pair not in self._inner]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])]

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """The bytes of pieces, with the space put before a text still in front."""
        return b"".join(map(self._text.__getitem__, ids))

    def encode(self, text: str | None, n: int) -> list[tuple[float, bytes, bool]]:
        """The ``n`` best segmentations: score, ids as little-endian 32-bit numbers, round trip.

        The last is whether decoding gives the text back, with the space sign
        U+2581, which the encoding cannot tell from a space, read as one.
        """
        (out,) = self.encode_all([text], n)
        return out

    def encode_all(self, texts: list[str | None], n: int) -> list[list[tuple[float, bytes, bool]]]:
        """``encode`` for each of some texts, whose new fragments are learnt together."""
        cut = [self._fragments(text or "") for text in texts]
        if self._held > CACHE_BYTES:
            self._forget()
        new = set().union(*cut).difference(self._number)
        some: list[str] = []
        size = 0
        for fragment in new:
            if len(fragment) > LONG:
                self._learn_by_search(fragment)
                continue
            some.append(fragment)
            size += len(fragment)
            if size >= SLICE:
                self._learn(some)
                some, size = [], 0
        if some:
            self._learn(some)
        return [self._put_together(fragments, n) for fragments in cut]

    def _put_together(self, fragments: list[str], n: int) -> list[tuple[float, bytes, bool]]:
        if not fragments:
            return [(0.0, b"", True)]
        numbers = np.fromiter(map(self._number.__getitem__, fragments), np.int64, len(fragments))
        total = float(self._best[numbers].sum())
        same = self._odd.isdisjoint(fragments)
        parts = [*map(self._ids.__getitem__, numbers.tolist())]
        best = b"".join(parts)
        out = [(total, best, same)]
        if n < 2:
            return out
        # Only the fragments that lose least can differ from the best in the n best.
        losses = self._loss[numbers]
        loose = np.argsort(losses, kind="stable")[: n - 1]
        choices: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        lists = []
        for at in sorted(loose[np.isfinite(losses[loose])].tolist()):
            options = self._alternatives(fragments[at], n)
            lists.append((at, options))
            grown = [
                (loss + options[0][0] - score, (*chosen, k))
                for loss, chosen in choices
                for k, (score, _) in enumerate(options)
            ]
            choices = nsmallest(n, grown)
        starts = {at: sum(map(len, parts[:at])) for at, _ in lists}
        for loss, chosen in choices[1:]:
            pieces, done, back = [], 0, True
            for (at, options), k in zip(lists, chosen):
                if k:
                    pieces += best[done : starts[at]], array("I", options[k][1]).tobytes()
                    done = starts[at] + len(parts[at])
                    wanted = fragments[at].replace(SPACE, " ").encode("utf-8", "surrogatepass")
                    back = back and self.decode(options[k][1]) == wanted
            pieces.append(best[done:])
            out.append((total - loss, b"".join(pieces), same and back))
        return out


@lru_cache(maxsize=2)
def piece_lattice(path: str) -> PieceLattice:
    """This worker's lattice for the file."""
    return PieceLattice(path)
