"""Pre-tokenisation without regex: codepoint classes, a nine-state transducer and an associative scan.

The transducer splits text as the pattern of byte-level BPE vocabularies does
(contractions, optional leading space with a run of letters, digits or other marks, white space).
A transition writes two marks: a token starts at this position, or one starts at the position before.
Text of any length is cut into equal chunks. Each chunk's effect is a map from entry state to exit
state; maps compose associatively, so a parallel prefix scan over chunks gives every entry state and
all chunks are then walked side by side.
"""

from __future__ import annotations

import numpy as np
import tiktoken

LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, STMD, RV, ELL, EEE, END = range(11)
BEGIN, IN_L, IN_N, IN_O, IN_S, IN_W, Q0, QRV, QL = range(9)
STATES, WIDTH = 9, 16
HERE, BEFORE = 1, 2

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def codepoint_classes() -> np.ndarray:
    """Class of every code point, built once a process from Unicode's general categories."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([b]): b for b in range(256)}
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            # the characters come from the library whose results are to be met, so both know the same version of Unicode
            found = bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
            table[np.frombuffer(found.decode().encode("utf-32-le"), np.uint32)] = kind
        table[WHITE_SPACE] = WHITE
        table[0x20] = SPACE
        for chars, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EEE)):
            table[[ord(c) for c in chars]] = kind
        _classes = table
    return _classes


def _transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for state * WIDTH + class."""
    letters = (LETTER, STMD, RV, ELL, EEE)
    go, mark = np.zeros(STATES * WIDTH, np.uint8), np.zeros(STATES * WIDTH, np.uint8)

    def put(state, kinds, to, marks):
        for kind in kinds:
            go[state * WIDTH + kind], mark[state * WIDTH + kind] = to, marks

    def fresh(state, extra=0):
        """As at the start of a match: every class opens a token."""
        put(state, letters, IN_L, HERE | extra)
        for kind, to in ((NUMBER, IN_N), (OTHER, IN_O), (SPACE, IN_S), (WHITE, IN_W), (QUOTE, Q0), (END, BEGIN)):
            put(state, [kind], to, HERE | extra)

    fresh(BEGIN)
    for state, kinds in ((IN_L, letters), (IN_N, [NUMBER]), (IN_O, [OTHER, QUOTE])):
        fresh(state)
        put(state, kinds, state, 0)
    # the last blank before a visible character leaves its run; a space then joins the next token
    for state, extra in ((IN_S, 0), (IN_W, HERE)):
        fresh(state)
        put(state, [SPACE], IN_S, 0)
        put(state, [WHITE], IN_W, 0)
        put(state, letters, IN_L, BEFORE | extra)
        put(state, [NUMBER], IN_N, BEFORE | extra)
        put(state, [OTHER], IN_O, BEFORE | extra)
    put(IN_S, [QUOTE], IN_O, BEFORE)
    put(IN_W, [QUOTE], Q0, BEFORE | HERE)
    # an apostrophe that may open a contraction
    fresh(Q0)
    put(Q0, [OTHER, QUOTE], IN_O, 0)
    put(Q0, [STMD], BEGIN, 0)
    put(Q0, [RV], QRV, 0)
    put(Q0, [ELL], QL, 0)
    for state, last in ((QRV, EEE), (QL, ELL)):
        fresh(state, BEFORE)
        put(state, letters, IN_L, BEFORE)
        put(state, [last], BEGIN, 0)
    return go, mark


GO, MARK = _transducer()


def compose_prefix(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps, one column a chunk, in log2 rounds."""
    out, step = maps.copy(), 1
    while step < out.shape[1]:
        out[:, step:] = np.take_along_axis(out[:, step:], out[:, :-step], axis=0)
        step *= 2
    return out


def token_starts(kinds: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Positions at which a token, or an END separator, starts in an array of classes."""
    n = len(kinds)
    if not n:
        return np.zeros(0, np.int64)
    lanes = -(-n // chunk)
    grid = np.full(lanes * chunk, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    # every entry state at once, until all of a chunk's paths have met in all chunks
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], lanes, axis=1)
    for k in range(chunk):
        maps = GO[(maps << 4) | grid[k]]
        if k % 8 == 7 and len(maps) > 1 and (maps == maps[0]).all():
            maps = maps[:1]
    entry = np.zeros(lanes, np.uint8)
    if len(maps) == 1:
        entry[1:] = maps[0, :-1]
    else:
        entry[1:] = compose_prefix(maps)[BEGIN, :-1]
    marks = np.empty((chunk, lanes), np.uint8)
    for k in range(chunk):
        at = (entry << 4) | grid[k]
        marks[k], entry = MARK[at], GO[at]
    marks = marks.T.reshape(-1)[: n + 1] if n < lanes * chunk else np.append(marks.T.reshape(-1), 0)
    starts = (marks[:n] & HERE) != 0
    starts |= (marks[1 : n + 1] & BEFORE) != 0
    return np.flatnonzero(starts)


def slices(texts: list[str]) -> tuple[str, list[int], list[int], np.ndarray]:
    """All texts joined, starts and ends of their tokens in it, and the number of tokens of each text."""
    joined = "\n".join(texts) + "\n"
    kinds = codepoint_classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kinds[ends] = END
    starts = token_starts(kinds)
    stops = np.append(starts[1:], len(joined))
    real = kinds[starts] != END
    starts, stops = starts[real], stops[real]
    per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
    return joined, starts.tolist(), stops.tolist(), per_text


def portions(texts: list[str], chars: int = 2_000_000):
    """Ranges of consecutive texts of about that many characters, so that memory stays bounded."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > chars:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


class SliceCache(dict):
    """Values of slices met before, in two generations of bounded size; subclasses give the value of a slice's bytes."""

    most, longest = 400_000, 64

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def __missing__(self, piece: str):
        found = self.older.get(piece)
        if found is None:
            found = self.value(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found
