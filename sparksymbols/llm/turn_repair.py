"""The cheapest edits that make a conversation's roles take turns: a dynamic programme over states, in blocks.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. Four states say what has been read: nothing,
a system turn, a user turn, a whole exchange. Going back from the end, a vector holds for each state what the rest
costs; only differences between the four matter for the next step, and those take a few values (``VECTORS``). So a
vector is a small number here, and what a row does to it is looked up in ``STEPS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

from sparksymbols.llm import files
from sparksymbols.session import ship_with_tasks

ship_with_tasks(__name__)
ship_with_tasks(files.__name__)

START, SYSTEM, USER, PAIR = range(4)
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: Row codes: three times the place of the role's initial in ``INITIALS``, plus the fault.
INITIALS = "sua"
OTHER = len(INITIALS)
FINE, CUT, GONE = range(3)
#: Where an initial leads from each state, and where the one turn leads that may be added there.
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): PAIR, (PAIR, 1): USER}
GROWN = (USER, USER, PAIR, USER)
ROLE_INTO = {USER: "user", PAIR: "assistant"}
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
FINAL = (0, 2 * INSERT, INSERT, 0)


def options(after: tuple[int, ...], code: int, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row: letter, cost with all that follows, state behind it; in the order of the letters."""
    initial, fault = divmod(code, 3)
    out = [("D", DELETE + after[state], state)]
    if fault != GONE:
        more = TRUNCATED if fault == CUT else 0
        kept = NEXT.get((state, initial))
        if kept is not None:
            out.append(("K", KEEP + more + after[kept], kept))
        out.append(("R", REROLE + more + after[GROWN[state]], GROWN[state]))
    return out


def back(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """Costs before a row from those behind it; turns may be added before the row."""
    plain = [min(cost for _, cost, _ in options(after, code, state)) for state in range(4)]
    grown = plain
    for _ in range(2):
        grown = [min(plain[state], INSERT + grown[GROWN[state]]) for state in range(4)]
    return tuple(grown)


def cheapest(after: tuple[int, ...], code: int, state: int) -> tuple[str, int]:
    """The ASCII-least letters for a row, added turns before it included, and the state behind it."""
    here, letters = back(after, code), ""
    while True:
        fits = {letter: to for letter, cost, to in options(after, code, state) if cost == here[state]}
        if "D" not in fits and INSERT + here[GROWN[state]] == here[state]:
            letters, state = letters + "I", GROWN[state]
            continue
        letter = min(fits)
        return letters + letter, fits[letter]


def _vectors() -> list[tuple[int, ...]]:
    """All vectors, least cost taken off, that any rows can lead to from the end."""
    found = [FINAL]
    for vector in found:
        for code in range(3 * (OTHER + 1)):
            new = back(vector, code)
            new = tuple(cost - min(new) for cost in new)
            if new not in found:
                found.append(new)
    return found


VECTORS = _vectors()
#: By code and vector: the vector before the row, and for each state the letters and the state behind the row.
STEPS = [
    [
        (VECTORS.index(tuple(cost - min(back(v, code)) for cost in back(v, code))), tuple(cheapest(v, code, state) for state in range(4)))
        for v in VECTORS
    ]
    for code in range(3 * (OTHER + 1))
]


def code_of(initial: str, fault: int) -> int:
    return 3 * (INITIALS.find(initial) if initial and initial in INITIALS else OTHER) + fault


def walk(codes: bytes, last: int = 0, state: int = START) -> Iterator[tuple[str, int]]:
    """For each row its letters and the state behind it, from the vector behind the ``last`` row.

    Vectors are kept at every square root of the rows only; a block's own are made again when the walk comes to it.
    """
    size = max(1, math.isqrt(len(codes)))
    marks = [last]
    vector = last
    for at in range(len(codes) - 1, 0, -1):
        vector = STEPS[codes[at]][vector][0]
        if at % size == 0:
            marks.append(vector)
    for start in range(0, len(codes), size):
        block = codes[start : start + size]
        behind = [marks.pop()]
        for code in reversed(block[1:]):
            behind.append(STEPS[code][behind[-1]][0])
        for code in block:
            letters, state = STEPS[code][behind.pop()][1][state]
            yield letters, state


def through(codes: bytes) -> tuple[list[int], list[int]]:
    """What a run of rows does, for each vector behind it: the vector before it, and by state the state behind it."""
    vectors = list(range(len(VECTORS)))
    states = [[START, SYSTEM, USER, PAIR] for _ in VECTORS]
    for code in reversed(codes):
        steps = STEPS[code]
        states = [[ends[to] for _, to in steps[v][1]] for v, ends in zip(vectors, states, strict=True)]
        vectors = [steps[v][0] for v in vectors]
    return vectors, [state for ends in states for state in ends]


def closing(state: int) -> str:
    """Letters that end a conversation from a state."""
    return {SYSTEM: "II", USER: "I"}.get(state, "")


def lines(letters: str, state: int, role: str, text: str) -> Iterator[tuple[str, str, str]]:
    """The turns that letters leave of a row and before it: letter, role, text."""
    for letter in letters:
        if letter == "D":
            continue
        into = GROWN[state] if letter != "K" else NEXT[state, INITIALS.index(role[0])]
        yield letter, role if letter == "K" else ROLE_INTO[into], "" if letter == "I" else text
        state = into


def cost_of(letters: str, code: int) -> int:
    cost = sum({"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[letter] for letter in letters)
    return cost + (TRUNCATED if code % 3 == CUT and letters[-1:] in ("K", "R") else 0)


def illegal_pairs(codes: Iterable[int], before: int | None = None) -> int:
    """Adjacent roles that may not follow each other; ``before`` is the code of the row ahead of the first."""
    count = 0
    for code in codes:
        if before is not None and (before // 3, code // 3) not in LEGAL_PAIRS:
            count += 1
        before = code
    return count


def sha256_of(texts: Iterable[str]) -> str:
    digest = hashlib.sha256()
    for at, text in enumerate(texts):
        digest.update(b"\n" * (at > 0) + text.encode("utf-8", "surrogatepass"))
    return digest.hexdigest()


def sha256_of_sections(paths: Iterable[str], block: int = 1 << 20) -> str:
    """The hash of files one after the other, joined by newlines, read a block at a time."""
    digest = hashlib.sha256()
    for at, path in enumerate(paths):
        system, inner = files.filesystem(path)
        digest.update(b"\n" * (at > 0))
        with system.open_input_stream(inner, compression=None) as stream:
            while piece := stream.read(block):
                digest.update(piece)
    return digest.hexdigest()
