"""Kernels of the chosen-path join: shingle sets, minwise signatures, tree paths.  numpy only.

A text is lower-cased (A-Z), its words are joined by one space, and each five-word stretch is hashed as a
substring: a polynomial over random byte values modulo 2**64, mixed at the end.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
POSITIONS = 128
SKETCH = 64
_U = np.uint64
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_FACTORS = _rng.integers(1, 2**63, POSITIONS, dtype=_U) * _U(2) + _U(1)
_powers = np.ones(1, _U)
_inverses = np.ones(1, _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            row = np.full(size, _U(base), _U)
            row[0] = 1
            globals()[name] = np.cumprod(row, dtype=_U)
    return _powers[:n], _inverses[:n]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; all words as one shingle if there are fewer than five."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, _U)
    data = np.frombuffer(b" ".join(words), np.uint8)
    powers, inverses = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers[:-1], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    n = max(1, len(starts) - WORDS + 1)
    last = ends[-n:] if len(starts) >= WORDS else ends[-1:]
    first = starts[:n]
    return np.unique(mix((sums[last] - sums[first]) * inverses[first] + _U(len(words) if len(words) < WORDS else 0)))


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set."""
    a = int(mix(grams).sum(dtype=_U))
    b = int(mix(grams ^ _U(0x9E3779B97F4A7C15)).sum(dtype=_U))
    return (a ^ 2**63) - 2**63, (b ^ 2**63) - 2**63


def signature(grams: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the fixed permutations."""
    out = np.full(POSITIONS, 2**64 - 1, _U)
    for i in range(0, len(grams), 4096):
        np.minimum(out, (grams[None, i : i + 4096] * _FACTORS[:, None]).min(axis=1), out=out)
    return out


def sketch(signatures: np.ndarray) -> np.ndarray:
    """One byte of each of the first positions, to estimate similarities."""
    return (mix(signatures[:, :SKETCH]) & _U(255)).astype(np.uint8)


def roots(docs: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Every document at the root of every tree: document numbers and node ids."""
    ids = mix(np.arange(1, trees + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return np.repeat(np.arange(docs), trees), np.tile(ids, docs)


def descend(doc: np.ndarray, node: np.ndarray, signatures: np.ndarray, levels: int, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Follow chosen paths down.  A node chooses one position, or two with probability ``branch``;
    a document goes to the child named by its minwise token at each chosen position."""
    for _ in range(levels):
        draw = mix(node + _U(0xD1B54A32D192ED03))
        place = (draw % _U(POSITIONS)).astype(np.int64)
        two = (draw >> _U(40)) % _U(1024) < _U(int(branch * 1024))
        other = ((draw >> _U(20)) % _U(POSITIONS)).astype(np.int64)
        doc, node, place = np.concatenate([doc, doc[two]]), np.concatenate([node, node[two]]), np.concatenate([place, other[two]])
        node = mix(node * _U(0x9E3779B97F4A7C15) + mix(signatures[doc, place] + place.astype(_U)))
    return doc, node


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b| for sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def look_similar(components: np.ndarray, sketches: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows in different components whose sketches have ``least`` equal bytes or more, and which of
    them make a forest that joins what all of them join, the most similar first."""
    equal = (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2, dtype=np.int16)
    a, b = np.nonzero(np.triu((equal >= least) & (components[:, None] != components[None, :]), 1))
    spans = np.ones(len(a), bool)
    if len(a) > 1:
        best = np.argsort(-equal[a, b], kind="stable")
        spans[:] = False
        spans[best[_forest(components[a[best]].tolist(), components[b[best]].tolist())]] = True
    return a, b, spans


def _forest(us: list[int], vs: list[int]) -> list[int]:
    """Numbers of the edges that join two trees when edges are taken in order."""
    parent: dict[int, int] = {}
    out = []
    left = len({*us, *vs}) - 1
    for k, (u, v) in enumerate(zip(us, vs)):
        while parent.get(u, u) != u:
            u = parent[u]
        while parent.get(v, v) != v:
            v = parent[v]
        if u != v:
            parent[v] = u
            out.append(k)
            left -= 1
            if not left:
                break
    return out


def joining_links(asked: list[tuple[int, int, np.ndarray]], there: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between rows ``(name, component, set)`` of the two lists in different components, as few as
    join what the similar pairs join.

    Intersections of all pairs come from the product of the two incidence matrices, over the shingles
    that occur in more than one place, 2048 at a time.
    """
    sides = asked, there
    sizes = [np.array([len(s) for _, _, s in side]) for side in sides]
    owner = np.concatenate([np.repeat(np.arange(len(side)), n) for side, n in zip(sides, sizes)])
    second = np.repeat([False, True], [n.sum() for n in sizes])
    known, column = np.unique(np.concatenate([s for side in sides for _, _, s in side]), return_inverse=True)
    places = np.bincount(column, minlength=len(known))
    met = np.bincount(column[second], minlength=len(known))
    useful = (met > 0) & (places > met)
    number = np.cumsum(useful) - 1
    use = useful[column]
    column, owner, second = number[column[use]], owner[use], second[use]
    order = np.argsort(column, kind="stable")
    column, owner, second = column[order], owner[order], second[order]
    both = np.zeros((len(asked), len(there)), np.float32)
    for start in range(0, int(useful.sum()), 2048):
        a, b = np.searchsorted(column, (start, start + 2048))
        parts = []
        for side, mine in zip(sides, (~second[a:b], second[a:b])):
            part = np.zeros((len(side), 2048), np.float32)
            part[owner[a:b][mine], column[a:b][mine] - start] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    components = [np.array([c for _, c, _ in side]) for side in sides]
    either = sizes[0][:, None] + sizes[1][None, :] - both
    first, other = np.nonzero((100 * both >= percent * either) & (both > 0) & (components[0][:, None] != components[1][None, :]))
    kept = _forest(components[0][first].tolist(), components[1][other].tolist())
    return [(asked[first[k]][0], there[other[k]][0]) for k in kept]
