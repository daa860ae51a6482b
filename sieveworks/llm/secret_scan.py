"""Secret scans: fixed patterns, and strings that look random under a battery of tests.

Patterns give the base spans, leftmost and non-overlapping for each kind, in code points.

The method adds spans of kind ``random``.  Candidates are runs of ``[A-Za-z0-9+/_-]`` (with ``=``
padding) of at least ``min_chars`` that no base span overlaps; a run that mixes the signs of both base 64
alphabets is cut at ``-`` and ``_``, and its parts are candidates.  Each gets the smallest encoding that holds
its characters (hexadecimal, base 32, lower-case or full alphanumeric, base 64; plain decimals and
single-case words are none).  The battery asks whether it could be drawn uniformly from that alphabet:
chi-squared uniformity, runs about the alphabet's middle, and lag-one serial correlation, each as a
two-sided p-value, combined by Bonferroni.  A candidate passes if the combined value is at least
``min_random``.

Short strings pass such tests easily, so passing is not enough: under the rival model of ordinary
text the likelihood ratio of the uniform model is an e-value, so
its inverse is a p-value whatever the length: a longer string can reach a smaller one.  The rival model is
fitted to the corpus: the shares of the characters of candidates in all its texts, over a weak prior
(:data:`ORDINARY`), 66 counts that reach the driver.  Within each
length class these p-values, over all candidates of the corpus, go through Benjamini-Hochberg on a
fixed grid of powers of ten, which keeps the share of false discoveries at most ``fdr``.  What
reaches the driver is one count per length class and grid step.  The grid ends at 10**-60: such a value is a
discovery among fewer than 10**58 candidates, so smaller ones change nothing.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written

#: The base patterns and the least length of what they must hold.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet on.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: The prior of the rival model: shares of character classes, uniform inside a class, as of so many characters.
ORDINARY = {LOWER: 0.86, UPPER: 0.08, DIGITS: 0.04, "+/-_": 0.02}
PRIOR_CHARS = 10_000
GRID = 60


@dataclass(frozen=True)
class Battery:
    """``min_chars``: least length of a candidate; shorter strings cannot tell enough."""

    min_random: float = 0.01
    fdr: float = 0.01
    min_chars: int = 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding_of(token: str) -> str | None:
    chars = set(token.rstrip("="))
    if len(chars) < 2 or chars <= set(DIGITS) or chars <= set(LOWER) or chars <= set(UPPER):
        return None
    return next((name for name, alphabet in ENCODINGS.items() if chars <= set(alphabet)), None)


def _normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, encoding: str) -> float:
    """Combined p-value of the hypothesis that the token is uniform over its encoding's alphabet."""
    token, alphabet = token.rstrip("="), ENCODINGS[encoding]
    at = {c: i for i, c in enumerate(alphabet)}
    codes, n, size = [at[c] for c in token], len(token), len(alphabet)
    counts: dict[int, int] = {}
    for c in codes:
        counts[c] = counts.get(c, 0) + 1
    chi = sum(k * k for k in counts.values()) * size / n - n
    df = size - 1
    spread = math.sqrt(2 * df * (n - 1) / n)
    uniform = 0.5 * math.erfc((chi - df) / spread / math.sqrt(2))
    high = [c >= size // 2 for c in codes]
    n1 = sum(high)
    n0 = n - n1
    if n0 and n1:
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _normal((1 + sum(a != b for a, b in zip(high, high[1:])) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    centre = (size - 1) / 2
    var = (size * size - 1) / 12
    serial = _normal(sum((a - centre) * (b - centre) for a, b in zip(codes, codes[1:])) / (var * math.sqrt(n - 1)))
    return min(1.0, 3 * min(uniform, runs, serial))


def rival(counts: dict[str, int]) -> dict[str, float]:
    """Log share of each character in ordinary text, from its counts and the prior."""
    prior = {c: PRIOR_CHARS * share / len(chars) for chars, share in ORDINARY.items() for c in chars}
    total = PRIOR_CHARS + sum(counts.get(c, 0) for c in prior)
    return {c: math.log((counts.get(c, 0) + n) / total) for c, n in prior.items()}


def evidence(token: str, encoding: str, ordinary: dict[str, float]) -> float:
    """-log10 of the p-value against ordinary text: the log likelihood ratio, at least 0."""
    token = token.rstrip("=")
    ratio = -len(token) * math.log(len(ENCODINGS[encoding])) - sum(ordinary[c] for c in token)
    return max(0.0, ratio / math.log(10))


def runs(text: str, least: int) -> Iterator[tuple[int, int]]:
    """Spans of the runs to test."""
    for m in re.finditer(rf"[A-Za-z0-9+/_-]{{{least},}}={{0,2}}", text):
        if re.search("[+/]", m[0]) and re.search("[-_]", m[0]):
            yield from ((m.start() + p.start(), m.start() + p.end()) for p in re.finditer(rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}", m[0]))
        else:
            yield m.span()


def candidates(text: str, base: list[tuple[int, int, str]], how: Battery, ordinary: dict[str, float]) -> list[tuple[int, int, int, int]]:
    """``start, end, length class, evidence step`` of the tested runs; step -1 failed the battery."""
    out = []
    for a, b in runs(text, how.min_chars):
        encoding = None if any(a < e and s < b for s, e, _ in base) else encoding_of(text[a:b])
        if encoding:
            step = min(GRID, int(evidence(text[a:b], encoding, ordinary))) if battery(text[a:b], encoding) >= how.min_random else -1
            out.append((a, b, (b - a).bit_length(), step))
    return out


def character_counts(docs: DataFrame) -> dict[str, int]:
    """How often each character of candidates stands in all texts."""
    known = "".join(ORDINARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    total += np.bincount(np.frombuffer(value.as_buffer(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(list(known)), pa.array([int(total[ord(c)]) for c in known], pa.int64())], names=["c", "n"])

    return {r["c"]: r["n"] for r in docs.select("text").mapInArrow(count, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}


def cutoffs(counts: list[tuple[int, int, int]], how: Battery) -> dict[int, int]:
    """Least evidence step that is a discovery in each length class (Benjamini-Hochberg).

    ``counts``: length class, step, candidates.
    """
    out = {}
    for size in {c for c, _, _ in counts}:
        steps = {s: n for c, s, n in counts if c == size}
        total, found, least = sum(steps.values()), 0, None
        for s in range(GRID, -1, -1):
            found += steps.get(s, 0)
            if found and 10.0**-s * total <= how.fdr * found:
                least = s
        if least is not None:
            out[size] = least
    return out


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("size", pa.int32()), ("step", pa.int32())])
_SCAN = "doc_id long, base array<struct<start:int,stop:int,kind:string>>, found array<struct<start:int,stop:int,size:int,step:int>>"


def scan(docs: DataFrame, how: Battery, ordinary: dict[str, float]) -> DataFrame:
    """Base spans and tested candidates of each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            base, found = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([{"start": a, "stop": b, "kind": k} for a, b, k in spans])
                found.append([dict(zip(("start", "stop", "size", "step"), c)) for c in candidates(text, spans, how, ordinary)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "base", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCAN)


def find_secrets(docs: DataFrame, how: Battery = Battery()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for each row of ``docs``."""
    scanned = written(scan(docs, how, rival(character_counts(docs))), "secret-spans")
    tested = scanned.select(F.explode("found").alias("c")).groupBy("c.size", "c.step").count()
    least = cutoffs([(r["size"], r["step"], r["count"]) for r in tested.collect()], how)

    def kept(c):
        out = F.lit(False)
        for size, step in sorted(least.items()):
            out = out | ((c["size"] == size) & (c["step"] >= step))
        return out

    found = F.filter("found", kept)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def ordered(spans):
        rank = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, "random")) for x in (k, i)])
        return F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], F.element_at(rank, s["kind"]).alias("rank"), s["stop"], s["kind"]))), lambda s: F.struct(s["start"], s["stop"], s["kind"]))

    added = F.transform(found, lambda c: F.struct(c["start"], c["stop"], F.lit("random").alias("kind")))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(ordered(F.concat("base", added))).alias("spans"),
        F.size(found).cast("long").alias("n_random"),
    )


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
