"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind
`random`: runs of LEAST or more characters of the base64 alphabets that overlap no base
span. A maximal run is cut at each inner "=" (`name=token`); a piece is tested whole and in the runs
between "-" and "_", between "+" and "/", and between all four, as a token stands in a path or after a
name. Of runs that overlap, the likeliest is kept; as at most OVER tests lie over a place, a part
pays a factor of OVER. A run's encoding is the smallest alphabet that holds it. Against uniform draws from
that alphabet it must pass three tests at level PASS: chi-squared uniformity, runs (changes between
character classes) and lag-one serial correlation. Such a pass says little for a short run,
so each run also gets the probability that word-like text looks as random: the lower
tail of chi-squared under the letter frequencies of prose, and the upper tail of the class
changes at the rate of prose, joined by Fisher's method. Both shrink with the length. All runs of
the corpus are one family: Benjamini-Hochberg at level FDR with weights in proportion to length
(at most MAX_WEIGHT), scaled to a mean of 1 over the family, on a histogram of BINS log-probabilities, which is all that
reaches the driver. Runs of decimal digits are tested like others, but digits have no letter frequencies or class changes to
tell them from prose: only very long ones are found.

One scan of the text, no shuffle of it; offsets are code points. Edge cases: null or empty text has
no spans; rows repeat as they come; extra columns are ignored; with no runs the cut is 0 and
nothing is added.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow, documents, stored

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Holds every run of HEX and every candidate.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST, PASS, FDR, MAX_WEIGHT = 20, 1e-4, 0.01, 4.0
BINS, BIN = 30_000, 0.01
#: Tests over one place: the piece, and the runs between the separators of each of SPLITS.
SPLITS = [re.compile(r"[^-_]+"), re.compile(r"[^+/]+"), re.compile(r"[^-_+/]+")]
PIECE = re.compile(r"[^=]+(?:=+\Z)?")
OVER = 1 + len(SPLITS)
#: Of prose: sum of squared letter frequencies, and class changes for each character.
PROSE_SQUARES, PROSE_CHANGES = 0.066, 0.08

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    ("decimal", _DIGIT),
    ("hex", _DIGIT + "abcdef"),
    ("HEX", _DIGIT + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGIT + _LOWER),
    ("BASE36", _DIGIT + _UPPER),
    ("base62", _DIGIT + _LOWER + _UPPER),
    ("base64", _UPPER + _LOWER + _DIGIT + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGIT + "-_"),
]
_PLACE = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS}


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _poisson_tail(k: int, rate: float) -> float:
    """P(X >= k)."""
    if k <= 0:
        return 1.0
    term, total = math.exp(-rate), 0.0
    for i in range(k):
        total += term
        term *= rate / (i + 1)
    if total < 1 - 1e-9:
        return 1 - total
    total = 0.0
    while term > 1e-300 and term > total * 1e-12:
        total += term
        k += 1
        term *= rate / (k)
    return max(total, 1e-300)


def _class(c: str) -> int:
    return 0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3


def encoding(run: str) -> tuple[str, int] | None:
    """Name and size of the smallest alphabet that holds the run, padding apart."""
    chars = set(run.rstrip("="))
    return next(((name, len(a)) for name, a in ALPHABETS if chars <= _PLACE[name].keys()), None) if chars else None


def battery(run: str) -> tuple[list[float], float]:
    """Probabilities of the three tests under uniform draws; -log10 that prose looks as random."""
    kind = encoding(run)
    if kind is None:
        return [0.0, 0.0, 0.0], 0.0
    name, k = kind
    run = run.rstrip("=")
    n, place = len(run), _PLACE[name]
    squares = sum(c * c for c in Counter(run).values())
    chi = squares * k / n - n
    spread = 2 / (9 * (k - 1))  # Wilson and Hilferty: the cube root of chi-squared is nearly normal, far into the tail
    uniform = 1 - _normal((math.cbrt(max(0.0, chi) / (k - 1)) - (1 - spread)) / math.sqrt(spread))
    classes = [_class(c) for c in run]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    sizes = Counter(_class(c) for c in place)
    rate = 1 - sum((s / k) ** 2 for s in sizes.values())
    spread = math.sqrt(max(1e-9, (n - 1) * rate * (1 - rate)))
    runs = math.erfc(abs(changes - (n - 1) * rate) / spread / math.sqrt(2))
    x = [place[c] for c in run]
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    serial = math.erfc(abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / var) * math.sqrt(n) / math.sqrt(2)) if var else 0.0
    shift = n * max(0.05, PROSE_SQUARES * k - 1)
    p = max(1e-300, _normal((chi - (k - 1) - shift) / math.sqrt(2 * (k - 1) + 4 * shift)))
    q = max(1e-300, _poisson_tail(changes, PROSE_CHANGES * n))
    half = -math.log(p) - math.log(q)  # Fisher: chi-squared with 4 degrees, whose upper tail is exp(-half) (1 + half)
    return [uniform, runs, serial], max(0.0, (half - math.log1p(half)) / math.log(10))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    out = []
    if WORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out


def candidates(text: str, a: int, b: int, starts: list[int], ends: list[int]) -> list[tuple[int, int, float]]:
    """Of a piece [a, b) without inner "=": runs that overlap neither a base span nor each other, with -log10 p over its weight.

    starts: of the base spans, ascending; ends: the greatest end up to each.
    """
    tried = {(a, b): 0.0}
    for split in SPLITS:
        for m in split.finditer(text, a, b):
            tried.setdefault(m.span(), math.log10(OVER))
    found = []
    for (x, y), price in tried.items():
        if y - x < LEAST or ((i := bisect_left(starts, y)) and ends[i - 1] > x):
            continue
        tests, logp = battery(text[x:y])
        passed = min(tests) >= PASS
        found.append((max(0.0, logp + math.log10(min(MAX_WEIGHT, (y - x) / LEAST)) - price) if passed else 0.0, x, y))
    out: list[tuple[int, int, float]] = []
    for logp, x, y in sorted(found, key=lambda f: (-f[0], f[1], -f[2])):
        i = bisect_left(out, (x,))
        if (i == 0 or out[i - 1][1] <= x) and (i == len(out) or y <= out[i][0]):
            out.insert(i, (x, y, logp))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Base spans (start, kind, end) in order; candidates (start, end, -log10 p over its weight)."""
    base, runs = base_spans(text), []
    for m in RUN.finditer(text):
        a, b = m.span()
        base += [(h.start(), 2, h.end()) for h in HEX.finditer(text, a, b)]
        if b - a >= LEAST:
            runs.append((a, b))
    base.sort()
    starts, ends, out = [h[0] for h in base], list(accumulate((h[2] for h in base), max)), []
    for a, b in runs:
        for m in PIECE.finditer(text[a:b]):
            out += candidates(text, a + m.start(), a + m.end(), starts, ends)
    return base, out


SCANNED = "doc_id long, base array<struct<start:int,kind:int,end:int>>, runs array<struct<start:int,end:int,logp:double>>"


def scanned(docs: DataFrame) -> DataFrame:
    """Per row of docs its base spans and candidate runs (SCANNED)."""
    arrow(docs.sparkSession)
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    runs_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("logp", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs = [], []
            for text in batch.column(1):
                b, r = scan(text.as_py() or "")
                base.append([{"start": x, "kind": y, "end": z} for x, y, z in b])
                runs.append([{"start": x, "end": y, "logp": z} for x, y, z in r])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_type), pa.array(runs, runs_type)], ["doc_id", "base", "runs"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCANNED)


def cut(found: DataFrame) -> float:
    """Benjamini-Hochberg over all runs: the least weighted -log10 p that counts as a discovery."""
    place = F.least(F.floor(F.col("r.logp") / BIN), F.lit(BINS - 1)).cast("int")
    weight = F.least(F.lit(MAX_WEIGHT), (F.col("r.end") - F.col("r.start")) / F.lit(float(LEAST)))
    rows = found.select(F.explode("runs").alias("r")).groupBy(place.alias("bin")).agg(F.count("*"), F.sum(weight)).collect()
    n, total = np.zeros(BINS, np.int64), 0.0
    for b, c, w in sorted(rows):
        n[b] = c
        total += w  # the probabilities are over weights of any mean; their sum in place of the number scales them to mean 1
    at_least = n[::-1].cumsum()[::-1]
    ok = (np.arange(BINS) > 0) & (at_least > 0) & (10.0 ** -(np.arange(BINS) * BIN) * total <= FDR * at_least)
    return float(np.flatnonzero(ok).min() * BIN) if ok.any() else float("inf")


def secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random)."""
    found = stored(scanned(docs), "secrets")
    least = cut(found)
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    new = F.transform(F.filter("runs", lambda r: r["logp"] >= F.lit(least)), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", new)).alias("spans"), F.size(new).cast("long").alias("n_random"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))
