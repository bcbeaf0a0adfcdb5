"""Secret scans: three base patterns, and a battery of randomness tests with false-discovery control.

Candidates of the battery are runs of 20 or more characters of the base64 alphabets. The smallest encoding that holds
all characters of a candidate is inferred, and under uniform symbols of that encoding three p-values are taken: chi-squared
over blocks of its alphabet, runs above and below its middle, and lag-1 serial correlation; Fisher's method combines them.

A candidate is called random if the battery doesn't reject it at 0.001 and ordinary text rarely looks as random. How often
it does is learned from decoys, which are made of all ordinary words of all texts: for each length class a document's
words, in order, are joined without a mark, and again with one of the alphabet's marks in turn, and cut into pieces of the
class's least length; only what is left at the end, shorter than that, makes none. A candidate's p-value is the share of
decoys of its length class that look at least as random, and within each class, since short ones give weak tests, the
Benjamini-Hochberg procedure over all candidates of the corpus bounds the false discoveries among those flagged by 0.05.
Both tallies are histograms of fixed size. With few words no share is small enough, and base spans alone remain. What is
flagged and doesn't overlap a base span is a span of kind random.

Spans are whole matches in code points, end exclusive. Cases: a null text is empty; rows are scanned each, whatever
their id; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._shared import Scratch, small_batches, table

#: Kinds in their order, patterns, the group whose length counts, and its least length. Fixed values.
KINDS = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
RANDOM = "random"
#: RE2 patterns that every text with a span of the kind matches.
HINTS = (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", "AKIA[A-Z0-9]{14}", "[0-9a-f]{16}", "[A-Za-z0-9+/_-]{20}")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Length classes by their least lengths, the rate, the battery's level, and the histogram of -log10 p in tenths, up to 30.
CLASSES = (20, 24, 32, 40, 64, 128)
RATE, LEVEL = 0.05, 0.001
#: Most letters of a decoy's words, and what joins them; None is one of the marks in turn.
ORDINARY, JOINTS, MARKS = 19, (b"", None), b"-_/"
BINS, PER_DECADE = 301, 10
#: Decoys tested at once.
PIECES = 4096


def _encodings():
    upper, lower, digits = string.ascii_uppercase, string.ascii_lowercase, string.digits
    return (
        (digits, ("01234", "56789")),
        (digits + "abcdef", ("0123", "4567", "89ab", "cdef")),
        (digits + "ABCDEF", ("0123", "4567", "89AB", "CDEF")),
        (upper + "234567", (upper[:13], upper[13:], "234567")),
        (upper + lower + digits + "+/", (upper[:13], upper[13:], lower[:13], lower[13:], digits + "+/")),
        (upper + lower + digits + "-_", (upper[:13], upper[13:], lower[:13], lower[13:], digits + "-_")),
        (upper + lower + digits + "+/-_", (upper[:13], upper[13:], lower[:13], lower[13:], digits + "+/-_")),
    )


def chi2_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom >= x)."""
    half = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(1.0, math.exp(-half) * total)
    total, term = 0.0, math.sqrt(half) / math.gamma(1.5) if half else 0.0
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return min(1.0, math.erfc(math.sqrt(half)) + math.exp(-half) * total)


def p_random(token: str) -> float:
    """Combined p-value of uniform symbols of the smallest encoding that holds the token."""
    token = token.rstrip("=")
    held = set(token)
    alphabet, blocks = next(e for e in _encodings() if held <= set(e[0]))
    n, size = len(token), len(alphabet)
    expected = [n * len(b) / size for b in blocks]
    chi = sum((sum(map(token.count, b)) - e) ** 2 / e for b, e in zip(blocks, expected))
    x = np.array([alphabet.index(c) for c in token]) - (size - 1) / 2
    high = x > 0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    z_runs = (runs - (n + 1) / 2) / math.sqrt((n - 1) / 4)
    z_serial = float((x[1:] * x[:-1]).sum()) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    ps = (chi2_tail(chi, len(blocks) - 1), math.erfc(abs(z_runs) / math.sqrt(2)), math.erfc(abs(z_serial) / math.sqrt(2)))
    return chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def base_spans(text: str, wanted=(True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    out = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        if wanted[k]:
            flags = re.ASCII | (re.IGNORECASE if k == 0 else 0)
            out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _class(n: int) -> int:
    return int(np.searchsorted(CLASSES, n, side="right")) - 1


def _bin(p: float) -> int:
    return min(BINS - 1, int(-math.log10(max(p, 1e-300)) * PER_DECADE))


def bins_of(tokens: np.ndarray) -> np.ndarray:
    """_bin(p_random(token)) of tokens of one length without a trailing =, each a column of bytes of (length, tokens)."""
    n, count = tokens.shape
    holds = np.zeros(256, np.uint8)
    for k, (alphabet, _) in enumerate(_encodings()):
        holds[np.frombuffer(alphabet.encode(), np.uint8)] |= 1 << k
    held = np.bitwise_and.reduce(holds[tokens], axis=0)
    out = np.zeros(count, np.int64)
    for k, (alphabet, blocks) in enumerate(_encodings()):
        mine = np.flatnonzero(held & ((2 << k) - 1) == 1 << k)
        if not len(mine):
            continue
        chars = tokens if len(mine) == count else tokens[:, mine]
        size, df = len(alphabet), len(blocks) - 1
        twice, block = np.zeros(256, np.int16), np.zeros(256, np.uint64)
        for i, c in enumerate(alphabet.encode()):
            twice[c] = 2 * i - (size - 1)
        for i, b in enumerate(blocks):  # counts of blocks side by side in one number, 12 bits each
            block[np.frombuffer(b.encode(), np.uint8)] = 1 << 12 * i
        sums, chi = block[chars].sum(axis=0, dtype=np.uint64), np.zeros(len(mine))
        for i, b in enumerate(blocks):
            e = n * len(b) / size
            chi += ((sums >> np.uint64(12 * i) & np.uint64(4095)).astype(np.float64) - e) ** 2 / e
        x = twice[chars]
        high = x > 0
        runs = 1 + (high[1:] != high[:-1]).sum(axis=0)
        z_runs = (runs - (n + 1) / 2) / math.sqrt((n - 1) / 4)
        z_serial = np.einsum("ij,ij->j", x[1:], x[:-1], dtype=np.int64) / 4 / ((size * size - 1) / 12) / math.sqrt(n - 1)
        tails = [np.fromiter(map(math.erfc, (abs(z) / math.sqrt(2)).tolist()), np.float64, len(mine)) for z in (z_runs, z_serial)]
        first = np.exp(-chi / 2) * (1 + chi / 2) if df == 4 else np.array([chi2_tail(v, df) for v in chi.tolist()])
        half = -sum(np.log(np.maximum(p, 1e-300)) for p in (first, *tails))
        p = np.minimum(1, np.exp(-half) * (1 + half + half * half / 2))
        out[mine] = np.minimum(BINS - 1, (-np.log10(np.maximum(p, 1e-300)) * PER_DECADE).astype(np.int64))
    return out


def _ordinary(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of ordinary words (runs of a candidate's characters that are up to ORDINARY letters), their lengths and texts."""
    kinds = np.zeros(256, np.int8)
    kinds[list(b"0123456789+/_=-")] = 2
    kinds[list(string.ascii_letters.encode())] = 1
    kind = kinds[values]
    inside = np.zeros(len(kind) + 1, bool)
    inside[:-1] = kind > 0
    begins, ends = inside.copy(), ~inside
    begins[1:] &= ~inside[:-1]
    ends[1:] &= inside[:-1]
    ends[0] = False
    edge = offsets[1:-1]  # a run ends where its text does
    edge = np.unique(edge[(edge > 0) & (edge < len(kind))])
    cut = edge[inside[edge] & inside[edge - 1]]
    begins[cut] = ends[cut] = True
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends)
    other = np.concatenate([[0], np.cumsum(kind == 2)])
    ok = (other[begins] == other[ends]) & (ends - begins <= ORDINARY)
    begins, ends = begins[ok], ends[ok]
    lengths = ends - begins
    at = np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)
    return values[at], lengths, np.searchsorted(offsets, begins, side="right") - 1


def decoys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many decoys of the texts values[offsets[i]:offsets[i+1]] are in each length class and bin."""
    total = np.zeros((len(CLASSES), BINS), np.int64)
    letters, lengths, of = _ordinary(values, offsets)
    if not len(lengths):
        return total
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    last = np.concatenate([first[1:], [len(of)]]) - 1
    for joint in JOINTS:
        gap = 0 if joint is not None else 1
        start = np.cumsum(lengths) - lengths + gap * np.arange(len(lengths))
        joined = np.zeros(int(start[-1] + lengths[-1]), np.uint8)
        joined[np.arange(len(letters)) + np.repeat(gap * np.arange(len(lengths)), lengths)] = letters
        size = start[last] + lengths[last] - start[first]
        for k, n in enumerate(CLASSES):
            pieces = size // n
            place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.repeat(start[first], pieces) + place * n
            for a in range(0, len(begin), PIECES):
                tokens = joined[np.arange(n)[:, None] + begin[None, a : a + PIECES]]
                marks = np.frombuffer(MARKS, np.uint8)[place[a : a + PIECES] % len(MARKS)]
                total[k] += np.bincount(bins_of(np.where(tokens == 0, marks, tokens)), minlength=BINS)
    return total


def _scan(batches):
    span = pa.list_(pa.int32())
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string()).fill_null("")
        hints = np.array([pc.match_substring_regex(texts, h).to_numpy(zero_copy_only=False) for h in HINTS])
        base, loose = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
        for i in np.flatnonzero(hints.any(axis=0)).tolist():
            text = texts[i].as_py()
            base[i] = [x for s in base_spans(text, hints[:3, i]) for x in s]
            if hints[3, i]:
                for m in re.finditer(CANDIDATE, text):
                    loose[i] += [m.start(), m.end(), _class(m.end() - m.start()), _bin(p_random(m[0]))]
        values, offsets = W.utf8(batch.column(1))
        total = np.zeros(len(CLASSES) * BINS, np.int64)
        for a, b in W.pieces(offsets):
            total += decoys(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).ravel()
        cells = np.flatnonzero(total)
        # The tally of a batch is kept in its first row: cell, count and so on.
        tallies = pa.array([np.column_stack([cells, total[cells]]).ravel().tolist(), *[None] * (len(texts) - 1)][: len(texts)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(loose, span), tallies], ["doc_id", "base", "loose", "decoys"])


def limits(candidates: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], rate: float = RATE, level: float = LEVEL) -> list[int]:
    """For each length class the number of bins that are flagged, from the most random on: (class, bin) to count.

    The p-value of a bin is (1 + decoys at least as random) / (1 + decoys of the class).
    """
    out = []
    for k in range(len(CLASSES)):
        n, m = (sum(v for (c, _), v in x.items() if c == k) for x in (candidates, decoys))
        found = like = flagged = 0
        for b in range(min(BINS, int(-math.log10(level) * PER_DECADE))):
            found, like = found + candidates.get((k, b), 0), like + decoys.get((k, b), 0)
            if found and (1 + like) / (1 + m) <= rate * found / n:
                flagged = b + 1
        out.append(flagged)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row, and n_random."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "secrets")
    kind = dict(docs.dtypes)["doc_id"]
    found = scratch.save(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, base array<int>, loose array<int>, decoys array<long>"), "found")

    def tally(batches):
        total = np.zeros((2, len(CLASSES) * BINS), np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, 4)
            total[0] += np.bincount(x[:, 2] * BINS + x[:, 3], minlength=total.shape[1])
            cells = batch.column(1).flatten().to_numpy().reshape(-1, 2)
            np.add.at(total[1], cells[:, 0], cells[:, 1])
        which, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(at), pa.array(total[which, at])], ["which", "at", "n"])

    counts = found.select("loose", "decoys").mapInArrow(tally, "which long, at long, n long").groupBy("which", "at").agg(F.sum("n").alias("n")).collect()
    flagged = limits(*({divmod(r["at"], BINS): r["n"] for r in counts if r["which"] == k} for k in (0, 1)))
    names = [k[0] for k in KINDS] + [RANDOM]

    def judge(batches):
        for batch in batches:
            rows = []
            for base, loose in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
                more = [(s, len(KINDS), e) for s, e, c, b in (loose[i : i + 4] for i in range(0, len(loose), 4)) if b < flagged[c] and not any(s < y and x < e for x, _, y in base)]
                text = [",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in (base, base + more)]
                rows.append([sum(k == j for _, k, _ in base) for j in range(3)] + [hashlib.sha256(text[0].encode()).hexdigest(), text[1], len(more)])
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return found.mapInArrow(judge, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
