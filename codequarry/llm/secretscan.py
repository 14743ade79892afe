"""Secret scan: fixed patterns, and strings that look random rather than written.

Character Markov models - transition probabilities between characters - are trained from
labelled samples, one on random strings and one on ordinary identifiers. A run of key
characters whose log-likelihood ratio per character is high enough is a secret of kind
``markov``. Runs of digits alone, and runs without digits whose letters are all of one case,
are not judged. The patterns' spans (kinds ``assign``, ``access``, ``hex``) always stay; the
model adds those that overlap none of them.

Defined results: a null or empty text has no spans; offsets are code points, ends exclusive;
spans are ordered by start, then kind as listed in ``KINDS``; rows pass one by one, so
repeated rows and ids don't matter; other columns are passed on, but give way to made names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_columns, whole_row

KINDS = ("assign", "access", "hex", "markov")

# The contract's patterns. Runs of [0-9a-f] and of [A-Z0-9] are taken whole, so
# asking for their least length at once finds the same spans as dropping short ones after.
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What the model judges: runs of key characters with a digit or a change of case inside.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = {c: i for i, c in enumerate(ALPHABET)}

MADE = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    found.sort()
    return found


def _judged(run: str) -> bool:
    if run.isdigit():
        return False
    return any(c.isdigit() for c in run) or run not in (run.lower(), run.upper())


class Markov:
    """First-order character model with add-one smoothing: log P(next | this)."""

    def __init__(self, samples: Iterable[str]) -> None:
        n = len(ALPHABET)
        # One more state for the start of a string.
        count = [[1.0] * n for _ in range(n + 1)]
        for s in samples:
            before = n
            for c in s:
                if (code := _CODE.get(c)) is not None:
                    count[before][code] += 1
                    before = code
        self.log = [[math.log(x / sum(row)) for x in row] for row in count]


class SecretModel:
    """Ratio of two Markov models; ``threshold`` in nats per character, set on the samples so
    that at most one in 2,000 ordinary identifiers exceeds it."""

    def __init__(self, samples: Iterable[tuple[str, int]]) -> None:
        random_ones, ordinary = [], []
        for text, label in samples:
            (random_ones if label else ordinary).append(text)
        held_out = ordinary[::5]
        a, b = Markov(random_ones), Markov(x for i, x in enumerate(ordinary) if i % 5)
        self.ratio = [[x - y for x, y in zip(r, s, strict=True)] for r, s in zip(a.log, b.log, strict=True)]
        self.threshold = 0.0
        ranked = sorted((self.score(x) for x in held_out), reverse=True)
        if ranked:
            self.threshold = max(0.4, ranked[len(ranked) // 2000] + 0.05)

    def score(self, text: str) -> float:
        """Log-likelihood ratio per character: above 0, rather random."""
        total, before = 0.0, len(ALPHABET)
        for c in text:
            code = _CODE[c]
            total += self.ratio[before][code]
            before = code
        return total / max(1, len(text))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [
            m.span()
            for m in _RUN.finditer(text)
            if _judged(m[0]) and self.score(m[0]) >= self.threshold
        ]


#: Parts of ordinary identifiers, for the training samples.
_PARTS = (
    "get set is has add remove update create delete find list read write open close load save parse format build make "
    "user name id key value type index count size length data item node file path line text word page table column row "
    "request response client server session config option default error message status code time date start end first "
    "last next prev current total max min sum avg handler manager service factory provider context result query filter "
    "event action state model view controller util helper test case main run init main version document language source "
    "the and that with this from have been they their there which would about could other were these than some time"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """Training samples by rule: (string, 1) random keys, (string, 0) ordinary identifiers
    in the usual spellings, long words and numbers among them."""
    rng = random.Random(seed)
    letters = ALPHABET[:52]
    alphabets = (ALPHABET[:52], ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), 1) for _ in range(n)]
    for _ in range(4 * n):
        parts = rng.choices(_PARTS, k=rng.randint(2, 6))
        style = rng.randrange(6)
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            s = "-".join(parts)
        elif style == 3:
            s = "/".join(parts)
        elif style == 4:
            s = "".join(parts)
        else:
            s = "_".join(parts).upper()
        if rng.random() < 0.3:
            s += rng.choice(["", "_", "-"]) + str(rng.randrange(10 ** rng.randint(1, 6)))
        out.append((s, 0))
    # Made-up words: pairs of a consonant and a vowel, so that unknown vocabularies pass too.
    vowels = "aeiou"
    for _ in range(n):
        s = "".join(rng.choice(letters[:26]) + rng.choice(vowels) for _ in range(rng.randint(4, 12)))
        out.append((s + rng.choice(["", str(rng.randrange(100))]), 0))
    return out


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    samples: list[tuple[str, int]] | None = None,
) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans
    (``kind:start:end``, comma-joined). ``samples``: (string, 1 random or 0 ordinary)."""
    spark = docs.sparkSession
    # Two tables of about 70 x 70 numbers.
    model = spark.sparkContext.broadcast(SecretModel(samples or labelled_samples()))

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = model.value
        for series in batches:
            rows = []
            for text in series.tolist():
                text = text or ""
                base = base_spans(text)
                said = ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in base])
                extra = [(a, 3, b) for a, b in judge.spans(text) if not any(a < e and s < b for s, _, e in base)]
                every = ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + extra)]) if extra else said
                kinds = [k for _, k, _ in base]
                rows.append(
                    (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said.encode()).hexdigest(), every)
                )
            yield pd.DataFrame(rows, columns=list(MADE))

    return docs.select(whole_row(docs), scan(F.col(text_col)).alias("_scan")).select(
        *row_columns(docs, MADE), *(F.col(f"_scan.{m}").alias(m) for m in MADE)
    )
