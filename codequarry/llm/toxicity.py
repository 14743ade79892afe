"""Toxicity: a learned lexicon, fuzzy matching by Levenshtein automata, and context windows.

The lexicon is learned from labelled rows: words and word beginnings that occur in toxic
documents far more often than chance allows. It is kept as a trie. A word of a text that is
no entry itself runs as a Levenshtein automaton against the trie, which finds the entries
within one edit. Matches score by their context: other matches within the window raise a
match, quotation marks around it lower it. A logistic regression over a document's match
scores, fitted on the same labelled rows, gives the final score.

Whole words of two characters or more are learned, and beginnings of 4 to 7 letters (a longer
beginning is met by its first seven). Misspellings are looked for of every entry of four letters
or more but beginnings that need two different words, and those near ordinary words of clean
rows. The weight of a match in quotation marks is set, not learned; what share of the matches
stands in quotations is one of the regression's inputs.

Training takes at most ``max_train`` labelled rows (default 10,000), chosen by hash; every word
of these is weighed. Ids, language, source and labels are never inputs. Without labelled rows
of both kinds the score is the labels' mean, or 0.5.

Defined results: a null or empty text has no matches and the score of that; rows with
repeated or null ids are scored one by one, and of a labelled id one row is learned from, or
none if its labels disagree; empty tables are fine; other columns are passed on, but give way
to made names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, row_columns, whole_row
from .labelled import id_crc, training_rows

WORD = re.compile(r"[^\W_]+")
#: Digits that stand for letters.
_LEET = str.maketrans("013457", "oieast")
#: What opens a quotation and what closes it; the straight mark does either.
_CLOSED_BY, _EITHER = {"«": "»", "“": "”", "„": "“”", "‹": "›"}, "\""
_MARKS = re.compile("[«»“”„‹›\"\n]")
#: Words on each side that a match's context takes in.
WINDOW = 12
#: Least length of a learned word; lengths of learned beginnings; least length of what is met misspelled.
MIN_LENGTH, BEGINNINGS, FUZZY_LENGTH = 2, range(4, 8), 4
SEEN = 300_000
#: Clean documents that hold an entry count so many times against it.
CLEAN_COST = 2


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    entry: int = -1


class Lexicon:
    """Entries (text, kind, strength) as a trie. Kinds: 0 a whole word, 1 a word's beginning,
    2 a beginning that counts only where a text has two different words with it."""

    def __init__(self, entries: list[tuple[str, int, float]], ordinary: frozenset[str] = frozenset(), rigid: frozenset[int] = frozenset()):
        self.entries, self.ordinary, self.rigid = entries, ordinary, rigid
        self.root = Node()
        self.exact: dict[str, int] = {}
        self.beginnings: dict[str, int] = {}
        # One edit leaves one half of an entry as it is: words that have neither are not tried.
        self.halves: set[str] = set()
        for k, (text, beginning, _) in enumerate(entries):
            (self.beginnings if beginning else self.exact)[text] = k
            if len(text) >= FUZZY_LENGTH and k not in rigid and beginning < 2:
                node = self.root
                for c in text:
                    node = node.children.setdefault(c, Node())
                node.entry = k
                half = len(text) // 2
                self.halves.update(("^" + text[:half], "$" + text[half:]) if not beginning else ("^" + text[:half], "+" + text[half:]))
        self.sizes = sorted({(h[0], len(h) - 1) for h in self.halves})
        self.starts = sorted({len(b) for b in self.beginnings})
        self.seen: dict[str, tuple[int, bool] | None] = {}

    def _likely(self, word: str) -> bool:
        for kind, n in self.sizes:
            if kind == "^":
                if "^" + word[:n] in self.halves:
                    return True
            elif kind == "$":
                if "$" + word[-n:] in self.halves:
                    return True
            elif any("+" + word[at : at + n] in self.halves for at in range(max(0, n - 2), n + 2)):
                return True
        return False

    def near(self, word: str) -> int | None:
        """The strongest entry within one edit: the word's Levenshtein automaton, whose state
        is the row of distances to its prefixes, walked along the trie."""
        n, best = len(word), None
        stack = [(self.root, tuple(range(min(n, 2) + 1)) + (2,) * max(0, n - 2))]
        while stack:
            node, row = stack.pop()
            if node.entry >= 0:
                beginning = self.entries[node.entry][1]
                if (min(row) if beginning else row[n]) <= 1 and (best is None or self.entries[node.entry][2] > self.entries[best][2]):
                    best = node.entry
            for c, child in node.children.items():
                new = [min(row[0] + 1, 2)]
                for i in range(n):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (word[i] != c), 2))
                if min(new) <= 1:
                    stack.append((child, tuple(new)))
        return best

    def find(self, word: str) -> tuple[int, bool] | None:
        """(entry, whether exact) of a lower-cased word."""
        if word in self.exact:
            return self.exact[word], True
        for n in self.starts:
            if word[:n] in self.beginnings:
                return self.beginnings[word[:n]], True
        if len(word) < FUZZY_LENGTH - 1 or word in self.ordinary:
            return None
        plain = word.translate(_LEET) if not word.isalpha() and not word.isdigit() else word
        if plain != word and (hit := self.find(plain)):
            return hit[0], False
        if self._likely(plain) and (entry := self.near(plain)) is not None:
            return entry, False
        return None

    def lookup(self, words: set[str]) -> dict[str, tuple[int, bool]]:
        """The matches among the words; what was found for a word is remembered."""
        out, seen = {}, self.seen
        if len(seen) > SEEN:
            seen.clear()
        for w in words:
            if w in seen:
                hit = seen[w]
            else:
                hit = seen[w] = self.find(w)
            if hit:
                out[w] = hit
        return out


def quotations(text: str) -> list[tuple[int, int]]:
    """The text's outermost quotations (first mark, last mark) in order. Marks that open and
    close pair up over any distance, straight ones within a line; what never closes is none."""
    found: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    straight = -1
    for m in _MARKS.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            straight = -1
        elif c == _EITHER:
            if straight >= 0:
                found.append((straight, at))
            straight = at if straight < 0 else -1
        elif (k := next((k for k in reversed(range(len(opened))) if c in _CLOSED_BY[opened[k][0]]), -1)) >= 0:
            found.append((opened[k][1], at))
            del opened[k:]
        elif c in _CLOSED_BY:
            opened.append((c, at))
    outer: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if outer and start < outer[-1][1]:
            outer[-1] = (outer[-1][0], max(end, outer[-1][1]))
        else:
            outer.append((start, end))
    return outer


FEATURES = 5


def features(text: str, lexicon: Lexicon) -> tuple[tuple[float, ...], int]:
    """(features, number of matches): summed and highest window score, score per 100 words,
    share of fuzzy and of quoted matches."""
    lowered = text.lower()
    hits = lexicon.lookup(set(WORD.findall(lowered)))
    together = Counter(entry for entry, _ in hits.values())
    hits = {w: h for w, h in hits.items() if lexicon.entries[h[0]][1] < 2 or together[h[0]] > 1}
    if not hits:
        return (0.0,) * FEATURES, 0
    found, n = [], 0
    quotes, q = quotations(lowered), 0
    # Offsets of the lower-cased text serve for quotes too: marks have no case.
    for m in WORD.finditer(lowered):
        if m[0] in hits:
            entry, exact = hits[m[0]]
            while q < len(quotes) and quotes[q][1] < m.start():
                q += 1
            in_quotes = q < len(quotes) and quotes[q][0] < m.start()
            found.append((n, lexicon.entries[entry][2] * (1.0 if exact else 0.6), exact, in_quotes))
        n += 1
    total = high = 0.0
    first = end = 0
    for at, strength, _, in_quotes in found:
        while found[first][0] < at - WINDOW:
            first += 1
        while end < len(found) and found[end][0] <= at + WINDOW:
            end += 1
        near = end - first - 1
        score = strength * (1 + 0.25 * near) * (0.25 if in_quotes else 1.0)
        total += score
        high = max(high, score)
    k = len(found)
    return (
        math.log1p(total), high, math.log1p(100 * total / n), sum(not f[2] for f in found) / k, sum(f[3] for f in found) / k,
    ), k


@dataclass(frozen=True)
class ToxicModel:
    entries: tuple[tuple[str, int, float], ...]
    ordinary: frozenset[str]
    rigid: frozenset[int]
    weights: tuple[float, ...]

    def lexicon(self) -> Lexicon:
        return Lexicon(list(self.entries), self.ordinary, self.rigid)

    def probability(self, x: tuple[float, ...]) -> float:
        z = self.weights[0] + sum(w * v for w, v in zip(self.weights[1:], x, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def marks_of(text: str, k: int = 16) -> list[int]:
    """The k smallest hashes of the text's runs of four words; copies share most of them."""
    words = WORD.findall(text.lower())
    runs = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    return sorted({zlib.crc32(r.encode()) for r in runs})[:k]


def independent(documents: list[tuple[list[int], list[int]]]) -> list[set[int]]:
    """Documents as (entries, marks), those that share a mark taken together: the words of a
    passage that was copied often are evidence only once."""
    root = list(range(len(documents)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_mark: dict[int, int] = {}
    for i, (_, marks) in enumerate(documents):
        for m in marks:
            root[find(i)] = find(by_mark.setdefault(m, i))
    together: dict[int, set[int]] = {}
    for i, (own, _) in enumerate(documents):
        together.setdefault(find(i), set()).update(own)
    return list(together.values())


def choose_entries(
    listed: list[tuple[str, int, int]], toxic: list[set[int]], clean: int, candidates: int
) -> list[tuple[str, int, float]]:
    """The entries whose share of toxic documents can't be chance.

    listed: (text, kind, clean documents); toxic: the entries of each
    independent toxic document, by their places in ``listed``. Entries that are significant by
    themselves come first; then, among the documents that these leave unexplained, those that
    explain most. Of related entries that do nearly as well, the most specific one is taken.
    """
    chosen: list[int] = []
    taken: set[int] = set()  # the chosen ones' families

    def related(a: int, b: int) -> bool:
        x, y = sorted((listed[a][0], listed[b][0]), key=len)
        return y.startswith(x) and (len(x) >= BEGINNINGS.start or x == y)

    def significant(k: int, t: int, unexplained: int, margin: float) -> bool:
        c = listed[k][2]
        p, rate = t / (t + c), min(0.5, unexplained / (unexplained + clean + 1))
        if p < 0.65 or t < 3:
            return False
        # Chernoff: the chance of t or more of t + c is at most exp(-(t + c) KL(p, rate)).
        kl = p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0)
        return (t + c) * kl > math.log(max(candidates, 2)) + margin

    def add(gain: Counter, good: list[int]) -> bool:
        """The best new family among the good ones, by its most specific member."""
        worth = lambda k: gain[k] - CLEAN_COST * listed[k][2]
        good = [k for k in good if worth(k) > 0 and k not in taken]
        if not good:
            return False
        best = max(good, key=lambda k: (worth(k), listed[k][0]))
        family = [k for k in good if related(k, best) and worth(k) >= 0.9 * worth(best)]
        chosen.append(min(family, key=lambda k: (listed[k][1], -len(listed[k][0]), listed[k][0])))
        taken.update(k for k in range(len(listed)) if related(k, chosen[-1]))
        return True

    every: Counter = Counter(k for own in toxic for k in own)
    strong = [k for k, t in every.items() if significant(k, t, len(toxic), 4)]
    while add(every, strong):
        pass
    while left := [own for own in toxic if own and not any(k in own for k in chosen)]:
        gain: Counter = Counter(k for own in left for k in own)
        if not add(gain, [k for k, t in gain.items() if significant(k, t, len(left), 2)]):
            break
    # What clean documents hold as well counts for less; the regression weighs how often it occurs.
    return [(listed[k][0], listed[k][1], (every[k] / (every[k] + listed[k][2])) ** 3) for k in chosen]


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = np.r_[0.0, np.full(x.shape[1], ridge)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + penalty * w
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(id_crc(id_col), F.lit(4)) == 2


def own_entries(text: str) -> set[str]:
    """What of a text may become an entry: words as they are, beginnings with one mark, and
    with two marks those that two different words of the text have."""
    own = {w for w in WORD.findall(text.lower()) if len(w) >= MIN_LENGTH and not w.isdigit()}
    begun = Counter(w[:n] for w in own if w.isalpha() for n in BEGINNINGS if n <= len(w))
    return own | {b + "*" for b in begun} | {b + "**" for b, n in begun.items() if n > 1}


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 10_000) -> ToxicModel:
    """The model from labelled rows outside the held-out fold, at most ``max_train`` of them."""
    spark = docs.sparkSession
    rows = checkpointed(training_rows(docs, labels, "toxic", held_out(), max_train))
    totals = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        mean = toxic / (toxic + clean) if toxic + clean else 0.5
        return ToxicModel((), frozenset(), frozenset(), (math.log((mean + 1e-3) / (1 - mean + 1e-3)), *(0.0,) * FEATURES))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            by: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(batch["_text"], batch["_y"], strict=True):
                by[y].update(own_entries(text))
            names = list(by[0].keys() | by[1].keys())
            yield pd.DataFrame({"entry": names, "toxic": [by[1][n] for n in names], "clean": [by[0][n] for n in names]})

    counted = checkpointed(
        rows.mapInPandas(count, "entry string, toxic long, clean long")
        .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where("toxic >= 3")
    )
    # No more than the distinct words of max_train rows.
    likely = counted.where(F.col("toxic") >= CLEAN_COST * F.col("clean")).orderBy(F.desc("toxic"), "entry").collect()
    listed = [(r["entry"].rstrip("*"), r["entry"].count("*"), r["clean"]) for r in likely]
    place = spark.sparkContext.broadcast({r["entry"]: k for k, r in enumerate(likely)})

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = place.value
        for batch in batches:
            texts = [t for t, y in zip(batch["_text"], batch["_y"], strict=True) if y]
            own = [sorted({of[e] for e in own_entries(t) if e in of}) for t in texts]
            yield pd.DataFrame({"own": own, "marks": [marks_of(t) for t in texts]})

    # At most max_train rows, each of its own likely entries and 16 marks.
    explaining = rows.where("_y = 1").mapInPandas(explained, "own array<int>, marks array<long>").collect()
    by_document = independent(sorted((list(r["own"]), list(r["marks"])) for r in explaining))
    entries = choose_entries(listed, by_document, clean, counted.count())

    # Words of clean rows that lie within an edit of an entry are ordinary; an entry that
    # meets them in more than 1 of 500 clean rows is matched exactly only.
    draft = spark.sparkContext.broadcast(Lexicon(entries))

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = draft.value
        for batch in batches:
            out = [
                (w, e) for text, y in zip(batch["_text"], batch["_y"], strict=True) if not y
                for w, (e, exact) in lexicon.lookup(set(WORD.findall(text.lower()))).items() if not exact
            ]
            yield pd.DataFrame(out, columns=["word", "entry"])

    # All of them: no more than the distinct words of max_train rows.
    met = rows.mapInPandas(neighbours, "word string, entry int").groupBy("word", "entry").agg(F.count(F.lit(1)).alias("n")).collect()
    per_entry: Counter = Counter()
    for r in met:
        per_entry[r["entry"]] += r["n"]
    rigid = frozenset(e for e, n in per_entry.items() if 500 * n > clean)
    ordinary = frozenset(r["word"] for r in met)
    lexicon = spark.sparkContext.broadcast(Lexicon(entries, ordinary, rigid))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = lexicon.value
        for batch in batches:
            yield pd.DataFrame(
                [(*features(text, own)[0], y) for text, y in zip(batch["_text"], batch["_y"], strict=True)],
                columns=[*(f"x{i}" for i in range(FEATURES)), "y"],
            )

    x = rows.mapInPandas(measure, ", ".join(f"x{i} double" for i in range(FEATURES)) + ", y int").toPandas()
    x = x.sort_values(list(x.columns), kind="stable").to_numpy(np.float64)
    weights = _fit_weights(x[:, :-1], x[:, -1])
    return ToxicModel(tuple(entries), ordinary, rigid, tuple(map(float, weights)))


def score_toxicity(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score, predicted and n_matches."""
    # Chosen entries explain toxic rows of the training set, ordinary words are of its clean rows.
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, n_matches long")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        lexicon = own.lexicon()
        for texts in batches:
            rows = [features(t or "", lexicon) for t in texts.tolist()]
            yield pd.DataFrame([(own.probability(x), n) for x, n in rows], columns=["score", "n_matches"])

    made = ["score", "predicted", "n_matches"]
    return docs.select(whole_row(docs), rate(F.col(text_col)).alias("_rate")).select(
        *row_columns(docs, made),
        F.col("_rate.score").alias("score"),
        F.when(F.col("_rate.score") >= threshold, 1).otherwise(0).alias("predicted"),
        F.col("_rate.n_matches").alias("n_matches"),
    )
