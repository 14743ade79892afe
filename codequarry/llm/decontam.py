"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised (A-Z lower-cased; words of letters, digits and everything beyond
ASCII) and cut into windows of ``window`` consecutive words; an item of fewer words is one
window. All windows go into one automaton. Each document is normalised the same way and
scanned once. Matches come back as word numbers, and in ``contaminated_spans`` as offsets in
the original text: normalising changes no byte's place before separators are closed up, so the
words' places in it are those of the original, counted in code points.

The automaton is built from the items, which stream through the driver: ``block_bytes`` of
window text are a block, which is broadcast and let go before the next one is gathered. Each
block has an automaton of its own; batches of documents, ``BATCH`` characters each, pass them
in turn. So neither driver nor worker ever holds more than one block, however many items there
are; most benchmarks are one.

Defined results: null and empty texts have no words; items without words have no windows;
an item id that repeats counts once; null item ids are left out of the id list; a document
without words is never contaminated; empty tables are fine; other columns are passed on
untouched, but give way to the operator's own names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_columns, whole_row

#: What a byte of UTF-8 becomes. Word characters: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of the lower-cased text.
_TO = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Characters of text that pass the automata at a time, where there are several.
BATCH = 16 << 20

MADE = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO).split() if text else []


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> Iterator[dict[str, tuple]]:
    """The windows of all items as {window: item ids}, block by block; at least one, perhaps empty."""
    block: dict[str, set] = defaultdict(set)
    size = 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        own = windows_of(words_of(row[1]), window)
        cost = sum(map(len, own))
        if size and size + cost > block_bytes:
            yield {w: tuple(ids) for w, ids in block.items()}
            block, size = defaultdict(set), 0
        for w in own:
            # One character per byte: the automaton takes strings.
            block[f" {w.decode('latin-1')} "].add(row[0])
        size += cost
    yield {w: tuple(ids) for w, ids in block.items()}


def _automaton(block: dict[str, tuple]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for w, ids in block.items():
        found.add_word(w, (w.count(" ") - 1, ids))
    found.make_automaton()
    return found


class _Scanner:
    """The automata of a worker; only one is held at a time where there are several."""

    def __init__(self, blocks: list) -> None:
        self.blocks, self.held = blocks, (-1, None)

    def automaton(self, k: int):
        if self.held[0] != k:
            self.held = (-1, None)  # let go first
            self.held = (k, _automaton(self.blocks[k].value))
            # The automaton has it all; a broadcast value would stay for the worker's life.
            self.blocks[k].__dict__.pop("_value", None)
        return self.held[1]

    def scan(self, texts: list[list[bytes]]) -> list[tuple[set[int], set]]:
        """Per document: the numbers of the words hit, and the items."""
        joined = [f" {b' '.join(w).decode('latin-1')} " if w else "" for w in texts]
        out = [(set(), set()) for _ in texts]
        for k in range(len(self.blocks)):
            if not len(self.automaton(k)):
                continue
            iterate = self.automaton(k).iter
            for (hit, items), text in zip(out, joined, strict=True):
                at, word = 0, 0
                for end, (n, ids) in iterate(text):
                    # `end` is the blank after the match's last word; the words up to it:
                    word += text.count(" ", at, end)
                    at = end
                    hit.update(range(word - n, word))
                    items.update(ids)
        return out


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end in it, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    in_word = np.frombuffer(raw.translate(_TO), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, in_word, False]))
    if len(raw) > len(text):
        # The number of characters begun before each byte.
        begun = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        edges = begun[edges]
    return edges[::2], edges[1::2]


def _batches(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    """The texts in runs of ``most`` characters, or of one longer text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def _spans(text: str, hit: set[int]) -> list[dict[str, int]]:
    """Offsets in the original text of each run of hit words."""
    starts, ends = word_places(text)
    words = np.array(sorted(hit))
    first = np.flatnonzero(np.diff(words, prepend=-2) > 1)
    last = np.r_[first[1:] - 1, len(words) - 1]
    return [{"start": a, "end": b} for a, b in zip(starts[words[first]].tolist(), ends[words[last]].tolist(), strict=True)]


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    min_share: int = 20,
    block_bytes: int = 32 << 20,
    with_spans: bool = True,
) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and, if asked for,
    ``contaminated_spans``: (start, end) offsets of the hit runs in the original text.

    A document is contaminated if at least one in ``min_share`` of its words is hit.
    """
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(b) for b in item_blocks(benchmark, window, block_bytes, item_id_col, item_text_col)]

    @F.pandas_udf(
        "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "contaminated_spans array<struct<start:int,end:int>>"
    )
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = _Scanner(blocks)
        # Few texts at a time are held as words; with several automata, as many as make
        # building each again worth it.
        most = BATCH if len(blocks) > 1 else BATCH // 256
        for series in batches:
            rows = []
            for texts in _batches(series.tolist(), most):
                words = [words_of(t) for t in texts]
                for text, own, (hit, items) in zip(texts, words, scanner.scan(words), strict=True):
                    ids = sorted(str(i) for i in items if i is not None)
                    rows.append(
                        (
                            len(own),
                            len(hit),
                            len(items),
                            hashlib.sha256(",".join(ids).encode()).hexdigest(),
                            bool(hit) and min_share * len(hit) >= len(own),
                            _spans(text, hit) if hit and with_spans else [],
                        )
                    )
            yield pd.DataFrame(rows, columns=[*MADE, "contaminated_spans"])

    made = [*MADE, *(["contaminated_spans"] if with_spans else [])]
    return docs.select(whole_row(docs), scan(F.col(text_col)).alias("_scan")).select(
        *row_columns(docs, made), *(F.col(f"_scan.{m}").alias(m) for m in made)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns alone."""
    text = options.pop("text_col", "text")
    judged = mark_contaminated(
        docs.select(whole_row(docs), F.col(text).alias("_text")), benchmark, text_col="_text", with_spans=False, **options
    )
    return judged.where(~F.col("contaminated")).select(*row_columns(docs))
