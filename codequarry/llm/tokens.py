"""Token ids from tokenizer files, with the library's results in a fraction of its time.

A text is cut where the file's own pre-tokenizer always cuts (single blanks and line breaks
between other characters), and the ids of each piece are kept, so the library sees each
distinct piece once per worker - thousands of them in a call. Of a group of texts Arrow finds
the distinct pieces and gathers their ids, so Python sees each once. Texts for which
that cut isn't certain - unusual white space, scripts beyond the Latin blocks, combining
marks, strings of special tokens - go through the library whole. Tests hold both ways
against each other.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Distinct pieces that a task keeps, about 75 MB. Between tasks a worker keeps the short ones,
#: which recur most.
KEPT_PIECES, SHORT = 300_000, 9  # with the blank before
#: Runs of marks that are kept, and the marks.
KEPT_TAILS, MARKS = 10_000, string.punctuation
#: Characters that are cut at once (one text at least), pieces that go to the library in a call,
#: and those of them that stand side by side in one of its texts.
GROUP_CHARS, CALL, JOINED = 2_000_000, 8_192, 64

# Beyond U+024F, or control separators that engines class differently.
_BEYOND = re.compile(r"[^\x00-\x1b\x20-ɏ]")
#: White space other than blank and line break among the first 256 characters.
_ODD_SPACE = ("\t", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_ODD_BYTES = "".join(_ODD_SPACE).encode("latin-1")


def _plain(text: str) -> bool:
    """Only characters up to U+024F, blanks and line breaks as the only white space."""
    try:
        raw = text.encode("latin-1")
        return len(raw.translate(None, _ODD_BYTES)) == len(raw)
    except UnicodeEncodeError:
        return not _BEYOND.search(text) and not any(c in text for c in _ODD_SPACE)


class FastTokenizer:
    """``each(texts)`` and ``ids(text)``: the ids as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        # The tasks are the threads; the library's own would only compete with them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pre = self.tokenizer.pre_tokenizer
        # Which pieces are safe depends on the file: blanks kept with the next word, or all dropped.
        sample = tuple(s for s, _ in pre.pre_tokenize_str("a b\nc")) if pre else ()
        self.kind = {("a", "Ġb", "Ċ", "c"): "blank-first", ("a", "b", "c"): "dropped"}.get(sample)
        # What stands between pieces whose ends their tokens don't show: one token. Pieces that hold it go alone.
        self.between = {"blank-first": "\n", "dropped": " |"}.get(self.kind, "")
        mark = self._encode([self.between.strip(" ")]).tolist() if self.kind else []
        if len(mark) != 1:
            self.kind = None
        self.mark = mark[0] if mark else -1
        # By id: the token begins a piece, or ends a word.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.kind == "blank-first":
            self.edge[[i for token, i in vocabulary.items() if token.startswith(("Ġ", "Ċ"))]] = True
        elif self.suffix:
            self.edge[[i for token, i in vocabulary.items() if token.endswith(self.suffix)]] = True
        self.folds = self.kind == "dropped" and self.whole("ÀÉ a") == self.whole("àé A")
        self.held: dict[str, bytes] = {}  # pieces, each with the blank or line break before it
        self.tails: dict[str, bytes] = {}  # runs of marks after a word

    def _encode(self, texts: list[str]) -> np.ndarray:
        """Ids of texts one after the other, without the places in the text that nothing here reads."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, "<u4") for e in found])

    def whole(self, text: str) -> bytes:
        return self._encode([text]).tobytes()

    def _tail(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) >= KEPT_TAILS:
                self.tails.clear()
            self.tails[tail] = self.whole(tail)
        return self.tails[tail]

    def _keep(self, pieces: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        raw, at = ids.tobytes(), (bounds * 4).tolist()
        own = [raw[a:b] for a, b in pairwise(at)]
        assert len(own) == len(pieces), "pieces and their ids don't match"
        self.held.update(zip(pieces, own, strict=True))

    def _learn_by_edge(self, pieces: list[str]) -> None:
        """Pieces side by side, as they stand in a text; their tokens show where one begins or ends."""
        for k in range(0, len(pieces), CALL):
            some = pieces[k : k + CALL]
            ids = self._encode(["".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)])
            edges = np.flatnonzero(self.edge[ids])
            self._keep(some, ids, np.append(edges, len(ids)) if self.kind == "blank-first" else np.append(0, edges + 1))

    def _learn_by_mark(self, pieces: list[str]) -> None:
        """Pieces of "dropped" that are no single words, with the mark after each."""
        for k in range(0, len(pieces), CALL):
            some = pieces[k : k + CALL]
            ids = self._encode([self.between.join([*some[i : i + JOINED], ""]) for i in range(0, len(some), JOINED)])
            marks = np.flatnonzero(ids == self.mark)
            self._keep(some, np.delete(ids, marks), np.append(0, marks - np.arange(len(marks))))

    def _learn(self, missing: list[str]) -> None:
        words: dict[str, None] = {}
        marked, mixed = [], []
        for p in missing:
            if p[1:].isalpha():
                words[p] = None
                continue
            # A word and the marks after it are tokens of their own.
            base = p.rstrip(MARKS)
            if base[1:].isalpha():
                marked.append((p, base))
                if base not in self.held:
                    words[base] = None
            elif self.between.strip(" ") in p[1:]:
                self.held[p] = self.whole(p)
            else:
                mixed.append(p)
        if self.kind == "blank-first":
            self._learn_by_edge([*words, *mixed])
        else:
            (self._learn_by_edge if self.suffix else self._learn_by_mark)([*words])
            self._learn_by_mark(mixed)
        for p, base in marked:
            self.held[p] = self.held[base] + self._tail(p[len(base) :])

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        own = list(map(self.held.get, pieces))
        missing = [p for p, ids in zip(pieces, own, strict=True) if ids is None]
        if not missing:
            return own
        if len(self.held) + len(missing) > KEPT_PIECES:
            self.held.clear()
            missing = pieces
        self._learn(missing)
        return list(map(self.held.__getitem__, pieces))

    def _certain(self, text: str) -> bool:
        """The text may be cut."""
        if self.kind is None or "<|" in text or not _plain(text):
            return False
        if self.kind == "dropped":
            return "İ" not in text
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n")

    def _cut(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts that may be cut: each distinct piece is looked up once, and its ids gathered to its places."""
        if self.kind == "dropped":
            # The file lower-cases anyway; for these blocks as Python does.
            raws = [(t.lower() if self.folds else t).replace("\n", " ").encode() for t in texts]
            first, skip = b" ", 0
        else:
            raws = [t.encode() for t in texts]
            first, skip = b"\n", 4  # the line break set before a text goes again, one id
        flat = first + first.join(raws)
        data = np.frombuffer(flat, np.uint8)
        places = np.flatnonzero((data == 32) | (data == 10))
        bounds = np.append(places, len(flat)).astype(np.int64)
        cut = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(bounds), pa.py_buffer(flat)).dictionary_encode()
        own = pa.array(self._pieces(cut.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(cut.indices)
        _, ends, ids = own.buffers()
        starts = np.cumsum([0] + [len(r) + 1 for r in raws])
        at = np.frombuffer(ends, np.int64)[: len(own) + 1][np.searchsorted(places, starts)]
        ids = memoryview(ids or b"")
        for a, b in pairwise(at.tolist()):
            yield bytes(ids[a + skip : b])

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        certain = [bool(t) and self._certain(t) for t in texts]
        cut = self._cut([t for t, sure in zip(texts, certain, strict=True) if sure]) if any(certain) else iter(())
        for text, sure in zip(texts, certain, strict=True):
            yield next(cut) if sure else self.whole(text) if text else b""

    def each(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of every text in turn; no text as an empty one."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def ids(self, text: str) -> bytes:
        return next(self.each([text]))


_held: dict[str, FastTokenizer] = {}


@contextmanager
def tokenizer(path: str) -> Iterator[FastTokenizer]:
    """The worker's tokenizer of this file, for one task. Workers outlive tasks and serve
    other operators as well, so the rarer pieces that a task has gathered go at its end."""
    if path not in _held:
        _held.clear()
        _held[path] = FastTokenizer(path)
    own = _held[path]
    try:
        yield own
    finally:
        short = {p: ids for p, ids in own.held.items() if len(p) <= SHORT}
        own.held.clear()
        if len(short) <= KEPT_PIECES // 2:
            own.held.update(short)
        pa.default_memory_pool().release_unused()


def public_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
