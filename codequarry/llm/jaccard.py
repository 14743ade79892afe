"""N-gram Jaccard join by T-occurrence search (DivideSkip), exact.

Two documents link when the Jaccard similarity of their sets of word n-grams reaches the
threshold. Documents of equal sets form a class, and one of them searches for all.

1. Candidates. A set of n grams differs from any partner in at most H(n) grams. The gram space
   is cut by hash into more than H parts (their number depends on the size band), so partners
   agree in at least one part as a whole. Each class emits the hashes of its parts; classes
   with a part in common are candidates. That is exact: no pair that links is missed. Parts
   of several grams seldom agree by chance, even between documents that share passages.
2. Part hashes are range-partitioned with the class as a second key, so a part that very many
   classes share spreads over partitions; each run of a part names its first class the pivot
   of all its classes, and runs that cross a border share one pivot. All classes of a pivot
   are a block; classes that link have a pivot in common. (Blocks aren't chained any further:
   chains of chance agreements would grow with the corpus.)
3. Blocks also hold classes that met by chance, over passages that many texts share, and those
   grow faster than the corpus. So sketches move before sets do: a bit for each residue of the
   gram hashes, set where an odd number of grams has it, one or two bits a gram. Two sets
   differ in at least as many grams as their sketches in bits; a class whose sketch leaves it
   no partner in a block goes from it. That is exact too: both ends of a link stay in all
   blocks that they share.
4. In a block, inverted lists of grams are searched for every class, by DivideSkip: the
   longest lists are set aside, the short ones go through a heap, and what the heap brings up
   often enough is looked for in the long lists by binary search, shortest first, until it
   can't reach the required overlap any more. What reaches it is a link. A class is searched
   against the classes before it, so a pair is met once; a link that several blocks find
   counts in that of the smallest common pivot. Blocks beyond ``block_grams`` are split into
   shares, and each pair of shares is a group of its own, so no task holds a whole block.

Only classes in what is left of blocks ever move with their sets. Links give components, whose id is the
smallest document id. Very common sets meet their class without a shuffle by it
(``join_counted``).

Defined results: null and empty texts, or texts without words, have empty sets and link with
nothing; a text with fewer words than n is one gram; every row is a document of its own, also
where ids repeat or are null (rows are then numbered, and kept in the shared folder for that);
a null id is reported as it is and never is a component's id unless all are null; an empty
table gives an empty result; of other columns none is read by ``link_documents``, all are
passed on by ``drop_near_copies``.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, checkpointed, join_counted, partitions, row_columns, whole_row
from .components import components

_TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

#: Sizes of a band differ by this factor at most; parts beyond H, as a share of it.
BAND, SLACK = 1.5, 0.06
#: Rows up to which a table of ids, or of classes with their blocks, is sent to every task
#: (about 100 bytes a row); beyond that both sides are shuffled.
BROADCAST_ROWS = 250_000
#: Grams and classes of a share; beyond ``MANY`` shares of a block, shares grow with it, as each
#: is paired with every other.
BLOCK_GRAMS, BLOCK_CLASSES, MANY = 60_000, 600, 64
#: Grams and classes of a share when sketches are compared, and words of sketches compared at once.
SKETCH_GRAMS, SKETCH_CLASSES, CELLS = 4_000_000, 1_500, 1 << 21
#: Bytes of a batch that goes to a Python worker. Spark's own bound is 64 MB, which the executor holds
#: twice while the batch grows, and the worker again for as long as it reads the batch.
BATCH_BYTES = 4 << 20
#: DivideSkip's constant: what a probe costs against an entry that goes through the heap.
MU = 0.0005
#: Long lists probed between two looks at which candidates can still link.
PROBES = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _K[0]
    x ^= x >> np.uint64(29)
    x *= _K[1]
    return x ^ (x >> np.uint64(32))


def grams(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word n-grams."""
    from xxhash import xxh64_intdigest

    if not text:
        return np.zeros(0, np.uint64)
    # bytes.split cuts at [\x20\x09-\x0D], as the contract does.
    found = text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _K[2] + h[k : len(h) - n + 1 + k] * _K[3] + np.uint64(k))
    return np.unique(out)


def sketch(own: np.ndarray) -> bytes:
    """Which residues an odd number of grams has, as bits; their number is a power of two, 64 at least."""
    bits = max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Threshold:
    """Similarity num/den in whole numbers."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.bands = [1]
        ratio = max(BAND, 1.05 * den / num)
        while self.bands[-1] < 1 << 40:
            self.bands.append(max(self.bands[-1] + 1, int(self.bands[-1] * ratio)))

    def links(self, a, b, both):
        return self.den * both >= self.num * (a + b - both)

    def able(self, a, b, differ):
        """Whether sets of a and b grams that differ in ``differ`` or more may link."""
        fit = self.num * np.maximum(a, b) <= self.den * np.minimum(a, b)
        return fit & (differ <= a + b - 2 * -(-self.num * (a + b) // (self.num + self.den)))

    def differ(self, n: int) -> int:
        """The most grams in which a set of n and any linked one differ."""
        return (n + n * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def overlap(self, n: int) -> int:
        """The least overlap of a set of n with any linked one."""
        return -(-self.num * n // self.den)

    def parts(self, band: int) -> int:
        most = self.differ(self.bands[band + 1] - 1)
        return most + 1 + max(1, int(SLACK * most)) if most else 0

    def signatures(self, own: np.ndarray) -> np.ndarray:
        """Hashes of the parts of a set, for its band and every lower one it has partners in."""
        n = len(own)
        if not n:
            return np.zeros(0, np.uint64)
        band = int(np.searchsorted(self.bands, n, "right")) - 1
        # In the own band partners may be larger; in lower ones they are below its border.
        mixed, out, most = _mixed(own), [], self.differ(n)
        while band >= 0:
            if m := self.parts(band):
                part = ((mixed >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
                total = np.zeros(m, np.uint64)
                np.add.at(total, part, mixed * _K[3])
                tokens = _mixed(total * _K[2] + (np.arange(m, dtype=np.uint64) + np.uint64(band << 40)) * _K[1])
                filled = np.bincount(part, minlength=m) > 0
                # With more filled parts than differing grams, one that agrees is filled;
                # otherwise it may be an empty one, and those are emitted as well.
                out.append(tokens[filled] if int(filled.sum()) > most else tokens)
            band -= 1
            border = self.bands[band + 1] - 1
            if band < 0 or self.num * n > self.den * border:
                break
            most = (n + border) * (self.den - self.num) // (self.den + self.num)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Index:
    """Inverted lists over the sets of a block, each in ascending order of the members."""

    def __init__(self, sets: list[np.ndarray], threshold: Threshold) -> None:
        self.t, self.m = threshold, len(sets)
        self.size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(self.m), self.size)
        self.grams, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.lists = owner[order]
        self.length = np.bincount(inverse, minlength=len(self.grams))
        self.begin = np.cumsum(self.length) - self.length
        # Gram and document as one ascending number, for binary probes.
        self.keys = inverse[order].astype(np.int64) * self.m + self.lists

    def _probe(self, lists: np.ndarray, members: np.ndarray) -> np.ndarray:
        """How many of the lists hold each member, by binary search."""
        wanted = (lists[:, None] * self.m + members[None, :]).ravel()
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[place] == wanted).reshape(len(lists), len(members)).sum(0)

    def search(self, own: np.ndarray, before: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(members, overlaps) that link with the set, the set itself among them if indexed;
        only members below number ``before`` if that is given."""
        none = np.zeros(0, np.int64)
        n, need = len(own), self.t.overlap(len(own))
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        at = at[self.grams[at] == own].astype(np.int64)
        if before is None:
            begin, length = self.begin[at], self.length[at]
        else:
            begin = self.begin[at]
            length = np.searchsorted(self.keys, at * self.m + before) - begin
            filled = length > 0
            at, begin, length = at[filled], begin[filled], length[filled]
        if len(at) < need:
            return none, none
        order = np.argsort(length, kind="stable")
        at, begin, length = at[order], begin[order], length[order]
        # DivideSkip: that many lists, the longest, are set aside.
        aside = min(need - 1, int(need / (MU * np.log2(length[-1] + 1) + 1)))
        short = len(at) - aside
        runs = [self.lists[b:e].tolist() for b, e in zip(begin[:short].tolist(), (begin + length)[:short].tolist(), strict=True)]
        found, count, last, times, least = [], [], -1, 0, need - aside
        for member in heapq.merge(*runs):
            if member == last:
                times += 1
                continue
            if times >= least:
                found.append(last)
                count.append(times)
            last, times = member, 1
        if times >= least:
            found.append(last)
            count.append(times)
        members, both = np.array(found, np.int64), np.array(count, np.int64)
        # Overlap that each candidate needs by its own size; those too small or large need more than there is.
        wanted = -(-self.t.num * (n + self.size[members]) // (self.t.den + self.t.num))
        for k in range(short, len(at), PROBES):
            able = both + (len(at) - k) >= wanted
            members, both, wanted = members[able], both[able], wanted[able]
            if not len(members):
                return none, none
            both = both + self._probe(at[k : k + PROBES], members)
        linked = self.t.links(self.size[members], n, both)
        return members[linked], both[linked]


def _by_length(sizes: list[int], sketches: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, sizes, sketches as rows of 64-bit words) for each length of sketches."""
    places: dict[int, list[int]] = {}
    for k, one in enumerate(sketches):
        places.setdefault(len(one), []).append(k)
    n = np.array(sizes, np.int64)
    return [
        (np.array(at), n[at], np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), -1)) for at in places.values()
    ]


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The sketches as they would be with that many words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def partners(
    a: tuple[list[int], list[bytes]], b: tuple[list[int], list[bytes]] | None, threshold: Threshold
) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``a``, and which of ``b``, may link with one of the others by sizes and sketches;
    without ``b`` those of ``a`` are compared among themselves."""
    within = b is None
    b = a if within else b
    met_a, met_b = np.zeros(len(a[0]), bool), np.zeros(len(b[0]), bool)
    others = _by_length(*b)
    for at, n, rows in _by_length(*a):
        for to, m, columns in others:
            words = min(rows.shape[1], columns.shape[1])
            x, y = _folded(rows, words), _folded(columns, words)
            step = max(1, CELLS // (len(y) * words))
            for k in range(0, len(x), step):
                here = slice(k, k + step)
                differ = np.bitwise_count(x[here, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                able = threshold.able(n[here, None], m[None, :], differ)
                if within:
                    able &= at[here, None] != to[None, :]
                met_a[at[here]] |= able.any(1)
                met_b[to] |= able.any(0)
    return met_a, met_b


class _Roots:
    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)


class Member:
    """A class in a block: its node, documents, set, and the pivots of all its blocks."""

    __slots__ = ("node", "weight", "own", "pivots")

    def __init__(self, node: int, weight: int, own: bytes, pivots: list[int]) -> None:
        self.node, self.weight, self.own = node, weight, np.frombuffer(own, np.uint64)
        self.pivots = sorted(pivots)


def _search_block(
    pivot: int, index: list[Member], queries: Iterator[Member] | None, threshold: Threshold
) -> Iterator[tuple[int, int, int]]:
    """(node, a node that it links with or itself, documents linked with it) of a block, or of
    a pair of its shares; what has no link is left out. Without queries the members ask
    themselves, each for those before it; queries are none of the members."""
    weights = np.array([m.weight for m in index], np.int64)
    leads = np.array([m.pivots[0] == pivot for m in index])
    inverted = Index([m.own for m in index], threshold)
    roots = _Roots(len(index))
    links, met = np.zeros(len(index), np.int64), np.zeros(len(index), bool)

    def counted(q: Member, found: np.ndarray) -> np.ndarray:
        """Those links that no block of a smaller common pivot counts."""
        if q.pivots[0] == pivot or not len(found):
            return found
        sure, others = leads[found], set(q.pivots)
        for k in np.flatnonzero(~sure).tolist():
            sure[k] = next(p for p in index[found[k]].pivots if p in others) == pivot
        return found[sure]

    for i, q in enumerate(index if queries is None else queries):
        found, _ = inverted.search(q.own, i if queries is None else None)
        if not len(found):
            continue
        own = counted(q, found)
        met[found] = True
        links[own] += q.weight
        if queries is None:
            met[i] = True
            links[i] += weights[own].sum()
            for j in found.tolist():
                roots.join(i, j)
        else:
            # A query from another share: one edge to each local component it meets.
            yield q.node, q.node, int(weights[own].sum())
            first, *rest = found.tolist()
            yield q.node, index[first].node, 0
            for j in rest:
                roots.join(first, j)
    for i in np.flatnonzero(met).tolist():
        yield index[i].node, index[roots.find(i)].node, int(links[i])


#: The session's bound on the bytes of a batch, and its units.
_BATCH, _UNITS = "spark.sql.execution.arrow.maxBytesPerBatch", {"": 0, "k": 10, "m": 20, "g": 30}


def _batched(df: DataFrame) -> DataFrame:
    """``checkpointed``, with batches of at most ``BATCH_BYTES`` and a row, or less if the session says so."""
    conf = df.sparkSession.conf
    before = conf.get(_BATCH, None)
    said = re.fullmatch(r"(\d+)([kmg]?)b?", (before or "").strip().lower())
    if said and 0 < int(said[1]) << _UNITS[said[2]] <= BATCH_BYTES:
        return checkpointed(df)
    conf.set(_BATCH, str(BATCH_BYTES))
    try:
        return checkpointed(df)
    finally:
        if before is None:
            conf.unset(_BATCH)
        else:
            conf.set(_BATCH, before)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches; each becomes Python values when its turn comes, not a batch at a time."""
    for batch in batches:
        columns = batch.columns
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _numbered(docs: DataFrame, id_col: str, text_col: str, rows: bool = False) -> tuple[DataFrame, bool]:
    """(_id, _text, _rid and, if asked for, _row): every row under a number of its own. Whole
    ids that are unique and known serve as numbers; otherwise rows are numbered once, and kept."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *([whole_row(docs)] if rows else []))
    whole = source.schema["_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    unique = whole and source.groupBy("_id").count().where("count > 1 OR _id IS NULL").isEmpty()
    if unique:
        return source.withColumn("_rid", F.col("_id").cast("long")), True
    return checkpointed(source.withColumn("_rid", F.monotonically_increasing_id())), False


def _link(source: DataFrame, unique: bool, words: int, threshold: Threshold, block_grams: int) -> DataFrame:
    """(_id, _rid, n, component_id, n_links, stays) of the numbered rows; of each component one
    row stays: that of the smallest id (known ones first), of equal ids that of the smallest number."""
    spark = source.sparkSession
    id_type = source.schema["_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh128_digest

        for batch in batches:
            sizes, marks, sketches, parts = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = grams(text, words)
                sizes.append(len(own))
                marks.append(xxh128_digest(own.tobytes()))
                sketches.append(sketch(own))
                parts.append(threshold.signatures(own).view(np.int64))
            offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(sketches, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64())),
                ],
                ["_id", "_rid", "n", "mark", "sketch", "parts"],
            )

    said = source.select("_id", "_text", "_rid")
    measured = _batched(said.mapInArrow(measure, f"_id {id_type}, _rid long, n long, mark binary, sketch binary, parts array<long>"))
    filled = measured.where("n > 0")
    # Classes of equal sets; the smallest row number of a class is its node.
    first = lambda rid: F.struct(F.col("_id").isNull().alias("unknown"), F.col("_id").alias("id"), rid.alias("rid"))
    order = {} if unique else {"first": F.min(first(F.col("_rid")))}
    classes = filled.groupBy("mark").agg(
        F.min("_rid").alias("node"), F.min("_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"),
        *(c.alias(name) for name, c in order.items()),
    )
    if unique:
        classes = classes.withColumn("first", F.struct(F.lit(False).alias("unknown"), F.col("rep").alias("id"), F.col("node").alias("rid")))
    classes = checkpointed(classes)
    total = classes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    placed_rows = join_counted(filled.select("_id", "_rid", "n", "mark"), classes.select("mark", "node", "weight"), ["mark"], "weight", total)
    empty = measured.where("n = 0").select("_id", "_rid", "n", F.lit(None).cast("long").alias("node"))
    members = checkpointed(placed_rows.select("_id", "_rid", "n", "node").unionByName(empty))
    others = members.where("node <> _rid").select("_rid")
    emitted = (
        filled.select("_rid", "parts")
        .join(_small(others, others.count()), "_rid", "left_anti")
        .select(F.explode("parts").alias("part"), F.col("_rid").alias("node"))
    )
    pairs = _chains(emitted, partitions(spark))
    # A pivot's block holds the pivot and all classes of its runs.
    blocks = checkpointed(
        pairs.select("a", F.col("b").alias("node")).unionByName(pairs.select("a", F.col("a").alias("node"))).distinct()
    )
    sketched = blocks.join(filled.select(F.col("_rid").alias("node"), "n", "sketch"), "node")
    blocks = _sieve(_with_shares(sketched, blocks.count(), SKETCH_GRAMS, SKETCH_CLASSES), threshold, partitions(spark))
    n_blocks = blocks.count()
    sized = blocks.join(classes.select("node", "n", "weight"), "node")
    placed = checkpointed(
        _with_shares(sized, n_blocks, block_grams, BLOCK_CLASSES)
        .groupBy("node", "weight")
        .agg(F.collect_list(F.struct(F.col("a").alias("pivot"), "shares")).alias("blocks"))
    )
    linked = _search(source, placed, n_blocks, threshold, words, partitions(spark))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    labels = checkpointed(components(linked.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    smallest = checkpointed(
        labels.join(classes.select("node", "rep", "first"), "node")
        .groupBy("label")
        .agg(F.min("rep").alias("cid"), F.min("first").alias("keep"), F.count(F.lit(1)).alias("held"))
    )
    found = join_counted(labels, smallest, ["label"], "held", labels.count()).select("node", "cid", "keep").join(counts, "node", "left")
    per_node = classes.select("node", "rep", "first", "weight").join(found, "node", "left").select(
        "node",
        "weight",
        F.least("rep", "cid").alias("component_id"),
        F.coalesce("keep", "first")["rid"].alias("keep"),
        (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    known = join_counted(members.where("node IS NOT NULL"), checkpointed(per_node), ["node"], "weight", total)
    alone = members.where("node IS NULL").select(
        "_id", "_rid", "n", F.col("_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays")
    )
    return known.select(
        "_id", "_rid", "n", F.coalesce("component_id", "_id").alias("component_id"), "n_links", (F.col("keep") == F.col("_rid")).alias("stays")
    ).unionByName(alone)


def link_documents(
    docs: DataFrame,
    words: int = 5,
    similarity: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
    block_grams: int = BLOCK_GRAMS,
) -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id and n_links (rows that
    link with it)."""
    source, unique = _numbered(docs, id_col, text_col)
    return _link(source, unique, words, Threshold(*similarity), block_grams).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links"
    )


def _chains(emitted: DataFrame, tasks: int) -> DataFrame:
    """(a, b): each class of a part's run with the run's pivot, its first class."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot, opened = None, 0, False

        def rows(parts: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            columns = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (parts, a, b)]
            return pa.RecordBatch.from_arrays(columns, ["part", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            first = node[starts].copy()
            if last is not None and part[0] == last:
                first[0] = pivot
            firsts = np.repeat(first, np.diff(np.r_[starts, len(part)]))
            if not opened:
                # The task's first run may have begun in the task before.
                yield rows(part[:1], first[:1], None)
                opened = True
            tied = firsts != node
            # Outer runs of a batch may cross a border of the task, where the pivot may be
            # another task's: their pairs keep the part.
            outer = tied & ((part == part[0]) | (part == part[-1]))
            if outer.any():
                yield rows(part[outer], firsts[outer], node[outer])
            if (inner := tied & ~outer).any():
                pairs = np.unique(np.stack([firsts[inner], node[inner]], 1), axis=0)
                yield rows(None, pairs[:, 0], pairs[:, 1])
            last, pivot = part[-1], first[-1]
        if last is not None:
            yield rows(np.array([last]), np.array([pivot]), None)

    runs = checkpointed(
        emitted.repartitionByRange(tasks, "part", "node")
        .sortWithinPartitions("part", "node")
        .mapInArrow(chain, "part long, a long, b long")
    )
    # At most two rows a task, so few enough for every task: the pivots of runs at borders.
    firsts = runs.where("b IS NULL").select("part", "a")
    heads = F.broadcast(firsts.groupBy("part").agg(F.min("a").alias("head")))
    pairs = runs.where("b IS NOT NULL").join(heads, "part", "left").select(F.coalesce("head", "a").alias("a"), "b")
    across = firsts.join(heads, "part").select(F.col("head").alias("a"), F.col("a").alias("b"))
    return pairs.unionByName(across).where("a <> b").distinct()


def _with_shares(members: DataFrame, total: int, most_grams: int, most_classes: int) -> DataFrame:
    """``members`` of blocks (a, n and others), ``total`` rows, with the number of their block's shares."""
    ratio = F.greatest(F.sum("n") / most_grams, F.count(F.lit(1)) / most_classes)
    shares = checkpointed(
        members.groupBy("a").agg(
            F.ceil(F.least(ratio, F.sqrt(MANY * ratio))).cast("int").alias("shares"), F.count(F.lit(1)).alias("held")
        )
    )
    return join_counted(members, shares, ["a"], "held", total)


def _dealt(members: DataFrame, block: Column, shares: Column, columns: list[str], tasks: int) -> DataFrame:
    """(block, r, s, role) and the columns of a block's members, for each pair of its shares. A
    member of share s is indexed in the pairs (s, t) with t >= s, and asks (role 1) in the pairs
    (r, s) with r < s; in (s, s) the members ask one another. One share: (0, 0)."""
    pair = lambda r, s, role: F.struct(r.alias("r"), s.alias("s"), F.lit(role).alias("role"))
    places = F.transform(
        F.sequence(F.lit(0), shares - 1), lambda t: F.when(t >= F.col("_s"), pair(F.col("_s"), t, 0)).otherwise(pair(t, F.col("_s"), 1))
    )
    spread = (
        members.withColumn("_s", F.pmod(F.xxhash64("node"), shares).cast("int"))
        .withColumn("_p", F.explode(places))
        .select(block.alias("block"), "_p.r", "_p.s", "_p.role", *columns)
    )
    return spread.repartition(tasks, "block", "r", "s").sortWithinPartitions("block", "r", "s", "role", "node")


def _sieve(members: DataFrame, threshold: Threshold, tasks: int) -> DataFrame:
    """(a, node) of those members of blocks (a, node, n, sketch, shares) that may link with another one."""
    dealt = _dealt(members, F.col("a"), F.col("shares"), ["node", "n", "sketch"], tasks)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, found = [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(found, pa.int64())], ["a", "node"])
            a.clear()
            found.clear()
            return out

        for (block, r, s), group in itertools.groupby(_rows(batches), lambda row: row[:3]):
            sides: tuple = (([], [], []), ([], [], []))
            for row in group:
                for column, value in zip(sides[row[3]], row[4:], strict=True):
                    column.append(value)
            (nodes, *own), (asking, *queries) = sides
            mets = partners(tuple(own), None if r == s else tuple(queries), threshold)
            for side, met in zip((nodes, asking), mets, strict=r != s):
                kept = [side[k] for k in np.flatnonzero(met[: len(side)]).tolist()]
                found += kept
                a += [block] * len(kept)
            if len(found) >= 50_000:
                yield flush()
        if found:
            yield flush()

    return _batched(dealt.mapInArrow(sieve, "a long, node long").distinct())


def _search(source: DataFrame, placed: DataFrame, n_placed: int, threshold: Threshold, words: int, tasks: int) -> DataFrame:
    """(node, label, links) from the T-occurrence search of every block."""
    wanted = placed.select(F.col("node").alias("_rid"), "weight", "blocks")
    texts = source.join(_small(wanted, n_placed), "_rid").select("_rid", "weight", "blocks", "_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([grams(t, words).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], own], ["node", "weight", "blocks", "own"])

    made = texts.mapInArrow(sets, "node long, weight long, blocks array<struct<pivot:long,shares:int>>, own binary")
    asked = made.select("node", "weight", F.col("blocks.pivot").alias("pivots"), "own", F.explode("blocks").alias("b"))
    dealt = _dealt(asked, F.col("b.pivot"), F.col("b.shares"), ["node", "weight", "own", "pivots"], tasks)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["node", "label", "links"])

        stream = _rows(batches)
        row = next(stream, None)
        while row is not None:
            key, index = row[:3], []
            while row is not None and row[:3] == key and row[3] == 0:
                index.append(Member(*row[4:]))
                row = next(stream, None)

            def queries(key: tuple = key) -> Iterator[Member]:
                nonlocal row
                while row is not None and row[:3] == key:
                    yield Member(*row[4:])
                    row = next(stream, None)

            if not index:
                found = (None for _ in queries())
            else:
                found = _search_block(key[0], index, None if key[1] == key[2] else queries(), threshold)
            for one in filter(None, found):
                out.append(one)
                if len(out) >= 50_000:
                    yield flush()
        if out:
            yield flush()

    return _batched(dealt.mapInArrow(search, "node long, label long, links long"))


def drop_near_copies(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id; of equal ids,
    or where none is known, one of those rows. Rows without words stay."""
    source, unique = _numbered(docs, id_col, text_col, rows=True)
    gone = checkpointed(_link(source, unique, words, Threshold(*similarity), BLOCK_GRAMS).where("NOT stays").select("_rid"))
    return source.select("_row", "_rid").join(_small(gone, gone.count()), "_rid", "left_anti").select(*row_columns(docs))
