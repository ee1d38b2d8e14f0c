"""Exact Jaccard self-join on word shingles by parity sketches.

A document is the set of its distinct shingles. Its sketch is a row of bits, each of which is toggled by the shingles
that hash to it. The Hamming distance of two sketches is a lower bound of the sets' symmetric difference, which for a
similarity of 0.8 is D = (a + b) / 9 at most, a and b being the sets' sizes.

* Size bands are octaves of the set size. A document enters its own octave, and the next one if a partner there is
  possible: any pair meets in the octave of its larger set.
* For candidates, the sketch of a band is cut into more than D segments of 2**16 bits. At most D segments of two similar
  documents differ, so that some are equal (pigeonhole): documents are joined on (band, segment number, bits of the
  segment). A segment's bits are kept as the XOR of a 64-bit hash for each bit that is set.
* Of S segments any D + 1 are enough, if both documents choose by one order: the order is by the number of documents
  that share the segment, rarest first. Segments that nobody shares come first and lead to nothing, so that most
  documents have no candidates at all. Segments of few bits say too little and are left out of longer sketches.
* A segment is crowded if over ``crowd`` documents share it. A document is *safe* if its D + 1 segments hold no crowded
  one; all pairs of a safe document are found through segments that aren't crowded.
* Documents that aren't safe (some short ones, and those made of crowded passages) are joined once more by the finest
  sketch, in which every shingle has a segment of its own. There a document that shares all but a fifth of its shingles
  with a partner needs only its rarest fifth, and only the rarest ninth if the partner is no smaller.
* Groups of near copies are joined up first: each document with a pivot of its bucket, as long as that joins many.
* What is open then are buckets that hold documents of different components. Buckets that share documents form a
  cluster. A cluster, or each of its buckets if that is less work, is divided into blocks of ``BLOCK`` documents, and
  two blocks at a time are compared by the sketches of their bands, of 8 bits for each element of the octave's lower
  end. Every pair is looked at, but only those whose Hamming distance allows a link leave the task.

Candidates are verified on their whole sets. Equal sets are one node from the start, so that copies are never
expanded into pairs. Nodes and shingles are 64-bit hashes; n distinct sets make a false match with probability of
about n**2 / 2**65.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectrill.llm.batches import bounded
from vectrill.llm.components import components, sized
from vectrill.llm.textbuf import LOWER, Texts, cut, mix64, no_nulls, runs
from vectrill.runtime import discard, mark, materialize

SHINGLE = 5
#: Segments per element of the lower end of an octave, and the binary logarithm of a segment's bits.
DENSITY, WIDE = 0.6, 16
#: Fewest bits set in a segment that is used, in octaves below ``LONG`` and from there on; smallest octave.
LEAST, LONG, FIRST = (1, 2), 64, 4
FREE = 1 << 30
_ONE = np.uint64(1)
#: The lowest bits of a coarse key are its octave.
_BAND = np.uint64(63)
#: Documents of a block that are compared with another block in one go.
BLOCK = 1024
#: 64-bit words of sketches that are compared at a time.
_AT_ONCE = 1 << 20


def shingle_sets(t: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order. A text of fewer words is one shingle."""
    first, found = t.windows(k)
    owners, hashes = [t.word_text[first]], [found]
    n = t.n_words
    for j in range(1, k):
        if (n == j).any():
            first, found = t.windows(j)
            whole = n[t.word_text[first]] == j
            owners.append(t.word_text[first][whole])
            hashes.append(found[whole])
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def fingerprints(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """64 bits of each set, as signed integers; 0 for empty sets."""
    mixed = mix64(h ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    at = np.searchsorted(owner, np.arange(n + 1))
    total = sums[at[1:]] - sums[at[:-1]]
    size = np.diff(at)
    some = np.flatnonzero(size)
    folded = np.zeros(n, np.uint64)
    if len(some):
        folded[some] = np.bitwise_xor.reduceat(h, at[some])
    out = mix64(total ^ mix64(folded + size.astype(np.uint64)))
    out[size == 0] = 0
    return out.view(np.int64)


def _octaves(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


def sketch_words(owner: np.ndarray, h: np.ndarray, octave: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the segments of the wanted texts' sketches for the given octaves, without those of few bits."""
    take = wanted[owner]
    owner, h = owner[take], h[take]
    if not len(h):
        return owner, h
    length = np.maximum(1, (DENSITY * (1 << octave))).astype(np.uint64)[owner]
    # hashes are in order within a text, and so are the bits that they toggle: (segment number, place in it)
    bit = ((h >> np.uint64(32)) * length) >> np.uint64(32 - WIDE)
    begins = np.ones(len(h), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (bit[1:] != bit[:-1])
    at = np.flatnonzero(begins)
    at = at[np.diff(np.append(at, len(h))) % 2 == 1]  # a bit toggled twice is not set
    owner, bit = owner[at], bit[at]
    number = bit >> np.uint64(WIDE)
    begins = np.ones(len(bit), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(begins)
    count = np.diff(np.append(at, len(bit)))
    word = np.bitwise_xor.reduceat(mix64((bit & np.uint64((1 << WIDE) - 1)) ^ np.uint64(0xA0761D6478BD642F)), at)
    band = octave[owner[at]].astype(np.uint64)
    key = (mix64(word ^ mix64((band << np.uint64(40)) | number[at])) & ~_BAND) | band
    some = count >= np.where(band < np.log2(LONG), *LEAST)
    return owner[at][some], key[some]


def sketches(owner: np.ndarray, h: np.ndarray, n: int):
    """Keys of all texts' segments, and how many of them each text can spare in its own octave and in the next."""
    size = np.bincount(owner, minlength=n)
    octave = _octaves(size)
    low = np.int64(1) << octave
    partner = (size * 5) // 4
    own = (size >= FIRST)
    up = (partner >= 2 * low) & (2 * low >= FIRST)
    o1, k1 = sketch_words(owner, h, octave, own)
    o2, k2 = sketch_words(owner, h, octave + 1, up)
    slack = np.bincount(o1, minlength=n) - ((size + np.minimum(partner, 2 * low - 1)) // 9 + 1)
    slack_up = np.where(up, np.bincount(o2, minlength=n) - ((size + partner) // 9 + 1), FREE)
    # sets of up to three elements have no similar but equal ones
    alone = size <= 3
    slack[alone] = FREE
    slack_up[alone] = FREE
    slack[~own & ~alone] = -1
    return (o1, k1), (o2, k2), slack, slack_up


def _over_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    texts = no_nulls(texts)
    for start, stop in runs(texts):
        owner, h = shingle_sets(cut(texts, start, stop, fold=LOWER), k)
        yield start, stop, owner, h, fingerprints(owner, h, stop - start)


class Seen:
    """Forgets when full; only spares work for copies in one task."""

    def __init__(self, most: int = 500_000):
        self.most, self.known = most, set()

    def fresh(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), bool)
        if len(self.known) > self.most:
            self.known.clear()
        for i, v in enumerate(values.tolist()):
            if v not in self.known:
                self.known.add(v)
                out[i] = True
        return out


def nodes(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """A row per document: key, n_shingles, node (0: empty set), slack, slack_up, and a hash of its text."""
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_shingles", "node", "slack", "slack_up", "text_hash"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[], [], [], []]
            for start, stop, owner, h, prints in _over_sets(batch.column(text), k):
                _, _, slack, slack_up = sketches(owner, h, stop - start)
                for f, v in zip(found, (np.bincount(owner, minlength=stop - start), prints, slack, slack_up), strict=True):
                    f.append(v.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(np.concatenate(f) if f else np.zeros(0, np.int64)) for f in found), batch.column("_hash")], names=[f.name for f in schema])

    return docs.select(key, text, F.xxhash64(text).alias("_hash")).mapInArrow(run, schema)


class Filter:
    """A bitmap of hashes with one probe, of at most ``most`` bits, for a broadcast. It may say yes wrongly, never no."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @classmethod
    def of(cls, values: DataFrame, most: int = 1 << 28) -> Filter:
        n = values.count()
        bits = min(most, max(1 << 16, 1 << (16 * n).bit_length()))

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits >> 6, np.uint64)
            for batch in batches:
                at = mix64(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), _ONE << (at & np.uint64(63)))
            some = np.flatnonzero(words)
            for i in range(0, len(some), 100_000):
                part = some[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].view(np.int64))], names=["at", "word"])

        found = values.mapInArrow(local, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
        return cls(bits, words)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = mix64(values.view(np.uint64)) & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & _ONE == _ONE


_PAIRS = "key long, node long"


def _passing(batch: pa.RecordBatch, sent) -> pa.Array:
    """The texts whose hash passes the filter: one text at least of each wanted node, before anything is computed."""
    return batch.column(0) if sent is None else batch.column(0).filter(pa.array(sent.value.holds(batch.column(1).to_numpy())))


def _emit(docs: DataFrame, text: str, k: int, of: Callable, sent=None) -> DataFrame:
    """(key, node) rows of each document's set; ``of(owner, h, n)`` gives (text, key) arrays. ``sent``: a Filter of text hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for start, stop, owner, h, prints in _over_sets(_passing(batch, sent), k):
                wanted = prints != 0
                wanted[wanted] = seen.fresh(prints[wanted])
                take = wanted[owner]
                for who, keys in of(owner[take], h[take], stop - start):
                    if len(who):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[who])], names=["key", "node"])

    return docs.select(text, F.xxhash64(text).alias("_hash")).mapInArrow(run, _PAIRS)


def _coarse(owner, h, n):
    home, up, _, _ = sketches(owner, h, n)
    return [home, up]


def _fine(owner, h, n):
    return [(owner, mix64(h ^ np.uint64(0x2545F4914F6CDD1D)))]


def buckets(rows: DataFrame) -> DataFrame:
    """(key, node) for keys with two or more nodes, without repetition.

    One shuffle and a sort that spills; the runs of equal keys are found in passing, in constant memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = last = None  # of the run that goes on
        shown = False
        for batch in batches:
            keys, found = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            goes_on = key is not None and keys[0] == key
            new[0] = not goes_on
            at = np.flatnonzero(new)
            run_of = np.cumsum(new) - (0 if goes_on else 1)
            firsts = np.concatenate([[first], found[at]]) if goes_on else found[at]
            pivot = firsts[run_of].astype(np.int64)
            fresh = np.ones(len(keys), bool)
            fresh[1:] = new[1:] | (found[1:] != found[:-1])
            if goes_on:
                fresh[0] = found[0] != last
            begin = at if not goes_on else np.concatenate([[0], at])
            many = np.maximum.reduceat(found != pivot, begin)
            if goes_on and shown:
                many[0] = True
            keep = fresh & many[run_of]
            out_key, out_node = keys[keep], found[keep]
            if goes_on and not shown and many[0]:
                # the first node's own row came in an earlier batch
                out_key, out_node = np.append(out_key, key), np.append(out_node, first)
            if len(out_key):
                yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_node)], names=["key", "node"])
            key, first, last, shown = keys[-1], firsts[-1], found[-1], bool(many[-1])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long")


def bit_sketches(owner: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """For each set a row of bits, 8 for each element of its octave's lower end, that its elements toggle."""
    size = np.bincount(owner, minlength=n)
    words = np.maximum(1, (1 << _octaves(size)) >> 3)
    begin = np.concatenate([[0], np.cumsum(words)])
    at = h & ((words.astype(np.uint64) << np.uint64(6)) - _ONE)[owner]
    out = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(out, begin[owner] + (at >> np.uint64(6)).astype(np.int64), _ONE << (at & np.uint64(63)))
    return [out[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]


def sets(docs: DataFrame, text: str, k: int, sent) -> DataFrame:
    """(node, n, bits, hashes) of the documents whose text passes the filter, once each.

    ``hashes`` are 8-byte integers in order, ``bits`` is the sketch of the set's band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            for start, stop, owner, h, prints in _over_sets(_passing(batch, sent), k):
                wanted = prints != 0
                wanted[wanted] = seen.fresh(prints[wanted])
                at = np.searchsorted(owner, np.arange(stop - start + 1))
                some = np.flatnonzero(wanted)
                if len(some):
                    bits = bit_sketches(owner, h, stop - start)
                    yield pa.RecordBatch.from_arrays([pa.array(prints[some]), pa.array(at[some + 1] - at[some]), pa.array([bits[i] for i in some], pa.binary()), pa.array([h[at[i] : at[i + 1]].tobytes() for i in some], pa.binary())], names=["node", "n", "bits", "hashes"])

    return docs.select(text, F.xxhash64(text).alias("_hash")).mapInArrow(run, "node long, n long, bits binary, hashes binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, of: DataFrame, similarity: int = 80) -> DataFrame:
    """Those of ``pairs(a, b)`` with 100 * intersection >= similarity * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            last, left = None, None
            for i, (node, x, y) in enumerate(zip(batch.column("a"), batch.column("x"), batch.column("y"), strict=True)):
                if node != last:
                    last, left = node, np.frombuffer(x.as_py(), np.uint64)
                right = np.frombuffer(y.as_py(), np.uint64)
                small, large = sorted((len(left), len(right)))
                if 100 * small >= similarity * large:
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    good[i] = 100 * both >= similarity * (small + large - both)
            kept = batch.select(["a", "b"]).filter(pa.array(good))
            if len(kept):
                yield kept

    size = F.octet_length
    left, right = of.select(F.col("node").alias("a"), F.col("hashes").alias("x")), of.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").where((size("x") * 100 >= size("y") * similarity) & (size("y") * 100 >= size("x") * similarity))
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def rarest(rows: DataFrame, slack: DataFrame, crowd: int, limit: int) -> DataFrame:
    """(key, node, crowded) of the rows that each node needs, for keys that two nodes need.

    ``rows`` are (key, node, band) of shared keys, ``slack`` is (node, band, slack, lead): that many of a node's keys of
    the band can be spared, and those are its most frequent ones. For a partner that is no smaller, ``lead`` of them
    can be spared, so that a key counts only if it is one of the others for some node.
    """
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("n")), "counts")
    found = rows.join(sized(counts, limit), "key").join(slack, ["node", "band"])
    mine = Window.partitionBy("node", "band")
    found = found.withColumn("_at", F.row_number().over(mine.orderBy("n", "key"))).withColumn("_all", F.count("*").over(mine))
    found = found.where("_at <= _all - slack").select("key", "node", (F.col("n") > crowd).alias("crowded"), F.expr("_at <= _all - lead").alias("leads"))
    found = materialize(found, "rarest")
    idle = found.groupBy("key").agg(F.count("*").alias("n"), F.max("leads").alias("leads")).where("n = 1 or not leads").select("key")
    return found.join(sized(materialize(idle, "idle"), limit), "key", "left_anti").drop("leads")


def open_rows(rows: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(key, node, label) of keys that still hold two components."""
    found = rows.join(sized(labels, limit), F.col("node") == F.col("l_node"), "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    still = found.groupBy("key").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select("key")
    return materialize(found.join(sized(materialize(still, "open"), limit), "key"), "labelled")


def groups_of(rows: DataFrame, limit: int, block: int) -> DataFrame:
    """(g, i, j, part, node, label): the nodes that have to be compared with each other, two blocks (i, j) at a time.

    A group is a cluster of keys that share nodes, unless the pairs under each key are fewer: then it is one key.
    """
    per_key = materialize(rows.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")), "keys")
    joined = rows.join(sized(per_key, limit), "key")
    clusters = materialize(components(joined.select(F.col("node").alias("a"), "b"), limit).select(F.col("node").alias("c_node"), F.col("label").alias("cluster")), "clusters")
    placed = materialize(joined.join(sized(clusters, limit), F.col("node") == F.col("c_node")).select("key", "node", "label", "n", "cluster"), "clusters")
    work = placed.groupBy("cluster").agg(F.sum("n").alias("apart")).join(clusters.groupBy("cluster").agg(F.count("*").alias("m")), "cluster")
    work = materialize(work.withColumn("whole", F.col("m").cast("double") * F.col("m") <= F.col("apart")), "work")
    placed = placed.join(sized(work, limit), "cluster")
    whole = placed.where("whole").select(F.col("cluster").alias("g"), "node", "label", F.col("m").alias("size")).distinct()
    single = placed.where("not whole").select(F.xxhash64("key", "cluster").alias("g"), "node", "label", F.col("n").alias("size"))
    found = whole.union(single).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    found = found.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return found.select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label")


def _fold(bits: np.ndarray) -> np.ndarray:
    """Sketches of half the length: positions modulo the half."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:] if half else bits


def near_pairs(node: np.ndarray, label: np.ndarray, n: np.ndarray, part: np.ndarray, bits: list[bytes], best: int | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """(a, b) of nodes with different labels, whose sizes and sketches allow them to be similar, and whether that is all.

    If ``part`` has two values, pairs are of one of each. With ``best``, at most so many of the nearest for each node.
    """
    across, octave = part.min() != part.max(), _octaves(n)
    sketch = {o: np.frombuffer(b"".join(bits[i] for i in np.flatnonzero(octave == o)), np.uint64).reshape(int((octave == o).sum()), -1) for o in np.unique(octave).tolist()}
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for o, mine in sketch.items():
        rows = np.flatnonzero(octave == o)
        for up in (o, o + 1):
            if up not in sketch:
                continue
            columns, theirs = np.flatnonzero(octave == up), sketch[up]
            if up != o and theirs.shape[1] > mine.shape[1]:
                theirs = _fold(theirs)
            step = max(1, _AT_ONCE // theirs.size)
            for x in range(0, len(rows), step):
                r = rows[x : x + step]
                fits = (label[r][:, None] != label[columns][None]) & (5 * n[r][:, None] >= 4 * n[columns][None]) & (5 * n[columns][None] >= 4 * n[r][:, None])
                if up == o:
                    fits &= node[r][:, None] < node[columns][None]
                if across:
                    fits &= part[r][:, None] != part[columns][None]
                if not fits.any():
                    continue
                apart = np.bitwise_count(mine[x : x + step][:, None] ^ theirs[None]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(fits & (9 * apart <= n[r][:, None] + n[columns][None]))
                found.append((r[i], columns[j], apart[i, j]))
    a, b, apart = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    whole = True
    if best is not None and len(a):
        keep = np.zeros(len(a), bool)
        for side in (a, b):
            order = np.lexsort((apart, side))
            new = np.flatnonzero(np.diff(side[order], prepend=-1))
            rank = np.arange(len(a)) - np.repeat(new, np.diff(np.append(new, len(a))))
            keep[order[rank < best]] = True
        whole = bool(keep.all())
        a, b = a[keep], b[keep]
    low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
    return low, high, whole


def near(groups: DataFrame, of: DataFrame, best: int | None = None) -> DataFrame:
    """Pairs (a, b) of :func:`groups_of` that may be similar, and a row of NULLs if ``best`` has left out some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            node, label, n, part = (t.column(c).to_numpy() for c in ("node", "label", "n", "part"))
            a, b, whole = near_pairs(node, label, n, part, t.column("bits").to_pylist(), best)
            if len(a):
                rest = pa.array([None] * (not whole), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x), rest]) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            g, i, j = (batch.column(c).to_numpy() for c in ("g", "i", "j"))
            new = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for x, y in zip([0, *new], [*new, len(g)], strict=True):
                if x == y:
                    continue
                if held and (g[x], i[x], j[x]) != now:
                    yield from flush()
                    held = []
                now = (g[x], i[x], j[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield from flush()

    known = groups.join(of.select("node", "n", "bits"), "node").select("g", "i", "j", "part", "node", "label", "n", "bits")
    return known.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(run, "a long, b long").distinct()


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, similarity: int = 80, crowd: int = 32, limit: int = 200_000, block: int = BLOCK) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id`` (the smallest key in reach by links).

    NULL, empty and wordless texts have no shingles and are linked with nothing; they are their own component. A NULL
    key counts as the largest: its component is the smallest other key in reach, or NULL. Repeated rows and equal
    texts are linked, as are equal sets; an empty table gives an empty result. Other columns aren't read, so that their
    names don't matter. ``similarity`` is 80 or more per cent.
    """
    if similarity < 80:
        raise ValueError("sketch lengths are laid out for a similarity of 80 per cent or more")
    context, start = bounded(docs.sparkSession).sparkContext, mark()
    own_key, own_text = "_own_key", "_own_text"
    docs = docs.select(F.col(key).alias(own_key), F.col(text).alias(own_text))
    documents = materialize(nodes(docs, own_key, own_text, k), "nodes")
    each = documents.where("node <> 0").groupBy("node").agg(F.min("slack").alias("slack"), F.min("slack_up").alias("slack_up"), F.first("n_shingles").alias("n_shingles"), F.min("text_hash").alias("text_hash"))
    each = materialize(each, "each")
    own = F.length(F.bin("n_shingles")) - 1
    bands = each.select("node", F.explode(F.array(F.struct(own.alias("band"), "slack"), F.struct((own + 1).alias("band"), F.col("slack_up").alias("slack")))).alias("s")).select("node", "s.band", "s.slack", F.col("s.slack").alias("lead"))
    coarse = materialize(buckets(_emit(docs, own_text, k, _coarse)).select("key", "node", F.col("key").bitwiseAND(63).cast("int").alias("band")), "coarse")
    coarse = materialize(rarest(coarse, bands, crowd, limit), "coarse")

    crowds = coarse.where("crowded").select("node").distinct()
    unsafe = each.where("least(slack, slack_up) < 0").select("node").union(crowds).distinct().join(each.select("node", "n_shingles", "text_hash"), "node")
    unsafe = materialize(unsafe, "unsafe")
    n = F.col("n_shingles")
    spare = unsafe.select("node", F.lit(0).alias("band"), (n - F.floor(n / 5) - 1).alias("slack"), (n - F.floor(n / 9) - 1).alias("lead"))
    fine = buckets(_emit(docs, own_text, k, _fine, context.broadcast(Filter.of(unsafe.select("text_hash")))))
    fine = materialize(fine.select("key", "node", F.lit(0).alias("band")), "fine")
    fine = materialize(rarest(fine, spare, crowd, limit), "fine")

    rows = materialize(coarse.where("not crowded").union(fine).select("key", "node"), "rows")
    of = materialize(sets(docs, own_text, k, context.broadcast(Filter.of(materialize(rows.select("node").distinct().join(each, "node").select("text_hash"), "candidates")))), "sets")

    # first every node with the smallest that it meets: one pair a node joins up most groups
    pivots = materialize(rows.groupBy("key").agg(F.min("node").alias("a")), "pivots")
    stars = rows.join(sized(pivots, limit), "key").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).where("a < b")
    links = materialize(verify(stars, of, similarity), "links")

    def labels() -> DataFrame:
        inner = mark()
        found = materialize(components(links, limit).select(F.col("node").alias("l_node"), "label"), "labels")
        discard(inner, found)
        return found

    # then with one of another component, chosen by a hash that changes, as long as a tenth of the pairs are links
    final = labels()
    left = open_rows(rows, final, limit)
    for turn in itertools.count():
        if left.isEmpty():
            break
        chance = F.xxhash64("node", F.lit(turn))
        pivots = left.groupBy("key").agg(F.min_by(F.struct(chance.alias("h"), F.col("node").alias("a"), F.col("label").alias("a_label")), chance).alias("p")).select("key", "p.*")
        tried = left.join(sized(materialize(pivots, "pivots"), limit), "key").where("label <> a_label")
        tried = tried.groupBy(F.col("node").alias("b")).agg(F.min_by("a", "h").alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tried = materialize(tried, "tried")
        verified = materialize(verify(tried, of, similarity), "links")
        links = links.union(verified)
        final = labels()
        left = open_rows(left.select("key", "node"), final, limit)
        if verified.count() * 10 < tried.count():
            break

    # then all pairs of components that still are different, the nearest of each document ahead of all others
    for best in (8, None):
        if left.isEmpty():
            break
        found = materialize(near(groups_of(left, limit, block), of, best), "near")
        verified = materialize(verify(found.where("a is not null"), of, similarity), "links")
        links = links.union(verified)
        final = labels()
        if found.where("a is null").isEmpty():
            break
        left = open_rows(left.select("key", "node"), final, limit)

    placed = documents.join(sized(final, limit), (documents["node"] == final["l_node"]) & (documents["node"] != 0), "left")
    placed = placed.select(own_key, "n_shingles", F.coalesce("label", "node").alias("_component"))
    groups = placed.where("_component <> 0").groupBy("_component").agg(F.min(own_key).alias("_least"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    groups = materialize(groups, "groups")
    discard(start, documents, final, groups)
    return placed.join(sized(groups, limit), "_component", "left").select(F.col(own_key).alias(key), "n_shingles", F.coalesce("_least", F.col(own_key)).alias("component_id"))
