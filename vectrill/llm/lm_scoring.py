"""Cross-entropy difference of a target and a background n-gram model over one shared vocabulary.

The vocabulary is every word of the corpus (a hash stands for each), or, if a size is given, the ``size - 1`` most
frequent ones, all others being one unknown word. Both models are bigram models with the same interpolation: the
background one is counted over all documents, the target one over the documents that the labels mark good. Every
document gets the mean over its tokens of (loss under the target model - loss under the background model): the lower,
the more it is like the target.

Counts are taken over all documents and nothing that grows with the vocabulary is gathered or broadcast. Documents are
cut into chunks of about ``CHUNK`` tokens. A chunk sends each of its distinct words and pairs once, with its own counts,
to the bucket that the hash falls into; buckets add them up and answer every chunk in the order it asked; the chunk,
whose words are dealt by its number in the same shuffle, is scored by the answers. A frequent pair is one entry for
each chunk. A word is a context as often as it occurs other than as the last of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vectrill.llm.batches import bounded
from vectrill.llm.textbuf import LOWER, cut, mix64, no_nulls, runs
from vectrill.runtime import materialize

#: So many words are counted at a time in a task.
FLUSH = 2_000_000
#: Tokens of a chunk, and of the corpus for each bucket.
CHUNK = 2_000_000
BUCKET = 3_000_000

_UNKNOWN, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: ``at`` is where a row is dealt to: a chunk, or a bucket as -1 - its number.
_MESSAGE = "at long, chunk long, bucket int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["at", "chunk", "bucket", "a", "b", "c", "d", "e"]
_COUNTS = ["b", "c", "d", "e"]


def word_counts(docs: DataFrame, text: str = "text", target: str = "_target") -> DataFrame:
    """(hash, n, n_target) of all words of all texts, words in ASCII lower case."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            n, chosen = np.bincount(at), np.bincount(at[np.concatenate([m for _, m in held])], minlength=len(words))
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n), pa.array(chosen)], names=["hash", "n", "n_target"])

        for batch in batches:
            texts, marks = no_nulls(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for start, stop in runs(texts):
                t = cut(texts, start, stop, fold=LOWER)
                if len(t.hashes):
                    held.append((t.hashes, marks[start:stop][t.word_text]))
                    size += len(t.hashes)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select(text, target).mapInArrow(run, "hash long, n long, n_target long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


@dataclass
class Vocabulary:
    """Number of words (the unknown one included), their occurrences in all documents and in the target, and the sorted
    hashes of the known words, or None if all words are known."""

    size: int
    total: int
    total_target: int
    hashes: np.ndarray | None = None

    def known(self, h: np.ndarray) -> np.ndarray:
        if self.hashes is None:
            return h
        if not len(self.hashes):
            return np.full(len(h), _UNKNOWN)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, h, _UNKNOWN)


def vocabulary(counts: DataFrame, size: int | None = None) -> Vocabulary:
    """All words, or the ``size - 1`` words of the highest counts; of equal counts, the smallest hashes."""
    row = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    if size is None:
        return Vocabulary(row[0] + 1, row[1], row[2])
    top = counts.orderBy(F.col("n").desc(), "hash").limit(size - 1).collect()
    return Vocabulary(len(top) + 1, row[1], row[2], np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64)))


def _pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: most counts and numbers are small."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _unpack(body: bytes, kind) -> np.ndarray:
    n = int.from_bytes(body[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(body[8:], n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


@dataclass
class Entries:
    """What a chunk asks for: its words, the start of texts and its pairs as sorted hashes.

    ``words`` are the chunk's distinct word hashes in any order, ``token`` the number of each token's word, ``n_words`` the tokens of
    each document; the first word of a text has the start before it.
    """

    words: np.ndarray
    token: np.ndarray
    n_words: np.ndarray

    def __post_init__(self) -> None:
        v = len(self.words)
        before = np.empty(len(self.token), np.int64)
        before[1:] = self.token[:-1]
        ends = np.cumsum(self.n_words)
        some = self.n_words > 0
        self.first, self.last = (ends - self.n_words)[some], ends[some] - 1
        before[self.first] = v
        self.pairs, self.pair = np.unique(before * v + self.token, return_inverse=True)
        self.pair_before, self.pair_word = np.divmod(self.pairs, max(v, 1))
        contexts = mix64(np.append(self.words, _START) + np.uint64(1))
        hashes = np.concatenate([self.words, [_START], mix64(contexts[self.pair_before] * np.uint64(0xD1342543DE82EF95) + self.words[self.pair_word])])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def counts(self, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the entries in the tokens for which ``of`` is true, and those that end a text, in the order of ``hashes``."""
        of = np.ones(len(self.token), bool) if of is None else of
        v, last = len(self.words), self.last[of[self.last]]
        n = np.concatenate([np.bincount(self.token[of], minlength=v), [of[self.first].sum()], np.bincount(self.pair[of], minlength=len(self.pairs))])
        ends = np.bincount(self.token[last], minlength=len(n))
        return n[self.order], ends[self.order]

    def losses(self, counts: np.ndarray, ends: np.ndarray, size: int, total: int, strength: float = 8.0) -> np.ndarray:
        """-log2 P(word | previous) of every token: a bigram model interpolated with the unigram model, and that with
        the uniform one, each by ``strength`` pseudo-counts. Without counts it is uniform."""
        n, before = np.empty(len(counts)), np.empty(len(counts))
        n[self.order] = counts
        before[self.order] = ends
        before = n - before
        v = len(self.words)
        single = (n[:v] + strength / size) / (total + strength)
        return -np.log2((n[v + 1 :] + strength * single[self.pair_word]) / (before[self.pair_before] + strength))[self.pair]


def _messages(at, chunk, bucket, *columns) -> pa.RecordBatch:
    none = [None] * len(at)
    parts = [*columns, *[None] * (5 - len(columns))]
    return pa.RecordBatch.from_arrays(
        [pa.array(at, pa.int64()), pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), *(pa.array(none if x is None else x, pa.binary()) for x in parts)], names=_NAMES
    )


def _ask(docs: DataFrame, words: Vocabulary, buckets: int) -> DataFrame:
    """For each chunk its own words, and a row of entries and counts for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = (TaskContext.get().partitionId() << 32) + made
            n_words, marks = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            distinct, token, often = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True, return_counts=True)
            rank = np.argsort(-often, kind="stable")  # small numbers for frequent words, which compress better
            number = np.empty_like(rank)
            number[rank] = np.arange(len(rank))
            distinct, token = distinct[rank], number[token]
            e = Entries(distinct, token, n_words)
            keys = pa.Table.from_arrays([pa.chunked_array([x[0] for x in held])], names=["key"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, keys.schema) as out:
                out.write_table(keys)
            yield _messages([chunk], [chunk], [-1], [sink.getvalue().to_pybytes()], [_pack(distinct)], [_pack(n_words.astype(np.int64))], [_pack(token.astype(np.uint32))])
            counts = [x.astype(np.uint32) for x in (*e.counts(), *e.counts(np.repeat(marks, n_words)))]
            bucket = ((e.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            for i in range(0, len(some), 64):
                to = some[i : i + 64]
                spans = [(int(edges[b]), int(edges[b + 1])) for b in to]
                hashes = [_pack(np.diff(e.hashes[x:y], prepend=np.uint64(0))) for x, y in spans]
                yield _messages(-1 - to, [chunk] * len(to), to, hashes, *([_pack(n[x:y]) for x, y in spans] for n in counts))

        for batch in batches:
            texts, marks = no_nulls(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for start, stop in runs(texts):
                t = cut(texts, start, stop, fold=LOWER)
                held.append((batch.column(0).slice(start, stop - start), t.n_words, marks[start:stop], words.known(t.hashes)))
                size += len(t.hashes)
                if size >= CHUNK:
                    yield from flush()
                    made, held, size = made + 1, [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, _MESSAGE)


def _add(asked: pa.Table) -> pa.Table:
    """The sums of one bucket, for each chunk in the order it asked; nothing for a chunk's own words."""
    if asked.column("at")[0].as_py() >= 0:
        return asked.slice(0, 0)
    hashes = [np.cumsum(_unpack(x.as_py(), np.uint64), dtype=np.uint64) for x in asked.column("a")]
    edges = np.cumsum([len(h) for h in hashes])[:-1]
    found, at = np.unique(np.concatenate(hashes), return_inverse=True)
    out = []
    for c in _COUNTS:
        n = np.concatenate([_unpack(x.as_py(), np.uint32) for x in asked.column(c)])
        sums = np.bincount(at, n, len(found)).astype(np.uint64)
        out.append([_pack(x) for x in np.split(sums[at], edges)])
    chunks = asked.column("chunk").to_pylist()
    return pa.Table.from_batches([_messages(chunks, chunks, asked.column("bucket").to_pylist(), None, *out)])


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", vocabulary_size: int | None = None) -> DataFrame:
    """One row per document: ``key``, n_tokens, ce_target, ce_background, ce_difference (bits a token).

    Texts without words (NULL, empty) have 0 tokens and differences of 0. Documents that labels call good several
    times count once per row; NULL labels and keys mark nothing. Without a target the target model is uniform.
    """
    bounded(docs.sparkSession)
    good = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    # the ids grow with the corpus: they are broadcast only if counted to be few
    flags = materialize(good, "target")
    few = flags.count() <= 500_000
    chosen = F.broadcast(flags) if few else flags
    marked = docs.select(key, text).join(chosen.withColumn("_target", F.lit(True)), F.col(key) == F.col("_key"), "left").select(key, text, F.coalesce("_target", F.lit(False)).alias("_target"))
    if not few:
        marked = materialize(marked, "marked")  # chunks must be the same if a task is run again
    words = vocabulary(word_counts(marked, text), vocabulary_size)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("ce_target", "ce_background", "ce_difference"))])
    types = [f.type for f in to_arrow_schema(schema)]
    size, total, total_target = words.size, words.total, words.total_target

    def finish(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not len(asked) or asked.column("at")[0].as_py() < 0:
            return pa.Table.from_arrays([pa.array([], f) for f in types], names=[f.name for f in schema])
        head, told = asked.to_pylist()[0], told.sort_by("bucket")
        keys = pa.ipc.open_stream(head["a"]).read_all().column("key")
        n_words = _unpack(head["c"], np.int64)
        e = Entries(_unpack(head["b"], np.uint64), _unpack(head["d"], np.uint32).astype(np.int64), n_words)
        n, ends, chosen, chosen_ends = (np.concatenate([_unpack(x.as_py(), np.uint64) for x in told.column(c)]) for c in _COUNTS)
        owner, some = np.repeat(np.arange(len(n_words)), n_words), np.maximum(n_words, 1)
        a, b = (np.bincount(owner, e.losses(x, y, size, t), len(n_words)) / some for x, y, t in ((chosen, chosen_ends, total_target), (n, ends, total)))
        return pa.Table.from_arrays([keys, pa.array(n_words), pa.array(a), pa.array(b), pa.array(a - b)], names=[f.name for f in schema])

    buckets = max(1, total // BUCKET)
    # one exchange of what is asked serves both: the buckets that add up, and the chunks that wait for the answers
    asked = _ask(marked, words, buckets)
    answers = asked.groupBy("at").applyInArrow(_add, _MESSAGE)
    return asked.groupBy("at").cogroup(answers.groupBy("at")).applyInArrow(finish, schema)
