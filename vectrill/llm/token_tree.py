"""Token counts under edits, by a segment tree over each document's pre-tokens.

A byte-level BPE tokenizer first cuts a text into pre-tokens by a pattern and encodes each by itself. The leaves of a
document's tree are its pre-tokens with their characters and tokens; every inner node holds the sums below it. An edit
finds its first leaf by going down the character sums, cuts and encodes the text again from there until a new
boundary meets an old one behind the edit, and updates the sums above the leaves that changed.

The pattern only looks ahead, and by two characters at most behind a pre-token's end, so that a pre-token that ends
two or more characters ahead of an edit stays as it is (the boundary context), and so does all behind a common
boundary.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vectrill.llm.batches import bounded

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-token pattern of this vocabulary, fixed.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKAHEAD = 2
_CUT = regex.compile(PATTERN)
_LOADED: dict[int, Counter] = {}

Edit = tuple[int, int, str]


class Counter(dict):
    """Tokens of each pre-token; forgets all when ``most`` are known."""

    def __init__(self, vocabulary: bytes, most: int = 400_000):
        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: str) -> int:
        raw = piece.encode()
        n = 1 if raw in self.ranks else len(self.encoding.encode_ordinary(piece))
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


def counter(vocabulary: bytes) -> Counter:
    """One for each worker process and vocabulary."""
    name = hash(vocabulary)
    if name not in _LOADED:
        _LOADED[name] = Counter(vocabulary)
    return _LOADED[name]


class TokenTree:
    """A document's text and the tree over its pre-tokens. An edited leaf may hold several pre-tokens, or none."""

    def __init__(self, text: str, tokens: Counter, leaves: tuple[np.ndarray, np.ndarray] | None = None):
        self.text, self.tokens = text, tokens
        if leaves is None:
            pieces = _CUT.findall(text)
            self.encoded = len(pieces)
            chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
            counts = np.fromiter(map(tokens.__getitem__, pieces), np.int64, len(pieces))
        else:
            self.encoded = 0
            chars, counts = (np.asarray(x, np.int64) for x in leaves)
        self.n = len(chars)
        self.size = 1 << max(0, self.n - 1).bit_length()
        self.chars, self.counts = self._sums(chars), self._sums(counts)
        self.parts: dict[int, tuple[list[int], list[int]]] = {}

    def _sums(self, leaves: np.ndarray) -> np.ndarray:
        tree = np.zeros(2 * self.size, np.int64)
        tree[self.size : self.size + len(leaves)] = leaves
        at = self.size
        while at > 1:
            tree[at >> 1 : at] = tree[at : 2 * at : 2] + tree[at + 1 : 2 * at : 2]
            at >>= 1
        return tree

    @property
    def n_tokens(self) -> int:
        return int(self.counts[1])

    def _leaf(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            node <<= 1
            if position >= begin + self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.size, begin

    def _set(self, leaf: int, chars: int, counts: int) -> None:
        node = leaf + self.size
        dc, dt = chars - int(self.chars[node]), counts - int(self.counts[node])
        while node:
            self.chars[node] += dc
            self.counts[node] += dt
            node >>= 1

    def _contents(self, leaf: int) -> tuple[list[int], list[int]]:
        if leaf in self.parts:
            return self.parts[leaf]
        node = leaf + self.size
        return ([int(self.chars[node])], [int(self.counts[node])]) if self.chars[node] else ([], [])

    def replace(self, begin: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from ``begin`` to ``end``."""
        if not 0 <= begin <= end <= len(self.text):
            raise ValueError(f"no such range: {begin} to {end} of {len(self.text)}")
        text = self.text
        self._splice(begin, end, new, lambda n: (text[end : end + n], end + n >= len(text)))
        self.text = text[:begin] + new + text[end:]

    def replace_all(self, edits: list[Edit]) -> None:
        """Edits in positions of the text as it is, in any order, not overlapping. The text is put together once."""
        right: list[str] = []  # what stands behind ``begin`` by now, the nearest last
        text = self.text
        begin = len(text)

        def behind(n: int) -> tuple[str, bool]:
            found, size = [text[end : min(begin, end + n)]], min(begin - end, n)
            for part in reversed(right):
                if size >= n:
                    return "".join(found), False
                found.append(part[: n - size])
                size += len(found[-1])
            return "".join(found), size < n

        for at, end, new in sorted(edits, reverse=True):
            if not 0 <= at <= end <= begin:
                raise ValueError(f"no such range: {at} to {end}, ahead of {begin}")
            self._splice(at, end, new, behind)
            right += [part for part in (text[end:begin], new) if part]
            begin = at
        self.text = text[:begin] + "".join(reversed(right))

    def _splice(self, begin: int, end: int, new: str, behind: Callable[[int], tuple[str, bool]]) -> None:
        """Update the leaves. ``behind(n)`` gives the n characters behind ``end``, and whether that is all there are."""
        first, leaf_begin = self._leaf(max(0, begin - LOOKAHEAD)) if self.chars[1] else (0, 0)
        # pre-tokens of the leaf that end well ahead of the edit stay
        chars, counts = self._contents(first)
        kept, start = 0, leaf_begin
        while kept < len(chars) and start + chars[kept] + LOOKAHEAD <= begin:
            start += chars[kept]
            kept += 1
        n = 64
        while (found := self._until_boundary(self.text[start:begin] + new, start, end, len(new) - (end - begin), first, kept, *behind(n))) is None:
            n *= 4
        passed, pieces, ahead, old_counts = found
        for changed in passed:
            self._set(changed, 0, 0)
            self.parts.pop(changed, None)
        self.encoded += len(pieces)
        new_chars = [*chars[:kept], *map(len, pieces), *ahead]
        new_counts = [*counts[:kept], *(self.tokens[p] for p in pieces), *old_counts]
        self.parts[first] = (new_chars, new_counts)
        self.n = max(self.n, 1)
        self._set(first, sum(new_chars), sum(new_counts))

    def _until_boundary(self, head: str, start: int, end: int, shift: int, first: int, kept: int, follow: str, whole: bool):
        """Cut ``head`` and ``follow`` until a boundary meets an old one behind the edit: the leaves passed, the new
        pre-tokens, and what is left of the last leaf. None if ``follow`` ends too soon to tell."""
        text, must = head + follow, len(head)
        total, old, position = int(self.chars[1]), start, 0
        passed: list[int] = []
        ahead, old_counts = (list(x[kept:]) for x in self._contents(first))
        pieces: list[str] = []
        for m in _CUT.finditer(text):
            while old + shift < start + position or old < end:
                if not ahead:
                    if old >= total:
                        break
                    passed.append(self._leaf(old)[0])  # the next one that isn't empty
                    ahead, old_counts = (list(x) for x in self._contents(passed[-1]))
                    continue
                old += ahead.pop(0)
                old_counts.pop(0)
            if old >= end and old + shift == start + position and position >= must:
                return passed, pieces, ahead, old_counts
            if not whole and m.end() + LOOKAHEAD > len(text):
                return None
            pieces.append(m[0])
            position = m.end()
        if not whole:
            return None
        # the text ends: whatever is left of the old leaves was replaced
        old += sum(ahead)
        while old < total:
            passed.append(self._leaf(old)[0])
            old += int(self.chars[passed[-1] + self.size])
        return passed, pieces, [], []

    def leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token, to keep and to go on from."""
        chars, counts = [], []
        for leaf in range(self.n):
            c, t = self._contents(leaf)
            chars += c
            counts += t
        return chars, counts


def apply_edits(tree: TokenTree, edits: list[Edit]) -> None:
    """Edits in positions of the text as it was, in any order, not overlapping."""
    tree.replace_all(edits)


_MAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def cleaning_edits(text: str) -> list[Edit]:
    """Delete lines that equal an earlier line, and put a tag in place of e-mail addresses in the others."""
    edits, known, begin = [], set(), 0
    mails = "@" in text
    for line in text.split("\n"):
        end = begin + len(line)
        if line in known and line.strip():
            edits.append((begin - 1, end, ""))
        else:
            known.add(line)
            if mails and "@" in line:
                edits += [(begin + m.start(), begin + m.end(), "<EMAIL>") for m in _MAIL.finditer(line)]
        begin = end + 1
    return edits


def _read(path: str) -> bytes:
    return Path(path).read_bytes()


def count_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", edits: Callable[[str], list[Edit]] = cleaning_edits, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document: ``key``, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_reencoded (pre-tokens).

    NULL and empty texts have no tokens. Rows are independent: repeated rows get equal counts, NULL keys are carried like
    others, ties don't arise, an empty table gives an empty result, and other columns aren't read. The vocabulary file (1 MB) is read on the driver.
    """
    sent = bounded(docs.sparkSession).sparkContext.broadcast(_read(tokenizer))
    names = ["n_tokens", "n_pretokens", "n_edits", "n_tokens_edited", "n_reencoded"]
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(sent.value)
        for batch in batches:
            out: list[tuple[int, ...]] = []
            for value in batch.column(text):
                tree = TokenTree(value.as_py() or "", tokens)
                before, pieces = tree.n_tokens, tree.encoded
                found = edits(tree.text)
                if found:
                    apply_edits(tree, found)
                out.append((before, pieces, len(found), tree.n_tokens, tree.encoded - pieces))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, pa.int64()) for c in columns)], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, schema)


def build_trees(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``key``, ``text`` and the leaves (``chars``, ``counts``) of each document's tree, to be kept as a table."""
    sent = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    schema = T.StructType([docs.schema[key], T.StructField(text, T.StringType()), T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(sent.value)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                trees = [TokenTree(v.as_py() or "", tokens).leaves() for v in part.column(text)]
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(text), *(pa.array([t[i] for t in trees], pa.list_(pa.int32())) for i in (0, 1))], names=[f.name for f in schema])

    return docs.select(key, text).mapInArrow(run, schema)


def edit_trees(trees: DataFrame, edits: str = "edits", key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The table of :func:`build_trees` after edits, with ``n_tokens`` and ``n_reencoded``.

    ``edits`` names a column of arrays of (begin, end, new); NULL and empty ones leave a document as it is.
    """
    sent = trees.sparkSession.sparkContext.broadcast(_read(tokenizer))
    schema = T.StructType([trees.schema[key], trees.schema[text], trees.schema["chars"], trees.schema["counts"], T.StructField("n_tokens", T.LongType()), T.StructField("n_reencoded", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(sent.value)
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                done = []
                for t, c, n, e in zip(*(part.column(x).to_pylist() for x in (text, "chars", "counts", edits)), strict=True):
                    tree = TokenTree(t or "", tokens, (c or [], n or []))
                    apply_edits(tree, [tuple(x.values()) for x in e or []])
                    done.append((tree.text, *tree.leaves(), tree.n_tokens, tree.encoded))
                columns = list(zip(*done, strict=True))
                kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True))], names=[f.name for f in schema])

    return trees.select(key, text, "chars", "counts", edits).mapInArrow(run, schema)
