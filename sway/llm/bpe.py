"""Byte-level BPE encoding and decoding by a prefix-sharing trie traversal.

A task gathers the distinct words of a batch of texts, inserts those it has not met yet
into a trie and walks the trie depth first.  The state of a node is the last token of the
encoding of its prefix; it follows from the states above it, so a prefix that many words
share is encoded once.  A word's encoding is read off by stepping back from its node, token
by token.

The step rests on a property of merge-ordered BPE: a token sequence is the encoding of its
bytes exactly if every two neighbours are, alone, the encoding of theirs.  Of the tokens that end
a prefix, the last one is thus the one that is compatible with the last token of the
prefix before it.

Vocabularies are read from a ``tokenizers`` JSON file; nothing is trained.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sway.llm.common import prepare

# Fixed value: the word pattern of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bounds of a task's memory: words kept from earlier batches, the longest of them, words in
#: one trie, and words of a long text handled at a time.
KEPT_WORDS, KEPT_CHARS, TRIE_WORDS, SLICE_WORDS = 1_000_000, 48, 16_384, 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and added tokens of a file, and the compatibility of two tokens."""

    def __init__(self, path: str) -> None:
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.id_of = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b = self.id_of[as_bytes(left)], self.id_of[as_bytes(right)]
            self.rank[a, b] = rank
            self.parts[self.id_of[as_bytes(left + right)]] = (a, b, rank)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(WORDS)
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}

    def _edge(self, token: int, side: int, found: dict[int, list]) -> list[tuple[int, float]]:
        """Parts at one edge of a token, each with the rank of the merge that consumes it."""
        if token not in found:
            edge, at, until = [], token, float("inf")
            while True:
                edge.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.parts[at][2], self.parts[at][side]
            found[token] = edge
        return found[token]

    def compatible(self, left: int, right: int) -> bool:
        """Is (left, right) the encoding of its own bytes?

        It isn't if, while the merges build both tokens, a part at the right edge of ``left``
        and a part at the left edge of ``right`` merge before either is consumed.  Equal
        merges apply from the left: one inside ``left`` precedes, one inside ``right`` follows."""
        inner = self._edge(right, 0, self._left)
        for a, a_until in self._edge(left, 1, self._right):
            for b, b_until in inner:
                rank = self.rank.get((a, b))
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True


class Encoder:
    """Encodes batches of texts; keeps the encodings of a bounded number of words."""

    END = -1

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}

    def _trie(self, words: Iterable[str]) -> dict:
        root: dict = {}
        for word in words:
            node = root
            for byte in word.encode():
                node = node.setdefault(byte, {})
            node[self.END] = word
        return root

    def _walk(self, root: dict) -> dict[str, bytes]:
        """Ids (32-bit, packed) of every word in the trie."""
        id_of, longest, fits, compatible = self.v.id_of.get, self.v.longest, self.fits, self.v.compatible
        one = [bytes([b]) for b in range(256)]
        out: dict[str, bytes] = {}
        last, size = [-1], [0]  # of the prefix at each depth: last token, its bytes
        stack = [(iter(root.items()), b"")]  # what follows a prefix, and the prefix's last bytes
        while stack:
            nodes, tail = stack[-1]
            for byte, node in nodes:
                if byte < 0:
                    ids, at = [], len(last) - 1
                    while at:
                        ids.append(last[at])
                        at -= size[at]
                    out[node] = np.array(ids[::-1], np.int32).tobytes()
                    continue
                end = tail + one[byte]
                n = len(end)
                if n > longest:
                    end, n = end[1:], longest
                depth = len(last)
                for at in range(n):
                    token = id_of(end[at:])
                    if token is None:
                        continue
                    before = last[depth - n + at]
                    if before < 0:
                        break
                    key = before << 32 | token
                    fit = fits.get(key)
                    if fit is None:
                        fit = fits[key] = compatible(before, token)
                    if fit:
                        break
                last.append(token)
                size.append(n - at)
                stack.append((iter(node.items()), end))
                break
            else:
                stack.pop()
                last.pop()
                size.pop()
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Encodings of all ``words``, from the trie where they are not known yet."""
        new = sorted(words.difference(self.known))
        found: dict[str, bytes] = {}
        for part in itertools.batched(new, TRIE_WORDS):
            found |= self._walk(self._trie(part))
        if len(self.known) + len(found) > KEPT_WORDS:
            rest = {w: self.known[w] for w in words if w in self.known}
            self.known = {}
            found |= rest
        if len(self.fits) > 4 * KEPT_WORDS:
            self.fits.clear()
        self.known |= {w: e for w, e in found.items() if len(w) <= KEPT_CHARS}
        return found

    def _pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id, text) of added tokens and (None, text) of what stands between them."""
        if self.v.split is None:
            yield None, text
            return
        for piece in self.v.split.split(text):
            if piece:
                yield self.v.added.get(piece), piece

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as an array of int32."""
        cut, get = self.v.words, self.known
        split: list[list] = []
        for text in texts:
            parts: list = []
            for added, piece in self._pieces(text):
                if added is not None:
                    parts.append(np.int32(added).tobytes())
                elif len(piece) < SLICE_WORDS:
                    parts.append(cut.findall(piece))
                else:
                    words = (m[0] for m in cut.finditer(piece))
                    for some in itertools.batched(words, SLICE_WORDS):
                        parts.append(self._join(list(some)))
            split.append(parts)
        words = {w for parts in split for p in parts if isinstance(p, list) for w in p}
        fresh = self.learn(words)
        get = self.known if all(len(w) <= KEPT_CHARS for w in fresh) else self.known | fresh
        return [np.frombuffer(b"".join(p if isinstance(p, bytes) else b"".join(map(get.__getitem__, p)) for p in parts), np.int32) for parts in split]

    def _join(self, words: list[str]) -> bytes:
        get = self.learn(set(words))
        return b"".join(get.get(w) or self.known[w] for w in words)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, added tokens included; unknown ids are left out, bad UTF-8 becomes U+FFFD."""
        get = self.v.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(Vocabulary(path))


def _kept(df: DataFrame, keep: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in keep]


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None,
           ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``keep`` columns plus the token ids of ``text`` and, if named, their decoded text.

    Added tokens are found in the text, none is put around it; a null text counts as empty
    and gives no ids.  Whole texts of any length are encoded.  Rows are neither dropped nor merged;
    ``ids`` and ``decoded`` must differ from the kept names."""
    prepare(df.sparkSession)
    keep, path = ["doc_id"] if keep is None else keep, path or default_path()
    schema = T.StructType([*_kept(df, keep), T.StructField(ids, T.ArrayType(T.IntegerType())),
                           *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            encoded = coder.encode([t or "" for t in batch.column(len(keep)).to_pylist()])
            ends = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
            flat = pa.array(np.concatenate([*encoded, np.empty(0, np.int32)]))
            columns = [*batch.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), flat)]
            if decoded:
                columns.append(pa.array([coder.decode(e.tolist()) for e in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "token_ids", keep: list[str] | None = None,
           path: str | None = None, text: str = "decoded") -> DataFrame:
    """``keep`` columns plus the text of the token ids (null ids: empty text)."""
    prepare(df.sparkSession)
    keep, path = ["doc_id"] if keep is None else keep, path or default_path()
    schema = T.StructType([*_kept(df, keep), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(i for i in e or [] if i is not None) for e in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=schema.names)

    return df.select(*keep, ids).mapInArrow(run, schema)
