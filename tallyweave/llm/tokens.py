"""Problem 7: encode a corpus with a public byte-level BPE vocabulary.

The encoder is a streaming transducer. A text is cut by the vocabulary's
pattern, and each part is read byte by byte. What lookahead suffices follows from
the tokens that the merges make, kept as a trie:

* the encoding of a prefix ends with the longest token that ends there and stays
  apart from the token before it, so one pass finds the last token of every
  prefix;
* a byte still to come can change only what lies behind the begin of a token that
  it may extend, that is of a read suffix that is a proper prefix of a token. A
  token on the paths to all of these is final and is emitted;
* no token holds certain pairs of neighbouring bytes: there one byte of lookahead
  is enough, and the segments between such pairs are encoded each on their own.

All of it is exact. No suffix is longer than the longest token, so the memory for
one part is constant however long it is.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import map_texts

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern that cuts a text into parts, as the vocabulary's publisher states it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bytes after which the transducer looks for final tokens.
BLOCK = 64
#: Longest part or segment, in characters or bytes, that a memo keeps.
MEMO_LENGTH = 512
#: Key of a trie's node under which the rank of the token that ends there stands; no byte.
END = -1
#: Entries of a worker's memo of encoded parts; when it is full it starts anew.
MEMO = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE and what its merges imply."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.reach = max(map(len, self.ranks))
        self.crossed = np.zeros((256, 256), dtype=bool)
        for token in self.ranks:
            for left, right in zip(token, token[1:]):
                self.crossed[left, right] = True
        self._rows = [bytes(row) for row in self.crossed.astype(np.uint8)]
        self._fits: dict[tuple[int, int], bool] = {}
        self._segments: dict[bytes, list[int]] = {}
        self.trie: dict = {}
        for token, rank in self.ranks.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[END] = rank

    def merge(self, part: bytes) -> list[int]:
        """Merge pairs of lowest rank first until none is left."""
        ranks = self.ranks
        whole = ranks.get(part)
        if whole is not None:
            return [whole]
        pieces = [part[i : i + 1] for i in range(len(part))]
        while len(pieces) > 1:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                rank = ranks.get(pieces[i] + pieces[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return [ranks[piece] for piece in pieces]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes meet."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > MEMO:
                self._fits.clear()
            known = self._fits[key] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def segments(self, part: bytes) -> Iterator[bytes]:
        """Cut where no token crosses: a boundary of every encoding."""
        rows, begin = self._rows, 0
        for i in range(1, len(part)):
            if not rows[part[i - 1]][part[i]]:
                yield part[begin:i]
                begin = i
        yield part[begin:]

    def encode_part(self, part: bytes) -> list[int]:
        out: list[int] = []
        for segment in self.segments(part):
            ids = self._segments.get(segment)
            if ids is None:
                ids = list(Transducer(self).run([segment]))
                if len(segment) <= MEMO_LENGTH:
                    if len(self._segments) >= MEMO:
                        self._segments.clear()
                    self._segments[segment] = ids
            out += ids
        return out


class Transducer:
    """Encodes one part given in blocks; emits a token once no later byte can change it."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.last = [-1]  # token that ends at each position since the origin
        self.open: list[tuple[int, dict]] = []  # (begin, trie node) of the read suffixes that a token may go on from
        self.held = -1  # a final token that isn't emitted yet: what follows the origin has to stay apart from it
        self.widest = 0  # most positions held at once, for tests

    def _read(self, byte: int) -> None:
        v, end = self.vocabulary, len(self.last)
        self.open.append((end - 1, v.trie))
        self.open = [(begin, node[byte]) for begin, node in self.open if byte in node]
        for begin, node in self.open:  # longest suffix first
            token = node.get(END)
            if token is None:
                continue
            before = self.last[begin] if begin else self.held
            if (before >= 0 or not begin) and (before < 0 or v.fits(before, token)):
                self.last.append(token)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        # a token without longer ones is no suffix to go on from
        self.open = [(begin, node) for begin, node in self.open if len(node) > (END in node)]

    def _chain(self, at: int) -> list[int]:
        ends = []
        while at > 0:
            ends.append(at)
            at -= len(self.vocabulary.tokens[self.last[at]])
        return ends[::-1]

    def _emit(self) -> Iterator[int]:
        """The tokens on the paths to the end and to the begin of every open suffix."""
        shared = set(self._chain(len(self.last) - 1))
        for begin, _ in self.open:
            shared &= set(self._chain(begin))
        if not shared:
            return
        ends = sorted(shared)
        if self.held >= 0:
            yield self.held
        for at in ends[:-1]:
            yield self.last[at]
        cut = ends[-1]
        self.held = self.last[cut]
        self.last = [-1] + self.last[cut + 1 :]
        self.open = [(begin - cut, node) for begin, node in self.open]

    def run(self, blocks: Iterable[bytes]) -> Iterator[int]:
        for block in blocks:
            for byte in block:
                self._read(byte)
                if len(self.last) > self.widest:
                    self.widest = len(self.last)
                if len(self.last) % BLOCK == 0:
                    yield from self._emit()
        if self.held >= 0:
            yield self.held
        for at in self._chain(len(self.last) - 1):
            yield self.last[at]


@lru_cache(maxsize=4)
def vocabulary(directory: str, name: str) -> Vocabulary:
    return Vocabulary(os.path.join(directory, name))


class Encoder(dict):
    """Ids of a text as packed 32-bit integers; also the memo of its parts."""

    def __init__(self, directory: str = TOKENIZERS, name: str = VOCABULARY) -> None:
        self.vocabulary = vocabulary(directory, name)
        self.cut = regex.compile(PATTERN).findall

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.vocabulary.encode_part(part.encode()), dtype=np.int32).tobytes()
        if len(part) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[part] = ids
        return ids

    def packed(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.cut(text))) if text else b""


def decode(ids: Iterable[int], words: Vocabulary) -> str:
    """Text of ids; an incremental decoder carries characters split over tokens."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join(machine.decode(words.tokens[i]) for i in ids) + machine.decode(b"", True)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """One row (id, ids) per input row, without special tokens.

    A null or empty text gives an empty list. Marks of special tokens are plain
    text. Repeated rows stay repeated, a null id stays null, other columns are
    not read, an empty table gives an empty table.
    """

    def make():
        encoder = Encoder(directory, name)

        def kernel(rows: dict[str, list]) -> pa.RecordBatch:
            parts = [encoder.packed(text) for text in rows["text"]]
            offsets = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(rows["id"], ids_type), ids], names=[id_col, "ids"])

        return kernel

    id_type = df.schema[id_col].dataType.simpleString()
    ids_type = pa.string() if id_type == "string" else pa.int32() if id_type == "int" else pa.int64()
    return map_texts(df, {"id": id_col, "text": text_col}, f"`{id_col}` {id_type}, ids array<int>", make)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", directory: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """One row (id, n_tokens) per input row; null and empty texts have 0 tokens."""

    def make():
        encoder = Encoder(directory, name)

        def kernel(rows: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array([len(encoder.packed(t)) // 4 for t in rows["text"]], pa.int64())], names=[id_col, "n_tokens"])

        return kernel

    return map_texts(df, {"id": id_col, "text": text_col}, f"`{id_col}` bigint, n_tokens bigint", make)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", directory: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """One row (id, text) per input row; an empty or null list gives an empty text."""

    def make():
        words = vocabulary(directory, name)

        def kernel(rows: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows["id"], pa.int64()), pa.array([decode(i or (), words) for i in rows["ids"]], pa.string())], names=[id_col, "text"])

        return kernel

    return map_texts(df, {"id": id_col, "ids": ids_col}, f"`{id_col}` bigint, text string", make)
