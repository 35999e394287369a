"""Byte-level BPE by content-defined chunk reuse.

A gear rolling hash over the UTF-8 bytes picks chunk boundaries from content alone, so a
passage that recurs in many documents yields the same chunks wherever it stands. A chunk is
encoded and decoded once per task and served from a bounded cache afterwards. Boundaries fall
anywhere, also within words, so every join is repaired: a few tokens on either side are encoded
again as one window, which is widened until it agrees with what lies on both its sides, that is
until its first and last tokens are those of the chunks, up to a place on either side where a
pre-token is known to start (a space or line end behind a character that is none; no pre-token
of a byte-level BPE reaches across one). A chunk without such a place is encoded again together
with those behind it.

Rows: a null text counts as empty; empty texts have no tokens; ids may repeat or be null and
are carried as they are; only the two named columns are read, so extra columns never clash.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pre-tokenizer of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "byte_bpe_50k.json"
#: Bytes that a task's chunk cache may hold, in two generations.
CACHE_BYTES = 48_000_000
MASK = np.uint32(0xFF << 20)
SHORTEST_CHUNK, LONGEST_CHUNK = 64, 4096
#: Tokens on either side of a join that are encoded again first.
WINDOW = 3
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: bytes) -> list[int]:
    """Chunk starts behind 0: starts of characters where the rolling hash of the 16 bytes before
    them hits the mask, or has its least value where no such place comes for long."""
    n = len(data)
    if n <= 2 * SHORTEST_CHUNK:
        return []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    starts = np.flatnonzero(((h[:-1] & MASK) == 0) & ((b[1:] & 0xC0) != 0x80)) + 1
    out, last = [], 0
    for at in [*starts.tolist(), n]:
        while at - last > LONGEST_CHUNK:  # no boundary in reach: cut by the same hash, anywhere
            lo, hi = last + LONGEST_CHUNK // 2, last + LONGEST_CHUNK
            last = lo + int(np.argmin(h[lo - 1 : hi - 1]))
            while data[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if at < n and at - last >= SHORTEST_CHUNK:
            out.append(at)
            last = at
    return out


def starts_pre_token(data: bytes, at: int) -> bool:
    """Whether a pre-token certainly starts at a place within the text, whatever stands around;
    both ends of the text count."""
    if not 0 < at < len(data):
        return True
    before = data[at - 1]
    return data[at] in (32, 10) and before < 128 and before not in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)


class ChunkCodec:
    """Encodes and decodes whole texts, each distinct chunk once while it stays cached."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE tokenizer")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(c): c for c in printable} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(printable))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if len(special) > 1:
            raise ValueError("more than one added token")
        self.special, self.special_id = next(iter(special.items()), (None, None))
        ranks = {bytes(map(to_byte.__getitem__, k)): v for k, v in model["vocab"].items() if k not in special}
        self.table = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        if self.special is not None:
            self.table[self.special_id] = self.special.encode()
        self._bpe = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._young, self._old, self._held, self._most = {}, {}, 0, cache_bytes // 2
        self.encoded = self.reused = self.repaired = self.widened = self.merged = 0
        self.encoded_bytes = self.reused_bytes = 0

    def _ids(self, data: bytes) -> array:
        """The ids of some bytes, which they must stand for exactly."""
        ids = array("I", self._bpe(data.decode()))
        if b"".join(map(self.table.__getitem__, ids)) != data:
            raise ValueError("the tokenizer does not keep its input")
        return ids

    def _chunk(self, data: bytes) -> array:
        """The ids of a chunk, encoded once while it stays cached."""
        got = self._young.get(data)
        if got is None:
            got = self._old.get(data)
            if got is None:
                got = self._ids(data)
                self.encoded += 1
                self.encoded_bytes += len(data)
            else:
                self.reused += 1
                self.reused_bytes += len(data)
            self._young[data] = got
            self._held += 200 + len(data) + 4 * len(got)
            if self._held > self._most:
                self._young, self._old, self._held = {}, self._young, 0
        else:
            self.reused += 1
            self.reused_bytes += len(data)
        return got

    def _agreed(self, data: bytes, at: int, window: list[int], side: list[int], step: int) -> bool:
        """Whether ``window`` and ``side`` agree, token by token from the window's end at ``at``
        inwards (``step`` 1 from the left, -1 from the right), up to a place where a pre-token
        starts."""
        if starts_pre_token(data, at):
            return True
        for a, b in zip(window[::step], side[::step], strict=False):
            if a != b:
                return False
            at += step * len(self.table[a])
            if starts_pre_token(data, at):
                return True
        return False

    def _join(self, data: bytes, out: array, at: int, right: array, end: int) -> bool:
        """Append ``right``, the ids of data[at:end], to ``out``, those of all before, with the
        join repaired; False (and nothing done) where ``right`` is too short for that."""
        n, table = WINDOW, self.table
        while True:
            left, ahead = out[-n:].tolist(), right[:n].tolist()
            a, b = at - sum(len(table[i]) for i in left), at + sum(len(table[i]) for i in ahead)
            # a token may end within a character: then no window can end there
            if (a == 0 or data[a] & 0xC0 != 0x80) and (b == len(data) or data[b] & 0xC0 != 0x80):
                window = self._bpe(data[a:b].decode())
                if self._agreed(data, a, window, left, 1) and self._agreed(data, b, window, ahead, -1):
                    break
            if b == end and end < len(data) and n >= len(right) and not starts_pre_token(data, end):
                return False
            n *= 2
            self.widened += 1
        del out[len(out) - len(left) :]
        out.extend(window)
        out.extend(right[len(ahead) :])
        self.repaired += 1
        return True

    def _segment(self, data: bytes) -> array:
        starts = [0, *cuts(data), len(data)]
        out = array("I", self._chunk(data[: starts[1]]))
        k = 1
        while k < len(starts) - 1:
            end = k + 1
            right = self._chunk(data[starts[k] : starts[end]])
            while not self._join(data, out, starts[k], right, starts[end]):
                end = min(len(starts) - 1, end + (end - k))  # twice as far, as one piece
                right = self._ids(data[starts[k] : starts[end]])
                self.merged += 1
            k = end
        return out

    def encode(self, text: str | None) -> array:
        out = array("I")
        if not text:
            return out
        if self.special is None or self.special not in text:
            return self._segment(text.encode())
        for i, part in enumerate(text.split(self.special)):
            if i:
                out.append(self.special_id)
            if part:
                out.extend(self._segment(part.encode()))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


def little(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "big" or ids.itemsize != 4:
        return np.array(ids, "<u4").tobytes()
    return ids.tobytes()


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: the id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    One narrow pass without a shuffle: a task holds an Arrow batch and a bounded cache."""
    kind = df.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(path or tokenizer_path())
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, a, b, lists = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text)
                    n.append(len(ids))
                    a.append(hashlib.sha256(little(ids)).hexdigest())
                    b.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    if with_ids:
                        lists.append(np.array(ids, np.int32))
                columns = {id_col: part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
                if with_ids:
                    columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Per row: the id and the decoded text; a null list decodes to an empty text."""
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(path or tokenizer_path(), 0)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [codec.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "text": pa.array(texts, pa.string())})

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, text string")
