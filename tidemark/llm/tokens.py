"""Tokenizers of the ``tokenizers`` library, with a bounded memo of words.

Byte-level BPE never joins characters across a single space that stands
between two other non-space characters, so a text is the concatenation of its
space-separated words and each distinct word is encoded once per task while it
stays in the memo.  Other kinds of tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa

#: A space that stands between two characters that aren't white space.
_JOINT = re.compile(r"(?<=\S) (?=\S)")
#: Characters whose words are looked up together.
_GROUP_CHARS = 1 << 20
#: Without any of these inside, and without a space at either end, every space
#: of a text is a joint.
_UNEVEN = ("  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))


def _even(text: str) -> bool:
    return text[:1] != " " and text[-1:] != " " and not any(map(text.__contains__, _UNEVEN))


@lru_cache(maxsize=2)
def worker_encoder(path: str, end_id: int | None, special_as_text: bool = False) -> Encoder:
    """The encoder of this Python worker, kept with its memo from task to task."""
    return Encoder(path, end_id, special_as_text=special_as_text)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself
    where it is printable Latin-1, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Texts to ids as little-endian bytes, ``width`` bytes for each id.

    The string of a special token in a text becomes that token, as the library
    does it, or with ``special_as_text`` the tokens of its characters, so that
    no text can hold the token's id.
    """

    def __init__(self, path: str, end_id: int | None = None, memo: int = 300_000, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.special = () if special_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), (end_id or 0) + 1)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.words = _Words(self, memo) if _splits_at_spaces(path) else None
        self.firsts: dict[bytes, bytes] = {}
        self.table = WordTable(self.words.fresh, self.dtype) if self.words is not None else None

    @property
    def width(self) -> int:
        return self.dtype.itemsize

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def __call__(self, text: str | None) -> bytes:
        """Ids of the text, then the end id."""
        if not text:
            return self.end
        if self.words is None or any(map(text.__contains__, self.special)):
            return self.whole(text) + self.end
        chunks = text.split(" ") if _even(text) else _JOINT.split(text)
        if len(chunks) == 1:
            return self.words.encode(text) + self.end
        first, chunks[0] = self.words.encode(chunks[0]), ""
        chunks.pop(0)
        return first + b"".join(map(self.words.__getitem__, chunks)) + self.end

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow array, as if called one by one, with
        words looked up in NumPy arrays for many texts at once."""
        strings = texts.to_pylist()
        out: list[bytes] = [b""] * len(strings)
        group: list[int] = []
        size = 0
        for row, t in enumerate(strings):
            if not t or self.words is None or len(t) > _GROUP_CHARS or not _even(t) or any(map(t.__contains__, self.special)):
                out[row] = self(t)
                continue
            group.append(row)
            size += len(t)
            if size > _GROUP_CHARS:
                self._group(strings, group, out)
                group, size = [], 0
        if group:
            self._group(strings, group, out)
        return out

    def _group(self, strings: list[str], group: list[int], out: list[bytes]) -> None:
        flat = [strings[row].encode() for row in group]
        joined = b" ".join(flat) + b" "
        ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts = np.concatenate([[0], ends[:-1] + 1])
        # each text's first and last word: texts lie one after another
        lasts = np.searchsorted(ends, np.cumsum([len(x) + 1 for x in flat]) - 1) + 1
        firsts = np.concatenate([[0], lasts[:-1]])
        if int((ends - starts).max()) > WordTable.LONGEST:
            long = np.maximum.reduceat(ends - starts, firsts) > WordTable.LONGEST
            for row in np.array(group)[long].tolist():
                out[row] = self(strings[row])
            if not long.all():
                self._group(strings, np.array(group)[~long].tolist(), out)
            return
        ids, edges = self.table.look_up(joined, starts, ends)
        width, data = self.width, memoryview(ids.tobytes())
        begin, end = edges[firsts + 1] * width, edges[lasts] * width
        for row, a, b, i in zip(group, begin.tolist(), end.tolist(), firsts.tolist(), strict=True):
            word = joined[starts[i] : ends[i]]
            own = self.firsts.get(word)
            if own is None:
                if len(self.firsts) >= 50_000:
                    self.firsts.clear()
                own = self.firsts[word] = self.words.encode(word.decode())
            out[row] = b"".join((own, data[a:b], self.end))


class Block:
    """Words of a byte string as little-endian numbers of eight bytes each, one
    word's after the other, the last one padded with zeros."""

    MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)

    def __init__(self, joined: bytes, starts: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        self.n = (sizes + 7) >> 3
        self.first = np.cumsum(self.n) - self.n
        step = 8 * (np.arange(int(self.n.sum())) - np.repeat(self.first, self.n))
        everywhere = np.ndarray((len(joined),), "<u8", joined + bytes(7), strides=(1,))
        self.numbers = everywhere[np.repeat(starts, self.n) + step] & self.MASKS[np.minimum(np.repeat(sizes, self.n) - step, 8)]

    def keys(self) -> np.ndarray:
        key = self.sizes.astype(np.uint64) * self.FACTORS[0]
        on, k = np.arange(len(key)), 0
        while len(on):
            x = (key[on] ^ self.numbers[self.first[on] + k]) * self.FACTORS[1]
            key[on] = x ^ (x >> np.uint64(29))
            k += 1
            on = on[self.n[on] > k]
        return key


class WordTable:
    """Ids of words with a space before them, in an open hash table of NumPy
    arrays; a whole block of words is hashed, found and gathered at once.

    A word with the hash of a stored one is compared with it byte for byte.  A
    full table starts anew.
    """

    SLOTS = 1 << 21
    FULL = 1_100_000
    LONGEST = 255

    def __init__(self, encode, dtype: np.dtype):
        self.encode, self.dtype = encode, dtype
        self.clear()

    def clear(self) -> None:
        self.n, self.used, self.held = 0, 0, 0
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.length = np.zeros(self.SLOTS, np.int32)  # in bytes
        self.word = np.zeros(self.SLOTS, np.int64)  # in ``numbers``
        self.at = np.zeros(self.SLOTS, np.int64)  # in ``pool``
        self.size = np.zeros(self.SLOTS, np.int32)  # every word has an id: 0 is an empty slot
        self.pool = np.empty(1 << 16, self.dtype)
        self.numbers = np.empty(1 << 16, np.uint64)

    def same(self, block: Block, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether the words in ``row`` of the block are those stored in ``slot``."""
        out = self.length[slot] == block.sizes[row]
        on, k = np.flatnonzero(out), 0
        while len(on):
            equal = block.numbers[block.first[row[on]] + k] == self.numbers[self.word[slot[on]] + k]
            out[on[~equal]] = False
            k += 1
            on = on[equal & (block.n[row[on]] > k)]
        return out

    def find(self, keys: np.ndarray, block: Block, todo: np.ndarray) -> np.ndarray:
        """Slots of the words ``todo`` of the block, -1 where they aren't there."""
        out = np.full(len(todo), -1)
        at = np.arange(len(todo))
        slot = (keys[todo] >> np.uint64(43)).astype(np.int64)
        while len(at):
            there = self.size[slot] > 0
            same = there & (self.keys[slot] == keys[todo[at]])
            hit = np.flatnonzero(same)
            same[hit] = self.same(block, todo[at[hit]], slot[hit])
            out[at[same]] = slot[same]
            more = there & ~same
            at, slot = at[more], (slot[more] + 1) % self.SLOTS
        return out

    @staticmethod
    def _room(pool: np.ndarray, used: int, fresh: np.ndarray) -> np.ndarray:
        if used + len(fresh) > len(pool):
            pool = np.concatenate([pool[:used], np.empty(len(fresh) + used + (1 << 16), pool.dtype)])
        pool[used : used + len(fresh)] = fresh
        return pool

    def insert(self, keys: np.ndarray, block: Block, rows: np.ndarray, ids: list[bytes]) -> None:
        """Store the words ``rows`` of the block, none of which is there."""
        size = np.array([len(x) for x in ids]) // self.dtype.itemsize
        self.pool = self._room(self.pool, self.used, np.frombuffer(b"".join(ids), self.dtype))
        at = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        n = block.n[rows]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.numbers = self._room(self.numbers, self.held, block.numbers[np.repeat(block.first[rows], n) + step])
        word = self.held + np.cumsum(n) - n
        self.held += int(n.sum())
        self.n += len(ids)
        todo = np.arange(len(ids))
        slot = (keys[rows] >> np.uint64(43)).astype(np.int64)
        while len(todo):
            _, winner = np.unique(slot, return_index=True)
            winner = winner[self.size[slot[winner]] == 0]
            to, own = slot[winner], todo[winner]
            self.keys[to], self.length[to], self.word[to] = keys[rows[own]], block.sizes[rows[own]], word[own]
            self.at[to], self.size[to] = at[own], size[own]
            rest = np.ones(len(todo), bool)
            rest[winner] = False
            todo, slot = todo[rest], slot[rest]
            slot = np.where(self.size[slot] > 0, (slot + 1) % self.SLOTS, slot)

    def look_up(self, joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin."""
        block = Block(joined, starts, ends - starts)
        keys = block.keys()
        every = np.arange(len(starts))
        slot = self.find(keys, block, every)
        missing = np.flatnonzero(slot < 0)
        if self.n + len(missing) > self.FULL:
            self.clear()
            missing = every
        while len(missing):  # once more only if two new words agree in the hash
            new = missing[np.unique(keys[missing], return_index=True)[1]]
            self.insert(keys, block, new, [self.encode(joined[a:b].decode()) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            slot[missing] = self.find(keys, block, missing)
            missing = missing[slot[missing] < 0]
        size = self.size[slot]
        edges = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return self.pool[np.repeat(self.at[slot] - edges[:-1], size) + np.arange(edges[-1])], edges


class _Words(dict):
    """Ids of a word with a space before it.

    Two generations bound the memo: when this dictionary is full it becomes the
    older one, from which words in use come back.
    """

    #: Below this code point, letters and digits are the same in every library's
    #: Unicode tables.
    SETTLED = "\u0500"
    LONGEST = 256

    def __init__(self, encoder: Encoder, memo: int):
        import public_tokenizers
        import regex

        self.encoder, self.memo = encoder, memo // 2
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.shown = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.space = byte_alphabet()[0x20]
        self.tokenize = encoder.tokenizer.model.tokenize
        code = {2: "H", 4: "I"}[encoder.width]
        self.packs = [struct.Struct(f"<{n}{code}").pack for n in range(4 * self.LONGEST + 1)]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.fresh(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.memo:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def fresh(self, word: str) -> bytes:
        """Ids of a word with a space before it, whether it is known or not."""
        if word.isascii() and word.isalpha() and len(word) <= self.LONGEST:
            return self.packed(self.tokenize(self.space + word))
        return self.encode(" " + word)

    def piece(self, piece: str) -> bytes:
        return self.packed(self.tokenize(piece.encode().decode("latin-1").translate(self.shown)))

    def packed(self, found: list) -> bytes:
        return self.packs[len(found)](*[t.id for t in found])

    def encode(self, text: str) -> bytes:
        if len(text) > self.LONGEST or not text.isascii() and max(text) >= self.SETTLED:
            return self.encoder.whole(text)
        pieces = self.split(text)
        if len(pieces) == 1:
            return self.piece(text)
        out = b""
        for piece in pieces:
            if piece[0] == " " and piece[1:].isalpha():
                out += self[piece[1:]]
                continue
            ids = self.pieces.get(piece)
            if ids is None:
                if len(self.pieces) >= self.memo // 4:
                    self.pieces.clear()
                ids = self.pieces[piece] = self.piece(piece)
            out += ids
        return out


def _splits_at_spaces(path: str) -> bool:
    """Whether the file is plain byte-level BPE with the usual word pattern."""
    x = json.loads(Path(path).read_text())
    before, model = x.get("pre_tokenizer") or {}, x["model"]
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space", True)
        and x.get("normalizer") is None
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and not any(t for t in x["added_tokens"] if not t["special"])
    )
