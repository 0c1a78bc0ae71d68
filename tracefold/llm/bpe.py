"""Tokenising with a public byte-level BPE vocabulary, by distinct chunks of a column.

A byte-level pre-tokenizer never joins what stands before white space to what
comes after it, so a text falls into chunks, each a run of white space with the
word after it, whose ids together are the text's ids. Texts are split and their
distinct chunks numbered by Arrow; only chunks that weren't met before go to the
tokenizer, and NumPy puts the ids of all chunks together. Texts with rare white
space, or that hold an added token such as <|endoftext|>, go to the tokenizer
whole. All ways give the ids of the whole text.

Punctuation after a word's letters is a piece of its own, so such words need to
be known only once. Words of plain letters are new most often; they go to the
same model in the byte-level spelling, which needs no pre-tokenizing pattern.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that the pre-tokenizer's pattern knows beside space, newline, tab and return.
_RARE_SPACE = "\x0b\x0c\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Texts with such white space are cut into chunks by a pattern, others by Arrow.
_MIXED = "[\\t\\r]|[ \\n\\t\\r][ \\n\\t\\r]"
_CHUNK = re.compile("[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Chunks remembered at most; those met in one stretch of text only are forgotten first.
REMEMBERED = 700_000
#: Bytes of text that are split together.
STRETCH = 8_000_000
_TAIL = "".join(c for c in string.punctuation if c != "'")
#: Letters below this are letters for every Unicode version.
_LETTERS_BELOW = "\u0250"


def _spelling() -> dict[int, str]:
    """Byte-level spelling: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Store:
    """Runs of ids, told by number."""

    def __init__(self):
        self.pool = np.zeros(1 << 16, dtype="<u4")
        self.starts = np.zeros(1 << 14, dtype=np.int64)
        self.lens = np.zeros(1 << 14, dtype=np.int64)
        self.used = self.n = 0

    def add(self, ids: np.ndarray, lens: np.ndarray) -> range:
        """Keep runs that lie one after the other in ``ids``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.n + len(lens) > len(self.starts):
            self.starts, self.lens = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens))
        at = self.used + np.concatenate(([0], np.cumsum(lens)))[: len(lens)]
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(lens)], self.lens[self.n : self.n + len(lens)] = at, lens
        self.used += len(ids)
        self.n += len(lens)
        return range(self.n - len(lens), self.n)

    def gather(self, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The ids of many runs, one after the other."""
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids; ``encode_column`` those of an Arrow column, stretch by stretch."""

    def __init__(self, path: str, remembered: int = REMEMBERED, stretch: int = STRETCH):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tk = Tokenizer.from_file(path)
        self._model = self._tk.model
        added = sorted((t.content for t in self._tk.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._whole = "|".join([f"[{_RARE_SPACE}]", *map(re.escape, added)])  # texts that go to the tokenizer whole
        self._spell = _spelling()
        self._remembered, self._stretch = remembered, stretch
        with open(path, encoding="utf-8") as f:
            pre = json.load(f).get("pre_tokenizer") or {}
        newline = self._ids("\n")
        self._chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and len(newline) == 1
        self._newline = newline
        self.vocab_size = self._tk.get_vocab_size()
        self._tails: dict[str, list[int]] = {}
        self._forget({})

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tk.encode(text, add_special_tokens=False).ids, dtype="<u4")

    # --- what is remembered: chunk to number of its run --------------------------

    def _forget(self, kept: dict[str, np.ndarray]) -> None:
        self._store = _Store()
        self._known: dict[str, int] = {}
        space = self._ids(" ")
        self._known |= zip(("", "\n"), self._store.add(np.concatenate((space, self._newline)), np.array([len(space), len(self._newline)])))
        self._seen = np.zeros(1 << 14, dtype=np.int32)
        if kept:
            self._known |= zip(kept, self._store.add(np.concatenate(list(kept.values())), np.array([len(x) for x in kept.values()])))

    def _make_room(self) -> None:
        """Once too many are remembered, only those met in several stretches stay."""
        if self._store.n <= self._remembered:
            return
        seen = self._seen
        often = sorted((k for k, n in self._known.items() if n < len(seen) and seen[n] > 1), key=lambda k: -seen[self._known[k]])[: self._remembered // 4]
        at = [self._known[k] for k in often]
        self._forget({k: self._store.pool[self._store.starts[n] : self._store.starts[n] + self._store.lens[n]] for k, n in zip(often, at)})

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        get = self._known.get
        found = np.array([get(c, -1) for c in chunks], dtype=np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn([chunks[k] for k in new.tolist()])
        return found

    def _learn(self, new: list[str]) -> range:
        """Numbers of different chunks that weren't met before. A chunk is kept without its space; one that begins a line begins with the newline."""
        model, spell = self._model, self._spell
        space, newline = spell[32], self._newline.tolist()
        cores: dict[str, list[int]] = {}
        ids: list[int] = []
        lens: list[int] = []
        for c in new:
            if c[0] == "\n":
                word, lead, own = c[1:], "", newline
            else:
                word, lead, own = c, space, []
            core = word.rstrip(_TAIL)
            if c[0] in " \t\r" or not core.isalpha() or not (core.isascii() or max(core) < _LETTERS_BELOW):
                # numbers, signs, mixtures, mixed white space: by the tokenizer as it is
                own = self._ids(c if c[0] in " \n\t\r" else " " + c).tolist()
            else:
                key = lead + core
                found = cores.get(key)
                if found is None:
                    spelled = key if core.isascii() else lead + core.encode().decode("latin-1").translate(spell)
                    found = cores[key] = [t.id for t in model.tokenize(spelled)]
                own = own + found
                if len(core) < len(word):
                    own = own + self._tail(word[len(core) :])
            ids += own
            lens.append(len(own))
        added = self._store.add(np.array(ids, dtype="<u4"), np.array(lens, dtype=np.int64))
        self._known |= zip(new, added)
        return added

    def _tail(self, tail: str) -> list[int]:
        found = self._tails.get(tail)
        if found is None:
            found = self._ids(tail).tolist()
            if len(self._tails) < 100_000:
                self._tails[tail] = found
        return found

    # --- texts ------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        """A text's chunks as they are remembered."""
        out = _CHUNK.findall("\n" + text if not text or text[0] not in " \n\t\r" else text)
        return [c[1:] if c[0] == " " and (len(c) == 1 or c[1] not in " \n\t\r") else c for c in out]

    def _stretch_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin and the last one's end)."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        self._make_room()
        n = len(texts)
        whole = pc.match_substring_regex(texts, self._whole).to_numpy(zero_copy_only=False) if self._chunked else np.ones(n, dtype=bool)
        mixed = pc.match_substring_regex(texts, _MIXED).to_numpy(zero_copy_only=False) & ~whole
        other = np.flatnonzero(whole | mixed)
        split = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", texts.type), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", texts.type)), " ")
        if len(other):
            split = pc.if_else(pa.array(whole | mixed), pa.scalar(["\n"], split.type), split)
        words = split.flatten().dictionary_encode()
        cuts = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy()))).astype(np.int64)
        numbers = self._numbers(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        if len(self._seen) < self._store.n:
            self._seen = np.concatenate((self._seen, np.zeros(len(self._store.starts) - len(self._seen), dtype=np.int32)))
        self._seen[numbers] += 1
        runs = numbers[words.indices.to_numpy()]
        starts, lens = self._store.starts[runs], self._store.lens[runs]
        starts[cuts[:-1]] += 1  # the newline set before each text
        lens[cuts[:-1]] -= 1
        ids = self._store.gather(starts, lens)
        ends = np.concatenate(([0], np.cumsum(lens)))[cuts]
        if len(other):
            parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            for k in other.tolist():
                t = texts[k].as_py()
                if whole[k]:
                    parts[k] = self._ids(t)
                else:
                    own, at = np.unique(self._chunks(t), return_inverse=True)
                    own = self._numbers(own.tolist())[at]
                    got = self._store.gather(self._store.starts[own], self._store.lens[own])
                    parts[k] = got if t[0] in " \n\t\r" else got[1:]
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, ends

    def encode_column(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, where each row's begin and the last one's end) of stretches of rows; null is empty.

        With ``end_id`` that id follows each row's.
        """
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(column).to_numpy())
        at = 0
        while at < len(column):
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + self._stretch, side="right")))
            ids, cuts = self._stretch_ids(column.slice(at, end - at))
            if end_id is not None:
                ids = np.insert(ids, cuts[1:], end_id)
                cuts = cuts + np.arange(len(cuts))
            yield at, end, ids.astype("<u4", copy=False), cuts
            at = end

    def encode(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        return [ids[a:b].tobytes() for _, _, ids, cuts in self.encode_column(pa.array(texts, pa.large_string()), end_id) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and vocabulary file."""
    return ChunkEncoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
