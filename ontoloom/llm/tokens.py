"""Encoding of whole texts with the tokenizers library, cached by chunks.

A text is cut at single spaces and line feeds between two other characters.  No
token of the two supported tokenizers reaches over such a place (one keeps a
space with the word after it, the other drops white space), so a chunk's ids
depend on the chunk alone and are cached as little-endian 32-bit bytes.  Arrow
tells the chunks of many texts apart.  New chunks go to the library many at a
time, joined to one string (words of Latin letters to the bare model, as they
need no normalising or splitting); tokens that only start (or only part) chunks
give the borders back.  Chunks with other white
space, and texts with runs of white space, take a slower way with the same
result.  Texts that hold a special token of the tokenizer go to the library
whole.  The cache has two generations of CACHE_BYTES / 2 each: what is met again
moves to the young one, the old one is dropped when the young one is full, so a
worker's memory stays bounded whatever the vocabulary or the length of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ontoloom.llm.common import claim, release_memory

#: Bytes of cached chunks that a worker keeps, and what an entry takes besides its characters.
CACHE_BYTES = 192 << 20
ENTRY_BYTES = 190
CALL_CHUNKS = 500
END_ID = 2
#: Text bytes that one call encodes together.
GATHER_BYTES = 2 << 20
#: Marks a text's first chunk, which has no space before it.
FIRST = "\x00"
#: A word that is one token, put between chunks where white space is dropped.
PARTER = "wednesday"
#: Words of Latin letters that stay one character each in lower case and are their own composed form.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Byte-level vocabularies write a printable byte as itself, and the others as the characters from U+0100 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}
_LEAD, _NOTHING = (pa.scalar(x, pa.large_string()) for x in (FIRST, ""))
_CUT = re.compile(r"(?<!\s) (?!\s)|(?<!\s)(?=\n\S)")
_PLAIN = re.compile(r"\n?\S+")
#: White space other than space and line feed, which sends a text the slower way, as do pairs of these two.
_OTHER = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PAIRS = ("  ", "\n\n", " \n", "\n ")


def _runs(text: str) -> bool:
    if any(x in text for x in _PAIRS) or text[0] in " \n" or text[-1] in " \n":
        return True
    return any(x in text for x in (_OTHER[:8] if text.isascii() else _OTHER))


class ChunkEncoder:
    """spaces: the tokenizer keeps a space with the word after it (else it drops white space)."""

    def __init__(self, path: str, spaces: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # The same model without normaliser and splitting rules, for words of Latin letters, which need neither.
        self._bare = Tokenizer(self._tokenizer.model)
        self._bytes = {b: c for b, c in _BYTES.items() if spaces or b != 0x20}
        if not spaces:  # else no merge reaches over the mark that begins a word
            self._bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._spaces = spaces
        self._cache: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._held = 0
        size = self._tokenizer.get_vocab_size()
        names = [self._tokenizer.id_to_token(i) or "" for i in range(size)]
        if spaces:  # byte-level names of tokens that begin with a space or line feed
            self._starts = np.array([n[:1] in ("\u0120", "\u010a") for n in names])
        else:
            self._ends = np.array([n.endswith("</w>") for n in names])
            self._part = names.index(PARTER + "</w>")
        self._tails = {c: self._one(c) for c in ",.!"}

    def _one(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _keys(self, text: str) -> list[str]:
        """Chunk keys: "x" stands for " x", "\\nx" for itself, FIRST + "x" for an "x" at the text's start."""
        if not self._spaces:
            return text.replace("\n", " ").split(" ")
        if _runs(text):
            cut = _CUT.split(text)
        else:
            cut = text.replace("\n", " \n").split(" ")
        cut[0] = FIRST + cut[0]
        return cut

    def _many(self, keys: list[str], words: bool, bare: bool = False) -> list[str]:
        """Encode keys in one call; returns them if the borders don't come out as expected.

        words: all are letters.  bare: all are Latin letters.
        """
        if bare:
            joined = " ".join(["", *keys] if self._spaces else keys)
            joined = (joined if self._spaces else joined.lower()).encode().decode("latin-1").translate(self._bytes)
        elif self._spaces:
            joined = "".join(k if k[0] == "\n" else " " + k for k in keys)
        else:
            joined = " ".join(keys) if words else f" {PARTER} ".join([*keys, ""])
        tokenizer = self._bare if bare else self._tokenizer
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        if self._spaces:
            begin = np.flatnonzero(self._starts[ids])
            end = np.append(begin[1:], len(ids))
        elif words:
            end = np.flatnonzero(self._ends[ids]) + 1
            begin = np.append(0, end[:-1])
        else:
            end = np.flatnonzero(ids == self._part)
            begin = np.append(0, end[:-1] + 1)
        if len(begin) != len(keys) or begin[0]:
            return keys
        raw = ids.tobytes()
        self._cache.update((k, raw[a:b]) for k, a, b in zip(keys, (begin * 4).tolist(), (end * 4).tolist(), strict=True))
        return []

    def _add(self, new: list[str]) -> None:
        cache, later, plain, words, letters, latin, tailed = self._cache, [], [], [], [], [], []
        whole = plain if self._spaces else words  # a run of letters is one pre-token, so its last token alone ends a word
        known = set(new)
        for k in new:
            if k.isalpha() and (k.isascii() or k.lower().isalpha()):
                (letters if k.isascii() else latin if _LATIN.fullmatch(k) else whole).append(k)
            elif not _PLAIN.fullmatch(k) or k[0] == FIRST and self._spaces or not self._spaces and PARTER in k.lower():
                later.append(k)
            elif k[-1] in self._tails and len(k) > 1 and (base := k[:-1]).isalpha() and (base.isascii() or base.lower().isalpha()):
                # A word and the mark after it are separate tokens.
                tailed.append((k, base, k[-1]))
                if base not in cache and base not in known:
                    known.add(base)
                    (letters if base.isascii() else latin if _LATIN.fullmatch(base) else whole).append(base)
            else:
                plain.append(k)
        for keys, alpha, bare in ((letters, True, True), (latin, True, True), (words, True, False), (plain, False, False)):
            for i in range(0, len(keys), CALL_CHUNKS):
                later += self._many(keys[i : i + CALL_CHUNKS], alpha, bare)
        for k in filterfalse(cache.__contains__, later):
            cache[k] = self._one(k[1:] if self._spaces and k[:1] == FIRST else k if not self._spaces or k[:1] == "\n" else " " + k)

        for k, base, tail in tailed:
            cache[k] = cache[base] + self._tails[tail]

    def _turn(self) -> dict[str, bytes]:
        """The young generation, after it took the old one's place if it was full."""
        if self._held > CACHE_BYTES // 2:
            self._cache, self._old, self._held = {}, self._cache, 0
        return self._cache

    def _meet(self, keys: list[str]) -> None:
        """Have all keys in the young generation."""
        cache, old, before = self._cache, self._old, len(self._cache)
        new = []
        for k in filterfalse(cache.__contains__, keys):
            if k in old:
                cache[k] = old[k]
            else:
                new.append(k)
        if new:
            self._add(new)
        self._held += (len(cache) - before) * ENTRY_BYTES + 8 * sum(map(len, new))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, without an end id."""
        flat, at = self.encode_flat(texts)
        raw, at = flat.tobytes(), (at * 4).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and len(texts) + 1 places in it where texts begin or end.

        Chunks are told apart by Arrow, so Python sees each chunk once in a call, not once an occurrence.
        """
        cache = self._turn()
        odd = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self._special) or self._spaces and FIRST in text:
                odd[i] = self._one(text)
            elif self._spaces and _runs(text):
                keys = self._keys(text)
                self._meet(list(set(keys)))
                odd[i] = b"".join(map(cache.__getitem__, keys))
        clean = pa.array(["" if i in odd else t or "" for i, t in enumerate(texts)], pa.large_string())
        if self._spaces:
            clean = pc.binary_join_element_wise(_LEAD, pc.replace_substring(clean, "\n", " \n"), _NOTHING)
        else:
            clean = pc.replace_substring(clean, "\n", " ")
        cut = pc.split_pattern(clean, " ")
        found = cut.values.dictionary_encode()
        keys = found.dictionary.to_pylist()
        cache.setdefault(FIRST if self._spaces else "", b"")
        self._meet(keys)
        raws = list(map(cache.__getitem__, keys))
        ids = np.frombuffer(b"".join(raws), dtype="<u4")
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // 4
        which = found.indices.to_numpy()
        each = size[which]
        ends = np.append(0, np.cumsum(each))
        place = np.repeat(((np.cumsum(size) - size)[which] - ends[:-1]).astype(np.int32), each)
        place += np.arange(ends[-1], dtype=np.int32)
        flat = ids[place]
        at = ends[cut.offsets.to_numpy()]
        if odd:
            parts, last = [], 0
            for i, raw in odd.items():
                parts += [flat[last : at[i]], np.frombuffer(raw, dtype="<u4")]
                last = at[i]
            flat = np.concatenate([*parts, flat[last:]])
            grown = np.zeros(len(at), np.int64)
            grown[[i + 1 for i in odd]] = [len(r) // 4 for r in odd.values()]
            at = at + np.cumsum(grown)
        return flat, at


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaces: bool) -> ChunkEncoder:
    """One encoder a worker process; later tasks find its cache filled, until a stage with another cache comes."""
    claim("tokens", _encoders.clear)
    key = (path, spaces)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, spaces)
    return _encoders[key]


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about GATHER_BYTES, so that a call meets a frequent chunk once in many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= GATHER_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    del held
    release_memory()


def encoded(texts: pa.Array, path: str, spaces: bool, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, each text followed by end_id, and the len(texts) + 1 places where texts begin or end."""
    flat, at = encoder(path, spaces).encode_flat(texts.to_pylist())
    return np.insert(flat, at[1:], np.uint32(end_id)), at + np.arange(len(at))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
