"""Token ids of whole texts under a byte-level vocabulary, with repeated words encoded once.

A text is cut before every space that stands in front of a visible character.
The byte-level pre-tokenizer cuts there as well, whatever stands around: a
word takes one space in front of it along, and a run of white space leaves its
last one to it. So the ids of the parts, joined, are the ids of the text. A
part is cut on into pre-tokens. Both repeat, and a worker keeps the ids of a
bounded number of short ones; what is forgotten is encoded again.

Texts that hold an added token of the tokenizer are cut at it first, as it
ends the white space before it.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Cut points: a space before a visible character.
CUT = re.compile(r" (?=\S)")
#: A text without this has a cut at every space.
ODD_SPACE = re.compile(r" (?!\S)")
#: The pattern of the byte-level pre-tokenizer.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Marks that end words; none is a space, letter, number or apostrophe.
MARKS = ".,;:!?&#$*%|<>()[]{}\"-_+=/\\^~@`"

#: Strings in one generation of what a worker keeps, and the longest one kept.
KEEP = 300_000
KEEP_CHARS = 48
#: Characters encoded between two looks at what is kept.
CALL_CHARS = 8 << 20
#: Words joined for one call of the library.
WORDS_CALL = 2_000


def id_width(vocabulary: int) -> int:
    """Bytes of the smallest unsigned integer that holds every id."""
    return 2 if vocabulary <= 1 << 16 else 4


def _strings(values: pa.StringArray) -> list[str]:
    """The strings of an array without nulls."""
    return values.to_numpy(zero_copy_only=False).tolist()


class Kept:
    """Ids by string: those in use, and the short ones used lately.

    Two generations of bounded size: a string that is used again moves to the
    young one, and the old one goes when the young one is full.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], keep: int):
        self.make, self.keep = make, keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, strings: list[str]) -> list[bytes]:
        """The ids of strings that differ from each other."""
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, strings))
        if None not in out:
            return out
        places = [k for k, ids in enumerate(out) if ids is None]
        rare = [strings[k] for k in places]
        found = list(map(self.old.get, rare)) if self.old else [None] * len(rare)
        new = [s for s, ids in zip(rare, found) if ids is None]
        made = iter(self.make(new) if new else ())
        for n, k in enumerate(places):
            if found[n] is None:
                found[n] = next(made)
            out[k] = found[n]
        if new and max(map(len, new)) > KEEP_CHARS:
            self.young.update((s, ids) for s, ids in zip(rare, found) if len(s) <= KEEP_CHARS)
        else:
            self.young.update(zip(rare, found))
        return out


class Encoder:
    """Ids of texts as little-endian unsigned integers.

    ``make`` gives the ids of pre-tokens; ``added`` maps the tokenizer's added
    tokens to their ids.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], vocabulary: int, added: dict[str, int]):
        self.width = id_width(vocabulary)
        self.kind = np.dtype(f"<u{self.width}")
        self.added = {t: np.array([i], self.kind).tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.make = make
        self.tokens = Kept(make, KEEP)
        self.first = Kept(lambda parts: self._parts(parts, ""), KEEP)
        self.later = Kept(lambda parts: self._parts(parts, " "), KEEP + KEEP // 2)  # most words are here

    def _parts(self, parts: list[str], before: str) -> list[bytes]:
        """Ids of parts, from those of their pre-tokens; letters alone are one."""
        plain = list(map(str.isalpha, parts))
        words = iter(self.make([before + p for p, x in zip(parts, plain) if x]))
        cut = [PRE_TOKEN.findall(before + p) for p, x in zip(parts, plain) if not x]
        different = list(set(chain.from_iterable(cut)))
        tokens = dict(zip(different, self.tokens.get(different)))
        others = iter([b"".join([tokens[t] for t in found]) for found in cut])
        return [next(words) if x else next(others) for x in plain]

    def _later(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that follow a space: a word's are kept once, whatever marks end it.

        Marks behind letters are a pre-token of their own.
        """
        stems = [p.rstrip(MARKS) for p in parts]
        keys = [s if s.isalpha() else p for s, p in zip(stems, parts)]
        different = list(set(keys))
        ids = dict(zip(different, self.later.get(different)))
        ended = [(k, len(s)) for k, (s, p) in enumerate(zip(keys, parts)) if len(s) != len(p)]
        out = list(map(ids.__getitem__, keys))
        if ended:
            marks = [parts[k][n:] for k, n in ended]
            known = list(set(marks))
            after = dict(zip(known, self.tokens.get(known)))
            for (k, _), m in zip(ended, marks):
                out[k] += after[m]
        return out

    def _joined(self, parts: pa.StringArray, ends: np.ndarray) -> list[bytes]:
        """Ids of texts given as their parts; ``ends`` has where each text's parts begin and end."""
        known = parts.dictionary_encode()
        table = self._later(_strings(known.dictionary))
        ids = list(map(table.__getitem__, known.indices.to_numpy().tolist()))
        opening = _strings(parts.take(pa.array(ends[:-1])))
        different = list(set(opening))
        opens = dict(zip(different, self.first.get(different)))
        bounds = ends.tolist()
        for a, part in zip(bounds, opening):
            ids[a] = opens[part]
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:])]

    def _plain(self, texts: list[str]) -> list[bytes]:
        odd = [bool(ODD_SPACE.search(t)) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        even = [k for k, x in enumerate(odd) if not x]
        if even:
            lists = pc.split_pattern(pa.array([texts[k] for k in even], pa.string()), " ")
            for k, ids in zip(even, self._joined(lists.flatten(), lists.offsets.to_numpy())):
                out[k] = ids
        rest = [k for k, x in enumerate(odd) if x]
        if rest:
            parts = [CUT.split(texts[k]) for k in rest]
            flat = pa.array([p for some in parts for p in some], pa.string())
            for k, ids in zip(rest, self._joined(flat, np.cumsum([0, *map(len, parts)]))):
                out[k] = ids
        return out

    def _call(self, texts: list[str]) -> list[bytes]:
        if not self.cut or not any(a in t for t in texts for a in self.added):
            return self._plain(texts)
        pieces = [self.cut.split(t) for t in texts]
        ids = iter(self._plain([s for p in pieces for s in p[::2]]))
        return [b"".join(self.added[s] if k % 2 else next(ids) for k, s in enumerate(p)) for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in order."""
        out, held, size = [], [], 0
        collects = gc.isenabled()
        gc.disable()  # no cycles are made here, and the collector would walk the long lists of parts again and again
        try:
            for text in texts:
                if held and size + len(text) > CALL_CHARS:
                    out += self._call(held)
                    held, size = [], 0
                held.append(text)
                size += len(text)
            return out + self._call(held) if held else out
        finally:
            if collects:
                gc.enable()


def library_encoder(path: str) -> Encoder:
    """Encodes by the tokenizers library: no special tokens, truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    kind = np.dtype(f"<u{id_width(size)}")

    opens = np.zeros(size, bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        opens[i] = token.startswith("Ġ")

    def call(strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, kind) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def make(strings: list[str]) -> list[bytes]:
        # words with a space in front stay apart when joined, and only their first ids hold a space
        words = [s for s in strings if s[0] == " " and s[1:].isalpha()]
        others = list(set(strings).difference(words))
        found = {s: ids.tobytes() for s, ids in zip(others, call(others))}
        for some in (words[k : k + WORDS_CALL] for k in range(0, len(words), WORDS_CALL)):
            ids = call(["".join(some)])[0]
            starts = np.flatnonzero(opens[ids]) * kind.itemsize
            flat, ends = ids.tobytes(), [*starts[1:].tolist(), ids.nbytes]
            found.update(zip(some, (flat[a:b] for a, b in zip(starts.tolist(), ends)), strict=True))
        return [found[s] for s in strings]

    return Encoder(make, size, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})


_LOADED: dict[str, Encoder] = {}


def loaded(path: str, make: Callable[[str], Encoder] = library_encoder) -> Encoder:
    """The worker's encoder for a tokenizer file, made once."""
    key = f"{make.__name__}:{path}"
    if key not in _LOADED:
        _LOADED[key] = make(path)
    return _LOADED[key]
