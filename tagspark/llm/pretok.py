"""Byte-pair tokens of whole texts through a table of known pre-tokens.

Texts are cut into pre-tokens by array operations on code points that follow the vocabulary's own
split rule. A pre-token's 64-bit hash looks up its ids; only pre-tokens not met before go through
the tokenizers library's merges. Texts that hold a special string go through the library as they are.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import regex
from tokenizers import Tokenizer

#: Pre-tokens that a worker remembers before it starts anew.
KNOWN = 1_000_000
#: Code points worked on at once.
CHUNK = 1 << 20
LETTER, NUMBER, SPACE = 1, 2, 3
MULT = np.uint64(0x9E3779B97F4A7C15)
LONG = 512


@cache
def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other (0)."""
    out = np.zeros(0x110000, np.uint8)
    points = np.r_[0:0xD800, 0xE000:0x110000]
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = k
    return out


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(MULT), -1, 1 << 64))
    up, down = np.full(CHUNK + 1, MULT), np.full(CHUNK + 1, inverse)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@cache
def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of texts by one vocabulary file; ``words`` tells the rule with word ends from the byte-level one."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation(), self.tok.no_padding()
        self.model = self.tok.model
        with open(path) as f:
            spec = json.load(f)
        self.words = bool(spec["model"].get("end_of_word_suffix"))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def preload(self, proven: dict[str, int]) -> None:
        """Remember pre-tokens that are one token each."""
        names = list(proven)
        if names:
            cps, starts = self._points(names)
            hashes = self._hash(cps, starts[:-1], starts[1:], names)
            self._remember(hashes, [[proven[n]] for n in names])

    def merge(self, pretoken: str) -> list[int]:
        """Ids of one pre-token by the library's merges."""
        return [t.id for t in self.model.tokenize(pretoken.encode().decode("latin-1").translate(byte_letters()))]

    def normal(self, text: str) -> str:
        if not self.words:
            return text
        if text.isascii() or not regex.search(r"[^\x00-ɏ]", text):
            return text.lower()  # composed letters stay composed
        return self.tok.normalizer.normalize_str(text)

    @staticmethod
    def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        return cps, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)

    def _starts(self, cps: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where pre-tokens start and end, by the rules of the two vocabularies."""
        n = len(cps)
        kind = classes()[cps]
        start = np.zeros(n + 1, bool)
        start[1:n] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, bool)
        edge[docs] = True
        start |= edge
        start[n] = False
        if self.words:
            start[:n] |= kind == NUMBER
        else:
            # the last of a run of white space before other text stands alone; a plain space joins that text
            b = np.flatnonzero(start[1:n] & ~edge[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
            start[b - 1] = True
            start[b[cps[b - 1] == 32]] = False
        # 's 't 'm 'd 're 've 'll where the apostrophe starts a pre-token
        p = np.flatnonzero((cps[:-1] == 39) & start[: n - 1]) if n > 1 else np.zeros(0, np.int64)
        p = p[~edge[p + 1]]
        if len(p):
            one = cps[p + 1]
            two = np.where((p + 2 < n) & ~edge[np.minimum(p + 2, n)], cps[np.minimum(p + 2, n - 1)], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for hit, width in ((short, 2), (pair & ~short, 3)):
                q = p[hit]
                start[q + 1] = False
                start[q[q + width < n] + width] = True
        s = np.flatnonzero(start[:n])
        e = np.r_[s[1:], n]
        if self.words:
            dark = kind[s] == SPACE
            s, e = s[~dark], e[~dark]
        return s, e

    @staticmethod
    def _hash(cps: np.ndarray, s: np.ndarray, e: np.ndarray, text) -> np.ndarray:
        """64-bit hashes; long pre-tokens take a digest. ``text`` gives a pre-token by its place."""
        up, down = powers()
        v = cps.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(31)
        v *= up[: len(v)]
        sums = np.zeros(len(v) + 1, np.uint64)
        np.cumsum(v, out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(e - s > LONG).tolist():
            word = text[i] if isinstance(text, list) else text[s[i] : e[i]]
            h[i] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h

    def _remember(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(sizes.sum()))
        known = np.concatenate([self.known, hashes])
        first = np.concatenate([self.first, len(self.pool) + np.cumsum(sizes) - sizes])
        count = np.concatenate([self.count, sizes])
        order = np.argsort(known, kind="stable")
        self.known, self.first, self.count = known[order], first[order], count[order]
        self.pool = np.concatenate([self.pool, flat])

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per pre-token: its text's number, and where its ids are in the pool and how many."""
        big = "".join(texts)
        cps, docs = self._points(texts)
        if not len(cps):
            z = np.zeros(0, np.int64)
            return z, z, z
        s, e = self._starts(cps, docs)
        uniq, at, inverse = np.unique(self._hash(cps, s, e, big), return_index=True, return_inverse=True)
        if len(self.known) + len(uniq) > KNOWN:
            self.forget()
        place = np.searchsorted(self.known, uniq)
        there = np.zeros(len(uniq), bool)
        inside = place < len(self.known)
        there[inside] = self.known[place[inside]] == uniq[inside]
        new = np.flatnonzero(~there)
        if len(new):
            self._remember(uniq[new], [self.merge(big[a:b]) for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)])
            place = np.searchsorted(self.known, uniq)
        return np.searchsorted(docs, s, side="right") - 1, self.first[place][inverse], self.count[place][inverse]

    def _parts(self, text: str) -> list[str] | None:
        """Pieces of a long text that do not change its pre-tokens: cut at a single space between letters.

        None if a stretch of the text has no such place.
        """
        parts = []
        while len(text) > CHUNK:
            at = CHUNK
            while at > 0:
                at = text.rfind(" ", 1, at)
                if at > 0 and text[at - 1].isalpha() and text[at + 1].isalpha():
                    break
            if at <= 0:
                return None
            parts.append(text[:at])
            text = text[at:]
        return [*parts, text]

    def _grouped(self, texts: list[str]):
        """Groups of pieces of at most ``CHUNK`` code points with the numbers of their texts; direct ids for the rest."""
        group, owners, size, direct = [], [], 0, {}
        for i, text in enumerate(texts):
            special = any(x in text for x in self.special)
            parts = None if special else self._parts(self.normal(text))
            if parts is None:  # the library takes the whole text
                direct[i] = self.tok.encode(text, add_special_tokens=False).ids
                continue
            for part in parts:
                if group and size + len(part) > CHUNK:
                    yield group, owners, {}
                    group, owners, size = [], [], 0
                group.append(part)
                owners.append(i)
                size += len(part)
        yield group, owners, direct

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for group, owners, direct in self._grouped(texts):
            doc, _, count = self._chunk(group)
            if len(doc):
                out += np.bincount(np.array(owners)[doc], weights=count, minlength=len(texts)).astype(np.int64)
            for i, ids in direct.items():
                out[i] = len(ids)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for group, owners, direct in self._grouped(texts):
            doc, first, count = self._chunk(group)
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.pool[np.arange(total) + np.repeat(first - (ends - count), count)] if total else self.pool[:0]
            per = np.bincount(doc, weights=count, minlength=len(group)).astype(np.int64) if len(group) else []
            for owner, part in zip(owners, np.split(ids, np.cumsum(per)[:-1]) if len(group) else [], strict=True):
                out[owner].append(part)
            for i, got in direct.items():
                out[i].append(np.array(got, np.uint32))
        return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.uint32), *x]) for x in out]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path)


def whole_tokens(path: str) -> dict[str, int]:
    """The vocabulary strings that, standing alone as a pre-token, are proven to be one token.

    Each candidate is merged by the library once; only those that come out as their own single id count.
    Bounded by the vocabulary.
    """
    enc = Encoder(path)
    suffix = "</w>" if enc.words else ""
    back = {c: b for b, c in byte_letters().items()}
    proven = {}
    for token, i in enc.tok.get_vocab(with_added_tokens=False).items():
        if not token.endswith(suffix) or token == suffix:
            continue
        try:
            word = bytes(back[c] for c in token[: len(token) - len(suffix)]).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if enc.merge(word) == [i]:
            proven[word] = i
    return proven
