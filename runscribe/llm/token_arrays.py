"""Byte-pair merges over batches of pre-tokens held as ragged numpy arrays.

All pre-tokens of a batch lie in one flat array of symbol ids with the number of the pre-token beside
each symbol.  One round looks up the rank of every adjacent pair at once, finds each pre-token's lowest
rank, merges all of that rank's pairs in all pre-tokens together, and drops pre-tokens with no pair left.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

NO_RANK = np.int64(1) << 60


def merge_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << np.int64(32) | right.astype(np.int64)


class MergeTable:
    """Ranks of a tokenizer file's merges, by the ids of the pair."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        suffix = model.get("end_of_word_suffix") or ""
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(merge_key(left, right), kind="stable")
        self.keys, self.ranks, self.made = merge_key(left, right)[order], order.astype(np.int64), made[order]
        self.vocab, self.suffix = vocab, suffix

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id of the merged symbol) of each pair; NO_RANK where it isn't a merge."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK), np.zeros(len(left), np.int64)
        key = merge_key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]


def merge_all(symbols: np.ndarray, owner: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of each pre-token, and their owners, in order; ``owner`` ascends.

    The rank of each symbol's pair with the next is kept from round to round; only pairs beside a merge are
    looked up again.
    """
    if not len(symbols):
        return symbols, owner
    symbols, done_symbols, done_owner = symbols.copy(), [], []
    rank, made = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(owner[:-1] == owner[1:])
    rank[inner], made[inner] = table.lookup(symbols[inner], symbols[inner + 1])
    while len(symbols):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        span = np.diff(np.r_[first, len(symbols)])
        lowest = np.minimum.reduceat(rank, first)
        if (over := lowest == NO_RANK).any():  # these pre-tokens are finished
            out = np.repeat(over, span)
            done_symbols.append(symbols[out])
            done_owner.append(owner[out])
            keep = ~out
            symbols, owner, rank, made = symbols[keep], owner[keep], rank[keep], made[keep]
            lowest, span = lowest[~over], span[~over]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, span))
        # of overlapping pairs (aaa) the leftmost goes first, so every second one of a run
        n = np.arange(len(at))
        at = at[(n - np.maximum.accumulate(np.where(np.r_[True, np.diff(at) != 1], n, 0))) % 2 == 0]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        moved = at - np.arange(len(at))
        symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
        rank[moved] = NO_RANK
        beside = np.concatenate([moved, moved[moved > 0] - 1])
        beside = beside[beside < len(symbols) - 1]
        beside = beside[owner[beside] == owner[beside + 1]]
        rank[beside], made[beside] = table.lookup(symbols[beside], symbols[beside + 1])
    symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return symbols[order], owner[order]


#: Chunks of these characters only are cut together, by one pattern that cuts them as the files' own do.
_SIMPLE = re.compile(r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u0149\u014a-\u017e]+")
_CUT = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\na-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+")


#: Python cuts at these, the library doesn't.
CONTROLS = "\x1c\x1d\x1e\x1f"


class ChunkTokens:
    """Token ids of texts, through a bounded cache of chunks between white space.

    A chunk is cut into pre-tokens by the file's own normalizer and pre-tokenizer (plain Latin chunks by one
    equal pattern) and its pre-tokens are merged by :func:`merge_all`.  Chunks are independent because the
    pre-tokenizer drops white space and no piece of it, nor a special token, spans any; texts with control
    characters on whose class the libraries differ are taken as one chunk.
    """

    def __init__(self, path: str, cached: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = MergeTable(spec["model"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = {chr(b): self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        byte_of = self._byte_letters()
        vocab, suffix = self.table.vocab, self.table.suffix
        self.inner = np.array([vocab[c] for c in byte_of], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_of], np.int64)
        self.byte_of = {c: b for b, c in enumerate(byte_of)}
        assert all(byte_of[ord(c)] == x for c, x in letters.items()), "a byte-level vocabulary is asked for"
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cached = cached

    @staticmethod
    def _byte_letters() -> list[str]:
        """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = iter(range(0x100, 0x200))
        return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        if not text:
            return []
        if any(c in text for c in CONTROLS):
            return [text]
        return text.split()

    def _pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a chunk, in the letters that stand for bytes, and the ids of special tokens that stand in it."""
        out: list[str | int] = []
        while chunk:
            found = min(((i, -len(s), s) for s in self.special if (i := chunk.find(s)) >= 0), default=None)
            plain = chunk if found is None else chunk[: found[0]]
            if plain:
                normal = self.tokenizer.normalizer.normalize_str(plain)
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
            if found is None:
                break
            out.append(self.special[found[2]])
            chunk = chunk[found[0] + len(found[2]) :]
        return out

    def _merged(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens given as bytes one behind the other, and how many each has."""
        symbols, ends = self.inner[flat], np.cumsum(lengths)
        if len(ends):
            symbols[ends - 1] = self.last[flat[ends - 1]]
        left, owner = merge_all(symbols, np.repeat(np.arange(len(lengths)), lengths), self.table)
        return left, np.bincount(owner, minlength=len(lengths))

    def _encode_simple(self, chunks: list[str]) -> list[bytes]:
        if not chunks:
            return []
        ids: dict[str, int] = {"\n": 0}
        add = ids.setdefault
        of = np.fromiter([add(p, len(ids)) for p in _CUT.findall("\n".join(chunks).lower())], np.int64)
        flat = np.frombuffer("".join([p + "\n" for p in list(ids)[1:]]).encode(), np.uint8)
        breaks = np.flatnonzero(flat == 10)
        left, counts = self._merged(flat[flat != 10], np.diff(np.r_[-1, breaks]) - 1)
        begin, counts = np.r_[0, 0, np.cumsum(counts)[:-1]], np.r_[0, counts]  # a line feed has no ids
        n = counts[of]
        at = np.repeat(begin[of] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        data = left[at].astype("<u4").tobytes()
        ends = (np.cumsum(n)[np.flatnonzero(np.r_[of, 0] == 0) - 1] * 4).tolist()
        return [data[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)]

    def _cut_others(self, chunks: list[str]) -> list[list[str | int]]:
        """Pre-tokens of each chunk, in the letters that stand for bytes, and ids of special tokens.

        Chunks without a special token go through the library's normalizer and pre-tokenizer as one text, with line
        feeds between them as in :meth:`chunks`; where these can't be told afterwards, each goes alone.
        """
        out: list[list[str | int]] = [[] for _ in chunks]
        plain = [i for i, c in enumerate(chunks) if not any(s in c for s in self.special) and not any(x in c for x in CONTROLS)]
        normal = self.tokenizer.normalizer.normalize_str("\n".join(chunks[i] for i in plain))
        breaks = np.array([m.start() for m in re.finditer(r"[ \n]", normal)], np.int64)
        together = plain and len(breaks) == len(plain) - 1
        if together:
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
            of = np.searchsorted(breaks, np.fromiter((a for _, (a, _) in found), np.int64, len(found)), "right").tolist()
            for (piece, _), k in zip(found, of, strict=True):
                out[plain[k]].append(piece)
        alone = set(range(len(chunks))).difference(plain if together else ())
        for i in alone:
            out[i] = self._pieces(chunks[i])
        return out

    def _encode_others(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks of any script; the distinct pre-tokens of all of them are merged together."""
        if not chunks:
            return []
        cut = self._cut_others(chunks)
        pieces = list({p for c in cut for p in c if isinstance(p, str)})
        made: dict[str | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        if pieces:
            flat = np.fromiter(map(self.byte_of.__getitem__, "".join(pieces)), np.uint8)
            left, counts = self._merged(flat, np.fromiter(map(len, pieces), np.int64, len(pieces)))
            data, ends = left.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            made.update(zip(pieces, (data[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        return [b"".join([made[p] for p in c]) for c in cut]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian unsigned 32-bit integers."""
        is_simple = [("<|" not in c) and _SIMPLE.fullmatch(c) is not None for c in chunks]
        simple, other = ([c for c, s in zip(chunks, is_simple, strict=True) if s is kind] for kind in (True, False))
        made = dict(zip(simple, self._encode_simple(simple), strict=True))
        made.update(zip(other, self._encode_others(other), strict=True))
        return [made[c] for c in chunks]

    def learn(self, cut: list[list[str]]) -> None:
        """Put all chunks of a batch in the cache; when it is full, those not used since the last time go."""
        if len(self.cache) > self.cached:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        new = {c for chunks in cut for c in chunks if c not in cache}
        if older:
            cache.update((c, older[c]) for c in new if c in older)
            new = new.difference(cache)
        unseen = list(new)
        cache.update(zip(unseen, self.encode_chunks(unseen), strict=True))

    def forget(self) -> None:
        """At a task's end: what a worker does next needs the memory more than the next task needs these chunks."""
        self.cache, self.older = {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        self.learn(cut)
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]


@functools.lru_cache(maxsize=2)
def chunk_tokens(path: str) -> ChunkTokens:
    """One per worker process and file, so that the file is read once."""
    return ChunkTokens(path)
