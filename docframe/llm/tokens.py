"""Token ids of whole texts by a public word-level BPE tokenizer, computed for a block of texts at once in numpy."""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from docframe.llm.shingles import run_sums

#: Its id stands between words that are encoded together by the tokenizer itself.
_MARK = "<|endoftext|>"
#: Classes of bytes: white space, letter, digit, other sign, and what makes a word one for the tokenizer itself.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: What the pattern takes after an apostrophe.
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: The pattern, normalisation and model that are computed here; fixed values, as the tokenizer's file states them.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
_NONE = np.iinfo(np.int32).max
_TABLE_BITS = 19


def _byte_signs() -> list[str]:
    """The character that a byte-level vocabulary has for each byte: printable ones stand for themselves, the others
    follow from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte, and of each code point from 128 to 255, which two bytes make."""
    one = np.full(256, ODD, np.uint8)
    one[33:127] = SIGN
    one[[9, 10, 11, 12, 13, 32]] = SPACE
    for b in range(33, 127):
        if chr(b).isalnum():
            one[b] = DIGIT if chr(b).isdigit() else LETTER
    two = np.full(128, ODD, np.uint8)
    for k in range(0xA1, 0x100):
        two[k - 128] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(k))[0], SIGN)
    return one, two


_ONE, _TWO = _classes()


class BlockTokens:
    """Ids of all texts of a block.

    Words of ASCII and Latin-1 are lowered and cut into the pattern's pieces by the classes of their bytes; equal pieces
    are met once and kept, up to about most_pieces, and byte pairs are merged in all different pieces side by side, each time the pair of the least rank,
    the leftmost first. Words with other characters, or with a special token's opening, go to the tokenizer itself. A
    file of another kind than this is an error.
    """

    def __init__(self, path: str, longest: int = 32, most_bytes: int = 4 << 20, most_pieces: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.longest, self.most_bytes = Tokenizer.from_file(path), longest, most_bytes
        self.most_pieces = most_pieces
        self._forget()
        spec = json.loads(self.tokenizer.to_str())
        normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        model = spec["model"]
        own = normal == _NORMAL and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _PATTERN and steps[1].get("type") == "ByteLevel"
        self.mark = self.tokenizer.token_to_id(_MARK)
        if not own or model.get("type") != "BPE" or model.get("ignore_merges") or model.get("end_of_word_suffix") != "</w>" or self.mark is None:
            raise ValueError(f"not a tokenizer of the kind that is computed here: {path}")
        ids, signs = model["vocab"], _byte_signs()
        self.signs = {b: s for b, s in enumerate(signs)}
        self.inner = np.array([ids[s] for s in signs], np.int32)
        self.final = np.array([ids[s + "</w>"] for s in signs], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pair = np.array([0, *(ids[a] << 32 | ids[b] for a, b in merges)], np.int64)  # nothing is merged first
        self.pair, self.made = pair, np.array([0, *(ids[a + b] for a, b in merges)], np.int32)
        # where a pair is in that list: by one hash, and what has lost its place there by another
        self.tables = []
        rest = np.arange(1, len(pair), dtype=np.int32)
        for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93):
            table = np.zeros(1 << _TABLE_BITS, np.int32)
            at = self._slots(pair[rest], odd)
            table[at] = rest
            rest = rest[table[at] != rest]
            self.tables.append((odd, table))
            if not len(rest):
                break
        else:
            raise ValueError("pairs clash in all tables")

    @staticmethod
    def _slots(pair: np.ndarray, odd: int) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - _TABLE_BITS)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, from 1 on; -1 on either side makes no pair."""
        pair = left.astype(np.int64) << 32 | right
        out = np.full(len(pair), _NONE, np.int32)
        for odd, table in self.tables:
            found = table[self._slots(pair, odd)]
            hit = (self.pair[found] == pair) & (found > 0)
            out[hit] = found[hit]
        return out

    def _merged(self, s: np.ndarray) -> np.ndarray:
        """s: symbols of pieces, one a row, filled up with -1. Merged in place."""
        n, width = s.shape
        live = np.arange(n)
        now = s
        rank = self._ranks(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(n, width - 1)
        places = np.arange(width)
        while len(live):
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            least = rank[rows, at]
            some = least < _NONE
            if not some.all():
                s[live[~some]] = now[~some]
                live, now, rank, at, least = live[some], now[some], rank[some], at[some], least[some]
                rows = np.arange(len(live))
                if not len(live):
                    break
            base = rows * width
            now[rows, at] = self.made[least]
            # what follows the pair moves up by one place
            move = base[:, None] + places + (places > at[:, None])
            now = np.append(now.ravel(), np.int32(-1))[move]
            now[:, -1] = -1
            rank = np.append(rank.ravel(), _NONE)[np.minimum(move[:, :-1] - rows[:, None], rank.size)] if width > 2 else np.full_like(rank, _NONE)
            rank[:, -1] = _NONE
            rank[rows, at] = self._ranks(now[rows, at], now[rows, at + 1])
            before = np.flatnonzero(at)
            p = at[before]
            rank[before, p - 1] = self._ranks(now[before, p - 1], now[before, p])
        return s

    def _pieces_ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different plain pieces, end to end in order, and how many each has."""
        count = np.zeros(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in sorted({*range(1, 13), 16, 24, self.longest}):
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            if not len(own):
                continue
            places = np.arange(width)
            inside = places[None, :] < size[own][:, None]
            raw = data[np.minimum(start[own][:, None] + places[None, :], len(data) - 1)]
            s = np.where(inside, self.inner[raw], -1)
            ends = size[own] - 1
            rows = np.arange(len(own))
            s[rows, ends] = self.final[raw[rows, ends]]
            if width > 1:
                s = self._merged(s)
            full = s >= 0
            count[own] = full.sum(axis=1)
            found.append((own, s[full]))
        for k in np.flatnonzero(size > self.longest):
            piece = data[start[k] : start[k] + size[k]].tobytes().decode("latin-1").translate(self.signs)
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(piece)], np.int32)
            count[k] = len(ids)
            found.append((np.array([k]), ids))
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for own, ids in found:
            n = count[own]
            out[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def _odd_ids(self, words: list[bytes], at_once: int = 4096) -> list[np.ndarray]:
        """Ids of words by the tokenizer itself; those with a special token's opening alone, the others joined by the mark."""
        out: dict[bytes, np.ndarray] = {}
        alone = [w for w in words if b"<|" in w]
        for w in alone:
            out[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.int32)
        rest = [w for w in words if b"<|" not in w]
        for i in range(0, len(rest), at_once):
            some = rest[i : i + at_once]
            ids = np.array(self.tokenizer.encode(_MARK.join(w.decode() for w in some), add_special_tokens=False).ids, np.int32)
            for w, own in zip(some, np.split(ids, np.flatnonzero(ids == self.mark)), strict=True):
                out[w] = own[own != self.mark]
        return [out[w] for w in words]

    def _of_pieces(self, keys: np.ndarray, low: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different pieces (of rising keys) begin in the pool, and how many they are. What is new is
        added to the pool; beyond most_pieces it begins anew."""
        if len(self.keys) > self.most_pieces:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        at, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], count[known] = self.at[place[known]], self.count[place[known]]
        plain, others = np.flatnonzero(~known & ~odd), np.flatnonzero(~known & odd)
        plain_ids, count[plain] = self._pieces_ids(low, start[plain], size[plain])
        odd_ids = self._odd_ids([data[start[k] : start[k] + size[k]].tobytes() for k in others])
        count[others] = [len(x) for x in odd_ids]
        new = np.concatenate([plain, others])
        at[new] = len(self.pool) + np.cumsum(count[new]) - count[new]
        self.pool = np.concatenate([self.pool, plain_ids, *odd_ids]).astype("<u4")
        every = np.concatenate([self.keys, keys[new]])
        order = np.argsort(every, kind="stable")
        self.keys, self.at, self.count = every[order], np.concatenate([self.at, at[new]])[order], np.concatenate([self.count, count[new]])[order]
        return at, count

    def _forget(self) -> None:
        self.keys, self.at, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: the UTF-8 bytes of some texts end to end; bounds: where each begins, and the end. The ids of all, as
        little-endian unsigned 32-bit numbers, and where each text's begin, and the end."""
        n, cut = len(data), self.most_bytes
        if not n:
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        if n > cut and (spaces := np.flatnonzero(_ONE[data] == SPACE)).size:
            # no piece goes over white space, so what is long is cut there
            cut = int(spaces[min(np.searchsorted(spaces, cut), len(spaces) - 1)]) + 1
            if cut < n:
                ids, edges = zip(*[self.encode(data[a:z], np.clip(bounds, a, z) - a) for a, z in ((0, cut), (cut, n))], strict=True)
                return np.concatenate(ids), edges[0] + edges[1]
        kind, low = _ONE[data], data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        lead = np.flatnonzero((data[:-1] == 0xC2) | (data[:-1] == 0xC3))
        follow = data[lead + 1]
        code = follow - 128 + np.where(data[lead] == 0xC3, 64, 0).astype(np.uint8)
        kind[lead] = kind[lead + 1] = _TWO[code]
        upper = lead[(data[lead] == 0xC3) & (follow <= 0x9E) & (follow != 0x97)]
        low[upper + 1] += 32
        opening = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        kind[opening] = ODD
        text_start = np.zeros(n, bool)
        text_start[bounds[:-1][bounds[:-1] < n]] = True
        # words, and those of them that are odd
        space = kind == SPACE
        begins = ~space
        begins[1:] &= space[:-1] | text_start[1:]
        word_at = np.flatnonzero(begins)
        if not len(word_at):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        ends = ~space
        ends[:-1] &= space[1:] | text_start[1:]
        word_end = np.flatnonzero(ends) + 1
        odd = np.add.reduceat(kind == ODD, word_at, dtype=np.int64) > 0
        # pieces of the others: runs of a class; digits one by one, a byte of two with its lead
        starts = begins.copy()
        starts[1:] |= ~space[1:] & (kind[1:] != kind[:-1])
        digit = kind == DIGIT
        digit[lead + 1] = False
        starts |= digit
        apostrophe = np.flatnonzero(starts & (data == 39))
        apostrophe = apostrophe[apostrophe + 1 < n]
        if len(apostrophe):
            word_of = np.searchsorted(word_at, apostrophe, side="right") - 1
            for ending in _ENDINGS:
                k = len(ending)
                here = apostrophe[apostrophe + k < word_end[word_of]]
                same = np.ones(len(here), bool)
                for j, c in enumerate(ending):
                    same &= low[here + 1 + j] == c
                hit = here[same]
                starts[hit + 1] = False
                after = hit[hit + 1 + k < n] + 1 + k
                starts[after[~space[after] & ~text_start[after]]] = True
        if odd.any():
            inside = np.zeros(n + 1, np.int8)
            np.add.at(inside, word_at[odd], 1)
            np.add.at(inside, word_end[odd], -1)
            starts &= ~(np.cumsum(inside[:-1]) > 0)
            starts[word_at[odd]] = True
            for a, z in zip(word_at[odd].tolist(), word_end[odd].tolist(), strict=True):
                low[a:z] = data[a:z]
        start = np.flatnonzero(starts)
        next_start = np.append(start[1:], n)
        end_of_word = word_end[np.searchsorted(word_at, start, side="right") - 1]
        size = np.minimum(next_start, end_of_word) - start
        is_odd = odd[np.searchsorted(word_at, start, side="right") - 1]
        keys = run_sums(low, start, size) ^ is_odd.astype(np.uint64)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at, count = self._of_pieces(distinct, low, data, start[first], size[first], is_odd[first])
        each = count[inverse]
        before = np.cumsum(each) - each
        ids = self.pool[np.repeat(at[inverse] - before, each) + np.arange(int(each.sum()))]
        edges = np.append(before, len(ids))
        return ids, edges[np.searchsorted(start, bounds)]
