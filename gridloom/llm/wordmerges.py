"""Ids of many words in one call, for byte-level merge files that mark the end of a word.

Words of ASCII and of Latin-1's letters of two bytes are cut in numpy where the file's own first split cuts. Letters, and
signs, have an alphabet of fewer than 64 codes each: a symbol is one ASCII character, and one bit more says that a
word ends with it. All pieces then are one text, which `tiktoken` merges; the bit tells them apart in its output.
"""

from __future__ import annotations

import json
import string
from collections.abc import Callable

import numpy as np

#: The normaliser and the first split of the files that are taken.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
#: Kinds of bytes; a part with one of the last kind isn't taken.
LETTER, DIGIT, SIGN, OTHER = range(4)
#: The first byte of Latin-1's letters, and the second ones of small letters. Large letters' are 32 less.
LEAD, SMALL = 0xC3, [0x9F, *(b for b in range(0xA0, 0xC0) if b != 0xB7)]
END = 0x40
#: A piece in the alphabets: codes without the bit, then one with it.
PIECE = r"[\x00-\x3f]*[\x40-\x7f]"


def byte_chars() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level files."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class _Alphabet:
    """The merges of a file among the symbols of some bytes. `last`: those that can end a word."""

    def __init__(self, code: dict[int, int], last: list[int], vocab: dict[str, int], merges: list[list[str]], suffix: str):
        import tiktoken

        chars = byte_chars()
        symbols = {chars[b]: bytes([c]) for b, c in code.items()} | {chars[b] + suffix: bytes([code[b] | END]) for b in last}
        pairs: dict[bytes, tuple[bytes, bytes]] = {}
        for a, b in merges:
            if a in symbols and b in symbols:
                symbols[a + b] = made = symbols[a] + symbols[b]
                if made in pairs:
                    raise ValueError("two merges make one symbol")
                pairs[made] = symbols[a], symbols[b]
        single = [x for x in symbols.values() if len(x) == 1]
        rank = {x: i for i, x in enumerate([*single, *pairs])}
        if not self._plain(pairs, rank):
            raise ValueError("merges by bytes and by pairs could differ")
        of = {x: vocab[s] for s, x in symbols.items()}
        self.id = np.array([of[x] for x in rank], np.uint32)
        self.ends = np.array([x[-1] >= END for x in rank])
        self.text = tiktoken.Encoding("own", pat_str=PIECE, mergeable_ranks=rank, special_tokens={})

    @staticmethod
    def _plain(pairs: dict[bytes, tuple[bytes, bytes]], rank: dict[bytes, int]) -> bool:
        """Whether each symbol, merged alone, comes from its own merge at last. Two symbols side by side that make one by their
        bytes are then always the file's pair: what is inside their span merges as it does alone."""
        for made, pair in pairs.items():
            x = [made[k : k + 1] for k in range(len(made))]
            while len(x) > 2:
                ranks = [rank.get(a + b, len(rank)) for a, b in zip(x[:-1], x[1:], strict=True)]
                k = ranks.index(least := min(ranks))
                if least == len(rank):
                    return False
                x[k : k + 2] = [x[k] + x[k + 1]]
            if tuple(x) != pair:
                return False
        return True

    def merged(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        found = np.array(self.text.encode_ordinary(codes.tobytes().decode("ascii")), np.int64)
        return self.id[found], np.diff(np.flatnonzero(self.ends[found]), prepend=-1)


class WordMerges:
    def __init__(self, vocab: dict[str, int], merges: list[list[str]], suffix: str, special: list[str]):
        small, signs = string.ascii_lowercase.encode(), [ord(c) for c in string.punctuation if c != "'"]
        code = {b: i for i, b in enumerate([*small, *SMALL, LEAD])}
        self.alphabets = {LETTER: _Alphabet(code, [*small, *SMALL], vocab, merges, suffix), SIGN: _Alphabet({b: i for i, b in enumerate(signs)}, signs, vocab, merges, suffix)}
        self.digits = np.array([vocab[d + suffix] for d in string.digits], np.uint32)
        self.kind, self.code = np.full(256, OTHER, np.uint8), np.zeros(256, np.uint8)
        for kind, of in ((LETTER, {b: code[b] for b in small} | {b - 32: code[b] for b in small}), (DIGIT, {ord(d): int(d) for d in string.digits}), (SIGN, {b: i for i, b in enumerate(signs)})):
            self.kind[list(of)], self.code[list(of)] = kind, list(of.values())
        #: Of the second bytes: whether a letter, and the small letter's code.
        self.second, self.second_code, self.lead_code = np.zeros(256, bool), np.zeros(256, np.uint8), code[LEAD]
        for of in ({b: code[b] for b in SMALL}, {b - 32: code[b] for b in SMALL if 0xA0 <= b < 0xBF}):
            self.second[list(of)], self.second_code[list(of)] = True, list(of.values())
        self.kind[[x.encode()[0] for x in special]] = OTHER

    @classmethod
    def of(cls, path: str) -> WordMerges | None:
        """None if the file isn't of this kind, or if its merges by pairs and by bytes could differ."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, first = file["model"], file["pre_tokenizer"] or {}
        steps = first.get("pretokenizers") or []
        if file["normalizer"] != NORMALIZER or len(steps) != 2 or steps[0] != SPLIT or any(steps[1].get(k) != v for k, v in BYTES.items()):
            return None
        suffix = model.get("end_of_word_suffix")
        if not suffix or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None
        special = [x["content"] for x in file["added_tokens"]]
        if any(x.get("normalized") or x["content"][:1] not in string.punctuation for x in file["added_tokens"]):
            return None
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        try:
            return cls(model["vocab"], merges, suffix, special)
        except (KeyError, ValueError):  # a byte without an id, or merges that could differ
            return None

    def ids(self, parts: list[bytes], rest: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts (none empty, without white space) in a row, and how many each has. `rest` is asked for parts with other characters."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(size) - size
        kind, code, head = self.kind[data], self.code[data], np.zeros(len(data), bool)
        head[starts] = True
        lead = np.flatnonzero(data[:-1] == LEAD)
        lead = lead[self.second[data[lead + 1]] & ~head[lead + 1]]
        kind[lead] = kind[lead + 1] = LETTER
        code[lead], code[lead + 1] = self.lead_code, self.second_code[data[lead + 1]]
        good = np.maximum.reduceat(kind, starts) < OTHER
        if not good.any():
            return rest(parts)
        if not good.all():
            keep = np.repeat(good, size)
            kind, code, head = kind[keep], code[keep], head[keep]
        new = head | (kind == DIGIT)
        new[1:] |= kind[1:] != kind[:-1]
        code[np.append(new[1:], True)] |= END
        piece = kind[new]
        count = np.ones(len(piece), np.int64)
        found = {DIGIT: self.digits[code[kind == DIGIT] ^ END]}
        for k, alphabet in self.alphabets.items():
            found[k], count[piece == k] = alphabet.merged(code[kind == k])
        ids = _dealt(np.repeat(piece, count), found)
        count = np.add.reduceat(count, np.flatnonzero(head[new]))
        if good.all():
            return ids, count
        more, n = rest([parts[i] for i in np.flatnonzero(~good).tolist()])
        count = _dealt(good, {True: count, False: n})
        return _dealt(np.repeat(good, count), {True: ids, False: more}), count


def _dealt(which: np.ndarray, found: dict[int, np.ndarray]) -> np.ndarray:
    """The values of each kind, in their order, at the places of that kind."""
    out = np.empty(len(which), next(iter(found.values())).dtype)
    for k, x in found.items():
        out[which == k] = x
    return out
