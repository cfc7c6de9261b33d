"""Token ids of whole texts, equal to those of a `tokenizers` file, by way of a table of its ids for words.

Texts are cut where the file's own first split always cuts: before white space that follows a word. The ids
of the parts are then the ids of the whole. Parts are found and hashed in numpy; each worker process asks a
library only for parts that its table hasn't, byte for byte; those of common characters go to a quicker one with the same
merges. A text in which such a cut could be unsure goes to the library whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .parts import Grown, PartTable
from .shingles import Hasher
from .wordmerges import WordMerges

#: Parts in a worker's table (about 60 bytes each) by kind; it starts anew beyond that. Words are soon learnt again.
TABLE_PARTS = {"bytes": 1_000_000, "words": 400_000}
#: Bytes of text looked up together: a worker holds some 60 times as much meanwhile.
BLOCK = 1 << 20
#: Parts that the library gets in one call, where a word can stand between them.
JOINED = 256
#: Fixed value: the first split of byte-level files that use their built-in pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_TABLES: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's own; its table serves all its tasks."""
    if (path, kind) not in _TABLES:
        _TABLES[path, kind] = Encoder(path, kind)
    return _TABLES[path, kind]


class Encoder:
    """kind: "bytes" (white space before a word is part of what is encoded) or "words" (white space is dropped)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.hasher = Hasher(fold=False, lead=kind == "bytes", block=BLOCK)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.quick = self._byte_pairs(path)
        self.mark, self.merges = (self._mark(), WordMerges.of(path)) if kind == "words" else (None, None)
        self.parts = PartTable(self.hasher)
        self._empty()

    def _empty(self) -> None:
        self.parts.empty()
        self.first, self.count, self.pool = Grown(np.int64), Grown(np.int32), Grown(np.uint32)

    def _byte_pairs(self, path: str):
        """A quicker library with the same merges, where the file is a plain byte-level one whose ids are its merge ranks."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        first, model = file["pre_tokenizer"], file["model"]
        plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not file["normalizer"]
        if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
            return None
        import tiktoken

        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in seen]
        byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _mark(self) -> tuple[bytes, int] | None:
        """A word of ASCII letters that is one id, and that id; of the newest such ids, as texts seldom have them."""
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or ""
        newest = sorted(self.library.get_vocab(with_added_tokens=False).items(), key=lambda x: -x[1])
        for piece, i in newest:
            word = piece.removesuffix(suffix)
            if piece.endswith(suffix) and word.isascii() and word.isalpha() and word.islower() and self.library.encode(f"{word} {word}", add_special_tokens=False).ids == [i, i]:
                return word.encode(), i
        return None

    def _single(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [x.decode("utf-8", "replace") for x in parts]
        if self.quick is None:
            ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            ids = [self.library.encode(x, add_special_tokens=False).ids if any(s in x for s in self.special) else self.quick.encode_ordinary(x) for x in texts]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(count.sum())), count

    def _ask(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each has. Parts with the mark's id in them are asked for one by one."""
        if self.mark is None:
            return self._single(parts)
        word, mark = self.mark
        groups = [parts[k : k + JOINED] for k in range(0, len(parts), JOINED)]
        texts = [(b" " + word + b" ").join(g).decode("utf-8", "replace") for g in groups]
        found = []
        for group, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            at = np.flatnonzero(ids == mark)
            if len(at) == len(group) - 1:
                found.append((np.delete(ids, at), np.diff(np.concatenate(([-1], at, [len(ids)]))) - 1))
            else:
                found.append(self._single(group))
        return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])

    def _learn(self, parts: list[bytes]) -> None:
        ids, count = self.merges.ids(parts, self._ask) if self.merges else self._ask(parts)
        self.first.add(self.pool.n + np.cumsum(count) - count)
        self.count.add(count)
        self.pool.add(ids)

    def _block(self, data: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts of a block."""
        if len(self.parts) > TABLE_PARTS[self.kind]:
            self._empty()
        starts, row = self.parts.rows(data, cuts, self._learn)
        count = self.count.values[row].astype(np.int64)
        total = np.cumsum(count)
        where = np.repeat(self.first.values[row] - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)
        bounds = np.concatenate(([0], total))[np.searchsorted(starts, cuts)]
        out = np.split(self.pool.values[where], bounds[:-1])
        if self.kind == "bytes":
            for k in self._unsure(data, cuts, starts):
                text = data[(cuts[k - 1] if k else 0) : cuts[k]].tobytes().decode("utf-8", "replace")
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return out

    def _unsure(self, data: np.ndarray, cuts: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Texts with other white space than the six characters right before a cut; there the pattern may take both as one."""
        s = starts[starts >= 3]
        a, b, c = data[s - 3], data[s - 2], data[s - 1]
        odd = (b == 0xC2) & ((c == 0x85) | (c == 0xA0)) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        early = starts[(starts > 0) & (starts < 3)]
        odd_at = np.concatenate((s[odd], early[data[early - 1] >= 0x80]))
        return np.unique(np.searchsorted(cuts, odd_at, "left"))

    def ids(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text of an Arrow column; null as empty."""
        held: list[np.ndarray] = []
        for data, cuts, more in self.hasher.blocks(column):
            parts = self._block(data, cuts)
            if more or held:
                held.append(parts[0])
                if not more:
                    yield np.concatenate(held)
                    held = []
            else:
                yield from parts
