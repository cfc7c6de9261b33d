"""A sentencepiece model as tables: its pieces, and which two symbols make which piece."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .shingles import Hasher

#: The piece character for a space, and the model's codes for kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    """What a model file says. Only models without a normaliser, that keep all white space and fall back to bytes, are taken."""

    path: str
    names: list[str] = field(init=False)
    scores: np.ndarray = field(init=False)
    kinds: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(self.path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        self.names = [p.piece for p in model.pieces]
        self.scores = np.array([p.score for p in model.pieces], np.float64)
        self.kinds = np.array([p.type for p in model.pieces], np.int64)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        odd = norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix
        if odd or not train.byte_fallback or set(self.kinds.tolist()) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{self.path}: only byte-fallback models with an identity normaliser are supported")
        self.normal = {p: i for i, p in enumerate(self.names) if self.kinds[i] == NORMAL}
        #: True if pieces hold the space character only before other characters: text can be cut there.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.normal)


def prefixed(column: pa.Array) -> pa.Array:
    """Texts with the space that such models put first; null and empty texts stay empty."""
    import pyarrow.compute as pc

    column = column.cast(pa.large_string()).fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))


class PartHasher(Hasher):
    """Cuts where no piece of the model can lie across: between characters that stand together in none.

    Hashes distinguish upper and lower case.
    """

    def __init__(self, model: PieceModel):
        super().__init__(fold=False, lead=True)
        self.cuts = model.cuts
        together = {(x[i], x[i + 1]) for x in model.normal for i in range(len(x) - 1)}
        self.apart = np.zeros((256, 256), bool)
        for a in range(128):
            for b in range(128):
                self.apart[a, b] = tuple(SPACE if c == 0x20 else chr(c) for c in (a, b)) not in together
        self.apart[128:, 0x20] = True  # as cuts says
        self.apart[128:, 0x0A] = self.apart[0x0A, 128:] = "\n" not in "".join(model.normal)

    def edges(self, data: np.ndarray) -> np.ndarray:
        left = np.zeros(len(data), bool)
        left[0] = True
        if self.cuts:
            left[1:] = self.apart[data[:-1], data[1:]]
            mark = np.flatnonzero(left & (data == 0x20))  # not between a written space character and a space: the same to the model
            mark = mark[mark >= 3]
            left[mark[(data[mark - 3] == 0xE2) & (data[mark - 2] == 0x96) & (data[mark - 1] == 0x81)]] = False
        return left
