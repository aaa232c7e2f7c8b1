"""Reads the pieces of a SentencePiece model file: (piece, score, type) in id order."""

from __future__ import annotations

from functools import lru_cache

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
#: Characters that normal forms would change, and spaces at both ends and in a row.
_PROBE = "  Ａ　ﬁ①  x é e\u0301 \u200b\t\n "


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[tuple[str, float, int], ...]:
    """Scores and types through the library's own accessors. A model that changes characters, drops spaces or sets none
    before a text is refused, as the operators take texts as they are, with one space before them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
        raise ValueError("this model's texts aren't taken as they are")
    kind = lambda i: UNKNOWN if sp.is_unknown(i) else CONTROL if sp.is_control(i) else BYTE if sp.is_byte(i) else NORMAL
    return tuple((sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size()))


def splits_before_space(vocab) -> bool:
    """True if no piece has a space mark after another character: then no piece crosses the start of a word."""
    return not any(SPACE in p.lstrip(SPACE) for p, _, kind in vocab if kind == NORMAL)
