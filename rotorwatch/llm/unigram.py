"""A SentencePiece vocabulary read as a unigram model: pieces with scores, unknown rule, bytes, cut points.

The pieces and scores are taken from the file as they stand; nothing is trained. A text gets one space in
front and spaces become U+2581. The best segmentation has the highest sum of scores; of equal sums the
one whose last piece starts earliest wins, the rule of unigram tokenizers; scores add up in double precision, so no tie comes from rounding. A character without a piece
of its own costs the lowest score less 10 and becomes its UTF-8 bytes.
"""

import re
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import public_tokenizers

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Unigram:
    pieces: dict[str, tuple[int, float]]
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]  # bytes of each id, spaces written as spaces
    unknown_score: float
    longest: int
    segments: str  # pattern of the parts between cut points that no piece crosses
    prefixes: frozenset = field(repr=False)

    @cached_property
    def matches(self) -> ahocorasick.Automaton:
        """Finds the pieces that end at each position, the longest first: length, score and id."""
        found = ahocorasick.Automaton()
        for piece, (number, score) in self.pieces.items():
            found.add_word(piece, (len(piece), score, number))
        found.make_automaton()
        return found


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None) -> Unigram:
    """Read a vocabulary file on the driver; the result (some MB at most) is broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    pieces, byte_ids, surface = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            surface.append(piece.replace(SPACE, " ").encode())
    return build(pieces, byte_ids, surface)


def build(pieces, byte_ids, surface) -> Unigram:
    return Unigram(
        pieces, tuple(byte_ids), tuple(surface), min(s for _, s in pieces.values()) - UNKNOWN_PENALTY,
        max(map(len, pieces)), cut_pattern(pieces),
        frozenset(p[:i] for p in pieces for i in range(1, len(p))),
    )


def cut_pattern(pieces) -> str:
    """Parts that no piece reaches across: before a run of spaces, and around characters that only stand alone."""
    together = {c for p in pieces if len(p) > 1 for c in p}
    alone = re.escape("".join(c for c in "\n\r\t\v\f" if c not in together))
    if any(SPACE in p.lstrip(SPACE) for p in pieces):  # some piece goes on after a space: cut at lone characters only
        return f"[^{alone}]+|[{alone}]" if alone else r"(?s:.+)"
    return f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")


def marked(text: str | None) -> str:
    """The form that is cut into pieces; null and empty texts have none."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def shared(spark, path: str | None = None):
    """The model for all tasks, and the key under which a worker keeps what it builds from it."""
    return spark.sparkContext.broadcast(load(path)), f"{spark.sparkContext.applicationId} {path or default_path()}"
