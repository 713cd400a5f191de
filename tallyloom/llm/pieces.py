"""Whitespace chunks of a sentencepiece BPE model and what it makes of them.

A chunk is a run of whitespace markers with the text up to the next marker. If no piece of the
vocabulary has a marker behind another character, no merge can cross the start of a chunk, so
a text's pieces are those of its chunks, one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import sentencepiece

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
_CROSSING = re.compile(f"[^{MARK}]{MARK}")

# Distinct chunks a worker remembers before it starts anew.
REMEMBERED = 400_000


def model_bytes(path: str) -> bytes:
    """The model file; its bytes travel to the tasks, which need no copy of their own."""
    with open(path, "rb") as f:
        return f.read()


def load(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_markers(sp: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether texts may be cut before whitespace markers.

    Holds if no piece crosses a marker, white space is kept as it is, a marker is put before
    the text, and no character is unknown (bytes stand in).
    """
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(_CROSSING.search(p) for p in pieces):
        return False
    for probe in (" a", "a", "a  b ", "\ta\n \r\nb", "Ⅳ ﬁ ½", "\U0010fffd"):
        ids = sp.encode(probe)
        if sp.decode(ids) != probe or sp.unk_id() in ids:
            return False
    first = sp.id_to_piece(sp.encode("a")[0])
    return first.startswith(MARK)


def chunks(text: str) -> list[str]:
    """Chunks of a whole text; none for the empty text."""
    return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []


def chunk_encoder(sp: sentencepiece.SentencePieceProcessor) -> Callable[[str], list[int]]:
    """Function from a chunk to its ids."""
    lone = sp.encode("a ")[len(sp.encode("a")):]  # a marker that ends a text

    def encode(chunk: str) -> list[int]:
        return sp.encode(chunk[1:]) if len(chunk) > 1 else lone

    return encode


def chunks_encoder(sp: sentencepiece.SentencePieceProcessor) -> Callable[[list[str]], list[list[int]]]:
    """Function from a list of chunks to their ids, in one call of the library."""
    one = chunk_encoder(sp)

    def encode(some: list[str]) -> list[list[int]]:
        got = sp.encode([c[1:] for c in some], num_threads=1)
        return [ids if len(c) > 1 else one(c) for c, ids in zip(some, got)]

    return encode


def whole_tokens(sp: sentencepiece.SentencePieceProcessor) -> list[str]:
    """Vocabulary strings that are a chunk and encode alone as that one token, shown piece by piece."""
    encode = chunk_encoder(sp)
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not sp.is_control(i) and not sp.is_byte(i) and CHUNK.fullmatch(p) and encode(p) == [i]:
            out.append(p)
    return out
