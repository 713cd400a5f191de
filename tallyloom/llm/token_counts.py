"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm import pieces
from tallyloom.llm.common import map_texts


class _Counts(dict):
    """Tokens of a chunk: 1 for those proven to be one token, else counted by merging."""

    def __init__(self, whole: list[str], encode):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.encode = whole, encode

    def __missing__(self, chunk: str) -> int:
        if len(self) >= len(self.whole) + pieces.REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self[chunk] = len(self.encode(chunk))
        return n


def count_tokens(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 4096,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Offline, on the driver, the vocabulary is tried out once: a string that is a whole
    whitespace chunk and encodes alone as its own token counts 1 wherever it stands as a
    chunk. Only the remaining chunks are merged, and a worker remembers a bounded number of
    them. A model whose pieces cross whitespace counts whole texts instead.

    Null text counts as empty (0 bytes, 0 tokens). Null ids, repeated rows and texts of any
    length are kept, one row out per row in. Further columns are not read.
    """
    model = pieces.model_bytes(model_path)
    sp = pieces.load(model)
    whole = pieces.whole_tokens(sp) if pieces.splits_at_markers(sp) else None
    shipped = docs.sparkSession.sparkContext.broadcast((model, whole))  # bounded by the vocabulary

    def make():
        model, whole = shipped.value
        sp = pieces.load(model)
        if whole is None:
            return lambda t: (len(t.encode()), len(sp.encode(t)))
        count = _Counts(whole, pieces.chunk_encoder(sp)).__getitem__
        split = pieces.chunks
        return lambda t: (len(t.encode()), sum(map(count, split(t))))

    return map_texts(docs, text_col, [id_col], make, [("n_bytes", "long"), ("n_tokens", "long")]
                     ).withColumn("over_limit", F.col("n_tokens") > limit)
