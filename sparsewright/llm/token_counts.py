"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are grouped into calls of about `CALL_BYTES` bytes, whatever their number.  A text longer than
`PIECE_CHARS` is split where the count of the parts is sure to add up to that of the whole: before a space
that follows another character.  The vocabulary is checked to hold no piece with a space after another
character, so no merge crosses such a place; the second part gives up that space, for which the
tokenizer puts its own word mark in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL_BYTES = 1 << 18
PIECE_CHARS = 1 << 14
OVER = 4096
#: How the tokenizer writes a space.
MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def splits_at_spaces(path: str) -> bool:
    """Whether a split before a space after another character is safe for this model."""
    model = load(path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    added = model.encode(["a", "a b", "a  b", " a"])
    plain = len(added[0]) and added[3] != added[0] and model.decode(added[2]) == "a  b"  # a mark in front, spaces kept
    return bool(plain) and not any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:], strict=False))


def split_text(text: str, limit: int = PIECE_CHARS) -> list[str]:
    """Parts of about `limit` characters whose token counts add up to the text's."""
    parts, at, n = [], 0, len(text)
    while n - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and text[cut - 1] in (" ", MARK):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 >= n:
            break
        parts.append(text[at:cut])
        at = cut + 1
    return [*parts, text[at:]]


def _count(path: str, call_bytes: int, piece_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        limit = piece_chars if splits_at_spaces(path) else 1 << 62
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            texts, rows, held = [], [], 0

            def flush(totals=totals):
                np.add.at(totals, rows, [len(x) for x in model.encode(texts, num_threads=1)])

            for r, (text, size) in enumerate(zip(batch.column("text"), batch.column("n_bytes").to_pylist(), strict=True)):
                parts = split_text(text.as_py() or "", limit)
                for part in parts:
                    texts.append(part)
                    rows.append(r)
                    held += size if len(parts) == 1 else len(part.encode())
                    if held >= call_bytes:
                        flush()
                        texts, rows, held = [], [], 0
            if texts:
                flush()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(totals)], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, over: int = OVER, call_bytes: int = CALL_BYTES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per row of `docs`: its id, `n_bytes` (UTF-8), `n_tokens`, `over_limit` (more than `over`).

    No begin, end or added tokens; special strings in texts are ordinary text.  Null counts as the empty
    text, which has no token.  Repeated rows are counted alike; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_count(model_path or default_model(), call_bytes, piece_chars), f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > over).withColumnRenamed("id", id_col)
