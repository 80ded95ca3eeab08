"""Token counts of whole texts: batch encoding inside Arrow functions, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from armspan.llm.common import arrow_map, pick
from armspan.llm.words import SpacedWords, parts, token_lengths

_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def count_tokens(
    df: DataFrame, tokenizer: str, limit: int = 512, part_chars: int = 262_144, batch_bytes: int = 1_048_576
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a byte-level tokenizer file on every executor. Texts are
    encoded in batches of about ``batch_bytes``, so a batch weighs the same whether its texts
    are long or short. A text of over ``part_chars`` characters is cut before single spaces,
    where the tokenizer starts a new word in any case, and encoded part by part. Special
    strings inside texts become special tokens, which is the library's default.

    Nothing is shuffled. A null text counts as empty: 0 bytes, 0 tokens. Null and repeated
    doc_ids keep their rows; extra columns are ignored; an empty table gives no rows.
    """

    def each(rows: Iterator[dict]) -> Iterator[tuple]:
        encoder = token_lengths(tokenizer)
        batch: list[tuple] = []
        weight = 0
        for row in rows:
            text = row["text"] or ""
            n_bytes = len(text.encode())
            if len(text) > part_chars:
                n = sum(sum(encoder.values([part])[0]) for part in parts(text, part_chars))
                yield row["doc_id"], n_bytes, n, n > limit
                continue
            batch.append((row["doc_id"], n_bytes, text))
            weight += n_bytes
            if weight >= batch_bytes:
                yield from _counted(batch, encoder, limit)
                batch, weight = [], 0
        if batch:
            yield from _counted(batch, encoder, limit)

    return arrow_map(pick(df, "doc_id", "text"), each, _SCHEMA)


def _counted(batch: list[tuple], encoder: SpacedWords, limit: int) -> Iterator[tuple]:
    values = encoder.values([text for _, _, text in batch])
    for (doc_id, n_bytes, _), counts in zip(batch, values, strict=True):
        n = sum(counts)
        yield doc_id, n_bytes, n, n > limit
