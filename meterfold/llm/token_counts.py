"""Token counts by rank-synchronous array merging.

A map over the documents. Texts are cut into pre-tokens that no piece of the vocabulary crosses (runs
of spaces with the word after them, line ends); the distinct pre-tokens of a batch become one ragged
array of symbols, and in every step each sequence merges its leftmost pair of lowest rank, all
sequences at once, until none has a pair left. What survives is counted; a symbol without a piece
counts its UTF-8 bytes. Counts of pre-tokens are kept per task in a bounded cache.

Pre-tokens of more than ``bpe_kernels.LONG`` symbols would take as many steps as they have merges,
each over the whole sequence; they make the same merges in the same order from a queue.

Defined cases: a null or empty text has no bytes and no tokens; other texts count whole, whatever
their length; null ids, repeated rows and further columns do not matter.
"""

from pyspark.sql import DataFrame

from meterfold.llm import bpe_kernels as kernels

LIMIT = 4096


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``model_path`` is on every executor."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        kernels.counts(model_path, limit),
        f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
