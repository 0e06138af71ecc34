"""Numbers of tokens of whole texts (byte-level BPE), lengths only.

The texts of an Arrow batch go to the library in batches balanced by bytes. Long
texts are split first, at safe boundaries: before a single space that stands
between two characters which are not white space. The pre-tokenizer starts a new
piece there whatever surrounds it, so counts of the parts add up to the count of
the text. Nothing but a batch of parts is held, whatever the texts are made of.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowsieve.llm.common import map_batches, texts
from flowsieve.llm.token_memo import by_bytes, load

# A longer text is split at the first safe boundary after so many characters.
PART_CHARS = 1 << 13
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def safe_parts(text: str, length: int = PART_CHARS) -> Iterator[str]:
    """``text`` cut at safe spaces into parts of about ``length`` characters, which joined
    give it back; what follows the last safe space stays whole, however long."""
    at = 0
    while len(text) - at > length and (space := _SAFE.search(text, at + length)):
        yield text[at : space.start()]
        at = space.start()
    if at < len(text):
        yield text[at:]


def lengths(some: Iterable[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    owner: list[int] = []
    n_bytes: list[int] = []

    def parts() -> Iterator[str]:
        for i, text in enumerate(some):
            n_bytes.append(len(text) if text.isascii() else len(text.encode()))
            for part in safe_parts(text):
                owner.append(i)
                yield part

    tokens = [len(e) for batch in by_bytes(parts()) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
    total = np.zeros(len(n_bytes), np.int64)
    np.add.at(total, np.array(owner, np.int64), np.array(tokens, np.int64))
    return np.array(n_bytes, np.int64), total


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a tokenizers file. Special strings inside a text
    count as the library reads them (one token); none are added. Null and empty
    texts have 0 bytes and 0 tokens, very long ones are counted in parts. Repeated rows and null ids come back as they
    are, other columns are ignored, an empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_bytes, n_tokens = lengths(texts(batch), load(tokenizer))
        columns = [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))]
    return map_batches(docs.select("doc_id", "text"), run, fields)
