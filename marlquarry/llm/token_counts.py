"""Token counts of whole texts; huge ones are encoded in overlapping chunks whose encodings are spliced.

Why a splice is right: a byte-level tokenizer cuts text into words by a pattern that is matched from left to right and looks at
most one character past what it takes, and it merges within words only. What follows a word's start depends on the text from there
on alone, so a chunk that starts anywhere is right from the first true word start that it finds. What comes before a
word's end is settled once that end and what an added token could reach beyond it lie inside the chunk. A word start that two overlapping
chunks have in common, far enough from the end of the left one, is therefore a word start of the whole text, and the tokens of the left
chunk before it and of the right one after it are the text's own. A start of a mere token proves nothing: merges within a
word depend on all of it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

JSON = "byte_bpe_50k.json"


@dataclass(frozen=True)
class CountConfig:
    """chunk: code points of a text that are encoded at once. overlap: code points that neighbouring chunks share at first.
    batch: code points of whole texts in a call of the library. limit: most tokens of a document that is not over it."""

    chunk: int = 16_384
    overlap: int = 256
    batch: int = 1 << 18
    limit: int = 1024
    tokenizer: str | None = None

    def __post_init__(self) -> None:
        if not 0 < self.overlap < self.chunk:
            raise ValueError("overlap must be positive and less than chunk")


@lru_cache(2)
def load(path: str | None = None) -> tuple[Tokenizer, int]:
    """The library's tokenizer and how far from a chunk's end a word start must lie to count as settled."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    path = path or public_tokenizers.path(JSON)
    told = json.loads(Path(path).read_text())
    words = told.get("pre_tokenizer") or {}
    if told.get("normalizer") or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
        raise ValueError("splices are proven for byte-level tokenizers without a normalizer, prefix spaces or tokens that strip")
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    found.post_processor = None
    return found, 1 + max([1, *(len(t["content"]) for t in told["added_tokens"])])


def word_starts(encoded: Encoding, at: int, low: int, high: int) -> dict[int, int]:
    """Places of the text in low .. high where a word of the chunk starts, with the number of the token that starts there.

    The chunk starts at `at`. Tokens are looked at from the nearer end of the chunk, and only as far as needed.
    """
    n, found = len(encoded), {}
    place = lambda i: at + encoded.token_to_chars(i)[0]
    near_end = n > 0 and high - place(0) > place(n - 1) - low
    for i in reversed(range(n)) if near_end else range(n):
        p = place(i)
        if p < low if near_end else p > high:
            break
        if low <= p <= high and (i == 0 or encoded.token_to_word(i) != encoded.token_to_word(i - 1)):
            found[p] = i
    return found


#: A chunk's encoding and the range of its tokens that are the text's next ones.
Piece = tuple[Encoding, int, int]


def spliced(text: str, cfg: CountConfig) -> Iterator[Piece]:
    """The tokens of a text, chunk by chunk. At no time are more than two chunks' encodings held.

    Where the overlap shows no common word start, it is doubled, back to where the left chunk is known to be right; if
    it holds none at all, a single word fills it, and the chunk itself is doubled until that word ends.
    """
    tokenizer, margin = load(cfg.tokenizer)
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    # The left chunk starts at `at` and is right from `known`, its token number `first`, on.
    at = known = first = 0
    end = min(len(text), cfg.chunk)
    left = encode(at, end)
    while end < len(text):
        overlap = cfg.overlap
        while True:
            begin = max(known, end - overlap)
            settled = word_starts(left, at, max(begin, known + 1), end - margin)
            if settled:
                stop = min(len(text), end + cfg.chunk - cfg.overlap)
                right = encode(begin, stop)
                starts = word_starts(right, begin, begin, end - margin)
                common = max(settled.keys() & starts.keys(), default=None)
                if common is not None:
                    yield left, first, settled[common]
                    at, known, first, end, left = begin, common, starts[common], stop, right
                    break
            if begin == known:
                end = min(len(text), 2 * end - known)
                at, first, left = known, 0, encode(known, end)
                break
            overlap *= 2
    yield left, first, len(left)


def token_ids(text: str, cfg: CountConfig) -> Iterator[int]:
    """The ids of a text of any length."""
    for encoded, a, b in spliced(text, cfg):
        yield from encoded.ids[a:b]


def counts(texts: list[str], cfg: CountConfig) -> list[int]:
    """Tokens of each text: short ones in calls of the library that hold about cfg.batch code points, huge ones spliced."""
    tokenizer, _ = load(cfg.tokenizer)
    found = [0] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        for i, e in zip(held, tokenizer.encode_batch_fast([texts[i] for i in held], add_special_tokens=False), strict=True):
            found[i] = len(e)
        held.clear()

    for i, text in enumerate(texts):
        if len(text) > cfg.chunk:
            found[i] = sum(b - a for _, a, b in spliced(text, cfg))
            continue
        held.append(i)
        size += len(text)
        if size >= cfg.batch:
            flush()
            size = 0
    flush()
    return found


def count_tokens(documents: DataFrame, cfg: CountConfig | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of documents (doc_id, text); other columns are ignored.

    Whole texts are counted as the tokenizers library has them, without begin, end or added special tokens; the string of a
    special token within a text is its one id. Null and empty texts have no bytes and no tokens. Repeated rows are counted each. Very
    long texts are spliced, see above: memory follows the chunk, not the text, but for a single word of many chunks. No row is
    shuffled or written; a lost executor costs its running tasks. An empty table gives no rows.
    """
    cfg = cfg or CountConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            n = pa.array(counts(text.to_pylist(), cfg), pa.int64())
            size = pc.cast(pc.binary_length(text), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pc.greater(n, cfg.limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

