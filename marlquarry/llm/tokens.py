"""Token ids of whole texts, with the byte-level BPE vocabulary that the tokenizers library reads from byte_bpe_50k.json.

The same vocabulary exists as ranks for tiktoken, which gives the same ids several times faster; tests hold both against
each other. The strings of added tokens stand for their one id each, as the library has it by default.
"""

from __future__ import annotations

import base64
import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken

JSON = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: The id that ends each document.
END = 0


@lru_cache(2)
def encoder(path: str | None = None, tokenizer: str | None = None) -> tiktoken.Encoding:
    """path: ranks; tokenizer: the library's file of the same vocabulary, for its added tokens."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path or public_tokenizers.path(RANKS)).read_bytes().splitlines())}
    added = json.loads(Path(tokenizer or public_tokenizers.path(JSON)).read_text()).get("added_tokens", [])
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def document_ids(text: str | None, path: str | None = None) -> np.ndarray:
    """Ids of a document, closed by END; null is empty."""
    ids = encoder(path).encode(text or "", allowed_special="all")
    ids.append(END)
    return np.array(ids, dtype="<u4")
