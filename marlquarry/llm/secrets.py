"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

A long token in a sensitive context is compressed after the text that stands on both sides of it, by a compressor
primed with identifiers of code and of prose. What the token adds to the frame, its marginal bytes, is
near its length only when neither the dictionary nor its surroundings foretell it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "novel")
#: The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Words that make the text before a token sensitive.
SENSITIVE = re.compile(
    r"(?:auth|bearer|basic|credential|private|access|secret|token|passw|pwd|passphrase|signature|signing|session|cookie|client|license|api|key|webhook|conn(?:ection)?[_ ]?str)[a-z0-9_. -]{0,24}[\"'`]?\s{0,3}(?:[:=]|=>|is|->)?\s{0,3}[\"'`<(]{0,2}$",
    re.ASCII | re.IGNORECASE,
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Identifiers and words that source code and its comments repeat.
IDENTIFIERS = """
abstract access account action address algorithm allocate application argument array assert async attribute authenticate
authorization await backend background base64 begin boolean boundary branch break buffer build button bytes cache callback
cancel capacity catch certificate character charset checksum class client close cluster collection column command comment
commit compile component compress config configuration connect connection console const constant constructor container
content context continue control controller convert cookie count create credential current cursor database dataframe date
debug decode default define delete description destination device dictionary directory disable display document domain
double download driver element email enable encode encrypt endpoint engine enterprise entity enumerate environment error
event example exception execute export extends extension external factory false field filename filter finally float folder
format frame framework function gateway generate getattr global handler hash header height helper hidden history hostname
html http https identifier image implement import index information initialize input insert instance integer interface
internal invalid iterator javascript json keyword label lambda language latitude length library license limit listener
local location logger login longitude manager mapping master match maximum member memory message metadata method minimum
model module monitor mutable namespace network notification null number object offset operation operator option order
organization output override package parameter parent parse password pattern payload permission pipeline pointer policy
position prefix previous primary print private process product profile program project property protected protocol provider
public query queue random range reader receive record redirect reference register release remote remove render replace
report repository request require reset resource response result return revision route runtime sample schedule schema
scope search secret section select self sequence serialize server service session setting shared signature simple single
socket source stack standard start state static status storage stream string struct style submit subscription success
suffix super support switch symbol sync system table target task template temporary terminal test thread throw timeout
timestamp title token transaction transform translate transport true type undefined unique update upload url user username
utility validate value variable vector version view virtual visible void volume warning webhook while widget width window
wrapper write yield ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 xxxxxxxxxxxxxxxx ================
----------------________________ https://www.example.com/path/index.html sha256 md5 uuid 00000000000000000000000000000000
"""


@dataclass(frozen=True)
class NoveltyConfig:
    """context: characters on each side of a candidate that prime the compressor besides the dictionary. min_ratio: marginal bytes
    per character from which a candidate is incompressible. Both letters and digits are needed (min_classes)."""

    context: int = 256
    before: int = 48
    min_ratio: float = 0.72
    min_classes: int = 2
    level: int = 6


class _Novelty:
    def __init__(self, cfg: NoveltyConfig):
        self.cfg = cfg
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=cfg.level, dict_data=primed, write_content_size=False, write_dict_id=False)

    def marginal(self, text: str, start: int, end: int) -> int:
        """Bytes that text[start:end] adds to the compressed text after and before it."""
        head = (text[end : end + self.cfg.context] + text[max(0, start - self.cfg.context) : start]).encode()
        return len(self.press.compress(head + text[start:end].encode())) - len(self.press.compress(head))

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        found = []
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            token = m[0]
            if any(a < end and start < b for a, b, _ in taken):
                continue
            kinds = bool(re.search("[a-z]", token)) + bool(re.search("[A-Z]", token)) + 2 * bool(re.search("[0-9]", token))
            if kinds <= self.cfg.min_classes or not SENSITIVE.search(text[max(0, start - self.cfg.before) : start]):
                continue
            if self.marginal(text, start, end) >= self.cfg.min_ratio * (end - start):
                found.append((start, end, "novel"))
        return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_text(text: str, novelty: _Novelty) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    return _ordered(base), _ordered(base + novelty.spans(text, base))


SCAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def scan_secrets(documents: DataFrame, cfg: NoveltyConfig | None = None) -> DataFrame:
    """One row for every row of documents (doc_id, text): counts by kind, the base digest and all spans.

    Null and empty texts have no spans and the digest of the empty string; repeated rows are scanned each. Spans
    may overlap between base kinds, never between a base kind and 'novel'. Whole texts are read in one pass.
    """
    cfg = cfg or NoveltyConfig()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = _Novelty(cfg)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                base, every = scan_text(text.as_py() or "", novelty)
                counts = [sum(k == kind for _, _, k in every) for kind in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=[x.split()[0] for x in SCAN_SCHEMA.split(", ")])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, SCAN_SCHEMA)


def redact_secrets(documents: DataFrame, cfg: NoveltyConfig | None = None, mark: str = "<SECRET>") -> DataFrame:
    """documents with each secret span of text replaced by mark; n_chars, where there is one, follows the new text.

    Overlapping spans are replaced as one. Other columns, row count and null texts stay as they are.
    """
    cfg = cfg or NoveltyConfig()
    schema = documents.schema
    at = documents.columns.index("text")
    length = documents.columns.index("n_chars") if "n_chars" in documents.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = _Novelty(cfg)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = np.zeros(len(texts), dtype=bool)
            for i, text in enumerate(texts):
                spans = scan_text(text, novelty)[1] if text else []
                if not spans:
                    continue
                parts, done = [], 0
                for start, end, _ in spans:
                    if start >= done:
                        parts += [text[done:start], mark]
                    done = max(done, end)
                texts[i], changed[i] = "".join(parts) + text[done:], True
            if changed.any():
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if length is not None:
                    old = columns[length].to_pylist()
                    new = [len(t) if c else n for t, c, n in zip(texts, changed, old, strict=True)]
                    columns[length] = pa.array(new, batch.schema.field(length).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return documents.mapInArrow(run, schema)
