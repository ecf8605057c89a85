"""Operator 6: secrets by patterns, and by novelty against primed zstandard.

Three fixed patterns give the base spans. The method adds spans: a token after
a sensitive word is a candidate; it is compressed with a dictionary of code and
identifiers followed by the text around it, copies of the token itself taken
out, and its marginal bytes are compared with its length. Tokens that neither
the dictionary nor their surroundings explain, and whose signs are spread as in
a random string, are reported, but UUIDs, names and paths made of words, and
data marked as base64.

A token is a run of letters, digits and ``+/_-``, of ``LEAST`` signs or more,
that begins within ``REACH`` code points of a sensitive word's end, or behind a
full stop that ends such a run (the parts of a dotted token are found one by
one). A run right behind the word is the rest of a name, unless it begins with
``/`` or ``-``; a run that begins with ``/`` is a path, and its parts are tokens.

Whole texts are searched; words that a pattern must contain are looked for in
the bytes first, so most texts never become Python strings. Null texts count as
empty; very long texts are searched whole. Repeated rows give equal results;
spans that tie in their start are ordered by kind. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.storage import lean, small_batches
from aeroframe.llm.textbytes import text_bytes

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(rb"[0-9a-f]{24}")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A word that makes what follows sensitive, and the token that may follow within a few signs.
_SENSITIVE = re.compile(r"(?ai:pass(?:word|wd|phrase)|secret|token|credential|authorization|bearer|signature|(?:api|access|private|client|encryption|signing|account|shared)[_-]?key)")
_SENSITIVE_WORDS = (b"pass", b"secret", b"token", b"credential", b"authorization", b"bearer", b"signature", b"key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_=-]))?")  # '=' only as padding: before more signs it separates name and value
LEAST = 16  # signs of a candidate, padding included
REACH = 48  # code points between the word and the token, at most
AROUND = 1024  # bytes of text on each side that prime the compressor
NOVELTY = 0.7  # marginal bytes for each byte of the token, at least
WORDS = 0.8  # share of a token's letters in words from which it is a name or a path
SPREAD = 3.2  # bits of entropy of a sign in the token, at least

_UUID = re.compile(r"(?a)[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORDLIKE = re.compile(r"(?i)(?=.*[aeiouy])(?:[a-z]{3,15}|(?!.*[^aeiouy]{5})[a-z]{16,})")

#: What code around secrets commonly says; primes the compressor.
DICTIONARY = " ".join((
    "def class return import from self None True False lambda yield async await const let var function export default public private static final void int string boolean",
    "password passwd passphrase secret token api_key apikey access_key secret_key private_key client_secret client_id authorization bearer credentials signature session cookie",
    "username user email host hostname port database connection url uri endpoint region bucket account tenant project environment production staging development localhost example",
    "get_password set_password reset_password_token access_token refresh_token csrf_token auth_token id_token secret_access_key aws_access_key_id aws_secret_access_key",
    "config configuration settings options parameters request response header headers body content type application json text html utf-8 base64 sha256 hmac encode decode",
    "https://www.example.com/api/v1/ http://localhost:8080/ postgres:// mysql:// redis:// mongodb:// placeholder changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx",
    "-----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- ssh-rsa Authorization: Bearer X-Api-Key: abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789",
)).encode()


@dataclass(frozen=True)
class Span:
    """Code points [start, end) of a finding; the secret itself begins at ``value``."""

    start: int
    end: int
    kind: str
    value: int


def base_spans(text: str) -> list[Span]:
    found = [Span(m.start(), m.end(), "assign", m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [Span(m.start(), m.end(), "access", m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [Span(m.start(), m.end(), "hex", m.start()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]


def _compressed(context: bytes, tail: bytes) -> int:
    primed = zstandard.ZstdCompressionDict(DICTIONARY + context, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return len(zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress(tail))


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that the token adds to its surroundings, for each of its own."""
    token = text[start:end].encode()
    before, after = (x.encode().replace(token, b"") for x in (text[max(0, start - AROUND) : start], text[end : end + AROUND]))
    before, after = before[-AROUND:], after[:AROUND]
    context, lead = after + before, before[-32:]
    return (_compressed(context, lead + token) - _compressed(context, lead)) / len(token)


def _spread(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in (token.count(c) for c in set(token)))


def _in_words(token: str) -> bool:
    """Whether nearly all letters are in words, as in names and paths; words don't alternate with digits time and again."""
    if len(re.findall("[0-9]+", token)) > 3:
        return False
    runs = _RUN.findall(token)
    letters = sum(map(len, runs))
    return letters > 0 and sum(len(r) for r in runs if _WORDLIKE.fullmatch(r)) >= WORDS * letters


def _tokens(text: str, start: int, end: int, glued: bool) -> Iterator[tuple[int, int]]:
    """The tokens of a run; ``glued`` if a sensitive word ends where it begins."""
    if glued and text[start] not in "/-":
        return
    if text[start] != "/":
        while start < end and text[start] == "-":
            start += 1
        yield start, end
        return
    for part in re.finditer("[^/]+", text[start:end]):
        yield start + part.start(), start + part.end()


def _suspicious(text: str, start: int, end: int, known: list[Span]) -> bool:
    token = text[start:end]
    if len(token) < LEAST or any(s.start < end and start < s.end for s in known):
        return False
    if not re.search("[A-Za-z]", token) or _UUID.fullmatch(token) or text[max(0, start - 8) : start].endswith("base64,") or _in_words(token):
        return False
    return _spread(token) >= SPREAD and novelty(text, start, end) >= NOVELTY


def novel_spans(text: str, known: list[Span]) -> list[Span]:
    """Candidates in sensitive context that don't compress and touch no base span."""
    out, last = [], 0
    for word in _SENSITIVE.finditer(text):
        reach = word.end() + REACH  # bounds the token's start alone
        if last > reach:
            continue
        for m in _CANDIDATE.finditer(text, max(last, word.end())):
            start, end = m.span()
            if start > reach:
                break
            last = end
            if text[end : end + 1] == ".":
                reach = max(reach, end + 1)
            out += [Span(a, b, "novel", a) for a, b in _tokens(text, start, end, start == word.end()) if _suspicious(text, a, b, known)]
    return out


def scan(raw: bytes) -> list[Span]:
    """All spans of a text in UTF-8, by start, then kind."""
    low = raw.lower()
    wanted = any(w in low for w in _ASSIGN_WORDS) or b"AKIA" in raw or _LONG_HEX.search(raw) is not None
    sensitive = any(w in low for w in _SENSITIVE_WORDS)
    if not wanted and not sensitive:
        return []
    text = raw.decode()
    found = base_spans(text) if wanted else []
    if sensitive:
        found += novel_spans(text, found)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, spans: list[Span], mark: str = "<SECRET>") -> str:
    """The text with each secret's own signs replaced; names before it stay."""
    out, at = [], 0
    for a, b in sorted((s.value, s.end) for s in spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _texts(column: pa.Array) -> Iterator[bytes]:
    offsets, data = text_bytes(column)
    raw = data.data
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(raw[a:b])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    say = lambda spans: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((4, batch.num_rows), np.int64)
            digests, said = [], []
            for i, raw in enumerate(_texts(batch.column(1))):
                spans = scan(raw)
                for s in spans:
                    counts[KINDS.index(s.kind), i] += 1
                digests.append(hashlib.sha256(say(s for s in spans if s.kind != "novel").encode()).hexdigest())
                said.append(say(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digests, pa.string()), pa.array(said, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(find), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced; all columns and rows stay."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, changed = batch.column(at), {}
            for i, raw in enumerate(_texts(column)):
                if spans := scan(raw):
                    changed[i] = redact(raw.decode(), spans)
            if changed:
                values = column.to_pylist()
                for i, text in changed.items():
                    values[i] = text
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(clean), docs.schema)
