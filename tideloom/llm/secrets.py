"""Secret scans: fixed patterns, and strings that compress badly next to their surroundings.

A candidate is a long token in a sensitive context. Its novelty is what it adds to the zstandard size of its context
(name, assignment, the text around it) when the compressor is primed with a dictionary of code and identifier words:
names, paths, versions and prose add few bytes a character, keys and passwords nearly as many as they have bits.

Defined cases: a null text counts as empty. Spans are in code points, end exclusive. A candidate that overlaps a span
of a fixed pattern is not reported again. Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideloom.llm.common import arrow_function

# The patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

# Words near which an unknown string is suspect.
SENSITIVE = (
    "password passwd passphrase secret token api_key apikey api-key access_key accesskey private_key credential "
    "client_secret authorization bearer auth_key signing_key encryption_key session_id connection_string"
).split()
CONTEXT = re.compile("|".join(map(re.escape, SENSITIVE)), re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~$@!^*-]{16,}")

# Words that code and configuration are made of; the compressor's dictionary.
IDENTIFIERS = (
    "import from class public private static final void return function const let var def self this new null none true "
    "false string int long float double boolean list dict map array object value name index count length size type id "
    "user username admin root host hostname port path file folder directory url uri http https localhost example com org "
    "net get set put post delete update insert select where order group config configuration settings environment env "
    "export default client server session connection database table column key keys public_key private_key access_key "
    "secret_key api_key token tokens password passphrase credential credentials authorization bearer basic auth "
    "authenticate certificate signature encrypt decrypt hash encode decode base64 utf8 ascii json yaml xml html version "
    "release build test tests main init start stop open close read write create remove handler manager service provider "
    "factory builder controller repository request response header headers body content message error exception "
    "timestamp date time year month day hour minute second abcdefghijklmnopqrstuvwxyz 0123456789 1234567890 "
    "placeholder changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 example_secret"
).split()

#: Compressed bytes a character from which a candidate is reported (random base64 has 0.75, random hex 0.5).
NOVELTY = 0.45
#: Characters before and after a candidate that belong to its context.
REACH = 48


def novelty(before: str, candidate: str, after: str, compressor: zstandard.ZstdCompressor) -> float:
    """Bytes a character that ``candidate`` adds to its surroundings, given the dictionary."""
    around = len(compressor.compress((before + " " + after).encode()))
    whole = len(compressor.compress((before + " " + candidate + " " + after).encode()))
    return (whole - around) / len(candidate)


def primed() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(" ".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if LONG_HEX.search(text):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(spans)


def novel_spans(text: str, taken, compressor, threshold: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Candidates near a sensitive word that are new to the compressor and outside ``taken``."""
    words = [(m.start(), m.end()) for m in CONTEXT.finditer(text)]
    if not words:
        return []
    spans, blocked, w, t = [], _merged(taken), 0, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while w < len(words) and words[w][1] + REACH < start:
            w += 1
        if w == len(words):
            break
        while t < len(blocked) and blocked[t][1] <= start:
            t += 1
        if words[w][0] > end + REACH or not _mixed(m[0]) or (t < len(blocked) and blocked[t][0] < end):
            continue
        before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
        if novelty(before, m[0], after, compressor) >= threshold:
            spans.append((start, 3, end))
    return spans


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for start, _, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _mixed(s: str) -> bool:
    """Keys mix digits with letters, or capitals with small letters inside; words and paths do not."""
    digits = sum(c.isdigit() for c in s)
    inner = sum(c.isupper() for c in s[1:])
    lower = sum(c.islower() for c in s)
    return (digits >= 2 and digits < len(s)) or (inner >= 3 and lower >= 3)


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


RESULT = (
    "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_novel:bigint,base_sha256:string,spans:string,"
    "found:array<struct<kind:string,start:bigint,end:bigint,text:string>>>"
)
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))


@arrow_function(RESULT)
def scan(texts: pa.Array) -> pa.Array:
    compressor = primed()
    out = []
    for value in texts:
        text = value.as_py() or ""
        base = base_spans(text) if text else []
        spans = sorted(base + novel_spans(text, base, compressor)) if text else []
        n = [sum(1 for s in spans if s[1] == k) for k in range(4)]
        found = [{"kind": KINDS[k], "start": s, "end": e, "text": text[s:e]} for s, k, e in spans]
        out.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), found))
    columns = list(zip(*out)) if out else [()] * 7
    types = [pa.int64()] * 4 + [pa.string(), pa.string(), _FOUND]
    names = ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "found"]
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


#: A text without any of these has no span of any kind: each pattern needs one of them.
GATE = r"(?i)passw|passphrase|secret|token|api[_-]?key|access_?key|_key|credential|authorization|bearer|session_id|connection_string|AKIA|[0-9a-f]{24}"


def scanned(text: Column) -> Column:
    """The struct :data:`RESULT` for a text column. Texts without a trace of a secret go to Python as empty."""
    return scan(F.when(text.rlike(GATE), text))


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the struct column ``out``: counts by kind, digests, and the spans with their text."""
    return docs.withColumn(out, scanned(F.col(text)))
