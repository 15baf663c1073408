"""Secret scans: patterns of known secrets, and dictionary-primed zstandard novelty for the rest.

The base patterns are assignments to secret names, access keys and long runs of hex digits. The method adds
candidates that no base span covers: long strings without spaces, of mixed characters, close behind a word that
speaks of secrets. What a candidate costs is measured: the bytes that it adds to its surroundings compressed with a
dictionary of code and identifiers. Names, paths and words are in the dictionary or the surroundings and add
little; random strings cannot be compressed, and those are reported.

Scale: a map over rows without a shuffle; whole texts, batch by batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import with_package

KINDS = ("assign", "access", "hex", "novel")
# The base patterns. Letters of the first one's words in either case, A-Z and a-z only.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"(?=[PSTApsta])({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

#: Words that make a context sensitive, within REACH code points before a candidate.
CONTEXT = re.compile(r"(?i:passw|secret|token|api.?key|credential|private|bearer|auth|access.?key|signature|client.?id|pwd)")
CANDIDATE, LEAST = re.compile(r"[A-Za-z0-9+/_=~.-]{16,}"), 16
#: A candidate starts within REACH code points behind its context; AROUND code points on each side are its surroundings.
REACH, AROUND, NOVEL = 48, 512, 0.6
#: What code and identifiers look like; primes the compressor.
DICTIONARY = (
    "import os from pathlib return self.client = Client(config) def get_user(request, response): if not found: raise ValueError "
    "const module exports function async await export default class public static void main String[] args private final int "
    "password passwd secret token api_key apikey access_key client_id client_secret private_key credentials authorization bearer "
    "username user_name email address first_name last_name created_at updated_at database_url localhost connection_string "
    "https://www.example.com/index.html http://api.example.org/v1/users/login?redirect=home&lang=en utm_source=feed "
    "application/json charset=utf-8 content-type text/html; multipart/form-data; boundary= accept-encoding gzip deflate "
    "the and of to a in that is was for on with as are this be at or by from le la les des une est que dans pour "
    "der die das und ist nicht ein eine mit el los las por con para una configuration settings environment production development "
    "SELECT FROM WHERE GROUP BY ORDER INSERT INTO VALUES UPDATE DELETE CREATE TABLE 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
).encode() * 2

SCHEMA = "n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"


def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(around: bytes, candidate: bytes, compressor: zstandard.ZstdCompressor) -> float:
    """Bytes that ``candidate`` adds to its surroundings once compressed, per byte of it."""
    return (len(compressor.compress(around + candidate)) - len(compressor.compress(around))) / max(len(candidate), 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], compressor: zstandard.ZstdCompressor) -> list[tuple[int, int, int]]:
    """Candidates in sensitive context that no base span meets and that do not compress."""
    found, done, met, reach = [], 0, 0, 0  # reach: where the base spans that start so far end
    for hint in CONTEXT.finditer(text):
        last = hint.end() + REACH
        # a run that starts in reach is seen by its first characters, then read to its end
        while m := CANDIDATE.search(text, max(hint.end(), done), max(hint.end(), done, last + LEAST)):
            m = CANDIDATE.match(text, m.start())
            done, s = m.end(), m.group()
            while met < len(base) and base[met][0] < m.end():
                reach, met = max(reach, base[met][2]), met + 1
            kinds = any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)
            if kinds < 2 or reach > m.start():
                continue
            around = text[max(0, m.start() - AROUND) : m.start()] + text[m.end() : m.end() + AROUND]
            if novelty(around.encode("utf-8", "replace"), s.encode(), compressor) >= NOVEL:
                found.append((m.start(), 3, m.end()))
    return found


def scan(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple[int, int, int, int, str, str]:
    text = text or ""
    base = base_spans(text)
    spans = sorted(base + novel_spans(text, base, compressor))
    line = lambda xs: ",".join(f"{KINDS[k]}:{b}:{e}" for b, k, e in xs)
    n = [sum(k == i for _, k, _ in spans) for i in range(4)]
    return n[0], n[1], n[2], n[3], hashlib.sha256(line(base).encode()).hexdigest(), line(spans)


def scan_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep``, then n_assign, n_access, n_hex, n_novel, base_sha256 and spans.

    Spans are of whole matches, in code points, end exclusive. A null text is as an empty one: no spans, the hash of
    an empty string; an empty table gives no rows. Equal rows stay as many rows; other columns of the input are not
    read, and columns in ``keep`` that are named like the results give way to them. Novel spans are of candidates of
    ``LEAST`` code points or more that start at most ``REACH`` code points behind a word of ``CONTEXT``, judged against
    ``AROUND`` code points on each side: these are parameters of the method, base spans have no such bounds. Texts are
    read whole, in time linear in their length.
    """
    named = {x.split()[0] for x in SCHEMA.split(", ")}
    texts = docs.select(*[F.col(f"`{c}`") for c in keep if c != text and c not in named], F.col(f"`{text}`").alias("__text"))
    kept = [f for f in texts.schema if f.name != "__text"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor()
        for part in parts:
            found = list(zip(*(scan(t.as_py(), compressor) for t in part.column("__text")))) or [()] * 6
            columns = [part.column(f.name) for f in kept] + [pa.array(found[i], pa.int64()) for i in range(4)] + [pa.array(found[i], pa.string()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + ["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    schema = texts.drop("__text").schema
    for name, kind in (x.split() for x in SCHEMA.split(", ")):
        schema = schema.add(name, kind)
    return with_package(texts).mapInArrow(batches, schema)
