"""Secret scans: keyword prefilter, anchored expressions near hits, checksums.

One Aho-Corasick pass over the text (A-Z lower-cased) finds keywords; an
expression is tried only at a keyword's position. Hexadecimal runs have no
keyword: a run of 24 or more covers at least one of every 24th character, so
only those positions are looked at. The other kinds carry a check of their own
and count only if it holds: platform tokens a CRC-32, extended wallet keys a
doubled SHA-256 (base 58), age and nostr keys a BCH code (bech32), PEM keys the
stated DER lengths of the outer sequence and all its members, OpenSSH keys their
two equal check numbers (or, enciphered, their stated lengths).

Offsets are code points, end exclusive; matches of one kind are leftmost and do
not overlap. Defined cases: a null text is empty; texts are scanned whole;
repeated rows are scanned alike; an empty table gives an empty result; other
columns, whatever their names, are kept untouched by ``redact_secrets``.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Span = tuple[str, int, int]

#: In listing order; ties of start are put out in this order.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "platform_token", "private_key", "wallet_key", "age_key", "nostr_key")
MARK = "[SECRET]"

#: Keywords and the expressions anchored at them.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
TOKEN_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
KEY = re.compile(r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
WALLET_WORDS = ("tprv", "xprv", "yprv", "zprv")
WALLET = re.compile(f"[txyz]prv([{BASE58}]{{107}})(?![{BASE58}])")
AGE = re.compile(f"AGE-SECRET-KEY-1([{BECH32.upper()}]{{58}})(?![A-Z0-9])")
NOSTR = re.compile(f"nsec1([{BECH32}]{{58}})(?![a-z0-9])")

MIN_HEX = 24
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_HEX = re.compile(rb"[0-9a-f]+")


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("platform_token", TOKEN_WORDS), ("private_key", ("-----begin ",)), ("wallet_key", WALLET_WORDS), ("age_key", ("age-secret-key-1",)), ("nostr_key", ("nsec1",))):
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def token_checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of a token's random part."""
    crc, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits


def base58_holds(key: str) -> bool:
    """Do the last four bytes of a base-58 key begin the doubled SHA-256 of the rest?"""
    n = 0
    for c in key:
        n = 58 * n + BASE58.index(c)
    raw = n.to_bytes(82, "big") if n < 1 << 656 else b""
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:] and bool(raw)


def bech32_state(prefix: str, digits: list[int]) -> int:
    """The BCH code's remainder over prefix and digits; 1 for a whole key."""
    state = 1
    for v in [*[ord(c) >> 5 for c in prefix], 0, *[ord(c) & 31 for c in prefix], *digits]:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            if top >> i & 1:
                state ^= step
    return state


def bech32_holds(prefix: str, data: str) -> bool:
    return bech32_state(prefix, [BECH32.index(c) for c in data.lower()]) == 1


def _der_end(raw: bytes, at: int) -> int:
    """Where the DER value at ``at`` ends; -1 if its header is cut or ill-formed."""
    if at + 2 > len(raw):
        return -1
    n = raw[at + 1]
    if n < 0x80:
        return at + 2 + n
    n &= 0x7F
    return at + 2 + n + int.from_bytes(raw[at + 2 : at + 2 + n], "big") if 1 <= n <= 4 and at + 2 + n <= len(raw) else -1


def _der_holds(raw: bytes) -> bool:
    """One sequence that fills ``raw``, whose members fill the sequence."""
    if raw[:1] != b"0" or _der_end(raw, 0) != len(raw):
        return False
    at = 2 + (raw[1] & 0x7F if raw[1] >= 0x80 else 0)
    while 0 <= at < len(raw):
        at = _der_end(raw, at)
    return at == len(raw)


def _openssh_holds(raw: bytes) -> bool:
    """Magic, length-prefixed fields to the end, and, if not enciphered, two equal check numbers."""
    at, fields = 15, []
    for i in range(5):
        if i == 3:
            at += 4  # the number of keys
        size = int.from_bytes(raw[at : at + 4], "big")
        fields.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
        if at > len(raw):
            return False
    cipher, secret = fields[0], fields[4]
    return at == len(raw) and (cipher != b"none" or (len(secret) >= 8 and secret[:4] == secret[4:8]))


def key_is_whole(body: str) -> bool:
    """Does the base64 body hold a whole DER sequence or OpenSSH key?"""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    return _openssh_holds(raw) if raw.startswith(b"openssh-key-v1\0") else _der_holds(raw)


def _accepted(kind: str, text: str, start: int) -> tuple[int, bool] | None:
    """(end of the match at ``start``, whether it counts), or None."""
    if kind == "assign":
        m = ASSIGN.match(text, start)
        return m and (m.end(), len(m[1]) >= 6)
    if kind == "access":
        m = ACCESS.match(text, start)
        return m and (m.end(), m.end() - start >= 20)
    if kind == "platform_token":
        m = TOKEN.match(text, start)
        return m and (m.end(), token_checksum(m[1]) == m[2])
    if kind == "wallet_key":
        m = WALLET.match(text, start)
        return m and (m.end(), base58_holds(m[0]))
    if kind == "age_key":
        m = AGE.match(text, start)
        return m and (m.end(), bech32_holds("age-secret-key-", m[1]))
    if kind == "nostr_key":
        m = NOSTR.match(text, start)
        return m and (m.end(), bech32_holds("nsec", m[1]))
    m = KEY.match(text, start)
    return m and (m.end(), key_is_whole(m[2]))


def _hex_runs(text: str) -> Iterator[Span]:
    raw = text.encode("latin-1", "replace")  # one byte for each code point
    codes = np.frombuffer(raw, dtype=np.uint8)
    at = np.arange(MIN_HEX - 1, len(codes), MIN_HEX)
    at = at[_IS_HEX[codes[at]]]
    if len(at):
        # of the 24 characters or more around it, 12 lie on one side of the position
        last = len(codes) - 1
        held = lambda d: _IS_HEX[codes[np.clip(at + d, 0, last)]]
        at = at[(held(-4) & held(-8) & held(-11)) | (held(4) & held(8) & held(11))]
    end = 0
    for p in at.tolist():
        if p < end:
            continue
        start = p
        while start > end and _IS_HEX[raw[start - 1]]:
            start -= 1
        end = _HEX.match(raw, start).end()
        if end - start >= MIN_HEX:
            yield "hex", start, end


_AUTOMATON = None


def find_secrets(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed."""
    global _AUTOMATON
    if not text:
        return []
    _AUTOMATON = _AUTOMATON or _automaton()
    lower = text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")
    found = list(_hex_runs(text))
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _AUTOMATON.iter(lower))
    ends = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start >= ends[kind] and (m := _accepted(kind, text, start)):
            ends[kind] = m[0]
            if m[1]:
                found.append((kind, start, m[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each maximal stretch of overlapping spans replaced by ``MARK``."""
    if not spans:
        return text
    out, at, stop = [], 0, -1
    for _, start, end in spans:
        if start >= stop:
            out += [text[at:start] if stop < 0 else text[stop:start], MARK]
            at = stop = end
        stop = max(stop, end)
    return "".join([*out, text[stop:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    """Column of spans of a text column."""
    return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in texts])


@F.pandas_udf(T.StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """The text column without its secrets; null stays null."""
    return pd.Series([redact(t, find_secrets(t)) for t in texts], dtype=object)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str, spans: str = "spans") -> Column:
    """How many spans of a column are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row."""
    return docs.select("doc_id", secret_spans(F.col("text")).alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and ``n_chars`` counted anew."""
    return docs.withColumn("text", redacted(F.col("text"))).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
