"""The standard security handler: RC4, AES-128 and AES-256, user or owner password."""

from __future__ import annotations

import hashlib
import stringprep
import struct
import unicodedata

import numpy as np

from quire.sources.pdf.objects import Name, PdfError, Stream

#: Fixed value: the padding of short passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _boxes() -> tuple[list[int], list[int]]:
    """The substitution box from inverses in the field of 256 elements, and its inverse."""
    box = [0] * 256
    p = q = 1
    while True:
        p = _times(p, 3)
        q = _times(q, 0xF6)  # the inverse of 3
        x = q
        for shift in (1, 2, 3, 4):
            x ^= (q << shift | q >> (8 - shift)) & 255
        box[p] = x ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    return box, back


_BOX, _BACK = _boxes()
_BY = {n: [_times(x, n) for x in range(256)] for n in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    constant = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(_BOX[c] for c in w[1:] + w[:1])
            w = bytes([w[0] ^ constant]) + w[1:]
            constant = _times(constant, 2)
        elif n > 6 and i % n == 4:
            w = bytes(_BOX[c] for c in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w, strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


def _turned(word: int, by: int) -> int:
    return (word >> by | word << (32 - by)) & 0xFFFFFFFF


#: Substitution and mixing of one byte as a word, for each row.
_FIRST = [_BY[2][v] << 24 | v << 16 | v << 8 | _BY[3][v] for v in _BOX]
_MIX = [[_turned(w, 8 * row) for w in _FIRST] for row in range(4)]
_NP_BACK = np.array(_BACK, dtype=np.uint8)
_NP_BY = {n: np.array(v, dtype=np.uint8) for n, v in _BY.items()}
_UNSHIFTED = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])


def aes_cbc_decrypt(key: bytes, iv: bytes, data: bytes, padded: bool = True) -> bytes:
    """All blocks at once: none of them waits for another's plain text."""
    if len(data) % 16:
        raise PdfError("AES data are not whole blocks")
    keys = [np.frombuffer(k, np.uint8) for k in _round_keys(key)]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    s = blocks ^ keys[-1]
    for i in range(len(keys) - 2, -1, -1):
        s = _NP_BACK[s[:, _UNSHIFTED]] ^ keys[i]
        if i:
            c = s.reshape(-1, 4, 4)
            s = np.stack([_NP_BY[14][c[..., r]] ^ _NP_BY[11][c[..., (r + 1) % 4]] ^ _NP_BY[13][c[..., (r + 2) % 4]] ^ _NP_BY[9][c[..., (r + 3) % 4]] for r in range(4)], axis=-1).reshape(-1, 16)
    out = (s ^ np.concatenate([np.frombuffer(iv, np.uint8).reshape(1, 16), blocks[:-1]])[: len(blocks)]).tobytes()
    if not padded:
        return out
    n = out[-1] if out else 0
    if not 1 <= n <= 16 or out[-n:] != bytes([n]) * n:
        raise PdfError("wrong AES padding")
    return out[:-n]


def aes_cbc_encrypt(key: bytes, iv: bytes, data: bytes, padded: bool = True) -> bytes:
    if padded:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    keys = [struct.unpack(">4I", k) for k in _round_keys(key)]
    first, middle, last = keys[0], keys[1:-1], keys[-1]
    t0, t1, t2, t3 = _MIX
    box, out = _BOX, []
    w = struct.unpack(">4I", iv)
    words = struct.unpack(f">{len(data) // 4}I", data)
    for at in range(0, len(words), 4):
        a, b, c, d = (words[at + i] ^ w[i] ^ first[i] for i in range(4))
        for k in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        r = (a, b, c, d)
        w = tuple((box[r[i] >> 24] << 24 | box[r[(i + 1) % 4] >> 16 & 255] << 16 | box[r[(i + 2) % 4] >> 8 & 255] << 8 | box[r[(i + 3) % 4] & 255]) ^ last[i] for i in range(4))
        out += w
    return struct.pack(f">{len(out)}I", *out)


def prepare_password(password: str) -> bytes:
    """SASLprep of a Unicode password, at most 127 bytes."""
    mapped = "".join(" " if stringprep.in_table_c12(c) else c for c in password if not stringprep.in_table_b1(c))
    text = unicodedata.normalize("NFKC", mapped)
    banned = (stringprep.in_table_c12, stringprep.in_table_c21_c22, stringprep.in_table_c3, stringprep.in_table_c4, stringprep.in_table_c5, stringprep.in_table_c6, stringprep.in_table_c7, stringprep.in_table_c8, stringprep.in_table_c9)
    if any(test(c) for c in text for test in banned):
        raise PdfError("a character not allowed in passwords")
    rtl = [stringprep.in_table_d1(c) for c in text]
    if any(rtl) and (any(stringprep.in_table_d2(c) for c in text) or not (rtl[0] and rtl[-1])):
        raise PdfError("mixed directions in a password")
    return text.encode("utf-8")[:127]


def hash_r6(password: bytes, salt: bytes, extra: bytes, revision: int) -> bytes:
    """The hardened hash of revision 6; revision 5 stops after the first digest."""
    k = hashlib.sha256(password + salt + extra).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        e = aes_cbc_encrypt(k[:16], k[16:32], (password + k + extra) * 64, padded=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    """The file key and methods of an encrypted document."""

    def __init__(self, encrypt: dict, file_id: bytes, password: str = ""):
        self.v, self.r = int(encrypt.get("V", 0)), int(encrypt.get("R", 0))
        if encrypt.get("Filter") != "Standard" or self.v not in (1, 2, 4, 5):
            raise PdfError("an unsupported security handler")
        self.permissions = int(encrypt.get("P", 0))
        self.metadata = encrypt.get("EncryptMetadata", True) is not False
        self.length = 5 if self.v == 1 else int(encrypt.get("Length", 40)) // 8 if self.v == 2 else 16
        self.methods = {"stream": "RC4", "string": "RC4"}
        if self.v >= 4:
            filters = encrypt.get("CF") or {}
            for kind, key in (("stream", "StmF"), ("string", "StrF")):
                name = encrypt.get(key, Name("Identity"))
                cfm = (filters.get(str(name)) or {}).get("CFM", Name("None")) if name != "Identity" else Name("None")
                self.methods[kind] = {"V2": "RC4", "AESV2": "AES", "AESV3": "AES", "None": "Identity"}.get(str(cfm), "Identity")
        self.owner = False
        self.key = self._key256(encrypt, password) if self.v == 5 else self._key(encrypt, file_id, password)

    def _key256(self, encrypt: dict, password: str) -> bytes:
        u, o, word = encrypt["U"][:48], encrypt["O"][:48], prepare_password(password)
        for own, data, extra, sealed in ((True, o, u, encrypt["OE"]), (False, u, b"", encrypt["UE"])):
            if hash_r6(word, data[32:40], extra, self.r) == data[:32]:
                self.owner = own
                return aes_cbc_decrypt(hash_r6(word, data[40:48], extra, self.r), bytes(16), sealed[:32], padded=False)
        raise PdfError("wrong password")

    def _key(self, encrypt: dict, file_id: bytes, password: str) -> bytes:
        word = password.encode("latin-1", "replace")
        for own, candidate in ((True, self._user_password(encrypt, word)), (False, word)):
            key = self._user_key(encrypt, file_id, candidate)
            if self._check(encrypt, file_id, key):
                self.owner = own and candidate != word
                return key
        raise PdfError("wrong password")

    def _user_password(self, encrypt: dict, owner: bytes) -> bytes:
        digest = hashlib.md5((owner + PAD)[:32]).digest()
        for _ in range(50 if self.r >= 3 else 0):
            digest = hashlib.md5(digest[: self.length]).digest()
        key, out = digest[: self.length], encrypt["O"][:32]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            out = rc4(bytes(c ^ i for c in key), out)
        return out

    def _user_key(self, encrypt: dict, file_id: bytes, password: bytes) -> bytes:
        seed = (password + PAD)[:32] + encrypt["O"][:32] + (self.permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id
        if self.r >= 4 and not self.metadata:
            seed += b"\xff\xff\xff\xff"
        digest = hashlib.md5(seed).digest()
        for _ in range(50 if self.r >= 3 else 0):
            digest = hashlib.md5(digest[: self.length]).digest()
        return digest[: self.length]

    def _check(self, encrypt: dict, file_id: bytes, key: bytes) -> bool:
        if self.r < 3:
            return rc4(key, PAD) == encrypt["U"][:32]
        out = hashlib.md5(PAD + file_id).digest()
        for i in range(20):
            out = rc4(bytes(c ^ i for c in key), out)
        return out == encrypt["U"][:16]

    def data(self, raw: bytes, num: int, gen: int, kind: str) -> bytes:
        method = self.methods[kind]
        if method == "Identity":
            return raw
        key = self.key
        if self.v < 5:
            seed = key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if method == "AES" else b"")
            key = hashlib.md5(seed).digest()[: min(len(key) + 5, 16)]
        if method == "RC4":
            return rc4(key, raw)
        if len(raw) < 16:
            raise PdfError("AES data without a start block")
        return aes_cbc_decrypt(key, raw[:16], raw[16:])

    def value(self, v: object, num: int, gen: int) -> object:
        """A value with its strings, and a stream's data, decrypted."""
        if isinstance(v, bytes):
            return self.data(v, num, gen, "string")
        if isinstance(v, list):
            return [self.value(x, num, gen) for x in v]
        if isinstance(v, dict):
            signed = v.get("Type") == "Sig" or "ByteRange" in v
            return {k: x if signed and k == "Contents" else self.value(x, num, gen) for k, x in v.items()}
        if isinstance(v, Stream):
            own = self.value(v.dict, num, gen)
            plain = v.dict.get("Type") == "XRef" or "F" in v.dict or (v.dict.get("Type") == "Metadata" and not self.metadata)
            filters = v.dict.get("Filter")
            crypt = filters == "Crypt" or (isinstance(filters, list) and filters[:1] == ["Crypt"])
            return Stream(own, v.raw if plain or crypt else self.data(v.raw, num, gen, "stream"), num, gen)
        return v
