"""Keys and ciphers of encrypted documents. MD5, SHA and AES are column functions; RC4 has none and is a small helper."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: What passwords are filled up with.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _md5(data: Column) -> Column:
    return F.unhex(F.md5(data))


def padded_password(password: Column) -> Column:
    return F.substring(F.concat(password, F.lit(PADDING)), 1, 32)


def little_endian(n: Column, size: int) -> Column:
    big = F.lpad(F.right(F.hex(n.cast("long")), F.lit(2 * size)), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(big, 2 * i + 1, 2) for i in reversed(range(size))]))


def file_key(password: Column, owner: Column, permissions: Column, file_id: Column, revision: int, length: int = 5, encrypt_metadata: bool = True) -> Column:
    """Revisions 2 to 4: MD5 of the padded password, O, P and ID; fifty more rounds from revision 3 on."""
    seed = F.concat(padded_password(password), owner, little_endian(permissions, 4), file_id)
    if revision >= 4 and not encrypt_metadata:
        seed = F.concat(seed, F.lit(b"\xff\xff\xff\xff"))
    key = _md5(seed)
    if revision >= 3:
        key = F.aggregate(F.sequence(F.lit(1), F.lit(50)), key, lambda acc, _: _md5(F.substring(acc, 1, length)))
    return F.substring(key, 1, length if revision >= 3 else 5)


def object_key(key: Column, number: Column, generation: Column, aes: bool) -> Column:
    data = F.concat(key, little_endian(number, 3), little_endian(generation, 2), F.lit(b"sAlT" if aes else b""))
    return F.substring(_md5(data), F.lit(1), F.least(F.octet_length(key) + 5, F.lit(16)))


def decrypt_aes(data: Column, key: Column) -> Column:
    """CBC with the vector in front and padding behind; null where that is broken."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def encrypt_aes(data: Column, key: Column, vector: Column) -> Column:
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), vector)


def _rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[s[i] + s[j] & 255])
    return bytes(out)


#: Rows whose ciphers run side by side, from how many on they do, and bytes that these may have.
ROWS, FEW, ROWS_BYTES = 1024, 64, 16_000_000


def _rc4_block(keys: list[bytes], datas: list[bytes]) -> list[bytes]:
    """RC4 of several rows side by side: each step is one for all of them."""
    n, long = len(keys), max(map(len, datas))
    # A key that comes round to its beginning is as long as the states are.
    filled = {k: (k * (256 // len(k) + 1))[:256] for k in set(keys)}
    turn = np.frombuffer(b"".join(filled[k] for k in keys), np.uint8).reshape(n, 256).T.copy()
    s, base, j = np.tile(np.arange(256, dtype=np.uint8), n), np.arange(n) * 256, np.zeros(n, np.uint8)
    for i in range(256):
        here = s[base + i]
        j = j + here + turn[i]
        s[base + i] = s[base + j]
        s[base + j] = here
    out, j = np.zeros((n, long), np.uint8), np.zeros(n, np.uint8)
    for t in range(long):
        at = base + (t + 1 & 255)
        here = s[at]
        j = j + here
        there = s[base + j]
        s[at] = there
        s[base + j] = here
        out[:, t] = s[base + (here + there)]
    out ^= np.frombuffer(b"".join(d.ljust(long, b"\0") for d in datas), np.uint8).reshape(n, long)
    return [row[: len(d)].tobytes() for row, d in zip(out, datas)]


def rc4_rows(keys: list, datas: list) -> list:
    """RC4 of each key and data; null where the key is null or empty, or the data null. Rows of like lengths run side by side."""
    out: list = [None] * len(keys)
    left = sorted((i for i, (k, d) in enumerate(zip(keys, datas)) if k and d is not None), key=lambda i: len(datas[i]))
    while left:
        most = 2 * len(datas[left[0]]) + 64
        n = 0
        while n < min(len(left), ROWS) and len(datas[left[n]]) <= most and (n + 1) * len(datas[left[n]]) <= ROWS_BYTES:
            n += 1
        block, left = left[: max(n, 1)], left[max(n, 1) :]
        if len(block) < FEW:
            made = [_rc4(keys[i], datas[i]) for i in block]
        else:
            made = _rc4_block([keys[i] for i in block], [datas[i] for i in block])
        for i, d in zip(block, made):
            out[i] = d
    return out


@pandas_udf(BinaryType())
def rc4(key: pd.Series, data: pd.Series) -> pd.Series:
    """The same both ways; null or empty keys give null."""
    return pd.Series(rc4_rows(list(key), list(data)))


@pandas_udf(ArrayType(StringType()))
def rc4_each(key: pd.Series, digits: pd.Series) -> pd.Series:
    """Each of an array's byte strings, written as hexadecimal digits, under one key."""
    held = [[bytes.fromhex(h) for h in each] if k and each is not None else [] for k, each in zip(key, digits)]
    made = iter(rc4_rows([k for k, each in zip(key, held) for _ in each], [d for each in held for d in each]))
    return pd.Series([[next(made).hex() for _ in own] if k and each is not None else None for k, each, own in zip(key, digits, held)])


@pandas_udf(BinaryType())
def user_entry_r3(key: pd.Series, file_id: pd.Series) -> pd.Series:
    """The first 16 bytes that U must have from revision 3 on: the padding's digest through twenty rounds of changed keys."""

    data = [hashlib.md5(PADDING + (i or b"")).digest() for i in file_id]
    for turn in range(20):
        data = rc4_rows([k and bytes(c ^ turn for c in k) for k in key], data)
    return pd.Series(data)


@pandas_udf(BinaryType())
def user_password(password: pd.Series, owner: pd.Series, revision: pd.Series, length: pd.Series) -> pd.Series:
    """The padded user password that an owner entry holds, if this is the owner's password; revisions 2 to 4."""

    def made(p, o, r, n):
        if o is None or r not in (2, 3, 4):
            return None
        key = hashlib.md5((p + PADDING)[:32]).digest()
        for _ in range(50 if r > 2 else 0):
            key = hashlib.md5(key).digest()
        return key[: int(n) if r > 2 else 5]

    keys, data = [made(*x) for x in zip(password, owner, revision, length)], list(owner)
    for turn in range(19, -1, -1):
        # Revision 2 has the last round alone.
        rounds = [k and bytes(c ^ turn for c in k) if r > 2 or turn == 0 else None for k, r in zip(keys, revision)]
        data = [d if k and not now else new for k, now, d, new in zip(keys, rounds, data, rc4_rows(rounds, data))]
    return pd.Series(data)


def user_entry_r2(key: Column) -> Column:
    """What U must be for a revision 2 file whose password gives this key."""
    return rc4(key, F.lit(PADDING))


def decrypt(data: Column, identity: Column, method: Column, key: Column) -> Column:
    """Identity streams stay; AESV2 and AESV3 are CBC, V2 is RC4."""
    aes = method.isin("AESV2", "AESV3")
    # Each row is sent to the function; one without a key costs nothing there.
    other = F.when(~F.coalesce(identity | aes, F.lit(False)), key)
    return F.when(identity, data).when(aes, decrypt_aes(data, key)).otherwise(rc4(other, data))


def signed_bytes(content: Column, byte_range: Column) -> Column:
    """The two parts of a file that a signature covers; null where the range is negative, overlaps or leaves the file."""
    a, b, c, d = (F.get(byte_range, i) for i in range(4))
    good = (F.least(a, b, c, d) >= 0) & (a + b <= c) & (c + d <= F.octet_length(content))
    part = lambda at, n: F.substring(content, at.cast("int") + 1, n.cast("int"))
    return F.when(good, F.concat(part(a, b), part(c, d)))


def digest_matches(content: Column, byte_range: Column, digest: Column, bits: int = 256) -> Column:
    return F.unhex(F.sha2(signed_bytes(content, byte_range), bits)) == digest
