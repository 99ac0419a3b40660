"""Blind indexes and authenticated encryption of columns."""

from __future__ import annotations

import base64
import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import base64url, unbase64url

IV_BYTES, TAG_BYTES = 12, 16


def blind_index(key: bytes):
    """A pandas function: HMAC-SHA-256 of the composed, trimmed, lower-cased text, as base64url."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        text = unicodedata.normalize("NFC", x).strip().lower()
        return base64.urlsafe_b64encode(hmac.new(key, text.encode(), hashlib.sha256).digest()).decode().rstrip("=")

    @F.pandas_udf("string")
    def index(values: pd.Series) -> pd.Series:
        return values.map(one)

    return index


def same_digest(a: str, b: str) -> bool:
    """Comparison in constant time."""
    return hmac.compare_digest(a.encode(), b.encode())


def encrypt(x: Column, keys: dict[int, bytes], version: int) -> Column:
    """AES-256-GCM as version.iv.text.tag, each part base64url; null stays null."""
    sealed = F.aes_encrypt(F.encode(x, "UTF-8"), F.lit(keys[version]), F.lit("GCM"))

    def parts(whole: Column) -> Column:
        n = F.octet_length(whole)
        part = lambda frm, length: base64url(F.substring(whole, frm, length))
        body = part(F.lit(IV_BYTES + 1), n - IV_BYTES - TAG_BYTES)
        return F.concat_ws(".", F.lit(str(version)), part(F.lit(1), F.lit(IV_BYTES)), body, part(n - TAG_BYTES + 1, F.lit(TAG_BYTES)))

    # the lambda's variable is computed once: another call would draw another initial vector
    return F.when(x.isNotNull(), F.transform(F.array(sealed), parts)[0])


def decrypt(x: Column, keys: dict[int, bytes]) -> Column:
    """The text of an encrypted value; a value without four parts or of an unknown key is an error."""

    def opened(value: Column) -> Column:
        parts = F.split(value, r"\.")
        joined = F.concat(unbase64url(parts[1]), unbase64url(parts[2]), unbase64url(parts[3]))
        out = F.raise_error(F.lit("malformed or unknown ciphertext")).cast("string")
        for version, key in keys.items():
            plain = F.decode(F.aes_decrypt(joined, F.lit(key), F.lit("GCM")), "UTF-8")
            out = F.when((F.size(parts) == 4) & (parts[0] == str(version)), plain).otherwise(out)
        return out

    return F.when(x.isNotNull(), F.transform(F.array(x), opened)[0])  # the value is computed once, whatever it is made of
