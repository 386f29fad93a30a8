"""Receiver and body text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

# (?U): blanks as Unicode defines them; 1c-1f are blanks too for the source
# system. (?d): only \n ends a line, so $ does not accept \r or U+2028.
EMAIL_PATTERN = r"(?Ud)^[^@\s\x1c-\x1f]+@[^@\s\x1c-\x1f]+\.[^@\s\x1c-\x1f]+$"

# A syllable outside the basic set takes 8 bytes in this codec.
MAX_BYTES_PER_CHAR = 8


@pandas_udf(IntegerType())
def _encoded_length(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    sizes = [len(t.encode("euc-kr", errors="ignore")) for t in distinct]
    return pd.Series([sizes[c] if c >= 0 else None for c in codes], dtype="Int32")


def euckr_length(text: Column, only_above: int = 0) -> Column:
    """Bytes of `text` in EUC-KR; characters outside the charset count 0.

    ASCII text is measured in the JVM. Only other rows carry their text to
    Python (the rest send null), and with `only_above` also rows too short to
    exceed that many bytes stay behind and report null.
    """
    ascii_only = text.rlike(r"^\p{ASCII}*\z")
    short = F.length(text) * MAX_BYTES_PER_CHAR <= only_above
    measured = _encoded_length(F.when(~ascii_only & ~short, text))
    return F.when(ascii_only, F.length(text)).otherwise(measured)


def clean_phone(receiver: Column) -> Column:
    return F.translate(F.coalesce(receiver, F.lit("")), "- ", "")


def is_mobile(receiver: Column) -> Column:
    cleaned = clean_phone(receiver)
    return cleaned.startswith("01") & F.length(cleaned).between(10, 11)


def is_email(receiver: Column) -> Column:
    return F.coalesce(receiver, F.lit("")).rlike(EMAIL_PATTERN)


def address_key(receiver: Column) -> Column:
    """Form used to compare receivers: no blanks or dashes, mail in lower case.

    Null for an empty address, which equals no other.
    """
    key = F.when(receiver.contains("@"), F.lower(F.trim(receiver))).otherwise(clean_phone(receiver))
    return F.nullif(key, F.lit(""))


def number_range(channel: Column, receiver: Column, digits: int = 7) -> Column:
    """Mail domain, or the leading `digits` of a phone number without its dashes.

    Seven digits are a mobile prefix with its exchange; all mobile numbers share
    the first three.
    """
    domain = F.when(receiver.contains("@"), F.substring_index(receiver, "@", -1)).otherwise("")
    return F.when(channel == "EMAIL", domain).otherwise(F.substring(clean_phone(receiver), 1, digits))
