"""Tokens of texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spindex.schema import WORD_LENGTH

# Accented letters and the letters they fold to, one to one.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿß"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyys"
TOKEN = "[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased, accent-folded runs of letters and digits, of valid length.

    Null text has no tokens.
    """
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, FOLDED)
    return F.filter(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), lambda t: F.length(t) < WORD_LENGTH)


def tokenize(text: str) -> list[str]:
    """The same for a query's text, on the driver."""
    import re

    folded = text.lower().translate(str.maketrans(ACCENTED, FOLDED))
    return [t for t in re.findall(TOKEN, folded) if len(t) < WORD_LENGTH]
