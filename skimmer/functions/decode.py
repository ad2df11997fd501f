"""HTML entities: no built-in decodes them, so an Arrow batch at a time."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_entity(body: str, strict_hex: bool = False) -> str:
    """The character of "&body;", or nothing for an unknown one. strict_hex: only decimal digits after x, an old quirk."""
    import re
    from html.entities import name2codepoint

    try:
        if m := re.fullmatch(r"#[xX]([0-9]+)" if strict_hex else r"#[xX]([0-9A-Fa-f]+)", body):
            return chr(int(m[1], 16))
        if m := re.fullmatch(r"#([0-9]+)", body):
            return chr(int(m[1]))
    except (ValueError, OverflowError):
        return ""
    return chr(name2codepoint[body]) if body in name2codepoint else ""


def html_entities(text: Column, strict_hex: bool = False) -> Column:
    import re

    import pandas as pd

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else re.sub(r"&(#?[A-Za-z0-9]+);", lambda m: decode_entity(m[1], strict_hex), x))

    return run(text)
