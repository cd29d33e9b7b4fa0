"""Cutting texts into pieces along paragraphs and sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.text import ABBREVIATIONS

_BLANK = re.compile(r"\n\s*\n")
_END = re.compile(r"[。！？!?]+[”’」』\"')\]]*|\.+(?=\s|$)|\n")
_SHORT = frozenset(ABBREVIATIONS)


def sentences(text: str) -> list[str]:
    """Sentences of a paragraph; an abbreviation's or a number's full stop ends none."""
    out, start = [], 0
    for m in _END.finditer(text):
        piece = text[start : m.end()]
        if m.group().startswith("."):
            word = re.search(r"([A-Za-z]{1,5})\.$", piece)
            if (word and word.group(1).lower() in _SHORT) or re.search(r"\d\.$", piece):
                continue
        piece = piece.strip()
        if piece:
            if out and len(piece) <= 3 and not piece[0].isupper():
                out[-1] += piece
            else:
                out.append(piece)
        start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


def pieces(text: str | None, most: int = 500, least: int = 10) -> list[str]:
    """Paragraphs; long ones packed sentence by sentence up to ``most`` characters (a longer sentence alone). Pieces below ``least`` join the one before, or are left out if there is none."""
    found: list[str] = []
    for paragraph in _BLANK.split((text or "").replace("\r\n", "\n").replace("\r", "\n")):
        paragraph = paragraph.strip()
        if len(paragraph) <= most:
            found += [paragraph] if paragraph else []
            continue
        held = ""
        for s in sentences(paragraph):
            if held and len(held) + 1 + len(s) > most:
                found.append(held)
                held = s
            else:
                held = f"{held} {s}" if held else s
        if held:
            found.append(held)
    out: list[str] = []
    for piece in found:
        if len(piece) < least and out:
            out[-1] += "\n" + piece
        else:
            out.append(piece)
    return [x for x in out if len(x) >= least]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(pieces)


def split_text(c: Column) -> Column:
    """Pieces of a text column, as an array."""
    return _split(c)


def chunk_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, chunk) of all texts."""
    return rows.select(F.col(key).alias("key"), F.posexplode(split_text(F.col(text))).alias("place", "chunk"))
