"""Text of PDF files: their streams, inflated where they are deflated, and the text operators inside."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmeter.sources.session import prepare

#: A stream that inflates beyond so many bytes is taken for broken.
MOST_BYTES = 256 << 20
_BEGIN = re.compile(rb"\bstream\r?\n")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?!\s+\d+\s+R)\b")
#: Comments, names, hexadecimal strings, brackets, and words (numbers, operators); literal strings nest, so they are read by hand.
_TOKEN = re.compile(rb"%[^\r\n]*|/[^\s()<>\[\]{}/%]*|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]{}(]|[^\s()<>\[\]{}/%]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])")
_PAREN = re.compile(rb"\\[\s\S]|[()]")


def streams(data: bytes) -> Iterator[bytes]:
    """The contents of stream objects: as they are without a filter, inflated with one; others, and broken ones, are skipped."""
    at = 0
    while found := _BEGIN.search(data, at):
        begin = found.end()
        head = data[max(data.rfind(b"obj", 0, found.start()), at) : found.start()]
        told = _LENGTH.search(head)
        end = begin + int(told[1]) if told else -1
        # The told length holds if the stream ends there; else it ends where the next endstream is.
        if not 0 <= end <= len(data) or not data[end : end + 12].lstrip(b"\r\n").startswith(b"endstream"):
            end = data.find(b"endstream", begin)
            if end < 0:
                return
        at, held = end, data[begin:end]
        if b"/Filter" not in head:
            yield held
            if held[:1] != b"\x78":
                continue
        for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
            try:
                inflater = zlib.decompressobj(bits)
                out = inflater.decompress(held, MOST_BYTES)
            except zlib.error:
                continue
            if not inflater.unconsumed_tail:
                yield out
            break


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose first parenthesis is just before `at`, and where it ends."""
    depth, i = 1, at
    while depth and (m := _PAREN.search(data, i)):
        i = m.end()
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
    body = data[at : i - 1] if not depth else data[at:]
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else b"" if m[1] in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(m[1], m[1])
    return _ESCAPE.sub(octal, body), i if not depth else len(data)


def _text(raw: bytes) -> str:
    return raw[2:].decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def shown(content: bytes) -> list[str]:
    """The strings that the text operators Tj, TJ, ' and " of a content stream show, in order; an array gives each of its strings."""
    out, operands, at = [], [], 0
    while m := _TOKEN.search(content, at):
        token, at = m[0], m.end()
        if token == b"(":
            held, at = _literal(content, at)
            operands.append(held)
        elif token[:1] == b"<" and token != b"<<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            operands.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif token in (b"TJ", b"Tj", b"'", b'"'):
            out += [_text(x) for x in (operands if token == b"TJ" else operands[-1:])]
            operands = []
        elif token == b"ID":
            # An inline image: bytes up to its end.
            end = re.compile(rb"\sEI\b").search(content, at)
            at, operands = end.end() if end else len(content), []
        elif token[:1].isalpha() and token not in (b"true", b"false", b"null"):
            operands = []
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pieces(content: pd.Series) -> pd.Series:
    return content.map(lambda data: None if data is None else [x for s in streams(bytes(data)) for x in shown(s)])


def pieces(content: Column) -> Column:
    """The shown strings of a PDF file's bytes, in the order of its streams; null for null, empty for what is no PDF."""
    return _pieces(content)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            told = [x for s in streams(content.as_py() or b"") for x in shown(s)]
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * len(told), pa.string()), pa.array(range(len(told)), pa.int32()), pa.array(told, pa.string())], names=["path", "place", "text"])


def pdf_pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, place, text of each string that the PDF files under a path show. A file is read whole; nothing of it is collected."""
    files = prepare(spark).read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(_files, "path string, place int, text string")


def pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: the strings of each file joined by blanks; a file that shows none has an empty text."""
    files = prepare(spark).read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.array_join(pieces(F.col("content")), " ").alias("text"))
