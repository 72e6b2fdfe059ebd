"""Text scalars: normalization, tokens, identifiers, sentence parts, stable ids."""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic letters and the base form they are normalized to; marks that are stripped.
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک", "ۀ": "ه", "ة": "ه", "ؤ": "و", "إ": "ا", "أ": "ا"}
MARKS = ((0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED))
# Words that are no keywords.
STOPWORDS = (
    "the a an and or of to in on for with is are this that from by be as at it its "
    "و در به از که را با برای این آن یک است هست می شود شد"
).split()
TERM = r"[\p{L}\p{N}_\-]+"
TOKEN = r"[\p{L}\p{N}_\-]+|[^\p{L}\p{N}_\s]"
IDENTIFIER = r"(?i)(?:https?://\S+|\b[A-Z]{2,}[\-_]?\d{2,}\b|\b[\p{L}\p{N}_]+[\-_]\d{3,}\b)"
SENTENCE_END = r"(?<=[.!?؟])\s+|\n+(?=\S)"


@functools.cache
def _table(form: str, letters: bool, digits: bool, marks: bool) -> dict[int, str]:
    """Characters whose normal form is another one; each is normalized by itself, none is composed with its neighbour."""
    out: dict[int, str] = {}
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x32400)):
        ch = chr(cp)
        got = unicodedata.normalize(form, ch)
        if letters:
            got = "".join(LETTERS.get(x, x) for x in got)
        if digits:
            got = "".join(str(unicodedata.decimal(x)) if "٠" <= x <= "٩" or "۰" <= x <= "۹" else x for x in got)
        if marks:
            got = "".join(x for x in got if not any(a <= ord(x) <= b for a, b in MARKS))
        if got != ch:
            out[cp] = got
    return out


def normal_form(text: str, *, form: str = "NFKC", letters: bool = True, digits: bool = True, marks: bool = True, newlines: bool = True, paragraphs: bool = False) -> str:
    """Characters in normal form, inner white space as one space, lines trimmed, empty lines dropped.

    ``paragraphs`` keeps one blank line where there were any; without
    ``newlines`` line breaks are white space like any other.
    """
    if not text.isascii():
        text = text.translate(_table(form, letters, digits, marks))
    if not newlines:
        return " ".join(text.split())
    lines = [" ".join(line.split()) for line in text.split("\n")]
    if not paragraphs:
        return "\n".join(x for x in lines if x)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def normal_form_spans(text: str) -> tuple[str, list[int]]:
    """The normal form and, for each of its characters, the place in ``text`` it comes from."""
    table = _table("NFKC", True, True, True)
    out: list[str] = []
    at: list[int] = []
    space = None  # place of white space waiting for the next character
    for i, ch in enumerate(text):
        for c in table.get(ord(ch), ch):
            if c == "\n":
                space = None
                if out and out[-1] != "\n":
                    out.append(c)
                    at.append(i)
            elif c.isspace():
                space = i if space is None else space
            else:
                if space is not None and out and out[-1] != "\n":
                    out.append(" ")
                    at.append(space)
                space = None
                out.append(c)
                at.append(i)
    if out and out[-1] == "\n":
        out.pop()
        at.pop()
    return "".join(out), at


def _mapped(fn, kind: str = "string"):
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in texts.to_pylist()], pa.string())

    return run


def normalized(col: Column | str, **options) -> Column:
    """Normal form of a text column; null stays null."""
    return _mapped(functools.partial(normal_form, **options))(col)


def folded(col: Column | str, **options) -> Column:
    """Normal form without case, as used for search."""
    return _mapped(lambda t: normal_form(t, **options).casefold())(col)


def normalized_spans(col: Column | str) -> Column:
    """``struct<text, offsets>``: the normal form and the source place of each of its characters."""

    @F.arrow_udf("struct<text:string,offsets:array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else dict(zip(("text", "offsets"), normal_form_spans(t))) for t in texts.to_pylist()]
        return pa.array(rows, pa.struct([("text", pa.string()), ("offsets", pa.list_(pa.int32()))]))

    return run(col)


def original_span(offsets: Column, start: Column, end: Column) -> Column:
    """Span of the source text for ``[start, end)`` of its normal form; null where there is none."""
    n = F.size(offsets)
    last = F.least(F.greatest(end - 1, start), n - 1)
    span = F.struct(F.element_at(offsets, F.greatest(start, F.lit(0)) + 1).alias("start"), (F.element_at(offsets, last + 1) + 1).alias("end"))
    return F.when(start.isNotNull() & end.isNotNull() & (n > 0) & (start < n), span)


def terms(folded_text: Column) -> Column:
    """Search terms of a folded text."""
    return F.regexp_extract_all(folded_text, F.lit(f"({TERM})"), F.lit(1))


def token_list(normal_text: Column) -> Column:
    return F.regexp_extract_all(normal_text, F.lit(f"({TOKEN})"), F.lit(1))


def token_count(normal_text: Column) -> Column:
    """Tokens of a normalized text: words, and single signs."""
    return F.size(token_list(normal_text))


def identifiers(text: Column) -> Column:
    """URLs, codes such as ``ERR-42`` and names with numbers, in order."""
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), F.lit(1))


def sentence_parts(text: Column) -> Column:
    """Parts after final marks and at line breaks, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(F.trim(text), SENTENCE_END), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def digest(raw: str, size: int) -> str:
    return hashlib.blake2b(raw.encode(), digest_size=size).hexdigest()


def stable_chunk_id(source_id: str, version: str, kind: str, path: list[str], text: str, ordinal: int) -> str:
    """Id of a chunk: the same source, version, kind, place and text give the same id."""
    raw = "\x1f".join((source_id, version, kind, " > ".join(path), str(ordinal), normal_form(text).casefold()))
    return f"{source_id}:chunk:{digest(raw, 12)}"


def section_id(source_id: str, version: str, path: list[str]) -> str:
    return f"{source_id}:section:{digest(f'{source_id}::{version}::' + ' > '.join(path), 10)}"


def tokenizer_count(col: Column | str, encode) -> Column:
    """Tokens of an injected encoder (text to ids); null has none."""

    @F.arrow_udf("int")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([0 if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return run(col)


def tokenizer_split(col: Column | str, encode, decode, size: int) -> Column:
    """Pieces of ``size`` tokens of an injected encoder and decoder; null and empty texts have none."""
    if size < 1:
        raise ValueError("size must be positive")

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        ids = [encode(t) if t else [] for t in texts.to_pylist()]
        return pa.array([[decode(x[i : i + size]) for i in range(0, len(x), size)] for x in ids], pa.list_(pa.string()))

    return run(col)


def point_id(col: Column | str, space: str = "corpusloom:") -> Column:
    """A name-based UUID of an id, for stores that take only UUIDs; null stays null."""
    import uuid

    return _mapped(lambda t: str(uuid.uuid5(uuid.NAMESPACE_URL, space + t)))(col)
