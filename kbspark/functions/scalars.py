"""Row-level helpers (C1-C18, S7, S8, A13): built-in expressions only, except the token counter."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kbspark.functions.predicates import _col

# Accepted upload formats.
SUPPORTED_FORMATS = ("pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "csv", "md")
# Extension to document class.
FILE_TYPES = {"txt": "TEXT", "csv": "TEXT", "md": "MARKDOWN", "pdf": "PDF", "doc": "WORD", "docx": "WORD",
              "xls": "EXCEL", "xlsx": "EXCEL", "ppt": "POWERPOINT", "pptx": "POWERPOINT"}
PAGE_MARKER = r"\[\[PAGE:(\d+)\]\]"


def file_extension(c: str | Column) -> Column:
    """Text after the last dot, '' when there is none."""
    return F.coalesce(F.regexp_extract(_col(c), r"(?s)\.([^.]+)\z", 1), F.lit(""))


def file_type(c: str | Column) -> Column:
    ext = F.lower(file_extension(c))
    out = F.lit("UNKNOWN")
    for kind in dict.fromkeys(FILE_TYPES.values()):
        out = F.when(ext.isin(*[e for e, k in FILE_TYPES.items() if k == kind]), kind).otherwise(out)
    return out


def type_letter(c: str | Column) -> Column:
    """Upper-cased first letter of the extension, 'F' when there is none."""
    return F.coalesce(F.nullif(F.upper(F.substring(F.trim(file_extension(c)), 1, 1)), F.lit("")), F.lit("F"))


def key_hash(c: str | Column) -> Column:
    return F.sha2(_col(c), 256)


def key_prefix(c: str | Column) -> Column:
    return F.concat(F.substring(_col(c), 1, 11), F.lit("..."))


def ellipsis(c: str | Column, n: int = 50) -> Column:
    """First n characters and '...' when longer; '' for null."""
    t = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def clean_title(c: str | Column, n: int = 30) -> Column:
    """Trim, drop quote characters, collapse white space, cut."""
    t = F.regexp_replace(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), "[\"'`]", "")
    return F.substring(F.regexp_replace(t, r"\s+", " "), 1, n)


def question_title(question: str | Column, session_id: str | Column, n: int = 50) -> Column:
    return F.coalesce(F.nullif(F.substring(_col(question), 1, n), F.lit("")), _col(session_id))


def null_to_zero(c: str | Column) -> Column:
    return F.coalesce(_col(c), F.lit(0))


def format_time(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def parse_iso_time(c: str | Column) -> Column:
    """ISO local date-time, null when malformed or date-only."""
    t = _col(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), t.try_cast("timestamp"))


def month_bounds(c: str | Column) -> tuple[Column, Column, Column]:
    """First day of the month, first day of the next month, 'yyyy-MM' label."""
    first = F.trunc(_col(c), "MM")
    return first, F.add_months(first, 1), F.date_format(first, "yyyy-MM")


def title_prefix(hierarchy: str | Column) -> Column:
    """'[a > b]' and a blank line from the non-blank titles, '' when there are none."""
    path = F.array_join(F.filter(_col(hierarchy), lambda h: F.trim(h) != ""), " > ")
    return F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(F.lit("["), path, F.lit("]\n\n")))


def numeric_id(c: str | Column) -> Column:
    """Absolute 32-bit hash of a UUID text, the XOR of its four words; null when it is no UUID."""
    c = _col(c)
    digits = F.replace(c, F.lit("-"), F.lit(""))
    words = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    x = words[0].bitwiseXOR(words[1]).bitwiseXOR(words[2]).bitwiseXOR(words[3])
    signed = F.when(x >= 2 ** 31, x - 2 ** 32).otherwise(x)
    value = F.when(signed == -2 ** 31, signed).otherwise(F.abs(signed))
    return F.when(c.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), value)


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(_col(path), r"[/\\]"), -1)


def comma_list(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(_col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def row_markdown(cols: Sequence[str | Column]) -> Column:
    """One pipe-delimited table row; null cells are empty."""
    cells = [F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def page_range(c: str | Column) -> Column:
    """'a-b' or 'a' from the first and last page marker, '1' without any."""
    pages = F.transform(F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(PAGE_MARKER), F.lit(1)),
                        lambda p: p.cast("int").cast("string"))
    first, last = F.get(pages, F.lit(0)), F.get(pages, F.size(pages) - 1)
    return (F.when(F.size(pages) == 0, "1").when(first == last, first)
            .otherwise(F.concat_ws("-", first, last)))


def strip_page_markers(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), PAGE_MARKER + r"\s*", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def file_name_from_url(url: str | Column) -> Column:
    """Last path segment, 'downloaded-file' when the path is empty."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(_col(url), F.lit("PATH")), F.lit("")), r"/+$", "")
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit("downloaded-file"))


# A word, one CJK character or one punctuation mark counts as a token.
TOKEN = r"[぀-ヿ㐀-䶿一-鿿가-힯]|[^\W぀-ヿ㐀-䶿一-鿿가-힯]+|[^\w\s]"
_TOKEN = re.compile(TOKEN)
# Without CJK characters the shorter pattern finds the same tokens faster.
_CJK = re.compile(TOKEN.split("|", 1)[0])
_PLAIN = re.compile(r"\w+|[^\w\s]")
# The same pattern for the JVM side.
TOKEN_SQL = (r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]"
             r"|[\p{L}\p{N}_&&[^\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}]]+"
             r"|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x{85}]")

TokenCounter = Callable[[str], int]


def regex_token_count(text: str | None) -> int:
    return len((_TOKEN if _CJK.search(text) else _PLAIN).findall(text)) if text else 0


TokenEnds = Callable[[str], list[int]]


def token_ends(text: str) -> list[int]:
    """End of each token that ``regex_token_count`` counts."""
    return [m.end() for m in (_TOKEN if _CJK.search(text) else _PLAIN).finditer(text)]


def token_count(c: str | Column) -> Column:
    """Default token counter as a built-in expression."""
    return F.regexp_count(F.coalesce(_col(c), F.lit("")), F.lit(TOKEN_SQL))


def token_counter_udf(counter: TokenCounter):
    """Any other counter, Arrow-batched."""
    @F.pandas_udf(IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: counter(t) if t else 0).astype("int32")

    return count
