"""String functions: built-ins where Spark has them, higher-order expressions or Arrow functions otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType


def concat(*parts: Column) -> Column:
    """Nulls count as empty."""
    return F.concat_ws("", *parts)


def left(s: Column, n: int) -> Column:
    """The first ``n`` characters; a negative number leaves out that many at the end."""
    return F.substring(s, 1, n) if n >= 0 else F.substr(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    if n >= 0:
        return F.when(F.length(s) <= n, s).otherwise(F.substr(s, F.length(s) - n + 1))
    return F.substr(s, F.lit(1 - n))


def array_slice(s: Column, begin: int, end: int) -> Column:
    """``s[begin:end]``, both inclusive and from 1."""
    return F.substring(s, begin, max(0, end - begin + 1))


def split_literal(s: Column, separator: str) -> Column:
    import re

    return F.split(s, re.escape(separator), -1)


def java_replacement(new: str) -> str:
    """A replacement with ``\\1`` groups, and plain dollars, as Java writes it."""
    import re

    return re.sub(r"\\(\d)|([$])", lambda m: f"${m[1]}" if m[1] else "\\$", new)


def regexp_replace(s: Column, pattern: str, new: str) -> Column:
    """All matches (option g); groups in ``new`` are ``\\1`` and so on."""
    return F.regexp_replace(s, pattern, java_replacement(new))


def regexp_replace_first(s: Column, pattern: str, new: str) -> Column:
    """Only the first match, the default of the dialect; groups in ``new`` are ``\\1`` and so on.

    The part before the match is found on its own, so that the pattern's groups keep their numbers.
    """
    match = F.regexp_substr(s, F.lit(pattern))
    at = F.regexp_instr(s, F.lit(pattern))
    # Only the text from the match on is rewritten: the pattern is tied to its start.
    rest = F.substr(s, at)
    done = F.regexp_replace(rest, f"\\A(?:{pattern})", java_replacement(new))
    return F.when(match.isNull() | (at == 0), s).otherwise(F.concat(F.substr(s, F.lit(1), at - 1), done))


def regexp_full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"\\A(?:{pattern})\\z")


def regexp_escape(text: str) -> str:
    """A pattern that matches ``text`` itself."""
    import re

    return re.escape(text)


def regexp_split_to_table(df: DataFrame, column: str, pattern: str, name: str = "part") -> DataFrame:
    """A row for each piece."""
    return df.withColumn(name, F.explode(F.split(F.col(column), pattern, -1)))


def glob(s: Column, pattern: str) -> Column:
    """GLOB: * any run, ? one character, [..] a class, [!..] its complement."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if end > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, re.escape(c))
        i += 1
    return s.rlike(f"\\A{out}\\z")


def hamming(a: Column, b: Column) -> Column:
    """Differing characters of two strings of one length; other lengths are an error, null is null."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    found = F.aggregate(pairs, F.lit(0), lambda t, x: t + x).cast("long")
    wrong = F.raise_error(F.lit("strings must be of equal length")).cast("long")
    return F.when(F.length(a) == F.length(b), found).when(F.length(a) != F.length(b), wrong)


def unicode(s: Column) -> Column:
    """The first character's code point; -1 of an empty text."""
    four = F.encode(F.substring(s, 1, 1), "UTF-32")
    return F.when(F.length(s) == 0, F.lit(-1)).otherwise(F.conv(F.hex(four), 16, 10).cast("int"))


def chr(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def to_base(n: Column, radix: int, least: int = 0) -> Column:
    """Digits 0-9, A-Z, padded with zeros to ``least``."""
    out = F.conv(n, 10, radix)
    return F.when(F.length(out) < least, F.lpad(out, least, "0")).otherwise(out) if least else out


def md5_lower(s: Column) -> Column:
    """``md5_number_lower``: the second eight bytes, as an unsigned number of low bytes first."""
    return _eight(F.substring(F.md5(s), 17, 16))


def md5_upper(s: Column) -> Column:
    """``md5_number_upper``: the first eight bytes, likewise."""
    return _eight(F.substring(F.md5(s), 1, 16))


def _eight(digits: Column) -> Column:
    turned = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(8))))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def bar(x: Column, low: float, high: float, width: int = 80) -> Column:
    """A bar of block characters in eighths, padded with blanks to ``width``."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    eighths = F.floor(share * width * 8).cast("int")
    parts = F.array(*(F.lit(c) for c in ("", "▏", "▎", "▍", "▌", "▋", "▊", "▉")))
    full = F.call_function("repeat", F.lit("█"), F.floor(eighths / 8).cast("int"))
    return F.rpad(F.concat(full, F.get(parts, (eighths % 8).cast("int"))), width, " ")


def format_braces(template: str, *values: Column) -> Column:
    """``format``: {} in order, {:05d}-like widths, {{ and }} for braces."""
    import re

    parts, at = [], iter(values)
    for piece in re.split(r"(\{\{|\}\}|\{[^{}]*\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif piece.startswith("{"):
            spec = piece[1:-1].partition(":")[2]
            parts.append(F.format_string(f"%{spec}" if spec else "%s", next(at)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def parse_path(path: Column) -> Column:
    """The parts between separators; a leading separator is a part of its own."""
    parts = F.filter(F.split(path, r"[/\\]", -1), lambda x: x != "")
    return F.when(path.rlike(r"\A[/\\]"), F.concat(F.array(F.substring(path, 1, 1)), parts)).otherwise(parts)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def format_bytes(n: Column) -> Column:
    """Sizes in decimal units with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        size = F.floor(n / (1000**power) * 10) / 10
        out = F.when(n >= 1000**power, F.concat(F.format_string("%.1f", size), F.lit(f" {unit}"))).otherwise(out)
    return out


def parse_filename(path: Column, trim: bool = False) -> Column:
    name = F.element_at(F.split(path, r"[/\\]", -1), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "") if trim else name


def parse_dirname(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]", -1), 1)


def parse_dirpath(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


@F.pandas_udf(StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    import unicodedata

    def one(t: str | None) -> str | None:
        return t and "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def nfc_normalize(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(LongType())
def length_grapheme(s: pd.Series) -> pd.Series:
    """User-perceived characters."""
    import regex

    return s.map(lambda t: len(regex.findall(r"\X", t)), na_action="ignore").astype("Int64")


def substring_grapheme(begin: int, length: int):
    """``substring`` in user-perceived characters, from 1; as a function of the column."""

    @F.pandas_udf(StringType())
    def cut(s: pd.Series) -> pd.Series:
        import regex

        return s.map(lambda t: "".join(regex.findall(r"\X", t)[begin - 1 : begin - 1 + length]), na_action="ignore")

    return cut


def _jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, u in zip(b, used, strict=True) if u]
    swapped = sum(x != y for x, y in zip(first, second, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        j, prefix = _jaro(x, y), 0
        for p, q in zip(x[:4], y[:4], strict=False):
            if p != q:
                break
            prefix += 1
        return j + prefix * 0.1 * (1 - j) if j > 0.7 else j

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(LongType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits with swaps of neighbours, where swapped characters may be edited again."""

    def one(s: str, t: str) -> int:
        most = len(s) + len(t)
        d = [[most] * (len(t) + 2) for _ in range(len(s) + 2)]
        for i in range(len(s) + 1):
            d[i + 1][1] = i
        for j in range(len(t) + 1):
            d[1][j + 1] = j
        row_of: dict[str, int] = {}
        for i in range(1, len(s) + 1):
            column = 0
            for j in range(1, len(t) + 1):
                k, m = row_of.get(t[j - 1], 0), column
                cost = s[i - 1] != t[j - 1]
                if not cost:
                    column = j
                d[i + 1][j + 1] = min(
                    d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1)
                )
            row_of[s[i - 1]] = i
        return d[-1][-1]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])
