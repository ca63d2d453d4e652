"""Display formats as columns, exact in integers (halves go to the even digit, as the exact value asks)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataseek.schema import ATTRIBUTE_BITS

UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _scaled(n: Column, power: int, digits: int) -> Column:
    """``n / 2**power`` with ``digits`` decimals, as text."""
    ten, half = 10**digits, 1 << (power - 1)
    # the whole part first, so that the product with 10**digits can't overflow
    whole = F.shiftright(n, power)
    rest = n % F.lit(1 << power)
    scaled = rest * F.lit(ten).cast("decimal(20,0)")
    q = F.call_function("div", scaled, F.lit(1 << power).cast("decimal(20,0)"))
    r = scaled - q.cast("decimal(20,0)") * F.lit(1 << power).cast("decimal(20,0)")
    # an odd last digit rounds up at the half; with no digits left over, the whole part's own decides
    up = (r > half) | ((r == half) & (q % 2 == 1))
    total = q + up.cast("long")
    shown_whole = whole + (total >= ten).cast("long")
    shown = total % ten
    return F.concat(shown_whole.cast("string"), F.lit("."), F.lpad(shown.cast("string"), digits, "0"))


def format_size(n: Column) -> Column:
    """Unit by powers of 1000, value by powers of 1024: 1000 is ``0.98 KB``."""
    n = n.cast("long")
    out = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(UNITS[1:], 1):
        out = out.when(n < F.lit(1000 ** (k + 1)), F.concat(_scaled(n, 10 * k, 2), F.lit(f" {unit}")))
    return out.otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_file_size(n: Column) -> Column:
    """Bytes, then KB and MB with one decimal; no larger unit."""
    n = n.cast("long")
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(_scaled(n, 10, 1), F.lit(" KB"))).otherwise(F.concat(_scaled(n, 20, 1), F.lit(" MB")))


def megabytes(n: Column) -> Column:
    return _scaled(n.cast("long"), 20, 2)


def format_timestamp(seconds: Column) -> Column:
    """Epoch seconds as UTC text (the session's time zone is UTC); what no date can hold is an error text."""
    ok = seconds.between(-62135596800, 253402300799)
    return F.when(ok, F.date_format(F.timestamp_seconds(F.when(ok, seconds)), "yyyy-MM-dd HH:mm:ss")).otherwise("时间错误")


def format_date(ts: Column, pattern: str = "yyyy-MM-dd HH:mm", zone: str = "UTC") -> Column:
    """A timestamp as text in ``zone``; null as empty."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), pattern), F.lit(""))


def ellipsis(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def attribute_bits(attributes: Column) -> Column:
    """The attribute flags as one number."""
    return reduce(lambda a, b: a + b, (F.when(attributes[n], bit).otherwise(0) for n, bit in ATTRIBUTE_BITS.items())).cast("long")


def highlight(text: Column, words: list[str], left: str = "【", right: str = "】") -> Column:
    """Marks every occurrence of each word, one word after the other, in their case."""
    for w in words:
        if w:
            text = F.replace(text, F.lit(w), F.lit(f"{left}{w}{right}"))
    return text


def fingerprint(content: Column) -> Column:
    """md5 of the first 8192 bytes and the decimal length."""
    return F.md5(F.concat(F.substring(content, 1, 8192), F.octet_length(content).cast("string").cast("binary")))


def byte_slice(text: Column, start: Column, length: Column) -> Column:
    """``length`` bytes of the UTF-8 text from the character on that byte ``start`` (from 0) lies in; the last character is taken whole."""
    return raw_slice(F.encode(text, "utf-8"), start, length)


def raw_slice(raw: Column, start: Column, length: Column) -> Column:
    """As ``byte_slice``, of a text's bytes."""
    size = F.octet_length(raw)
    first = F.least(F.greatest(start, F.lit(0)), size)

    def inside(at: Column) -> Column:  # whether a byte continues a character
        return F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)

    back = F.coalesce(*(F.when(~F.coalesce(inside(first - k), F.lit(False)), first - k) for k in range(3)), first - 3)
    last = F.least(back + F.greatest(length, F.lit(0)), size)
    forth = F.coalesce(*(F.when(~F.coalesce(inside(last + k), F.lit(False)), last + k) for k in range(3)), last + 3)
    return F.decode(F.substring(raw, back + 1, forth - back), "utf-8")


def url_encode(text: Column) -> Column:
    return F.url_encode(text)


def url_decode(text: Column) -> Column:
    """Percent signs and pluses of a URL read; a broken escape gives null."""
    return F.try_url_decode(text)


def base64_encode(text: Column) -> Column:
    return F.base64(F.encode(text, "utf-8"))


def base64_decode(text: Column) -> Column:
    """The text of a base64 string; what isn't one gives null."""
    return F.decode(F.try_to_binary(text, F.lit("base64")), "utf-8")
