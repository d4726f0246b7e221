"""Column expressions for numbered text lines ``<integer>. <text>``.

Three grammars give a line its number and key:

lenient  the number is what precedes the first ``". "``, blanks trimmed, one
         sign allowed; a line without one gets number 0 and itself as key
strict   digits, a dot and a space at the start; null otherwise
split    digits and a dot at the start, the key follows the first space after
         that dot; null otherwise

All are native expressions: they run inside generated code and need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ". "
NUMBER = r"^(?U:\s*)([+-]?[0-9]+)(?U:\s*)\z"


def _int(digits: Column) -> Column:
    """Null where ``digits`` is empty or not a 32-bit number."""
    return digits.try_cast("int")


def _is_digits(text: Column) -> Column:
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def _before(value: Column, at: Column) -> Column:
    return F.substring(value, F.lit(1), at - 1)


def _from(value: Column, at: Column) -> Column:
    return F.substring(value, at, F.length(value))


def _space_after(value: Column, at: Column) -> Column:
    """Place of the first space behind ``at``, 0 for none."""
    return F.call_function("locate", F.lit(" "), value, at + 1)


def _lenient_number(value: Column) -> Column:
    """Null for a line without a number; plain digits are told without a regular expression."""
    at = F.instr(value, SEPARATOR)
    head = _before(value, at)
    return F.when(at > 0, F.when(_is_digits(head), _int(head)).otherwise(_int(F.regexp_extract(head, NUMBER, 1))))


def lenient_number(value: Column) -> Column:
    """Never null for a line that is not."""
    return F.when(value.isNotNull(), F.coalesce(_lenient_number(value), F.lit(0)))


def lenient_key(value: Column) -> Column:
    return F.when(_lenient_number(value).isNull(), value).otherwise(_from(value, F.instr(value, SEPARATOR) + 2))


def strict_number(value: Column) -> Column:
    """Null for a line that the strict grammar rejects."""
    at = F.instr(value, ".")
    head = _before(value, at)
    return F.when((F.substring(value, at + 1, F.lit(1)) == " ") & _is_digits(head), _int(head))


def strict_key(value: Column) -> Column:
    return F.when(strict_number(value).isNotNull(), _from(value, F.instr(value, ".") + 2))


def split_number(value: Column) -> Column:
    at = F.instr(value, ".")
    head = _before(value, at)
    return F.when((_space_after(value, at) > 0) & _is_digits(head), _int(head))


def split_key(value: Column) -> Column:
    return F.when(split_number(value).isNotNull(), _from(value, _space_after(value, F.instr(value, ".")) + 1))


#: Per grammar: the number's and the key's expression.
GRAMMARS = {"lenient": (lenient_number, lenient_key), "strict": (strict_number, strict_key), "split": (split_number, split_key)}


def strip_cr(value: Column) -> Column:
    """Without one trailing carriage return."""
    return F.regexp_replace(value, r"\r\z", "")


def line_bytes(value: Column) -> Column:
    """UTF-8 bytes of a line with its newline."""
    return F.octet_length(value).cast("long") + 1


def line_chars(value: Column) -> Column:
    return F.char_length(value).cast("long") + 1


def format_line(number: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit(SEPARATOR), text)


def key_slice(value: Column) -> tuple[Column, Column]:
    """Where the key of a strict line starts (from 0) and how many characters it has; nulls for a rejected line."""
    start = F.instr(value, ".").cast("long") + 1
    good = strict_number(value).isNotNull()
    return F.when(good, start), F.when(good, F.char_length(value) - start)


def sliced(value: Column, start: Column, length: Column) -> Column:
    return F.substring(value, (start + 1).cast("int"), length.cast("int"))


def whole_part(a: Column, n: int) -> Column:
    """``a`` divided by ``n``, rounded down, in whole numbers of 64 bits."""
    return F.call_function("div", a - F.pmod(a, F.lit(n).cast("long")), F.lit(n).cast("long"))


def utf16_order(key: Column) -> Column:
    """Sorts as UTF-16 code units do; plain strings sort by UTF-8 bytes.

    The two differ only between U+E000..U+FFFF and the code points above.
    """
    return F.encode(key, "UTF-16BE")


def compare(left_key: Column, left_number: Column, right_key: Column, right_number: Column) -> Column:
    """-1, 0 or 1: by key, then by number."""

    def sign(a: Column, b: Column) -> Column:
        return F.when(a < b, -1).when(a > b, 1).otherwise(0)

    by_key = sign(left_key, right_key)
    return F.when(by_key != 0, by_key).otherwise(sign(left_number, right_number))
