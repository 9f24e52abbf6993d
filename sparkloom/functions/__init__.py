"""Column functions with the dialect's semantics, lowered to Spark expressions.

Everything stays in the JVM but ``json_set`` and ``unistr`` (Arrow-batched pandas
UDFs, as Spark has no counterpart).
"""

from .conditional import case_of, cast_bool, cast_decimal, cast_int, cast_real, cast_text, iif, likelihood, sql_typeof
from .datetime import add_interval, date_diff_days, date_text, datetime_text, extract_field, julian_day, strftime, time_text
from .jsonfn import json_array, json_extract, json_object, json_set, json_type, json_valid
from .numeric import add, bit_and, bit_not, bit_or, bit_xor, divide, int_divide, modulo, multiply, random_int, scalar_max, scalar_min, sign, sql_round, subtract
from .strings import char_of, concat, concat_ws, format_text, glob, hex_text, instr, octet_length, quote, random_blob, replace, soundex, substr, trim_chars, unhex, unicode_of, unistr, zero_blob

__all__ = [name for name in dir() if not name.startswith("_")]
