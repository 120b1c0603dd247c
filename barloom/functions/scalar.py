"""Scalar helpers: coercions that never raise, dates in the local calendar, text, references and ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of query parameters that carry credentials.
SENSITIVE_KEYS = (
    "api_key", "apikey", "access_token", "api_token", "api-token", "x-api-key", "x_api_key", "authorization", "auth", "bearer", "credential", "credentials",
    "key", "password", "secret", "signature", "token", "client_secret", "private_key", "x-amz-credential", "x-amz-signature",
)
# Fixed value: what stands for a credential in error text.
REDACTED = "[REDACTED]"
# Fixed value: the exchange's codes of common stock.
COMMON_STOCK = "[0-9]{4}"
#: words before whose value error text is cut, with any of - _ or nothing for the blank
CREDENTIAL_WORDS = ("password", "passphrase", "token", "secret", "api key", "access key", "private key", "authorization")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(value: Column, places: int = 12) -> Column:
    """Rounded before any comparison with a threshold, so that noise below 1e-12 doesn't decide; no negative zero."""
    return F.round(value, places) + F.lit(0.0)


def clean_text(value: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.btrim(value), F.lit(""))


def clean_symbol(value: Column) -> Column:
    return F.upper(clean_text(value))


def is_symbol(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9A-Z]{2,12}$"), F.lit(False))


def is_common_stock_code(value: Column, codes: str = COMMON_STOCK) -> Column:
    return F.coalesce(value.rlike(f"^(?:{codes})$"), F.lit(False))


def to_number(value: Column) -> Column:
    """A finite double, thousands separators allowed in groups of three; else null."""
    text = F.btrim(value)
    grouped = text.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    plain = text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    number = F.when(grouped | plain, F.regexp_replace(text, ",", "").try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def to_integer(value: Column) -> Column:
    """A long from "5", "1,234" or "5.0"; fractions give null."""
    number = to_number(value)
    exact = F.when(F.btrim(value).rlike(r"^[+-]?[0-9]{1,3}(,?[0-9]{3})*$|^[+-]?[0-9]+$"), F.regexp_replace(F.btrim(value), ",", "").try_cast("long"))
    return F.coalesce(exact, F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.try_cast("long")))


def to_boolean(value: Column) -> Column:
    word = F.lower(F.btrim(value))
    return F.when(word.isin("true", "1", "yes", "y"), True).when(word.isin("false", "0", "no", "n"), False)


def roc_date(value: Column) -> Column:
    """A date from the Republic of China calendar: YYYMMDD or YYY/MM/DD, year 1 being 1912."""
    text = F.btrim(value)
    digits = F.regexp_replace(text, "/", "")
    fits = text.rlike("^[0-9]{3}[0-9]{4}$|^[0-9]{2,3}/[0-9]{2}/[0-9]{2}$")
    year = F.regexp_extract(digits, "^([0-9]+)[0-9]{4}$", 1).try_cast("int") + 1911
    return F.when(fits, F.concat_ws("-", year.cast("string"), F.regexp_extract(digits, "([0-9]{2})[0-9]{2}$", 1), F.regexp_extract(digits, "([0-9]{2})$", 1)).try_cast("date"))


def flexible_date(value: Column) -> Column:
    """A date from seven digits (local calendar) or eight (Gregorian), with or without - or / between."""
    digits = F.regexp_replace(F.btrim(value), "[-/.]", "")
    gregorian = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date")
    return F.when(digits.rlike("^[0-9]{8}$"), gregorian).when(digits.rlike("^[0-9]{7}$"), roc_date(digits))


def month_end(day: Column) -> Column:
    return F.last_day(day)


def previous_month_start(day: Column) -> Column:
    return F.add_months(F.trunc(day, "month"), -1).cast("date")


def redacted(message: Column, limit: int = 1000) -> Column:
    """Error text in one line without the values of credentials, cut to ``limit`` characters.

    A value is what follows a credential's name and a colon or equals sign - in quotes, or up to a blank, comma,
    semicolon or ampersand - or the word Bearer."""
    words = "|".join(w.replace(" ", "[-_ ]?") for w in CREDENTIAL_WORDS)
    value = r"""(?:"[^"]*"|'[^']*'|[^\s,;&]+)"""
    line = F.btrim(F.translate(message, "\r\n", "  "))
    line = F.regexp_replace(line, rf"(?i)\bbearer\s+{value}", f"Bearer {REDACTED}")
    line = F.regexp_replace(line, rf"(?i)\b((?:{words})[\"']?)\s*[:=]\s*(?!Bearer \[REDACTED\]){value}", f"$1={REDACTED}")
    return F.substring(line, 1, limit)


def error_text(error_type: Column, message: Column, limit: int = 1000) -> Column:
    """An error as users see it: its type and, if it says anything, its redacted text, cut to ``limit`` together."""
    line = redacted(F.coalesce(message, F.lit("")), limit)
    return F.when(line == "", error_type).otherwise(F.substring(F.concat(error_type, F.lit(": "), line), 1, limit))


def is_clean_reference(uri: Column) -> Column:
    """An absolute reference of any scheme without user information and without credentials among its query
    keys, which are compared decoded and whatever their case."""
    scheme, rest = r"^[a-zA-Z][a-zA-Z0-9+.-]*:", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?[^?#]*\?([^#]*)"
    pairs = F.split(F.regexp_extract(uri, rest, 1), "&")
    keys = F.transform(pairs, lambda kv: F.lower(F.coalesce(F.try_url_decode(F.element_at(F.split(kv, "="), 1)), F.element_at(F.split(kv, "="), 1))))
    user = uri.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*@")
    return F.coalesce(uri.rlike(scheme) & ~user & ~F.arrays_overlap(keys, F.array(*[F.lit(k) for k in SENSITIVE_KEYS])), F.lit(False))


def json_scalar(value: Column) -> Column:
    """A scalar from JSON text as (kind, number, text, truth). JSON's null is the kind ``null``, other than no
    JSON scalar at all, which has no kind."""
    t = F.btrim(value)
    kind = F.when(t == "null", "null").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number").when(t.rlike(r'^"([^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"$'), "string")
    text = F.element_at(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 1)
    return F.struct(kind.alias("kind"), F.when(kind == "number", t.try_cast("double")).alias("number"), F.when(kind == "string", text).alias("text"), F.when(kind == "boolean", t == "true").alias("truth"))


def canonical_json(**fields: Column) -> Column:
    """JSON with keys in order, without spaces, and with nulls kept."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def content_id(*parts: Column, length: int = 64) -> Column:
    """A hash of the parts' text; nulls are parts of their own."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.substring(F.sha2(text, 256), 1, length)


def group_id(hashes: Column) -> Column:
    """A hash of a group's row hashes, whatever their order; an aggregate."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), ","), 256)


def first_of(*cases: tuple[Column, Column | str | None], otherwise: Column | str | None = None) -> Column:
    """An ordered decision list: the value of the first case that holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    start = F.when(F.coalesce(cases[0][0], F.lit(False)), value(cases[0][1]))
    return reduce(lambda acc, case: acc.when(F.coalesce(case[0], F.lit(False)), value(case[1])), cases[1:], start).otherwise(value(otherwise))
