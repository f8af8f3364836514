"""Column rules that turn one export record into one log row.

All are native expressions, so they stay inside whole-stage code generation
wherever Spark generates code for the function itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_SECOND = 1_000_000_000
NS_PER_DAY = 86_400 * NS_PER_SECOND

# The accepted event-time window around `now`.
MAX_AGE_NS = 30 * NS_PER_DAY
MAX_AHEAD_NS = 3_600 * NS_PER_SECOND

# Severity numbers, from, to (both inclusive), name; in order, without gaps.
SEVERITY_RANGES = (
    (1, 4, "TRACE"),
    (5, 8, "DEBUG"),
    (9, 12, "INFO"),
    (13, 16, "WARN"),
    (17, 20, "ERROR"),
    (21, 24, "FATAL"),
)

NANOS_MIN = -(2**63)
NANOS_MAX = 2**63 - 1


def _nanos(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("bigint")


def severity_col(number: Column, text: Column) -> Column:
    """Severity name: by number range, else the upper-cased text, else UNSPECIFIED."""
    named = F
    for _low, high, name in SEVERITY_RANGES:
        named = named.when(number <= high, name)
    text = F.coalesce(text, F.lit(""))
    known = number.between(SEVERITY_RANGES[0][0], SEVERITY_RANGES[-1][1])
    return (
        F.when(known, named)
        .when(text != "", F.upper(text))
        .otherwise("UNSPECIFIED")
    )


def _acceptable(stamp: Column, now_ns: Column | int) -> Column:
    if isinstance(now_ns, int):
        low = F.lit(max(now_ns - MAX_AGE_NS, NANOS_MIN)).cast("bigint")
        high = F.lit(min(now_ns + MAX_AHEAD_NS, NANOS_MAX)).cast("bigint")
    else:
        low = saturating_minus(now_ns, MAX_AGE_NS)
        high = F.when(
            now_ns > NANOS_MAX - MAX_AHEAD_NS, F.lit(NANOS_MAX).cast("bigint")
        ).otherwise(now_ns + MAX_AHEAD_NS)
    return F.coalesce((stamp != 0) & stamp.between(low, high), F.lit(False))


def saturating_minus(value: Column, amount: int) -> Column:
    """`value - amount` that stops at the smallest long instead of overflowing."""
    floor = F.lit(NANOS_MIN).cast("bigint")
    return F.when(value < NANOS_MIN + amount, floor).otherwise(value - F.lit(amount).cast("bigint"))


def event_time_col(time: Column, observed: Column, now_ns: Column | int) -> Column:
    """Event time in ns: own stamp if acceptable, else the observed one, else `now`."""
    return (
        F.when(_acceptable(time, now_ns), time)
        .when(_acceptable(observed, now_ns), observed)
        .otherwise(_nanos(now_ns))
    )


def clamped_col(time: Column, now_ns: Column | int) -> Column:
    """True where a stamp was given and rejected. An absent stamp is no rejection."""
    return F.coalesce(time != 0, F.lit(False)) & ~_acceptable(time, now_ns)


def hex_id_col(raw: Column, width: int) -> Column:
    """Lower-case hex of an id of exactly `width` non-zero bytes, else ''."""
    given = (F.octet_length(raw) == width) & (raw != F.lit(bytes(width)))
    return F.when(given, F.lower(F.hex(raw))).otherwise("")


def service_col(resource: Column) -> Column:
    return F.coalesce(resource["service.name"], F.lit("unknown"))


# Values that are not plain text are rare. Their rules are SQL lambdas, which
# Spark interprets: the long text stays out of the generated code of the hot
# path, and `transform(array(x), v -> ...)[0]` computes `x` once for all its uses.


def _double_sql(value: str) -> str:
    """Decimal text of a double without exponent and without a trailing '.0'.

    Works on the digits of Spark's own text (`-d.ddE-dd` when there is an
    exponent, with one digit before the point), so no digit is lost at any size.
    """
    parts = r"""named_struct(
        'sign', if(startswith(t, '-'), '-', ''),
        'digits', concat(regexp_extract(t, r'^-?(\d)', 1),
            regexp_replace(regexp_extract(t, r'\.(\d+)', 1), '^0$', '')),
        'whole', 1 + cast(regexp_extract(t, r'E(-?\d+)$', 1) as int))"""
    expanded = f"""transform(array({parts}), p -> case
        when p.whole < 1 then concat(p.sign, '0.', repeat('0', -p.whole), p.digits)
        when p.whole >= length(p.digits) then concat(p.sign, rpad(p.digits, p.whole, '0'))
        else concat(p.sign, left(p.digits, p.whole), '.', substr(p.digits, p.whole + 1))
        end)[0]"""
    return rf"""transform(array(cast({value} as string)), t -> case
        when t = 'Infinity' then 'inf' when t = '-Infinity' then '-inf'
        when contains(t, 'E') then {expanded}
        else regexp_replace(t, r'\.0$', '') end)[0]"""


def _nested_sql(text: str) -> str:
    """Compact JSON: keys sorted, the last of two equal keys kept, numbers as written.

    VARIANT does the sorting but rewrites numbers (`1.0` to `1`), so each
    number outside a string travels as a string that starts with an escaped
    control character, and is unwrapped after. Raw control characters cannot
    occur in valid JSON text, so the helpers \\u0002 and \\u0003 are never input.
    """
    literal = r"""r'("(?:[^"\\]|\\.)*+")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'"""
    split = f"regexp_replace(j, {literal}, '$1\\u0002$2\\u0003')"
    numbers = f"replace({split}, '\\u0002\\u0003', '')"
    marked = (
        f"regexp_replace({numbers}, '\\u0002([^\\u0003]*)\\u0003', r'\"\\\\u0001num:$1\"')"
    )
    unwrapped = rf"""regexp_replace(to_json(parse_json({marked})), r'"\\u0001num:([^"]*)"', '$1')"""
    return f"transform(array({text}), j -> {unwrapped})[0]"


def _simple_sql(value: str) -> str:
    return f"""coalesce({value}.string_value, cast({value}.bool_value as string),
        cast({value}.int_value as string), {_lower_hex(f"{value}.bytes_value")})"""


def _any_value_sql(value: str) -> str:
    return f"""coalesce({_simple_sql(value)},
        case when {value}.double_value is not null then {_double_sql(f"{value}.double_value")} end,
        case when {value}.json_value is not null then {_nested_sql(f"{value}.json_value")} end,
        '')"""


def _lower_hex(value: str) -> str:
    return f"lower(hex({value}))"


def double_text_col(name: str) -> Column:
    return F.expr(_double_sql(name))


def nested_text_col(name: str) -> Column:
    return F.expr(_nested_sql(name))


def simple_text_col(name: str) -> Column:
    """Text of a string, boolean, integer or bytes value; NULL for the other kinds."""
    return F.expr(_simple_sql(name))


def any_value_col(name: str) -> Column:
    """Text of an attribute value; a missing value is ''."""
    return F.expr(_any_value_sql(name))


# Key/value lists. A list of text values only, the common case, becomes a map
# without any per-element lambda, so its whole path is generated code. A list
# with other values takes `mixed_map_col`.


def all_text_col(pairs: str) -> Column:
    """True if every key and every value of the list is a string.

    An overlap test answers NULL, neither true nor false, when a NULL is among
    the elements; comparing with one fixed string turns it into a NULL test.
    """
    return F.expr(
        f"coalesce(not arrays_overlap({pairs}.key, array('\\u0001')), false)"
        f" and coalesce(not arrays_overlap({pairs}.value.string_value, array('\\u0001')), false)"
    )


def sorted_pairs_col(pairs: str) -> Column:
    """Text pairs in key order; equal keys keep their order of appearance."""
    position = F.expr(f"case when size({pairs}) > 0 then sequence(1, size({pairs})) end")
    keys, values = F.col(f"{pairs}.key"), F.col(f"{pairs}.value.string_value")
    return F.sort_array(F.arrays_zip(keys.alias("k"), position.alias("p"), values.alias("v")))


def text_map_col(sorted_pairs: str) -> Column:
    """Map of sorted text pairs; the last value of a key wins."""
    return F.expr(f"map_from_arrays({sorted_pairs}.k, {sorted_pairs}.v)")


def mixed_map_col(pairs: str) -> Column:
    """Map of a list with values of any kind: last value wins, keys sorted."""
    keys = f"transform({pairs}, p -> coalesce(p.key, ''))"
    values = f"transform({pairs}, p -> {_any_value_sql('p.value')})"
    built = f"map_from_arrays({keys}, {values})"
    return F.expr(f"map_from_entries(sort_array(map_entries({built})))")


def flatten_kvs_col(pairs: str) -> Column:
    """Key/value list to a string map: last value of a key wins, keys sorted."""
    return F.coalesce(mixed_map_col(pairs), empty_map_col())


def empty_map_col() -> Column:
    return F.create_map().cast("map<string,string>")


def header_text(value: Column) -> Column:
    """A header value if it is visible ASCII, else NULL (as if not sent)."""
    return F.when(value.rlike(r"\A[\x20-\x7e\t]*\z"), value)


def request_key_col(x_api_key: Column, authorization: Column) -> Column:
    """The API key of a request: x-api-key first, else the text after 'Bearer '."""
    bearer = header_text(authorization)
    return F.coalesce(
        header_text(x_api_key),
        F.when(bearer.startswith("Bearer "), bearer.substr(F.lit(8), F.length(bearer))),
    )


def key_hash_col(key: Column) -> Column:
    """Keys are stored and compared as SHA-256 hex only."""
    return F.sha2(key, 256)
