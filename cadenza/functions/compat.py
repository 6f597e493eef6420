"""SQL functions that users of other engines know under another name.

Each is a one-line SQL function, so Catalyst inlines it: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Euclid's steps on two 64-bit numbers end within 92 rounds.
_GCD = (
    "aggregate(sequence(1, 92), named_struct('a', abs(x), 'b', abs(y)), "
    "(s, i) -> IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
)

# Capture groups of a pattern: parentheses outside of escapes and bracketed classes, without a question mark or with a name.
_GROUPS = r"regexp_count(regexp_replace(p, '\\\\.|\\[[^]]*\\]', ''), '[(](?![?])|[(][?]<(?![=!])')"
_FLAGGED = "concat(IF(flags = '' OR flags = 'g', '', concat('(?', replace(flags, 'g', ''), ')')), p)"

# Its span is a day-time interval; a whole number is one of seconds. The span in microseconds is where it ends after the epoch.
_DATE_BIN = (
    "date_bin(span INTERVAL SECOND, ts TIMESTAMP, origin TIMESTAMP DEFAULT TIMESTAMP'1970-01-01 00:00:00') RETURNS TIMESTAMP RETURN "
    "timestamp_micros(unix_micros(ts) - pmod(unix_micros(ts) - unix_micros(origin), unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + span)))"
)

FUNCTIONS = (
    "strpos(s STRING, t STRING) RETURNS INT RETURN instr(s, t)",
    "starts_with(s STRING, t STRING) RETURNS BOOLEAN RETURN startswith(s, t)",
    "ends_with(s STRING, t STRING) RETURNS BOOLEAN RETURN endswith(s, t)",
    "substr_index(s STRING, d STRING, n INT) RETURNS STRING RETURN substring_index(s, d, n)",
    "to_hex(n BIGINT) RETURNS STRING RETURN lower(hex(n))",
    f"regexp_match(s STRING, p STRING, flags STRING DEFAULT '') RETURNS ARRAY<STRING> RETURN CASE WHEN regexp_like(s, {_FLAGGED}) THEN "
    f"IF({_GROUPS} = 0, array(regexp_substr(s, {_FLAGGED})), transform(sequence(1, greatest({_GROUPS}, 1)), "
    f"k -> regexp_extract(s, {_FLAGGED}, k))) END",
    "string_to_array(s STRING, d STRING) RETURNS ARRAY<STRING> RETURN split(s, concat('\\\\Q', d, '\\\\E'))",
    "array_to_string(a ARRAY<STRING>, d STRING) RETURNS STRING RETURN array_join(a, d)",
    "iszero(x DOUBLE) RETURNS BOOLEAN RETURN x = 0",
    f"gcd(x BIGINT, y BIGINT) RETURNS BIGINT RETURN {_GCD}",
    f"lcm(x BIGINT, y BIGINT) RETURNS BIGINT RETURN IF(x = 0 OR y = 0, 0, abs(x div {_GCD} * y))",
    "sha256(s STRING) RETURNS BINARY RETURN unhex(sha2(s, 256))",
    "sha512(s STRING) RETURNS BINARY RETURN unhex(sha2(s, 512))",
    "to_timestamp_seconds(n BIGINT) RETURNS TIMESTAMP RETURN timestamp_seconds(n)",
    "to_timestamp_millis(n BIGINT) RETURNS TIMESTAMP RETURN timestamp_millis(n)",
    "to_timestamp_micros(n BIGINT) RETURNS TIMESTAMP RETURN timestamp_micros(n)",
    _DATE_BIN,
    "digest(s STRING, m STRING) RETURNS BINARY RETURN unhex(CASE lower(m) WHEN 'md5' THEN md5(s) "
    "WHEN 'sha224' THEN sha2(s, 224) WHEN 'sha256' THEN sha2(s, 256) WHEN 'sha384' THEN sha2(s, 384) "
    "WHEN 'sha512' THEN sha2(s, 512) END)",
    "map_extract(m MAP<STRING, STRING>, k STRING) RETURNS ARRAY<STRING> "
    "RETURN IF(map_contains_key(m, k), array(m[k]), array())",
)

# Built-in functions under a second name; aggregates and functions of any type need this form.
ALIASES = {
    "approx_distinct": "approx_count_distinct",
    "approx_median": "median",
    "approx_percentile_cont": "approx_percentile",
    "array_length": "array_size",
    "arrow_typeof": "typeof",
    "generate_series": "sequence",
    "make_array": "array",
    "unnest": "explode",
}


def _alias(spark: SparkSession, name: str, known: str) -> None:
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    registry = spark._jsparkSession.sessionState().functionRegistry()
    source, target = catalyst.FunctionIdentifier(known), catalyst.FunctionIdentifier(name)
    registry.registerFunction(target, registry.lookupFunction(source).get(), registry.lookupFunctionBuilder(source).get())


def register(spark: SparkSession, said: str) -> None:
    """Make the functions a text names (in lower case) known to one session."""
    for definition in FUNCTIONS:
        if definition.split("(", 1)[0] in said:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {definition}")
    for name, known in ALIASES.items():
        if name in said:
            _alias(spark, name, known)
