"""Scalar functions over columns: ids, hashes, fingerprints, keys, JSON, durations and typed map access."""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types by their lower-case names; fixed values.
ENTITY_TYPES = ["Person", "Place", "Organization", "Event", "Concept", "Work", "Object", "Time", "Method", "Unknown"]
#: Preferred file extensions; fixed values.
EXTENSIONS = {"application/epub+zip": ".epub", "application/json": ".json", "application/pdf": ".pdf", "application/zip": ".zip", "image/gif": ".gif",
              "image/jpeg": ".jpg", "image/png": ".png", "image/svg+xml": ".svg", "text/css": ".css", "text/csv": ".csv", "text/html": ".html",
              "text/markdown": ".md", "text/plain": ".txt"}
#: Log levels and their numbers; fixed values.
LEVELS = {"TRACE": 5, "DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40, "CRITICAL": 50}
#: Signs of an error that is worth another try; fixed values.
RETRYABLE = ["rate limit", "429", "timeout", "timed out", "connection", "502", "503", "504", "overloaded"]


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def gen_id(*parts: Column, prefix: str = "", suffix: str = "") -> Column:
    """A stable id from natural keys: 32 hexadecimal digits between prefix and suffix."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, 32), F.lit(suffix))


def random_id(prefix: str = "", suffix: str = "", hyphens: bool = True) -> Column:
    u = F.expr("uuid()")
    return F.concat(F.lit(prefix), u if hyphens else F.replace(u, F.lit("-"), F.lit("")), F.lit(suffix))


def gen_secret(length: int = 32, alphabet: str = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", seed: int | None = None) -> Column:
    """Random characters; not for cryptography."""
    one = lambda i: F.substring(F.lit(alphabet), (F.floor(F.rand(None if seed is None else seed + i) * len(alphabet)) + 1).cast("int"), F.lit(1))
    return F.concat(*[one(i) for i in range(length)])


def utc_now() -> Column:
    return F.current_timestamp()


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def _quoted(c: Column) -> Column:
    """As a Python string literal, for text without control characters other than \\n, \\r and \\t."""
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(plain), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"')), F.concat(F.lit('"'), c, F.lit('"'))).when(
        F.contains(c, F.lit("'")), single).otherwise(F.concat(F.lit("'"), c, F.lit("'")))


def fingerprint(c: Column) -> Column:
    """Length, a short hash, and the ends of a string."""
    return F.concat(F.lit("len="), F.length(c).cast("string"), F.lit(" sha256="), F.substring(F.sha2(c, 256), 1, 12),
                    F.lit(" head="), _quoted(F.substring(c, 1, 6)), F.lit(" tail="), _quoted(F.right(c, F.lit(4))))


def flatten(json_text: Column, sep: str = ".") -> Column:
    """A JSON object as a map from joined keys to the text of the leaves."""
    def walk(value, path, out):
        for k, v in value.items():
            name = f"{path}{sep}{k}" if path else k
            if isinstance(v, dict):
                walk(v, name, out)
            else:
                out[name] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return out

    @F.pandas_udf("map<string,string>")
    def flat(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                value = json.loads(t) if t else None
            except ValueError:
                return None
            return walk(value, "", {}) if isinstance(value, dict) else None
        return pd.Series([one(t) for t in texts], dtype=object)

    return flat(json_text)


def int_to_base64url(c: Column) -> Column:
    """The big-endian bytes of a non-negative integer, URL-safe and without padding; 0 is empty."""
    coded = F.base64(F.unhex(F.hex(c.cast("long"))))
    return F.when(c == 0, "").otherwise(F.rtrim(F.translate(coded, "+/", "-_"), F.lit("=")))


def secure_equal(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def lookup(c: Column, values: dict, default=None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), F.lit(default))


def ext_for_mime(mime: Column) -> Column:
    return lookup(F.lower(mime), EXTENSIONS, "")


def entity_type(c: Column) -> Column:
    """The entity type that a name stands for in any case, Unknown for others."""
    return lookup(F.lower(strip(F.coalesce(c, F.lit("")))), {t.lower(): t for t in ENTITY_TYPES}, "Unknown")


def once(value: Column, body) -> Column:
    """body(value) with value computed once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def salvage_json(c: Column) -> Column:
    """The text from the first { to the last } if it is one JSON value, else null. It is read inside brackets, as the parser
    passes over what stands after a value."""
    def whole(body: Column) -> Column:
        listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
        return once(listed, lambda x: F.when(x.isNotNull() & F.try_variant_get(x, "$[1]", "variant").isNull() & (body != ""), body))
    return once(F.regexp_extract(c, r"(?s)\{.*\}", 0), whole)


def duration(seconds: Column) -> Column:
    """Whole days from a day on, else whole hours."""
    s = seconds.cast("long")
    return F.when(s >= 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))


def eta(total: Column, done: Column, elapsed: Column) -> Column:
    """Seconds left at the rate so far; null where there is none."""
    good = (total > 0) & (done > 0) & (elapsed > 0)
    return F.when(good, F.greatest(F.lit(0.0), (total - done) / (done / elapsed)))


def find_text(haystack: Column, needle: Column, start: Column) -> Column:
    """The offset of needle at or after start, else of needle with single blanks, else -1."""
    words = F.trim(F.regexp_replace(needle, r"(?U)\s+", " "))
    first = F.call_function("locate", needle, haystack, start + 1)
    second = F.call_function("locate", words, haystack, start + 1)
    return F.when(first > 0, first).otherwise(second) - 1


def normalize_key(key: Column) -> Column:
    return F.ltrim(key, F.lit("/"))


def blob_path(content_hash: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs"), F.left(content_hash, F.lit(2)), content_hash)


def snake_case(name: Column) -> Column:
    c = F.regexp_replace(name, r"(.)([A-Z][a-z]+)", "$1_$2")
    return F.lower(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2"))


def range_end(offset: Column, length: Column) -> Column:
    return offset + length


def key_build(parts: list[Column], named: dict[str, Column] | None = None, prefix: str = "", sep: str = ":") -> Column:
    all_parts = [F.lit(prefix)] * bool(prefix) + parts + [F.concat(F.lit(f"{k}="), v) for k, v in (named or {}).items()]
    return F.concat_ws(sep, *all_parts)


def _key_parts(key: Column, prefix: str, sep: str) -> Column:
    return F.split(F.substr(key, F.lit(len(prefix) + len(sep) + 1)), "\\Q" + sep + "\\E", -1)


def key_positional(key: Column, prefix: str = "", sep: str = ":") -> Column:
    return F.filter(_key_parts(key, prefix, sep), lambda p: ~F.contains(p, F.lit("=")))


def key_named(key: Column, prefix: str = "", sep: str = ":") -> Column:
    named = F.filter(_key_parts(key, prefix, sep), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(named, lambda p: F.struct(F.substring_index(p, "=", 1), F.substr(p, F.instr(p, F.lit("=")) + 1)))
    #: Of a repeated name the last value counts.
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.lit(0), F.size(pairs) - i - 1)), lambda y: y["col1"] == x["col1"]))
    return F.map_from_entries(last)


def key_valid(key: Column, prefix: str = "", sep: str = ":") -> Column:
    """Whether the key has the prefix and no positional part after a named one."""
    kinds = F.transform(_key_parts(key, prefix, sep), lambda p: F.contains(p, F.lit("=")).cast("int"))
    return key.startswith(prefix + sep) & (F.array_sort(kinds) == kinds)


def get_str(m: Column, key: str, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def get_int(m: Column, key: str, default: int | None = None) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)).try_cast("long"), F.lit(default))


def get_bool(m: Column, key: str, default: bool | None = None) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)).try_cast("boolean"), F.lit(default))


def is_retryable(error: Column) -> Column:
    text = F.lower(error)
    found = F.lit(False)
    for sign in RETRYABLE:
        found = found | F.contains(text, F.lit(sign))
    return found


def level_number(name: Column) -> Column:
    return lookup(F.upper(name), LEVELS, 0)


def log_line(ts: Column, level: Column, name: Column, message: Column, fields: Column) -> Column:
    """One readable line of a log record; fields is a map, shown by key."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return F.rtrim(F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.rpad(level, 8, " "), name, message, shown))


def result_summary(tool: Column, items: Column, types: Column) -> Column:
    """What a tool returned in a few words."""
    return F.when(items == 0, F.concat(tool, F.lit(": no results"))).otherwise(
        F.concat(tool, F.lit(": "), items.cast("string"), F.when(items == 1, " result").otherwise(" results"),
                 F.when(F.size(types) > 0, F.concat(F.lit(" ("), F.array_join(F.array_sort(types), ", "), F.lit(")"))).otherwise("")))


def evaluate(expression: Column) -> Column:
    """The value of an arithmetic expression of numbers, + - * / // % ** and brackets; null where it is none.
    Symbolic calculus needs a library that is not here."""
    import ast
    import operator

    ops = {"Add": operator.add, "Sub": operator.sub, "Mult": operator.mul, "Div": operator.truediv, "Pow": operator.pow, "Mod": operator.mod,
           "USub": operator.neg, "UAdd": operator.pos, "FloorDiv": operator.floordiv}

    def value(node):
        kind = type(node).__name__
        if kind == "Constant" and type(node.value) in (int, float):
            return node.value
        if kind == "BinOp":
            left, right = value(node.left), value(node.right)
            if type(node.op).__name__ == "Pow" and (abs(right) > 1000 or abs(left) > 1e6):
                raise ValueError("too large")
            return ops[type(node.op).__name__](left, right)
        if kind == "UnaryOp":
            return ops[type(node.op).__name__](value(node.operand))
        raise ValueError(kind)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return float(value(ast.parse(t.strip(), mode="eval").body))
            except Exception:  # anything that is no plain arithmetic has no value
                return None
        return pd.Series([one(t) if t else None for t in texts], dtype="float64")

    return run(expression)
