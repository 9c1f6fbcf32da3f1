"""String, regex and JSON helpers as Column expressions. They mirror Python's string methods where those differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRIP = " \t\n\r\x0b\x0c"


def strip(x: Column) -> Column:
    """Trim ASCII white space, not only spaces."""
    return F.btrim(x, F.lit(_STRIP))


def norm_key(x: Column) -> Column:
    """Lookup key of a term."""
    return strip(F.lower(x))


def truncate(x: Column, limit: int, suffix: str = "") -> Column:
    """At most ``limit`` characters, then ``suffix`` if anything was cut; null becomes ''; negative limits cut nothing."""
    x = F.coalesce(x, F.lit(""))
    return x if limit < 0 else F.when(F.length(x) <= limit, x).otherwise(F.concat(F.substring(x, 1, limit), F.lit(suffix)))


def tokens(x: Column) -> Column:
    """Lower-case tokens between white space, none empty."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda t: t != "")


def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def after(x: Column, mark: str) -> Column:
    """What follows the first ``mark``, trimmed; without it the whole text."""
    return strip(F.when(F.instr(x, mark) > 0, F.substring(x, F.instr(x, mark) + len(mark), F.length(x))).otherwise(x))


def before(x: Column, mark: str) -> Column:
    return strip(F.substring_index(x, mark, 1))


def nullif_empty(x: Column) -> Column:
    return F.when(x != "", x)


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """First match or null."""
    return nullif_empty(F.regexp_extract(x, pattern, group))


def joined(parts: Column, default: str = "") -> Column:
    """Comma-joined array; null or empty gives ``default``."""
    return F.when(F.size(F.coalesce(parts, F.array())) > 0, F.array_join(parts, ", ")).otherwise(F.lit(default))


def format_bytes(size: Column) -> Column:
    """1024 steps, one decimal; 0 is '0 B'."""
    x = size.cast("double")
    out = F.format_string("%.1f TB", x / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(x < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", x / 1024.0**power)).otherwise(out)
    return F.when(size == 0, "0 B").otherwise(out)


def format_gb(gb: Column) -> Column:
    return F.when(gb < 1, F.format_string("%.0f MB", gb * 1024.0)).otherwise(F.format_string("%.1f GB", gb))


def sample_id(name: Column) -> Column:
    """Sample accession in a file name, upper case, else NA."""
    return F.coalesce(F.upper(extract(name, r"(?i)(GSM\d+)")), F.lit("NA"))


def series_ids(x: Column) -> Column:
    """Sorted distinct series accessions in a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"(GSE\d+)"), F.lit(1))))


def first_number(x: Column) -> Column:
    return extract(x, r"(\d+)").cast("int")


def utc_stamp() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def failure_class(message: Column, kind: Column | None = None) -> Column:
    """Kind of a failed call by its message and, if known, the class of its exception."""
    m = F.lower(F.coalesce(message, F.lit("")))
    kind = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    return (
        F.when(m.contains("timeout") | (kind == "Timeout"), "timeout")
        .when(m.contains("out of memory") | m.contains("oom"), "oom")
        .when(kind == "HTTPError", "http_error")
        .when(kind == "RequestException", "request_error")
        .otherwise("error")
    )


FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"


def _balanced(x: Column) -> Column:
    """The first balanced {...} of a text, aware of strings and escapes, or null."""
    start = F.instr(x, "{")
    chars = F.split(F.substring(x, start, F.length(x)), "")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["escaped"] & (c != "\\")
        code = plain & ~s["quoted"] & (c != '"')
        depth = s["depth"] + F.when(code & (c == "{"), 1).when(code & (c == "}"), -1).otherwise(0)
        return F.struct(
            (s["at"] + 1).alias("at"),
            depth.alias("depth"),
            F.when(plain & (c == '"'), ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"),
            (~s["escaped"] & (c == "\\")).alias("escaped"),
            F.when((s["end"] == 0) & code & (c == "}") & (depth == 0), s["at"] + 1).otherwise(s["end"]).alias("end"),
        )

    end = F.aggregate(chars, zero, step)["end"]
    return F.when((start > 0) & (end > 0), F.substring(x, start, end))


def json_text(x: Column) -> Column:
    """The JSON object in a model's answer as text: fenced block, else first balanced braces, else the widest ones."""
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t)
    fenced = strip(extract(x, FENCE))
    return F.coalesce(valid(fenced), valid(_balanced(x)), valid(extract(x, r"(?s)(\{.*\})")))
