"""Column expressions for product texts: blanks, numbers in text, model names, capacities, addresses.

Blanks are the Unicode set of the scripting language that the catalogue's rules were written for; Java's \\s is
smaller, so every expression uses BLANK. Word edges are ASCII, so they are written as lookarounds, not as \\b.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: all blanks, the byte order mark and line separators included.
BLANKS = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BLANK = f"[{BLANKS}]"
_EDGE_BEFORE, _EDGE_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: The words taken for colours.
COLOURS = ("white", "black", "blue", "red", "green", "yellow", "pink", "purple", "orange", "silver", "gold", "titanium", "graphite", "space", "gray", "grey")

#: Date layouts by name.
DATE_LAYOUTS = {"day": "dd-MM-yyyy", "stamp": "yyyy-MM-dd HH:mm:ss", "minute": "HH:mm:00", "weekday": "EEEE"}

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim(x: Text) -> Column:
    """Without blanks at either end."""
    return F.regexp_replace(col(x), f"^{BLANK}+|{BLANK}+$", "")


def collapse(x: Text) -> Column:
    """Trimmed, with single spaces inside."""
    return trim(F.regexp_replace(col(x), f"{BLANK}+", " "))


def blank_to_null(x: Text) -> Column:
    return F.nullif(trim(x), F.lit(""))


def number_prefix(x: Text) -> Column:
    """The longest number at the text's start as a double; null without one. May be infinite."""
    found = F.regexp_extract(col(x), rf"^{BLANK}*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def number_text(x: Text) -> Column:
    """A double as text, whole ones without a fraction."""
    v = col(x)
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def base_model(title: Text) -> Column:
    """The model's name: lower case, without bracketed parts, storage and memory sizes, and colours. Null gives ""."""
    size = rf"{_EDGE_BEFORE}[0-9]+{BLANK}*(?:GB|TB|MB)"
    out = F.coalesce(col(title), F.lit(""))
    for pattern in (
        r"\([^)]*\)",
        rf"(?i){size}{BLANK}*(?:ROM|RAM){_EDGE_AFTER}|(?i){size}(?:{BLANK}+(?=[A-Za-z0-9_])|{_EDGE_AFTER})",
        rf"(?i){_EDGE_BEFORE}[0-9]+{BLANK}*(?:GB|TB){_EDGE_AFTER}",
        rf"(?i){_EDGE_BEFORE}(?:{'|'.join(COLOURS)}){_EDGE_AFTER}",
    ):
        out = F.regexp_replace(out, pattern, "")
    return F.lower(collapse(out))


def without_brackets(x: Text) -> Column:
    return F.regexp_replace(col(x), rf"{BLANK}*\([^)]*\)", "")


def tokens(x: Text) -> Column:
    """Lower-cased parts between blanks, repeats included; none for a null."""
    parts = F.split(F.lower(F.coalesce(col(x), F.lit(""))), f"{BLANK}+")
    return F.filter(parts, lambda t: t != "")


def _capacity(x: Column, unit: str) -> Column:
    found = F.regexp_extract(x, rf"(?i)([0-9]+(?:\.[0-9]+)?){BLANK}*{unit}", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def ram_gb(x: Text) -> Column:
    """The first size in GB; null without one or if it isn't above zero."""
    v = _capacity(col(x), "GB")
    return F.when(v > 0, v)


def rom_gb(x: Text) -> Column:
    """The first size in TB, times 1024, else the first in GB; null unless above zero."""
    v = F.coalesce(_capacity(col(x), "TB") * 1024.0, _capacity(col(x), "GB"))
    return F.when(v > 0, v)


def rating_prefix(x: Text) -> Column:
    return F.nullif(F.regexp_extract(trim(x), r"^([0-9]+\.?[0-9]*)", 1), F.lit(""))


def absolute_link(link: Text, host: str) -> Column:
    """Links that start with "http" as they are, others behind the host; an empty or missing one is null."""
    v = F.nullif(col(link), F.lit(""))
    return F.when(v.startswith("http"), v).otherwise(F.concat(F.lit(host), v))


def joined_bullets(items: Text) -> Column:
    """Trimmed non-empty items with " | " between; null without any."""
    kept = F.filter(F.transform(col(items), trim), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.nullif(F.array_join(kept, " | "), F.lit(""))


def url_slashes(x: Text) -> Column:
    """Backslashes turned, and exactly two slashes behind http: and https:."""
    return F.regexp_replace(F.regexp_replace(col(x), r"\\", "/"), r"(?i)^(https?):/+", "$1://")


def clean_json(x: Text) -> Column:
    """JSON text without line-break escapes, with single spaces and none next to quotes; spaces inside strings suffer."""
    out = F.regexp_replace(F.regexp_replace(col(x), r"\\n", ""), f"{BLANK}+", " ")
    return F.regexp_replace(out, rf'{BLANK}*"{BLANK}*', '"')


def bearer_token(header: Text) -> Column:
    return F.nullif(F.regexp_extract(col(header), r"(?i)^Bearer (.+)$", 1), F.lit(""))


#: Schemes whose addresses have a host and a path that links are relative to.
HIERARCHICAL = ("http", "https", "ftp", "file", "ws", "wss")
_SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"


def _parts(x: Column) -> dict[str, Column]:
    """An address in parts, without their marks: scheme, host, path, query, fragment."""
    plain = F.regexp_replace(F.regexp_replace(x, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    rest = F.regexp_replace(plain, _SCHEME, "")
    part = lambda pattern: F.regexp_extract(rest, "(?s)" + pattern, 1)
    return {"scheme": F.lower(F.regexp_extract(plain, _SCHEME, 1)), "host": part("^//([^/?#]*)"), "path": part("^(?://[^/?#]*)?([^?#]*)"), "query": part(r"^[^?#]*\?([^#]*)"), "fragment": part("^[^#]*#(.*)")}


def _without_dots(segments: Column) -> Column:
    """A path's segments after "." and ".." have done their work; one of these at the end leaves a folder."""
    step = lambda kept, s: F.when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.array_append(kept, s))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)


def resolved(base: Column | str, href: Column | str) -> Column:
    """The absolute address of a page's link: RFC 3986 in columns. Web and file addresses stay as they are, and so do links
    without a base and, against a base of another kind, those that have a scheme. An empty link is its base."""
    b, h = col(base), col(href)
    own, of = _parts(h), _parts(b)
    relative = of["scheme"].isin(*HIERARCHICAL) & ((own["scheme"] == "") | (own["scheme"] == of["scheme"]))
    # Parameters of the last segment aren't part of its name, where a scheme has any.
    parameters = F.when(of["scheme"].isin("http", "https", "ftp"), F.regexp_extract(own["path"], "(?s)^(?:.*/)?[^/;]*(;[^/]*)$", 1)).otherwise(F.lit(""))
    path = F.substring(own["path"], F.lit(1), F.length(own["path"]) - F.length(parameters))
    folder = F.slice(F.split(of["path"], "/"), F.lit(1), F.greatest(F.size(F.split(of["path"], "/")) - 1, F.lit(0)))
    joined = F.concat(F.when(F.size(folder) > 0, folder).otherwise(F.array(F.lit(""))), F.split(path, "/"))
    n = F.size(joined)
    inner = F.filter(F.slice(joined, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s: s != "")
    merged = F.concat(F.slice(joined, 1, 1), inner, F.slice(joined, n, F.lit(1)))
    placed = F.array_join(_without_dots(F.when(path.startswith("/"), F.split(path, "/")).otherwise(merged)), "/")
    bare = (own["path"] == "") & (own["host"] == "")
    whole = F.when(own["host"] != "", own["path"]).when(bare, of["path"]).otherwise(F.concat(F.when(placed == "", F.lit("/")).otherwise(placed), parameters))
    rooted = F.when((whole != "") & ~whole.startswith("/"), F.concat(F.lit("/"), whole)).otherwise(whole)
    query = F.when(bare & (own["query"] == ""), of["query"]).otherwise(own["query"])
    marked = lambda mark, x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise(F.lit(""))
    host = F.when(own["host"] != "", own["host"]).otherwise(of["host"])
    address = F.concat(of["scheme"], F.lit("://"), host, rooted, marked("?", query), marked("#", own["fragment"]))
    stays = h.rlike("(?i)^(https?://|file://)") | ((h != "") & ~relative) | (b == "") | b.isNull()
    return F.when(h.isNull() | stays, h).when(h == "", b).otherwise(address)
