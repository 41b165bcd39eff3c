"""Column expressions for routes, names, texts and vectors. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_segments(x: Column | str, sep: str, n: int) -> Column:
    return F.substring_index(_c(x), sep, n)


def normal_route(x: Column | str) -> Column:
    """Lower-case segments without leading slashes and ``api/``; any parameter becomes {*}."""
    bare = F.regexp_replace(F.regexp_replace(_c(x), r"^/+", ""), r"^(?i)api/", "")
    return F.array_join(F.transform(F.split(bare, "/"), lambda s: F.when(s.rlike(r"^\{.*\}$"), F.lit("{*}")).otherwise(F.lower(s))), "/")


def routes_match(a: Column | str, b: Column | str) -> Column:
    """Two normal routes agree segment by segment, {*} on either side being anything."""
    x, y = F.split(_c(a), "/"), F.split(_c(b), "/")
    wild = lambda s: s == "{*}"
    return (F.size(x) == F.size(y)) & F.forall(F.zip_with(x, y, lambda p, q: (p == q) | wild(p) | wild(q)), lambda t: F.coalesce(t, F.lit(False)))


def url_pattern(x: Column | str) -> Column:
    """A URL without its query, template expressions as {param}."""
    return F.regexp_replace(F.substring_index(_c(x), "?", 1), r"\$\{[^}]*\}", "{param}")


def interpolation_pattern(x: Column | str) -> Column:
    """An interpolated string with its holes as {*} and double slashes as one."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"\{[^}]*\}", "{*}"), r"/{2,}", "/")


def plural(x: Column | str) -> Column:
    """The usual English plural of a name."""
    c = _c(x)
    return (
        F.when(c.rlike(r"(?i)[^aeiou]y$"), F.concat(F.regexp_replace(c, r"y$", ""), F.lit("ies")))
        .when(c.rlike(r"(?i)(s|x|z|ch|sh)$"), F.concat(c, F.lit("es")))
        .otherwise(F.concat(c, F.lit("s")))
    )


def token_estimate(x: Column | str) -> Column:
    """Tokens of a text at 4 characters each, a rest counting as one."""
    return F.ceil(F.length(_c(x)) / 4)


def clip_bytes(x: Column | str, n: int) -> Column:
    """At most n bytes of a line, cut between characters and marked with …."""
    c = _c(x)
    fits = F.aggregate(
        F.split(c, ""),
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda a, ch: F.when(a["full"] | (F.octet_length(a["s"]) + F.octet_length(ch) > n), F.struct(a["s"].alias("s"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["s"], ch).alias("s"), F.lit(False).alias("full"))),
        lambda a: a["s"],
    )
    return F.when(F.octet_length(c) > n, F.concat(fits, F.lit("…"))).otherwise(c)


def dot(a: Column | str, b: Column | str) -> Column:
    d = lambda v: F.transform(_c(v), lambda x: x.cast("double"))
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors, 0 where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def l2_distance(a: Column | str, b: Column | str) -> Column:
    d = lambda v: F.transform(_c(v), lambda x: x.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(d(a), d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def l2_normal(v: Column | str) -> Column:
    """A vector of length 1; one shorter than 1e-9 stays as it is."""
    c = F.transform(_c(v), lambda x: x.cast("double"))
    n = F.sqrt(dot(c, c))
    return F.when(n > 1e-9, F.transform(c, lambda x: x / n)).otherwise(c)


def module_fits(path: Column | str, module: Column | str) -> Column:
    """A file's path answers to a module name: its end, with dots as slashes, or else its last part somewhere."""
    bare = F.regexp_replace(F.regexp_replace(_c(module), r"^(\.{1,2}/)+", ""), r"\.(ts|tsx|js|cs)$", "")
    stem = F.regexp_replace(_c(path), r"\.(ts|tsx|js|cs)$", "")
    last = F.element_at(F.split(bare, r"[./]"), -1)
    return F.endswith(stem, bare) | F.endswith(stem, F.replace(bare, F.lit("."), F.lit("/"))) | ((F.length(last) > 0) & F.contains(_c(path), last))


def escape(pattern: str) -> str:
    """A literal as a regular expression."""
    return re.sub(r"([\\.^$*+?()\[\]{}|/-])", r"\\\1", pattern)


def match_words(query: str) -> list[str]:
    """The words of a content query that are long enough for three-letter sets, with quotes doubled as in a phrase."""
    return [w.replace('"', '""') for w in query.split() if len(w.encode()) >= 3]


def glob_regex(glob: str) -> str:
    """A path pattern: ``**`` any folders, ``*`` within one, ``?`` one character; one without a slash fits any file name."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + escape(glob[i]), i + 1
    return ("^" if "/" in glob else "(?:^|/)") + out + "$"


def in_scope(path: Column | str, language: Column | str, languages: list[str] | None = None, folder: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a file belongs to a search scope."""
    ok = F.lit(True)
    if languages:
        ok = ok & F.lower(_c(language)).isin([x.lower() for x in languages])
    if folder:
        ok = ok & F.startswith(_c(path), F.lit(folder.rstrip("/") + "/"))
    if include:
        ok = ok & _c(path).rlike("|".join(map(glob_regex, include)))
    if exclude:
        ok = ok & ~_c(path).rlike("|".join(map(glob_regex, exclude)))
    return ok
