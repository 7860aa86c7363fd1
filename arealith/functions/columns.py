"""Column expressions of areal work: rates, ratios, bins, classifiers, distances, tails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the published rational approximation of erfc (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
EARTH_KM = 6371.0088


def rate(count: Column, population: Column, per: float = 100_000.0) -> Column:
    """Events per ``per`` inhabitants; null without inhabitants."""
    return F.try_divide(count.cast("double") * per, population.cast("double"))


def ratio(observed: Column, expected: Column) -> Column:
    """Observed over expected; 0 where nothing is expected."""
    return F.when(expected > 0, observed.cast("double") / expected).otherwise(F.lit(0.0))


def cut_right(x: Column, edges: list[float]) -> Column:
    """Right-closed bins (a, b], numbered from 1; null outside."""
    out = None
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
        test = (x > a) & (x <= b)
        out = F.when(test, k) if out is None else out.when(test, k)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def hot_cold(z: Column, bound: float = 1.96) -> Column:
    """Labels of a score: strict bounds, isolated first."""
    return F.when(z.isNull(), "isolated").when(z > bound, "hot").when(z < -bound, "cold").otherwise("not significant")


def safe_int(text: Column) -> Column:
    """Integers of census cells: ``-``, blanks and unreadable cells are 0."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def coordinate_class(lat: Column, lon: Column, box: tuple[float, float, float, float] = (20.0, 46.0, 122.0, 154.0)) -> Column:
    """Why a pair of coordinate texts is usable or not; the order of the tests matters, bounds are exclusive."""
    la, lo = lat.try_cast("double"), lon.try_cast("double")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(lat) | blank(lon), "missing")
        .when(la.isNull() | lo.isNull(), "unparseable")
        .when((la == 0) & (lo == 0), "sentinel")
        .when((la > box[0]) & (la < box[1]) & (lo > box[2]) & (lo < box[3]), "ok")
        .otherwise("out_of_range")
    )


def erfc(x: Column) -> Column:
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * a)
    inner = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        inner = F.lit(c) + t * inner
    tail = t * F.exp(-a * a + inner)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def upper_tail(z: Column) -> Column:
    return 0.5 * erfc(z / F.sqrt(F.lit(2.0)))


def great_circle_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance on a sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def relative_difference(value: Column, reference: Column) -> Column:
    """0 where both are 0, null where only the reference is, else the absolute difference over the reference."""
    return F.when((value == 0) & (reference == 0), F.lit(0.0)).when(reference == 0, F.lit(None).cast("double")).otherwise(F.abs(value - reference) / F.abs(reference))


def occurrences(text: Column, word: str) -> Column:
    """How often a string occurs, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def parent_code(code: Column, width: int = 4, prefix: int = 2) -> Column:
    """Prefix of a zero-padded code."""
    return F.substring(F.lpad(code.cast("string"), width, "0"), 1, prefix)


def hash_uniform(*keys: Column) -> Column:
    """A uniform number in (0, 1) out of an md5, the same in every engine."""
    h = F.md5(F.concat_ws("|", *(k.cast("string") for k in keys)))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def resolved_path(base: Column, link: Column) -> Column:
    """The path that a link leads to from a page's path: query and anchor off, relative to the page's folder, dots resolved.

    Null for links to other hosts and to anchors of the page. What would lie above the root is at the root.
    """
    bare = F.regexp_replace(link, "[?#].*$", "")
    outside = link.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:|//|#)") | (bare == "")
    return F.when(~outside, F.concat(F.lit("/"), F.array_join(_walked(base, bare)["at"], "/")))


def leaves_root(base: Column, link: Column) -> Column:
    """Whether a relative link goes up beyond the root on its way."""
    return _walked(base, F.regexp_replace(link, "[?#].*$", ""))["out"]


def _walked(base: Column, bare: Column) -> Column:
    """``(at, out)``: the folders and file of a path as a stack, and whether it was ever left at its foot."""
    path = F.when(bare.startswith("/"), bare).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), bare))
    steps = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    at = lambda stack, out: F.struct(stack.alias("at"), out.alias("out"))
    up = lambda s: F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0)))
    move = lambda s, x: F.when(x == "..", at(up(s), s["out"] | (F.size(s["at"]) == 0))).when(x == ".", s).otherwise(at(F.concat(s["at"], F.array(x)), s["out"]))
    # A path that ends with dots is that of a folder.
    ended = lambda s: F.when(F.element_at(steps, -1).isin(".", ".."), at(F.concat(s["at"], F.array(F.lit(""))), s["out"])).otherwise(s)
    return F.aggregate(steps, at(F.array().cast("array<string>"), F.lit(False)), move, ended)


def unescaped(path: Column) -> Column:
    """Percent escapes of a path undone; a path with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def dealt_rank(rank: Column, n: Column, *keys: Column, rounds: int = 6, walks: int = 60) -> Column:
    """A permutation of 0 to n - 1 for every key: where it puts a rank, the same in every engine.

    A Feistel network over the bits of n, keyed by md5, is a permutation of the next power of two; a rank that leaves
    the range is walked on until it is back (half of all steps are; 60 walks miss with probability below 2^-60).
    """
    bits = F.greatest(F.length(F.bin(n - 1)), F.lit(1)).cast("int")
    low = F.ceil(bits / 2).cast("int")
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
    half = lambda r, v: F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), r.cast("string"), v.cast("string"))), 1, 8), 16, 10).cast("long")
    high_part = lambda x: F.call_function("shiftright", x, low)
    upper = lambda x, r: x.bitwiseXOR(F.call_function("shiftleft", half(r, x.bitwiseAND(mask(low))).bitwiseAND(mask(bits - low)), low))
    lower = lambda x, r: x.bitwiseXOR(half(r, high_part(x)).bitwiseAND(mask(low)))
    mixed = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, lambda y, r: F.when(r % 2 == 0, upper(y, r)).otherwise(lower(y, r)))
    return F.aggregate(F.sequence(F.lit(2), F.lit(walks)), mixed(rank.cast("long")), lambda x, _: F.when(x < n, x).otherwise(mixed(x)))
