"""URL parts as column expressions. A null or malformed URL gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without a leading ``www.`` and without a port."""
    name = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    return F.nullif(name, F.lit(""))


def path_segments(url: Column) -> Column:
    """Non-empty path segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def locale(segments: Column) -> Column:
    """The first segment if it is two lower-case letters."""
    first = F.try_element_at(segments, F.lit(1))
    return F.when(first.rlike("^[a-z]{2}$"), first)


def section(segments: Column) -> Column:
    """The segment after the locale, or the first one if there is no locale."""
    return F.when(locale(segments).isNotNull(), F.try_element_at(segments, F.lit(2))).otherwise(F.try_element_at(segments, F.lit(1)))


def content_type(segments: Column, blog: str, news: str) -> Column:
    """blog if a segment is the blog marker, else news if one is the news marker, else other."""
    return F.when(F.array_contains(segments, blog), "blog").when(F.array_contains(segments, news), "news").otherwise("other")


def registrable_domain(name: Column) -> Column:
    """The last two labels of a host; no public-suffix list."""
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(name)


def host_excluded(name: Column, excluded: Sequence[str]) -> Column:
    """The host equals an excluded one or lies below it; leading dots and case of the list are ignored."""
    hosts = sorted({h for x in excluded if (h := x.strip().lower().lstrip("."))})
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (name == h) | name.endswith("." + h)
    return F.coalesce(hit, F.lit(False))


def on_domain(name: Column, primary: str, strict: bool = False) -> Column:
    """The host ends in ``primary``; only at a dot if ``strict``."""
    return ((name == primary) | name.endswith("." + primary)) if strict else name.endswith(primary)


def slug(text: Column, length: int = 48, default: str = "rule") -> Column:
    """Lower case, every other character an underscore, none at the ends, cut; ``default`` if nothing is left."""
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "_")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(flat, "^_+|_+$", ""), F.lit(length)), F.lit("")), F.lit(default))


#: The parts of a reference: scheme, what follows ``//``, path, query and fragment, each empty or with its mark.
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(reference: Column, group: int) -> Column:
    return F.regexp_extract(reference, "(?s)" + PARTS, group)


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; ``..`` above the top is dropped."""
    rooted, parts = path.startswith("/"), F.split(path, "/")
    last = F.element_at(parts, -1)
    inner = F.when(rooted, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    kept = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    flat = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), flat).otherwise(path)


def resolve(base: Column, reference: Column) -> Column:
    """A reference as it reads on the page ``base``, without its fragment (RFC 3986, section 5.2, not strict).

    White space at the ends of the reference is ignored, and so are an empty query and the
    page's own scheme before a path; an empty reference names the page itself. References
    with a scheme or host of their own stay as they are.
    """
    ref = F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    b_scheme, b_host, b_path, b_query = F.lower(_part(base, 1)), *(_part(base, k) for k in (2, 3, 4))
    host_, path, query = _part(ref, 2), _part(ref, 3), F.regexp_replace(_part(ref, 4), r"^\?$", "")
    own = F.lower(_part(ref, 1)) == b_scheme
    scheme = F.when(own & (host_ == ""), "").when(own, b_scheme).otherwise(_part(ref, 1))
    folder = F.when((b_host != "") & (b_path == ""), "/").otherwise(F.regexp_extract(b_path, "(?s)^(.*/)[^/]*$", 1))
    merged = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    return (
        F.when(scheme != "", F.concat(scheme, host_, path, query))
        .when(host_ != "", F.concat(b_scheme, host_, path, query))
        .when(path == "", F.concat(b_scheme, b_host, b_path, F.when(query != "", query).otherwise(b_query)))
        .otherwise(F.concat(b_scheme, b_host, without_dots(merged), query))
    )
