"""Text functions: tokenizers, stop lists, addresses, dates, snippets' scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A short list of words left out of queries by default. Fixed values.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can did do does doing down during each few for from further had has have having he her here hers herself him himself "
    "his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours "
    "ourselves out over own same she should so some such than that the their theirs them themselves then there these they "
    "this those through to too under until up very was we were what when where which while who whom why will with you your "
    "yours yourself yourselves"
).split()
#: Months by name. Fixed values.
MONTHS = "january february march april may june july august september october november december".split()


#: Lists by name. Users add their own, or read them from files with ``word_list``.
WORD_LISTS: dict[str, list[str]] = {"short": STOPWORDS, "months": MONTHS}


def word_list(name: str, folder: str | None = None) -> list[str]:
    """A list of words or phrases by name: a registered one, or the lines of ``<folder>/<name>``,
    lower-cased, without blank lines, comments (``#``) and repeats, in order."""
    if name in WORD_LISTS:
        return WORD_LISTS[name]
    if folder is None:
        raise KeyError(f"no list {name}")
    with open(f"{folder}/{name}", encoding="utf-8") as f:
        rows = [" ".join(x.split("#")[0].lower().split()) for x in f]
    return list(dict.fromkeys(x for x in rows if x))


def simple_tokens(text: Column) -> Column:
    """Array of tokens: tags dropped, runs of ASCII letters and digits, then lower-cased.

    Lower-casing comes last, so that no other letter turns into an ASCII one. Null text has no
    tokens (an empty array).
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    return F.transform(F.regexp_extract_all(bare, F.lit("[a-zA-Z0-9]+"), F.lit(0)), F.lower)


def simple_token_count(text: Column) -> Column:
    """How many tokens ``simple_tokens`` gives, without making them."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    return F.regexp_count(bare, F.lit("[a-zA-Z0-9]+"))


def newline_tokens(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def stop_filter(tokens: Column, words: list[str], keep: bool = False) -> Column:
    """Tokens in (``keep``: not in) the list become null; positions stay as they are."""
    listed = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    inside = lambda t: F.array_contains(listed, t)
    return F.transform(tokens, lambda t: F.when(inside(t) if keep else ~inside(t), t))


def scrub_url(url: Column) -> Column:
    """Lower-cased address without default port, fragment mark at the end and trailing slash."""
    u = F.regexp_replace(F.lower(F.trim(url)), "#$", "")
    u = F.regexp_replace(u, ":80(?=/|$)", "")
    return F.regexp_replace(u, "/$", "")


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments resolved; ``..`` above the
    root is dropped. A path that ends in one of them keeps a slash at its end."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def step(done: Column, x: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    end = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def join_url(base: Column, link: Column) -> Column:
    """The address a link of a page points to, as RFC 3986 resolves references, by built-in
    functions. The fragment is dropped; fragments alone, empty links and those of schemes that
    name no page (mail, script, data, telephone) are null, and so is a link of a null page."""
    ref = F.regexp_replace(F.trim(link), "#.*$", "")
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    own = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*(/[^?#]*)?", 1)
    query = F.regexp_extract(ref, r"(\?.*)$", 1)
    path = F.regexp_replace(ref, r"\?.*$", "")
    folder = F.regexp_replace(F.when(own == "", "/").otherwise(own), r"[^/]*$", "")
    other = F.regexp_extract(ref, r"^((?:[a-zA-Z][\w+.-]*:)?//[^/?#]*)", 1)
    rest = F.regexp_replace(path, r"^(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*", "")
    dotted = F.when(rest == "", "").otherwise(_without_dots(rest))
    return (
        F.when(link.rlike(r"(?i)^\s*(?:#|mailto:|javascript:|data:|tel:|sms:|about:|news:)") | (ref == "") | base.isNull(), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(scheme, other, dotted, query))
        .when(ref.rlike(r"^[a-zA-Z][\w+.-]*://"), F.concat(other, dotted, query))
        .when(ref.rlike(r"^[a-zA-Z][\w+.-]*:[^\d]"), ref)
        .when(ref.startswith("?"), F.concat(root, F.when(own == "", "/").otherwise(own), query))
        .when(ref.startswith("/"), F.concat(root, _without_dots(path), query))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), query))
    )


def year_of(text: Column) -> Column:
    """First year from 1000 to 2999 in a text, null without one."""
    y = F.regexp_extract(text, r"(?<!\d)([12]\d{3})(?!\d)", 1)
    return F.when(y != "", y.cast("int"))


def month_near_year(text: Column) -> Column:
    """Name of a month within three words of the first year, lower-cased; null without one."""
    names = "|".join(MONTHS)
    before = F.regexp_extract(F.lower(text), rf"({names})\W+(?:\w+\W+){{0,2}}[12]\d{{3}}(?!\d)", 1)
    after = F.regexp_extract(F.lower(text), rf"(?<!\d)[12]\d{{3}}\W+(?:\w+\W+){{0,2}}({names})", 1)
    return F.coalesce(F.when(before != "", before), F.when(after != "", after))
