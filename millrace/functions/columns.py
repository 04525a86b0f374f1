"""Scalar functions as Column expressions: text, URLs, numbers, dates, salaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32, INT16 = 2**31 - 1, 32767
#: Second-level labels under which names are registered (fixed values).
SECOND_LEVEL = ["com", "net", "org", "gov", "edu", "ac", "co"]


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "-"), trimmed)


def tolerant_int(text: Column) -> Column:
    """int(float(x)), or null."""
    return F.trim(text).try_cast("double").try_cast("int")


def iso_date(text: Column) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_timestamp(F.substr(text, F.lit(1), F.lit(10)), F.lit("yyyy-MM-dd")).cast("date")


def years_before(date: Column, years: int) -> Column:
    """The same day some years earlier; 29 February becomes 28."""
    return F.add_months(date, -12 * years)


def utc_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur."""
    return sum((F.lower(text).contains(w.lower()).cast("int") for w in words), F.lit(0))


def delimited(text: Column, limit: int = 200) -> Column:
    """Parts between commas (full-width ones too), trimmed, cut, without empty ones."""
    parts = F.transform(F.split(text, "[,，]"), lambda x: F.substr(F.trim(x), F.lit(1), F.lit(limit)))
    return F.filter(parts, lambda x: x != "")


def ordered_match(text: Column, words: dict[str, str], otherwise: str | None = None) -> Column:
    """The value of the first word (in declared order) that the text holds."""
    out = None
    for word, value in words.items():
        test = F.lower(text).contains(word.lower())
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(otherwise)


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)(?::\d*)?(?:[/?#]|$)", 1))


def normalized_url(url: Column) -> Column:
    """http(s) without credentials; scheme and host in lower case; no default port, no fragment. Others are null."""
    clean = F.trim(url)
    scheme = F.lower(F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    port = F.regexp_extract(clean, r"^[A-Za-z]+://[^/?#:@]+:(\d+)", 1)
    rest = F.regexp_extract(clean, r"^[A-Za-z]+://[^/?#]+([^#]*)", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    good = scheme.isin("http", "https") & (_host(clean) != "") & ~clean.rlike(r"^[A-Za-z]+://[^/?#]*@")
    return F.when(good, F.concat(scheme, F.lit("://"), _host(clean), F.when(default, "").otherwise(F.concat(F.lit(":"), port)), rest))


def identity_url(url: Column) -> Column:
    """Without the query too."""
    return F.regexp_replace(normalized_url(url), r"\?.*$", "")


def entry_url(url: Column) -> Column:
    """Without tracking parameters and trailing slash."""
    plain = normalized_url(url)
    base, query = F.substring_index(plain, "?", 1), F.when(F.instr(plain, "?") > 0, F.regexp_extract(plain, r"\?(.*)$", 1)).otherwise("")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(F.regexp_replace(base, "/$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def host(url: Column) -> Column:
    return _host(F.trim(url))


def root_domain(url: Column) -> Column:
    """The registrable domain: two labels, three below a second-level suffix such as co.uk."""
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    second = F.when(n >= 3, F.element_at(labels, F.when(n >= 3, -2).otherwise(-1))).otherwise("")
    take = F.when((n >= 3) & second.isin(SECOND_LEVEL) & (F.length(F.element_at(labels, -1)) == 2), 3).otherwise(F.least(n, F.lit(2)))
    return F.array_join(F.slice(labels, n - take + 1, take), ".")


def platform(url: Column, suffixes: dict[str, str], own: Column) -> Column:
    """The platform whose suffix ends the host, else `self_hosted` on the owner's domain, else `unknown`."""
    out = None
    for suffix, name in suffixes.items():
        test = (host(url) == suffix) | host(url).endswith(f".{suffix}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(root_domain(url) == own, "self_hosted").otherwise("unknown")


def statically_public(url: Column) -> Column:
    """Not an address literal or a local name."""
    h = host(url)
    return (h != "") & ~h.rlike(r"^[0-9.]+$|^\[|^localhost$|\.(local|internal|localhost)$") & h.contains(".")


_SALARY = r"^\s*(\d+(?:\.\d+)?)[kK]?\s*-\s*(\d+(?:\.\d+)?)[kK]\s*(?:[·x*]\s*(\d+)薪)?\s*$"


def salary(text: Column) -> Column:
    """Struct (low, high, months, warning) of `15-25K·14薪`, in units of one. Only exact amounts, low <= high and 32-bit bounds; else
    all null and the warning invalid_salary; null for null."""
    low, high, months = (F.regexp_extract(text, _SALARY, i) for i in (1, 2, 3))
    amount = [(F.when(x != "", x).try_cast("decimal(30,9)") * 1000) for x in (low, high)]
    count = F.when(months != "", months).try_cast("bigint")
    exact = (amount[0] % 1 == 0) & (amount[1] % 1 == 0) & (amount[0] <= amount[1]) & (amount[1] <= INT32)
    good = F.coalesce(exact, F.lit(False)) & ((months == "") | F.coalesce(count.between(1, INT16), F.lit(False)))
    value = F.struct(F.when(good, amount[0].try_cast("int")).alias("low"), F.when(good, amount[1].try_cast("int")).alias("high"), F.when(good, count.try_cast("smallint")).alias("months"), F.when(~good, "invalid_salary").alias("warning"))
    return F.when(text.isNotNull(), value)
