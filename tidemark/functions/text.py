"""Text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(text: Column | str) -> Column:
    """Lower case, everything but ASCII letters and digits to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


@F.pandas_udf(T.StringType())
def folded_slug(texts: pd.Series) -> pd.Series:
    """slug() of the text without accents (NFKD, ASCII only)."""
    import re
    import unicodedata

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
        return re.sub("[^a-z0-9]+", "-", plain).strip("-")

    return texts.map(one)


@F.pandas_udf(T.StringType())
def entity_name(texts: pd.Series) -> pd.Series:
    """NFKC, lower case, punctuation to spaces, single spaces."""
    import re
    import unicodedata

    return texts.map(lambda t: None if t is None else " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", t).lower()).split()))


@F.pandas_udf(T.StringType())
def exact_name(texts: pd.Series) -> pd.Series:
    """NFKC, case folded, single spaces."""
    import unicodedata

    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def stream_title(text: Column | str) -> Column:
    """Without URLs and everything but letters and digits; single spaces; lower case."""
    plain = F.regexp_replace(F.lower(_col(text)), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9 ]", " "), " +", " "))


def facility_key(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]", "")


def split_list(text: Column | str, separator: str = ";") -> Column:
    """The parts that aren't empty; an empty array for null."""
    return F.filter(F.split(F.coalesce(_col(text), F.lit("")), separator), lambda x: x != "")


def alias_key(text: Column | str) -> Column:
    """Lower case, ``._,'’"-/`` to spaces, single spaces, runs of single letters folded (u s a: usa)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[._,'\u2019\"\\-/]", " "), r"(?U)\s+", " "))
    return F.regexp_replace(plain, r"(?U)(?<=\b[a-z]) (?=[a-z]\b)", "")


def strip_html(html: Column | str) -> Column:
    """Visible text: scripts, styles and comments out, tags to spaces, five entities decoded, single spaces."""
    text = F.regexp_replace(_col(html), r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", " "))


def clip(text: Column | str, limit: int) -> Column:
    """At most limit characters, the rest replaced by the number of characters left out. The
    suffix counts itself: its own digits take room, so the count follows from their number."""
    text = _col(text)
    n = F.length(text)
    out = text
    for digits in range(1, 8):
        suffix = len("… [+ chars]") + digits
        keep = max(limit - suffix, 0)
        left = n - keep
        made = F.concat(F.substring(text, 1, keep), F.lit("… [+"), left.cast("string"), F.lit(" chars]"))
        out = F.when((n > limit) & (F.length(left.cast("string")) == digits), made).otherwise(out)
    return out


def neutral_headers(text: Column | str) -> Column:
    """Lines that look like section headers or fences are quoted."""
    lines = F.split(_col(text), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*(#{1,6} |={3,}|-{3,}|```|\[[A-Z]+\])"), F.concat(F.lit("> "), x)).otherwise(x)), "\n")


def word_shingles(words: Column, n: int) -> Column:
    """Distinct n-word shingles; fewer words give one short shingle; none for no words. words
    should be a column, not an expression, which would be worked out anew for every shingle."""
    size = F.size(words)
    full = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(size == 0, F.array().cast("array<string>")).when(size < n, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(full))


def shingle_hashes(words: Column, n: int) -> Column:
    """word_shingles as distinct 64-bit hashes: eight bytes for each in a shuffle instead of n words, and sets of numbers to
    compare. Two shingles of one pair of texts share a hash with a chance of about their number squared in 2 ** 64."""
    size = F.size(words)
    full = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(F.slice(words, i + 1, n)))
    return F.when(size == 0, F.array().cast("array<bigint>")).when(size < n, F.array(F.xxhash64(words))).otherwise(F.array_distinct(full))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two sets in arrays; 0 if both are empty."""
    a, b = _col(a), _col(b)
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def provider_key(url: Column | str) -> Column:
    """Host without www and path in lower case; an id with a namespace stays."""
    text = F.lower(F.trim(_col(url)))
    host = F.regexp_replace(F.regexp_replace(text, "^[a-z]+://", ""), "[/?#].*$", "")
    return F.when(text.rlike("^[a-z0-9_-]+:[^/]"), text).otherwise(F.regexp_replace(host, r"^www\.", ""))


def normal_url(url: Column | str) -> Column:
    """Trimmed, scheme and host in lower case, the path's case kept, no slash at its end."""
    text = F.trim(_col(url))
    head = F.regexp_extract(text, r"^([A-Za-z]+://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substring(text, F.length(head) + 1, F.length(text))), "/+$", "")


def host_and_first_segment(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^[A-Za-z]+://([^/?#]+(?:/[^/?#]+)?)", 1))


#: What stands for no contractor.
_NOBODY = ("/", "n/a", "na", "", "-")


def contractors(text: Column | str) -> Column:
    """Names out of a list: a bracketed group with commas or ampersands first, then commas and
    semicolons, else ampersands; never "und". Placeholders and "etc" go."""
    text = F.trim(F.coalesce(_col(text), F.lit("")))
    inner = F.regexp_extract(text, r"\(([^)]+)\)", 1)
    source = F.when(inner.rlike("[,&]"), inner).otherwise(text)
    parts = F.when(source.rlike("[,;]"), F.split(source, r"\s*[,;]\s*")).otherwise(F.split(source, r"\s*&\s*"))
    names = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ .]+|[ .]+$", "")), lambda x: ~F.lower(x).isin(*_NOBODY, "etc"))
    return F.when(F.lower(text).isin(*_NOBODY), F.array().cast("array<string>")).otherwise(names)


#: German names of countries in lower case, and their names in the graph.
COUNTRIES = {
    "deutschland": "Germany", "frankreich": "France", "usa": "United States", "vereinigte staaten": "United States", "vereinigtes k\u00f6nigreich": "United Kingdom", "gro\u00dfbritannien": "United Kingdom",
    "italien": "Italy", "spanien": "Spain", "schweden": "Sweden", "norwegen": "Norway", "niederlande": "Netherlands", "schweiz": "Switzerland", "\u00f6sterreich": "Austria", "polen": "Poland", "israel": "Israel",
    "t\u00fcrkei": "T\u00fcrkiye", "finnland": "Finland", "belgien": "Belgium", "tschechien": "Czechia",
}
#: German states.
STATES = (
    "Baden-W\u00fcrttemberg", "Bayern", "Berlin", "Brandenburg", "Bremen", "Hamburg", "Hessen", "Mecklenburg-Vorpommern", "Niedersachsen", "Nordrhein-Westfalen", "Rheinland-Pfalz", "Saarland", "Sachsen",
    "Sachsen-Anhalt", "Schleswig-Holstein", "Th\u00fcringen",
)


def graph_country(name: Column | str) -> Column:
    """The graph's name of a country given in German; null for names that are not known. Letters with a separate diaeresis are
    read as one."""
    low = F.lower(F.trim(_col(name)))
    for letter, whole in (("a\u0308", "\u00e4"), ("o\u0308", "\u00f6"), ("u\u0308", "\u00fc")):
        low = F.replace(low, F.lit(letter), F.lit(whole))
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair]), low)


def headquarters(address: Column | str) -> Column:
    """city and country of an address, from its parts between commas before the first slash: a last part that is a German state or
    begins with a postal code is in Germany, any other is the country itself; the city has no postal code."""
    parts = F.filter(F.transform(F.split(F.get(F.split(_col(address), "/"), F.lit(0)), ","), lambda x: F.trim(x)), lambda x: x != "")
    tail, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    city = lambda x: F.nullif(F.trim(F.regexp_replace(x, r"^\d{4,5}\s*", "")), F.lit(""))
    coded = F.coalesce(tail.rlike(r"^\d{4,5}\s+\S"), F.lit(False))
    home = tail.isin(*STATES)
    return F.struct(F.when(coded & ~home, city(tail)).otherwise(city(before)).alias("city"), F.when(home | coded, "Deutschland").otherwise(tail).alias("country"))
