"""Scalar functions as Column expressions; Python is used only where none expresses the rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query words that carry no meaning, and parameters that only track.
STOP_WORDS = ("about", "from", "have", "what", "when", "where", "which", "while", "who", "worked", "work", "with")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "\u0000", ""), r"(?U)\s+", " "))


def without_tags(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, with the common entities resolved."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>", " "), r"(?s)<[^>]*+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return collapsed(bare)


def title_of(html: Column) -> Column:
    return F.nullif(collapsed(F.regexp_extract(html, r"(?is)<title[^>]*+>(.*?)</title>", 1)), F.lit(""))


def without_tail(text: Column, marker: str = "read more", times: int = 3) -> Column:
    """Text up to the first marker if it occurs often enough to be a list of related pages."""
    low = F.lower(text)
    count = (F.length(low) - F.length(F.replace(low, F.lit(marker), F.lit("")))) / len(marker)
    return F.when(count >= times, F.rtrim(F.substring(text, F.lit(1), F.instr(low, marker) - 1))).otherwise(text)


def title_case(text: Column) -> Column:
    return F.initcap(collapsed(text))


def organisation(text: Column) -> Column:
    head = F.split(text, " and ", 2)[0]
    return F.btrim(F.regexp_replace(F.btrim(head, F.lit(" ,.;:")), r"(?i)^the\s+", ""), F.lit(" ,.;:"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def header_key(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def alias_key(text: Column) -> Column:
    return F.lower(collapsed(text))


def query_terms(text: Column) -> Column:
    """Folded letter-led tokens of four characters or more that mean something, in first-seen order."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9'-]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*STOP_WORDS)))


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no default port, tracking parameter, fragment or trailing slash; query sorted, path never empty."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), r":(?:80|443)$", "")
    given = F.lower(F.regexp_extract(url, r"://[^/?#]*:(80|443)(?:[/?#]|$)", 1))
    port = F.when((scheme == "http") & (given == "443"), ":443").when((scheme == "https") & (given == "80"), ":80").otherwise("")
    path = F.regexp_replace(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    keyed = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.array_join(F.transform(F.array_sort(F.transform(keyed, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p")))), lambda x: x["p"]), "&")
    return F.concat(scheme, F.lit("://"), host, port, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def display_url(url: Column) -> Column:
    """A URL as it is shown: without scheme and fragment."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^#]*)", 1)
    bare = F.when(rest.rlike(r"^//[^/?]*$"), F.concat(rest, F.lit("/"))).otherwise(F.regexp_replace(rest, r"^(//[^/?]*)\?", "$1/?"))
    return F.when(rest == "", url).otherwise(bare)


def host_key(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1))


def idna(host: Column) -> Column:
    """A host in its ASCII form; Python runs only for rows with other characters."""

    @F.pandas_udf("string")
    def ascii_form(hosts):
        def one(h):
            try:
                return h.encode("idna").decode("ascii")
            except UnicodeError:
                return h

        return hosts.map(lambda h: None if h is None else one(h))

    return F.when(host.rlike(r"[^\x00-\x7F]"), ascii_form(host)).otherwise(host)


def root_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"://([^/?#:]*)", 1)), r"^www\.", "")


def in_scope(url: Column, root: Column) -> Column:
    host = root_host(url)
    return url.rlike("(?i)^https?://") & ((host == root) | host.endswith(F.concat(F.lit("."), root)))


def source_label(url: Column) -> Column:
    """Host without its last label, separators as spaces, in title case; what is no URL is cut at 34 characters."""
    text = F.trim(url)
    parts = F.split(root_host(text), r"\.")
    host = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    shown = F.array_join(F.transform(F.split(F.regexp_replace(host, "[-_]", " "), " "), lambda w: F.array_join(F.transform(F.split(w, r"\."), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), ".")), " ")
    short = F.when(F.length(text) > 34, F.concat(F.substring(text, 1, 31), F.lit("..."))).otherwise(text)
    return F.when(text == "", "").when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]"), F.coalesce(F.nullif(shown, F.lit("")), root_host(text))).otherwise(short)


def identifier(kind: Column, raw: Column, crawl_depth: Column | None = None) -> Column:
    """What a source is known by: the host of a domain; with a bounded crawl depth its page; a sitemap's own URL; else as given.

    Scheme, credentials, port, `www.`, query and fragment do not count.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    full = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("//"), text))
    place = F.lower(F.regexp_extract(full, r"//([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.substring_index(place, "@", -1), r":.*$", ""), r"^www\.", "")
    path = F.regexp_extract(full, r"//[^/?#]*([^?#;]*)", 1)
    page = F.concat(F.lit("https://"), host, F.when(path == "", F.lit("/")).otherwise(path))
    depth = crawl_depth if crawl_depth is not None else F.lit(None)
    sitemap = (host != "") & (F.lower(path).endswith(".xml") | F.contains(F.lower(path), F.lit("sitemap")))
    return F.when(kind != "domain", text).when(depth.isNotNull(), F.when(host == "", "").otherwise(page)).when(sitemap, page).otherwise(host)


def year_pattern(school: str = "") -> str:
    """A year of graduation: a lead, if any, and two or four digits. school: a name that may stand in the lead."""
    own = rf"(?:{school}\s+)?" if school else ""
    more = rf"{school}\s+['’]|" if school else ""
    return rf"(?i)(?<![A-Za-z0-9])(?:{own}T\s*['’]?\s*|class\s+of\s+['’]?\s*|{more}['’])?(\d{{2}}|\d{{4}})(?!\d)"


def class_year(text: Column, school: str = "") -> Column:
    """Graduation year: four digits from 1900, or two digits of which 50 and up belong to the 1900s."""
    digits = F.regexp_extract(F.trim(text), year_pattern(school), 1)
    n = F.nullif(digits, F.lit("")).cast("int")
    return F.when(F.length(digits) == 4, F.when(n >= 1900, n)).when(n >= 50, n + 1900).otherwise(n + 2000)


def leading_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^(\d{4})", 1), F.lit("")).cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double over the shorter length; 0 for empty or zero vectors."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((n > 0) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def sentence_trim(text: Column, longest: int) -> Column:
    """text cut to a length: after its last full sentence if that keeps a third, else with an ellipsis."""
    window = F.rtrim(F.substring(text, 1, longest))
    stop = F.length(F.regexp_extract(window, r"(?s)^(.*)[.?!] ", 1))
    whole = window.rlike(r"[.?!] ") & (stop >= longest // 3)
    return F.when(F.length(text) <= longest, text).when(whole, F.trim(F.substring(window, F.lit(1), stop + 1))).otherwise(F.concat(F.rtrim(window, F.lit(" ,.;:")), F.lit("...")))


def anchored_snippet(text: Column, anchor: Column, longest: int) -> Column:
    """From the start of the anchor's sentence over at most two ends of sentences after it, cut to a length."""
    whole, wanted = F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.trim(F.regexp_replace(F.coalesce(anchor, F.lit("")), r"(?U)\s+", " "))

    def cut(t: Column, a: Column) -> Column:
        index = F.when(a == "", F.lit(-1)).otherwise(F.position(F.lower(a), F.lower(t)) - 1)
        head = F.substring(t, F.lit(1), index)
        before = F.position(F.lit(" ."), F.reverse(head))
        start = F.when(before > 0, F.length(head) - before + 1).otherwise(0)
        near = index + F.length(a)
        first = F.position(F.lit(". "), t, near + 1)
        second = F.position(F.lit(". "), t, first + 1)
        end = F.when(first == 0, F.length(t)).when(first - start >= longest, first).when(second == 0, F.length(t)).otherwise(second)
        return F.when(F.length(t) <= longest, t).when(index < 0, sentence_trim(t, longest)).otherwise(sentence_trim(F.trim(F.substring(t, start + 1, end - start)), longest))

    # One struct binds the collapsed texts, so that they are made once.
    return F.get(F.transform(F.array(F.struct(whole.alias("t"), wanted.alias("a"))), lambda x: cut(x["t"], x["a"])), F.lit(0))


def snippet(text: Column, anchor: str, size: int = 200) -> Column:
    return anchored_snippet(text, F.lit(anchor), size)


def question_key(question: Column, history: Column | None = None) -> Column:
    """The key of a cached answer: the folded question with its history, as JSON."""
    fields = [F.lower(collapsed(question)).alias("question")]
    return F.to_json(F.struct(*([history.alias("history")] if history is not None else []), *fields))


def snapshot_time(text: Column) -> Column:
    """Seconds of an ISO-8601 time; null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(text))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, given as seconds or as an HTTP date; not below 0."""
    date = F.try_to_timestamp(F.regexp_extract(value, r"^[A-Za-z]{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), date.cast("double") - now))


def cost(model_price_in: Column, model_price_out: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return F.round((tokens_in * model_price_in + tokens_out * model_price_out) / 1_000_000, 6)


def model_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]], default: str) -> Column:
    """Cost of a call by its model's prices a million tokens; unknown models cost what the default does."""
    table = F.create_map(*[x for name, (a, b) in prices.items() for x in (F.lit(name), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    price = F.coalesce(table[model], table[F.lit(default)])
    return F.round((tokens_in * price["a"] + tokens_out * price["b"]) / 1_000_000, 6)


def vector_or_empty(vector: Column) -> Column:
    return F.coalesce(vector, F.array().cast("array<float>"))


def byte_vector(text: Column, size: int = 1536) -> Column:
    """A deterministic stand-in for an embedding: bytes of the folded text counted by place plus value, at length one."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def embed(texts):
        def one(t):
            raw = np.frombuffer((t or "").casefold().encode(), np.uint8)
            counts = np.bincount((np.arange(len(raw)) + raw) % size, minlength=size).astype(float)
            norm = np.sqrt((counts * counts).sum())
            return counts / norm if norm else counts

        return texts.map(one)

    return embed(text)


#: Small words by language: enough to tell which of them a text is written in.
SMALL_WORDS = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was", "as", "it"),
    "es": ("el", "los", "las", "y", "es", "que", "una", "con", "por", "del", "se", "en"),
    "fr": ("le", "les", "et", "est", "des", "une", "dans", "pour", "que", "du", "au", "la"),
}


def language_of(text: Column) -> Column:
    """The language whose small words a text has most of, null for a text with none of them; ties go by name."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    counts = F.transform(F.array(words), lambda w: F.array(*[F.struct(F.size(F.filter(w, lambda x: x.isin(*small))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, small) in enumerate(sorted(SMALL_WORDS.items()))]))
    best = F.array_max(F.get(counts, F.lit(0)))
    return F.when(best["n"] > 0, best["lang"])
