"""Text functions as Column expressions: repair, slugs, years, chunks, answers of a model, imprint pages, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, in a form that Java's and RE2's expressions both read.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Wrongly decoded sequences and what they stand for, replaced in this order.
MOJIBAKE = (
    ("Ã¼", "ü"), ("Ãœ", "Ü"), ("Ã¶", "ö"), ("Ã–", "Ö"), ("Ã¤", "ä"), ("Ã„", "Ä"), ("ÃŸ", "ß"), ("Å¿", "ß"), ("Ã©", "é"),
    ("â€“", "-"), ("â€”", "-"), ("â€", '"'), ("â€œ", '"'), ("Ã ", "à"), ("Ã¡", "á"), ("Ã²", "ò"), ("Ã³", "ó"), ("Â", ""),
)
#: German letters in ASCII.
UMLAUTS = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))
#: What counts as no year.
NO_VALUE = ("", "unbekannt", "unknown", "?", "-", "N/A")
#: Legal forms that are left out of a company's address.
LEGAL_FORMS = ("gmbh", "ag", "kg", "ohg", "gbr", "ug", "eg", "ev", "mbh", "co", "&", "und")
#: Patterns of imprint pages.
IMPRINT_URL = "impressum|legal|about|contact|company|terms"
ADDRESS = r"(Adresse|Impressum|Company\sAddress|Registered\sOffice)"
REGISTER = r"(Amtsgericht|Registration\sCourt|Handelsregister|Registergericht)"
REGISTER_NUMBER = r"(HRB|HRA|VR|GnR|PartR|HRB\sEWR|WR|GeR)\s?\d{1,5}"
#: The last year of a name is the last match of this.
YEAR = r"(1[89]\d{2}|20\d{2})"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: Column, pairs) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs, c)


def where_any(c: Column, characters: str, change) -> Column:
    """change(c) where c holds any of the characters, else c: most texts need one look instead of all replacements."""
    inside = "".join(f"\\x{{{ord(x):x}}}" for x in dict.fromkeys(characters))
    # the text is a variable in here, so what was done to it before is done once
    once = F.transform(F.array(c), lambda x: F.when(F.regexp_like(x, F.lit(f"[{inside}]")), change(x)).otherwise(x))
    return F.element_at(once, 1)


def strip(c: Column | str) -> Column:
    """Without white space, as Unicode has it, at both ends."""
    return F.regexp_replace(_column(c), rf"\A{WS}+|{WS}+\z", "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space alone, as Unicode has it."""
    return ~F.regexp_like(F.coalesce(_column(c), F.lit("")), F.lit(WS.replace("[", "[^", 1)))


def normalize_text(c: Column | str) -> Column:
    """Repair and transliterate German text; null and '' stay as they are.

    A text that reads as UTF-8 when taken for Latin-1 bytes is decoded so as a whole; then fixed replacements, long s,
    umlauts; stray accents go and white space collapses."""
    c = _column(c)
    latin = F.octet_length(c) > F.length(c)  # text of ASCII alone reads the same
    bytes_ = F.encode(F.when(latin & F.regexp_like(c, F.lit(r"\A[\x00-\xff]*\z")), c), "ISO-8859-1")
    c = F.coalesce(F.try_validate_utf8(bytes_.cast("string")), c)
    c = where_any(c, "".join(a[0] for a, _ in MOJIBAKE), lambda x: replace_all(x, MOJIBAKE))
    c = where_any(c, "ſ" + "".join(a for a, _ in UMLAUTS), lambda x: replace_all(x, [("ſ", "s"), *UMLAUTS]))
    c = where_any(c, "~`^¨´", lambda x: F.regexp_replace(x, "[~`^¨´]", ""))
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def clean_uri(c: Column | str) -> Column:
    """Local name of an IRI; an empty or null text is 'unknown'."""
    c = _column(c)
    ascii_ = where_any(strip(c), "".join(a for a, _ in UMLAUTS), lambda x: replace_all(x, UMLAUTS))
    slug = F.regexp_replace(F.replace(ascii_, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]+", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(slug)


def court_slug(c: Column | str) -> Column:
    """Register courts keep upper-case umlauts and most punctuation."""
    lower = [kv for kv in UMLAUTS if kv[0].islower()]
    return replace_all(_column(c), [(" ", "_"), ("(", ""), (")", ""), *lower])


def state_slug(c: Column | str) -> Column:
    return replace_all(_column(c), [(" ", ""), *[kv for kv in UMLAUTS if kv[0].islower()]])


def register_types(c: Column | str) -> Column:
    """Slugs of a comma list, as an array; null for null."""
    lower = [kv for kv in UMLAUTS if kv[0].islower()]
    return F.transform(F.split(_column(c), ","), lambda x: replace_all(strip(x), [(" ", "_"), *lower, ("-", "_"), (".", "")]))


def iso_date(c: Column | str) -> Column:
    """d.m.y as y-mm-dd, padded but not checked; null unless there are three parts."""
    parts = F.split(_column(c), r"\.")
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    return F.when(F.size(parts) == 3, F.concat_ws("-", parts[2], pad(parts[1]), pad(parts[0])))


def is_code(c: Column | str) -> Column:
    """A future code that says something."""
    return ~F.lower(F.coalesce(_column(c), F.lit(""))).isin("nan", "none", "")


def version_of(name: Column | str) -> Column:
    """Two digits before .xlsx, or null."""
    v = F.regexp_extract(_column(name), r"(\d{2})\.xlsx$", 1)
    return F.when(v != "", v).cast("int")


def last_year(name: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(_column(name), F.lit(YEAR), F.lit(1)), F.lit(-1)).cast("int")


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_column(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """The last part of a path without its ending."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative_path(path: Column | str, root: Column | str) -> Column:
    """path below root; null if it is not."""
    path, root = _column(path), F.concat(F.rtrim(_column(root), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path)))


def join_path(*parts: Column | str) -> Column:
    """Parts of a path with one slash between them."""
    return F.concat_ws("/", *[F.rtrim(_column(p), F.lit("/")) for p in parts])


def year_value(c: Column | str) -> tuple[Column, Column]:
    """(lexical form, whether it is an xsd:gYear) of a year's text; null where it stands for no value."""
    c = strip(c)
    digits = F.replace(c, F.lit("."), F.lit(""))
    number = F.when(F.regexp_like(digits, F.lit(r"^\d+$")), F.try_to_number(F.substring(digits, 1, 9), F.lit("999999999"))).cast("int")
    good = F.coalesce(F.regexp_like(digits, F.lit(r"^\d+$")) & (F.length(digits) < 9) & number.between(1, 9998), F.lit(False))
    none = F.coalesce(c.isin(*NO_VALUE), F.lit(True))
    return F.when(~none, F.when(good, digits).otherwise(c)), ~none & good


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_column(c), F.lit("")), f"{WS}+"), lambda x: x != "")


def chunk_words(c: Column | str, max_words: int = 500, overlap: int = 50, mode: str = "compat") -> Column:
    """Texts of consecutive word windows, as an array.

    mode 'compat': windows follow each other whatever the overlap, which is what the published procedure does; 'sliding':
    each starts overlap words before the end of the one before."""
    if max_words <= 0 or overlap < 0:
        raise ValueError("max_words must be positive and overlap not negative")
    step = max_words if mode == "compat" else max_words - overlap
    if step <= 0:
        raise ValueError("sliding windows must advance")
    empty = F.expr("cast(array() as array<int>)")

    def windows(w: Column) -> Column:
        # a sliding window that starts where the one before has already reached the end says nothing new
        last = F.size(w) - 1 if mode == "compat" else F.greatest(F.lit(0), F.size(w) - overlap - 1)
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(empty)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, max_words), " "))

    return F.flatten(F.transform(F.array(words(c)), windows))  # the words are a variable in here, so a text is split once


def json_objects(c: Column | str) -> Column:
    """Flat objects in a model's answer, whatever stands around them."""
    return F.regexp_extract_all(_column(c), F.lit(r"\{[\s\S]*?\}"), F.lit(0))


def strip_code_fence(c: Column | str) -> Column:
    """An answer without code fences: its outermost object if there is one, else the trimmed text."""
    c = strip(F.regexp_replace(F.regexp_replace(_column(c), r"(?i)```json\s*", ""), r"(?m)```\s*$", ""))
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(c)


#: Where each provider puts the answer's text.
ANSWER_PATHS = {"ollama": "$.message.content", "openai": "$.choices[0].message.content", "generate": "$.response"}


def answer_text(response: Column | str, provider: str) -> Column:
    return F.get_json_object(_column(response), ANSWER_PATHS[provider])


def company_key(c: Column | str) -> Column:
    """Lower-case name without punctuation and legal forms."""
    kept = F.regexp_replace(F.lower(_column(c)), rf"[^\p{{L}}\p{{N}}_\x09-\x0d\x1c-\x20\x{{85}}\x{{a0}}-]", "")
    return F.array_join(F.filter(words(kept), lambda x: ~x.isin(*LEGAL_FORMS)), " ")


def url_variations(c: Column | str) -> Column:
    """Addresses where a company may be found, in a fixed order without repeats."""
    key = company_key(c)
    parts = words(key)
    acronym = F.array_join(F.transform(parts, lambda x: F.substring(x, 1, 1)), "")
    bases = F.array(*[F.replace(key, F.lit(" "), F.lit(j)) for j in ("", "-", "_")])
    bases = F.when((F.size(parts) > 1) & (F.length(acronym) > 1), F.array_append(bases, acronym)).otherwise(bases)
    forms = [(f"{scheme}://{www}", tld) for tld in (".de", ".com") for scheme in ("https", "http") for www in ("www.", "")]
    return F.array_distinct(F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(F.lit(h), b, F.lit(t)) for h, t in forms]))))


def is_imprint_url(url: Column | str) -> Column:
    return F.regexp_like(F.lower(_column(url)), F.lit(IMPRINT_URL))


def imprint_score(text: Column | str) -> Column:
    """0 to 3: speaks of an address, of a register, has a register number."""
    text = _column(text)
    tests = ("(?iu)" + ADDRESS, "(?iu)" + REGISTER, REGISTER_NUMBER)
    return reduce(lambda a, b: a + b, [F.coalesce(F.regexp_like(text, F.lit(t)), F.lit(False)).cast("int") for t in tests])


def keyword_context(text: Column | str, reach: int = 500) -> Column:
    """struct(start, matched, context) of the first register keyword; null without one. start counts from 0."""
    text = _column(text)
    found = F.regexp_extract(text, REGISTER, 0)
    before = F.length(F.element_at(F.split(text, REGISTER, 2), 1))
    first = F.greatest(before - reach, F.lit(0))
    context = F.substring(text, (first + 1).cast("int"), (before + F.length(found) + reach - first).cast("int"))
    return F.when(found != "", F.struct(before.alias("start"), found.alias("matched"), context.alias("context")))


def clean_label(iri: Column | str) -> Column:
    """The fragment of an IRI, else its last non-empty path segment, with spaces for underscores."""
    iri = _column(iri)
    fragment = F.regexp_extract(iri, r"#(.+)$", 1)
    path = F.regexp_replace(F.regexp_replace(iri, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    tail = F.regexp_extract(path, r"([^/]*)/?$", 1)
    return F.replace(F.when(fragment != "", fragment).otherwise(tail), F.lit("_"), F.lit(" "))


#: Colours of node types, and of all others.
COLORS = {"Company": "#4CAF50", "Court": "#2196F3"}
OTHER_COLOR = "#9E9E9E"


def node_color(kind: Column | str) -> Column:
    """Colour of a node's type, or of the first known one in a comma list."""
    kind = _column(kind)
    first = F.try_element_at(F.filter(F.split(kind, ", "), lambda t: t.isin(*COLORS)), F.lit(1))
    return reduce(lambda x, kv: x.when(first == kv[0], kv[1]), COLORS.items(), F.when(F.lit(False), "")).otherwise(OTHER_COLOR)


def node_size(kind: Column | str) -> Column:
    return F.when(_column(kind).contains("Company"), 25).when(_column(kind).contains("Court"), 35).otherwise(20)


def clean_string(c: Column | str) -> Column:
    """Lower case without white space, hyphens, points, commas and double oblique hyphens; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_column(c), F.lit(""))), WS, ""), "[-.,⸗]", "")


def contains_match(a: Column | str, b: Column | str) -> Column:
    """1 if either contains the other, whatever the case; 0 if one is null or ''."""
    a, b = (F.lower(F.coalesce(_column(x), F.lit(""))) for x in (a, b))
    return ((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))).cast("int")


def equal_match(a: Column | str, b: Column | str) -> Column:
    """1 if both are equal but for case and outer white space; 0 if one is null or ''."""
    x, y = (F.coalesce(_column(c), F.lit("")) for c in (a, b))
    return ((x != "") & (y != "") & (strip(F.lower(x)) == strip(F.lower(y)))).cast("int")
