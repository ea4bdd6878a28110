"""Match keys as Column expressions: names, addresses, phones, hosts, hashes, distances, trigram similarity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without a canonical decomposition, and what they fold to.
LIGATURES = {"æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ß": "ss", "ẞ": "ss", "þ": "th", "Þ": "th"}
STROKES = {"ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l", "ı": "i", "ð": "d", "Ð": "d", "ħ": "h", "Ħ": "h", "ŧ": "t", "Ŧ": "t", "ŋ": "n", "Ŋ": "n", "ŀ": "l", "Ŀ": "l"}
# Word lists of the name key.
STOP_WORDS = ["el", "la", "los", "las", "de", "del", "y", "and", "the", "of"]
LEGAL_FORMS = [
    "llc", "inc", "co", "ltd", "corp", "dba", "lp", "llp", "pllc", "plc", "incorporated", "company", "corporation",
]
SPACED_LEGAL_FORMS = ["p l l c", "l l c", "l l p", "l p"]
TRADE_WORDS = ["taqueria", "carniceria", "panaderia"]
# Postal abbreviations of street types and directions.
STREET_TYPES = {"STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "ROAD": "RD", "HIGHWAY": "HWY", "EXPRESSWAY": "EXPY", "FREEWAY": "FWY", "PARKWAY": "PKWY", "LANE": "LN", "COURT": "CT", "CIRCLE": "CIR", "PLACE": "PL", "TRAIL": "TRL", "TERRACE": "TER", "PLAZA": "PLZ", "CENTER": "CTR", "SQUARE": "SQ"}
DIRECTIONS = {"NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW"}
# Designators that say nothing about which unit is meant.
UNIT_WORDS = ["STE", "SUITE", "UNIT", "APT", "APARTMENT", "NO", "NUM", "NUMBER", "RM", "ROOM", "SPC", "SPACE"]
# Host classes and their domains.
HOST_CLASSES = {
    "business_site_dead": ["business.site", "g.page"],
    "social": ["facebook.com", "instagram.com", "linktr.ee", "beacons.ai"],
    "directory": ["yelp.com", "yellowpages.com", "bbb.org", "nextdoor.com", "mapquest.com", "manta.com"],
    "platform_subdomain": ["wixsite.com", "square.site", "myshopify.com", "godaddysites.com"],
}
TOLL_FREE = ["800", "833", "844", "855", "866", "877", "888"]
EARTH_M = 6_371_000.0


def _accents() -> tuple[str, str]:
    """Every letter with marks up to the Greek extensions and its bare letter, from Unicode's own decompositions."""
    import unicodedata

    marked = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.normalize("NFD", chr(c)) != chr(c) and unicodedata.category(chr(c))[0] == "L"]
    bare = [unicodedata.normalize("NFD", c)[0] for c in marked]
    return "".join([*marked, *STROKES]), "".join([*bare, *STROKES.values()])


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it: a Column that is named twice is evaluated twice."""
    return F.transform(F.array(value), body)[0]


def fold(c: Column) -> Column:
    """Ligatures and accents folded to plain letters; combining marks removed. ASCII is left as it is."""

    def folded(c: Column) -> Column:
        for letter, plain in LIGATURES.items():
            c = F.replace(c, F.lit(letter), F.lit(plain))
        return F.regexp_replace(F.translate(c, *_accents()), r"\p{M}+", "")

    return _once(c, lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), folded(c)).otherwise(c))


def plain(text: str) -> str:
    """What :func:`fold` makes of a constant."""
    import unicodedata

    for letter, bare in (LIGATURES | STROKES).items():
        text = text.replace(letter, bare)
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M")


def _legal_run(before: str) -> str:
    return f"(?:(?:^| )(?:{'|'.join([*SPACED_LEGAL_FORMS, *[x for x in LEGAL_FORMS if x != 'dba']])}))+(?={before})"


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def name_parts(raw: Column) -> Column:
    """``struct(norm, had_store_number)``: the match key of a business name; ``norm`` is null if nothing is left."""
    words = F.trim(F.regexp_replace(F.lower(fold(raw)), "[^a-z0-9]+", " "))
    kept = F.array_join(F.filter(_tokens(words), lambda t: ~t.isin(STOP_WORDS)), " ")
    plain = F.array_join(F.filter(_tokens(F.regexp_replace(kept, _legal_run(" dba(?: |$)|$"), "")), lambda t: t != "dba"), " ")
    phone = r"(?:^| )(?:1(?: ?[0-9]){10}|[0-9](?: ?[0-9]){9})$"

    def parts(free: Column, all_tokens: Column, has_phone: Column) -> Column:
        identity = F.size(F.filter(free, lambda t: (F.length(t) >= 2) | t.rlike("^[0-9]+$")))
        joined = F.array_join(F.when((F.size(free) < F.size(all_tokens)) & (identity == 1), all_tokens).otherwise(free), " ")
        number = has_phone | F.coalesce(F.try_element_at(free, F.lit(-1)).rlike("^[0-9]+$"), F.lit(False))
        return _once(joined, lambda norm: F.struct(F.when(norm != "", norm).alias("norm"), F.coalesce(number, F.lit(False)).alias("had_store_number")))

    def traded(plain: Column, has_phone: Column) -> Column:
        return F.when(has_phone, F.regexp_replace(F.regexp_replace(plain, phone, ""), _legal_run("$"), "")).otherwise(plain)

    def of_tokens(all_tokens: Column, has_phone: Column) -> Column:
        return _once(F.filter(all_tokens, lambda t: ~t.isin(TRADE_WORDS)), lambda free: parts(free, all_tokens, has_phone))

    return _once(plain, lambda p: _once(p.rlike(phone), lambda has: _once(_tokens(traded(p, has)), lambda tokens: of_tokens(tokens, has))))


def name_norm(raw: Column) -> Column:
    return name_parts(raw)["norm"]


def chain_key(raw: Column, norm: Column) -> Column:
    """The name key with the trade words that it dropped put back in front."""
    words = _tokens(F.regexp_replace(F.lower(fold(raw)), "[^a-z0-9]+", " "))

    def key(norm: Column, in_norm: Column) -> Column:
        dropped = F.filter(words, lambda t: t.isin(TRADE_WORDS) & ~F.array_contains(in_norm, t))
        return F.concat_ws(" ", F.array_distinct(dropped), norm)

    return _once(norm, lambda n: _once(F.split(n, " "), lambda in_norm: key(n, in_norm)))


def postal(raw: Column) -> Column:
    found = F.regexp_extract(F.trim(raw), r"^(\d{5})(?:-?\d{4})?$", 1)
    return F.when(found != "", found)


_UNIT = r"(?i)[\s,]+(?:(?:STE|SUITE|UNIT|APT|BLDG|RM|SPC|LOT|FL)\.?\s+|#\s*)([A-Z0-9][A-Z0-9-]*)(?=\s|$)"


def address_parts(raw: Column) -> Column:
    """``struct(street_num, street_norm, unit)``. A unit is the last designator whose identifier is no street type and
    that has a street in front of it; street types and directions are abbreviated."""
    types = "|".join([*STREET_TYPES, *STREET_TYPES.values()])
    directions = "|".join([*DIRECTIONS, *DIRECTIONS.values()])
    text = F.trim(fold(raw))
    unit = F.upper(F.regexp_extract(text, f"^.*{_UNIT}", 1))
    before = F.regexp_replace(F.regexp_extract(text, f"^(.*?){_UNIT}", 1), r"^\d+(?:\s+|$)", "")
    after = F.upper(F.trim(F.regexp_extract(text, f"^.*{_UNIT}(.*)$", 2)))
    real = (unit != "") & F.upper(F.trim(before)).rlike("[A-Z0-9]") & ~F.upper(F.trim(before)).rlike(f"^(?:{directions})$") & ~unit.rlike(f"^(?:{types})$") & ~after.rlike(f"^(?:{types})(?:[^A-Z0-9]|$)")
    street = F.when(real, F.regexp_replace(text, _UNIT, "")).otherwise(text)
    number = F.regexp_extract(street, r"^(\d+)(?:\s+|$)", 1)
    short = F.create_map(*[F.lit(x) for pair in (STREET_TYPES | DIRECTIONS).items() for x in pair])
    words = _tokens(F.regexp_replace(F.upper(F.regexp_replace(street, r"^\d+(?:\s+|$)", "")), "[^A-Z0-9]+", " "))
    norm = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")
    return F.struct(F.when(number != "", number).alias("street_num"), F.when(norm != "", norm).alias("street_norm"), F.when(real, unit).alias("unit"))


def unit_identity(unit: Column) -> Column:
    """A unit for comparison, without designator words and punctuation; null if nothing is left. Buildings, lots and
    floors keep their word, as it tells units apart."""
    bare = F.array_join(F.filter(_tokens(F.regexp_replace(F.upper(unit), "[^A-Z0-9]+", " ")), lambda t: ~t.isin(UNIT_WORDS)), "")
    return F.when(bare != "", bare)


def units_conflict(a: Column, b: Column) -> Column:
    """Both sides name a unit, and not the same one; the units as :func:`unit_identity` gives them."""
    return F.coalesce(a != b, F.lit(False))


def phone(raw: Column) -> Column:
    """``struct(e164, blockable)`` of a North American number; an approximation of the full numbering plan."""
    extension = raw.rlike(r"(?i)(?:ext\.?|x)\s*\d+\s*$")
    digits = F.regexp_replace(F.regexp_replace(raw, r"(?i)(?:ext\.?|x)\s*\d+\s*$", ""), r"[^0-9]", "")
    ten = F.when(F.length(digits) == 11, F.regexp_extract(digits, "^1([0-9]{10})$", 1)).otherwise(digits)
    valid = ten.rlike(r"^[2-9][0-9]{2}[2-9][0-9]{6}$") & (F.substring(ten, 4, 3) != "555")
    return F.struct(F.when(valid, F.concat(F.lit("+1"), ten)).alias("e164"), F.coalesce(valid & ~extension & ~F.substring(ten, 1, 3).isin(TOLL_FREE), F.lit(False)).alias("blockable"))


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def host_class(url: Column) -> Column:
    out = F.when(F.coalesce(url, F.lit("")) == "", "none").when(host(url).isNull(), "other")
    for kind, domains in HOST_CLASSES.items():
        any_of = F.lit(False)
        for d in domains:
            any_of = any_of | (host(url) == d) | host(url).endswith(f".{d}")
        out = out.when(any_of, kind)
    return out.otherwise("other")


def utf16_units(c: Column) -> Column:
    """The UTF-16 code units of a text: two for characters beyond U+FFFF."""
    points = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("long"))
    pair = lambda p: F.array(F.lit(0xD800) + F.shiftright(p - 0x10000, 10), F.lit(0xDC00) + (p - 0x10000).bitwiseAND(F.lit(0x3FF)))
    return F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(pair(p))))


def fnv1a32(c: Column) -> Column:
    """FNV-1a over the text's UTF-16 code units, as a non-negative long."""
    step = lambda a, unit: (a.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.aggregate(utf16_units(c), F.lit(2166136261).cast("long"), step)


def picked_phone(raw: Column) -> Column:
    """Of an array of phones the first that can block, else the first that is a number at all, as :func:`phone` gives it."""
    parsed = F.transform(raw, phone)
    blockable = F.filter(parsed, lambda p: p["blockable"])
    return F.coalesce(F.try_element_at(blockable, F.lit(1)), F.try_element_at(F.filter(parsed, lambda p: p["e164"].isNotNull()), F.lit(1)))


def external_id(taxpayer: Column, outlet: Column) -> Column:
    """A permit's natural key."""
    return F.concat_ws("-", taxpayer, outlet)


# Fixed value: digits of public keys, without letters that look like digits.
KEY_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def public_key(identity: Column, prefix: str = "SL-", size: int = 6) -> Column:
    """A short public key that follows from a row's identity, so that a replayed task makes the same one."""
    h = F.conv(F.substring(F.sha2(identity, 256), 1, 12), 16, 10).cast("long")
    return F.concat(F.lit(prefix), *[F.substring(F.lit(KEY_DIGITS), F.shiftright(h, 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(size)])


# The shapes of ids from outside and of tile paths.
SHAPES = {
    "place": r"^[A-Za-z0-9_-]{10,255}$", "dataset": r"^[a-z0-9]{4}-[a-z0-9]{4}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "path": r"^r[0-3]*$",
}


def has_shape(raw: Column, shape: str) -> Column:
    """Whether a text has one of :data:`SHAPES`; null has none. A UUID isn't taken for a place's id."""
    ok = F.coalesce(raw.rlike(SHAPES[shape]), F.lit(False))
    return ok & ~F.coalesce(raw.rlike(SHAPES["uuid"]), F.lit(False)) if shape == "place" else ok


def county_padded(code: Column) -> Column:
    """A county code of one to three digits with leading zeros; null for anything else."""
    return F.when(code.rlike("^[0-9]{1,3}$"), F.lpad(code, 3, "0"))


def county_bare(code: Column) -> Column:
    """A county code without leading zeros; null for anything but three digits."""
    return F.when(code.rlike("^[0-9]{3}$"), code.cast("int").cast("string"))


def in_code_ranges(code: Column, ranges: list[tuple[str, str]]) -> Column:
    """Whether a digit code lies in one of the half-open ranges of prefixes, compared as text."""
    return F.coalesce(reduce(lambda a, r: a | ((code >= r[0]) & (code < r[1])), ranges, F.lit(False)), F.lit(False))


def folded(raw: Column) -> Column:
    """A city or lookup key: trimmed, white space collapsed, upper case; null if nothing is left."""
    out = F.upper(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    return F.when(out != "", out)


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres on a sphere; null if any coordinate is."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2 - lng1)
    return F.when(h.isNotNull(), 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), h))))  # least() skips nulls


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each padded with two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def gram_codes(grams: Column) -> Column:
    """Trigrams as numbers, which are compared faster: texts of three ASCII characters are 24 bits, and no two have one CRC-32."""
    return F.transform(grams, lambda g: F.crc32(g))


def gram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct trigrams. The union is named where it is always evaluated, so it is computed
    once; under a condition it would be once for each name."""
    either = F.size(F.array_distinct(F.concat(a, b)))
    return F.coalesce(F.try_divide(F.size(a) + F.size(b) - either, either), F.lit(0.0))


def canonical_json(*columns: str) -> Column:
    """JSON of the columns with keys sorted and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def payload_hash(*columns: str) -> Column:
    """SHA-256 of :func:`canonical_json`."""
    return F.sha2(canonical_json(*columns), 256)


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")
