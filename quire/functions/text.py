"""Text expressions: string decoding, display escaping, search offsets.

Everything here is a column expression, so it stays inside generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# PDFDocEncoding, the codes whose meaning differs from Latin-1
# (ISO 32000-1 Annex D). Codes the encoding leaves undefined read as U+FFFD.
PDFDOC_18_1F = "˘ˇˆ˙˝˛˚˜"
PDFDOC_80_9E = (
    "•†‡…—–ƒ⁄‹›−‰„“”"
    "‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
)
PDFDOC_A0 = "€"
PDFDOC_UNDEFINED = [c for c in range(0x18) if c not in (0x09, 0x0A, 0x0D)] + [0x7F, 0x9F, 0xAD]

_PDFDOC_FROM = (
    "".join(map(chr, range(0x18, 0x20)))
    + "".join(map(chr, range(0x80, 0x9F)))
    + " "
    + "".join(map(chr, PDFDOC_UNDEFINED))
)
_PDFDOC_TO = PDFDOC_18_1F + PDFDOC_80_9E + PDFDOC_A0 + "�" * len(PDFDOC_UNDEFINED)


def latin1(b: Column) -> Column:
    """Bytes to text, one code point per byte."""
    return F.decode(b, "ISO-8859-1")


def utf16be(b: Column) -> Column:
    """Even-length UTF-16BE bytes to text; an unpaired surrogate is U+FFFD."""
    units = F.regexp_replace(F.hex(b), "(....)", "$1 ")
    paired_high = F.regexp_replace(units, "D[89AB].. (?!D[C-F])", "FFFD ")
    paired = F.regexp_replace(paired_high, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    return F.decode(F.unhex(F.regexp_replace(paired, " ", "")), "UTF-16BE")


def text_string(b: Column) -> Column:
    """Decode a text string; NULL when it is marked with an encoding it breaks."""
    text = latin1(b)
    head = F.hex(F.substring(b, 1, 3))
    body16 = F.substring(b, 3, 2_147_483_647)
    body8 = F.substring(b, 4, 2_147_483_647)
    return (
        F.when(
            head.startswith("FEFF"),
            F.when(F.octet_length(b) % 2 == 0, utf16be(body16)),
        )
        .when(head == "EFBBBF", F.when(F.is_valid_utf8(body8.cast("string")), body8.cast("string")))
        .when(~text.rlike(r"[\x18-\x1F\x80-\xFF]"), text)
        .otherwise(F.translate(text, _PDFDOC_FROM, _PDFDOC_TO))
    )


def text_or_raw(b: Column) -> Column:
    """Decoded text, else the bytes as UTF-8, else their upper-case hex digits."""
    raw = b.cast("string")
    return F.coalesce(text_string(b), F.when(F.is_valid_utf8(raw), raw), F.hex(b))


def latin1_view(b: Column) -> Column:
    """Bytes one by one; control bytes but tab, LF and CR, and DEL, are U+FFFD."""
    return F.regexp_replace(latin1(b), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "�")


_CONTROLS = r"[\x00-\x1F\x7F\u0080-\u009F]"


def escape_display(s: Column) -> Column:
    r"""One-line form: \n, \r, \t and \\ by name, other controls as \xHH."""
    named = s
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        named = F.replace(named, F.lit(raw), F.lit(shown))

    def unit(c: Column) -> Column:
        # ascii() of a two-byte character is its code point.
        code = F.lpad(F.hex(F.ascii(c)), 2, "0")
        return F.when(c.rlike(_CONTROLS), F.concat(F.lit("\\x"), code)).otherwise(c)

    spelled = F.array_join(F.transform(F.split(named, ""), unit), "")
    return F.when(named.rlike(_CONTROLS), spelled).otherwise(named)


def clamp_display(s: Column, limit: int) -> Column:
    """Escaped text cut to ``limit`` characters on a unit boundary, saying so."""
    shown = escape_display(s)
    total = F.char_length(shown)
    whole_units = F.regexp_extract(
        F.left(shown, F.lit(limit)), r"^(?:[^\\]|\\[nrt\\]|\\x[0-9A-F]{2})*", 0
    )
    note = F.format_string(" [truncated: %d of %d]", F.char_length(whole_units), total)
    return F.when(total > limit, F.concat(whole_units, note)).otherwise(shown)


def normalize_text(s: Column) -> Column:
    """Whitespace runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# The predefined XML entities.
XML_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&amp;", "&"),
]
_CHAR_REF = r"&#(?:x[0-9A-Fa-f]+|[0-9]+);"


def unescape_xml(s: Column) -> Column:
    """Numeric references first, then the five named entities, each once."""

    def code_point(ref: Column) -> Column:
        body = F.regexp_replace(ref, r"[&#;]", "")
        return F.when(
            body.startswith("x"),
            F.conv(F.substring(body, 2, 20), 16, 10).try_cast("bigint"),
        ).otherwise(body.try_cast("bigint"))

    def spell(ref: Column) -> Column:
        cp = code_point(ref)
        # A surrogate half is no character; it reads as U+FFFD.
        safe = F.when((cp >= 0xD800) & (cp <= 0xDFFF), F.lit(0xFFFD)).otherwise(cp)
        text = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
        return F.when(cp.isNotNull() & (cp <= 0x10FFFF), text).otherwise(ref)

    refs = F.array_distinct(F.regexp_extract_all(s, F.lit(_CHAR_REF), F.lit(0)))
    numeric = F.aggregate(refs, s, lambda acc, r: F.replace(acc, r, spell(r)))
    out = F.when(s.rlike(_CHAR_REF), numeric).otherwise(s)
    for entity, char in XML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def xmp_value(xmp: Column, prop: str) -> Column:
    """The one text value of an XMP property, '' when absent or ambiguous."""
    name = "\\Q" + prop + "\\E"
    simple = F.trim(F.regexp_extract(xmp, f"<{name}[^>]*>([^<]*)</{name}>", 1))
    block = F.regexp_extract(xmp, f"(?s)<{name}[^>]*>(.*?)</{name}>", 1)
    items = F.regexp_extract_all(block, F.lit("<rdf:li[^>]*>([^<]*)</rdf:li>"), F.lit(1))
    single = F.when(F.size(items) == 1, unescape_xml(F.trim(F.element_at(items, 1)))).otherwise("")
    return F.when(simple != "", unescape_xml(simple)).otherwise(single)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    An expression used inside a lambda is evaluated for every element; a lambda
    variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


_BLOCK = 256


def prefix_sums(values: Column) -> Column:
    """Exclusive running sums of a bigint array.

    Two levels of blocks keep it near linear for the long arrays of big texts.
    """
    zero = F.lit(0).cast("bigint")

    def small(xs: Column, base: Column) -> Column:
        init = F.struct(base.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            xs,
            init,
            lambda acc, x: F.struct(
                (acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def blocks(vs: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(vs) - 1) / _BLOCK).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(vs, i * _BLOCK + 1, F.lit(_BLOCK)))

    def spread(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
        return let(small(totals, zero), lambda bases: F.flatten(F.zip_with(bs, bases, small)))

    return let(values, lambda vs: let(blocks(vs), spread))


_HITS = "array<struct<start:bigint,end:bigint,line:bigint>>"


def literal_hits(text: Column, query: str, case_sensitive: bool = True) -> Column:
    """Non-overlapping hits of a literal as ``array<struct<start,end,line>>``.

    Offsets count characters from 0, lines from 1; LF, CR and CRLF each end a
    line. Offsets stay true under case folding because a text whose lower-case
    form has another length is searched case-sensitively.
    """
    if query == "":
        return F.array().cast(_HITS)
    exact = F.split(text, "\\Q" + query + "\\E", -1)
    if case_sensitive:
        parts = exact
    else:
        folded = F.split(F.lower(text), "\\Q" + query.lower() + "\\E", -1)
        parts = F.when(F.char_length(F.lower(text)) == F.char_length(text), folded).otherwise(exact)
    step = len(query)
    breaks = r"\r\n|\r|\n"
    query_breaks = len(re.findall(breaks, query))

    def hit(end: Column, line: Column) -> Column:
        return F.struct(
            (end - step).alias("start"), end.alias("end"), (line - query_breaks + 1).alias("line")
        )

    def locate(p: Column) -> Column:
        lens = F.transform(p, lambda x: (F.char_length(x) + step).cast("bigint"))
        lines = F.transform(p, lambda x: (F.size(F.split(x, breaks, -1)) - 1 + query_breaks).cast("bigint"))
        # Entry i of the exclusive sums is where hit i ends.
        return F.slice(F.zip_with(prefix_sums(lens), prefix_sums(lines), hit), F.lit(2), F.size(p) - 1)

    return F.when(F.contains(F.lower(text), F.lit(query.lower())), let(parts, locate)).otherwise(F.array().cast(_HITS))


def format_bytes(n: Column, decimals: int = 1) -> Column:
    """B, KB, MB or GB, moving up a unit where rounding would show 1024.0."""

    def scaled(power: int, unit: str) -> Column:
        # Halves round up, as fixed-point printing of an exact binary half does.
        return F.format_string(f"%.{decimals}f {unit}", n / F.lit(float(1024**power)))

    return (
        F.when(n.isNull() | (n < 0), F.lit("0 B"))
        .when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when((n < 1024**2) & (n / 1024 < 1023.95), scaled(1, "KB"))
        .when((n < 1024**3) & (n / 1024**2 < 1023.95), scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+hh'mm'`` to a timestamp, NULL when it cannot be read."""
    pattern = (
        r"^(?:D:)?(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})"
        r"(?:(Z)(?:00'?00'?)?|([+-])(\d{2})'?(?:(\d{2})'?)?)?)?)?)?)?)?$"
    )

    def part(i: int, default: str) -> Column:
        got = F.regexp_extract(raw, pattern, i)
        return F.when(got == "", F.lit(default)).otherwise(got)

    stamp = F.concat(
        part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        part(8, "+"), part(9, "00"), F.lit(":"), part(10, "00"),
    )
    return F.when(raw.rlike(pattern), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def decode_name(s: Column) -> Column:
    """``#xx`` escapes of a name to their bytes, read as UTF-8."""
    shielded = F.replace(F.replace(s, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return F.coalesce(
        F.try_url_decode(F.regexp_replace(shielded, "#([0-9A-Fa-f]{2})", "%$1")), s
    )
