"""Scalar expressions over object values: references, flags, sizes, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

# --- references and paths ----------------------------------------------------

_REF = r"^\s*(\d{1,18})\s+(\d{1,9})\s+R\s*$"
_NODE = r"^\s*obj:(\d{1,9}):(\d{1,18})\s*$"


def parse_ref(ref: Column) -> Column:
    """``N G R`` or ``obj:G:N`` to ``struct<num,gen>``, NULL when it is neither."""
    num = F.when(ref.rlike(_REF), F.regexp_extract(ref, _REF, 1)).when(
        ref.rlike(_NODE), F.regexp_extract(ref, _NODE, 2)
    )
    gen = F.when(ref.rlike(_REF), F.regexp_extract(ref, _REF, 2)).when(
        ref.rlike(_NODE), F.regexp_extract(ref, _NODE, 1)
    )
    return F.when(
        num.isNotNull(), F.struct(num.cast("bigint").alias("num"), gen.cast("bigint").alias("gen"))
    )


def ref_string(num: Column, gen: Column) -> Column:
    return F.format_string("%d %d R", num.cast("bigint"), gen.cast("bigint"))


def node_id(num: Column, gen: Column) -> Column:
    """Generation first, then number."""
    return F.format_string("obj:%d:%d", gen.cast("bigint"), num.cast("bigint"))


def breadcrumb(parts: Column) -> Column:
    return F.array_join(parts, " > ")


def path_join(steps: Column) -> Column:
    """``/Key`` segments joined by blanks, ``[n]`` glued to what precedes it."""
    return F.regexp_replace(F.array_join(steps, " "), r" \[", "[")


def display_steps(path: Column) -> Column:
    """Entry path steps as segments: dictionary keys get their slash."""
    return F.transform(path, lambda p: F.when(p.startswith("["), p).otherwise(F.concat(F.lit("/"), p)))


# --- bit names ---------------------------------------------------------------

# Font descriptor flags by 1-based bit.
FONT_FLAGS = [
    (1, "FixedPitch"),
    (2, "Serif"),
    (3, "Symbolic"),
    (4, "Script"),
    (6, "Nonsymbolic"),
    (7, "Italic"),
    (17, "AllCap"),
    (18, "SmallCap"),
    (19, "ForceBold"),
]
# Inheritable page attributes by 1-based bit.
INHERITED = [(1, "Resources"), (2, "MediaBox"), (3, "CropBox"), (4, "Rotate")]
# Key usage bits (RFC 5280), 1-based here.
KEY_USAGE = [
    (1, "digitalSignature"),
    (2, "nonRepudiation"),
    (3, "keyEncipherment"),
    (4, "dataEncipherment"),
    (5, "keyAgreement"),
    (6, "keyCertSign"),
    (7, "cRLSign"),
    (8, "encipherOnly"),
    (9, "decipherOnly"),
]


def bit_names(mask: Column, names: list[tuple[int, str]]) -> Column:
    """Names of the set bits in listed order; NULL mask gives NULL."""
    picked = F.array_compact(
        F.array(*[F.when(F.getbit(mask.cast("bigint"), F.lit(b - 1)) == 1, F.lit(n)) for b, n in names])
    )
    return F.when(mask.isNotNull(), picked)


def flag_names(mask: Column) -> Column:
    return bit_names(mask, FONT_FLAGS)


def inherited_names(mask: Column) -> Column:
    """Comma list, ``-`` when nothing is inherited."""
    text = F.array_join(bit_names(mask, INHERITED), ",")
    return F.when(text == "", F.lit("-")).otherwise(text)


def key_usage_names(bits: Column) -> Column:
    return bit_names(bits, KEY_USAGE)


# --- names of object identifiers ---------------------------------------------

# Digest and signature algorithms.
ALGORITHMS = {
    "1.3.14.3.2.26": "SHA-1",
    "2.16.840.1.101.3.4.2.1": "SHA-256",
    "2.16.840.1.101.3.4.2.2": "SHA-384",
    "2.16.840.1.101.3.4.2.3": "SHA-512",
    "1.2.840.113549.1.1.1": "RSA",
    "1.2.840.113549.1.1.5": "RSA with SHA-1",
    "1.2.840.113549.1.1.10": "RSA-PSS",
    "1.2.840.113549.1.1.11": "RSA with SHA-256",
    "1.2.840.113549.1.1.12": "RSA with SHA-384",
    "1.2.840.113549.1.1.13": "RSA with SHA-512",
    "1.2.840.10045.2.1": "ECDSA",
    "1.2.840.10045.4.3.2": "ECDSA with SHA-256",
    "1.2.840.10045.4.3.3": "ECDSA with SHA-384",
    "1.2.840.10045.4.3.4": "ECDSA with SHA-512",
    "1.2.840.113549.1.1.2.1": "SHA-1",
    "1.2.840.113549.2.5": "MD5",
}
# Extended key purposes.
KEY_PURPOSES = {
    "2.5.29.37.0": "anyExtendedKeyUsage",
    "1.3.6.1.5.5.7.3.1": "serverAuth",
    "1.3.6.1.5.5.7.3.2": "clientAuth",
    "1.3.6.1.5.5.7.3.3": "codeSigning",
    "1.3.6.1.5.5.7.3.4": "emailProtection",
    "1.3.6.1.5.5.7.3.5": "ipsecEndSystem",
    "1.3.6.1.5.5.7.3.6": "ipsecTunnel",
    "1.3.6.1.5.5.7.3.7": "ipsecUser",
    "1.3.6.1.5.5.7.3.8": "timeStamping",
    "1.3.6.1.5.5.7.3.9": "OCSPSigning",
    "1.3.6.1.5.5.7.3.36": "documentSigning",
    "1.2.840.113583.1.1.5": "adobeAuthenticDocumentsTrust",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def algorithm_name(oid: Column) -> Column:
    return F.coalesce(_lookup(ALGORITHMS, oid), oid)


def eku_name(oid: Column) -> Column:
    return F.coalesce(_lookup(KEY_PURPOSES, oid), F.lit(""))


# --- signatures --------------------------------------------------------------


def signature_kind(sub_filter: Column) -> Column:
    """``cms``, ``timestamp``, ``cert-entry`` or ``other``."""
    return (
        F.when(sub_filter == "ETSI.RFC3161", "timestamp")
        .when(sub_filter.startswith("adbe.pkcs7.") | sub_filter.startswith("ETSI.CAdES"), "cms")
        .when(sub_filter == "adbe.x509.rsa_sha1", "cert-entry")
        .otherwise("other")
    )


def byte_range_coverage(
    value: Column, size: Column, is_array: Column | None = None, all_integers: Column | None = None
) -> Column:
    """``struct<error, trailing_gap, covers_whole_file>`` of a byte range.

    ``value`` is ``array<bigint>`` (NULL: the entry is missing). ``is_array`` and
    ``all_integers`` say what the stored value was; both default to true.
    """
    given = F.struct(
        value.alias("v"),
        size.cast("bigint").alias("size"),
        (F.lit(True) if is_array is None else is_array).alias("is_array"),
        (F.lit(True) if all_integers is None else all_integers).alias("ints"),
    )
    return let(given, lambda g: let(_coverage_error(g), lambda error: _coverage(g, error)))


def _coverage_error(g: Column) -> Column:
    v, size = g["v"], g["size"]
    n = F.size(v)
    at = lambda i: F.try_element_at(v, F.lit(i))
    # The first entry that is negative or too large decides which is reported.
    first_bad = F.try_element_at(F.filter(v, lambda x: (x < 0) | (x > size)), F.lit(1))
    return (
        F.when(v.isNull() & g["is_array"], "/ByteRange missing")
        .when(~g["is_array"], "/ByteRange is not an array")
        .when(~g["ints"], "/ByteRange contains a non-integer entry")
        .when(n % 2 == 1, F.format_string("/ByteRange has an odd number of entries (%d)", n))
        .when(
            n != 4,
            F.format_string("/ByteRange has %d entries; expected 4 (offset length offset length)", n),
        )
        .when(first_bad < 0, "/ByteRange contains a negative value")
        .when(first_bad > size, "/ByteRange value exceeds the file size")
        .when(
            (at(1) + at(2) > size) | (at(3) + at(4) > size),
            "/ByteRange extends past the end of the file",
        )
        .when(at(3) < at(1) + at(2), "/ByteRange ranges overlap")
    )


def _coverage(g: Column, error: Column) -> Column:
    v = g["v"]
    gap = F.when(error.isNull(), g["size"] - (F.element_at(v, 3) + F.element_at(v, 4)))
    return F.struct(
        error.alias("error"),
        gap.alias("trailing_gap"),
        F.coalesce((F.try_element_at(v, F.lit(1)) == 0) & (gap == 0), F.lit(False)).alias("covers_whole_file"),
    )


# --- display rules -----------------------------------------------------------


def raw_needed(raw: Column, shown: Column) -> Column:
    """The stored form says something the shown one does not."""
    return (raw != shown) & (raw != F.concat(F.lit("("), shown, F.lit(")")))


def binary_summary(payload: Column) -> Column:
    return F.format_string("<binary, %d bytes>", F.octet_length(payload))


def binary_key(key: Column, in_signature: Column) -> Column:
    """The entry carries bytes that must not be decoded for display."""
    return (key == "CheckSum") | (key.isin("Contents", "Cert") & in_signature)


def encoding_summary(name: Column, is_dict: Column, has_differences: Column, base: Column) -> Column:
    """Table label of a font's encoding."""
    return (
        F.when(is_dict & has_differences, F.lit("Differences"))
        .when(is_dict & base.isNotNull(), F.concat(F.lit("/"), base))
        .when(is_dict, F.lit("Dict"))
        .when(name.isNotNull(), F.concat(F.lit("/"), name))
        .otherwise(F.lit("Built-in"))
    )


def image_flags(mask: Column, smask: Column, decode: Column, marker: Column, transform: Column) -> Column:
    """Short flag words of one image row."""
    present = marker == "present"
    return F.array_compact(
        F.array(
            F.when(mask, F.lit("mask")),
            F.when(smask, F.lit("SMask")),
            F.when(decode, F.lit("Decode")),
            F.when(
                present & transform.isNotNull(), F.concat(F.lit("APP14 t="), transform.cast("string"))
            ).when(present, F.lit("APP14")),
        )
    )


# --- image sizes -------------------------------------------------------------

MAX_DIMENSION = 1 << 20
MAX_BITS = 16
MAX_COMPONENTS = 32
CEILING_FLOOR = 50 * 1024 * 1024
CEILING_TOP = 512 * 1024 * 1024
CEILING_HEADROOM = 1024 * 1024


def _plausible(width: Column, height: Column, bits: Column, components: Column) -> Column:
    inside = (
        width.between(1, MAX_DIMENSION)
        & height.between(1, MAX_DIMENSION)
        & bits.between(1, MAX_BITS)
        & components.between(1, MAX_COMPONENTS)
    )
    return F.coalesce(inside, F.lit(False))


def _row_padded(width: Column, height: Column, bits: Column, components: Column) -> Column:
    pixel = bits.cast("bigint") * components.cast("bigint")
    return F.floor((width.cast("bigint") * pixel + 7) / 8).cast("bigint") * height.cast("bigint")


def estimated_bytes(width: Column, height: Column, bits: Column, components: Column) -> Column:
    """Decoded size with rows padded to whole bytes, 0 when implausible."""
    return F.when(
        _plausible(width, height, bits, components), _row_padded(width, height, bits, components)
    ).otherwise(F.lit(0).cast("bigint"))


def decode_ceiling(width: Column, height: Column, bits: Column, components: Column) -> Column:
    """Double the declared size plus headroom, within fixed bounds."""
    wanted = _row_padded(width, height, bits, components) * 2 + CEILING_HEADROOM
    bounded = F.least(F.greatest(wanted, F.lit(CEILING_FLOOR)), F.lit(CEILING_TOP))
    return F.when(_plausible(width, height, bits, components), bounded).otherwise(
        F.lit(CEILING_FLOOR).cast("bigint")
    )


# --- decode arrays -----------------------------------------------------------


def _alternates(decode: Column, first: float, second: float) -> Column:
    """Every even entry equals ``first`` and every odd one ``second``."""
    return F.forall(
        F.transform(
            decode, lambda x, i: F.when(i % 2 == 0, x == first).otherwise(x == second)
        ),
        lambda ok: ok,
    )


def decode_identity(decode: Column, components: Column) -> Column:
    empty = decode.isNull() | (F.size(decode) == 0)
    fits = F.size(decode) == 2 * components
    return F.coalesce(empty | (fits & _alternates(decode, 0.0, 1.0)), F.lit(False))


def decode_inverted(decode: Column, components: Column) -> Column:
    fits = (F.size(decode) > 0) & (F.size(decode) == 2 * components)
    return F.coalesce(decode.isNotNull() & fits & _alternates(decode, 1.0, 0.0), F.lit(False))


def decode_default(color_space: Column, bits: Column, decode: Column, lab_range: Column) -> Column:
    """The array is the default of an Indexed or Lab colour space."""
    top = F.pow(F.lit(2.0), bits) - 1
    indexed = bits.between(1, 16) & (F.size(decode) == 2)
    indexed = indexed & (F.try_element_at(decode, F.lit(1)) == 0)
    indexed = indexed & (F.try_element_at(decode, F.lit(2)) == top)
    wanted = F.concat(F.array(F.lit(0.0), F.lit(100.0)), lab_range)
    lab = (F.size(lab_range) == 4) & (decode == wanted)
    return F.coalesce(
        F.when(color_space == "Indexed", indexed).when(color_space == "Lab", lab), F.lit(False)
    )


# The verdict texts.
VERDICTS = {
    "normal": "Normal (default)",
    "normal_adobe": "Normal: /Decode compensates for Adobe-inverted CMYK",
    "inverted_adobe": "Inverted: Adobe CMYK is stored inverted and no /Decode compensates",
    "inverted_no_marker": "Inverted: /Decode inverts, no Adobe APP14 marker",
    "inverted": "Inverted by /Decode",
    "non_default": "Non-default /Decode",
    "not_classified": "Not classified: /Decode on an Indexed or Lab image is not a simple inversion",
    "unknown_decode": "Unknown: /Decode array unreadable",
    "unknown_arity": "Unknown: /Decode not checkable (colour-component count unresolved)",
    "unknown_marker": "Unknown: Adobe APP14 marker not checkable (colour-component count unresolved)",
    "unknown_chain": "Unknown: JPEG marker chain unreadable",
    "unknown_reach": "Unknown: JPEG bytes not reachable (DCTDecode behind another filter)",
}


def sample_verdict(
    color_space: Column,
    image_mask: Column,
    components: Column,
    decode: Column,
    decode_rejected: Column,
    marker: Column,
) -> Column:
    """How samples are to be read, from the decode array and the marker outcome.

    ``marker`` is ``present``, ``absent``, ``unparseable``, ``not-examined`` or
    empty for a stream without a marker question.
    """
    v = {k: F.lit(t) for k, t in VERDICTS.items()}
    masked = F.coalesce(image_mask, F.lit(False))
    n = F.when(masked, F.lit(1)).otherwise(F.coalesce(components, F.lit(0)))
    mark = F.coalesce(marker, F.lit(""))
    has_array = F.coalesce(F.size(decode) > 0, F.lit(False)) & decode.isNotNull()
    identity, inverted = decode_identity(decode, n), decode_inverted(decode, n)
    four = n == 4
    indexed_or_lab = F.coalesce(color_space.isin("Indexed", "Lab"), F.lit(False))
    asks = mark.isin("present", "unparseable", "not-examined")
    return (
        F.when(four & (mark == "unparseable"), v["unknown_chain"])
        .when(four & (mark == "not-examined"), v["unknown_reach"])
        .when(F.coalesce(decode_rejected, F.lit(False)), v["unknown_decode"])
        .when(~masked & has_array & indexed_or_lab, v["not_classified"])
        .when(has_array & (n <= 0), v["unknown_arity"])
        .when((n <= 0) & asks, v["unknown_marker"])
        .when(four & (mark == "present") & inverted, v["normal_adobe"])
        .when(four & (mark == "present") & identity, v["inverted_adobe"])
        .when(identity & ~(four & (mark == "present")), v["normal"])
        .when(four & (mark == "absent") & inverted, v["inverted_no_marker"])
        .when(inverted & ~(four & mark.isin("present", "absent")), v["inverted"])
        .otherwise(v["non_default"])
    )


# --- code maps ---------------------------------------------------------------


def unicode_units(hex_text: Column) -> Column:
    """UTF-16BE hex digits as an array of four-digit units, odd bytes left-padded."""
    h = F.upper(hex_text)
    padded = F.when(F.char_length(h) % 4 == 2, F.concat(F.lit("00"), h)).otherwise(h)
    return F.regexp_extract_all(padded, F.lit("[0-9A-F]{4}"), F.lit(0))


def _code_points(hex_text: Column) -> Column:
    """Hex of each code point, surrogate pairs joined, lone halves kept."""
    units = F.array_join(unicode_units(hex_text), " ")
    return F.regexp_extract_all(
        units, F.lit("D[89AB][0-9A-F]{2} D[C-F][0-9A-F]{2}|[0-9A-F]{4}"), F.lit(0)
    )


def _code_point_value(token: Column) -> Column:
    unit = lambda pos: F.conv(F.substring(token, pos, 4), 16, 10).cast("bigint")
    pair = (unit(1) - 0xD800) * 0x400 + (unit(6) - 0xDC00) + 0x10000
    return F.when(F.char_length(token) > 4, pair).otherwise(unit(1))


def unicode_display(hex_text: Column) -> Column:
    """``U+XXXX`` per code point, blank separated."""
    return F.array_join(
        F.transform(
            _code_points(hex_text),
            lambda t: F.concat(
                F.lit("U+"),
                F.when(F.char_length(t) > 4, F.hex(_code_point_value(t))).otherwise(t),
            ),
        ),
        " ",
    )


def unicode_glyph(hex_text: Column) -> Column:
    """The characters themselves; controls, surrogates and private use are dropped."""

    def shown(cp: Column) -> Column:
        return ~(
            (cp < 0x20)
            | cp.between(0x7F, 0xA0)
            | cp.between(0xD800, 0xDFFF)
            | cp.between(0xE000, 0xF8FF)
            | cp.between(0xF0000, 0xFFFFD)
            | cp.between(0x100000, 0x10FFFD)
        )

    points = F.filter(F.transform(_code_points(hex_text), _code_point_value), shown)
    return F.array_join(
        F.transform(points, lambda cp: F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")), ""
    )
