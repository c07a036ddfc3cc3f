"""Page locators as column expressions: split, normalise, redact, digest.  No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagefacts import fixed
from pagefacts.functions.digests import canonical_struct, digest
from pagefacts.functions.patterns import matches, utf16_length

REDACTED = "[REDACTED_SEGMENT]"
_SPLIT = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)"
_ESCAPES = r"%[0-9a-fA-F]{2}|[^%]+|%"
_DOT_SEGMENT = r"(?i)(?:^|[/\\])(?:\.|%2e){1,2}(?:[/\\]|\z)"
_PATH_UNSAFE = r"[^\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"


def _is_escape(token: Column) -> Column:
    return matches(token, "^%[0-9a-fA-F]{2}$")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_ESCAPES), F.lit(0))


def _upper_escapes(text: Column) -> Column:
    upper = F.array_join(F.transform(_tokens(text), lambda t: F.when(_is_escape(t), F.upper(t)).otherwise(t)), "")
    return F.when(F.contains(text, F.lit("%")), upper).otherwise(text)


def decode_unreserved(segment: Column) -> Column:
    """`%7e` becomes `~`; every other escape is kept in upper case."""

    def one(token: Column) -> Column:
        plain = F.char(F.conv(F.substring(token, 2, 2), 16, 10).cast("bigint"))
        decoded = F.when(matches(plain, "^[A-Za-z0-9._~-]$"), plain).otherwise(F.upper(token))
        return F.when(_is_escape(token), decoded).otherwise(token)

    joined = F.array_join(F.transform(_tokens(segment), one), "")
    return F.when(F.contains(segment, F.lit("%")), joined).otherwise(segment)


def decode_fully(segment: Column) -> Column:
    """All escapes decoded; null for a broken escape or for bytes that are not UTF-8."""
    hexed = F.array_join(
        F.transform(_tokens(segment), lambda t: F.when(_is_escape(t), F.upper(F.substring(t, 2, 2))).otherwise(
            F.hex(F.encode(t, "UTF-8")))), "")
    decoded = F.try_validate_utf8(F.unhex(hexed).cast("string"))
    broken = segment.rlike("%(?![0-9a-fA-F]{2})")
    return F.when(~F.contains(segment, F.lit("%")), segment).when(~broken, decoded)


def is_sensitive_segment(text: Column) -> Column:
    return (
        (utf16_length(text) > fixed.MAX_SEGMENT_LENGTH)
        | matches(text, fixed.EMAIL_SEGMENT)
        | matches(text, fixed.JWT_SEGMENT)
        | matches(text, fixed.HIGH_ENTROPY)
        | matches(text, fixed.CREDENTIAL_LIKE)
    )


def encode_path(path: Column) -> Column:
    """Percent-encode what a path may not hold as is."""
    one = lambda c: F.when(
        matches(c, "^" + _PATH_UNSAFE + "$"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    ).otherwise(c)
    encoded = F.array_join(F.transform(F.split(path, ""), one), "")
    return F.when(F.regexp_replace(path, "[%]", "").rlike(_PATH_UNSAFE), encoded).otherwise(path)


def drop_dot_segments(path: Column) -> Column:
    """Resolve `.` and `..`, also when written as `%2e`; repeated slashes stay."""
    one_dot, two_dots = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    segments = F.slice(F.split(path, "/"), 2, 1_000_000)
    last = F.element_at(segments, -1)

    def step(kept: Column, segment: Column) -> Column:
        popped = F.when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        return F.when(matches(segment, two_dots), popped).when(matches(segment, one_dot), kept).otherwise(
            F.concat(kept, F.array(segment)))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.when(matches(last, one_dot) | matches(last, two_dots), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.when(path.rlike(_DOT_SEGMENT), F.concat(F.lit("/"), F.array_join(closed, "/"))).otherwise(path)


def address_parts(text: Column) -> dict[str, Column]:
    """The written parts of a cleaned address."""
    authority = F.regexp_extract(text, _SPLIT, 2)
    endpoint = F.regexp_replace(authority, r"(?s)^.*@", "")
    raw_path = F.translate(F.regexp_extract(text, _SPLIT, 3), "\\", "/")
    return {
        "scheme": F.lower(F.regexp_extract(text, _SPLIT, 1)),
        "userinfo": F.regexp_extract(authority, r"(?s)^(.*)@", 1),
        "host": F.lower(F.regexp_replace(endpoint, r":[0-9]*\z", "")),
        "port": F.regexp_extract(endpoint, r":([0-9]*)\z", 1),
        "path": F.when(raw_path == "", F.lit("/")).otherwise(raw_path),
    }


def cleaned(raw: Column) -> Column:
    """Address without outer control characters and spaces and without inner tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(raw, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")


def ascii_host(host: Column) -> Column:
    """International names use the JVM's own IDNA tables; plain names pass unchanged."""
    mapped = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host))
    return F.when(host.rlike(r"[^\x00-\x7F]"), mapped).otherwise(host)


def reject_reason(raw: Column, text: Column, userinfo: Column, host: Column, mapped: Column, port: Column) -> Column:
    # ß, ς, ZWNJ and ZWJ: the letters on which IDNA versions disagree are refused, not mapped wrongly.
    bad_host = (
        (host.rlike(r"[\x00-\x20#%/:<>?@\\^|\u00DF\u03C2\u200C\u200D]") & ~matches(host, r"^\[[0-9a-f:.]+\]$"))
        | (host == "")
        | mapped.isNull()
    )
    number = port.cast("int")
    return (
        F.when(raw.isNull(), "URL_INVALID")
        .when((F.length(raw) == 0) | (utf16_length(raw) > fixed.MAX_URL_LENGTH), "URL_LENGTH")
        .when(~text.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), "URL_INVALID")
        .when(~text.rlike(_SPLIT), "UNSUPPORTED_SCHEME")
        .when(F.regexp_replace(userinfo, ":", "") != "", "CREDENTIALS_REJECTED")
        .when(bad_host, "URL_INVALID")
        .when((F.length(port) > 0) & (number.isNull() | (number > 65535) | (number < 1)), "PORT_INVALID")
    )


def written_port(scheme: Column, port: Column) -> Column:
    """The port number, or null for the scheme's own."""
    default = F.when(scheme == "http", 80).otherwise(443)
    return F.when((port != "") & (port.cast("int") != default), port.cast("int"))


def redact_segments(path: Column) -> Column:
    """Path segments as (text, hidden), private ones replaced.

    Each step is a transform of its own, so that a decoded segment is worked out once and then only read.
    """
    decoded = F.transform(F.split(path, "/"), decode_unreserved)
    probed = F.transform(decoded, lambda d: F.struct(d.alias("text"), decode_fully(d).alias("probe")))
    judged = F.transform(probed, lambda s: F.struct(
        s["text"].alias("text"),
        F.coalesce((s["text"] != "") & (s["probe"].isNull() | is_sensitive_segment(s["probe"])), F.lit(False)).alias("hidden")))
    return F.transform(judged, lambda s: F.struct(
        F.when(s["hidden"], F.lit(REDACTED)).otherwise(_upper_escapes(s["text"])).alias("text"), s["hidden"].alias("hidden")))


def join_segments(segments: Column) -> Column:
    joined = F.array_join(F.transform(segments, lambda s: s["text"]), "/")
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def hidden_count(segments: Column) -> Column:
    return F.size(F.filter(segments, lambda s: s["hidden"]))


def normal_path(path: Column) -> Column:
    return join_segments(redact_segments(path))


def normal_scope(scope: Column) -> Column:
    usable = F.startswith(scope, F.lit("/")) & ~scope.rlike("[?#]")
    path = normal_path(scope)
    return F.when(usable, F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/")))).otherwise("/")


def locator_digest(scheme: Column, host: Column, port: Column, path: Column, scope: Column) -> Column:
    return digest(canonical_struct(
        {"scheme": scheme, "host_ascii": host, "port": port, "path": path, "site_path_scope": scope}))


def display_path(path: Column) -> Column:
    """Short path for people: slashes collapsed, private segments as `:redacted`."""
    from pagefacts.functions.redaction import looks_private

    squeezed = F.regexp_replace(path, "/{2,}", "/")
    base = F.when((F.length(squeezed) > 1) & F.endswith(squeezed, F.lit("/")),
                  F.regexp_replace(squeezed, r"/\z", "")).when(squeezed == "", "/").otherwise(squeezed)

    probed = F.transform(F.split(base, "/"), lambda s: F.struct(s.alias("text"), decode_fully(s).alias("probe")))

    def one(segment: Column) -> Column:
        text, probe = segment["text"], segment["probe"]
        hidden = probe.isNull() | looks_private(probe) | (utf16_length(probe) > fixed.MAX_DISPLAY_SEGMENT_LENGTH)
        return F.when(text == "", text).when(hidden, F.lit(":redacted")).otherwise(text)

    return F.array_join(F.transform(probed, one), "/")
