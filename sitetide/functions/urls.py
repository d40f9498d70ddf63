"""URL parsing, normalization, resolution and the outbound guard as column expressions.

``parse_http_url`` splits an absolute http(s) URL the way browsers do (WHATWG rules: control
characters stripped, host lower-cased and canonicalized, default port dropped, dot segments folded)
into a struct; everything else works on that struct. Invalid input gives null, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitetide.functions.text import apply_sql, as_col, let, sql_let, sql_text

# Query keys that only carry campaign tracking.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["gclid", "fbclid", "msclkid"]

# Reasons of the outbound guard.
REASON_INVALID = "Invalid URL"
REASON_SCHEME = "Only HTTP and HTTPS outbound requests are allowed"
REASON_CREDENTIALS = "Credential-bearing URLs are not allowed"
REASON_LOCALHOST = "Localhost targets are not allowed"
REASON_PRIVATE_IP = "Private, loopback, or metadata IP targets are not allowed"

_URL = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
# URLs that need no canonicalization: lower-case named host, no port or login, safe path without dot segments.
_PLAIN_HEAD = r"^(?!.*(?:/\.|%2[eE]))(https?)://((?:[a-z0-9\-]+\.)+[a-z][a-z0-9\-]*)"
_PLAIN = _PLAIN_HEAD + r"(/[A-Za-z0-9*\-._~%!$&'()+,/:;=@|\[\]]*)?(\?[^#\x00-\x20]*)?(#[^\x00-\x20]*)?$"
_PLAIN_SERIALIZED = (
    _PLAIN_HEAD + r"/[A-Za-z0-9*\-._~%!$&'()+,/:;=@|\[\]]*(?:\?[A-Za-z0-9*\-._~%!$&()+,/:;=?@|\[\]]*)?"
    r"(?:#[A-Za-z0-9*\-._~%!$&'()+,/:;=?@|\[\]]*)?$"
)
# The origin of such a URL, and paths from the root that stay as they are.
_PLAIN_ORIGIN = r"^(https?://(?:[a-z0-9\-]+\.)+[a-z][a-z0-9\-]*)(?:[/?#]|\z)"
_ROOTED = r"^(?!.*(?:/\.|%2[eE]))/(?!/)[A-Za-z0-9*\-._~%!$&'()+,/:;=@|\[\]]*\z"
# URLs that are in normal form already: such an origin, and segments without query and fragment or the root.
_NORMAL = _PLAIN_HEAD + r"(?:/|(?:/[A-Za-z0-9*\-._~%!$&'()+,:;=@|\[\]]+)+)\z"
_AUTHORITY = r"(?s)^(?:(.*)@)?(\[[^\]]*\]|[^:@\[\]]*)(?::([0-9]*))?$"
_FORBIDDEN_HOST = r"[\x00-\x20\"#%/:<>?@\[\\\]^`{|}\x7F]"
_DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"

# Characters each URL component keeps as they are (on top of letters, digits and ``*-._``).
_PATH_KEEPS = "!$&'()+,/:;=@[]|~"
_QUERY_KEEPS = "!$&()+,/:;=?@[]\\^`{|}~"
_FRAGMENT_KEEPS = "!#$&'()+,/:;=?@[]\\^{|}~"
_USERINFO_KEEPS = "!$&'()+,~"


# The functions up to ``parse_http_url`` compose SQL text: the parser is one large expression that is used in
# many places, and text is much cheaper to build than the same tree of Column objects.


def _matches(text: str, pattern: str) -> str:
    return f"({text} rlike {sql_text(pattern)})"


def _sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(replacement)})"


def _group(text: str, pattern: str, n: int) -> str:
    return f"regexp_extract({text}, {sql_text(pattern)}, {n})"


def _groups(text: str, pattern: str, n: int) -> str:
    """All groups of one match as an array; a single-element array when nothing matches."""
    template = "\n".join(f"${i}" for i in range(1, n + 1))
    return f"split({_sub(text, pattern, template)}, '\n', -1)"


def _percent_encode(text: str, keeps: str) -> str:
    unsafe = "[^A-Za-z0-9*\\-._%" + "".join("\\" + ch for ch in keeps) + "]"
    encoded = f"replace(url_encode({text}), '+', '%20')"
    for ch in keeps:
        encoded = f"replace({encoded}, '%{ord(ch):02X}', {sql_text(ch)})"
    return f"CASE WHEN {_matches(text, unsafe)} THEN replace({encoded}, '%25', '%') ELSE {text} END"


def _percent_decode(text: str) -> str:
    """Form decoding: ``+`` is a space, stray percent signs stay."""
    return f"url_decode({_sub(text, '%(?![0-9A-Fa-f]{2})', '%25')})"


def _cleaned(text: str) -> str:
    bare = _sub(_sub(text, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return f"CASE WHEN {_matches(text, '[' + chr(92) + 'x00-' + chr(92) + 'x20]')} THEN {bare} ELSE {text} END"


# --- hosts ---------------------------------------------------------------------------------------


def _ipv4_number(label: str) -> str:
    def value(digits: str, base: int) -> str:
        short = _sub(digits, "^0+", "")
        return (
            f"CASE WHEN length({short}) = 0 THEN 0L WHEN length({short}) <= 11 "
            f"THEN CAST(conv({short}, {base}, 10) AS BIGINT) ELSE {1 << 40}L END"
        )

    return (
        f"CASE WHEN {_matches(label, '^0x[0-9a-f]*$')} THEN {value(f'substring({label}, 3)', 16)} "
        f"WHEN {_matches(label, '^0[0-7]*$')} THEN {value(label, 8)} "
        f"WHEN {_matches(label, '^[1-9][0-9]*$')} THEN {value(label, 10)} END"
    )


def _ipv4(host: str) -> str:
    """Dotted form of a numeric host (1 to 4 decimal, octal or hex parts), null when out of range."""
    octets = ", ".join(f"CAST(pmod(shiftright(n4, {shift}), 256) AS STRING)" for shift in (24, 16, 8, 0))
    heads = "slice(parts, 1, greatest(size(parts) - 1, 0))"
    last = "element_at(parts, -1)"
    room = "CAST(pow(256.0, 5 - size(parts)) AS BIGINT)"
    number = f"aggregate({heads}, 0L, (acc, x) -> acc * 256 + x) * {room} + {last}"
    valid = (
        f"size(parts) <= 4 AND NOT exists(parts, x -> x IS NULL) AND NOT exists({heads}, x -> x > 255) AND {last} < {room}"
    )
    dotted = sql_let(number, "n4", f"concat_ws('.', {octets})")
    labels = f"split({_sub(host, '[.]$', '')}, '[.]')"
    return sql_let(
        f"transform({labels}, label -> {_ipv4_number('label')})", "parts", f"CASE WHEN {valid} THEN {dotted} END")


_V4_TAIL = r"^(.*:)(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
_V6_SHAPE = r"^(?!.*:::)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)(?:[0-9a-f]{1,4}|::?)*$"


def _ipv6(text: str) -> str:
    """Compressed form of an IPv6 literal without brackets; null when it is not one."""
    quads = ", ".join(f"CAST({_group('v6', _V4_TAIL, i)} AS INT)" for i in range(2, 6))
    words = "lower(hex(q[0] * 256 + q[1])), ':', lower(hex(q[2] * 256 + q[3]))"
    dotted = sql_let(
        f"array({quads})", "q",
        f"CASE WHEN array_max(q) <= 255 THEN concat({_group('v6', _V4_TAIL, 1)}, {words}) END")
    plain = sql_let(text, "v6", f"CASE WHEN {_matches('v6', _V4_TAIL)} THEN {dotted} ELSE v6 END")

    def groups(part: str) -> str:
        return f"CASE WHEN length({part}) = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE split({part}, ':') END"

    missing = "(8 - size(lr.l) - size(lr.r))"
    filled = f"concat(lr.l, array_repeat('0', greatest({missing}, 0)), lr.r)"
    joined = f"array_join(transform({filled}, g -> {_sub('g', '^0+(?=.)', '')}), ':')"
    full = sql_let(
        f"named_struct('n', size(halves), 'l', {groups('halves[0]')}, 'r', {groups(chr(39) * 2)})", "lr",
        f"CASE WHEN lr.n = 1 AND {missing} = 0 THEN {joined} END")
    halved = sql_let(
        f"named_struct('l', {groups('halves[0]')}, 'r', {groups('halves[1]')})", "lr",
        f"CASE WHEN {missing} >= 1 THEN {joined} END")
    expanded = sql_let("split(six, '::', -1)", "halves", f"CASE WHEN size(halves) = 2 THEN {halved} ELSE {full} END")
    compressed = "CASE"
    for run in range(8, 1, -1):
        zeros = r"^(.*?)(?:^|:)0(?::0){%d}(?:$|:)(.*)$" % (run - 1)
        compressed += f" WHEN {_matches('whole', zeros)} THEN {_sub('whole', zeros, '$1::$2')}"
    compressed += " ELSE whole END"
    return sql_let(plain, "six", f"CASE WHEN {_matches('six', _V6_SHAPE)} THEN {sql_let(expanded, 'whole', compressed)} END")


def _punycode(label: str) -> str:
    """A label of at least one non-ASCII character in the bootstring encoding of RFC 3492 (base 36, bias 72, first code 128)."""
    codes = f"transform(sequence(1, length({label})), i -> CAST(ascii(substring({label}, i, 1)) AS BIGINT))"
    digit = "substring('abcdefghijklmnopqrstuvwxyz0123456789', CAST({0} AS INT) + 1, 1)"
    number = (  # delta in digits whose range depends on the bias
        "aggregate(sequence(1L, 8L), named_struct('q', s.delta, 'out', '', 'open', true), (v, k) -> CASE WHEN NOT v.open THEN v ELSE "
        + sql_let(
            "greatest(1L, least(26L, 36 * k - s.bias))", "t",
            f"CASE WHEN v.q < t THEN named_struct('q', v.q, 'out', concat(v.out, {digit.format('v.q')}), 'open', false) "
            f"ELSE named_struct('q', (v.q - t) DIV (36 - t), 'out', concat(v.out, {digit.format('(t + (v.q - t) % (36 - t))')}), 'open', true) END")
        + " END, v -> v.out)"
    )
    share = "(CASE WHEN s.done = basic THEN s.delta DIV 700 ELSE s.delta DIV 2 END)"
    bias = (
        f"aggregate(sequence(1, 6), named_struct('d', {share} + {share} DIV (s.done + 1), 'k', 0L), "
        "(b, i) -> CASE WHEN b.d > 455 THEN named_struct('d', b.d DIV 35, 'k', b.k + 36) ELSE b END, b -> b.k + 36 * b.d DIV (b.d + 38))"
    )

    def state(delta: str, bias: str, done: str, out: str) -> str:
        return f"named_struct('delta', {delta}, 'bias', {bias}, 'done', {done}, 'out', {out})"

    read = (  # one code of the label, while all codes below ``m`` are written
        f"(s, c) -> CASE WHEN c < m THEN {state('s.delta + 1', 's.bias', 's.done', 's.out')} "
        f"WHEN c = m THEN {state('0L', bias, 's.done + 1', f'concat(s.out, {number})')} ELSE s END"
    )
    write = (
        "(r, m) -> aggregate(codes, "
        + state("r.s.delta + (m - r.n) * (r.s.done + 1)", "r.s.bias", "r.s.done", "r.s.out")
        + f", {read}, s -> named_struct('s', {state('s.delta + 1', 's.bias', 's.done', 's.out')}, 'n', m + 1))"
    )
    head = "concat(array_join(transform(filter(codes, c -> c < 128), c -> char(c)), ''), CASE WHEN basic > 0 THEN '-' ELSE '' END)"
    run = f"aggregate(array_sort(array_distinct(filter(codes, c -> c >= 128))), named_struct('s', {state('0L', '72L', 'basic', head)}, 'n', 128L), {write}, r -> r.s.out)"
    return sql_let(codes, "codes", sql_let("CAST(size(filter(codes, c -> c < 128)) AS BIGINT)", "basic", run))


# The characters that the newer rules for host names keep and the older ones map away, the signs after
# which a joiner may stand, and the letters between which the non-joiner may.
_KEPT_LETTERS = "\u00DF\u03C2"
_NON_JOINER, _JOINER = "\u200C", "\u200D"
_VIRAMAS = (
    "\u094D\u09CD\u0A4D\u0ACD\u0B4D\u0BCD\u0C4D\u0CCD\u0D3B\u0D3C\u0D4D\u0DCA\u0E3A\u0EBA\u0F84\u1039\u103A\u1714\u1734\u17D2"
    "\u1A60\u1B44\u1BAA\u1BAB\u1BF2\u1BF3\u2D7F\uA806\uA8C4\uA953\uA9C0\uAAF6\uABED"
)
_JOINS_ON = "\u0620\u0626\u0628\u062A-\u062E\u0633-\u063F\u0641-\u0647\u0649\u064A\u066E\u066F\u0678-\u0687\u069A-\u06BF\u06C1\u06C2\u06CC\u06CE\u06D0\u06D1\u06FA-\u06FC\u06FF"
_DEVIATES = f"[{_KEPT_LETTERS}{_NON_JOINER}{_JOINER}]"
_STRAY_JOINER = (
    f"(?<![{_VIRAMAS}]){_JOINER}|(?<![{_VIRAMAS}{_JOINS_ON}]){_NON_JOINER}"
    f"|(?<=[{_JOINS_ON}]){_NON_JOINER}(?!\\p{{IsArabic}})"
)


def _international(named: str) -> str:
    """The ASCII form of a host; null when there is none.

    ``java.net.IDN`` knows the older rules, which map four characters away that browsers keep. A label with one of them is
    mapped piece by piece between them and encoded here; a joiner out of place is an error.
    """
    known = "lower(try_reflect('java.net.IDN', 'toASCII', {0}))"
    mapped = "CASE WHEN {0} rlike '[^ -~]' THEN try_reflect('java.net.IDN', 'toUnicode', " + known + ") ELSE lower({0}) END"
    pieces = f"regexp_extract_all(label, {sql_text(f'{_DEVIATES}|[^{_DEVIATES[1:-1]}]+')}, 0)"
    kept = f"transform({pieces}, piece -> CASE WHEN {_matches('piece', f'^{_DEVIATES}$')} THEN piece ELSE {mapped.format('piece')} END)"
    joined, encoded = "array_join(pieces, '')", f"concat('xn--', {_punycode('text')})"
    whole = sql_let(kept, "pieces", f"CASE WHEN NOT exists(pieces, x -> x IS NULL) THEN {sql_let(joined, 'text', encoded)} END")
    label = (
        f"CASE WHEN {_matches('label', _STRAY_JOINER)} THEN NULL WHEN {_matches('label', _DEVIATES)} THEN {whole} "
        f"WHEN {_matches('label', '[^ -~]')} THEN {known.format('label')} ELSE lower(label) END"
    )
    dots = "[.\u3002\uFF0E\uFF61]"
    labels = sql_let(
        f"transform(split({named}, {sql_text(dots)}, -1), label -> {label})", "labels",
        "CASE WHEN NOT exists(labels, x -> x IS NULL) THEN array_join(labels, '.') END")
    return f"CASE WHEN {_matches(named, _DEVIATES)} THEN {labels} ELSE {known.format(named)} END"


def _canonical_host(raw: str) -> str:
    decoded = f"CASE WHEN contains({raw}, '%') THEN {_percent_decode(f'replace({raw}, {sql_text(chr(43))}, {sql_text(chr(37) + str(2) + chr(66))})')} ELSE {raw} END"
    ascii_form = (
        f"CASE WHEN {_matches('named', '[^ -~]')} THEN {_international('named')} ELSE lower(named) END"
    )
    checked = (
        f"CASE WHEN length(host) = 0 OR {_matches('host', _FORBIDDEN_HOST)} THEN NULL "
        f"WHEN {_matches('host', '(?:^|[.])(?:[0-9]+|0x[0-9a-f]*)[.]?$')} THEN {_ipv4('host')} ELSE host END"
    )
    domain = sql_let(sql_let(decoded, "named", ascii_form), "host", checked)
    literal = f"concat('[', {_ipv6('lower(' + _group(raw, '^.(.*).$', 1) + ')')}, ']')"
    return f"CASE WHEN startswith({raw}, '[') THEN {literal} ELSE {domain} END"


# --- whole URLs ----------------------------------------------------------------------------------


def _fold_dots(path: str) -> str:
    """Resolve ``.`` and ``..`` segments of a path that starts with a slash."""
    closed = _sub(path, r"(?i)(/(?:\.|%2e){1,2})$", "$1/")
    plain = "replace(lower(segment), '%2e', '.')"
    step = (
        f"(done, segment) -> CASE WHEN {plain} = '..' THEN slice(done, 1, greatest(size(done) - 1, 0)) "
        f"WHEN {plain} = '.' THEN done ELSE array_append(done, segment) END"
    )
    folded = f"aggregate(split(substring({closed}, 2), '/', -1), CAST(array() AS ARRAY<STRING>), {step})"
    return f"CASE WHEN {_matches(path, _DOT_SEGMENT)} THEN concat('/', array_join({folded}, '/')) ELSE {path} END"


def _canonical_path(raw: str) -> str:
    slashed = f"replace({raw}, {sql_text(chr(92))}, '/')"
    rooted = f"CASE WHEN length({raw}) = 0 THEN '/' ELSE {slashed} END"
    return sql_let(sql_let(rooted, "rooted", _percent_encode("rooted", _PATH_KEEPS)), "path", _fold_dots("path"))


def _port(scheme: str, raw: str) -> str:
    """Port text, '' for none or the default one, null when it is not a port."""
    default = f"CASE WHEN {scheme} = 'http' THEN '80' ELSE '443' END"
    return sql_let(
        _sub(raw, "^0+(?=.)", ""), "digits",
        f"CASE WHEN length(digits) = 0 OR digits = {default} THEN '' "
        f"WHEN length(digits) <= 5 AND try_cast(digits AS INT) <= 65535 THEN digits END")


def _userinfo(raw: str) -> str:
    user = _percent_encode(_group(raw, "(?s)^([^:]*)", 1), _USERINFO_KEEPS)
    password = _percent_encode(_group(raw, "(?s)^[^:]*:(.*)$", 1), _USERINFO_KEEPS)
    both = sql_let(
        f"named_struct('u', {user}, 'p', {password})", "login",
        "CASE WHEN length(login.p) = 0 THEN login.u ELSE concat(login.u, ':', login.p) END")
    return f"CASE WHEN length({raw}) = 0 THEN '' ELSE {both} END"


def _parser() -> str:
    parsed = (
        f"named_struct('scheme', scheme, 'userinfo', {_userinfo('auth[0]')}, 'host', {_canonical_host('auth[1]')}, "
        f"'port', {_port('scheme', 'auth[2]')}, 'path', {_canonical_path('found[2]')}, 'query', found[3], 'fragment', found[4])"
    )
    split_up = sql_let(
        "lower(found[0])", "scheme",
        sql_let(_groups("found[1]", _AUTHORITY, 3), "auth", f"CASE WHEN size(auth) = 3 THEN {parsed} END"))
    whole = sql_let(
        _groups("cleaned", _URL, 5), "found",
        f"CASE WHEN size(found) = 5 THEN {sql_let(split_up, 'url', 'CASE WHEN url.host IS NOT NULL AND url.port IS NOT NULL THEN url END')} END")
    plain = (
        "named_struct('scheme', plain[0], 'userinfo', '', 'host', plain[1], 'port', '', "
        "'path', CASE WHEN plain[2] = '' THEN '/' ELSE plain[2] END, 'query', plain[3], 'fragment', plain[4])"
    )
    slow = sql_let(_cleaned("raw"), "cleaned", whole)
    fits = "size(plain) = 5 AND NOT contains(raw, '\\n')"
    return "raw -> " + sql_let(_groups("raw", _PLAIN, 5), "plain", f"CASE WHEN {fits} THEN {plain} ELSE {slow} END")


_PARSER = _parser()


def parse_http_url(col: Column | str) -> Column:
    """struct(scheme, userinfo, host, port, path, query, fragment) of an http(s) URL, else null.

    ``query`` and ``fragment`` keep their ``?`` / ``#`` and are '' when absent.
    """
    return apply_sql(as_col(col), _PARSER)


_ORIGIN = (
    "concat(p.scheme, '://', CASE WHEN length(p.userinfo) > 0 THEN concat(p.userinfo, '@') ELSE '' END, p.host, "
    "CASE WHEN length(p.port) > 0 THEN concat(':', p.port) ELSE '' END)"
)


def normalize_path(path: Column | str) -> Column:
    """Repeated slashes become one; trailing ones go, except for the root."""
    collapsed = F.regexp_replace(as_col(path), "/{2,}", "/")
    return F.when(collapsed == "/", collapsed).otherwise(F.regexp_replace(collapsed, "/+$", ""))


def query_params(query: Column | str) -> Column:
    """Decoded (key, value) structs of a query string in their original order."""

    def pair(item: Column) -> Column:
        def decoded(pattern: str) -> Column:
            raw = F.regexp_extract(item, pattern, 1)
            return F.url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))

        return F.struct(
            decoded("(?s)^([^=]*)").alias("key"), decoded("(?s)^[^=]*=(.*)$").alias("value"))

    items = F.split(F.regexp_replace(as_col(query), r"^\?", ""), "&", -1)
    return F.transform(F.filter(items, lambda item: F.length(item) > 0), pair)


def strip_tracking(params: Column | str) -> Column:
    def keep(param: Column) -> Column:
        key = F.lower(param["key"])
        return ~(F.startswith(key, F.lit(TRACKING_PREFIX)) | key.isin(TRACKING_KEYS))

    return F.filter(as_col(params), keep)


def sort_params(params: Column | str) -> Column:
    """Order by key, then value, in locale order; equal pairs keep their order."""

    def ranked(param: Column, position: Column) -> Column:
        return F.struct(
            F.collate(param["key"], "UNICODE").alias("key_order"),
            F.collate(param["value"], "UNICODE").alias("value_order"),
            position.alias("position"),
            param.alias("param"),
        )

    source = as_col(params)
    ordered = F.transform(F.array_sort(F.transform(source, ranked)), lambda r: r["param"])
    return F.when(F.size(source) > 1, ordered).otherwise(source)


def encode_params(params: Column | str) -> Column:
    pairs = F.transform(as_col(params), lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])))
    return F.array_join(pairs, "&")


def _normalizer() -> str:
    """The normalization of a parsed URL ``p`` as SQL text, with the same steps as the functions above."""
    item = "CAST(item AS STRING)"
    decoded = [
        _percent_decode(_group(item, pattern, 1)) for pattern in ("(?s)^([^=]*)", "(?s)^[^=]*=(.*)$")
    ]
    params = (
        f"transform(filter(split(substring(p.query, 2), '&', -1), item -> length(item) > 0), "
        f"item -> named_struct('key', {decoded[0]}, 'value', {decoded[1]}))"
    )
    keys = ", ".join(sql_text(k) for k in TRACKING_KEYS)
    kept = f"filter({params}, kv -> NOT (startswith(lower(kv.key), {sql_text(TRACKING_PREFIX)}) OR lower(kv.key) IN ({keys})))"
    ranked = (
        "transform(kept, (kv, i) -> named_struct('k', collate(kv.key, 'UNICODE'), 'v', collate(kv.value, 'UNICODE'), "
        "'i', i, 'key', kv.key, 'value', kv.value))"
    )

    def encoded(source: str) -> str:
        return f"array_join(transform({source}, e -> concat(url_encode(e.key), '=', url_encode(e.value))), '&')"

    query = (
        f"CASE WHEN size(kept) = 0 THEN '' WHEN size(kept) = 1 THEN concat('?', {encoded('kept')}) "
        f"ELSE concat('?', {encoded(f'array_sort({ranked})')}) END"
    )
    suffix = f"CASE WHEN length(p.query) <= 1 THEN '' ELSE {sql_let(kept, 'kept', query)} END"
    path = sql_let(
        f"CASE WHEN contains(p.path, '//') THEN {_sub('p.path', '/{2,}', '/')} ELSE p.path END", "path",
        f"CASE WHEN path = '/' OR NOT endswith(path, '/') THEN path ELSE {_sub('path', '/+$', '')} END")
    return f"p -> concat({_ORIGIN}, {path}, {suffix})"


_NORMALIZER = _normalizer()


def normalize_parts(parts: Column) -> Column:
    """Comparable form of a parsed URL: no fragment, no tracking, sorted parameters."""
    return apply_sql(parts, _NORMALIZER)


def normalize_url(col: Column | str) -> Column:
    """Comparable form of a URL, null when it is none; one that has this form already is not parsed."""
    raw = as_col(col)
    return F.when(raw.rlike(_NORMAL), raw).otherwise(normalize_parts(parse_http_url(raw)))


def safe_normalize(col: Column | str) -> Column:
    return F.coalesce(normalize_url(col), as_col(col))


def _serializer() -> str:
    query = _percent_encode("p.query", _QUERY_KEEPS)
    fragment = _percent_encode("p.fragment", _FRAGMENT_KEEPS)
    return (
        f"p -> concat({_ORIGIN}, p.path, CASE WHEN length(p.query) <= 1 THEN p.query ELSE {query} END, "
        f"CASE WHEN length(p.fragment) <= 1 THEN p.fragment ELSE {fragment} END)"
    )


_SERIALIZER = _serializer()


def canonical_url(col: Column | str) -> Column:
    """Serialized form of an absolute http(s) URL, keeping query order and fragment."""
    raw = as_col(col)
    return F.when(raw.rlike(_PLAIN_SERIALIZED), raw).otherwise(apply_sql(parse_http_url(raw), _SERIALIZER))


def _joiner() -> str:
    """Absolute text for reference ``s.ref`` seen from the parsed base ``s.base``."""
    origin = sql_let("s.base", "p", _ORIGIN)
    same_scheme = f"(lower(ref0) rlike concat('(?s)^', s.base.scheme, ':(?!/|{chr(92) * 4}).*$'))"
    bare = sql_let(_cleaned("s.ref"), "ref0", f"CASE WHEN {same_scheme} THEN {_sub('ref0', _SCHEME, '')} ELSE ref0 END")
    joined = (
        f"CASE WHEN {_matches('r', _SCHEME)} THEN r "
        f"WHEN {_matches('r', r'^[/\\]{2}')} THEN concat(s.base.scheme, ':', r) "
        f"WHEN {_matches('r', r'^[/\\]')} THEN concat({origin}, r) "
        f"WHEN length(r) = 0 THEN concat({origin}, s.base.path, s.base.query) "
        f"WHEN startswith(r, '?') THEN concat({origin}, s.base.path, r) "
        f"WHEN startswith(r, '#') THEN concat({origin}, s.base.path, s.base.query, r) "
        f"ELSE concat({origin}, {_sub('s.base.path', '[^/]*$', '')}, r) END"
    )
    return f"s -> CASE WHEN s.base IS NOT NULL THEN {sql_let(bare, 'r', joined)} END"


_JOINER = _joiner()


def resolve_url(href: Column | str, base: Column | str) -> Column:
    """Absolute form of ``href`` seen from ``base``; null when either cannot be parsed.

    A path from the root that needs no canonicalization only takes the origin of a base that needs none.
    """
    head = F.regexp_extract(as_col(base), _PLAIN_ORIGIN, 1)
    rooted = as_col(href).rlike(_ROOTED) & (F.length(head) > 0)
    both = F.struct(parse_http_url(base).alias("base"), as_col(href).alias("ref"))

    def finish(target: Column) -> Column:
        other = target.rlike(_SCHEME) & ~target.rlike("(?i)^https?:")
        return F.when(other, target).otherwise(canonical_url(target))

    return F.when(rooted, F.concat(head, as_col(href))).otherwise(let(apply_sql(both, _JOINER), finish))


# --- domains and the outbound guard --------------------------------------------------------------


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def normalize_domain(col: Column | str) -> Column:
    """Bare host of a domain or URL without one leading ``www.``; null when invalid."""
    text = as_col(col)
    candidate = F.when(F.contains(text, F.lit("://")), text).otherwise(F.concat(F.lit("https://"), text))
    return strip_www(parse_http_url(candidate)["host"])


def host_within(host: Column, domain: Column | str) -> Column:
    bare, allowed = strip_www(host), strip_www(as_col(domain))
    return (bare == allowed) | F.endswith(bare, F.concat(F.lit("."), allowed))


def same_host(url: Column | str, domain: Column | str) -> Column:
    return let(parse_http_url(url)["host"], lambda host: host_within(host, domain))


def is_blocked_ip(host: Column | str) -> Column:
    """Private, loopback, link-local, multicast or malformed IP literals."""
    value = F.lower(as_col(host))
    quad = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"

    def octet(i: int) -> Column:
        digits = F.regexp_extract(value, quad, i)
        return F.when(F.length(digits) > 0, digits).cast("int")

    a, b = octet(1), octet(2)
    v4 = (
        (F.greatest(a, b, octet(3), octet(4)) > 255)
        | a.isin(0, 10, 127)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | (a >= 224)
    )
    bare = F.regexp_replace(value, r"^\[|\]$", "")
    v6 = F.contains(bare, F.lit(":")) & bare.rlike("^(?:::1?$|f[cd]|fe[89ab])")
    return F.when(value.rlike(quad), v4).otherwise(v6)


def outside_reason(host: Column, domain: Column | str) -> Column:
    return F.concat(F.lit("Outbound host "), host, F.lit(" is outside competitor domain "), as_col(domain))


def guard_parts(parts: Column, raw: Column, domain: Column | str) -> Column:
    """Reason to refuse a parsed URL, null when it may be requested."""
    host = parts["host"]
    return (
        F.when(parts.isNull() & raw.rlike(_SCHEME) & ~raw.rlike("(?i)^https?:"), F.lit(REASON_SCHEME))
        .when(parts.isNull(), F.lit(REASON_INVALID))
        .when(F.length(parts["userinfo"]) > 0, F.lit(REASON_CREDENTIALS))
        .when(host.isin("localhost", "localhost.localdomain") | F.endswith(host, F.lit(".localhost")),
              F.lit(REASON_LOCALHOST))
        .when(is_blocked_ip(host), F.lit(REASON_PRIVATE_IP))
        .when(~host_within(host, domain), outside_reason(host, domain))
    )


def outbound_guard(url: Column | str, domain: Column | str) -> Column:
    """struct(ok, reason) for a URL about to be requested on behalf of ``domain``."""
    raw = as_col(url)
    reason = let(parse_http_url(raw), lambda p: guard_parts(p, raw, domain))
    return let(reason, lambda r: F.struct(r.isNull().alias("ok"), r.alias("reason")))


def inspect_url(url: Column | str, domain: Column | str) -> Column:
    """struct(normalized_url, reason): guard and normalization from one parse.

    A URL in normal form with a host of the domain is not parsed: its host is a name, without login or port.
    """
    raw = as_col(url)
    host = F.regexp_extract(raw, _PLAIN_HEAD, 2)
    local = host.isin("localhost.localdomain") | F.endswith(host, F.lit(".localhost"))
    whole = let(
        parse_http_url(raw),
        lambda p: F.struct(
            normalize_parts(p).alias("normalized_url"),
            guard_parts(p, raw, domain).alias("reason"),
        ),
    )
    allowed = F.struct(raw.alias("normalized_url"), F.lit(None).cast("string").alias("reason"))
    return F.when(raw.rlike(_NORMAL) & ~local & host_within(host, domain), allowed).otherwise(whole)
