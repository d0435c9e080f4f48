"""Text expressions: keys, similarity, hashing, masking and guards, all as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_key(title: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", "")


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the text without white space; none below three characters.

    A look-ahead takes the three characters at every place, so a long text is
    read once; a place inside a surrogate pair takes none.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?s)(?=([^\uDC00-\uDFFF]..))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct-element arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def content_hash(*parts: Column) -> Column:
    """sha256 over the parts, each followed by a NUL; null parts are empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.decode(F.unhex(F.lit("00")), "UTF-8"))]), 256)


def ref_key(post_id: Column, url: Column) -> Column:
    return F.sha2(F.when(post_id.isNotNull(), F.concat(F.lit("id:"), post_id)).otherwise(F.concat(F.lit("url:"), url)), 256)


# What is masked, in this order, and by what.
MASKS = (
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [비밀값]"),
    (r"(?i)\b(?:sk|rk|pk)-[A-Za-z0-9_-]{8,}", "[API키]"),
    (r"(?i)\b(?:api[_ -]?key|access[_ -]?token|password|비밀번호|계좌번호)\s*[:=]\s*[^\s,;]+", "[비밀값]"),
    (r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}", "[전화번호]"),
    (r"(?<!\d)0(?:2|[3-6][1-5]|70)[-\s]?\d{3,4}[-\s]?\d{4}(?!\d)", "[전화번호]"),
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[이메일]"),
    (r"\d{6}[-\s]?[1-4]\d{6}", "[주민번호]"),
    (r"(?im)^(?:\s*(?:성명|이름|연락처|전화번호|주소|근무지 주소|상세 주소)\s*[:：]\s*).+$", "[개인정보 항목]"),
    (r"https?://[^\s<>\"']+", "[URL]"),
)


def mask_personal(text: Column) -> Column:
    for pattern, name in MASKS:
        text = F.regexp_replace(text, "(?U)" + pattern, name)
    return text


def csv_safe(value: Column) -> Column:
    """Put a quote before cells that a spreadsheet would run as formulas."""
    return F.when(value.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), value)).otherwise(value)


def safe_url(url: Column) -> Column:
    """The trimmed URL if it is http(s) with a host, else null."""
    u = F.trim(url)
    return F.when(u.rlike("^(?i:https?)://[^/?#]"), u)


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, query kept."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_replace(F.substr(url, F.length(head) + 1), "#.*$", "")
    return F.concat(F.lower(head), rest)


def first_sentence(text: Column, limit: int = 90) -> Column:
    """The first sentence of the first line of six characters or more, mark included, cut to ``limit`` with an ellipsis; null without one."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.btrim(x, F.lit(" -•*\t")))

    def sentence(line: Column) -> Column:
        head = F.regexp_extract(line, r"(?U)^(.+?[.!?])(?:\s|$)", 1)
        found = F.when(head != "", head).otherwise(line)
        return F.when(F.length(found) > limit, F.concat(F.substring(found, 1, limit - 1), F.lit("…"))).otherwise(found)

    return sentence(F.get(F.filter(lines, lambda x: F.length(x) >= 6), F.lit(0)))


# The named character references that plain texts still carry.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """The common character references; the HTML reader resolves all of them."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def normalize_text(text: Column) -> Column:
    """Unix line ends, single blanks, trimmed lines, at most one empty line in a row."""
    t = F.replace(F.replace(unescape(text), F.lit("\r\n"), F.lit("\n")), F.lit("\u00a0"), F.lit(" "))
    t = F.array_join(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"(?U)^\s+|\s+$", "")), "\n")
    return F.btrim(F.regexp_replace(t, r"\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def matches_all(text: Column, keyword: str, most: int = 5) -> Column:
    """Whether the text holds each of the first ``most`` white-space separated tokens, case apart."""
    found = F.lit(True)
    for token in keyword.strip().lower().split()[:most]:
        found = found & F.contains(text, F.lit(token))
    return found


def grounded(quotes: Column, *sources: Column) -> Column:
    """Whether every quote occurs in one of the sources."""

    def anywhere(q: Column) -> Column:
        found = F.lit(False)
        for s in sources:
            found = found | F.contains(s, q)
        return found

    return F.forall(quotes, anywhere)


def post_slug(title: Column) -> Column:
    """Lower-case runs of Latin letters, digits and Hangul joined by hyphens."""
    return F.btrim(F.regexp_replace(F.lower(title), "[^0-9a-z가-힣]+", "-"), F.lit("-"))


# Fixed value: the label of the chat tab, with the number of unread messages if there are any.
BADGE = r"^채팅(?:, 읽지 않은 메시지 ([0-9]{1,7})개)?$"


def badge_count(label: Column) -> Column:
    """The number of unread messages that the tab shows, 0 if none; null for any other label."""
    shown = F.regexp_extract(label, BADGE, 1)
    return F.when(label.rlike(BADGE), F.coalesce(shown.try_cast("int"), F.lit(0)))


# What a log line must not show, in this order, and by what it is replaced.
LOG_MASKS = (
    (r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [masked]"),
    (r"(?i)(token|api[_-]?key|authorization)(\"?\s*[:=]\s*\"?)[^\s\",]+", "$1$2[masked]"),
    (r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}", "[phone]"),
    (r"[\w.+-]+@[\w-]+\.[\w.]+", "[email]"),
    (r"(?<!\d)0(?:2|[3-6][1-5])[-\s]\d{3,4}[-\s]\d{4}(?!\d)", "[phone]"),
    (r"(?<!\d)\d{6}[-\s]?[1-4]\d{6}(?!\d)", "[identity]"),
)


def redact_log(line: Column, secrets: tuple[str, ...] = ()) -> Column:
    for secret in filter(None, secrets):
        line = F.replace(line, F.lit(secret), F.lit("[masked]"))
    for pattern, name in LOG_MASKS:
        line = F.regexp_replace(line, "(?U)" + pattern, name)
    return line


def public_post_id(url: Column, host: str, path: str) -> Column:
    """The number of a link with exactly this https host and path; null for any other link."""
    found = F.regexp_extract(url, rf"^https://{host.replace('.', '[.]')}{path}/([0-9]+)/?(?:[?#].*)?$", 1)
    return F.nullif(found, F.lit(""))


def template_lines(body: Column, filler: str = "\u3164") -> Column:
    """A template's lines; a line of the filler character alone counts as empty."""
    return F.transform(F.split(F.replace(body, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: F.when(x == filler, "").otherwise(x))
