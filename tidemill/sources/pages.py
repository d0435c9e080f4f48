"""Web pages to columns: one small reader in Arrow batches, everything after it column logic.

``read_pages`` turns markup into title, canonical link, meta data, links,
structured-data nodes, plain text and the elements that carry labels; parsers
of job posts, boards and community pages are expressions over those.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..analysis.pay import budget_label, structured_salary
from ..functions.clock import ZONE_HOURS, parse_iso
from ..functions.clock import at as instant
from ..functions.matches import has, let
from ..functions.text import canonical_url, normalize_text

# Elements whose content is no text, and those that begin a line.
HIDDEN = ("style", "noscript", "template", "script")
LINES = ("br", "p", "div", "li", "tr", "h1", "h2", "h3", "section")
LABELLED = ("a", "button", "form", "dialog", "h1", "h2", "span", "p", "time", "li", "div", "article")
EMPTY = ("br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr")

NODE = "struct<tag:string,class:string,href:string,role:string,label:string,inside:string,text:string>"
CONTENT = f"title string, canonical string, meta map<string,string>, links array<string>, data array<string>, text string, nodes array<{NODE}>"


class Reader(HTMLParser):
    """One pass over a page; open labelled elements collect the text inside them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict = {"title": None, "canonical": None, "meta": {}, "links": [], "data": [], "text": [], "nodes": []}
        self.open: list[tuple[str, dict | None, list[str]]] = []
        self.hidden, self.structured, self.in_title = 0, None, False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k.lower(): v or "" for k, v in attrs}
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.structured = []
        elif tag in HIDDEN:
            self.hidden += 1
        elif tag == "meta" and "content" in a and (name := (a.get("property") or a.get("name") or "").lower()):
            self.found["meta"][name] = a["content"]
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.found["canonical"] = a.get("href") or None
        elif tag == "title":
            self.in_title = True
        if tag == "a" and a.get("href"):
            self.found["links"].append(a["href"])
        if tag in LINES:
            self.found["text"].append("\n")
        if tag not in EMPTY and tag not in HIDDEN:
            node = None
            if tag in LABELLED:
                around = " ".join(n["class"] for _, n, _ in self.open if n and n["class"])
                node = {"tag": tag, "class": a.get("class", ""), "href": a.get("href"), "role": a.get("role"), "label": a.get("aria-label"), "inside": around, "text": ""}
                self.found["nodes"].append(node)
            self.open.append((tag, node, []))

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.structured is not None:
            self.found["data"] += nodes_of("".join(self.structured))
            self.structured = None
        elif tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        if any(t == tag for t, _, _ in self.open):
            while self.open:
                at, node, words = self.open.pop()
                text = " ".join(words).strip()
                if node is not None:
                    node["text"] = text
                if self.open and text:
                    self.open[-1][2].append(text)
                if at == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.structured is not None:
            self.structured.append(data)
        elif self.in_title:
            self.found["title"] = (self.found["title"] or "") + data
        elif not self.hidden:
            self.found["text"].append(data)
            if self.open and data.strip():
                self.open[-1][2].append(data.strip())


def nodes_of(block: str) -> list[str]:
    """The objects of a structured-data block, lists and graphs taken apart breadth first; none if it is no JSON."""
    try:
        found = json.loads(block.strip())
    except ValueError:
        return []
    waiting, out = found if isinstance(found, list) else [found], []
    for node in waiting:  # grows while it is walked
        if isinstance(node, dict):
            if isinstance(node.get("@graph"), list):
                waiting.extend(node["@graph"])
            out.append(json.dumps(node, ensure_ascii=False))
    return out


def read_page(markup: str | None, url: str | None) -> dict:
    reader = Reader()
    reader.feed(markup or "")
    reader.close()
    while reader.open:
        reader.handle_endtag(reader.open[-1][0])
    found = reader.found
    absolute = [_join(url, x) for x in found["links"]]
    nodes = [n | {"href": _join(url, n["href"]) if n["href"] else None} for n in found["nodes"]]
    return found | {"links": absolute, "nodes": nodes, "text": "".join(found["text"]), "meta": list(found["meta"].items())}


def _join(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def read_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` without its markup, with the columns of CONTENT.  A null page is empty."""
    kept = [c for c in pages.columns if c != html]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema) + ", " + CONTENT
    names = ["title", "canonical", "meta", "links", "data", "text", "nodes"]
    node = pa.struct([(k, pa.string()) for k in ("tag", "class", "href", "role", "label", "inside", "text")])
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(node)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [read_page(m.as_py(), u.as_py()) for m, u in zip(part.column(html), part.column(url), strict=True)]
                columns = [part.column(c) for c in kept] + [pa.array([f[n] for f in found], t) for n, t in zip(names, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return pages.mapInArrow(run, shape)


def only_escaped(markup: Column) -> Column:
    """Markup whose only character references are the five that escaping writes, whole; any other ``&`` is text.

    For pages made by escaping texts and cutting them, where ``&amp`` without
    its end is what was left of the text and no ``&``.
    """
    return F.regexp_replace(markup, "&(?!(?:lt|gt|quot|#x27|amp);)", "&amp;")


def html_text(fragment: Column) -> Column:
    """Plain text of a fragment of markup; batches travel as Arrow."""
    return F.udf(lambda x: None if x is None else read_page(f"<div>{x}</div>", None)["text"], "string", useArrow=True)(fragment)


def links(pattern: str) -> Column:
    """A page's absolute links that hold the pattern, each once, in order."""
    return F.array_distinct(F.filter("links", lambda x: x.rlike(pattern)))


def listing_state(found: Column, empty_markers: tuple[str, ...]) -> Column:
    """``listed``, ``empty`` where the page says so, else ``unreadable``: no links and no mark may be a changed page."""
    says = F.lit(False)
    for m in filter(None, empty_markers):
        says = says | F.contains("text", F.lit(m))
    return F.when(F.size(found) > 0, "listed").when(says, "empty").otherwise("unreadable")


def job_posting() -> Column:
    """The first structured node typed JobPosting, as JSON text; null without one."""
    kind = lambda n: F.coalesce(F.get_json_object(n, "$['@type']"), F.lit(""))
    return F.get(F.filter("data", lambda n: (kind(n) == "JobPosting") | kind(n).rlike(r'^\[.*"JobPosting".*\]$')), F.lit(0))


def location_text(posting: Column) -> Column:
    """Region, locality and street of each job location; null without any."""
    raw = F.get_json_object(posting, "$.jobLocation")
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))

    def one(place: Column) -> Column:
        address = F.get_json_object(place, "$.address")
        parts = F.array(*[F.btrim(F.coalesce(F.get_json_object(address, f"$.{k}"), F.lit(""))) for k in ("addressRegion", "addressLocality", "streetAddress")])
        return F.when(address.startswith("{"), F.array_join(F.filter(parts, lambda x: x != ""), " ")).otherwise(address)

    return F.nullif(F.array_join(F.filter(F.transform(listed, one), lambda x: x.isNotNull() & (x != "")), ", "), F.lit(""))


@dataclass(frozen=True)
class Profile:
    """What a survey of a site has found out; it drives the parsers without code."""

    allowed_hosts: tuple[str, ...] = ()
    post_id_pattern: str = r"-([0-9a-z]+)/?$"
    closed_markers: tuple[str, ...] = ()
    open_markers: tuple[str, ...] = ()
    valid_through_means_open: bool = False
    block_markers: tuple[str, ...] = ()

    def missing(self) -> list[str]:
        return [k for k in ("allowed_hosts", "post_id_pattern") if not getattr(self, k)]


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in filter(None, markers):
        found = found | F.contains(text, F.lit(m))
    return found


def job_posts(read: DataFrame, profile: Profile, observed: Column | str) -> DataFrame:
    """``read_pages`` rows with a job posting as posts; ``outcome`` tells why others are none.

    A closed mark on the page comes before the date until which the posting
    holds, and that before an open mark.
    """
    field = lambda name: F.get_json_object("posting", f"$.{name}")
    rows = read.withColumn("posting", job_posting()).withColumn("page_text", normalize_text(F.col("text")))
    rows = rows.withColumns({"post_title": normalize_text(field("title")), "body": normalize_text(html_text(field("description"))), "until": parse_iso(field("validThrough")), "published": parse_iso(field("datePosted"))})
    passed = F.col("until.at") < instant(observed)
    status = F.when(_any(F.col("page_text"), profile.closed_markers), "closed").when(passed, "closed")
    status = status.when(F.col("until.at").isNotNull() & F.lit(profile.valid_through_means_open), "open").when(_any(F.col("page_text"), profile.open_markers), "open")
    host = F.try_parse_url(F.col("canonical"), F.lit("HOST"))
    address = F.when(host.isin(*profile.allowed_hosts), F.col("canonical")).otherwise(F.col("url")) if profile.allowed_hosts else F.col("url")
    outcome = F.when(_any(F.col("text"), profile.block_markers), "blocked").when(F.col("posting").isNull(), "no_posting").when((F.coalesce("post_title", F.lit("")) == "") | (F.coalesce("body", F.lit("")) == ""), "empty").otherwise("ok")
    post_id = F.coalesce(field("identifier.value"), F.nullif(F.regexp_extract("url", profile.post_id_pattern, 1), F.lit("")))
    return rows.withColumns(
        {
            "outcome": outcome, "post_id": post_id, "canonical_url": canonical_url(address), "source_status": status, "pay": structured_salary(field("baseSalary")), "workplace": location_text(F.col("posting")),
            "remote": F.coalesce(field("jobLocationType") == "TELECOMMUTE", F.lit(False)), "applicants": field("applicantLocationRequirements.name"),
        }
    ).drop("nodes", "links", "data", "meta", "page_text")


def store_nodes(store: Column, edges: str) -> Column:
    """Nodes of an embedded JSON store that the list at ``edges`` refers to by ``__ref``, in order; a missing one is null."""
    table = F.from_json(store, "map<string,string>")
    refs = F.from_json(F.get_json_object(store, edges), "array<struct<__ref:string>>")
    return F.transform(refs, lambda r: F.struct(r["__ref"].alias("ref"), F.try_element_at(table, r["__ref"]).alias("node")))


def feed_posts(store: Column, edges: str = "$.ROOT.edges") -> Column:
    """``post_id, title, closed, pay_unit, listed`` of a feed's posts: closed ones are listed but not taken; monthly pay goes to the end of the list's reasons."""
    node = lambda n, k: F.get_json_object(n["node"], f"$.{k}")
    known = F.filter(store_nodes(store, edges), lambda n: n["node"].isNotNull())
    return F.transform(
        known,
        lambda n: F.struct(
            node(n, "id").alias("post_id"), node(n, "title").alias("title"), (F.coalesce(node(n, "closed"), F.lit("false")) == "true").alias("closed"), node(n, "salaryType").alias("pay_unit"),
        ),
    )


def board_cards(pattern: str) -> DataFrame | Column:
    """``post_id, url, title, place`` of a board's link cards; the first card of a post wins."""
    cards = F.filter("nodes", lambda n: (n["tag"] == "a") & n["href"].rlike(pattern))
    numbered = F.transform(cards, lambda n, i: F.struct(F.regexp_extract(n["href"], pattern, 1).alias("post_id"), n["href"].alias("url"), n["text"].alias("title"), i.alias("place")))
    return F.filter(numbered, lambda c: ~F.exists(numbered, lambda d: (d["post_id"] == c["post_id"]) & (d["place"] < c["place"])))


def closed_button(button: str, text: str, area: str) -> Column:
    """Whether the post's own contact area holds its closed button; cards of other posts lie elsewhere."""
    return F.exists("nodes", lambda n: n["class"].rlike(rf"(?:^|\s){button}(?:\s|$)") & (n["text"] == text) & F.contains(n["inside"], F.lit(area)))


def directory_links(keywords: tuple[str, ...], host: str) -> Column:
    """``url, name`` of community links whose label holds a keyword; a later card of the same link replaces an earlier one."""
    home = rf"^https://{host.replace('.', '[.]')}/[a-zA-Z0-9][a-zA-Z0-9_-]{{0,99}}/?$"
    wanted = lambda n: F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(n["text"]), k)) if keywords else F.lit(True)
    cards = F.filter("nodes", lambda n: (n["tag"] == "a") & F.coalesce(n["href"].rlike(home), F.lit(False)) & (n["text"] != "") & wanted(n))
    plain = F.transform(cards, lambda n, i: F.struct(F.rtrim(n["href"], F.lit("/")).alias("url"), F.substring(n["text"], 1, 200).alias("name"), i.alias("place")))
    return F.filter(plain, lambda c: ~F.exists(plain, lambda d: (d["url"] == c["url"]) & (d["place"] > c["place"])))


# Words of boards for job seekers, and phrases that ban promotion.
BOARD_WORDS = ("구직", "구인구직", "알바 구인", "홍보", "재능", "프리랜서", "외주")
PROMOTION_BANS = ("홍보 금지", "광고 금지", "외부 링크 금지", "구직글 금지")
BOARD_DENIED = r"(?:구직글|홍보글|서비스\s*홍보|외주\s*홍보)[^.!?\n]{0,60}(?:금지|불가|허용하지|허용되지|불허)"
BOARD_ALLOWED = r"(?:구직글|홍보글|서비스 홍보|외주 홍보)\s*(?:을|를|은|는)?\s*(?:게시|등록)?\s*(?:가능|허용)(?:합니다|됩니다|해요|한다|됨)?(?=$|[\s.!?。])"


def board_class(name: Column, rules: Column) -> Column:
    """``kind, post_allowed`` of a board by its name and the rules read there: a ban wins, and only an explicit allowance for this board permits."""
    compact = F.regexp_replace(rules, r"(?U)\s+", "")
    banned = F.lit(False)
    for phrase in PROMOTION_BANS:
        banned = banned | F.contains(compact, F.lit(phrase.replace(" ", "")))
    candidate = _any(name, BOARD_WORDS)
    kind = F.when(candidate, "job_seek").when(F.contains(name, F.lit("자유")), "free").when(F.contains(name, F.lit("구인")), "job_offer").otherwise("other")
    bare = lambda x: F.regexp_replace(x, "[^가-힣a-zA-Z0-9]", "")
    scoped = F.transform(F.regexp_extract_all(rules, F.lit(r"([^.!?\n]+?)게시판(?:에서|에|만|은|는)"), F.lit(1)), bare)
    own = F.regexp_replace(bare(name), "게시판$", "")
    in_scope = ~F.contains(rules, F.lit("게시판")) | F.array_contains(scoped, own)
    return F.struct(kind.alias("kind"), (~banned & ~has(rules, BOARD_DENIED) & candidate & has(rules, BOARD_ALLOWED) & in_scope).alias("post_allowed"))


def session_state(status: Column) -> Column:
    """``logged_in``, ``logged_out`` or ``needs_user``: challenges count only in gates, never in what users wrote."""
    gate = lambda n: n["tag"].isin("form", "dialog", "h1", "h2") | F.coalesce(n["role"] == "dialog", F.lit(False)) | n["class"].rlike("(?i)captcha|challenge")
    gates = F.lower(F.array_join(F.transform(F.filter("nodes", gate), lambda n: n["text"]), " "))
    challenged = gates.rlike("captcha|자동입력 방지|본인 ?인증|계정이 제한|약관에 동의|인증코드가 만료|verify you are a human")
    menu = F.exists("nodes", lambda n: F.coalesce(n["label"] == "사용자 메뉴", F.lit(False)))
    login = F.exists("nodes", lambda n: n["tag"].isin("button", "a") & (n["text"] == "로그인"))
    return F.when(status.isin(401, 403, 429) | challenged, "needs_user").when(menu, "logged_in").when(login, "logged_out").otherwise("needs_user")


def rule_sentences(most: int = 20) -> Column:
    """Sentences about promotion in the article's body, at most ``most``: a report with a limit."""
    bodies = F.transform(F.filter("nodes", lambda n: n["class"].rlike(r"(?:^|\s)article-body(?:\s|$)")), lambda n: n["text"])
    sentences = F.flatten(F.transform(bodies, lambda t: F.split(t, r"(?<=[.!?。])\s+|\n")))
    return F.slice(F.transform(F.filter(sentences, lambda s: s.rlike(r"홍보|광고|구직글|외부\s*링크")), lambda s: F.substring(s, 1, 1000)), 1, most)


def community_home(url: Column, rules: Column) -> Column:
    """``name, members, posts, joined, status`` of a community's front page; being a member shows only in what members can do."""
    number = lambda label: F.replace(F.regexp_extract("text", label + r"\s*([\d,]+)\s*(?:명|개)", 1), F.lit(","), F.lit("")).try_cast("int")
    name = F.get(F.filter("nodes", lambda n: n["tag"].isin("h1", "h2") & (n["text"] != "")), F.lit(0))["text"]
    can_write = F.exists("nodes", lambda n: (n["tag"] == "a") & F.coalesce(n["href"] == F.concat(url, F.lit("/posts/new")), F.lit(False)))
    must_join = F.exists("nodes", lambda n: (n["tag"] == "button") & (n["text"] == "카페 가입하기"))
    boards = F.filter("nodes", lambda n: (n["tag"] == "a") & F.coalesce(n["href"].startswith(F.concat(url, F.lit("/boards/"))), F.lit(False)))
    allowed = F.exists(boards, lambda n: board_class(n["text"], rules)["post_allowed"])
    compact = F.regexp_replace(rules, r"(?U)\s+", "")
    banned = F.exists(F.array(*[F.lit(p.replace(" ", "")) for p in PROMOTION_BANS]), lambda p: F.contains(compact, p))
    joined = F.when(must_join, False).when(can_write, True)
    status = F.when(banned, "excluded").when(must_join, "needs_join").when(F.coalesce(joined, F.lit(False)) & allowed, "eligible").otherwise("candidate")
    return F.struct(F.substring(name, 1, 200).alias("name"), number("멤버").alias("members"), number("게시글").alias("posts"), joined.alias("joined"), status.alias("status"))


def board_post(budget: Column, deadline: Column, observed: Column) -> Column:
    """``pay, deadline_at, closed`` of a board's detail page: the budget's label, the last local day to apply, and the closed button."""
    day = F.try_to_timestamp(F.regexp_extract(deadline, r"(\d{4}[-.]\d{2}[-.]\d{2})", 1), F.lit("yyyy[-][.]MM[-][.]dd")).cast("timestamp_ntz")
    at = day - F.expr(f"INTERVAL {ZONE_HOURS} HOURS")
    closed = closed_button("btn_cash", "마감된 의뢰입니다", "user_info_contact")
    return F.struct(budget_label(budget).alias("pay"), at.alias("deadline_at"), (closed | F.coalesce(at + F.expr("INTERVAL 1 DAY") <= observed, F.lit(False))).alias("closed"))


@dataclass(frozen=True)
class StoreNames:
    """How an embedded store names its parts; a survey of the site fills them in."""

    root: str = "client:root"
    pair: str = "permalinkPairByPublicId(publicId:\"{}\")"
    link: str = "permalink"
    public_id: str = "publicId"
    kind: str = "JobPost"
    title: str = "title(masking:true)"
    body: str = "content(masking:true)"
    refused: str = "webCrawlNotAllowed"
    closed_badge: str = "마감 "


def store_detail(store: Column, post_id: Column, names: StoreNames = StoreNames()) -> Column:
    """``outcome, title, body, source_status, published`` of the post that an embedded store and its page show.

    The store must name the asked id twice and a post of the right kind; hidden
    posts and those whose writer forbids collection, or does not say, are not
    taken; the page must show the store's title once, and its text.
    """
    field = lambda node, name: F.get_json_object(node, f"$['{name}']")
    head, tail = names.pair.split("{}")

    def read(table: Column) -> Column:
        at = lambda node, name: F.try_element_at(table, F.get_json_object(field(node, name), "$.__ref"))
        root = F.from_json(F.try_element_at(table, F.lit(names.root)), "map<string,string>")
        pair = F.try_element_at(table, F.get_json_object(F.try_element_at(root, F.concat(F.lit(head), post_id, F.lit(tail))), "$.__ref"))
        return let(at(pair, names.link), lambda link: let(at(link, "model"), lambda post: judge(link, post, at(post, "user"))))

    def judge(link: Column, post: Column, user: Column) -> Column:
        yes = lambda node, name: F.coalesce(field(node, name) == "true", F.lit(False))
        masked, body = normalize_text(F.coalesce(field(post, names.title), F.lit(""))), normalize_text(F.coalesce(field(post, names.body), F.lit("")))
        texts = lambda tag: F.transform(F.filter("nodes", lambda n: n["tag"] == tag), lambda n: n["text"])
        shown = F.get(texts("h1"), F.lit(0))
        title = F.when(yes(post, "closed") & (shown == F.concat(F.lit(names.closed_badge), masked)), masked).otherwise(shown)
        outcome = (
            F.when(post.isNull() | ~F.coalesce(field(link, names.public_id) == post_id, F.lit(False)), "identity_mismatch").when(~F.coalesce(field(post, "__typename") == names.kind, F.lit(False)), "no_posting")
            .when(yes(post, "hidden") | yes(post, "deleted"), "hidden_or_deleted").when(yes(user, names.refused), "collection_disallowed")
            .when(~F.coalesce(field(user, names.refused) == "false", F.lit(False)), "collection_permission_unknown")
            .when((F.size(texts("h1")) != 1) | ~F.array_contains(texts("p"), body) | (body == "") | (title == "") | (title != masked), "page_changed").otherwise("ok")
        )
        closed = field(post, "closed")
        status = F.when(closed == "true", "closed").when(closed == "false", "open")
        return F.struct(outcome.alias("outcome"), title.alias("title"), body.alias("body"), status.alias("source_status"), parse_iso(field(post, "publishedAt")).alias("published"))

    return let(F.from_json(store, "map<string,string>"), read)


def feed_choice(match: Column, closed: Column, pay_unit: Column) -> Column:
    """``core``, ``explore`` or ``listed`` for a feed's card: closed ones are only listed, and pay by month or year moves each one step down."""
    steady = F.coalesce(pay_unit.isin("MONTHLY", "YEARLY"), F.lit(False))
    core, explore = match["core"] & ~steady, (match["explore"] & ~steady) | (match["core"] & steady)
    return F.when(F.coalesce(closed, F.lit(False)), "listed").when(core, "core").when(explore, "explore").otherwise("listed")
