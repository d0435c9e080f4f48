"""Addresses, crawl policies and small classifications, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def policy_rules(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, grp, agent, allow, pattern`` of crawl-policy files: consecutive agent lines share the rules below them.

    An empty disallow rules nothing; rules before any agent count for none.  An
    agent without rules has one row with a null pattern.
    """
    lines = files.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("n", "line"))
    bare = F.btrim(F.substring_index("line", "#", 1))
    pairs = lines.select(key, "n", F.lower(F.btrim(F.substring_index(bare, ":", 1))).alias("k"), F.btrim(F.substring(bare, F.instr(bare, ":") + 1, F.lit(100_000))).alias("v"), F.contains(bare, F.lit(":")).alias("pair")).where("pair")
    w = Window.partitionBy(key).orderBy("n")
    agent = F.col("k") == "user-agent"
    starts = (agent & ~F.coalesce(F.lag(agent).over(w), F.lit(False))).cast("int")
    grouped = pairs.withColumn("grp", F.sum(starts).over(w)).where("grp > 0")
    agents = grouped.where(agent).select(key, "grp", F.lower("v").alias("agent"))
    rules = grouped.where(F.col("k").isin("allow", "disallow") & ~((F.col("k") == "disallow") & (F.col("v") == ""))).select(key, "grp", (F.col("k") == "allow").alias("allow"), F.col("v").alias("pattern"))
    return agents.join(rules, [key, "grp"], "left")


def rules_for(rules: DataFrame, key: str, agent: str) -> DataFrame:
    """The rules that bind ``agent``: of the groups that name it, else of those for all."""
    token = agent.lower().split("/", 1)[0]
    named = (F.col("agent") != "*") & (F.col("agent") != "") & F.contains(F.lit(token), F.col("agent"))
    marked = rules.withColumns({"named": named, "any_named": F.max(named).over(Window.partitionBy(key))})
    return marked.where(F.when(F.col("any_named"), F.col("named")).otherwise(F.col("agent") == "*") & F.col("pattern").isNotNull()).select(key, "allow", "pattern")


def crawl_allowed(urls: DataFrame, rules: DataFrame, key: str, url: str, agent: str) -> DataFrame:
    """``urls`` with ``allowed``: the longest rule that fits decides, an allowance on a tie, and nothing means yes."""
    query = F.try_parse_url(F.col(url), F.lit("QUERY"))
    path = F.concat(F.coalesce(F.nullif(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")), F.lit("/")), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))
    escaped = F.regexp_replace("pattern", r"([.+?^(){}\[\]|\\])", r"\\$1")
    ends = F.col("pattern").endswith("$")
    fits = F.concat(F.lit("^"), F.replace(F.regexp_replace(F.rtrim(escaped, F.lit("$")), r"\$", r"\\$"), F.lit("*"), F.lit(".*")), F.when(ends, F.lit("$")).otherwise(""))
    bound = rules_for(rules, key, agent).withColumn("_fits", fits)
    distinct = urls.select(key, url).distinct()
    hits = distinct.withColumn("_path", path).join(bound, key).where(F.rlike(F.col("_path"), F.col("_fits")))
    best = hits.groupBy(key, url).agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allowed"))
    return urls.join(best, [key, url], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def safe_home(url: Column, host: str) -> Column:
    """The address if it is the https front page of a community on exactly this host, else null."""
    return F.when(url.rlike(rf"^https://{host.replace('.', '[.]')}/[a-zA-Z0-9][a-zA-Z0-9_-]{{0,99}}/?$"), F.rtrim(url, F.lit("/")))


def community_url(url: Column, host: str, board: bool = False) -> Column:
    """Canonical address of a community's front page, or of one of its boards; null for any other."""
    tail = r"/boards/[0-9a-zA-Z_-]+" if board else ""
    found = F.regexp_extract(url, rf"^https://{host.replace('.', '[.]')}(/[a-zA-Z0-9][a-zA-Z0-9_-]{{0,99}}{tail})/?(?:[?#].*)?$", 1)
    return F.when(found != "", F.concat(F.lit(f"https://{host}"), found))


def expanded_keywords(keywords: Column, aliases: list[set[str]]) -> Column:
    """Keywords without blanks in lower case, with all names of every alias group that one of them belongs to, sorted."""
    plain = F.array_distinct(F.transform(F.filter(keywords, lambda k: F.btrim(k) != ""), lambda k: F.lower(F.regexp_replace(k, r"(?U)\s+", ""))))
    more = [F.when(F.arrays_overlap(plain, F.array(*map(F.lit, sorted(g)))), F.array(*map(F.lit, sorted(g)))).otherwise(F.array().cast("array<string>")) for g in aliases]
    return F.array_sort(F.array_distinct(F.concat(plain, *more)))


def title_match(title: Column, keywords: Column, specific: Column, core_pattern: str, weak_pattern: str, physical_pattern: str, technical_pattern: str) -> Column:
    """``core, explore, physical`` of a listing title: a keyword is needed; clear handwork is no weak candidate unless it names a technical object."""
    plain = F.lower(F.regexp_replace(title, r"(?U)\s+", ""))
    holds = lambda words: F.exists(words, lambda w: F.contains(plain, w))
    asked = holds(keywords)
    core = title.rlike(core_pattern) & asked
    weak = ~core & asked & (holds(specific) | title.rlike(weak_pattern))
    physical = weak & title.rlike(physical_pattern) & ~title.rlike(technical_pattern)
    return F.struct(core.alias("core"), (weak & ~physical).alias("explore"), physical.alias("physical"))


def comment_class(body: Column) -> Column:
    """request, question or other."""
    compact = F.lower(F.regexp_replace(body, r"(?U)\s+", ""))
    return (
        F.when(compact.rlike("견적|작업문의|제작문의|개발문의|가능할까요|연락주세요|채팅드렸|부탁드|제작가능"), "request")
        .when(F.contains(body, F.lit("?")) | compact.rlike("궁금|질문|어떻게|무엇|언제|어디|어떤"), "question").otherwise("other")
    )


def own_post(title: Column, body: Column, template_title: str, host: str) -> Column:
    """Whether a post is one's own: the template's title, or a link to exactly the portfolio's host or one under it."""
    name = host.replace(".", "[.]")
    linked = body.rlike(rf"(?i)https?://(?:[^\s/<>\"'@]*@)?(?:[\w-]+[.])*{name}(?![\w.-])") | body.rlike(rf"(?i)(?<![\w.-])(?:www[.])?{name}(?![\w.-])")
    return F.coalesce((F.btrim(title) == template_title.strip()) | linked, F.lit(False))


def task_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def guard_hash(cache_key: Column, config: Column, revision: Column, generation: Column) -> Column:
    """sha256 over what a deferred call was prepared under; another value means that its result is stale."""
    return F.sha2(F.to_json(F.struct(cache_key.alias("cache_key"), config.alias("config"), generation.alias("generation"), revision.alias("revision"))), 256)


def alert_text(title: Column, name: Column, lo: Column, hi: Column, url: Column) -> Column:
    """Lines of an alert: what, which, pay range, where; missing ones are left out."""
    pay = F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(F.format_number(lo, 0), F.lit("~"), F.format_number(hi, 0), F.lit("원"))).when(F.coalesce(lo, hi).isNotNull(), F.concat(F.format_number(F.coalesce(lo, hi), 0), F.lit("원")))
    return F.concat_ws("\n", title, name, pay, url)


def sanitised(texts: Column, most: int, chars: int) -> Column:
    """At most ``most`` distinct non-empty texts of at most ``chars`` characters, in order: a limit of the feature."""
    return F.slice(F.array_distinct(F.filter(F.transform(texts, lambda t: F.substring(F.btrim(t), 1, chars)), lambda t: t != "")), 1, most)


def grounded_numbers(text: Column, *sources: Column) -> Column:
    """Whether every number of the text stands in one of the sources."""
    numbers = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"\d[\d,.]*"), F.lit(0)), lambda n: F.regexp_replace(n, "[,.]", ""))
    known = F.concat(*[numbers(s) for s in sources])
    return F.forall(numbers(text), lambda n: F.array_contains(known, n))
