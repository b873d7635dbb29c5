"""Main text of pages by template deduction over equivalence classes.

Pages of a host share a template.  A page is a sequence of tokens: tags (with
class or id) and strings between tags (long ones by a hash).  Tokens with the same occurrence
vector over the pages of a host form an equivalence class; vectors are compared
by a sum of hashes of (page, count), so a class is an aggregate and no host is
gathered.  Classes of tokens that occur equally often on each page that has them, on
most pages, make the host's template, ordered by mean position; on a page, a class
is valid if its tokens appear in that order, round by round, and each round nests
inside one slot of the classes before it.

The slots between template tokens are what the template leaves open, and text in them
is the page's own; text of the template is on most pages of the host, three or more,
and not only on copies of one.  The article is an ``article`` or ``main`` element with
text of its own (one that is all template, such as a teaser, is left out where another
has some); without such an element it is the smallest element that holds nearly all of
the page's own text, or, where only the whole page does, what lies between the first and
the last slot that isn't empty.  Inside the article nothing is dropped because it repeats on
other pages, headings for one; left out are elements that are boilerplate by their
kind, role or whole class or id name (menus, adverts, forms, comments, scripts and the
like), the rest becomes blocks; open elements and blocks are told from all tags.  A page
that fits no template, or that is all template, is read by the same rules with all its text.

Null and empty pages give an empty text; a null url is a host of its own; tags
that are never closed end with what encloses them; a null id stays null, repeated
rows are read each.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, table
from coppice.session import save, ship, spread

LEAST_SHARE = 0.5  # of the host's pages that a template token is on
LEAST_PAGES = 3  # that a template's text is on
LONG_TEXT = 40  # characters beyond which a hash stands for a text; it decides nothing
HOT_SHARE = 64  # a host with more than this part of all pages is dealt out; so at most as many hosts are

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    # quotes only quote where a value begins, and only if they are closed
    r"|</?[a-zA-Z][^\s/>]*+(?:\s++|/|[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+)?+|[\"'=])*+>"
    r"|</?[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content)(?:$|[\s_-])")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    *("address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset"),
    *("figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre"),
    *("section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"),
}
MAIN = {"article", "main"}
HOLDERS = {*MAIN, "section", "div"}
ASIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "object", "canvas", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
MAIN_SHARE = 0.8  # of a page's own text that its article holds at least
#: Names of boilerplate: a class or id is one if each of its words is here or below, and one here.
ASIDE_NAMES = set(
    "nav navbar navigation menu side sidebar footer masthead ad ads advert adverts advertisement advertising adbox adsense promo promos promotion "
    "sponsor sponsors sponsored cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share shares sharing social related recommended recommendations comment comments commentlist disqus reply replies breadcrumb breadcrumbs "
    "pagination pager toolbar widget widgets banner alert alerts".split()
)
HOLDER_NAMES = set(
    "area bar block body bottom box button buttons container content div group header holder icon icons inner item items left link links list "
    "main message outer page panel post posts right section site text thread title tools top wrap wrapper".split()
)


def attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag)}


def parse(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, raw) of each token in order: kind is open, close or text; comments and raw elements are gone."""
    out, at = [], 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            out.append(("text", "", page[at:]))
            break
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at, raw = m.end(), m[0]
        named = NAME.match(raw)
        if named is None:
            continue
        name = named[1].lower()
        if raw[1] == "/":
            out.append(("close", name, raw))
            continue
        if name in RAW and not raw.endswith("/>"):
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        out.append(("open", name, raw))
    return out


def signature(kind: str, name: str, raw: str) -> str | None:
    """What identifies a token across pages; None for what no template could hold."""
    if kind == "text":
        text = " ".join(raw.split())
        if len(text) > LONG_TEXT:
            return f'"#{blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()}'
        return f'"{text}' if text else None
    if kind == "close":
        return f"/{name}"
    if " " not in raw:
        return name
    own = attributes(raw)
    mark = re.sub(r"\d+", "0", f"{own.get('class', '')}#{own.get('id', '')}")
    return f"{name}.{mark}" if mark != "#" else name


def aside(name: str, raw: str) -> bool:
    """Whether an element is boilerplate by its name, role, class or id."""
    if name in ASIDE:
        return True
    if "=" not in raw and "hidden" not in raw:
        return False
    own = attributes(raw)
    if own.get("role", "").lower() in ROLES or own.get("aria-hidden") == "true":
        return True
    if re.search(r"\shidden(?=[\s/>=])", raw) or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    if name in MAIN or name in ("body", "html"):
        return False
    return any(boilerplate_name(x) for k in ("class", "id") for x in own.get(k, "").lower().split())


def boilerplate_name(name: str) -> bool:
    """Whether a class or id names boilerplate as a whole: ``share-buttons`` does, ``share-price`` and ``side-by-side`` don't."""
    words = [w for w in re.split(r"[_\d-]+", name) if w]
    return any(w in ASIDE_NAMES for w in words) and all(w in ASIDE_NAMES or w in HOLDER_NAMES for w in words)


def articled(raw: str) -> bool:
    """Whether a tag's class or id says that it holds an article."""
    own = attributes(raw) if "=" in raw else {}
    return any(ARTICLE_WORDS.search(own.get(k, "").lower()) for k in ("class", "id"))


def page_tokens(df: DataFrame, html: str) -> DataFrame:
    """Rows (_host, token, page, n, at): how often a token is on a page and where it is first."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for host, key, page in zip(hosts, pages, batch.column(2).to_pylist(), strict=True):
            seen: Counter = Counter()
            first = {}
            for i, token in enumerate(parse(page or "")):
                if (s := signature(*token)) is not None:
                    seen[s] += 1
                    first.setdefault(s, i)
            rows += [(host, s, key, n, first[s]) for s, n in seen.items()]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        arrays = [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["_host", "token", "page", "n", "at"])

    keyed = df.select("_host", F.xxhash64(html).alias("page"), html)
    return arrow_map(keyed, count, "_host string, token string, page long, n long, at long")


def templates(df: DataFrame, html: str) -> DataFrame:
    """Rows (_host, classes): each class its tokens in order; classes by support, then size."""
    vector = F.sum(F.xxhash64("page", "n").bitwiseAND(F.lit((1 << 40) - 1)).cast("decimal(24,0)"))
    sizes = df.groupBy("_host").agg(F.count("*").alias("pages"))
    tag = ~F.startswith("token", F.lit('"'))
    tokens = (
        page_tokens(df, html)
        .groupBy("_host", "token")
        .agg(
            F.count("*").alias("support"),
            F.min("n").alias("least"),
            F.max("n").alias("most"),
            vector.alias("vector"),
            F.avg("at").alias("at"),
            (F.min("page") != F.max("page")).alias("repeated"),  # not only on copies of one page
        )
        .where("least = most")
        .where(tag | (F.col("repeated") & (F.col("support") >= LEAST_PAGES)))
        .join(sizes, "_host")
        .where(F.col("support") >= F.col("pages") * LEAST_SHARE)
        .where(tag | (F.col("support") > F.col("pages") * LEAST_SHARE))
    )
    return (
        tokens.groupBy("_host", "vector", "support")
        .agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("members"))
        .groupBy("_host")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("s"), (-F.size("members")).alias("n"), "vector", "members"))).alias("c"))
        .select("_host", F.expr("transform(c, x -> transform(x.members, m -> m.token))").alias("classes"))
    )


def skeleton(tokens: list[tuple[str, str, str]], classes: list[list[str]]) -> list[int]:
    """Places of the template's tokens on this page, from the classes that are valid on it."""
    places: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        s = signature(*token)
        if s is not None:
            places.setdefault(s, []).append(i)
    taken: list[int] = []
    for members in classes:
        here = [places.get(t, []) for t in members]
        if len({len(x) for x in here}) > 1 or not here[0]:
            continue
        rounds = list(zip(*here, strict=True))
        order = [i for r in rounds for i in r]
        if any(a >= b for a, b in zip(order, order[1:], strict=False)):
            continue
        if any(bisect(taken, r[0]) != bisect(taken, r[-1]) for r in rounds):
            continue  # it doesn't nest inside one slot
        taken = sorted([*taken, *order])
    return taken


def main_text(page: str | None, classes: list[list[str]] | None) -> str:
    tokens = parse(page or "")
    fixed = {i for i in skeleton(tokens, classes or []) if tokens[i][0] == "text"}
    own = [i for i, (kind, _, raw) in enumerate(tokens) if kind == "text" and i not in fixed and not raw.isspace()]
    inside = main_elements(tokens)
    if not inside:
        return "\n\n".join(blocks(tokens, *slot_region(tokens, own, bool(fixed))))
    filled = [(a, b) for a, b in inside if bisect(own, b) > bisect(own, a)]
    return "\n\n".join(blocks(tokens, filled or inside, False))


def main_elements(tokens: list[tuple[str, str, str]]) -> list[tuple[int, int]]:
    """Ranges of tokens of the page's outermost main elements."""
    out, depth, start = [], 0, 0
    for i, (kind, name, _) in enumerate(tokens):
        if name in MAIN:
            if kind == "open":
                start = i if depth == 0 else start
                depth += 1
            elif depth:
                depth -= 1
                if depth == 0:
                    out.append((start, i))
    return [*out, (start, len(tokens))] if depth else out


def slot_region(tokens: list[tuple[str, str, str]], own: list[int], template: bool) -> tuple[list[tuple[int, int]], bool]:
    """The range of tokens with nearly all of the page's own text, and whether it is one element; all of the page without a template."""
    open_: list[tuple[str, int]] = []
    around: dict[int, list[tuple[int, str]]] = {}
    ends: dict[int, int] = {}
    mine = set(own)
    for i, (kind, name, raw) in enumerate(tokens):
        if kind == "open" and (name in HOLDERS or name in ASIDE) and not raw.endswith("/>"):
            open_.append((name, i))
        elif kind == "close" and any(name == n for n, _ in open_):
            while True:
                n, at = open_.pop()
                ends[at] = i
                if n == name:
                    break
        elif i in mine:
            around[i] = [(at, n) for n, at in open_]
    weight: Counter = Counter()
    outside = [i for i in own if not any(aside(tokens[at][1], tokens[at][2]) for at, _ in around[i])]
    for i in outside:
        for at, _ in around[i]:  # none of them is boilerplate
            weight[at] += len(tokens[i][2])
    total = sum(len(tokens[i][2]) for i in outside)
    if not template or not total:
        return [(0, len(tokens))], True
    holding = [at for at, w in weight.items() if w >= MAIN_SHARE * total]
    if holding:
        return [(max(holding), ends.get(max(holding), len(tokens)))], False
    return [(outside[0], outside[-1] + 1)], True


def blocks(tokens: list[tuple[str, str, str]], inside: list[tuple[int, int]], of_page: bool) -> list[str]:
    """Blocks of the tokens inside the ranges, nested boilerplate left out; in a range of the page, not of an article, headers too."""
    out: list[str] = []
    now: list[str] = []
    skipped, depth = None, 0
    around: list[tuple[str, bool]] = []  # open elements that may hold an article, and whether one does

    def flush() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    for start, end in inside:
        for kind, name, raw in tokens[start:end]:
            if skipped is not None:
                if name == skipped:
                    depth += (kind == "open") - (kind == "close")
                    skipped = skipped if depth else None
                elif kind == "close" and name in MAIN:
                    skipped = None
                continue
            if kind == "text":
                now.append(raw)
                continue
            if name in HOLDERS:
                if kind == "open":
                    holds = bool(around) and around[-1][1]
                    around.append((name, holds or name in MAIN or articled(raw)))
                elif any(name == n for n, _ in around):
                    while around.pop()[0] != name:
                        pass
            site_head = of_page and name == "header" and not (around and around[-1][1])
            if kind == "open" and name not in VOID and (site_head or aside(name, raw)):
                if name in BLOCKS or name in ASIDE:
                    flush()
                skipped, depth = name, 1
            elif name == "br":
                now.append(" ")
            elif name in BLOCKS:
                flush()
    flush()
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_text(df: DataFrame, html: str = "html", url: str = "url", id_col: str = "page_id") -> DataFrame:
    """Columns id, url, text, n_chars; one row a row of ``df``."""
    ship(df.sparkSession)
    named = {"_id": F.col(id_col), "_url": F.col(url), "_html": F.col(html), "_host": host_of(F.col(url))}
    pages = df.select(*[c.alias(k) for k, c in named.items()])
    # written first, so the planner knows their size: below its threshold they are broadcast and pages stay put
    known = save(templates(pages, "_html"), "page-templates")
    sizes = save(pages.groupBy("_host").count(), "page-hosts")
    total = sizes.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in sizes.where(F.col("count") * HOT_SHARE > total).collect()]  # fewer than HOT_SHARE
    is_hot = F.col("_host").isin(hot) if hot else F.lit(False)
    # the pages of a hot host are dealt into parts, each with the template
    part = F.when(is_hot, F.pmod(F.xxhash64("_html", "_url"), F.lit(HOT_SHARE))).otherwise(0).cast("int")
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SHARE - 1))).otherwise(F.array(F.lit(0)))
    known = known.withColumn("_part", F.explode(every))
    ready = pages.withColumn("_part", part).join(known, ["_host", "_part"], "left").select("_id", "_url", "_html", "classes")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h, c) for h, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, [id_col, url, "text", "n_chars"])

    kinds = dict(df.dtypes)
    return arrow_map(ready, read, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string, n_chars long")


def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spread(table(spark, sf_dir, "pages")))
