"""S9 link catalogue and O1 variable classifier over a table of HTML pages (page_id, url, html).

Anchors are pulled out with regular expressions (one row per anchor, document position kept), resolved
against the page URL, classified to a variable and the first link per (page, variable) is kept. The
classifier is a literal expression built from the fixed vocabulary, so it runs inside whole-stage codegen;
only the Unicode accent folding of the haystack uses the pandas UDF of ``normalize_text``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from envspark import vocab
import pandas as pd
from pyspark.sql import types as T

from envspark.functions.text import normalize_code_py, normalize_text_series

# No alternative below can be left again once it matched (possessive groups), so a tag of any length is read in one loop
# and without recursion.
TAG = r"""<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ANCHOR_RE = rf"(?is){TAG}(?:.*?</a>)?+"  # a tag that no end tag follows is passed over whole
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"']++)"""
# an href attribute of the opening tag (not data-href): double-quoted, single-quoted or bare
HREF_RE = rf"""(?is)^<a(?:(?!\shref\s*+=\s*+{_VALUE})(?:[^>"'\s]++|\s|"[^"]*+"|'[^']*+'))*+\shref\s*+=\s*+({_VALUE})"""
INNER_RE = rf"(?is)^{TAG}(.*)</a>$"
CODE_IN_PARENS_RE = r"\(([a-z0-9\.\-]+)\)"

# HTML entities decoded in anchor text.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _decoded(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def without_comments(html: Column) -> Column:
    """HTML without its comments; one that is never closed goes to the end. Each part behind a "<!--" is looked at once."""
    parts = F.split(html, "<!--")
    behind = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(
        F.instr(p, "-->") > 0, F.substring(p, F.instr(p, "-->") + 3, F.length(p))).otherwise(F.lit("")))
    return F.concat(F.element_at(parts, 1), F.array_join(behind, ""))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, pos, href, text) for every <a href> outside comments, in document order."""
    html = without_comments(F.col("html"))
    # behind the last end tag no anchor can be complete, so no opening tag there is followed to the end of the page
    closed = F.replace(html, F.lit("</A>"), F.lit("</a>"))
    html = F.substring(html, F.lit(1), F.length(html) - F.length(F.substring_index(closed, "</a>", -1)))
    found = F.regexp_extract_all(html, F.lit(ANCHOR_RE), 0)
    ex = pages.select("page_id", F.col("url").alias("page_url"),
                      F.posexplode(F.filter(found, lambda a: a.rlike("(?i)</a>$") & a.rlike(HREF_RE))).alias("pos", "a"))
    text = _decoded(F.regexp_replace(F.regexp_extract("a", INNER_RE, 1), r"<[^>]*>", " "))
    href = F.regexp_replace(F.regexp_extract("a", HREF_RE, 1), """^["']|["']$""", "")
    return ex.select("page_id", "page_url", "pos", F.trim(_decoded(href)).alias("href"),
                     F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


def _without_dots(url: Column) -> Column:
    """The URL with the "." and ".." segments of its path collapsed; ".." never climbs above the root."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    path = F.regexp_replace(path, r"(^|/)(\.\.?)$", "$1$2/")  # a dot segment at the end leaves its folder

    def step(done: Column, part: Column) -> Column:
        return (F.when(part == ".", done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
                .otherwise(F.array_append(done, part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    dotted = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/\.\.?([/?#]|$)")
    return F.when(dotted, F.concat(head, F.lit("/"), F.array_join(parts, "/"), tail)).otherwise(url)


def resolve_url(base: Column, href: Column) -> Column:
    """RFC 3986-style join of href against the page URL, dot segments collapsed; fragment removed."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    authority = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_query = F.regexp_replace(base, r"[?#].*$", "")
    directory = F.regexp_replace(no_query, r"/[^/]*$", "/")
    directory = F.when(no_query == authority, F.concat(authority, F.lit("/"))).otherwise(directory)
    joined = (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
              .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
              .when(href.startswith("/"), F.concat(authority, href))
              .when(href.startswith("?"), F.concat(no_query, href))
              .when(href.startswith("#") | (href == ""), base)
              .otherwise(F.concat(directory, href)))
    return _without_dots(F.regexp_replace(joined, "#.*$", ""))


@F.pandas_udf(T.StringType())
def _haystack_udf(text: pd.Series, href: pd.Series, url: pd.Series) -> pd.Series:
    parts = [normalize_text_series(c.fillna("")) for c in (text, href, url)]
    return parts[0] + " " + parts[1] + " " + parts[2]


# Marked non-deterministic only so that the optimizer evaluates it once per anchor: a deterministic UDF
# would be copied into every filter pushed below the projection that defines the classification.
_haystack_once = _haystack_udf.asNondeterministic()


def _haystack(text: Column, href: Column, url: Column) -> Column:
    """normalise(text) + ' ' + normalise(href) + ' ' + normalise(url) in one Arrow batch call."""
    return _haystack_once(text, href, url)


def classify(text: Column, href: Column, url: Column, extra_hints: dict[str, tuple[str, ...]] | None = None) -> Column:
    """O1: a code in parentheses of the lower-cased text (via aliases), else the first variable in vocabulary
    order whose hint occurs in normalise(text) + normalise(href) + normalise(url)."""
    # The first parenthesised code that is an alias: codes lose their '-' before the lookup, so removing '-'
    # from the text first and finding the leftmost "(alias)" gives the same code (a code group cannot
    # contain parentheses, so every "(alias)" occurrence is one of the groups, in the same order).
    alias_map = F.create_map(*[F.lit(x) for kv in vocab.VARIABLE_ALIASES.items() for x in kv])
    alternatives = "|".join(re.escape(a) for a in sorted(vocab.VARIABLE_ALIASES, key=len, reverse=True))
    found = F.regexp_extract(F.replace(F.lower(text), F.lit("-"), F.lit("")), rf"\(({alternatives})\)", 1)
    by_alias = F.when(found != "", alias_map[found])
    hay = _haystack(text, href, url)
    hints = {code: tuple(h) for code, h in vocab.VARIABLE_HINTS.items()}
    for code, more in (extra_hints or {}).items():
        hints[code] = hints.get(code, ()) + tuple(more)
    order = list(vocab.VARIABLE_CODES) + [c for c in hints if c not in vocab.VARIABLE_CODES]
    by_hint = None
    for code in order:
        cond = None
        for h in hints.get(code, ()):
            c = hay.contains(h)
            cond = c if cond is None else (cond | c)
        if cond is None:
            continue
        by_hint = F.when(cond, F.lit(code)) if by_hint is None else by_hint.when(cond, F.lit(code))
    return F.coalesce(by_alias, by_hint) if by_hint is not None else by_alias


def select_variables(requested: list[str] | None, max_archives: int | None = None) -> tuple[list[str], int]:
    """Normalise, keep known codes, de-duplicate in order; empty = all; explicit list caps to its length. A cap outside
    1 to MAX_ARCHIVES is an error."""
    if max_archives is not None and not 1 <= max_archives <= vocab.MAX_ARCHIVES:
        raise ValueError(f"max_archives must be between 1 and {vocab.MAX_ARCHIVES}")
    if not requested:
        return list(vocab.VARIABLE_CODES), max_archives or vocab.DEFAULT_ARCHIVES
    out: list[str] = []
    for raw in requested:
        code = normalize_code_py(str(raw))
        if code in vocab.VARIABLE_CODES and code not in out:
            out.append(code)
    if not out:
        raise ValueError("No valid variable codes selected.")
    return out, len(out)


def classified_anchors(pages: DataFrame, extra_hints=None, base_url: str | None = None) -> DataFrame:
    """Anchors with resolved URL and variable. With ``base_url`` the cheap link checks (scheme, prefix,
    javascript / mailto) run first, so the classifier only sees acceptable links."""
    a = anchors(pages).withColumn("url", resolve_url(F.col("page_url"), F.col("href")))
    if base_url is not None:
        a = a.where(~F.col("href").startswith("javascript:") & ~F.col("href").startswith("mailto:")
                    & F.lower(F.col("url")).rlike("^https?://")
                    & F.lower(F.col("url")).startswith(base_url.lower()))
    return a.withColumn("variable_code", classify(F.col("text"), F.col("href"), F.col("url"), extra_hints))


_PICK_SCHEMA = "page_id long, pos int, url string, label string, variable_code string"


def _greedy_walk(cap: int):
    """Per partition (rows clustered by page, in document order): take a link when neither its URL nor its
    variable was taken before on the page, until the cap. State is reset when the page changes, so a page
    split across Arrow batches is still walked as one sequence."""
    cols = ["page_id", "pos", "url", "label", "variable_code"]

    def run(batches):
        page, urls, variables, taken = None, set(), set(), 0
        for pdf in batches:
            keep = []
            for row in zip(*(pdf[c] for c in cols)):
                if row[0] != page:
                    page, urls, variables, taken = row[0], set(), set(), 0
                if taken >= cap or row[2] in urls or row[4] in variables:
                    continue
                urls.add(row[2])
                variables.add(row[4])
                taken += 1
                keep.append(row)
            yield pd.DataFrame(keep, columns=cols)
    return run


def link_catalogue(pages: DataFrame, base_url: str, variables: list[str] | None = None,
                   max_archives: int | None = None, extra_hints=None) -> DataFrame:
    """Per page, links in document order, each taken when its URL and its variable were not taken by an
    earlier link of the page, until the cap (the number of selected variables, or max_archives).

    Acceptable: not javascript:/mailto:, http(s) after resolution, starts with base_url (case-insensitive),
    classified to a selected variable. Repeats of a (page, URL, variable) are dropped with a window top-1
    (partial before the shuffle); the greedy walk that settles the two rules is one sequential pass per
    partition (``mapInPandas``) over candidates clustered by page and sorted by position.
    """
    selected, cap = select_variables(variables, max_archives)
    cand = (classified_anchors(pages, extra_hints, base_url).where(F.col("variable_code").isin(selected))
            .select("page_id", F.col("pos").cast("int").alias("pos"), "url", F.col("text").alias("label"),
                    "variable_code"))
    # A later anchor with the same (page, URL, variable) as an earlier one is never taken: either the earlier
    # one was taken (URL now blocked) or it was skipped because its URL or variable was already taken.
    first_triple = cand.withColumn("_r", F.row_number().over(
        Window.partitionBy("page_id", "url", "variable_code").orderBy("pos"))).where("_r = 1").drop("_r")
    clustered = first_triple.repartition("page_id").sortWithinPartitions("page_id", "pos")
    return clustered.mapInPandas(_greedy_walk(cap), _PICK_SCHEMA)


def found_links(links: DataFrame) -> DataFrame:
    """``links``, or an error if a catalogue found none (a sync without archives is a failed one)."""
    if links.isEmpty():
        raise ValueError("no archive links of the selected variables were found")
    return links
