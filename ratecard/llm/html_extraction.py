"""HTML extraction by equivalence classes of tokens across pages of a host.

1. Every page becomes a list of tokens (``html_blocks``): starts and ends of
   elements, and blocks of text, each with a role. Roles that occur equally often
   in every page of a host have one occurrence vector; two 32-bit sums of hashes
   of (page, times) stand for a vector, with its number of pages and its total,
   so that vectors are summed before the shuffle and never gathered.
2. Roles of one vector are an equivalence class. Kept are classes of at least two
   roles and of at least ``LEAST_PAGES`` pages and ``SHARE`` percent of a host's:
   a host's classes have at most 100 / ``SHARE`` times the roles of an average page.
3. A class is valid if its roles come in one order, over and over, in all its
   pages, and nests: no other class's tokens cross it, and all its occurrences
   lie in one and the same gap of the class around it. The valid classes, one
   inside the gaps of another, are the host's template; what is left are slots.
4. A text is the template's own if it belongs to a class together with the
   element around it (``NOISE_PAGES`` pages at least); a text that merely
   repeats is none. On hosts where such texts are most of the pages' main text,
   pages are copies of each other and nothing is taken for template.
5. Main text is what an article or main element holds. For pages without one, it
   is the deepest template element whose slots hold ``MAIN`` percent of the text
   outside links of such pages of the host; without a template, all slots.
   Elements that are named menus, adverts and so on are no slots (``html_blocks``).

Tokens and classes are compact and written once; the html itself is read twice
and never grouped. Templates are one bounded row a host and joined to pages by
host, so Spark may split a hot host's pages over tasks.

Defined cases: null and empty html and pages without text give an empty text;
pages whose url names no host have no template; repeated rows are pages each
and come out alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import forget, saved, table
from .html_blocks import CLOSE, OPEN, TEXT, Page, hashed, main_blocks

LEAST_PAGES, SHARE = 3, 10
NOISE_PAGES = 8
MAIN = 70
TOKENS = "host string, page bigint, own array<bigint>, times array<int>, kinds array<int>, roles array<bigint>, ups array<bigint>, chars array<int>, linked array<int>, level int, levels array<int>"
FACTS = "host string, kind string, key bigint, low bigint, high bigint, bad int, amount bigint"
JOIN = "\n\n"


def host_column(url):
    """The host that a url names, without its port; null if none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def page_tokens(pages: DataFrame) -> DataFrame:
    """``TOKENS`` of each of ``pages`` (host, html)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for host, page, html in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    p = Page(html)
                    counts: dict[int, int] = defaultdict(int)
                    for role in p.roles:
                        counts[role] += 1
                    rows.append((host, page, list(counts), list(counts.values()), p.kinds, p.roles, p.ups, [len(t) for t in p.texts], p.linked, max(p.levels, default=0), p.levels))
                names = [c.split()[0] for c in TOKENS.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(TOKENS))

    return pages.select("host", F.xxhash64("url", "html").alias("page"), "html").mapInArrow(read, TOKENS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def equivalence_classes(tokens: DataFrame) -> DataFrame:
    """host, class (its smallest role), pages, members (role, up: of a text, its element's role)."""
    hosts = tokens.groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= LEAST_PAGES)
    # a text's element is the one role it was read with: its place in the page gives it
    ups = F.transform("own", lambda r: F.element_at("ups", F.array_position("roles", r).cast("int")))
    is_text = F.transform("own", lambda r: F.element_at("kinds", F.array_position("roles", r).cast("int")) == TEXT)
    each = tokens.select("host", "page", F.explode(F.arrays_zip(F.col("own").alias("role"), F.col("times").alias("times"), ups.alias("up"), is_text.alias("is_text"))).alias("t")).select("host", "page", "t.*")
    h = F.xxhash64("page", "times")
    vectors = each.groupBy("host", "role").agg(
        F.count("*").alias("pages"),
        F.sum("times").alias("total"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("v1"),
        F.sum(F.shiftrightunsigned(h, 32)).alias("v2"),
        F.max(F.when(F.col("is_text"), F.col("up"))).alias("up"),
    )
    frequent = vectors.where(F.col("pages") >= LEAST_PAGES).join(hosts, "host").where(100 * F.col("pages") >= SHARE * F.col("host_pages"))
    classes = frequent.groupBy("host", "v1", "v2", "pages", "total").agg(F.min("role").alias("class"), F.collect_list(F.struct("role", "up")).alias("members"))
    return classes.where(F.size("members") >= 2).select("host", "class", "pages", "members")


def class_orders(roles: list[int], class_of: dict[int, tuple[int, int]]) -> dict[int, int | None]:
    """Of each class on a page, a hash of the order of its roles; None if that changes."""
    met: dict[int, list[int]] = defaultdict(list)
    for role in roles:
        if role in class_of:
            met[class_of[role][0]].append(role)
    out: dict[int, int | None] = {}
    for c, row in met.items():
        size = class_of[row[0]][1]
        first = row[:size]
        same = len(set(first)) == size and row == first * (len(row) // size)
        out[c] = hashed(c, repr(first)) if same else None
    return out


def class_places(roles: list[int], class_of: dict[int, tuple[int, int]]) -> dict[int, tuple[set[int], bool]]:
    """Of each class of one order on a page: the gaps of other classes it lies in, and whether it is crossed."""
    places: dict[int, tuple[set[int], bool]] = {}
    at: dict[int, int] = defaultdict(int)
    stack: list[int] = []
    for role in roles:
        if role not in class_of:
            continue
        c, size = class_of[role]
        if not at[c]:
            gaps, crossed = places.get(c, (set(), False))
            gaps.add(hashed(stack[-1], str(at[stack[-1]])) if stack else 0)
            places[c] = gaps, crossed
            stack.append(c)
        while stack[-1] != c:  # what was opened inside and is still open crosses this class
            inner = stack.pop()
            places[inner] = places[inner][0], True
            at[inner] = 0
        at[c] += 1
        if at[c] == size:
            stack.pop()
            at[c] = 0
    for c in stack:
        places[c] = places[c][0], True
    return places


def slot_amounts(page: dict, class_of: dict[int, tuple[int, int]], own: frozenset[int]) -> tuple[dict[int, tuple[int, int]], int, int]:
    """Of a page: of each template element, the text outside links in its slots and its depth; all main text, and the template's own of that."""
    inside: dict[int, tuple[int, int]] = {}
    begun: list[tuple[int, int]] = []
    so_far = main = noise = 0
    for kind, role, chars, linked, level in zip(page["kinds"], page["roles"], page["chars"], page["linked"], page["levels"]):
        if kind == OPEN:
            begun.append((role, so_far))
        elif kind == CLOSE:
            opened, before = begun.pop()
            if opened in class_of:
                inside[opened] = inside.get(opened, (0, 0))[0] + so_far - before, len(begun)
        else:
            if level == page["level"]:
                main += chars
                noise += chars if role in own else 0
            if role not in own:
                so_far += chars - linked
    return inside, main, noise


def _facts(tokens: DataFrame, classes: DataFrame, make) -> DataFrame:
    """What ``make`` finds on each page with its host's classes, by host, kind and key."""
    templates = classes.groupBy("host").agg(F.collect_list(F.struct("class", "members", "pages")).alias("classes"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, known = [], {}
                for page in batch.slice(at, 256).to_pylist():
                    host = page["host"]
                    if host not in known:
                        class_of, own = {}, set()
                        for c in page["classes"]:
                            members = {m["role"] for m in c["members"]}
                            class_of |= dict.fromkeys(members, (c["class"], len(members)))
                            own |= {m["role"] for m in c["members"] if m["up"] in members and c["pages"] >= NOISE_PAGES}
                        known = {host: (class_of, frozenset(own))}  # pages of a host mostly come together
                    rows += [(host, *fact) for fact in make(page, *known[host])]
                names = [c.split()[0] for c in FACTS.split(", ")]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(FACTS))

    facts = tokens.drop("page", "own", "times", "ups").join(templates, "host").mapInArrow(read, FACTS)
    return facts.groupBy("host", "kind", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("bad").alias("bad"), F.sum("amount").alias("amount"))


def ordered_classes(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of one order in all pages."""

    def orders(page: dict, class_of: dict, own: frozenset) -> list[tuple]:
        return [("order", c, x or 0, x or 0, int(x is None), 0) for c, x in class_orders(page["roles"], class_of).items()]

    good = _facts(tokens, classes, orders).where("bad = 0 and low = high").select("host", F.col("key").alias("class"))
    return classes.join(good, ["host", "class"])


def nested_and_amounts(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Facts of kinds nest (a class: one gap, uncrossed), inside (an element: text, depth), main and noise (a host: characters)."""

    def places(page: dict, class_of: dict, own: frozenset) -> list[tuple]:
        rows = [("nest", c, min(gaps), max(gaps), int(crossed), 0) for c, (gaps, crossed) in class_places(page["roles"], class_of).items()]
        inside, main, noise = slot_amounts(page, class_of, own)
        rows += [("main", 0, 0, 0, 0, main), ("noise", 0, 0, 0, 0, noise)]
        if page["level"] == 0:
            rows += [("inside", role, depth, depth, 0, chars) for role, (chars, depth) in inside.items()]
        return rows

    return _facts(tokens, classes, places)


def host_templates(tokens: DataFrame) -> DataFrame:
    """host, noise (roles of the template's own texts), main (the role of the element with the main text, if any)."""
    classes = saved(equivalence_classes(tokens), "classes")
    ordered = saved(ordered_classes(tokens, classes), "ordered")
    facts = saved(nested_and_amounts(tokens, ordered), "facts")
    nested = facts.where("kind = 'nest' and bad = 0 and low = high").select("host", F.col("key").alias("class"))
    valid = ordered.join(nested, ["host", "class"])
    roles = F.transform("members", lambda m: m["role"])
    texts = F.filter("members", lambda m: F.array_contains(roles, m["up"]))
    noise = valid.where(F.col("pages") >= NOISE_PAGES).select("host", F.explode(F.transform(texts, lambda m: m["role"])).alias("role")).groupBy("host").agg(F.collect_list("role").alias("noise"))
    copies = facts.where("kind in ('main', 'noise')").groupBy("host").agg(F.sum(F.when(F.col("kind") == "noise", 2 * F.col("amount")).otherwise(-F.col("amount"))).alias("over")).where("over > 0").select("host")
    inside = facts.where("kind = 'inside'").join(valid.select("host", F.explode(roles).alias("key")), ["host", "key"])
    most = inside.groupBy("host").agg(F.max("amount").alias("most"))
    enough = inside.join(most, "host").where(f"amount > 0 and 100 * amount >= {MAIN} * most")
    main = enough.groupBy("host").agg(F.max_by("key", F.struct("high", "amount", "key")).alias("main"))
    out = saved(noise.join(copies, "host", "left_anti").join(main, "host", "full"), "templates")
    forget(classes, ordered, facts)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_column(F.col("url")).alias("host"))
    tokens = saved(page_tokens(rows.where("host is not null")), "tokens")
    templates = host_templates(tokens)
    forget(tokens)
    text = main_text(F.col("html"), F.coalesce("noise", F.array().cast("array<bigint>")), F.col("main").cast("string"))
    return rows.join(templates, "host", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


@F.pandas_udf(StringType())
def main_text(html: pd.Series, noise: pd.Series, main: pd.Series) -> pd.Series:
    """Blocks of a page's main text, given its host's template (the role as text, since nulls make numbers of a series doubles)."""
    return pd.Series([JOIN.join(main_blocks(h, frozenset(map(int, n)), frozenset() if m is None else frozenset([int(m)]))) for h, n, m in zip(html, noise, main)], dtype=object)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))
