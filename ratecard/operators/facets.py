"""Typed constraints and facets as Columns; all facet counts in one aggregate."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import number_in

_NUMBER = r"(-?[\d.,]+)"


def constraints_match(constraints: dict[str, object], columns: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(ok, matched, total). Unknown attributes are tolerated, but a brand must be
    there; text compares without case; names that begin with _ are notes."""
    wanted = {k: v for k, v in constraints.items() if not k.startswith("_")}
    matched, contradicted = F.lit(0), F.lit(0)
    for name, value in wanted.items():
        own = columns.get(name, F.lit(None).cast("string"))
        if name == "brand":
            low, text = F.lower(F.trim(own.cast("string"))), str(value).strip().lower()
            hit = (low == text) | low.startswith(text + " ")
            hit, against = F.coalesce(hit, F.lit(False)), ~F.coalesce(hit, F.lit(False))
        elif isinstance(value, (int, float)):
            hit = F.coalesce(own.cast("double") == float(value), F.lit(False))
            against = own.isNotNull() & ~hit
        else:
            hit = F.coalesce(F.lower(F.trim(own.cast("string"))) == str(value).strip().lower(), F.lit(False))
            against = own.isNotNull() & ~hit
        matched, contradicted = matched + hit.cast("int"), contradicted + against.cast("int")
    ok = F.lit(True) if not wanted else (matched > 0) & (contradicted == 0)
    return ok, matched, F.lit(len(wanted))


def facet_value(raw: Column) -> Column:
    """STRUCT<text, number, triple>: what labels are compared with, read from a value once."""
    text = raw.cast("string")
    return F.struct(text.alias("text"), number_in(text).alias("number"), text.rlike(r"\d\s*[×x]\s*\d").alias("triple"))


def value_matches(raw: Column, label: str) -> Column:
    """Whether a value falls under a facet label, which is written for readers:
    dimension triples, intervals, Under and Over, a leading number, or text."""
    return matches(facet_value(raw), label)


def matches(value: Column, label: str) -> Column:
    """``value_matches`` of a value that ``facet_value`` has read."""
    text, number = value.text, value.number
    clean = lambda s: float(s.replace(",", "").rstrip("."))
    norm = lambda c: F.lower(F.regexp_replace(c, r"(?i)[\s×]*x[\s×]*|\s*×\s*|\s+", "×"))
    same = F.lower(text) == label.lower()
    numeric = None
    if m := re.search(rf"{_NUMBER}\s*[–-]\s*{_NUMBER}", label):
        numeric = number.between(clean(m[1]), clean(m[2]))
    elif m := re.match(r"Under\s+₹?([\d.,]+)", label, re.I):
        numeric = number < clean(m[1])
    elif m := re.match(r"Over\s+₹?([\d.,]+)", label, re.I):
        numeric = number > clean(m[1])
    elif m := re.search(r"-?\d+(?:\.\d+)?", label.replace(",", "")):
        numeric = F.abs(number - float(m[0])) < 1e-9
    plain = same if numeric is None else F.when(number.isNotNull(), numeric).otherwise(same)
    return F.coalesce(F.when(value.triple, norm(text) == norm(F.lit(label))).otherwise(plain), F.lit(False))


def _read(rows: DataFrame, facets: dict[str, tuple[Column, list[str]]], *keep: str) -> DataFrame:
    """``keep`` and one column of ``facet_value`` for each facet."""
    return rows.select(*keep, *(facet_value(column).alias(f"_facet{i}") for i, (column, _) in enumerate(facets.values())))


def failing_mask(facets: dict[str, tuple[Column, list[str]]], selected: dict[str, list[str]], value=lambda i, column: facet_value(column)) -> Column:
    """Bit i is set if the row fails the selection in the i-th facet (values of a facet are alternatives)."""
    mask = F.lit(0).cast("bigint")
    for i, (name, (column, _)) in enumerate(facets.items()):
        if chosen := selected.get(name):
            hit = reduce(lambda a, b: a | b, (matches(value(i, column), v) for v in chosen))
            mask = mask + F.when(hit, F.lit(0)).otherwise(F.lit(1 << i)).cast("bigint")
    return mask


def select_facets(rows: DataFrame, facets: dict[str, tuple[Column, list[str]]], selected: dict[str, list[str]]) -> DataFrame:
    return rows.where(failing_mask(facets, selected) == 0)


def facet_counts(rows: DataFrame, facets: dict[str, tuple[Column, list[str]]], selected: dict[str, list[str]], item: str = "product_id") -> DataFrame:
    """(facet, value, n): distinct items of every value, each facet counted against
    the selections in all *other* facets.

    A row that fails nothing counts in every facet, one that fails only facet f
    counts in f. Rows are first reduced to one bit set for each item, by a map-side
    OR, so neither the number of facets nor of values multiplies rows or scans.
    """
    held = _read(rows, facets, item)
    held = held.withColumn("_mask", failing_mask(facets, selected, lambda i, _: F.col(f"_facet{i}")))
    names, bits = [], []
    for i, (name, (_, values)) in enumerate(facets.items()):
        for value in values:
            names.append((name, value))
            bits.append(F.bool_or(F.col("_mask").isin(0, 1 << i) & matches(F.col(f"_facet{i}"), value)))
    reduced = held.groupBy(item).agg(*(b.alias(f"v{i}") for i, b in enumerate(bits)))
    counted = reduced.agg(*(F.count_if(F.col(f"v{i}")).alias(f"v{i}") for i in range(len(bits))))
    out = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value"), F.col(f"v{i}").alias("n")) for i, (f, v) in enumerate(names))))
    return counted.select(out.alias("x")).select("x.*")


def zero_result_rung(rows: DataFrame, constraints: dict[str, object], columns: dict[str, Column], order: list[str]) -> DataFrame:
    """(rung, n) of the first relaxation that keeps something: constraints are
    dropped in ``order``; all rungs are tested in one pass. Rung 0 drops none."""
    ladder, left = [dict(constraints)], dict(constraints)
    for name in order:
        if name in left:
            left = {k: v for k, v in left.items() if k != name}
            ladder.append(dict(left))
    counts = rows.agg(*(F.count_if(constraints_match(c, columns)[0]).alias(f"r{i}") for i, c in enumerate(ladder)))
    rungs = F.array(*(F.struct(F.lit(i).alias("rung"), F.col(f"r{i}").alias("n")) for i in range(len(ladder))))
    return counts.select(F.get(F.filter(rungs, lambda r: r.n > 0), F.lit(0)).alias("x")).select("x.*")


def dominant_category(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """The category of at least ``share`` of the rows; no row if there is none."""
    counts = rows.groupBy("category").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("category", "n")
