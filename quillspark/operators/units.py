"""Quantities recorded in different units, brought to one canonical unit each.

A unit expression is parsed by a small grammar into a *factor* (a fraction),
an *offset*, and a *dimension*, the vector of exponents of (US dollar, share,
ratio, other currency).  A value converts to a target unit if the dimensions agree; the
target names its own factor and dimension.  Amounts of another currency have another
dimension than dollars and convert to none of the targets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Dim = tuple[int, int, int, int]
MONEY: Dim = (1, 0, 0, 0)
RATIO: Dim = (0, 0, 1, 0)
FOREIGN: Dim = (0, 0, 0, 1)

# The words of the grammar.
SCALES = {"thousand": 10**3, "thousands": 10**3, "k": 10**3, "000": 10**3, "000s": 10**3, "million": 10**6, "millions": 10**6, "m": 10**6, "mm": 10**6, "mn": 10**6, "mil": 10**6, "mill": 10**6, "mln": 10**6, "billion": 10**9, "billions": 10**9, "b": 10**9, "bn": 10**9, "bln": 10**9, "trillion": 10**12, "trillions": 10**12, "tn": 10**12}
CURRENCY = {"$", "us$", "usd", "dollar", "dollars"}
OTHER_CURRENCIES = {"eur", "euro", "euros", "€", "gbp", "£", "sterling", "cad", "c$", "canadian", "aud", "a$", "australian", "nz$", "nzd", "hk$", "hkd", "s$", "sgd", "nt$", "r$", "brl", "jpy", "yen", "¥", "cny", "rmb", "yuan", "renminbi", "chf", "francs", "inr", "₹", "rupees", "krw", "₩", "won", "mxn", "pesos", "sek", "nok", "dkk", "kronor", "kroner", "ils", "zar"}
TIMES = {"times", "multiple"}
CENTS = {"cent", "cents", "c", "¢"}
SHARES = {"share", "shares", "sh"}
PERCENT = {"%", "percent", "pct", "percentage"}
BASIS = {"bp", "bps", "basispoint", "basispoints"}
FRACTIONS = {"fraction", "fractions"}
WHOLE = {"whole", "actual", "rounded"}
COUNTS = {"hundred": 100, "thousand": 1000, "one": 1, "a": 1, "each": 1, "every": 1}
#: A header clause "<noun> in <scale>" speaks of money only for these nouns (or without a noun).
MONEY_NOUNS = {"dollars", "dollar", "amounts", "amount", "figures", "values", "usd", "$", "us$", "all", "shown", "stated", "money"}


@dataclass(frozen=True)
class Unit:
    """factor * x + offset gives the amount in base units (dollars, shares, ratio) of ``dim``."""

    factor: Fraction
    dim: Dim
    offset: Fraction = Fraction(0)


#: Canonical target per kind of quantity: (factor of one target unit, dimension, what a bare scale means).
TARGETS = {
    "usd": Unit(Fraction(1), MONEY),
    "usd_per_share": Unit(Fraction(1, 10_000), (1, -1, 0, 0)),
    "ratio": Unit(Fraction(1, 10_000), RATIO),
}

_TOKEN = re.compile(r"us\$|(?<![a-z])(?:hk|nt|nz|[acrs])\$|[$%¢€£¥₹₩/()\[\],;:|]|\n|--|#|[a-z]+|\d[\d,]*(?:\.\d+)?|'")


def _tokens(text: str) -> list[str]:
    text = text.lower().replace("u.s.", "us").replace("us dollars", "dollars").replace("us $", "us$").replace("us cents", "cents").replace("per cent ", "percent ").replace("_", " ")
    text = re.sub(r"\bper cent$", "percent", text)
    text = re.sub(r"(?<![\w.])'?000'?s?\b(?!,)", " 000 ", text)
    text = re.sub(r"\$000s?\b", "$ 000 ", text)
    text = re.sub(r"\bbasis points?\b", "basispoints", text)
    return _TOKEN.findall(text)


def _denominator(toks: list[str], i: int) -> tuple[Fraction, int] | None:
    """'per 100 shares', '/share', 'a share', 'for every one hundred shares' from i: (count, next)."""
    if i < len(toks) and toks[i] == "for":
        i += 1
    elif i < len(toks) and toks[i] not in {"per", "/", "a", "each", "every"}:
        return None
    count, j = Fraction(1), i
    while j < len(toks) and j < i + 4:
        t = toks[j]
        if t in SHARES:
            return count, j + 1
        if t in COUNTS:
            count *= COUNTS[t]
        elif t[0].isdigit():
            count *= Fraction(t.replace(",", ""))
        elif t not in {"per", "/"}:
            return None
        j += 1
    return None


def _per_share(toks: list[str]) -> Fraction | None:
    for i in range(len(toks)):
        if (d := _denominator(toks, i)) is not None:
            return d[0]
    return None


def _build(scale: int | None, money: bool, cents: bool, percent: bool, basis: bool, fraction: bool, per: Fraction | None, kind: str, *, foreign: bool = False, times: bool = False) -> Unit | None:
    """The unit of what an expression holds, read for a quantity of ``kind``; None if it states none."""
    if foreign and kind != "ratio":
        return Unit(Fraction(scale or 1), FOREIGN)
    if kind == "ratio":
        if times:  # so many times the price, of which a premium is what goes beyond one
            return Unit(Fraction(1), RATIO, Fraction(-1))
        if basis:
            return Unit(Fraction(1, 10_000), RATIO)
        if percent:
            return Unit(Fraction(1, 100), RATIO)
        return Unit(Fraction(1), RATIO) if fraction else None
    if percent or basis or not (scale or money or cents or per):
        return None
    factor = Fraction(scale or 1) * (Fraction(1, 100) if cents else 1)
    if kind == "usd_per_share":
        return Unit(factor / (per or 1), (1, -1, 0, 0)) if money or cents or per else None
    return Unit(factor, MONEY)


@lru_cache(maxsize=4096)
def parse_unit(text: str | None, kind: str) -> Unit | None:
    """The unit that a unit column states; None for 'as printed', 'n/a', empty, or unknown words."""
    if text is None:
        return None
    toks = _tokens(text)
    words = set(toks)
    if not toks or "printed" in words or toks == ["n", "/", "a"]:
        return None
    scale = next((SCALES[t] for t in toks if t in SCALES), None)
    per = _per_share(toks)
    whole = bool(words & WHOLE)
    return _build(scale, bool(words & CURRENCY) or whole, bool(words & CENTS), bool(words & PERCENT), bool(words & BASIS), bool(words & FRACTIONS), per, kind, foreign=bool(words & OTHER_CURRENCIES), times=bool(words & TIMES))


_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")


@lru_cache(maxsize=65536)
def _parse_quote(text: str, kind: str) -> Unit | None:
    """The unit that a quote states; the row's own figure is written '#' in it."""
    toks = _tokens(text)
    at = toks.index("#") if "#" in toks else -1
    scale = money = cents = percent = basis = fraction = foreign = times = None
    per = None
    if at >= 0:  # what stands at the figure itself
        nxt = toks[at + 1] if at + 1 < len(toks) else ""
        money = at > 0 and toks[at - 1] in CURRENCY or nxt in CURRENCY
        scale = SCALES.get(nxt)
        foreign = at > 0 and toks[at - 1] in OTHER_CURRENCIES or bool({nxt, *(toks[at + 2 : at + 3] if scale else ())} & OTHER_CURRENCIES)
        times = nxt in TIMES
        cents = nxt in CENTS
        percent, basis = nxt in PERCENT, nxt in BASIS
        if scale and at + 2 < len(toks):
            money = money or toks[at + 2] in CURRENCY
        fraction = bool(set(toks) & FRACTIONS)
        per = _per_share(toks)
    if kind != "usd":
        return _build(scale, money, cents, percent, basis, bool(fraction), per if money or cents else None, kind, foreign=bool(foreign), times=bool(times))
    if scale or foreign:
        return _build(scale, True, cents, False, False, False, None, kind, foreign=bool(foreign))
    # else a header clause: the clause that has a scale or names whole dollars
    clauses, clause = [], []
    for t in toks:
        if t in {",", ";", "(", ")", "[", "]", "\n", "|", "--", ":"}:
            clauses.append(clause)
            clause = []
        else:
            clause.append(t)
    for clause in [*clauses, clause]:
        words = set(clause)
        stated = next((k for k, t in enumerate(clause) if t in SCALES and (len(t) > 1 or k > 0 and clause[k - 1] in CURRENCY)), None)
        if "#" in clause and stated is not None:  # the figure's own clause: the scale follows a header word there
            clause = clause[clause.index("#") + 1 :] if stated > clause.index("#") else clause[: clause.index("#")]
            words, stated = set(clause), next((k for k, t in enumerate(clause) if t in SCALES and (len(t) > 1 or k > 0 and clause[k - 1] in CURRENCY)), None)
        if stated is not None:
            nouns = [t for t in clause[:stated] if t.isalpha() and t not in {"in", "us", "of"}]
            if "in" in clause[:stated] and nouns and not set(nouns) & MONEY_NOUNS and not words & CURRENCY and "#" not in text.lower().split(nouns[0])[0][-3:]:
                continue  # 'shares in thousands'
            if words & SHARES and "in" in clause[:stated]:
                continue
            return Unit(Fraction(SCALES[clause[stated]]), FOREIGN if words & OTHER_CURRENCIES else MONEY)
        if words & OTHER_CURRENCIES and ("in" in words or "rounded" in words or words & WHOLE):
            return Unit(Fraction(1), FOREIGN)
        if words & CURRENCY and ("in" in words or "rounded" in words or words & WHOLE):
            return Unit(Fraction(1), MONEY)
    return Unit(Fraction(1), MONEY) if money else None


def quote_unit(quote: str | None, value: str | None, kind: str) -> Unit | None:
    """The unit that a verbatim quote states for the figure ``value``; None if it states none."""
    if not quote:
        return None
    spans = list(_NUMBER.finditer(quote))
    own = None
    if value is not None:
        wanted = Fraction(value)
        own = next((m for m in spans if Fraction(m.group().rstrip(",").replace(",", "")) == wanted), None)
    if own is None and kind != "usd" and len(spans) == 1:
        own = spans[0]
    keep = [m for m in spans if m is not own and (m.group() in {"000", "100", "1,000"})]
    out, last = [], 0
    for m in spans:
        out.append(quote[last : m.start()])
        out.append(" # " if m is own else m.group() if m in keep else " ")
        last = m.end()
    out.append(quote[last:])
    return _parse_quote("".join(out), kind)


def stated_unit(unit: str | None, quote: str | None, value: str | None, kind: str) -> Unit | None:
    """The unit that holds for a row: the verbatim quote's before the unit column's."""
    return quote_unit(quote, value, kind) or parse_unit(unit.strip() if unit else None, kind)


def to_canonical(df: DataFrame, *, key: str, kind: str, value: str, unit: str, quote: str, out: str = "common_value") -> DataFrame:
    """``key`` and the value in the canonical unit of its kind, a whole number.

    ``kind`` names a column with 'usd', 'usd_per_share' or 'ratio'; the
    canonical units are whole dollars, hundredths of a cent per share, and
    basis points; halves round away from zero.  Rows whose unit neither column
    states (or that it does not fit the kind's dimension, as that of another currency), rows whose
    value in the canonical unit exceeds 64 bits and rows with a NULL
    value give no row; a repeated row gives its result again; an empty table
    an empty result.  The grammar runs once per Arrow batch in Python on the
    text columns, with a cache by quote shape; the arithmetic is the JVM's.
    """
    rows = df.select(F.col(key).alias("k"), F.col(kind).alias("kind"), F.col(value).cast("decimal(28,6)").alias("v"), F.col(unit).cast("string").alias("u"), F.col(quote).cast("string").alias("q")).where("v is not null")

    def parse(kinds: pd.Series, values: pd.Series, units: pd.Series, quotes: pd.Series) -> pd.DataFrame:
        out = []
        for k, v, u, q in zip(kinds, values, units, quotes):
            got = stated_unit(u, q, v, k) if k in TARGETS else None
            row = (None, None, None)
            if got is not None and got.dim == TARGETS[k].dim:
                f, offset = got.factor / TARGETS[k].factor, (got.offset - TARGETS[k].offset) / TARGETS[k].factor
                exact = (f.numerator * offset.denominator, f.denominator * offset.denominator, offset.numerator * f.denominator)
                row = exact if max(map(abs, exact)) < 2**63 else row
            out.append(row)
        return pd.DataFrame({c: pd.array([r[i] for r in out], "Int64") for i, c in enumerate(("num", "den", "add"))})

    factor = F.pandas_udf(parse, "num long, den long, add long")
    rows = rows.withColumn("f", factor("kind", F.col("v").cast("string"), "u", "q")).where("f.num is not null")
    part = lambda c: F.col(f"f.{c}").cast("decimal(20,0)")
    whole = F.round(F.try_divide(F.try_add(F.try_multiply(F.col("v"), part("num")), part("add")), part("den")), 0)
    rows = rows.select(F.col("k").alias(key), whole.alias("c")).where(F.col("c").between(-(2**63), 2**63 - 1))
    return rows.select(key, F.col("c").cast("bigint").alias(out))
