"""Names and symbols of companies: keys for comparison, diagnosis of symbols, the daily promotion of filers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.exprs import cik_key

# Endings of company names, longest kinds of security first.
CLASS_SUFFIXES = ("common stock", "common shares", "ordinary shares", "class a", "class b", "class c", "series a", "series b")
ENTITY_SUFFIXES = ("incorporated", "corporation", "companies", "company", "holdings", "holding", "limited", "partners", "group", "trust", "plc", "llc", "llp", "ltd", "inc", "corp", "co", "lp", "sa", "nv", "ag", "ab", "as", "oy")
# Words of an organisation's name, and of a pooled vehicle's.
ENTITY_WORDS = ("LLC", "LLP", "LP", "LTD", "INC", "CORP", "CORPORATION", "CO", "PLC", "GP", "TRUST", "FUND", "FUNDS", "CAPITAL", "MANAGEMENT", "PARTNERS", "ADVISORS", "ADVISERS", "HOLDINGS", "HOLDING", "GROUP", "ASSOCIATES", "VENTURES", "INVESTMENT", "INVESTMENTS", "ASSET", "SA", "NV", "AG", "BV", "GMBH", "COMPANY", "BANK", "INSURANCE", "REINSURANCE")
FUND_WORDS = ("FUND", "FUNDS", "TRUST", "PORTFOLIO", "PORTFOLIOS", "LP", "PARTNERS", "CAPITAL")
# Venues that are no listing.
OTC_EXCHANGES = ("PINK", "OTCMKTS", "OTCQB", "OTCQX", "OTCGREY", "OTCD", "NMFQS", "OTCBB")
STRUCTURED_TAIL = r"(?:WS|WT|RT)$|(?<=[A-Z]{4})[UWR]$"


def bare_name(name: Column) -> Column:
    """A name without accents, punctuation, a leading 'the' and the endings of class and legal form, however many.

    Never empty for a name of letters: what would leave nothing stays.
    """
    plain = F.regexp_replace(_fold_accents(name), r"\p{M}+", "")
    text = F.regexp_replace(F.regexp_replace(F.replace(F.lower(plain), F.lit("&"), F.lit(" and ")), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    text = F.regexp_replace(F.trim(text), r"^the\s+", "")
    for suffix in CLASS_SUFFIXES:
        text = F.regexp_replace(text, rf"(?<=\S) {suffix}$", "")
    return F.regexp_replace(text, rf"(?<=\S)(?: (?:{'|'.join(ENTITY_SUFFIXES)}))+$", "")


# Latin letters with marks, and what they are without.
_MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžÀÁÂÃÄÅĀĂĄÇĆĈĊČĎÈÉÊËĒĔĖĘĚĜĞĠĢĤÌÍÎÏĨĪĬĮİĴĶĹĻĽÑŃŅŇÒÓÔÕÖŌŎŐŔŖŘŚŜŞŠŢŤÙÚÛÜŨŪŬŮŰŲŴÝŸŶŹŻŽ"


def _fold_accents(name: Column) -> Column:
    """Letters with marks as plain ones; native, by a table made from Unicode's decompositions."""
    import unicodedata

    plain = "".join(unicodedata.normalize("NFKD", ch)[0] for ch in _MARKED)
    return F.translate(name, _MARKED, plain)


def symbol_variants(ticker: Column) -> Column:
    """Spellings of a symbol that vendors treat as one: dash for dot, dot for dash, neither.  For diagnosis, never a key."""
    return F.array_sort(F.array_distinct(F.array(ticker, F.replace(ticker, F.lit("-"), F.lit(".")), F.replace(ticker, F.lit("."), F.lit("-")), F.regexp_replace(ticker, "[-.]", ""))))


def is_structured(ticker: Column) -> Column:
    """Units, warrants, rights and preferred classes, written against a parent's symbol."""
    return ticker.rlike("[-.]") | ticker.rlike(STRUCTURED_TAIL)


def base_symbol(ticker: Column) -> Column:
    """The parent's symbol."""
    return F.regexp_replace(F.regexp_replace(ticker, "[-.].*$", ""), STRUCTURED_TAIL, "")


def symbol_gaps(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``ticker, why``: symbols of ``wanted`` that ``known`` lacks and the first thing that explains it.

    spelling: known in another spelling; parent: its parent's symbol is known; otc: listed at no exchange (``exchange`` of
    ``wanted``); foreign: five letters that end in F or Y; else unknown.
    """
    have = known.select("ticker").where("ticker is not null").distinct()
    lost = wanted.where("ticker is not null").groupBy("ticker").agg(F.max("exchange").alias("exchange")).join(have, "ticker", "left_anti")
    spelled = lost.select("ticker", F.explode(symbol_variants(F.col("ticker"))).alias("v")).join(have.withColumnRenamed("ticker", "v"), "v", "left_semi").select("ticker", F.lit(True).alias("spelled")).distinct()
    parent = lost.where(is_structured(F.col("ticker"))).select("ticker", base_symbol(F.col("ticker")).alias("v")).join(have.withColumnRenamed("ticker", "v"), "v", "left_semi").select("ticker", F.lit(True).alias("parent"))
    j = lost.join(spelled, "ticker", "left").join(parent, "ticker", "left")
    why = F.when(F.col("spelled"), "spelling").when(F.col("parent"), "parent").when(F.col("exchange").isin(list(OTC_EXCHANGES)), "otc").when(F.col("ticker").rlike("^[A-Z]{4}[FY]$"), "foreign").otherwise("unknown")
    return j.select("ticker", why.alias("why"))


def _words(name: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[A-Za-z][A-Za-z&.']*"), F.lit(0)), lambda w: F.upper(F.trim(w, F.lit("."))))


def fund_like(buyers: Column, symbol: Column, issuer: Column) -> Column:
    """Why a cluster looks like funds buying a fund (NULL if it does not): all ``buyers`` (an array of names) read as organisations, and so does the issuer."""
    organisations = (F.size(buyers) > 0) & F.forall(buyers, lambda b: F.arrays_overlap(_words(b), F.array(*map(F.lit, ENTITY_WORDS))))
    reasons = F.array_compact(F.array(F.when(symbol.rlike("^[A-Z]{4}X$"), "fund ticker"), F.when(symbol.isNull(), "no listed equity"), F.when(F.arrays_overlap(_words(issuer), F.array(*map(F.lit, FUND_WORDS))), "fund in issuer name")))
    return F.when(organisations & (F.size(reasons) > 0), F.concat(F.lit("all buyers are entities; "), F.array_join(reasons, ", ")))


REASONS = ("volatility", "deal_filing", "form4_cluster")


class PromotionError(RuntimeError):
    """The promoted set cannot be built."""


def promote_day(day: date, listed: DataFrame, symbols: DataFrame, deals: DataFrame, clusters: DataFrame, *, window_days: int = 7, deal_types: Sequence[str] = ("operating", "division_sale")) -> DataFrame:
    """``cik10, company, ticker, tickers, reasons, n_reasons`` of the filers promoted for a session, most reasons first, then by company and key.

    ``listed``: ``ticker, security_type, pct_move`` of the day's lists, of which stocks count; ``symbols``: ``ticker,
    cik, company, last_seen``, whose newest row (then the least key) says whom a symbol belongs to; ``deals``: ``cik, company, filed_date,
    deal_type`` filed on the day; ``clusters``: ``key, at`` ('cluster:<cik>:<role>:<day>') within ``window_days`` up to the day, by UTC.
    Keys only, never names.  A filer's ticker is that of its largest move, then the greatest symbol; its
    company the name of the first reason that has one.  No symbol of a non-empty list found is an error.
    """
    stock = listed.where("security_type = 'stock' and ticker is not null").groupBy("ticker").agg(F.max(F.abs("pct_move")).alias("move"))
    owner = symbols.where("ticker is not null").withColumn("cik10", cik_key("cik")).groupBy("ticker", "last_seen").agg(F.min(F.struct("cik10", "company")).alias("o")).groupBy("ticker").agg(F.max_by("o", F.coalesce("last_seen", F.lit("0001-01-01").cast("date"))).alias("o")).select("ticker", "o.cik10", "o.company")
    moved = stock.join(owner, "ticker")
    if moved.isEmpty() and not stock.isEmpty():
        raise PromotionError(f"no symbol of the lists of {day} belongs to a filer: look at the keys of both sides")
    leg = lambda df, k, *cols: df.select("cik10", F.lit(k).alias("k"), *cols)
    none, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = leg(moved, 0, "company", "ticker", F.col("move").cast("double").alias("move"))
    filed = deals.where((F.col("filed_date") == F.lit(day)) & F.col("deal_type").isin(list(deal_types))).withColumn("cik10", cik_key("cik"))
    rows = rows.unionByName(leg(filed, 1, "company", none.alias("ticker"), no_number.alias("move")))
    seen = clusters.where(F.to_date("at").between(F.date_sub(F.lit(day), window_days - 1), F.lit(day))).withColumn("cik10", cik_key(F.regexp_extract("key", r"^cluster:(\d+):[a-z_]+:\d{4}-\d{2}-\d{2}$", 1)))
    rows = rows.unionByName(leg(seen, 2, none.alias("company"), none.alias("ticker"), no_number.alias("move"))).where("cik10 is not null")
    name = F.when(F.coalesce("company", F.lit("")) != "", F.struct("k", "company"))
    g = rows.groupBy("cik10").agg(F.min(name).alias("n"), F.max(F.when(F.col("ticker").isNotNull(), F.struct("move", "ticker"))).alias("t"), F.array_sort(F.collect_set("ticker")).alias("tickers"), F.array_sort(F.collect_set("k")).alias("ks"))
    out = g.select("cik10", F.coalesce("n.company", "cik10").alias("company"), F.col("t.ticker").alias("ticker"), F.array_join("tickers", ",").alias("tickers"), F.array_join(F.transform("ks", lambda k: F.element_at(F.array(*map(F.lit, REASONS)), k + 1)), ",").alias("reasons"), F.size("ks").alias("n_reasons"))
    return out.orderBy(F.desc("n_reasons"), "company", "cik10")
