"""Smaller plans: macro series, reconciliation of universes, ticker histories, text rules, catalog statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import cik_key


def latest_per_series(macro: DataFrame) -> DataFrame:
    """The newest observation of each series that has a value."""
    rows = macro.where("value is not null").groupBy("series_id").agg(F.max(F.struct("obs_date", "value")).alias("m"))
    return rows.select("series_id", "m.obs_date", "m.value")


def change_over_days(macro: DataFrame, days: Sequence[int]) -> DataFrame:
    """``series_id, days, value, then_date, then_value, change``: the newest value against the one on or before so many days earlier."""
    newest = latest_per_series(macro).withColumn("days", F.explode(F.array(*map(F.lit, days))))
    then = macro.where("value is not null").select(F.col("series_id").alias("_s"), F.col("obs_date").alias("_d"), F.col("value").alias("_v"))
    met = newest.join(then, (F.col("series_id") == F.col("_s")) & (F.col("_d") <= F.expr("date_sub(obs_date, days)")), "left")
    g = met.groupBy("series_id", "days", "obs_date", "value").agg(F.max(F.struct("_d", "_v")).alias("m"))
    return g.select("series_id", "days", "value", F.col("m._d").alias("then_date"), F.col("m._v").alias("then_value"), (F.col("value") - F.col("m._v")).alias("change"))


def reconcile(left: DataFrame, right: DataFrame, *, key: str) -> DataFrame:
    """``key, side``: keys of two universes as 'both', 'left_only' or 'right_only'."""
    sides = left.select(key, F.lit(1).alias("s")).distinct().unionByName(right.select(key, F.lit(2).alias("s")).distinct()).where(F.col(key).isNotNull())
    return sides.groupBy(key).agg(F.sum("s").alias("s")).select(key, F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "left_only").otherwise("right_only").alias("side"))


def ticker_owners(history: DataFrame) -> DataFrame:
    """``ticker, owners, ciks``: how many companies each symbol has belonged to (a list, never one pick)."""
    return history.groupBy("ticker").agg(F.countDistinct("cik").alias("owners"), F.array_join(F.array_sort(F.collect_set("cik")), ",").alias("ciks"))


def collapse_ranges(sightings: DataFrame) -> DataFrame:
    """One row per (company, symbol) with its first and last sighting and the number of filings."""
    return sightings.groupBy("cik", "ticker").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("filings").cast("bigint").alias("filings"))


def price_fate(history: DataFrame, bars: DataFrame) -> DataFrame:
    """``cik, ticker, fate``: whether bars cover a company's time under a symbol.

    usable: bars overlap its range; before_our_history: the bars start only after it and nobody else
    held the symbol; not_in_file: no bars at all; other_owner_bars: bars, but outside its range.
    """
    span = bars.groupBy("ticker").agg(F.min("date").alias("first_bar"), F.max("date").alias("last_bar"))
    whole = F.broadcast(bars.agg(F.min("date").alias("from_day")))
    own = collapse_ranges(history)
    j = own.join(span, "ticker", "left").crossJoin(whole)
    fate = F.when((F.col("first_bar") <= F.col("last_seen")) & (F.col("last_bar") >= F.col("first_seen")), "usable").when(F.col("last_seen") < F.col("from_day"), "before_our_history").when(F.col("first_bar").isNull(), "not_in_file").otherwise("other_owner_bars")
    return j.select("cik", "ticker", "first_seen", "last_seen", "first_bar", "last_bar", fate.alias("fate"))


def route_counts(history: DataFrame) -> DataFrame:
    """Companies and symbols by the route that found them."""
    return history.groupBy("source").agg(F.count("*").alias("rows"), F.countDistinct("cik").alias("ciks"), F.countDistinct("ticker").alias("tickers"))


def growth_of_series(projections: DataFrame, *, value: str = "revenue") -> DataFrame:
    """``accession, scenario, points, first_year, last_year, cagr``: yearly growth between the first and last positive figure."""
    ok = projections.where(F.col(value) > 0).groupBy("accession", F.coalesce("scenario", F.lit("")).alias("scenario"), "fiscal_year").agg(F.max(value).alias("v"))
    g = ok.groupBy("accession", "scenario").agg(F.count("*").alias("points"), F.min(F.struct("fiscal_year", "v")).alias("a"), F.max(F.struct("fiscal_year", "v")).alias("b"))
    years = F.col("b.fiscal_year") - F.col("a.fiscal_year")
    cagr = F.when(years > 0, F.pow(F.col("b.v").cast("double") / F.col("a.v").cast("double"), 1.0 / years) - 1)
    return g.select("accession", "scenario", "points", F.col("a.fiscal_year").alias("first_year"), F.col("b.fiscal_year").alias("last_year"), F.round(cagr, 6).alias("cagr"))


def dataset_stats(named: Sequence[tuple[str, DataFrame, str | None]]) -> DataFrame:
    """``dataset, rows, newest``: one row per dataset, the newest day as text."""
    out = None
    for name, df, day in named:
        one = df.agg(F.count("*").alias("rows"), (F.date_format(F.max(F.col(day)), "yyyy-MM-dd") if day else F.lit(None).cast("string")).alias("newest")).select(F.lit(name).alias("dataset"), "rows", "newest")
        out = one if out is None else out.unionByName(one)
    return out


def overdue_jobs(beats: DataFrame, cadence: DataFrame, *, now) -> DataFrame:
    """``job, last_run, due_every_hours, overdue``: whether each job has run since it was last due."""
    last = beats.groupBy("job").agg(F.max("at").alias("last_run"))
    j = cadence.join(last, "job", "left")
    late = F.col("last_run").isNull() | ((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_run")) > F.col("due_every_hours") * 3600)
    return j.select("job", "last_run", "due_every_hours", late.alias("overdue"))


# --- rules over text ---------------------------------------------------------

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#8217;", "'"), ("&#160;", " "), ("&amp;", "&"))


def visible_text(html: Column) -> Column:
    """What a reader sees of an HTML text: tags go before entities are read, so an escaped '<' stays text."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?is)<[^>]*>", " ")
    for entity, plain in _ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


_MONEY = r"\$ ?(\d[\d,]*(?:\.\d+)?) ?(thousand|million|billion|bn)?"


def largest_amount(text: Column, *, floor: float = 1e4, ceiling: float = 5e11) -> Column:
    """The greatest dollar amount that a text names within the bounds, in whole dollars; NULL without one."""
    found = F.arrays_zip(F.regexp_extract_all(F.lower(text), F.lit(_MONEY), 1).alias("n"), F.regexp_extract_all(F.lower(text), F.lit(_MONEY), 2).alias("u"))
    scale = lambda u: F.when(u == "thousand", 1e3).when(u == "million", 1e6).when(u.isin("billion", "bn"), 1e9).otherwise(1.0)
    amounts = F.transform(found, lambda x: F.round(F.replace(x["n"], F.lit(","), F.lit("")).cast("double") * scale(x["u"])))
    return F.array_max(F.filter(amounts, lambda a: (a >= floor) & (a <= ceiling))).cast("bigint")


def densest_window(text: Column, *, size: int = 400, least: int = 3) -> Column:
    """Start (from 0) of the ``size``-character block of a text with most figures, the first of equals; NULL below ``least`` figures."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size) - 1).cast("int")), lambda k: F.struct(F.regexp_count(F.substring(text, k * size + 1, F.lit(size)), F.lit(r"\d[\d,.]*")).alias("n"), (-k).alias("at")))
    best = F.array_max(blocks)
    return F.when(best["n"] >= least, -best["at"] * size)


#: Currency amounts, percentages and bare decimals.
_FIGURE = r"(?U)\$\s?[\d,]+(?:\.\d+)?|\d+(?:\.\d+)?\s?%|\b\d+\.\d{2,4}\b"

#: Headings of each section, the most specific first.
SECTIONS = {
    "merger_consideration": (
        r"(?:right\s+to\s+receive|entitled\s+to\s+receive|consideration\s+of|Per\s+Share\s+Price[^.]{0,30}?is)[^.]{0,90}?(?:\$\s?[\d,]+(?:\.\d+)?|[\d.]{4,7}\s+(?:of\s+a\s+)?share)", r"each\s+(?:issued\s+and\s+outstanding\s+)?share[^.]{0,160}?(?:converted\s+into|entitled\s+to\s+receive)", r"What\s+(?:will\s+I|I\s+will)\s+receive\s+in\s+the\s+[Mm]erger", r"Consideration\s+to\s+be\s+Received", r"(?:The\s+)?Merger\s+Consideration\b",
    ),
    "premium_statement": (r"premium\s+of\s+(?:approximately\s+)?[\d.]+\s?%", r"[\d.]+\s?%\s+premium\b", r"represent(?:s|ed|ing)\s+a\s+premium"),
    "prospective_financial": (r"(?i:(?:Certain\s+)?(?:Unaudited\s+)?Prospective\s+Financial\s+Information)", r"(?i:Management(?:'s)?\s+(?:Projections|Forecasts|Financial\s+Projections))", r"(?i:(?:Internal\s+)?Financial\s+(?:Projections|Forecasts))"),
    "fairness_opinion": (r"Opinion\s+of\s+[A-Z][^\n]{0,70}?(?:Financial\s+Advisor|&\s*Co\.?|Securities|Partners|LLC|Inc\.)", r"Opinion\s+of\s+the\s+(?:Company|Board)'?s?\s+Financial\s+Advisor"),
}


def section_window(text: Column, headings: Sequence[str], *, size: int = 8000, least: int = 3) -> Column:
    """``(start, end, heading, figures, candidates)`` of the window of ``size`` characters after a heading that holds most figures, the first of equals.

    The patterns of ``headings`` (none of which matches an empty text) are tried in order; the first with a window of
    at least ``least`` figures decides.  NULL if none has one.
    """
    picks = []
    for heading in headings:
        found = F.regexp_extract_all(text, F.lit(f"(?U){heading}"), F.lit(0))
        between = F.split(text, f"(?U){heading}", -1)
        total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
        starts = F.transform(found, lambda m, i: F.struct((total(F.slice(between, 1, i + 1)) + total(F.slice(found, 1, i))).alias("at"), m.alias("m")))
        scored = F.transform(starts, lambda s: F.struct(F.regexp_count(F.substring(text, s["at"] + 1, F.lit(size)), F.lit(_FIGURE)).alias("n"), (-s["at"]).alias("at"), s["m"].alias("m")))
        best = F.array_max(scored)
        title = F.substring(F.trim(F.regexp_replace(best["m"], r"(?U)\s+", " ")), 1, 120)
        picks.append(F.when(best["n"] >= least, F.struct((-best["at"]).alias("start"), F.least(F.length(text), -best["at"] + size).alias("end"), title.alias("heading"), best["n"].alias("figures"), F.size(found).alias("candidates"))))
    return F.coalesce(*picks)


def consideration_shape(figures: DataFrame) -> DataFrame:
    """One row per filing: how many figures of each kind are stated, and the shape that makes."""
    has = lambda f: F.count_if((F.col("field") == f) & (F.col("reason") == "stated"))
    g = figures.groupBy("accession").agg(F.count("*").alias("figures"), has("consideration_per_share").alias("prices"), has("premium_pct").alias("premiums"), has("termination_fee").alias("fees"))
    return g.withColumn("shape", F.when(F.col("prices") > 1, "several_prices").when(F.col("prices") == 1, "one_price").otherwise("no_price"))


def coherent_projections(projections: DataFrame, *, most_step: float = 10.0) -> DataFrame:
    """``id, coherent, why``: rows whose figures can hold together (operating profit within EBITDA, margins in range, no wild step from the year before)."""
    w = Window.partitionBy("accession", F.coalesce("scenario", F.lit(""))).orderBy("fiscal_year", "id")
    prior = F.lag("revenue").over(w)
    margin = F.try_divide(F.col("ebitda").cast("double"), F.col("revenue").cast("double"))
    step = F.try_divide(F.col("revenue").cast("double"), prior.cast("double"))
    why = F.when(F.col("revenue").isNull(), "no_revenue").when(F.col("ebit") > F.col("ebitda"), "ebit_above_ebitda").when(~margin.between(-2.0, 0.7), "margin").when((step > most_step) | (step < 1 / most_step), "step")
    return projections.withColumn("why", why).select("id", F.col("why").isNull().alias("coherent"), "why")


def normalised_accession(c: Column) -> Column:
    """An accession with its dashes (10-2-6 digits), NULL if it is none."""
    hit = r"(\d{10})-?(\d{2})-?(\d{6})"
    parts = [F.regexp_extract(c, hit, k) for k in (1, 2, 3)]
    return F.when(parts[0] != "", F.concat_ws("-", *parts))


def trading_symbol(html: Column) -> Column:
    """``(symbol, route)`` of a filing's cover: the tagged symbol before one in prose, NULL without either."""
    tagged = F.regexp_extract(html, r'(?is)name="dei:TradingSymbol"[^>]*>(?:\s|<[^>]*>)*([A-Z][A-Z.\-]{0,9})\b', 1)
    prose = F.regexp_extract(html, r"\((?:NYSE|NASDAQ|Nasdaq|AMEX|OTC)[^:)]{0,20}:\s*([A-Z][A-Z.\-]{0,9})\)", 1)
    symbol = F.coalesce(F.nullif(tagged, F.lit("")), F.nullif(prose, F.lit("")))
    return F.when(symbol.isNotNull(), F.struct(symbol.alias("symbol"), F.when(tagged != "", "tag").otherwise("prose").alias("route")))


def filings_by_cik(deals: DataFrame) -> DataFrame:
    """Filings with their company's ten-digit key, how late the company files, and whether it files again later."""
    d = deals.withColumn("cik10", cik_key("cik")).groupBy("accession").agg(F.max("cik10").alias("cik10"), F.max("filed_date").alias("filed_date"))
    last = d.groupBy("cik10").agg(F.max("filed_date").alias("last_filed")).withColumnRenamed("cik10", "_k")
    return d.join(last, F.col("cik10").eqNullSafe(F.col("_k"))).drop("_k").withColumn("files_later", F.col("last_filed") > F.col("filed_date"))
