"""Documents of filing feeds as relations; native JSON and XML functions, no Python per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_lines(lines: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    """``form, company, cik, filed, path`` from the lines of a fixed-width daily index (column ``value``); other lines are no rows."""
    got = lines.select(*(F.trim(F.regexp_extract("value", r"^(\S+(?: \S+)*?)\s{2,}(.+?)\s{2,}(\d{1,10})\s+(\d{8}|\d{4}-\d{2}-\d{2})\s+(\S+)\s*$", k)).alias(n) for k, n in enumerate(("form", "company", "cik", "filed", "path"), 1)))
    return got.where(F.col("form").isin(list(forms))).withColumn("filed", F.coalesce(F.try_to_timestamp("filed", F.lit("yyyyMMdd")), F.try_to_timestamp("filed", F.lit("yyyy-MM-dd"))).cast("date"))


def submissions_rows(docs: DataFrame, *, column: str = "json") -> DataFrame:
    """``cik, accession, form, filed, items`` from documents that hold parallel arrays."""
    schema = "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, items: array<string>>>"
    r = docs.select(F.from_json(column, schema).alias("j")).select("j.cik", F.explode(F.arrays_zip("j.filings.recent.accessionNumber", "j.filings.recent.form", "j.filings.recent.filingDate", "j.filings.recent.items")).alias("z"))
    return r.select("cik", F.col("z.accessionNumber").alias("accession"), F.col("z.form").alias("form"), F.try_to_timestamp("z.filingDate", F.lit("yyyy-MM-dd")).cast("date").alias("filed"), F.col("z.items").alias("items"))


def observations(docs: DataFrame, *, column: str = "json", series: str = "series_id") -> DataFrame:
    """``series_id, obs_date, value``: a '.' is no value."""
    schema = "observations array<struct<date: string, value: string>>"
    o = docs.select(series, F.explode(F.from_json(column, schema)["observations"]).alias("o"))
    return o.select(series, F.try_to_timestamp("o.date", F.lit("yyyy-MM-dd")).cast("date").alias("obs_date"), F.expr("try_cast(nullif(o.value, '.') as decimal(38,10))").alias("value"))


def ticker_map(docs: DataFrame, *, column: str = "json") -> DataFrame:
    """``cik, ticker, title`` from a document that maps row numbers to rows."""
    rows = docs.select(F.explode(F.map_values(F.from_json(column, "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("r"))
    return rows.select(F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"), "r.ticker", "r.title")


def feed_entries(docs: DataFrame, *, column: str = "xml") -> DataFrame:
    """``accession, form, title, updated``: distinct entries of atom documents, by (form, accession)."""
    schema = "entry array<struct<title: string, updated: string, id: string, category: struct<_term: string>>>"
    e = docs.select(F.explode(F.from_xml(F.col(column), schema)["entry"]).alias("e"))
    got = e.select(F.regexp_extract("e.id", r"(\d{10}-\d{2}-\d{6})", 1).alias("accession"), F.col("e.category._term").alias("form"), F.col("e.title").alias("title"), F.col("e.updated").alias("updated")).where("accession <> ''")
    return got.groupBy("accession", "form").agg(F.max(F.struct("updated", "title")).alias("m")).select("accession", "form", "m.title", "m.updated")


def ownership_transactions(docs: DataFrame, *, column: str = "xml", key: str = "accession") -> DataFrame:
    """One row per open-market purchase of an ownership document, its value shared among joint owners."""
    schema = (
        "issuer struct<issuerCik: string, issuerTradingSymbol: string>, periodOfReport string,"
        "reportingOwner array<struct<reportingOwnerId: struct<rptOwnerCik: string>, reportingOwnerRelationship: struct<isDirector: string, isOfficer: string, isTenPercentOwner: string>>>,"
        "nonDerivativeTable struct<nonDerivativeTransaction: array<struct<transactionDate: struct<value: string>, transactionCoding: struct<transactionCode: string>, transactionAmounts: struct<transactionShares: struct<value: string>, transactionPricePerShare: struct<value: string>>>>>"
    )
    d = docs.select(key, F.from_xml(F.col(column), schema).alias("x"))
    yes = lambda c: F.coalesce(F.lower(c).isin("1", "true"), F.lit(False))
    d = d.withColumn("owners", F.filter("x.reportingOwner", lambda o: yes(o["reportingOwnerRelationship"]["isDirector"]) | yes(o["reportingOwnerRelationship"]["isOfficer"]) | yes(o["reportingOwnerRelationship"]["isTenPercentOwner"]))).where("size(owners) > 0")
    t = d.select(key, "x", "owners", F.explode("x.nonDerivativeTable.nonDerivativeTransaction").alias("t")).where("t.transactionCoding.transactionCode = 'P'").withColumn("o", F.explode("owners"))
    value = F.expr("try_cast(t.transactionAmounts.transactionShares.value as decimal(20,4)) * try_cast(t.transactionAmounts.transactionPricePerShare.value as decimal(17,6))")
    insider = yes(F.col("o.reportingOwnerRelationship.isDirector")) | yes(F.col("o.reportingOwnerRelationship.isOfficer"))
    return t.select(key, F.col("x.issuer.issuerCik").alias("issuer"), F.col("x.issuer.issuerTradingSymbol").alias("symbol"), F.when(insider, "insider").otherwise("ten_percent").alias("role"), F.col("o.reportingOwnerId.rptOwnerCik").alias("buyer"), F.to_date(F.coalesce("t.transactionDate.value", "x.periodOfReport")).alias("day"), (value / F.size("owners")).cast("decimal(20,2)").alias("value"))


def listed_universe(rows: DataFrame, *, exchanges: tuple[str, ...], types: tuple[str, ...], today: str, within_days: int = 30) -> DataFrame:
    """Symbols of the wanted exchanges and types that traded lately and are no test symbols."""
    test = F.col("ticker").rlike(r"^(ZTEST|ZVZZT|ZWZZT|ZXZZT|ZJZZT|NTEST|CTEST|PTEST)")
    return rows.where(F.col("exchange").isin(list(exchanges)) & F.col("asset_type").isin(list(types)) & ~test & (F.datediff(F.lit(today).cast("date"), F.col("end_date").cast("date")) <= within_days))
