"""Queries over readers, writers, contracts and streams: each writes whole tables to shared storage, reads them back, and their SQL."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.exprs import cik_key, iso, market_date
from quillspark.operators import merge, quality
from quillspark.operators.ledger import ChunkLedger
from quillspark.operators.ordering import sorted_by
from quillspark.plans.adapters import relation, with_relations
from quillspark.session import checkpoint_dir
from quillspark.sources import delimited, feeds, generators
from quillspark.sources.catalog import Catalog, CatalogError, DatasetRef, may_publish, with_listing
from quillspark.sources.tables import table
from quillspark.streaming import polling

TEST_SYMBOLS = "ticker like 'ZTEST%'"


def _room(spark: SparkSession) -> str:
    """A new folder on the storage that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def _year_files(spark: SparkSession, d: str) -> Catalog:
    """The daily bars as one partition a year, and the catalog of these."""
    room = _room(spark)
    bars = table(spark, d, "prices_eod_raw").select("ticker", "date", "source", "close", "listing_id")
    merge.write_years(bars, room)
    years = [r["y"] for r in bars.select(F.year("date").alias("y")).distinct().collect()]  # one row a year
    catalog = Catalog()
    for y in sorted(years):
        catalog.add(DatasetRef("prices", str(y), f"{room}/year={y}"))
    return catalog


def src_catalog_all_years(spark, d):
    """Bars of all partitions in one relation, by year."""
    bars = with_listing(_year_files(spark, d).read(spark, "prices"))
    return bars.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("rows"), F.sum("close").cast("double").alias("closes"), F.count("listing_id").alias("listed"))


def src_catalog_recent_years(spark, d):
    """Bars of a year and the one before it; no other partition is read."""
    bars = _year_files(spark, d).read_recent_years(spark, "prices", 2020)
    return bars.groupBy("ticker").agg(F.count("*").alias("rows"), iso(F.min("date")).alias("first_day"), iso(F.max("date")).alias("last_day"))


def src_catalog_lookup(spark, d):
    """What the catalog says of each partition: its location is there, it may be published, or why not."""
    catalog = _year_files(spark, d)
    catalog.add(DatasetRef("lost", "all", f"{_room(spark)}/nowhere"))
    catalog.add(DatasetRef("private", "all", "x", "postgres"))
    rows = []
    for name, part, state in catalog.verify(spark):
        try:
            may_publish(catalog.get(name, part), 1 if state == "ok" else 0)
            publish = True
        except CatalogError:
            publish = False
        rows.append((name, part, state, publish))
    return generators.values(spark, rows, "dataset string, part string, state string, may_publish boolean")


def src_text_table(spark, d):
    """Submissions through a tab-separated file of all-text columns."""
    room = _room(spark)
    relation(spark, d, "raw_sub").write.csv(room, sep="\t", header=True, quote="", emptyValue="")
    back = delimited.read_text_table(spark, room, required=["adsh", "cik", "form", "period"])
    return back.groupBy("form", "fp").agg(F.count("*").alias("filings"), F.countDistinct("cik").alias("filers"), F.min("period").alias("first_period"), F.max("filed").alias("last_filed"))


def src_csv_skips_bad_rows(spark, d):
    """Customers through a comma-separated file in which every tenth line has too many fields."""
    room = _room(spark)
    c = table(spark, d, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(', x"')), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 10 == 0, F.lit("one,too,many")))
    c.select(line.alias("c_custkey,c_name,c_nationkey")).write.csv(room, header=True, sep="\x01", quote="", escapeQuotes=False)  # whole lines, as they are
    back = delimited.read_text_table(spark, room, sep=",", required=["c_custkey"], skip_bad=True)
    return back.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("nation"))


def src_index_lines(spark, d):
    """Filings through the lines of a fixed-width daily index."""
    filings = table(spark, d, "deals").select("accession", "filed_date", cik_key("cik").alias("cik10"), F.col("id")).where("cik10 is not null and filed_date is not null")
    line = F.concat(F.rpad(F.when(F.col("id") % 2 == 0, "8-K").otherwise("SC 13D"), 12, " "), F.rpad(F.concat(F.lit("COMPANY "), F.col("id").cast("string"), F.lit(" INC")), 40, " "), F.rpad(F.regexp_replace("cik10", "^0+", ""), 14, " "), F.rpad(F.date_format("filed_date", "yyyyMMdd"), 12, " "), F.concat(F.lit("edgar/data/"), F.col("accession"), F.lit(".txt")))
    room = _room(spark)
    filings.select(line.alias("value")).unionByName(generators.values(spark, [("Form Type   Company Name",), ("-" * 80,)], "value string")).write.text(room)
    got = feeds.index_lines(spark.read.text(room), ("8-K",))
    return got.select("form", "company", "cik", iso("filed").alias("filed"), "path")


def src_submissions(spark, d):
    """Filings through the companies' documents of parallel arrays."""
    one = table(spark, d, "deals").where("accession is not null and cik is not null").groupBy("accession").agg(F.max(F.struct("id", "cik", "filed_date")).alias("m"))
    rows = one.select("accession", F.col("m.cik").alias("cik"), F.col("m.filed_date").alias("filed_date"))
    g = rows.groupBy("cik").agg(F.array_sort(F.collect_list(F.struct("accession", F.coalesce(iso("filed_date"), F.lit("")).alias("filed")))).alias("f"))
    recent = F.struct(F.col("f.accession").alias("accessionNumber"), F.transform("f", lambda x: F.lit("8-K")).alias("form"), F.col("f.filed").alias("filingDate"), F.transform("f", lambda x: F.lit("1.01")).alias("items"))
    docs = g.select(F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("json"))
    return feeds.submissions_rows(docs).select("cik", "accession", "form", iso("filed").alias("filed"), "items")


def src_observations(spark, d):
    """A series' observations through its document, in which a point stands for no value."""
    m = relation(spark, d, "macro")
    o = F.struct(iso("obs_date").alias("date"), F.coalesce(F.col("value").cast("string"), F.lit(".")).alias("value"))
    docs = m.groupBy("series_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(o)).alias("observations"))).alias("json"))
    return feeds.observations(docs).select("series_id", iso("obs_date").alias("obs_date"), F.col("value").cast("double").alias("value"))


def src_ticker_map(spark, d):
    """Registrants through documents that number their rows, a hundred documents in all."""
    n = relation(spark, d, "sec_names").where("tickers <> ''").select(F.col("cik").cast("bigint").alias("k"), "tickers", "name")
    entry = F.struct(F.col("k").cast("string").alias("key"), F.struct(F.col("k").alias("cik_str"), F.col("tickers").alias("ticker"), F.col("name").alias("title")).alias("value"))
    docs = n.groupBy((F.col("k") % 100).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json"))
    return feeds.ticker_map(docs)


def src_feed(spark, d):
    """Filings through atom documents, one a filing day, in which deliveries repeat."""
    f = table(spark, d, "deals").where("filed_date is not null and accession rlike '^[0-9]{10}-[0-9]{2}-[0-9]{6}$'")
    entry = F.concat(F.lit("<entry><title>8-K - Filer</title><updated>"), iso("filed_date"), F.lit("</updated><id>urn:accession-number="), F.col("accession"), F.lit("</id><category term='8-K'/></entry>"))
    docs = f.groupBy("filed_date").agg(F.concat(F.lit("<feed>"), F.concat_ws("", F.collect_list(entry)), F.lit("</feed>")).alias("xml"))
    return feeds.feed_entries(docs).select("accession", "form", F.col("updated").cast("string").alias("updated"))


def src_ownership(spark, d):
    """Purchases through ownership documents; the value is shared among joint owners, and a sale is none."""
    e = table(spark, d, "events").where("event_type = 'purchase' and value > 0")
    owner = lambda k, role: F.concat(F.lit("<reportingOwner><reportingOwnerId><rptOwnerCik>"), k, F.lit(f"</rptOwnerCik></reportingOwnerId><reportingOwnerRelationship><{role}>1</{role}></reportingOwnerRelationship></reportingOwner>"))
    trade = lambda code: F.concat(F.lit("<nonDerivativeTransaction><transactionDate><value>"), iso("ts"), F.lit(f"</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>"), F.col("value").cast("decimal(12,2)").cast("string"), F.lit("</value></transactionShares><transactionPricePerShare><value>2</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>"))
    user = F.col("user_id").cast("string")
    second = F.when(F.col("event_id") % 2 == 0, owner(F.concat(user, F.lit("9")), "isTenPercentOwner")).otherwise("")
    xml = F.concat(F.lit("<ownershipDocument><issuer><issuerCik>"), user, F.lit("</issuerCik><issuerTradingSymbol>T</issuerTradingSymbol></issuer><periodOfReport>2024-01-02</periodOfReport>"), owner(user, "isDirector"), second, F.lit("<nonDerivativeTable>"), trade("P"), trade("S"), F.lit("</nonDerivativeTable></ownershipDocument>"))
    got = feeds.ownership_transactions(e.select(F.col("event_id").cast("string").alias("accession"), xml.alias("xml")))
    return got.select("accession", "role", "buyer", iso("day").alias("day"), F.col("value").cast("double").alias("value"))


def src_universe(spark, d):
    """Symbols of the wanted exchanges and types that traded lately."""
    listed = table(spark, d, "prices_eod_raw").groupBy("ticker", "exchange", F.col("security_type").alias("asset_type")).agg(F.max("date").alias("end_date"))
    got = feeds.listed_universe(listed.where("exchange is not null and asset_type is not null"), exchanges=("NYQ", "NSX"), types=("Stock",), today="2026-01-01", within_days=365)
    return got.select("ticker", "exchange", "asset_type", iso("end_date").alias("end_date"))


def src_generated_bars(spark, d):
    """Generated bars for each of a few horizons: inline rows, a range and a list of items."""
    bars = generators.synthetic_bars(spark, tickers=7, days=40)
    marks = generators.values(spark, [("T000001", "a"), ("T000003", "b")], "ticker string, mark string")
    got = bars.join(F.broadcast(marks), "ticker").join(F.broadcast(generators.each(spark, [1, 5])), F.dayofmonth("date") % F.col("h") == 0)
    return got.groupBy("ticker", "mark", "h").agg(F.count("*").alias("bars"), F.max("volume").alias("volume"))


def snk_publish(spark, d):
    """A partition published twice: the second, larger one takes the place of the first; a smaller one is refused."""
    path, orders = _room(spark), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = merge.publish_partition(spark, orders.where("o_orderkey % 2 = 0"), path)
    second = merge.publish_partition(spark, orders, path)
    try:
        merge.publish_partition(spark, orders.where("o_orderkey % 3 = 0"), path)
        refused = False
    except quality.QualityError:
        refused = True
    kept = spark.read.parquet(path)
    return kept.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers")).withColumns({"first_rows": F.lit(first).cast("bigint"), "second_rows": F.lit(second).cast("bigint"), "smaller_refused": F.lit(refused)})


def snk_review_inserts(spark, d):
    """Review rows into a queue that has some: only keys that it lacks, and none lacking after the write."""
    r = table(spark, d, "entity_review").where("ein is not null").groupBy("ein", "plan_year").agg(F.max("participants").alias("participants"))
    room, keys = _room(spark), ["ein", "plan_year"]
    r.where("plan_year <= 2022").write.parquet(room)
    merge.insert_missing(spark.read.parquet(room), r, keys=keys).write.mode("append").parquet(room)
    queue = spark.read.parquet(room)
    left = merge.missing_after_write(queue, r, keys=keys).agg(F.count("*").alias("still_missing"))
    return queue.groupBy("plan_year").agg(F.count("*").alias("rows"), F.sum("participants").cast("bigint").alias("participants")).crossJoin(F.broadcast(left))


def snk_ordered(spark, d):
    """Orders written in the order of their customers with narrower types, and whether each file holds a range of it."""
    room = _room(spark)
    merge.write_ordered(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), room, order=["o_custkey", "o_orderkey"], types={"o_totalprice": "decimal(12,2)"})
    back = spark.read.parquet(room).withColumn("file", F.input_file_name())
    spans = back.groupBy("file").agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b"), F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    clash = spans.alias("x").join(spans.alias("y"), (F.col("x.file") < F.col("y.file")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))).agg(F.count("*").alias("overlaps"))
    return spans.agg(F.sum("n").alias("rows"), F.sum("total").cast("double").alias("total")).crossJoin(F.broadcast(clash))


def snk_figure_upsert(spark, d):
    """Proxy figures extracted twice: the newer extraction over the older, fields it leaves empty kept."""
    f = table(spark, d, "proxy_figure").where("accession is not null and field is not null")
    pick = lambda fold: f.groupBy("accession", "field").agg(fold(F.struct("extracted_at", "id", "value", "unit")).alias("m")).select("accession", "field", F.col("m.value").alias("value"), F.col("m.unit").alias("unit"))
    stored, staged = pick(F.min), pick(F.max)
    return merge.upsert(stored, staged, keys=["accession", "field"]).groupBy("field").agg(F.count("*").alias("filings"), F.count("value").alias("with_value"), F.count("unit").alias("with_unit"))


def snk_chunks(spark, d):
    """A sweep by year that resumes: chunks that are done are not done again."""
    room, years = _room(spark), table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_totalprice")
    chunks = [str(r["y"]) for r in years.select("y").distinct().orderBy("y").collect()]
    work = lambda y: years.where(F.col("y") == int(y)).groupBy("y").agg(F.count("*").alias("orders")).write.mode("overwrite").parquet(f"{room}/out/{y}")
    ran = len(ChunkLedger(f"{room}/ledger.json", "sweep", spark=spark).run(chunks[:3], work))
    again = len(ChunkLedger(f"{room}/ledger.json", "sweep", spark=spark).run(chunks, work))
    return spark.read.parquet(f"{room}/out/*").select(F.col("y").alias("year"), "orders", F.lit(ran).alias("first_run"), F.lit(again).alias("second_run"))


def chk_contracts(spark, d):
    """What each contract says of the daily bars, by year."""
    bars = table(spark, d, "prices_eod_raw")
    rows = []
    for y in sorted(r["y"] for r in bars.select(F.year("date").alias("y")).distinct().collect()):
        part = bars.where(F.year("date") == y)

        def holds(check) -> bool:
            try:
                check()
                return True
            except quality.QualityError:
                return False

        closed = holds(lambda: quality.assert_closed_year(part, day="date", year=y))
        fresh = holds(lambda: quality.assert_fresh(part, day="date", today=date(y, 12, 31), most_days=5, least_rows=10, required=["close"]))
        rows.append((y, closed, fresh))
    return generators.values(spark, rows, "year int, closed boolean, fresh boolean")


def ord_named(spark, d):
    """Sponsors' rows in a named order (NULLs last), with their places in it (a top-k report)."""
    r = table(spark, d, "entity_review").where("id is not null").select("id", "participants", "plan_year")
    top = sorted_by(r, "largest", {"largest": [("participants", True), ("plan_year", True), ("id", False)]}).limit(50)
    return top.select("id", F.col("participants").cast("double").alias("participants"))


def fn_market_day(spark, d):
    """Events by the market's day."""
    return table(spark, d, "events").groupBy(iso(market_date("ts")).alias("day")).agg(F.count("*").alias("events"))


def stream_first(spark, d):
    """Events that come twice, as a stream into a keyed store: each key once."""
    room = _room(spark)
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    e.write.parquet(f"{room}/in")
    e.where("event_id % 3 = 0").write.mode("append").parquet(f"{room}/in")
    source = polling.file_stream(spark, f"{room}/in", e.schema)
    polling.run_available(polling.first_deliveries(source, at="at", keys=["event_id"], lateness="3650 days"), polling.append_missing(f"{room}/out", ["event_id"]), checkpoint=f"{room}/progress")
    return spark.read.parquet(f"{room}/out").groupBy("event_type").agg(F.count("*").alias("rows"), F.countDistinct("event_id").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        src_catalog_all_years, src_catalog_recent_years, src_catalog_lookup, src_text_table, src_csv_skips_bad_rows, src_index_lines, src_submissions, src_observations, src_ticker_map, src_feed, src_ownership, src_universe, src_generated_bars,
        snk_publish, snk_review_inserts, snk_ordered, snk_figure_upsert, snk_chunks, chk_contracts, ord_named, fn_market_day, stream_first,
    )
}

_CIK = "lpad(ltrim(regexp_replace(cik, '[^0-9]', '', 'g'), '0'), 10, '0')"

ORACLE_SQL = {
    "src_catalog_all_years": "select cast(year(date) as int) as year, count(*) as rows, cast(sum(close) as double) as closes, count(listing_id) as listed from prices_eod_raw group by 1",
    "src_catalog_recent_years": "select ticker, count(*) as rows, strftime(min(date), '%Y-%m-%d') as first_day, strftime(max(date), '%Y-%m-%d') as last_day from prices_eod_raw where year(date) in (2019, 2020) group by 1",
    "src_catalog_lookup": "select 'prices' as dataset, cast(year(date) as varchar) as part, 'ok' as state, true as may_publish from prices_eod_raw group by 2 union all select 'lost', 'all', 'missing', false union all select 'private', 'all', 'skipped', false",
    "src_text_table": with_relations("raw_sub", then="select form, fp, count(*) as filings, count(distinct cik) as filers, min(period) as first_period, max(filed) as last_filed from raw_sub group by all"),
    "src_csv_skips_bad_rows": "select cast(c_custkey as bigint) as c_custkey, concat(c_name, ', x') as c_name, cast(c_nationkey as int) as nation from customer where c_custkey % 10 <> 0",
    "src_index_lines": f"select '8-K' as form, concat('COMPANY ', id, ' INC') as company, ltrim({_CIK}, '0') as cik, strftime(filed_date, '%Y-%m-%d') as filed, concat('edgar/data/', accession, '.txt') as path from deals where id % 2 = 0 and {_CIK} is not null and filed_date is not null",
    "src_submissions": "select cik, accession, '8-K' as form, strftime(filed_date, '%Y-%m-%d') as filed, '1.01' as items from (select *, row_number() over (partition by accession order by id desc) as rn from deals where accession is not null and cik is not null) where rn = 1",
    "src_observations": with_relations("macro", then="select series_id, strftime(obs_date, '%Y-%m-%d') as obs_date, cast(value as double) as value from macro"),
    "src_ticker_map": with_relations("sec_names", then="select lpad(cast(cast(cik as bigint) as varchar), 10, '0') as cik, tickers as ticker, name as title from sec_names where tickers <> ''"),
    "src_feed": "select accession, '8-K' as form, strftime(max(filed_date), '%Y-%m-%d') as updated from deals where filed_date is not null and regexp_full_match(accession, '[0-9]{10}-[0-9]{2}-[0-9]{6}') group by accession",
    "src_ownership": """
with e as (select *, case when event_id % 2 = 0 then 2 else 1 end as owners, cast(value as decimal(12,2)) * 2 as paid from events where event_type = 'purchase' and value > 0)
select cast(event_id as varchar) as accession, 'insider' as role, cast(user_id as varchar) as buyer, strftime(ts, '%Y-%m-%d') as day, round(cast(paid as double) / owners, 2) as value from e
union all select cast(event_id as varchar), 'ten_percent', concat(user_id, '9'), strftime(ts, '%Y-%m-%d'), round(cast(paid as double) / owners, 2) from e where owners = 2""",
    "src_universe": "select ticker, exchange, security_type as asset_type, strftime(max(date), '%Y-%m-%d') as end_date from prices_eod_raw where exchange in ('NYQ', 'NSX') and security_type in ('Stock') and not regexp_matches(ticker, '^(ZTEST|ZVZZT|ZWZZT|ZXZZT|ZJZZT|NTEST|CTEST|PTEST)') group by 1, 2, 3 having date '2026-01-01' - max(date) <= 365",
    "src_generated_bars": """
with b as (select t, d, date '2024-01-01' + cast(d as int) as day, t * 1000 + d as volume from range(7) a(t), range(40) c(d)), m as (select 1 as t, 'a' as mark union all select 3, 'b')
select concat('T', lpad(cast(b.t as varchar), 6, '0')) as ticker, mark, cast(h as int) as h, count(*) as bars, max(volume) as volume from b join m on m.t = b.t cross join (select unnest([1, 5]) as h) x where day(b.day) % h = 0 group by 1, 2, 3""",
    "snk_publish": "select count(*) as rows, count(distinct o_custkey) as customers, count(*) filter (where o_orderkey % 2 = 0) as first_rows, count(*) as second_rows, true as smaller_refused from orders",
    "snk_review_inserts": "select plan_year, count(*) as rows, cast(sum(participants) as bigint) as participants, cast(0 as bigint) as still_missing from (select ein, plan_year, max(participants) as participants from entity_review where ein is not null group by 1, 2) group by 1",
    "snk_ordered": "select count(*) as rows, cast(sum(cast(o_totalprice as decimal(12,2))) as double) as total, cast(0 as bigint) as overlaps from orders",
    "snk_figure_upsert": """
with f as (select * from proxy_figure where accession is not null and field is not null),
old as (select accession, field, value, unit from f qualify row_number() over (partition by accession, field order by extracted_at nulls first, id) = 1),
new as (select accession, field, value, unit from f qualify row_number() over (partition by accession, field order by extracted_at desc nulls last, id desc) = 1)
select n.field, count(*) as filings, count(coalesce(n.value, o.value)) as with_value, count(coalesce(n.unit, o.unit)) as with_unit from new n left join old o on o.accession = n.accession and o.field = n.field group by 1""",
    "snk_chunks": "with y as (select cast(year(o_orderdate) as int) as year, count(*) as orders from orders group by 1) select year, orders, cast(3 as int) as first_run, cast((select count(*) from y) - 3 as int) as second_run from y",
    "chk_contracts": """
select cast(y as int) as year, a <= make_date(y, 1, 8) and b >= make_date(y, 12, 29) as closed, make_date(y, 12, 31) - b <= 5 and n >= 10 as fresh from (select year(date) as y, min(date) as a, max(date) as b, count(*) as n from prices_eod_raw group by 1)""",
    "ord_named": "select id, cast(participants as double) as participants from entity_review order by participants desc nulls last, plan_year desc nulls last, id limit 50",
    "fn_market_day": "select strftime(timezone('America/New_York', timezone('UTC', cast(ts as timestamp))), '%Y-%m-%d') as day, count(*) as events from events group by 1",
    "stream_first": "select event_type, count(distinct event_id) as rows, count(distinct event_id) as events from events group by 1",
}
