"""Plans over plan filings: sponsors, resolution, multi-year trend, purchase clusters, promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.exprs import max_by_nn
from quillspark.operators.quality import QualityError

# Words that say nothing about who a company is.
NAME_NOISE = ("inc", "incorporated", "corp", "corporation", "co", "company", "companies", "llc", "llp", "lllp", "lp", "ltd", "limited", "plc", "pc", "pa", "psc", "holdings", "holding", "group", "the", "and", "of", "a", "an")
# Industries whose organisations are mostly not for profit (a guess by sector).
NONPROFIT_NAICS = ("712100", "622000", "611000", "624100", "813000", "624200", "624310", "711100", "621420", "623000", "515100", "621498")


def name_key(name: Column) -> Column:
    """A name in lower case, without punctuation and noise words; native expressions only."""
    text = F.trim(F.regexp_replace(F.lower(F.replace(name, F.lit("&"), F.lit(" and "))), "[^a-z0-9 ]", " "))
    noise = F.array(*map(F.lit, NAME_NOISE))
    return F.array_join(F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~F.array_contains(noise, w)), " ")


def sponsor_rollup(filings: DataFrame, *, nonprofit_naics: Sequence[str] = NONPROFIT_NAICS) -> DataFrame:
    """One row per (plan year, sponsor), over one row per plan.

    Amendments fold into the greatest count of a plan; sponsors carry the sum and the
    greatest over plans (bounds of the headcount) and the counts by plan for later comparison.
    """
    code = F.coalesce(F.col("pension_code").like("%2L%") | F.col("pension_code").like("%2M%"), F.lit(False))
    early = (F.col("plan_eff_date") > F.lit("1900-01-01").cast("date")) & (F.col("plan_eff_date") <= F.make_date(F.col("plan_year") + 1, F.lit(1), F.lit(1)))
    per_plan = filings.where("ein is not null").groupBy("plan_year", "ein", F.coalesce("plan_num", F.lit("?")).alias("plan")).agg(
        F.max(F.coalesce("participants", F.lit(0))).alias("participants"), F.max("active").alias("active"), F.min("sponsor_name").alias("sponsor_name"), F.max("naics").alias("naics"), F.max("state").alias("state"), F.max("dfe_code").alias("dfe_code"), F.max("entity_code").alias("entity_code"),
        F.bool_or(code).alias("has_403b"), F.bool_or(F.col("form") == "short").alias("short"), F.bool_or(F.col("form") == "main").alias("main"), F.min(F.when(early, F.col("plan_eff_date"))).alias("plan_eff"),
    )
    g = per_plan.groupBy("plan_year", "ein").agg(
        F.min("sponsor_name").alias("sponsor_name"), F.max("naics").alias("naics"), F.max("state").alias("state"), F.count("*").alias("plans"), F.sum("participants").cast("bigint").alias("participants_sum"), F.max("participants").alias("participants_max"), F.sum("active").cast("bigint").alias("active_sum"), F.max("active").alias("active_max"),
        F.array_sort(F.collect_list(F.struct("plan", "participants", "active"))).alias("plan_counts"), F.min("plan_eff").alias("oldest_plan_eff"), F.max("dfe_code").alias("dfe_code"), F.coalesce(F.bool_or(F.col("dfe_code").isNotNull()), F.lit(False)).alias("is_dfe"), F.coalesce(F.bool_or(F.col("entity_code") == "1"), F.lit(False)).alias("is_multiemployer"),
        F.coalesce(F.bool_or("has_403b"), F.lit(False)).alias("has_403b"), F.coalesce(F.bool_or("short"), F.lit(False)).alias("files_short_form"), F.coalesce(F.bool_or("main"), F.lit(False)).alias("files_main_form"),
    )
    listed = F.coalesce(F.col("naics").isin(list(nonprofit_naics)), F.lit(False))
    return g.withColumn("nonprofit_basis", F.when(F.col("has_403b") & listed, "both").when(F.col("has_403b"), "plan_type").when(listed, "naics")).drop("has_403b")


def resolve_sponsors(sponsors: DataFrame, names: DataFrame) -> DataFrame:
    """Sponsors with what number, exact name and normalised name each find among the registrants.

    Each lookup is grouped to one row per key first, so no join can fan out.
    """
    keyed = names.withColumn("ekey", F.upper(F.trim("name"))).withColumn("nkey", name_key(F.col("name")))
    by_ein = keyed.where("ein is not null and ein <> ''").groupBy("ein").agg(F.min("cik").alias("ein_cik"), F.max("tickers").alias("ein_tickers"))
    exact = keyed.where("ekey is not null").groupBy("ekey").agg(F.min("cik").alias("exact_cik"), F.count("*").alias("exact_candidates"))
    norm = keyed.where("nkey <> ''").groupBy("nkey").agg(F.min("cik").alias("norm_cik"), F.count("*").alias("norm_candidates"))
    s = sponsors.withColumn("ekey", F.upper(F.trim("sponsor_name"))).withColumn("nkey", F.nullif(name_key(F.col("sponsor_name")), F.lit("")))
    j = s.join(by_ein, "ein", "left").join(exact, "ekey", "left").join(norm, "nkey", "left")
    return j.withColumn("by_ein", F.col("ein_cik").isNotNull()).withColumn("by_ein_listed", F.coalesce("ein_tickers", F.lit("")) != "").withColumn("name_matched", F.col("exact_cik").isNotNull() | F.col("norm_cik").isNotNull()).drop("ekey", "nkey")


def completeness(filings: DataFrame) -> DataFrame:
    """``plan_year, filings, share``: filings of each year against the fullest one."""
    g = filings.groupBy("plan_year").agg(F.count("*").alias("filings"))
    return g.crossJoin(F.broadcast(g.agg(F.max("filings").alias("most")))).select("plan_year", "filings", F.round(F.col("filings") / F.col("most"), 6).alias("share"))


def assert_one_per_year(history: DataFrame) -> DataFrame:
    """``history``, or an error if a sponsor has a year twice."""
    if not history.groupBy("ein", "plan_year").count().where("count > 1").isEmpty():
        raise QualityError("a sponsor has a plan year twice")
    return history


def trend(history: DataFrame, *, newest_complete: int, flat_band: float = 0.05) -> DataFrame:
    """One row per sponsor over its complete years: spans, gaps, and the change over plans filed in both end years.

    Years after ``newest_complete`` only tell whether a sponsor still files.  The end years'
    plan lists meet by plan number, so added and dropped plans are counted and never mistaken for growth.
    Values of the newest year are the newest that are not NULL.
    """
    done = history.where(F.col("plan_year") <= newest_complete)
    newest = lambda c: max_by_nn(F.col(c), F.col("plan_year")).alias(c)
    agg = done.groupBy("ein").agg(
        F.min("sponsor_name").alias("sponsor_name"), newest("naics"), newest("state"), newest("plans"), newest("participants_sum"), newest("active_max"), F.max_by("plan_counts", "plan_year").alias("last_plans"), F.min_by("plan_counts", "plan_year").alias("first_plans"),
        F.min("oldest_plan_eff").alias("oldest_plan_eff"), F.bool_or("is_dfe").alias("is_dfe"), F.bool_or("is_multiemployer").alias("is_multiemployer"), newest("nonprofit_basis"), newest("by_ein"), newest("name_matched"), F.min("plan_year").alias("first_year"), F.max("plan_year").alias("last_year"), F.count("*").alias("years_filed"),
    )
    years = F.broadcast(done.select("plan_year").distinct().agg(F.array_sort(F.collect_set("plan_year")).alias("years")))
    seen = history.groupBy("ein").agg(F.max("plan_year").alias("last_seen_year"))
    counted = lambda c: F.filter(c, lambda x: x["active"].isNotNull())
    plans_of = lambda c: F.transform(counted(c), lambda x: x["plan"])
    common = lambda mine, other: F.filter(counted(F.col(mine)), lambda x: F.array_contains(plans_of(F.col(other)), x["plan"]))
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x["active"])
    t = agg.join(seen, "ein").crossJoin(years).withColumn("cf", common("first_plans", "last_plans")).withColumn("cl", common("last_plans", "first_plans"))
    t = t.withColumn("matched_first", total(F.col("cf"))).withColumn("matched_last", total(F.col("cl"))).withColumn("common_plans", F.size("cf"))
    unknown = (F.col("years_filed") < 2) | (F.col("common_plans") == 0) | (F.col("matched_first") == 0)
    pct = F.when(~unknown, (F.col("matched_last") - F.col("matched_first")).cast("double") / F.nullif(F.col("matched_first"), F.lit(0)))
    t = t.withColumn("pct", pct)
    gaps = F.size(F.filter("years", lambda y: (y >= F.col("first_year")) & (y <= F.col("last_year")))) - F.col("years_filed")
    return t.select(
        "ein", "sponsor_name", "naics", "state", "plans", "participants_sum", "active_max", "oldest_plan_eff", "is_dfe", "is_multiemployer", "nonprofit_basis", "by_ein", "name_matched", "first_year", "last_year", "years_filed", "last_seen_year", "common_plans",
        (F.size("last_plans") - F.size("cl")).alias("plans_added"), (F.size("first_plans") - F.size("cf")).alias("plans_dropped"), "matched_first", "matched_last", gaps.cast("bigint").alias("gap_years"), F.when(F.col("last_seen_year") >= newest_complete, "filing").otherwise("lapsed").alias("status"),
        F.when(F.col("pct").isNull(), "unknown").when(F.col("pct") > flat_band, "growing").when(F.col("pct") < -flat_band, "declining").otherwise("flat").alias("trend"), F.round("pct", 6).alias("pct_change"),
    )


def review_queue(resolved: DataFrame) -> DataFrame:
    """Sponsors that only a name finds, exact ones first, then by number of candidates."""
    q = resolved.where("not by_ein and name_matched").select("plan_year", "ein", "sponsor_name", F.coalesce("exact_cik", "norm_cik").alias("matched_cik"), F.when(F.col("exact_cik").isNotNull(), "exact_name").otherwise("normalized_name").alias("match_basis"), F.coalesce("exact_candidates", "norm_candidates").alias("candidates"), F.least("participants_sum", F.lit(2147483647)).alias("participants"))
    return q.orderBy(F.col("match_basis") != "exact_name", "candidates", "ein", "plan_year")


def target_stages(trended: DataFrame, *, today, least_years: float = 20, active: tuple[int, int] = (20, 1000)):
    """The conditions that narrow sponsors down, in order."""
    age = F.datediff(F.lit(today).cast("date"), "oldest_plan_eff") / 365.25
    yes = lambda c: F.coalesce(c, F.lit(False))
    return [("sponsors", F.lit(True)), ("no registrant", ~yes(F.col("by_ein")) & ~yes(F.col("name_matched"))), ("an employer", ~yes(F.col("is_dfe")) & ~yes(F.col("is_multiemployer"))), ("for profit", F.col("nonprofit_basis").isNull()), ("still files", F.col("status") == "filing"), ("not growing", F.col("trend").isin("flat", "declining")), ("of the size", F.col("active_max").between(*active)), ("old enough", age >= least_years)]


def purchase_clusters(buys: DataFrame, *, window_days: int = 3, least_buyers: int = 2, floors: dict[str, float] | None = None) -> DataFrame:
    """Greedy, non-overlapping clusters of purchases per (issuer, role).

    A window opens at the earliest purchase not yet placed and takes all within
    ``window_days``.  Purchases fold to one row per day first, so a sequence is no longer than the
    days of its issuer; a fold over the sorted days assigns windows (overlap-free, hence sequential), and
    clusters with too few buyers or below the role's floor are left out.
    """
    floors = floors or {"insider": 50_000, "ten_percent": 1_000_000}
    days = buys.where("day is not null").groupBy("issuer", "role", "day").agg(F.collect_set("buyer").alias("buyers"), F.sum("value").alias("value"), F.count("*").alias("n"))
    seq = days.groupBy("issuer", "role").agg(F.array_sort(F.collect_list(F.struct("day", "buyers", "value", "n"))).alias("s"))
    # the fold keeps the current window's start and tags each day with it
    init = F.struct(F.lit(None).cast("date").alias("open"), F.array().cast("array<date>").alias("starts"))

    def step(acc, x):
        fresh = acc["open"].isNull() | (F.datediff(x["day"], acc["open"]) >= window_days)
        start = F.when(fresh, x["day"]).otherwise(acc["open"])
        return F.struct(start.alias("open"), F.concat(acc["starts"], F.array(start)).alias("starts"))

    tagged = seq.withColumn("starts", F.aggregate("s", init, step)["starts"]).select("issuer", "role", F.explode(F.arrays_zip("s", "starts")).alias("z")).select("issuer", "role", F.col("z.starts").alias("first"), F.col("z.s.day").alias("day"), F.col("z.s.buyers").alias("buyers"), F.col("z.s.value").alias("value"), F.col("z.s.n").alias("n"))
    g = tagged.groupBy("issuer", "role", "first").agg(F.max("day").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("buyers")))).alias("buyers"), F.sum("n").alias("buys"), F.sum("value").alias("value"))
    floor = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
    return g.where((F.col("buyers") >= least_buyers) & (F.col("value") >= F.coalesce(floor[F.col("role")], F.lit(0))))


def without_superseded(filings: DataFrame) -> DataFrame:
    """Filings without the originals that an amendment of the same (issuer, owners, period) supersedes.

    ``filings``: ``accession, form, issuer, owners ARRAY<STRING>, period``.
    """
    keyed = filings.withColumn("_owners", F.array_join(F.array_sort(F.array_distinct("owners")), "|"))
    amended = F.bool_or(F.col("form").endswith("/A")).over(Window.partitionBy("issuer", "_owners", "period"))
    return keyed.withColumn("_am", amended).where(F.col("form").endswith("/A") | ~F.col("_am")).drop("_owners", "_am")


def promote(*legs: tuple[str, DataFrame]) -> DataFrame:
    """``cik10, name, reasons ARRAY<STRING>, n_reasons``: entities that any leg (``cik10, name``) names, by key; the name comes from the first leg that has it."""
    tagged = [df.select("cik10", "name", F.lit(reason).alias("reason"), F.lit(no).alias("no")) for no, (reason, df) in enumerate(legs)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.where("cik10 is not null").groupBy("cik10").agg(F.min(F.when(F.col("name").isNotNull(), F.struct("no", "name")))["name"].alias("name"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.countDistinct("reason").alias("n_reasons"))


def gate(promoted: DataFrame, valued: DataFrame) -> DataFrame:
    """Promoted entities with whether they pass (have a value) and, if not, why."""
    v = valued.select(F.col("cik").alias("cik10"), F.col("outcome").alias("_o"))
    return promoted.join(v, "cik10", "left").withColumn("passed", F.coalesce(F.col("_o") == "valued", F.lit(False))).withColumn("reason", F.when(F.col("passed"), F.lit(None)).otherwise(F.coalesce("_o", F.lit("no_figures")))).drop("_o")
