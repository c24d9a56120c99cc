import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.plans import deal_text, entities, filers, market, misc, sponsors
from tests.conftest import rows

BARS = "ticker string, date date, close decimal(18,6), volume bigint, security_type string, exchange string, listing_id date"
ACTIONS = "ticker string, ex_date date, split_factor decimal(18,8), div_cash decimal(18,8)"


def d(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def bars(spark, data):
    return spark.createDataFrame([(t, d(n), Decimal(c) if c is not None else None, v, "Stock", "X", d(li) if li is not None else None) for t, n, c, v, li in data], BARS)


def actions(spark, data=()):
    return spark.createDataFrame([(t, d(n), Decimal(f), Decimal(c)) for t, n, f, c in data], ACTIONS)


def test_move_rules(spark):
    px = bars(spark, [
        ("SUB", 0, "0.0002", 10, 0), ("SUB", 1, "0.0003", 10, 0),  # one tick, below the floor
        ("REV", 0, "1", 10, 0), ("REV", 3, "10", 10, 0),  # a reverse split inside a gap
        ("BAD", 0, "1", 10, 0), ("BAD", 1, "9", 10, 0),  # nothing explains it
        ("DIV", 0, "1", 10, 0), ("DIV", 1, "9", 10, 0),  # a dividend is an action
        ("GAP", 0, "5", 10, 0), ("GAP", 40, "6", 10, 0),
        ("TWO", 0, "5", 10, 0), ("TWO", 1, "50", 10, 1), ("NUL", 0, "5", 10, None), ("NUL", 1, "6", 10, None), ("NUL", 2, None, 10, None),
    ])
    got = {r["ticker"]: r for r in market.moves(px, actions(spark, [("REV", 2, "0.1", "0"), ("DIV", 1, "1", "0.05")])).collect()}
    assert "TWO" not in got  # another listing is another company
    assert (got["SUB"]["tick_move"], got["SUB"]["passes_floor"], got["SUB"]["pct_move"]) == (Decimal("1.000000"), False, Decimal("50.000000"))
    assert got["REV"]["pct_move"] == Decimal("0.000000") and not got["REV"]["action_suspect"]
    assert got["BAD"]["action_suspect"] and not got["DIV"]["action_suspect"] and got["DIV"]["is_ex_div"]
    assert not got["GAP"]["within_gap"] and got["NUL"]["pct_move"] == Decimal("20.000000")


def test_lists_never_mix_signs_and_break_ties(spark):
    px = bars(spark, [(t, n, c, 10, 0) for t, a, b in (("A", "10", "11"), ("B", "10", "11"), ("C", "10", "9"), ("D", "10", "10")) for n, c in ((0, a), (1, b))])
    got = rows(market.top_moves(market.moves(px, actions(spark)), market.MoveRules(top=1)).select("direction", "liquidity", "ticker"))
    assert got == [("gainers", "all", "A"), ("losers", "all", "C")]


def test_event_study(spark):
    px = bars(spark, [("T", n, c, 1, 0) for n, c in ((0, "10"), (1, "11"), (5, "12"), (6, "24"))] + [("SPY", 1, "100", 1, 0), ("SPY", 5, "110", 1, 0)])
    ev = spark.createDataFrame([("e1", "T", d(5)), ("e2", "T", d(0)), ("e3", "T", d(90))], "event_id string, ticker string, event_date date")
    assert rows(market.event_anchors(ev, px).select("event_id", "base_date")) == [("e1", d(1))]
    got = rows(market.forward_returns(ev, px, actions(spark, [("T", 6, "0.5", "0")]), horizons=(1, 2, 9)).select("h", "ret", "excess"))
    assert got == [(1, Decimal("0.090909"), Decimal("-0.009091")), (2, Decimal("0.090909"), None)]
    with pytest.raises(ValueError):
        market.forward_returns(ev, px, actions(spark), horizons=())


def test_spans_and_gaps(spark):
    r = spark.createDataFrame([("T", d(0), d(5)), ("T", d(7), d(9)), ("T", d(1), d(2)), ("T", d(30), d(31))], "k string, a date, b date")
    assert rows(market.merged_spans(r, key="k", start="a", end="b", tolerance=1)) == [("T", d(0), d(9), 3), ("T", d(30), d(31), 1)]
    assert rows(market.series_gaps(bars(spark, [("T", 0, "1", 1, 0), ("T", 31, "1", 1, 0), ("T", 61, "1", 1, 0)]))) == [("T", d(0), d(31), 31)]


def test_resolution_statuses(spark):
    sub = spark.createDataFrame([(f"a{i}", "1", "F", "3000", "10-K", "20231231", "FY", "20240301") for i in range(6)], "adsh string, cik string, name string, sic string, form string, period string, fp string, filed string")
    n = lambda a, tag="Revenues", ddate="20231231", qtrs="4", uom="USD", seg="", value="5": (a, tag, "us-gaap/2023", ddate, qtrs, uom, seg, "", value)
    num = spark.createDataFrame([n("a0", "SalesRevenueNet", value="7"), n("a0"), n("a1", value=""), n("a2", ddate="20221231"), n("a3", seg="S=X"), n("a4", uom="CAD")], "adsh string, tag string, version string, ddate string, qtrs string, uom string, segments string, coreg string, value string")
    pre = spark.createDataFrame([("a5", "2", "3", "IS", "0", "RoyaltyRevenue"), ("a5", "10", "1", "IS", "0", "ResearchExpense"), ("a4", "1", "1", "IS", "1", "X")], "adsh string, report string, line string, stmt string, inpth string, tag string")
    got = rows(filers.resolve_facts(sub, num, pre).where("concept = 'revenue'").select("adsh", "status", "value"))
    assert got == [("a0", "stated", Decimal("5.0000")), ("a1", "absent", None), ("a2", "period_mismatch", None), ("a3", "segment_only", None), ("a4", "not_usd", None), ("a5", "unmapped", None)]


def test_peer_ladder_against_pairs(spark):
    import random

    rnd = random.Random(3)
    companies = [(f"c{i}", rnd.choice([3011, 3012, 3020, 3100]), rnd.randint(1, 60) * 1_000_000) for i in range(60)]
    facts = [(c, c, sic, "operating", concept, Decimal(size * w), "stated", d(0), d(1), c) for c, sic, size in companies for concept, w in (("assets", 1), ("revenue", 2))]
    df = spark.createDataFrame(facts, "cik string, company string, sic int, sic_class string, concept string, value decimal(28,4), status string, period_end date, filed date, adsh string")
    got = {r["cik"]: (r["sic_depth"], r["peers_banded"]) for r in filers.peer_sets(df, least=4).collect()}
    for c, sic, size in companies:
        want = (None, 0)
        for depth in (4, 3, 2):
            n = sum(1 for p, s, z in companies if p != c and s // 10 ** (4 - depth) == sic // 10 ** (4 - depth) and size / 3 <= z <= size * 3)
            if n >= 4:
                want = (depth, n)
                break
        assert got[c] == want, c


def test_peer_sets_without_pairs(spark):
    import random

    import numpy as np

    rnd = random.Random(5)
    sizes = [3**k for k in range(4, 9)] * 6 + [rnd.randint(50, 9000) for _ in range(150)]
    companies = [(f"c{i}", rnd.choice([3011, 3012, 3020, 3100, 4000]), size, rnd.choice([1, 40, size // 2, 3 * size, 3 * size])) for i, size in enumerate(sizes)]
    companies += [(None, 3011, 729, 2000), ("no code", None, 729, 2000), ("no size", 3011, 0, 2000)]
    facts = [(c, c, sic, "operating", concept, Decimal(v), "stated", d(0), d(1), c) for c, sic, size, revenue in companies for concept, v in (("assets", size), ("revenue", revenue))]
    sets = filers.peer_sets(spark.createDataFrame(facts, "cik string, company string, sic int, sic_class string, concept string, value decimal(28,4), status string, period_end date, filed date, adsh string"), material=30, least=8)
    plan = sets._jdf.queryExecution().toString()
    assert "Join" not in plan and "Generate" not in plan  # pairs grow as the square of an industry
    got = {r["cik"]: r for r in sets.collect()}
    assert len(got) == len(companies)
    for c, sic, size, revenue in companies:
        want = (None, 0, 0, None, None)
        for depth in (4, 3, 2) if c and sic and size else ():
            peers = [(z, r) for p, s, z, r in companies if p and p != c and s and s // 10 ** (4 - depth) == sic // 10 ** (4 - depth) and z and size / 3 <= z <= size * 3]
            turnovers = [r / z for z, r in peers if r > 30]
            if len(turnovers) >= 8:
                q1, q2, q3 = np.percentile(turnovers, [25, 50, 75])
                want = (depth, len(peers), len(turnovers), pytest.approx(q2, abs=2e-6), pytest.approx(q3 - q1, abs=2e-6))
                break
        r = got[c]
        assert (r["sic_depth"], r["peers_banded"], r["peers_material"], r["turnover_median"], r["turnover_iqr"]) == want, c


def test_band_ladder_against_all_pairs():
    import numpy as np

    from quillspark.operators.bands import banded_ladder

    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 40, 257):
        code, size, material = rng.integers(2000, 2004, n), rng.choice([1.0, 3.0, 9.0, 27.0, 81.0, 10.0], n), rng.random(n) < 0.7
        value = np.where(material, rng.integers(0, 5, n).astype(float), np.nan)
        step, banded, count, found = banded_ladder(code, size, value, material, band=3.0, least=3, divisors=(1, 10), shares=(0.25, 0.5, 0.75))
        for i in range(n):
            want = (-1, 0, 0)
            for k, divisor in enumerate((1, 10)):
                near = (code // divisor == code[i] // divisor) & (size >= size[i] / 3) & (size <= size[i] * 3) & (np.arange(n) != i)
                if (near & material).sum() >= 3:
                    want = (k, near.sum(), (near & material).sum())
                    assert np.allclose(found[:, i], np.quantile(value[near & material], [0.25, 0.5, 0.75]), rtol=0, atol=1e-12)
                    break
            assert (step[i], banded[i], count[i]) == want
            assert want[0] >= 0 or np.isnan(found[:, i]).all()


def test_latest_figures_in_one_fold(spark, data):
    from quillspark.plans.adapters import RELATIONS, relation
    from quillspark.sources.tables import table

    f = lambda cik, concept, value, status, end, filed, adsh, company="N": (cik, company, 1, "operating", concept, value, status, end, filed, adsh)
    facts = [f("1", "revenue", Decimal(5), "stated", d(0), d(1), "a"), f("1", "revenue", Decimal(7), "stated", d(0), d(2), "b"), f("1", "assets", Decimal(9), "stated", d(0), d(1), "a"), f("1", "assets", None, "absent", d(9), d(9), "c"), f("1", "other", Decimal(1), "stated", d(10), None, "d", "New"), f("2", "capex", Decimal(3), "stated", None, d(5), "e")]
    got = filers.latest_figures(spark.createDataFrame(facts, "cik string, company string, sic int, sic_class string, concept string, value decimal(28,4), status string, period_end date, filed date, adsh string"))
    assert [(r["cik"], r["company"], r["period_end"], r["revenue"], r["assets"], r["capex"]) for r in got.orderBy("cik").collect()] == [("1", "New", d(10), Decimal(7), None, None), ("2", "N", None, None, None, Decimal(3))]
    built, said = relation(spark, data, "facts_long"), spark.sql(RELATIONS["facts_long"], orders=table(spark, data, "orders"), customer=table(spark, data, "customer"))
    assert built.dtypes == said.dtypes and built.exceptAll(said).isEmpty() and said.exceptAll(built).isEmpty()
    plan = filers.latest_figures(built)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Window" not in plan  # orders and customers, no rows of concepts


def test_clusters_are_greedy_and_apart(spark):
    buys = [("i", "insider", b, d(n), Decimal(60_000)) for b, n in (("a", 0), ("b", 2), ("a", 3), ("a", 4), ("c", 9), ("d", 10), ("d", 10))]
    got = rows(sponsors.purchase_clusters(spark.createDataFrame(buys, "issuer string, role string, buyer string, day date, value decimal(18,2)")).select("first", "last", "buyers", "buys"))
    assert got == [(d(0), d(2), 2, 2), (d(9), d(10), 2, 3)]


def test_trend_compares_only_matched_plans(spark):
    f = lambda y, plan, active: (y, "E", "N", plan, active, active, None, None, None, None, None, "main", None)
    filings = spark.createDataFrame([f(2022, "1", 100), f(2022, "2", 900), f(2024, "1", 103), f(2025, "1", 500)], "plan_year int, ein string, sponsor_name string, plan_num string, participants int, active int, naics string, state string, dfe_code string, entity_code string, pension_code string, form string, plan_eff_date date")
    history = sponsors.resolve_sponsors(sponsors.sponsor_rollup(filings), spark.createDataFrame([], "cik string, ein string, name string, tickers string"))
    r = sponsors.trend(sponsors.assert_one_per_year(history), newest_complete=2024).first()
    assert (r["trend"], r["matched_first"], r["matched_last"], r["plans_dropped"], r["status"], r["gap_years"]) == ("flat", 100, 103, 1, "filing", 0)
    with pytest.raises(RuntimeError):
        sponsors.assert_one_per_year(history.unionByName(history))


def test_superseded_and_promoted(spark):
    f = spark.createDataFrame([("1", "4", "i", ["a", "b"], 1), ("2", "4/A", "i", ["b", "a"], 1), ("3", "4", "i", ["a"], 1)], "accession string, form string, issuer string, owners array<string>, period int")
    assert rows(sponsors.without_superseded(f).select("accession")) == [("2",), ("3",)]
    leg = lambda *r: spark.createDataFrame(list(r), "cik10 string, name string")
    assert rows(sponsors.promote(("deal", leg(("1", None), ("2", "B"))), ("form4", leg(("1", "A"), ("2", "C"), (None, "D"))))) == [("1", "A", "deal,form4", 2), ("2", "B", "deal,form4", 2)]


def test_text_rules(spark):
    one = spark.createDataFrame([("<p>a &lt;b&gt; &amp; c</p><script>x</script>", "paid $5 million, then $2.5 bn and $7", "merger agreement; merger agreement; notes due")], "h string, m string, t string")
    r = one.select(misc.visible_text(F.col("h")).alias("v"), misc.largest_amount(F.col("m")).alias("a"), deal_text.classify_text(F.col("t")).alias("c"), deal_text.classify_text(F.lit("merger agreement and credit facility")).alias("tie")).first()
    assert tuple(r) == ("a <b> & c", 2_500_000_000, "m_and_a", None)
    assert rows(one.select(sponsors.name_key(F.lit("The Acme & Sons Holdings, Inc.")).alias("k"))) == [("acme sons",)]


def test_symbols_and_orders(spark):
    from quillspark.operators.ordering import sorted_by

    df = spark.createDataFrame([('<ix name="dei:TradingSymbol" id="x"><span>ACME</span></ix> (NYSE: OTHER)',), ("Acme (Nasdaq: ABC)",), ("none",)], "h string")
    assert rows(df.select(misc.trading_symbol(F.col("h")).alias("s")).select("s.symbol", "s.route")) == [("ABC", "prose"), ("ACME", "tag"), (None, None)]
    x = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, v int")
    assert [r["id"] for r in sorted_by(x, "v", {"v": [("v", True)]}).collect()] == [3, 2, 1]
    with pytest.raises(ValueError):
        sorted_by(x, "drop table", {"v": [("v", True)]})


def test_section_window(spark):
    figures = "at $1,000.50 or 12 % or 0.6303. "
    intro = "Projections\n" + "x" * 500  # a heading without figures near it
    body = "a" * 390 + " Projections " + figures * 2 + "The Forecasts " + figures
    docs = [intro + body, "é😀 Forecasts: $1, 5%, 1.25", "Forecasts 5% 6%", figures, None, "y" * 398 + " Forecasts $1 2% 3.25" + "z" * 9000 + "Forecasts $1 2% 3.25 4%"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(docs)], "i int, text string")
    got = {r["i"]: r["w"] and tuple(r["w"]) for r in df.select("i", misc.section_window(F.col("text"), ("Projections", "The\\s+Forecasts|Forecasts")).alias("w")).collect()}
    at = docs[0].index("Projections", 5)
    assert got == {0: (0, len(docs[0]), "Projections", 9, 2), 1: (3, len(docs[1]), "Forecasts", 3, 1), 2: None, 3: None, 4: None, 5: (docs[5].rindex("Forecasts"), len(docs[5]), "Forecasts", 4, 2)}
    near = df.where("i = 0").select(misc.section_window(F.col("text"), ("Projections",), size=300).alias("w")).first()["w"]
    assert tuple(near) == (at, len(docs[0]), "Projections", 9, 2)  # the dense passage lies across blocks of 400


def test_bare_names(spark):
    names = {"The Coca-Cola Company": "coca cola", "Berkshire Hathaway Inc.": "berkshire hathaway", "Acme Holdings, LLC": "acme", "Holdings Inc": "holdings", "Nestlé S.A. Class A": "nestle s a", "A & B Co": "a and b", "": "", "Société Générale SA": "societe generale"}
    df = spark.createDataFrame([*names.items(), (None, None)], "n string, want string")
    assert df.where(~entities.bare_name(F.col("n")).eqNullSafe(F.col("want"))).select("n", entities.bare_name(F.col("n"))).collect() == []


def test_symbol_gaps(spark):
    wanted = spark.createDataFrame([("BRK-B", "NYSE"), ("AAC-U", "NYSE"), ("ABCDW", "NASDAQ"), ("ZZZ", "PINK"), ("ABCDF", "X"), ("QQQ", None), ("AAA", "NYSE"), (None, "X")], "ticker string, exchange string")
    known = spark.createDataFrame([("BRK.B",), ("AAC",), ("ABCD",), ("AAA",), (None,)], "ticker string")
    assert rows(entities.symbol_gaps(wanted, known)) == [("AAC-U", "parent"), ("ABCDF", "foreign"), ("ABCDW", "parent"), ("BRK-B", "spelling"), ("QQQ", "unknown"), ("ZZZ", "otc")]


def test_fund_like(spark):
    data = [(["Alpha Capital LLC", "Beta Fund"], "ABCDX", "Gamma Inc"), (["Alpha Capital LLC"], None, "Gamma Trust"), (["Alpha Capital LLC", "Jane Doe"], None, "Gamma Trust"), (["Alpha LLC"], "ABC", "Gamma Inc"), ([], None, "Gamma Trust")]
    df = spark.createDataFrame(data, "b array<string>, s string, i string")
    assert [r[0] for r in df.select(entities.fund_like(F.col("b"), F.col("s"), F.col("i"))).collect()] == ["all buyers are entities; fund ticker", "all buyers are entities; no listed equity, fund in issuer name", None, None, None]


def test_promotion_of_a_day(spark):
    day = dt.date(2026, 1, 8)
    listed = spark.createDataFrame([("AA", "stock", 5.0), ("AAW", "stock", -50.0), ("EF", "etf", 90.0), ("LOST", "stock", 1.0)], "ticker string, security_type string, pct_move double")
    symbols = spark.createDataFrame([("AA", "7", "Alpha", day), ("AAW", "0000000007", "Alpha Inc", day), ("AA", "9", "Old", dt.date(2020, 1, 1))], "ticker string, cik string, company string, last_seen date")
    deals = spark.createDataFrame([("7", "Alpha Filing", day, "operating"), ("8", "", day, "division_sale"), ("9", "Nine", day, "spac"), ("10", "Ten", dt.date(2026, 1, 7), "operating")], "cik string, company string, filed_date date, deal_type string")
    at = lambda d, h: dt.datetime(2026, 1, d, h, tzinfo=dt.timezone.utc)
    clusters = spark.createDataFrame([("cluster:7:insider:2026-01-02", at(2, 0)), ("cluster:11:insider:2026-01-01", at(1, 23)), ("cluster:12:ten_percent:2026-01-08", at(8, 23)), ("odd", at(8, 1))], "key string, at timestamp")
    got = [tuple(r) for r in entities.promote_day(day, listed, symbols, deals, clusters).collect()]
    assert got == [("0000000007", "Alpha", "AAW", "AA,AAW", "volatility,deal_filing,form4_cluster", 3), ("0000000008", "0000000008", None, "", "deal_filing", 1), ("0000000012", "0000000012", None, "", "form4_cluster", 1)]
    with pytest.raises(entities.PromotionError):
        entities.promote_day(day, listed, symbols.limit(0), deals, clusters)
