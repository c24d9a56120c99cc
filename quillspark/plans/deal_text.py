"""Terms of a deal read from a filing's text: kind of agreement, value, consideration, parties, type.  Native expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (kind of agreement, weight, pattern); a pattern counts once, however often it matches.
PHRASES = (
    ("m_and_a", 3, r"agreement and plan of (?:merger|reorganization)"), ("m_and_a", 3, r"\bmerger agreement\b"), ("m_and_a", 3, r"business combination agreement"), ("m_and_a", 3, r"\barrangement agreement\b"), ("m_and_a", 3, r"(?:stock|share|equity|asset|unit) purchase agreement"),
    ("m_and_a", 3, r"membership interest purchase agreement"), ("m_and_a", 3, r"\bacquisition agreement\b"), ("m_and_a", 1, r"\bagreed to acquire\b|\bto acquire all\b"), ("m_and_a", 1, r"acquisition of (?:all|substantially all)"), ("m_and_a", 1, r"\btender offer\b"), ("m_and_a", 1, r"\bmerger sub\b"),
    ("debt", 3, r"\bcredit agreement\b"), ("debt", 3, r"loan (?:and security )?agreement"), ("debt", 3, r"\bindenture\b"), ("debt", 3, r"note purchase agreement"), ("debt", 3, r"\bcredit facility\b"), ("debt", 3, r"revenue interest financing"), ("debt", 1, r"revolving credit|\bterm loan\b"), ("debt", 1, r"promissory note|convertible note"), ("debt", 1, r"\bforbearance\b"), ("debt", 1, r"exchange agreement"),
    ("securitization", 3, r"asset.backed notes"), ("securitization", 3, r"pooling and servicing agreement"), ("securitization", 3, r"\breceivables\b.{0,40}\btrust\b"), ("securitization", 1, r"\bissuing entity\b|\bcertificateholders?\b"),
    ("equity_raise", 3, r"securities purchase agreement"), ("equity_raise", 3, r"underwriting agreement"), ("equity_raise", 3, r"placement agen(?:cy|t) agreement"), ("equity_raise", 3, r"at.the.market"), ("equity_raise", 3, r"equity (?:line|purchase|distribution) agreement"), ("equity_raise", 1, r"registration rights agreement"), ("equity_raise", 1, r"subscription agreement"), ("equity_raise", 1, r"\bpre-funded warrant"), ("equity_raise", 1, r"standby equity"),
    ("employment", 3, r"employment agreement"), ("employment", 3, r"separation (?:and release )?agreement"), ("employment", 3, r"transition (?:and separation )?agreement"), ("employment", 3, r"consulting agreement"), ("employment", 1, r"\bseverance\b|retention (?:agreement|award|bonus)"), ("employment", 1, r"indemnification agreement"),
    ("commercial", 3, r"supply agreement"), ("commercial", 3, r"licen[cs]e agreement"), ("commercial", 3, r"collaboration agreement"), ("commercial", 3, r"distribution agreement"), ("commercial", 3, r"master services agreement"), ("commercial", 3, r"management services agreement"), ("commercial", 3, r"development agreement"), ("commercial", 3, r"manufacturing agreement"), ("commercial", 1, r"\boff.?take\b|\bjoint venture\b"),
    ("real_estate", 3, r"\blease agreement\b|\bground lease\b|\bthe leases?\b"), ("real_estate", 1, r"purchase and sale agreement"),
    ("governance", 3, r"rights agreement|rights plan"), ("governance", 3, r"cooperation agreement|standstill agreement"), ("settlement", 3, r"settlement agreement"),
)

# Patterns of the fields.
MONEY = r"\$\s?([\d][\d,]*(?:\.\d+)?)\s*(billion|million|thousand|bn|mm|[kmb])?\b"
SCALES = {"thousand": 10**3, "k": 10**3, "million": 10**6, "mm": 10**6, "m": 10**6, "billion": 10**9, "bn": 10**9, "b": 10**9}
PRICE_CONTEXT = r"(?:aggregate|total|purchase price|consideration|enterprise value|equity value|transaction value|base purchase price|valued at|for a price of|in exchange for|acquisition price)"
MARKET_SIZE = r"\b(?:addressable|global|worldwide|total)\s+market\b|\bmarket\s+(?:size|opportunity|is\s+(?:expected|projected|forecast))|\bTAM\b|\bindustry\s+is\s+(?:expected|projected)|\bexpected\s+to\s+reach\b|\bprojected\s+to\s+(?:reach|grow)\b|\bassets\s+under\s+management\b"
DEAL_CUE = r"\bacquisi\w+|\bacquire\w*|\bmerger\b|\bpurchase price\b|\bconsideration\b|\btransaction\b|\bcombination\b"
CASH = r"\bin cash\b|\bcash consideration\b|\ball.cash\b"
STOCK = r"\bshares? of (?:the )?(?:parent|acquir\w+|buyer|company)?\s*common stock\b|\bstock consideration\b|\bexchange ratio\b|\bshare consideration\b"
PROMISED = r"financial statements[^.]{0,140}(?:will be|to be|are to be) filed by amendment|required by Item 9\.01\(a\)|not later than seventy.one|not later than 71 calendar days|Rule 3-05"
FIGURES = r"\b(?:revenue|revenues|EBITDA|net income|annual sales)\b[^.]{0,60}(?:\$|approximately|of about)"
SELLER = r"\bas seller\b|\bagreed to sell\b|\bwill sell\b|\bsold the (?:equity|business)\b|\bdivest\w*\b|\bdisposition of\b"
ACQUIRER = r"\bas (?:buyer|purchaser|acquirer)\b|\bagreed to acquire\b|\bwill acquire\b|\bto acquire all\b|\bthe \"?Acquirer\"?\b|\bthe \"?Buyer\"?\b"
COUNTERPARTY = r"\b(?:with|among|by and among|and|to|from)\s+([A-Z][\w.&'-]*(?:\s+[A-Z][\w.&'-]*){0,6}(?:,?\s+(?:Inc|LLC|L\.L\.C|Ltd|Corp|Corporation|Company|Holdings|L\.P|LP|plc|N\.V|S\.A|GmbH)\.?))"
SHELL = r"\bmerger\s+sub\b|\bacquisition\s+sub\b|\bmerger\s+corp\b|\bsub\s+(?:i{1,3}|\d)\b"
DIVISION = r"\b(?:segment|division|business unit|product line|operating unit)\b|\bits\s+(?:wholly[- ]owned\s+)?subsidiar(?:y|ies)\b|\bcarve[- ]out\b|\bsubstantially all of the assets of (?:its|the)\s+\w+\s+(?:business|segment|division|operations)\b"
WHOLE = r"\beach (?:issued and outstanding )?share[^.]{0,120}(?:converted into|cancelled and converted)\b|\ball of the (?:issued and )?outstanding (?:shares|capital stock|equity)\s+of the Company\b|\bmerged? with and into\b[^.]{0,80}\bthe Company\b|\bwill (?:become|be) a wholly[- ]owned subsidiary of\b"
SHELL_COMPANY = r"business combination agreement|\btrust account\b|\bblank check\b|\bde-SPAC\b|\bsponsor\b.{0,40}\bfounder shares\b"
BLANK_CHECK_SIC = "6770"


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def classify_text(text: Column, phrases: Sequence[tuple[str, int, str]] = PHRASES) -> Column:
    """The kind with the greatest weight of matching patterns; NULL without a match or on a tie."""
    kinds = sorted({b for b, _, _ in phrases})
    score = {b: sum((F.when(_says(text, p), w).otherwise(0) for x, w, p in phrases if x == b), F.lit(0)) for b in kinds}
    best = F.greatest(*score.values())
    ties = sum(((s == best).cast("int") for s in score.values()), F.lit(0))
    return F.when((best > 0) & (ties == 1), F.coalesce(*(F.when(s == best, b) for b, s in score.items())))


def places(text: Column, pattern: str) -> Column:
    """``[(at, m)]``: the matches of a pattern that matches no empty text, with their offsets from 0."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    letters = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(found, lambda m, i: F.struct((letters(F.slice(between, 1, i + 1)) + letters(F.slice(found, 1, i))).alias("at"), m.alias("m")))


def deal_value(text: Column, *, strict: bool = False, floor: int = 10_000, ceiling: int = 500_000_000_000) -> Column:
    """The greatest dollar amount near words of a price (140 characters before it to 60 after its start), in whole dollars; NULL without one.

    Amounts near words of a market's size are none; ``strict`` asks for words of a deal nearby, too.
    """
    pattern = f"(?i){MONEY}"
    number = lambda m: F.replace(F.regexp_extract(m, pattern, 1), F.lit(","), F.lit("")).cast("decimal(28,6)")
    unit = lambda m: F.lower(F.regexp_extract(m, pattern, 2))
    scales = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])

    def amount(x: Column) -> Column:
        near = F.substring(text, F.greatest(x["at"] - 140, F.lit(0)) + 1, x["at"] + 60 - F.greatest(x["at"] - 140, F.lit(0)))
        counts = _says(near, PRICE_CONTEXT) & ~_says(near, MARKET_SIZE)
        if strict:
            counts = counts & _says(near, DEAL_CUE)
        return F.when(counts & (F.length(F.regexp_extract(x["m"], pattern, 1)) <= 26), number(x["m"]) * F.coalesce(scales[unit(x["m"])], F.lit(1)))

    amounts = F.filter(F.transform(places(text, pattern), amount), lambda a: (a >= floor) & (a <= ceiling))
    return F.array_max(amounts).cast("decimal(20,2)")


def consideration(text: Column) -> Column:
    """'mixed', 'cash', 'stock' or 'not_stated'."""
    cash, stock = _says(text, CASH), _says(text, STOCK)
    return F.when(cash & stock, "mixed").when(cash, "cash").when(stock, "stock").otherwise("not_stated")


def target_financials(text: Column) -> Column:
    """Whether figures of the target are promised, given, or neither."""
    return F.when(_says(text, PROMISED), "rule_305_promised").when(_says(text, FIGURES), "figures_in_filing").otherwise("none_disclosed")


def parties(text: Column, company: Column) -> Column:
    """``(role, counterparty, acquirer, target, basis)`` of the filer ``company``.

    The counterparty is the first party named with a legal form that is neither the filer nor a shell made for a merger.
    Buyer and target follow from the filer's role, and stay NULL where that is unclear.
    """
    seller, buyer = _says(text, SELLER), _says(text, ACQUIRER)
    head = lambda c: F.substring(F.lower(c), 1, 12)
    named = F.transform(F.regexp_extract_all(text, F.lit(COUNTERPARTY), F.lit(1)), lambda n: F.trim(n, F.lit(" ,")))
    other = F.get(F.filter(named, lambda n: ~_says(n, SHELL) & F.coalesce(head(n) != head(company), F.lit(True))), 0)
    role = F.when(buyer & ~seller, "acquirer").when(seller & ~buyer, "seller").when(other.isNotNull(), "party").otherwise("not_stated")
    basis = F.when(other.isNull(), "not_parsed").when(role == "party", "counterparty_only").otherwise("derived_from_role")
    acquirer = F.when(role == "acquirer", company).when(role == "seller", other)
    target = F.when(role == "acquirer", other).when(role == "seller", company)
    return F.struct(role.alias("role"), other.alias("counterparty"), acquirer.alias("acquirer"), target.alias("target"), basis.alias("basis"))


def deal_type(text: Column, kind: Column, *, sic: Column | None = None, exhibit: Column | None = None) -> Column:
    """'spac', 'securitization', 'division_sale', 'operating' or 'unclassified'; words of a whole company go before those of a division."""
    deal = F.coalesce(kind == "m_and_a", F.lit(False))
    blank = F.coalesce(sic == BLANK_CHECK_SIC, F.lit(False)) if sic is not None else F.lit(False)
    any_deal = deal | (F.coalesce(exhibit, F.lit(False)) if exhibit is not None else F.lit(False))
    part = _says(text, DIVISION) & ~_says(text, WHOLE)
    return F.when(blank | (deal & _says(text, SHELL_COMPANY)), "spac").when(kind == "securitization", "securitization").when(any_deal & part, "division_sale").when(any_deal, "operating").otherwise("unclassified")


# Words of a name that do not identify, and phrases that say a figure is another's.
NAME_NOISE = ("inc", "corp", "corporation", "company", "co", "llc", "lp", "plc", "ltd", "limited", "holdings", "holding", "group", "the", "and", "of", "new", "sub", "merger", "parent", "acquisition", "technologies", "international", "common", "stock", "shares", "shareholders", "stockholders", "class")
NOT_THE_FILER = r"\bmerger\s*sub\b|\bsub\s*\d\b|\bsurviving\s+(?:corporation|company)\b|\bparent\b|\bacquir(?:er|or)\b|\bbuyer\b|\b(?:\d+(?:th|st|nd|rd)\s+)?percentile\b|\bselected\s+transactions?\b|\bmedian\b|\bother\s+transactions?\b"


def _identity(name: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(NAME_NOISE))))


def attributed(to: Column, filer: Column) -> Column:
    """Whether a figure attributed ``to`` someone is the filer's own: no phrase of another, and the first identifying word of either name stands in the other."""
    mine, theirs = _identity(filer), _identity(to)
    unknown = (F.size(mine) == 0) | (F.size(theirs) == 0)
    agree = F.array_contains(theirs, F.get(mine, 0)) | F.array_contains(mine, F.get(theirs, 0))
    return F.when(F.coalesce(to, F.lit("")) == "", False).when(_says(to, NOT_THE_FILER), False).when(F.coalesce(filer, F.lit("")) == "", True).when(unknown, True).otherwise(agree)


def cites(quote: Column, text: Column) -> Column:
    """Whether a quote stands in a text word for word, but for white space and case; NULL or empty quotes do not."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    return F.coalesce((plain(quote) != "") & F.contains(plain(text), plain(quote)), F.lit(False))
