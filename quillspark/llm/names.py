"""Variant spellings of organisations' names, linked by exact radius joins in metric cells."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import checkpointed

# Public vocabulary of organisations' names, each word with its usual short forms.
LINES = {
    "accounting": "acctg", "advertising": "advtg", "aerospace": "aero", "agriculture": "agri", "airlines": "airline", "apparel": "", "architects": "archts", "automotive": "auto", "aviation": "aviat avn", "bakery": "bakeries", "bank": "bancorp bankshares", "beverages": "beverage bev", "biosciences": "bioscience", "biotechnology": "biotech",
    "bottling": "", "brewing": "brew", "broadcasting": "brdcstg", "cable": "", "chemical": "chem chemicals", "clothing": "", "coal": "", "communications": "communication comm comms", "computers": "computer", "concrete": "", "construction": "const constr", "consulting": "conslt", "controls": "", "dairy": "", "defense": "", "dental": "dent", "devices": "", "diagnostics": "",
    "distributing": "distr distributors", "electric": "elec", "electronics": "electr", "energy": "", "engineering": "eng engrg", "entertainment": "entmt", "environmental": "environ", "equipment": "equip", "farms": "", "financial": "finl", "fisheries": "", "foods": "food", "freight": "", "furniture": "furn", "gas": "", "glass": "", "graphics": "", "hardware": "hdwe", "health": "hlth healthcare",
    "heating": "htg", "homes": "", "hotels": "hotel", "instruments": "instr", "insurance": "ins", "jewelry": "", "laboratories": "labs laboratory", "landscaping": "", "leasing": "", "logistics": "logist lgstcs", "lumber": "lbr", "machinery": "mach", "manufacturing": "mfg manuf", "marine": "", "marketing": "mktg", "media": "", "metals": "metal", "mining": "", "mortgage": "mtg", "motors": "motor", "networks": "network", "nursing": "",
    "oil": "", "optical": "opt", "orchards": "", "packaging": "pkg pkgg", "paper": "", "petroleum": "pet petrol", "pharmaceuticals": "pharm pharma", "plastics": "plastic", "plumbing": "plbg", "power": "pwr", "printing": "prtg", "properties": "props", "publishing": "pub publ", "railroad": "rr", "realty": "rlty", "restaurants": "restaurant", "roofing": "", "rubber": "", "securities": "secs", "security": "", "semiconductor": "semi semicond semiconductors",
    "shipping": "", "software": "softw", "staffing": "", "steel": "", "stores": "", "supply": "", "telecommunications": "telecom telecomm", "textiles": "text", "therapeutics": "", "tobacco": "", "tools": "tool", "toys": "", "transportation": "transp trans", "trucking": "trkg", "utilities": "util", "veterinary": "vet", "warehousing": "whse", "waste": "", "water": "", "wireless": "",
}
TRADES = {"bricklayers": "", "carpenters": "carp", "drivers": "", "electricians": "", "firefighters": "", "ironworkers": "", "laborers": "", "machinists": "", "musicians": "", "nurses": "", "painters": "", "pipefitters": "", "plumbers": "", "police": "", "roofers": "", "teachers": "tchrs", "teamsters": "", "workers": "wkrs"}
KINDS = {"academy": "acad", "church": "", "clinic": "", "college": "coll", "hospital": "hosp", "institute": "inst", "library": "", "medical": "med", "museum": "", "school": "sch", "seminary": "", "university": "univ"}
FAMILY = {"sons": "", "daughters": "", "associates": "assoc assocs"}
TAGS = {"brothers": "bros", "services": "svc svcs service", "group": "grp", "holdings": "hldg hldgs holding", "international": "intl internatl int", "national": "natl nat", "saint": "st", "district": "dist", "center": "ctr", "local": "lcl loc", "company": "co", "corporation": "corp", "incorporated": "inc", "limited": "ltd", "llc": "", "subsidiaries": "subs", "affiliates": "", "benefits": "", "dept": "department", "and": "", "the": "", "of": "", "us": "usa"}
GIVEN = {
    "alexander": "alex sandy", "andrew": "andy", "anthony": "tony", "barbara": "barb", "benjamin": "ben", "charles": "chas charlie chuck", "christopher": "chris", "daniel": "dan danny", "david": "dave", "deborah": "deb debbie", "donald": "don", "dorothy": "dot dottie", "edward": "ed ned eddie", "elizabeth": "liz beth betty", "frances": "fran fanny", "frederick": "fred", "george": "geo", "gerald": "jerry gerry", "henry": "hank",
    "james": "jim jimmy jas", "john": "jack johnny", "joseph": "joe jos", "katherine": "kate kathy katie", "kenneth": "ken", "lawrence": "larry", "margaret": "maggie peggy meg", "matthew": "matt", "michael": "mike", "nicholas": "nick", "patricia": "pat patty", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob robt", "ronald": "ron", "samuel": "sam", "stephen": "steve steven", "susan": "sue",
    "theodore": "ted theo", "thomas": "tom thos", "timothy": "tim", "walter": "walt", "william": "bill will wm",
}
#: What may tell two organisations of a like name apart: legal forms and the words that go with them.
FORMS = {"brothers", "services", "group", "holdings", "international", "national", "company", "corporation", "incorporated", "limited", "llc"}
_GROUPS = (("line", LINES), ("trade", TRADES), ("kind", KINDS), ("family", FAMILY), ("tag", TAGS), ("given", GIVEN))
#: The default vocabulary: typed word -> (role, word in full).
WORDS = {w: (role, full) for role, table in _GROUPS for full, short in table.items() for w in (full, *short.split())}


def damerau(a: str, b: str, most: int) -> int:
    """Unrestricted Damerau-Levenshtein distance (a true metric); most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match = 0
        low = big
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            d[i + 1][j + 1] = v = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
            low = min(low, v)
        seen[x] = i
        if low > most + 1:
            return most + 1
    return min(d[-1][-1], most + 1)


def core_distance(a: tuple[str, str | None], b: tuple[str, str | None], most: int) -> int:
    """Distance of two cores (first word, second word or None); most + 1 if it is larger.

    Two pairs of words: the least sum of the words' distances, in either order.
    A run-together core against a pair: the same, for the best place at which the space may have
    stood.  Two run-together cores: the distance of the texts.
    """
    if a[1] is None and b[1] is None:
        return damerau(a[0], b[0], most)
    if a[1] is not None and b[1] is None:
        a, b = b, a
    best = most + 1
    for v, w in (b, b[::-1]):
        if a[1] is not None:
            splits = [a]
        else:
            splits = [(a[0][:h], a[0][h:]) for h in range(max(0, len(v) - most), min(len(a[0]), len(v) + most) + 1)]
        for x, y in splits:
            d = damerau(x, v, best - 1) if best else 0
            if d < best:
                best = min(best, d + damerau(y, w, best - 1 - d))
    return best


def _shorter(word: str, n: int) -> set[str]:
    """``word`` with at most ``n`` letters left out."""
    return {"".join(ch for i, ch in enumerate(word) if i not in gone) for k in range(n + 1) for gone in map(set, combinations(range(len(word)), k))}


_CAMEL = re.compile(r"(?<=[a-z]{2}[a-z])(?=[A-Z][a-z]{2})")
_CAMEL_INITIAL = re.compile(r"(?<=[a-z]{3})(?=[A-Z](?:\.|\b))")
_LLC = re.compile(r"\bl\.? ?l\.? ?c\b\.?")


@dataclass
class NameReader:
    """Reads names with a vocabulary: the public default, or a caller's, and words learned from the names."""

    words: Mapping[str, tuple[str, str]] = field(default_factory=lambda: WORDS)

    def __post_init__(self) -> None:
        self._by_part: dict[str, set[str]] = defaultdict(set)
        for w in self.words:
            for part in _shorter(w, self._slack(w)) if len(w) >= 4 else ():
                self._by_part[part].add(w)
        self._near = lru_cache(maxsize=200_000)(self._nearest)

    @staticmethod
    def _slack(word: str) -> int:
        """Edits that a word of the vocabulary may have."""
        return (2 if len(word) >= 8 else 1) if len(word) <= 20 else 0

    def _nearest(self, token: str) -> tuple[int, str, str] | None:
        """The nearest word of the vocabulary to a mistyped token: (distance, role, word in full)."""
        if not 3 <= len(token) <= 24:
            return None
        best = None
        for word in sorted({w for part in _shorter(token, 2) for w in self._by_part.get(part, ())}):
            role, full = self.words[word]
            most = self._slack(word)
            if (d := damerau(token, word, most)) <= most and (best is None or (d, full) < best[::2]):
                best = (d, role, full)
        return best

    def read(self, name: str) -> tuple[str, list[str], str, str, bool]:
        """(class, core words, initial, form, glued) of a name as typed.

        The class holds what tells organisations apart exactly: lines of business,
        trade and local number, kind of institution, or founder's first name and
        kind of kin.  The core words are what is left in typed order; a second
        word typed as one letter is the initial.  The form is the legal form with
        the words that go with it, in full and sorted.  ``glued`` marks a single word of a
        company that may hold an initial at its end.
        """
        text = unicodedata.normalize("NFKD", name)
        text = "".join(ch for ch in text if not unicodedata.combining(ch))
        text = _CAMEL_INITIAL.sub(" ", _CAMEL.sub(" ", text))
        text = _LLC.sub(" llc ", re.sub(r"\([^)]*\)", " ", text.lower()).replace("'", "").replace("’", ""))
        text = re.sub(r"[&+]", " and ", text)
        tokens = re.findall(r"[^\W_]+", text)
        roles: list[tuple[str, str] | None] = [self.words.get(t) for t in tokens]
        number = next((t.lstrip("0") for t in tokens if t.isdigit()), "")
        unknown = [i for i, r in enumerate(roles) if r is None and not tokens[i].isdigit()]

        def have(role: str) -> str:
            return next((r[1] for r in roles if r and r[0] == role), "")

        def settled() -> bool:
            return bool(have("line") or (have("trade") and number) or have("kind") or (have("family") and have("given")))

        while unknown and (len(unknown) > 2 or not settled()):
            near = [(n[0], i, n) for i in unknown if len(tokens[i]) > 1 and (n := self._near(tokens[i]))]
            if not near:
                break
            _, i, n = min(near)
            roles[i] = (n[1], n[2])
            unknown.remove(i)
        core = [tokens[i] for i in unknown]
        if have("family"):
            cls = f"F|{have('family')}|{have('given')}"
        elif have("trade") or have("tag") == "local" or (number and not have("line")):
            cls = f"L|{have('trade')}|{number}"
        elif have("kind") and not have("line"):
            cls = f"K|{have('kind')}"
        else:
            cls = "C|" + "+".join(sorted({r[1] for r in roles if r and r[0] == "line"}))
        if cls[0] != "F":  # a first name tells founders apart; elsewhere it is a word like others
            core = [roles[i][1] if roles[i] and roles[i][0] == "given" else tokens[i] for i in range(len(tokens)) if i in unknown or (roles[i] and roles[i][0] == "given")]
        if not core:  # a name made of words of the vocabulary only stands for itself
            return "W|" + "".join(sorted(tokens)), ["".join(tokens)], "", "", False
        form = " ".join(sorted({r[1] for r in roles if r and r[1] in FORMS}))
        initials = [t for t in core if len(t) == 1]
        words = [t for t in core if len(t) > 1]
        if initials and len(words) == 1:
            return cls, words, initials[0], form, False
        words = words or ["".join(core)]
        return cls, words if len(words) <= 2 else [words[0], "".join(words[1:])], "", form, cls[0] == "C" and len(words) == 1 and 4 <= len(words[0]) <= 12


def parse_name(name: str) -> tuple[str, list[str], str]:
    """(class, core words, initial) of a name as typed, by the default vocabulary."""
    return NameReader().read(name)[:3]


def learn_words(names: DataFrame, words: Mapping[str, tuple[str, str]] = WORDS, *, name: str = "name", least_share: float = 0.001, least_count: int = 50, least_initials: int = 8, most_of_one: float = 0.3) -> dict[str, tuple[str, str]]:
    """``words`` and the lines of business that the names themselves show.

    A line of business stands in many names beside ever other words: a word that the
    vocabulary lacks is one if at least ``least_share`` of all distinct names (and
    ``least_count``) hold it and the other unknown words beside it have at least
    ``least_initials`` first letters, none of which has more than ``most_of_one`` of them; so a single
    organisation of many spellings teaches nothing.  A learned word of three letters or more with which
    exactly one full word begins is short for that.  Counts all names; a share of at least
    ``least_share`` leaves at most a few words per ``1 / least_share`` names, so the
    collected list does not grow with the data.
    """
    known = names.sparkSession.createDataFrame([(w,) for w in sorted(words)], "t string")
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(name)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    each = names.select(F.filter(tokens, lambda t: F.length(t).between(3, 40) & ~t.rlike(r"^\d")).alias("ts"))
    df = each.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    least = max(least_count, names.count() * least_share)
    often = df.where(F.col("n") >= least).join(F.broadcast(known), "t", "left_anti").select("t")
    frequent = [r["t"] for r in often.collect()]
    if not frequent:
        return dict(words)
    other = F.array_except("ts", F.array(*map(F.lit, sorted({*words, *frequent}))))
    beside = each.select(F.explode(F.array_intersect("ts", F.array(*map(F.lit, frequent)))).alias("t"), other.alias("o")).select("t", F.explode("o").alias("o"))
    letters = beside.groupBy("t", F.substring("o", 1, 1).alias("c")).agg(F.count("*").alias("n")).groupBy("t").agg(F.count("*").alias("initials"), F.max("n").alias("top"), F.sum("n").alias("n"))
    learned = sorted(r["t"] for r in letters.where((F.col("initials") >= least_initials) & (F.col("top") <= most_of_one * F.col("n"))).collect())
    out = dict(words)
    whole = {full: role for role, full in words.values()} | {t: "line" for t in learned}
    for t in learned:
        longer = [w for w in whole if w != t and w.startswith(t)]
        out[t] = (whole[longer[0]], longer[0]) if len(longer) == 1 else ("line", t)
    return out


def _parsed(names: DataFrame, words: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``name, cls, w1, w2, initial, form, glued`` of distinct names."""
    cache: list[NameReader] = []

    def parse(s: pd.Series) -> pd.DataFrame:
        if not cache:
            cache.append(NameReader(words))
        got = [cache[0].read(x) for x in s]
        return pd.DataFrame({"cls": [g[0] for g in got], "w1": [g[1][0] for g in got], "w2": [g[1][1] if len(g[1]) > 1 else None for g in got], "initial": [g[2] for g in got], "form": [g[3] for g in got], "glued": [g[4] for g in got]})

    udf = F.pandas_udf(parse, "cls string, w1 string, w2 string, initial string, form string, glued boolean")
    return names.withColumn("p", udf("name")).select("name", "p.*")


def _large(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join: sizes estimated of repetitive keys are too small to let them decide on a broadcast."""
    return df.hint("merge")


#: Letters of a long word that stand for it in cells.
_HEAD = 20


def _pivots(word: Column) -> Column:
    """The pivots within one deletion of a word: itself and each text with one letter left out."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def _labels(word: Column) -> Column:
    """What stands for a word in cells: itself; of a long word its first 19 to 21 letters, for an edit may move the end of its head."""
    heads = F.transform(F.array(*(F.lit(n) for n in (_HEAD - 1, _HEAD, _HEAD + 1))), lambda n: F.substring(word, F.lit(1), n))
    return F.when(F.length(word) <= _HEAD + 1, F.array(word)).otherwise(heads)


def near_words(words: DataFrame) -> DataFrame:
    """``va < vb``: ids of the words of one class (``vid, cls, word``) that stand in a common cell.

    The pivots of a class are the texts that one deletion of a letter reaches; a word
    is assigned to its own pivots, and so replicated over every cell whose pivot is within one
    deletion of it.  Two words one edit apart share a pivot, so none of these pairs is
    missed; some pairs two edits apart come along.  A cell holds distinct words
    only, no more than one letter put into its pivot makes, whatever the size of the data.
    """
    cells = words.select("vid", "cls", F.explode(_labels(F.col("word"))).alias("label")).select(F.explode(F.transform(_pivots(F.col("label")), lambda p: F.xxhash64("cls", p))).alias("cell"), "vid")
    a, b = cells, _large(cells.select("cell", F.col("vid").alias("vb")))
    return a.join(b, "cell").where("vid < vb").select(F.col("vid").alias("va"), "vb").distinct()


def _word_id(word: Column | str) -> Column:
    return F.xxhash64("cls", word)


def _cuts(lengths: set[int], whole: set[int]) -> list[int]:
    """Lengths of beginnings and ends by which run-together cores are found: those of words, and half of a core's, each give or take an edit."""
    return sorted({n + d for n in lengths for d in (-1, 0, 1)} | {n // 2 + d for n in whole for d in (-2, -1, 0, 1)})


def core_parts(cores: DataFrame) -> DataFrame:
    """``id, cls, w1, w2, part, rest, vid`` of ``cores`` (``id, cls, w1, w2``): each word with the other one.

    A run-together core has its beginnings and ends of the lengths that other cores' words (or halves) may have there.
    The lengths that occur are collected: they are few whatever the size of the data.
    """
    w1, w2 = F.col("w1"), F.col("w2")
    one = lambda pair, w: F.struct(F.lit(pair).alias("pair"), F.length(w).alias("n"))
    met = cores.select(F.explode(F.when(w2.isNotNull(), F.array(one(True, w1), one(True, w2))).otherwise(F.array(one(False, w1)))).alias("m")).select("m.*").distinct().collect()
    cuts = F.array(*map(F.lit, _cuts({r["n"] for r in met if r["pair"]}, {r["n"] for r in met if not r["pair"]}) or [0]))
    piece = lambda part, rest: F.struct(part.alias("part"), rest.alias("rest"))
    after = lambda n: F.substring(w1, n + 1, F.length(w1))
    ends = F.flatten(F.transform(F.filter(cuts, lambda n: (n >= 0) & (n <= F.length(w1))), lambda n: F.array(piece(F.substring(w1, F.lit(1), n), after(n)), piece(after(F.length(w1) - n), F.substring(w1, F.lit(1), F.length(w1) - n)))))
    split = F.when(w2.isNotNull(), F.array(piece(w1, w2), piece(w2, w1))).otherwise(F.array_distinct(F.concat(F.array(piece(w1, F.lit(""))), ends)))
    return cores.select("id", "cls", "w1", "w2", F.explode(split).alias("p")).select("id", "cls", "w1", "w2", "p.part", "p.rest").withColumn("vid", _word_id("part"))


def _allowed(letters: Column, radius: int) -> Column:
    return F.least(F.lit(radius), F.floor(letters / 3).cast("int"))


def _linked(met: DataFrame, radius: int) -> DataFrame:
    """``a, b`` of the rows (``a, a1, a2, b, b1, b2``) whose cores lie within the radius; native where Levenshtein's distance decides."""
    none, far = F.lit(""), F.lit(99)

    def lev(x: Column, y: Column) -> Column:
        d = F.levenshtein(x, y, 2 * radius)
        return F.when(d >= 0, d).otherwise(far)

    a1, a2, b1, b2 = (F.col(c) for c in ("a1", "a2", "b1", "b2"))
    fa, ra, fb, rb = F.concat(a1, F.coalesce(a2, none)), F.concat(F.coalesce(a2, none), a1), F.concat(b1, F.coalesce(b2, none)), F.concat(F.coalesce(b2, none), b1)
    pair = F.least(lev(a1, b1) + lev(a2, b2), lev(a1, b2) + lev(a2, b1))
    got = met.withColumn("d", F.when(a2.isNotNull() & b2.isNotNull(), pair).otherwise(F.least(lev(fa, fb), lev(fa, rb), lev(ra, fb)))).withColumn("most", _allowed(F.greatest(F.length(fa), F.length(fb)), radius))
    got = got.where("d <= 2 * most").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("d") <= F.col("most")).alias("sure"), *(F.when(F.col("d") > F.col("most"), F.col(c)).alias(c) for c in ("a1", "a2", "b1", "b2")), "most")
    got = got.dropDuplicates(["a", "b"])

    def exact(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([core_distance((p, q), (r, s), m) <= m for p, q, r, s, m in zip(a1, a2, b1, b2, most)], dtype="bool")

    sure, unsure = got.where("sure").select("a", "b"), got.where("not sure").where(F.pandas_udf(exact, "boolean")("a1", "a2", "b1", "b2", "most")).select("a", "b")
    return sure.unionByName(unsure)


def _inner_cells(part: DataFrame, radius: int) -> DataFrame:
    """Rows of crowded words in cells of a second level, by pivots of both halves of what stands beside the word.

    What is left of the radius (at most 3) leaves one half with at most one edit, so pairs within it meet in such a cell.
    """
    rest, n = F.col("rest"), F.length("rest")
    at = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.transform(F.sequence(F.lit(-2), F.lit(1)), lambda e: F.floor((n + d) / 2).cast("int") + e))))
    inside = F.filter(at, lambda k: (k >= 0) & (k <= n))
    halves = F.array_distinct(F.flatten(F.transform(inside, lambda k: F.array(F.concat(F.lit("<"), F.substring(rest, F.lit(1), k)), F.concat(F.lit(">"), F.substring(rest, n - k + 1, n))))))
    return part.withColumn("inner", F.explode(F.array_distinct(F.flatten(F.transform(halves, lambda h: F.flatten(F.transform(_labels(h), lambda w: F.transform(_pivots(w), lambda p: F.xxhash64(p)))))))))


def core_links(parts: DataFrame, near: DataFrame, *, radius: int, cell_limit: int) -> DataFrame:
    """Pairs (a, b) of cores within the radius: cores of the same word and of near words, compared by all their words."""
    left = parts.select(F.col("id").alias("a"), F.col("w1").alias("a1"), F.col("w2").alias("a2"), F.col("vid").alias("va"), "rest")
    right = parts.select(F.col("id").alias("b"), F.col("w1").alias("b1"), F.col("w2").alias("b2"), F.col("vid").alias("vb"), "rest")
    crowded = checkpointed(parts.groupBy("vid").agg(F.count("*").alias("n")).where(F.col("n") > cell_limit).select("vid"))
    kept = ("a", "a1", "a2", "b", "b1", "b2")
    if crowded.isEmpty():
        same = left.join(_large(right), F.col("va") == F.col("vb")).where("a < b").select(*kept)
        met = left.drop("rest").join(_large(near), "va").join(_large(right.drop("rest")), "vb").where("a <> b").select(*kept)
        return _linked(same.unionByName(met), radius).distinct()
    # a pair of words of which one is crowded is joined in cells of the second level, all others as they are
    every = near.unionByName(parts.select(F.col("vid").alias("va"), F.col("vid").alias("vb")).distinct())
    marked = every.join(_large(crowded.select(F.col("vid").alias("va"), F.lit(True).alias("ca"))), "va", "left").join(_large(crowded.select(F.col("vid").alias("vb"), F.lit(True).alias("cb"))), "vb", "left")
    marked = checkpointed(marked.select("va", "vb", F.coalesce("ca", "cb", F.lit(False)).alias("hot")))
    cold, hot = marked.where("not hot").drop("hot"), marked.where("hot").drop("hot")
    plain = left.drop("rest").join(_large(cold), "va").join(_large(right.drop("rest")), "vb")
    a = _inner_cells(left.join(_large(hot.select("va").distinct()), "va", "left_semi"), radius).drop("rest")
    b = _inner_cells(right.join(_large(hot.select("vb").distinct()), "vb", "left_semi"), radius).drop("rest")
    inner = a.join(_large(hot), "va").join(_large(b), ["vb", "inner"])
    return _linked(plain.where("a <> b").select(*kept).unionByName(inner.where("a <> b").select(*kept)), radius).distinct()


def radius_links(cores: DataFrame, *, radius: int, cell_limit: int = 1000) -> DataFrame:
    """All pairs (a, b), a < b, of core ids of one class within ``radius`` edits of each other, and within one edit for each three letters of the longer.

    ``cores``: ``id, cls, w1, w2`` (w2 NULL for a run-together core); the
    distance is ``core_distance``.  At most three edits leave one of two words with at
    most one, so both cores have a word in a common cell of ``near_words``; a
    run-together core stands there by its beginnings and ends of all lengths that words have,
    and of half its own.  Cores of a common or near word are then compared exactly.
    (Pivots sampled from the names would put a name into most cells: see the README.)  A word that
    more than ``cell_limit`` cores hold is crowded; its cores are joined in cells of a second
    level, by the halves of their other word, which lose no pair either.
    """
    if radius > 3:
        raise ValueError("cells cover a radius of at most 3")
    parts = checkpointed(core_parts(cores))
    near = checkpointed(near_words(parts.select("vid", "cls", F.col("part").alias("word")).distinct()))
    return core_links(parts, near, radius=radius, cell_limit=cell_limit)


def components(nodes: DataFrame, links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``id, component`` (the least id of each connected component).

    Each round hooks every node to the first of itself and its neighbours by an order of hashes
    and contracts the graph, whose size falls by a constant factor; only nodes with links take part.
    """
    edges = checkpointed(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels = []
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        hook = checkpointed(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select("a", F.least("m", rank("a"))["to"].alias("to")))
        levels.append(hook)
        to = lambda c, new: hook.select(F.col("a").alias(c), F.col("to").alias(new))
        moved = edges.join(_large(to("a", "x")), "a").join(_large(to("b", "y")), "b").where("x <> y")
        edges = checkpointed(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        if not edges.isEmpty():
            raise RuntimeError("components did not settle")
    if not levels:
        return nodes.select("id", F.col("id").alias("component"))
    root = levels[-1]
    for hook in reversed(levels[:-1]):
        root = hook.join(_large(root.select(F.col("a").alias("to"), F.col("to").alias("end"))), "to", "left").select("a", F.coalesce("end", "to").alias("to"))
    root = checkpointed(root)
    least = root.groupBy("to").agg(F.least(F.min("a"), F.col("to")).alias("component"))
    found = root.join(_large(least), "to").select(F.col("a").alias("id"), "component")
    return nodes.select("id").join(_large(found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def entity_classes(names: DataFrame, *, name: str = "name", radius: int = 3, short_radius: int = 1, cell_limit: int = 1000, words: Mapping[str, tuple[str, str]] = WORDS) -> DataFrame:
    """``name, entity``: one row per distinct name with the id of its organisation.

    ``words`` is the vocabulary of what tells organisations apart or says nothing; lines of
    business that the names show beyond it are learned (``learn_words``).
    NULL and empty names are left out; repeated names count once; a name of
    no core words stands alone with its exact repeats of words.  Cores are
    distinct (class, words); cores within ``radius`` of one another in the same class
    (``radius_links``) are one organisation, transitively.  A name whose second word is an
    initial joins the one organisation of its class with a word within
    ``short_radius`` of its own and that initial, if there is exactly one nearest.
    The others are closed over links within ``short_radius`` among names of the same
    class and initial; such a group joins the one organisation that its linked
    names have joined.  If none has, it joins the one nearest organisation at
    distance 2 from its usual word, if their legal forms agree or the group states none: single words of
    different organisations lie that near now and then, and at distance 3 mostly.
    Otherwise it keeps to itself.  A company's single word is read as a word and an
    initial run together only if other names of the class have that word (within ``short_radius``) and that
    initial; else it is a word.
    """
    distinct = names.select(F.col(name).cast("string").alias("name")).where("name is not null and trim(name) <> ''").distinct()
    distinct = checkpointed(distinct.repartition(max(8, names.sparkSession.sparkContext.defaultParallelism)))
    parsed = _parsed(distinct, learn_words(distinct, words))
    core_id = F.xxhash64("cls", F.least("w1", F.coalesce("w2", "w1")), F.greatest("w1", F.coalesce("w2", "w1")), F.col("w2").isNull(), "initial")
    parsed = checkpointed(parsed.withColumn("id", core_id))
    cores = parsed.groupBy("id", "cls", "initial", "glued").agg(F.min(F.struct("w1", "w2")).alias("w"), F.count("*").alias("n"))
    cores = checkpointed(cores.select("id", "cls", "initial", "glued", "w.w1", "w.w2", "n"))
    full = cores.where("initial = ''")
    parts = checkpointed(core_parts(full))
    # a word and an initial: typed so, or what a single word may be
    cut = F.substring("w1", F.lit(1), F.length("w1") - 1)
    short = cores.where("initial <> '' or glued").select("id", "cls", "glued", F.when(F.col("glued"), cut).otherwise(F.col("w1")).alias("own"), F.when(F.col("glued"), F.substring("w1", -1, 1)).otherwise(F.col("initial")).alias("initial"))
    short = checkpointed(short.withColumn("vid", _word_id("own")))
    words_of = parts.select("vid", "cls", F.col("part").alias("word")).unionByName(short.select("vid", "cls", F.col("own").alias("word"))).distinct()
    near = checkpointed(near_words(words_of))
    tried, links = _short_meetings(full, short, parts, near, short_radius)
    # single words that others show to hold an initial
    typed = links.join(_large(short.where("not glued").select(F.col("id").alias("b"))), "b", "left_semi").select(F.col("a").alias("id"))
    shown = checkpointed(short.where("glued").join(_large(tried.select("id").unionByName(typed).distinct()), "id", "left_semi").select("id"))
    whole = full.join(_large(shown), "id", "left_anti")
    short = short.where("not glued").unionByName(short.join(_large(shown), "id", "left_semi"))
    of_full = checkpointed(components(whole, core_links(parts.join(_large(shown), "id", "left_anti"), near, radius=radius, cell_limit=cell_limit)))
    in_use = lambda df, c: df.join(_large(short.select(F.col("id").alias(c))), c, "left_semi")
    of_short = _place_short(whole, short, of_full, in_use(tried, "id"), in_use(in_use(links, "a"), "b"), parsed.select("id", "form").distinct(), short_radius=short_radius)
    entity = of_full.unionByName(of_short)
    return parsed.select("name", "id").join(_large(entity), "id").select("name", F.col("component").alias("entity"))


def _sides(full: DataFrame) -> DataFrame:
    """``core, cls, word, initial, n``: each word of a two-word core with the initial of the other."""
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.substring(y, 1, 1).alias("initial"))
    return full.where("w2 is not null").select(F.col("id").alias("core"), "cls", "n", F.explode(F.array(side("w1", "w2"), side("w2", "w1"))).alias("s")).select("core", "cls", "n", "s.word", "s.initial")


def _edits(most: int):
    """The distance of two columns of words, ``most`` + 1 beyond it."""
    return F.pandas_udf(lambda a, b: pd.Series([damerau(x, y, most) for x, y in zip(a, b)], dtype="int32"), "int")


def _short_meetings(full: DataFrame, short: DataFrame, parts: DataFrame, near: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(``id, core, d``, ``a, b``): names with an initial and the cores, or other such names, with that initial and a word within ``most`` edits."""
    both = near.unionByName(near.select(F.col("vb").alias("va"), F.col("va").alias("vb")))
    own = short.select("id", "cls", "initial", "own", "vid")
    reach = checkpointed(own.join(_large(both), own["vid"] == both["va"]).select("id", "cls", "initial", "own", "vb").unionByName(own.select("id", "cls", "initial", "own", F.col("vid").alias("vb"))))
    sides = _sides(full).withColumn("vb", _word_id("word")).select("vb", "initial", "core", "word")
    met = reach.join(_large(sides), ["vb", "initial"]).withColumn("d", _edits(most)("own", "word")).where(F.col("d") <= most)
    others = short.select(F.col("vid").alias("vb"), "initial", F.col("id").alias("b"), F.col("own").alias("word"))
    peers = reach.withColumnRenamed("id", "a").join(_large(others), ["vb", "initial"]).where("a <> b and length(own) >= 3").where(_edits(most)("own", "word") <= most)
    return checkpointed(met.select("id", "core", "d").distinct()), checkpointed(peers.select("a", "b").distinct())


def _one_nearest(tried: DataFrame, key: str) -> DataFrame:
    """``key, component, d`` of the one component at the least distance; no row for a tie."""
    best = tried.groupBy(key, "component").agg(F.min("d").alias("d"))
    ranked = best.groupBy(key).agg(F.min(F.struct("d", "component")).alias("m"), F.min("d").alias("least"))
    ties = best.join(_large(ranked.select(F.col(key).alias("_k"), "least")), (F.col(key) == F.col("_k")) & (F.col("d") == F.col("least"))).groupBy(key).agg(F.count("*").alias("tied"))
    return ranked.join(_large(ties.where("tied = 1").select(key)), key).select(key, "m.component", "m.d")


def _place_short(full: DataFrame, short: DataFrame, of_full: DataFrame, tried: DataFrame, links: DataFrame, forms: DataFrame, *, short_radius: int, wide: int = 2) -> DataFrame:
    """``id, component`` of the names with an initial: see ``entity_classes``.  ``tried, links``: as of ``_short_meetings``; ``forms``: ``id, form``."""
    placed = of_full.withColumnRenamed("id", "core")
    near = checkpointed(_one_nearest(tried.join(_large(placed), "core").select("id", "component", "d"), "id").select("id", "component"))
    # the others, closed over their own links
    left = checkpointed(short.join(_large(near.select("id")), "id", "left_anti"))
    links = checkpointed(links.join(_large(left.select(F.col("id").alias("a"))), "a", "left_semi"))
    group = checkpointed(components(left.select("id"), links.join(_large(left.select(F.col("id").alias("b"))), "b", "left_semi")).select("id", F.col("component").alias("grp")))
    # a group joins the organisation of the names it is linked with, or the nearest of like form
    known = links.join(_large(near.select(F.col("id").alias("b"), "component")), "b").join(_large(group.withColumnRenamed("id", "a")), "a").groupBy("grp").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    known = checkpointed(known)
    open_ids = left.join(_large(group), "id").join(_large(known.select("grp")), "grp", "left_anti")
    usual = _sides(full).join(_large(placed), "core").groupBy("component", "cls", "initial", "word").agg(F.sum("n").alias("n")).groupBy("component", "cls", "initial").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    twice = lambda w: F.array_distinct(F.flatten(F.transform(_pivots(F.col(w)), _pivots)))
    cell = lambda w: F.explode(F.when(F.length(w).between(3 * wide - wide, 4 * _HEAD), F.transform(twice(w), lambda p: F.xxhash64("cls", "initial", p)))).alias("cell")
    far = open_ids.select("grp", "own", cell("own")).join(_large(usual.select("component", "word", cell("word"))), "cell").drop("cell").distinct()
    far = far.where(F.greatest(F.length("own"), F.length("word")) >= 3 * wide).withColumn("d", _edits(wide)("own", "word")).where((F.col("d") <= wide) & (F.col("d") > short_radius))
    far = checkpointed(_one_nearest(far.select("grp", "component", "d"), "grp"))
    stated = group.join(_large(forms), "id").groupBy("grp").agg(F.collect_set(F.nullif("form", F.lit(""))).alias("own"))
    meant = of_full.join(_large(far.select("component").distinct()), "component", "left_semi").join(_large(forms), "id").groupBy("component").agg(F.collect_set("form").alias("forms"))
    agreed = far.join(_large(stated), "grp").join(_large(meant), "component").where((F.size("own") == 0) | F.arrays_overlap("own", "forms"))
    joins = known.where("component = other").select("grp", "component").unionByName(agreed.select("grp", "component"))
    own = group.join(_large(joins), "grp", "left").select("id", F.coalesce("component", "grp").alias("component"))
    return near.unionByName(own)


def entity_pairs(classes: DataFrame, *, hot: int = 500) -> DataFrame:
    """``name_a, name_b`` (code-point order) of all different names of one entity.

    An entity with more than ``hot`` names is spread: its left names over
    salts, its right names to each of them, so no task holds all its pairs.
    """
    sizes = classes.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1")
    sized = classes.join(_large(sizes), "entity").withColumn("salts", F.ceil(F.col("n") / hot).cast("int"))
    left = sized.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.col("salts")).cast("int").alias("salt"))
    right = sized.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(_large(right), ["entity", "salt"]).where("name_a < name_b").select("name_a", "name_b")
