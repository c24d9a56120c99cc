import random

import pytest

from quillspark.llm.names import NameReader, components, core_distance, damerau, entity_classes, entity_pairs, learn_words, parse_name, radius_links
from tests.conftest import rows


def osa_reference(a, b):
    """Unrestricted Damerau-Levenshtein by search over single edits (short words only)."""
    seen, edge, n = {a}, {a}, 0
    letters = sorted(set(a + b))
    while b not in seen:
        n += 1
        nxt = set()
        for w in edge:
            for i in range(len(w) + 1):
                nxt |= {w[:i] + c + w[i:] for c in letters}
                if i < len(w):
                    nxt.add(w[:i] + w[i + 1 :])
                    nxt |= {w[:i] + c + w[i + 1 :] for c in letters}
                if i + 1 < len(w):
                    nxt.add(w[:i] + w[i + 1] + w[i] + w[i + 2 :])
        edge = {w for w in nxt if len(w) <= 5} - seen
        seen |= edge
    return n


def test_distance():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in "xy")
        assert damerau(a, b, 9) == osa_reference(a, b), (a, b)
    assert damerau("abcdef", "xyz", 2) == 3


@pytest.mark.parametrize(
    ("name", "cls", "words", "initial"),
    [("The Fanutil Kogoben Publ. Corp. (US)", "C|publishing", ["fanutil", "kogoben"], ""), ("Publishing of Fanutil Kogoben Corporation", "C|publishing", ["fanutil", "kogoben"], ""), ("KIBITEM L CONST L L C", "C|construction", ["kibitem"], "l"), ("Lotutex Dafudol Carpemters Lcl 811", "L|carpenters|811", ["lotutex", "dafudol"], ""), ("Sekini-Mibufex, Peggy + Daughters Inc", "F|daughters|margaret", ["sekini", "mibufex"], ""), ("Univ. of Fabelis Bagarath and Subsidiaries", "K|university", ["fabelis", "bagarath"], ""), ("MuketothSokebun Brewing Grp", "C|brewing", ["muketoth", "sokebun"], "")],
)
def test_parts(name, cls, words, initial):
    assert parse_name(name) == (cls, words, initial)


def near(p, q, radius=3):
    """By brute force: within the radius, and within an edit for each three letters."""
    letters = lambda c: sum(len(w) for w in c if w)
    most = min(radius, max(letters(p), letters(q)) // 3)
    return core_distance(p, q, 9) <= most


def test_core_distance():
    assert core_distance(("kogoben", "tarit"), ("tarti", "kgoben"), 3) == 2
    assert core_distance(("kogobentarit", None), ("kogobn", "tarti"), 3) == 2
    assert core_distance(("tartikogobn", None), ("kogoben", "tarit"), 3) == 2
    assert core_distance(("ab", "cd"), ("ef", "gh"), 3) == 4
    assert core_distance(("kestrel", None), ("kastrol", None), 3) == 2


def test_links_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("bdfgk") + rnd.choice("aeiou") for _ in range(n)) + rnd.choice("lmn")

    def typo(w, times=1):
        for _ in range(times):
            if len(w) > 1:
                i = rnd.randrange(len(w) - 1)
                w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("xyz") + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rnd.choice("xyz") + w[i + 1 :]])
        return w

    cores = set()
    for k in range(9):
        a, b = word(3), word(3)
        cores |= {(a, b), (typo(a), b), (typo(a), typo(b, 2)), (b, typo(a, 2)), (a + b, None), (typo(a + b, 3), None), (typo(typo(a) + b, 2), None), (typo(b + a, 2), None)}
        c, d = word(1)[: 2 + k % 2], word(2 + k % 3)  # short words
        cores |= {(c, d), (typo(c), d), (c, typo(d, 2)), (d, typo(c)), (c + d, None), (typo(c + d, 2), None), (c, c[::-1]), (typo(c, 2), c)}
        e = word(k % 3 + 1)  # single words
        cores |= {(e, None), (typo(e), None), (typo(e, 2), None)}
        f = word(14)  # long ones
        cores |= {(f, b), (typo(f), typo(b)), (typo(f + b, 2), None), (typo(f, 3), b), (f, None), (typo(f, 3), None)}
    cores = sorted((c for c in cores if c[0] and c[1] != ""), key=str)
    table = [(k, f"c{k % 2 if k % 5 else 0}", a, b) for k, (a, b) in enumerate(cores)]
    df = spark.createDataFrame(table, "id bigint, cls string, w1 string, w2 string")
    want = sorted((p[0], q[0]) for p in table for q in table if p[0] < q[0] and p[1] == q[1] and near(p[2:], q[2:]))
    assert len(want) > 100
    assert sorted(tuple(r) for r in radius_links(df, radius=3).collect()) == want
    assert sorted(tuple(r) for r in radius_links(df, radius=3, cell_limit=2).collect()) == want  # crowded words lose nothing
    one = sorted((p[0], q[0]) for p in table for q in table if p[0] < q[0] and p[1] == q[1] and near(p[2:], q[2:], 1))
    assert sorted(tuple(r) for r in radius_links(df, radius=1).collect()) == one
    with pytest.raises(ValueError):
        radius_links(df, radius=4)


def test_learned_words(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    names = [f"{word()} {word()} {rnd.choice(['Zeppelin', 'Zepp', 'Dental'])} Inc" for _ in range(400)]
    hot = [f"Hotorg {'Stellar'[:i] + c + 'Stellar'[i:]} Dental" for i in range(7) for c in "abcdefghij"]  # one organisation in many spellings
    words = learn_words(spark.createDataFrame([(n,) for n in names + hot], "name string"))
    assert words["zeppelin"] == ("line", "zeppelin") and words["zepp"] == ("line", "zeppelin")
    assert "hotorg" not in words
    read = NameReader(words).read
    assert read("Fanutil Kogoben Zepp Ltd")[0] == read("Fanutil Kogoben Zepelin Ltd")[0] == "C|zeppelin"
    assert learn_words(spark.createDataFrame([], "name string"), {"a": ("tag", "a")}) == {"a": ("tag", "a")}


def test_single_words(spark):
    same = [["Oracle Corp", "Oracel Corp"], ["Boeing Aviation", "Boeinq Aviation"], ["Kestrel Foods", "Kastrol Foods Inc"], ["Gonarin Bilutus Steel", "GonarinB Steel", "Gonarinb Steel", "GONARIN B. STEEL"], ["Charles Schwab Securities", "Chas. Schwab Securities"]]
    names = spark.createDataFrame([(n,) for g in same for n in g] + [("Delta Airlines",), ("Delta Software",), ("First Bank",)], "name string")
    assert rows(entity_pairs(entity_classes(names))) == sorted((a, b) for g in same for a in g for b in g if a < b)


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id bigint")
    links = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(10, 11)], "a bigint, b bigint")
    assert rows(components(nodes, links)) == sorted([(i, 0) for i in range(10)] + [(10, 10), (11, 10)], key=lambda r: tuple((False, str(x)) for x in r))
    assert rows(components(nodes.limit(2), links.limit(0))) == [(0, 0), (1, 1)]


def test_entities_and_edges(spark):
    same = ["Fanutil Kogoben Publishing Corporation", "FANUTIL  KOGOBEN PUBL. CORP", "Famutil Kgooben Publishing", "Kogoben Fanutil Publishing Corporation", "Fanutil K. Pub Corp.", "The Fanutil Kogoben Publishing Corporation and Subsidiaries"]
    others = ["Fanutil Kogoben Steel Corporation", "Fanutil Kogoben Teachers Local 12", "Fanutil Kogoben Teachers Local 13", "Saint Fanutil Kogoben Hospital"]
    names = spark.createDataFrame([(n, "x") for n in same + others + same[:2] + [None, "", "  ", "The Company", "x" * 20_000]], "name string, entity string")
    got = rows(entity_pairs(entity_classes(names), hot=2))
    assert got == sorted([(a, b) for a in same for b in same if a < b], key=lambda r: tuple((False, x) for x in r))
    assert rows(entity_pairs(entity_classes(names.limit(0)))) == []


def test_initial_forms(spark):
    groups = [
        ["TIGOLOS M. VETERINARY", "Tigools M Veterinary Ltd"],  # no full spelling at all
        ["Kappader Dofusum Semiconductor Limited", "KAPADR D SEMI LTD"],  # distance 2, same form
        ["Gonarin Bilutus Steel Company", "GONARIN B STEEL", "Gonaran B. Steel Co", "GONRRAN B. STEEL INC"],  # by way of a linked name
        ["Goganin Bilutus Telecommunications Company"],
        ["GONARIN B. TELECOMMUNICATIONS INCORPORATED"],  # distance 2, but another form
        ["Telisor Malakum Dental Company"],
        ["TELUSIX M DENTAL COMPANY"],  # distance 3
    ]
    names = spark.createDataFrame([(n,) for g in groups for n in g], "name string")
    assert rows(entity_pairs(entity_classes(names))) == sorted((a, b) for g in groups for a in g for b in g if a < b)


def test_short_and_long_words_meet(spark):
    pairs = [(("bal", "nokudum"), ("balnokudum", None)), (("kogobenarith", "tel"), ("kogobenariht" + "tel", None)), (("li", "kogobenat"), ("li", "kgoobnat")), (("dafuditolem", "rukasiponeb"), ("dafudtolemrukasiponeb", None))]
    table = [(2 * k + side, f"c{k}", *core) for k, pair in enumerate(pairs) for side, core in enumerate(pair)] + [(90, "s", "ab", "cd"), (91, "s", "ef", "ab")]
    df = spark.createDataFrame(table, "id bigint, cls string, w1 string, w2 string")
    assert rows(radius_links(df, radius=3)) == [(2 * k, 2 * k + 1) for k in range(len(pairs))]
