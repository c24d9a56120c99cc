"""Sentence boundaries in many languages and scripts, as code-point offsets."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, case-folded, by how they meet a period.
#: A name follows: a capital after them starts no sentence.
TITLES = set("mr mrs ms dr prof st gen hon rep sen gov capt lt col sgt rev reg hrn hr fr sr sra srta mme m cía cia mio mrd ee mt ft messrs डॉ श्री कं सं د م أ".split())
#: They never end a sentence.
BOUND = set("cf vs ca approx env aprox i.e e.g z.b d.h bzw vgl p.ex viz incl z d v av".split())
#: A number follows: a digit after them starts no sentence.
REFERENCES = set("no nr abs art sec p pp pág pag s fig ch vol par cap núm num n jan feb mar apr jun jul aug sep sept oct nov dec janv févr juil déc l'art d'art seite tit सं".split())
#: They may stand at the end of a sentence, too: a capital after them starts one.
ENDING = set("a.m p.m p.a u.s u.k e.u u.n n.v l.p b.v s.a a.g l.l.c p.l.c s.p.a co corp inc ltd llc plc bn mn mm tn mill mil etc usw u.s.w cie jr ave blvd rd uu ee.uu est dept ex b h लि रु ش.م ق.م".split())
#: After an ellipsis these go on with the sentence in scripts without capitals.
GOES_ON = ("但", "可是", "不过", "然而", "而", "却", "しかし", "だが", "けれど", "でも", "が、", "पर ", "लेकिन", "मगर", "किन्तु", "परंतु", "لكن", "ولكن", "غير أن", "إلا أن", "แต่")
#: Nouns that follow a German ordinal.
ORDINAL_NOUNS = set("januar jänner februar märz april mai juni juli august september oktober november dezember quartal quartals halbjahr halbjahres jahr jahrhundert tag woche monat auflage sitzung kapitel abschnitt stock mal".split())
#: Words of grammar: with a capital they are no names, so they start a sentence.
STARTERS = set(
    "a an the this that these those it its he she they we you i his her their our my there here who what when where which why how if as at in on of to by for from with and but or so nor yet after before since until while once under over between both all each every some any no not then thus also however although because such"
    " der die das ein eine er sie es wir ihr im in am auf aus bei mit nach von zu und aber oder doch wenn als dass da für über unter vor seit bis so nur noch auch dies diese dieser jede jeder"
    " le la les un une des il elle on nous vous ils elles ce cet cette ces dans en au aux sur sous par pour avec sans et mais ou donc car si quand que qui dont selon après avant depuis"
    " el los las una unos unas ella ellos ellas nosotros este esta estos estas ese esa eso en al del por para con sin y pero o si cuando que quien según tras desde hasta hacia".split()
)

_EMPTY_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_STOP = r"[.!?…؟۔।॥。！？｡]"
_CLOSE = r"[\"'”’“»)\]）」』】]"
# a run of stops with its closing marks, then white space, the end, or (for full-width stops and missing spaces) a letter
_CANDIDATE = re.compile(rf"({_STOP}+)((?:[\s ]?»|{_CLOSE})*)(?=\s|$|(.))")
_THAI_GAP = re.compile(r"(?<=[฀-๿])[^\S\n]*(?:\n[^\S\n]*|[^\S\n])(?=[฀-๿])")
_TOKEN_BEFORE = re.compile(r"[^\s(\[（「『“\"„«¿¡<>/—–]+$")
_QUOTE = re.compile(r"[\"“”„«»「」『』]")
_PAIRS = {"“": "”", "「": "」", "『": "』", "«": "»", "„": "“"}
_WIDE = set("。！？｡")


def _quoted_spans(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Spans (open, close) of quotations in a paragraph; marks without a partner enclose nothing."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in _QUOTE.finditer(text, lo, hi):
        ch, at = m.group(), m.start()
        if stack and (ch == stack[-1][0] or (stack[-1][0] == "“" and ch == "”")):
            _, begin = stack.pop()
            if not stack:
                spans.append((begin, at))
        elif ch in _PAIRS:
            stack.append((_PAIRS[ch], at))
        elif ch == '"':
            stack.append(('"', at))
    return spans


def _is_upper_start(word: str) -> bool:
    """A word that can start a sentence: a capital, or one inside as in 'iVeta'."""
    return word[:1].isupper() or (len(word) > 1 and word[0].islower() and word[1].isupper())


_DOC_LOWER = re.compile(r"(?<![^\s(])([^\W\d_]{1,5})\.(?=\s+[^\W\d_A-ZÀ-Þ]|\s*[,;])")
_DOC_PLAIN = re.compile(r"(?<![^\s(])([^\W\d_]{1,5})(?=\s+[^\W\d_])")


def document_abbreviations(text: str) -> set[str]:
    """Short words of a document whose other occurrences show them to be abbreviations.

    An occurrence with a period before a lower-case word or a comma speaks
    for an abbreviation, one inside a sentence without the period against it.
    """
    found = Counter(m.group(1).casefold() for m in _DOC_LOWER.finditer(text))
    if not found:
        return set()
    plain = Counter(w.casefold() for w in _DOC_PLAIN.findall(text))
    return {w for w, n in found.items() if n >= 2 and plain[w] == 0}


_INSIDE = re.compile(r"(?:(?<=[^\W\d_])|(?<=[,;]))\s([^\W\d_]+)")
_PAIR = re.compile(r"(?<![^\s(])([^\W\d_](?:[^\W\d_]|\.(?=[^\W\d_]))*)\.\s+(?=([^\W\d_]+)(?:\W+(\w+))?)")
_LETTERS = re.compile(r"[^\W\d_]+")


def document_names(text: str) -> set[str]:
    """Words of a document that stand capitalised inside its sentences and never in lower case there.

    Only paragraphs with a stop at their end speak: a heading may capitalise any word.
    """
    seen: set[str] = set()
    at = 0
    for end in [*(m.start() for m in _EMPTY_LINE.finditer(text)), len(text)]:
        part = text[at:end].strip()
        if part and not part[-1].isalnum():
            seen.update(_INSIDE.findall(part))
        at = end
    return {w for w in seen if w[0].isupper() and w.lower() not in seen}


def document_pairs(text: str, names: set[str]) -> set[tuple[str, str]]:
    """Pairs of a word with a period and a name after it that belong together in a document.

    They stand together at least twice before different words, and at least
    half of all the name's occurrences are these.
    """
    after: dict[tuple[str, str], list[str]] = {}
    for m in _PAIR.finditer(text):
        if m.group(2) in names:
            after.setdefault((m.group(1).casefold(), m.group(2)), []).append(m.group(3) or "")
    often = {pair: n for pair, n in after.items() if len(set(n)) >= 2}
    if not often:
        return set()
    total = Counter(_LETTERS.findall(text))
    return {pair for pair, n in often.items() if 2 * len(n) >= total[pair[1]]}


class Splitter:
    """Splits documents with fixed word lists, the document's own evidence, and the corpus's."""

    def __init__(self, corpus: frozenset[str] = frozenset()):
        self.corpus = corpus

    def split(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of the sentences of a document, in order."""
        if not text:
            return []
        out: list[tuple[int, int]] = []
        own: list[set | None] = [None, None, None]  # the document's abbreviations, names and pairs, when first needed
        at = 0
        for m in _EMPTY_LINE.finditer(text):
            self._paragraph(text, at, m.start(), out, own)
            at = m.end()
        self._paragraph(text, at, len(text), out, own)
        return out

    def _paragraph(self, text: str, lo: int, hi: int, out: list[tuple[int, int]], own: list) -> None:
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo >= hi:
            return
        spans = _quoted_spans(text, lo, hi)
        start, k = lo, 0
        cuts: list[int] = []
        for m in _CANDIDATE.finditer(text, lo, hi):
            stop = m.end(1)
            while k < len(spans) and spans[k][1] < m.start():
                k += 1
            end = m.end()
            span = spans[k] if k < len(spans) and spans[k][0] < m.start() else None
            if span is not None and span[1] >= end:
                continue  # inside a quotation
            if m.group(2):
                # marks after the stop that open a quotation belong to the next sentence
                while end > stop and any(s[0] == end - 1 for s in spans[k : k + 3]):
                    end -= 1
                while end > stop and text[end - 1].isspace():
                    end -= 1
            if self._ends(text, m.start(), stop, end, hi, start, span, own):
                cuts.append(end)
                start = end
                while start < hi and text[start].isspace():
                    start += 1
        thai: list[int] = []
        k = 0
        for m in _THAI_GAP.finditer(text, lo, hi) if "฀" <= max(text[lo:hi]) else ():
            while k < len(spans) and spans[k][1] <= m.start():
                k += 1
            if k == len(spans) or m.start() <= spans[k][0]:
                thai.append(m.start())
        begin = lo
        for cut in sorted({*cuts, *thai}):
            self._emit(text, begin, cut, out)
            begin = cut
        self._emit(text, begin, hi, out)

    @staticmethod
    def _emit(text: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    def _ends(self, text: str, at: int, stop: int, end: int, hi: int, start: int, span: tuple[int, int] | None, own: list) -> bool:
        """Whether the run of stops at..stop, with closing marks up to end, ends a sentence."""
        marks = text[at:stop]
        nxt = end
        while nxt < hi and text[nxt].isspace():
            nxt += 1
        if nxt >= hi:
            return True
        ch = text[nxt]
        gap = nxt > end
        wide = marks[-1] in _WIDE
        ellipsis = "…" in marks or marks.endswith("..")
        if span is not None:  # the quotation closes right here
            if "぀" <= ch <= "ゟ" or ch in ",，、،;；:：":
                return False
            if ch.islower() and not _is_upper_start(text[nxt : nxt + 2]):
                return False
            leads = not text[start : span[0]].strip()
            if leads and not (ch.isupper() or ch in "\"“«„¿¡「“" and gap):
                return False  # the words after it say who speaks
            return True
        if ch in ",;:，、；：،؛)]）":
            return False
        cased = ch.isupper() or ch.islower()
        if wide:
            return True
        if ellipsis and not cased:
            return not text.startswith(GOES_ON, nxt)
        if ellipsis:
            return (gap or text[nxt + 1 : nxt + 2].islower()) and _is_upper_start(text[nxt : nxt + 2])
        last = marks[-1]
        if last in "!?؟۔।॥":
            return gap or not ch.islower() and not ch.isdigit()
        # a period
        if not gap:
            if end > stop:
                return ch.isupper() and text[nxt + 1 : nxt + 2].islower() or ch in "\"“«„¿¡"
            before = text[max(at - 2, start) : at]
            if not (len(before) == 2 and (before.islower() and before.isalpha() or before.isdigit() or before[-1] == "%")):
                return cased is False and ch.isalpha() and not before[-1:].isalnum()
            return ch.isupper() and text[nxt + 1 : nxt + 2] != "" and (text[nxt + 1].islower() or text[nxt + 1] in ". " and text[nxt + 1] == ".")
        token = _TOKEN_BEFORE.search(text, max(start, at - 24), at)
        word = token.group().casefold() if token else ""
        number = bool(word) and word[-1].isdigit()
        if ch == "(" or ch == "（":
            return end > stop or not self._known(word, text, own)
        if number:
            if word.isdigit() and len(word) <= 2:
                follow = re.compile(r"[^\W\d_]+").match(text, nxt)
                if follow and follow.group().casefold() in ORDINAL_NOUNS:
                    return False
            return True
        if end > stop:
            return not ch.islower() or _is_upper_start(text[nxt : nxt + 2])
        if len(word) == 1 and text[at - 1].isupper() and ch.isupper():
            return False  # an initial
        if word in BOUND:
            return False
        if word in TITLES and (cased or ch.isalpha()):
            return False
        if ch.isdigit() or ch in "$€£¥§#":
            return not (word in REFERENCES or word in TITLES or self._known(word, text, own))
        if word == "cie" and ch.isupper():
            return text[start : at - len(word)].rstrip().endswith(("et", "ET", "&"))
        if word == "co" and re.compile(r"KG\b|kg\b").match(text, nxt):
            return False
        if ch.islower() and not _is_upper_start(text[nxt : nxt + 2]):
            return not (word in REFERENCES or self._known(word, text, own))
        if ch.isupper():
            return not self._leads_name(word, text, nxt, own)
        if ch in "\"“«„¿¡「“":
            return True
        if ch.isalpha():  # a script without capitals
            return not (word in ENDING or word in self.corpus)
        return True

    def _known(self, word: str, text: str, own: list) -> bool:
        """An abbreviation by the lists, the document itself, or the corpus."""
        word = word.strip(".")
        if word in ENDING or word in TITLES or word in BOUND or word in REFERENCES or "." in word or len(word) == 1:
            return True
        if own[0] is None:
            own[0] = document_abbreviations(text)
        return word in own[0] or word in self.corpus


    def _leads_name(self, word: str, text: str, nxt: int, own: list) -> bool:
        """Whether the capital after an abbreviation is that of a proper name that goes with it.

        After an abbreviation that only the document or the corpus shows, a capital is
        that of a name unless the document has the word in lower case or it is one of grammar.  Else the document must
        show the word to be a name, and an abbreviation that may
        stand at the end of a sentence, too, must be seen to go with it.
        """
        if not (word.replace(".", "").isalpha() and self._known(word, text, own)):
            return False
        name = _LETTERS.match(text, nxt)
        if name is None or (low := name.group().casefold()) in TITLES or low in REFERENCES:
            return False
        word = word.strip(".")
        both = word in ENDING or word in REFERENCES
        if not both and word not in TITLES and word not in BOUND and "." not in word and len(word) > 1:
            # an abbreviation by evidence alone: what follows is a name unless it is shown, or by grammar bound, to be a common word
            return low not in STARTERS and re.search(rf"(?<!\w){re.escape(low)}(?!\w)", text) is None
        if both and text.find(name.group(), nxt + 1) < 0 and text.find(name.group()) == nxt:
            return False  # met here only
        if own[1] is None:
            own[1] = document_names(text)
        if name.group() not in own[1]:
            return False
        if not both:
            return True
        if own[2] is None:
            own[2] = document_pairs(text, own[1])
        return (word, name.group()) in own[2]


_SHORT = r"(?:^|[\s(])(\p{L}[\p{L}.]{0,5})\.\s+"


def corpus_abbreviations(documents: DataFrame, *, text: str = "text", least_count: int = 5, least_share: float = 0.3, most: int = 50_000) -> list[str]:
    """Short words that in the whole corpus stand before a period inside sentences.

    Counts every document: a word before a period and a lower-case word or a
    digit speaks for an abbreviation, one before a period and a capital
    against it.  The words have at most six letters and are met at least
    ``least_count`` times inside sentences, so the list stays that of a few languages'
    abbreviations; more than ``most`` of them are an error, not cut off.
    """
    t = F.col(text)
    hits = lambda after, kind: F.transform(F.regexp_extract_all(t, F.lit(_SHORT + after), 1), lambda w: F.struct(F.lower(w).alias("w"), F.lit(kind).alias("inside")))
    both = documents.where(t.isNotNull()).select(F.explode(F.concat(hits(r"[\p{Ll}\d]", 1), hits(r"[\p{Lu}]", 0))).alias("h")).select("h.w", "h.inside")
    counts = both.groupBy("w").agg(F.sum("inside").alias("inside"), F.count("*").alias("n"))
    rows = counts.where((F.col("inside") >= least_count) & (F.col("inside") >= least_share * F.col("n"))).select("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} abbreviations: raise least_count")
    return [r["w"] for r in rows]


def split_sentences(documents: DataFrame, *, key: str = "doc_id", text: str = "text", use_corpus: bool = True) -> DataFrame:
    """``key, sent_start INT, sent_end INT``: the sentences of every document.

    Offsets count code points from 0, end exclusive, without white space
    around a sentence; together they cover all text that is not white space.  An empty line
    always ends a unit.  Stops by script: Latin, Arabic, Devanagari marks need
    white space (or a plainly missing one) after them, full-width ones do not,
    Thai statements end at a space between Thai letters.  A period is no end
    after an abbreviation or initial (fixed lists, the document's own
    unambiguous occurrences, then the corpus's), in an ordinal or number, or before a
    lower-case word that follows one of these; stops inside a quotation are none.
    A capital after an abbreviation starts no sentence if the document shows its
    word to be a name; abbreviations that may end a sentence, too, must stand with that
    name repeatedly.
    NULL and empty texts give no row; repeated documents give theirs each; an
    empty table gives an empty result.  No shuffle but for the corpus counts.
    """
    learned = frozenset(corpus_abbreviations(documents, text=text)) if use_corpus else frozenset()
    splitter = Splitter(learned)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, begins, ends = [], [], []
            for k, t in zip(pdf["k"], pdf["t"]):
                for a, b in splitter.split(t):
                    keys.append(k)
                    begins.append(a)
                    ends.append(b)
            yield pd.DataFrame({"k": pd.array(keys, "Int64"), "sent_start": begins, "sent_end": ends}).astype({"sent_start": "int32", "sent_end": "int32"})

    rows = documents.select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInPandas(run, "k long, sent_start int, sent_end int").withColumnRenamed("k", key)
