"""Held-out test passages found in a corpus, whole or in part (Aho-Corasick)."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a searched piece.
PIECE = 5
#: Characters that show nothing.
_INVISIBLE = dict.fromkeys([0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF])
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:[\s/][^<>]*)?>")
_TAG_OR_HIDDEN = re.compile(r"[<­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_MARKS = re.compile(r"[̀-ͯ]+")
_IN_NUMBER = re.compile(r"(?<=[0-9])[.,](?=[0-9])")
# a run of letters or of digits; every ideograph, kana or Thai letter by itself
_WORD = re.compile(r"[0-9]+|[฀-໿぀-ヿ㐀-鿿가-힯豈-﫿]|[^\W\d_฀-໿぀-ヿ㐀-鿿가-힯豈-﫿]+")


def tokens_of(text: str) -> list[str]:
    """The tokens of a text without case, accents, markup, punctuation and hidden characters."""
    if _TAG_OR_HIDDEN.search(text):
        text = _TAG.sub("", text).translate(_INVISIBLE)
    text = text.casefold() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall(_IN_NUMBER.sub("", text))


def tokens_with_offsets(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """``tokens_of`` with the span of each token in the original text."""
    hidden = [False] * len(text)
    for m in _TAG.finditer(text):
        hidden[m.start() : m.end()] = [True] * (m.end() - m.start())
    chars: list[str] = []
    where: list[int] = []
    for i, ch in enumerate(text):
        if hidden[i] or ord(ch) in _INVISIBLE:
            continue
        for c in unicodedata.normalize("NFKD", ch).casefold():
            if not "̀" <= c <= "ͯ":
                chars.append(c)
                where.append(i)
    plain = "".join(chars)
    drop = {m.start() for m in _IN_NUMBER.finditer(plain)}
    if drop:
        where = [w for i, w in enumerate(where) if i not in drop]
        plain = "".join(c for i, c in enumerate(plain) if i not in drop)
    found = list(_WORD.finditer(plain))
    return [m.group() for m in found], [(where[m.start()], where[m.end() - 1] + 1) for m in found]


class LeakFinder:
    """One automaton over the pieces of all test items, and the alignment of what it hits."""

    def __init__(self, items: list[tuple[int, str]], *, piece: int = PIECE, share: float = 1 / 3):
        import ahocorasick

        self.share, self.piece = share, piece
        self.items = {i: tokens_of(t) for i, t in items}
        self.total = {i: sum(map(len, t)) for i, t in self.items.items()}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, toks in self.items.items():
            n = min(piece, len(toks))
            for p in range(len(toks) - n + 1 if n else 0):
                places[" " + " ".join(toks[p : p + n]) + " "].append((i, p))
        shared: dict[int, set[int]] = defaultdict(set)
        for at in places.values():
            if len({i for i, _ in at}) > 1:
                for i, p in at:
                    shared[i].add(p)
        #: Places of an item's pieces that other items have, too, unless the item is much shared.
        self.common = {i: at for i, at in shared.items() if not self._much_shared(i, at)}
        self.automaton = ahocorasick.Automaton()
        for text, at in places.items():  # a piece stands for all the places it has, in one item or several
            if at := [(i, p) for i, p in at if p not in self.common.get(i, ())]:
                self.automaton.add_word(text, (at, text.count(" ") - 1))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def _much_shared(self, item: int, at: set[int]) -> bool:
        """Whether the pieces at these places, found in other items, too, are a share of the item's pieces or hold one in a single run."""
        mine = self.items[item]
        n = min(self.piece, len(mine))
        if len(at) >= self.share * (len(mine) - n + 1):
            return True
        most = run = end = 0
        for p in sorted(at):
            run = (run if p <= end else 0) + sum(map(len, mine[max(p, end) : p + n]))
            most, end = max(most, run), p + n
        return most >= 0.9 * self.share * self.total[item]

    def hits(self, tokens: list[str]) -> dict[int, set[tuple[int, int]]]:
        """(place in item, place in text) of the pieces found, by item; one pass over the text."""
        out: dict[int, set[tuple[int, int]]] = defaultdict(set)
        if self.empty:
            return out
        joined = " " + " ".join(tokens) + " "
        starts: dict[int, int] | None = None
        for end, (at, n) in self.automaton.iter(joined):
            if starts is None:
                starts, pos = {}, 0
                for k, t in enumerate(tokens):
                    pos += len(t) + 1
                    starts[pos] = k  # the space after token k
            last = starts[end]
            for item, p in at:
                out[item].add((p, last - n + 1))
        return out

    def covered(self, item: int, hits: set[tuple[int, int]], tokens: list[str]) -> tuple[float, int, int]:
        """Share of the item's letters that stands in the text, and the first and last token of it there.

        Hits grow along the text while tokens go on to agree, over at most
        two changed, added or lost tokens at a time if three of the next four agree
        after them; tokens so bridged count as standing there.
        """
        mine = self.items[item]
        n = min(self.piece, len(mine))
        got = [False] * len(mine)
        lo, hi = len(tokens), -1
        seen: set[tuple[int, int]] = set()
        for p, q in sorted(hits):
            if (p, q) in seen:
                continue
            for k in range(n):
                got[p + k] = True
            lo, hi = min(lo, q), max(hi, q + n - 1)
            for step in (1, -1):
                i, j = (p + n, q + n) if step > 0 else (p - 1, q - 1)
                while 0 <= i < len(mine) and 0 <= j < len(tokens):
                    if mine[i] == tokens[j]:
                        got[i] = True
                        if step > 0:
                            seen.add((i - n + 1, j - n + 1))
                        lo, hi = min(lo, j), max(hi, j)
                        i, j = i + step, j + step
                        continue
                    for a, b in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0)):
                        agree = sum(1 for k in range(4) if 0 <= i + step * (a + k) < len(mine) and 0 <= j + step * (b + k) < len(tokens) and mine[i + step * (a + k)] == tokens[j + step * (b + k)])
                        ok = 0 <= i + step * a < len(mine) and 0 <= j + step * b < len(tokens) and mine[i + step * a] == tokens[j + step * b]
                        if ok and agree >= 3:
                            for k in range(a):
                                got[i + step * k] = True
                            i, j = i + step * a, j + step * b
                            break
                    else:
                        break
        return sum(len(t) for t, g in zip(mine, got) if g) / max(1, self.total[item]), lo, hi

    def find(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, share, start, end) of the items of which enough stands in the text; offsets into the original."""
        if not text:
            return []
        tokens = tokens_of(text)
        found = self._shares(tokens)
        if not found:
            return []
        mapped, spans = tokens_with_offsets(text)
        if mapped != tokens:  # one letter's form depends on the next in some scripts
            found = self._shares(mapped)
        return [(item, share, spans[lo][0], spans[hi][1]) for item, share, lo, hi in found]

    def _shares(self, tokens: list[str]) -> list[tuple[int, float, int, int]]:
        """(item, share, first token, last token) of the items of which enough stands in a text."""
        out = []
        for item, hits in self.hits(tokens).items():
            share, lo, hi = self.covered(item, hits, tokens)
            if share >= self.share:
                out.append((item, share, lo, hi))
        return out


#: Automata of this worker process, by the test set they were built for.
_FINDERS: dict[str, LeakFinder] = {}


def leaked_passages(documents: DataFrame, passages: DataFrame, *, doc_key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = 1 / 3, most_items: int = 200_000, most_letters: int = 100_000_000) -> DataFrame:
    """``doc_key, item_key, share DOUBLE, leak_start INT, leak_end INT`` of passages in documents.

    The test set is what a person holds out by hand: it is collected once,
    and more than ``most_items`` or ``most_letters`` of it are an error.  Every worker process builds one
    automaton over all its pieces of five tokens (words; single characters in
    scripts without spaces), each with every item and place that has it, scans each document
    once, grows the hits along both texts over changed words, and keeps the
    pairs in which at least ``share`` of the item's letters stands, in one piece or
    several.  Pieces that other items share, too, are the build of a sentence and start no hit, though hits grow over
    them; but if they make up a passage that could be a leak of the item (a share of its
    pieces, or nearly of its letters in a run), they do, and a text with that passage leaks each of
    the items that have it.  There is no shuffle of documents.  Offsets are code points of
    the original text.  NULL and empty texts on either side give nothing;
    repeated documents are reported each; a repeated item id keeps its first
    text in text order; of items of the same text
    only the least of their ids is searched and its rows are given to all of them.
    """
    wanted = passages.select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").groupBy("i").agg(F.min("t").alias("t"))
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("letters")).first()
    if size["n"] > most_items or size["letters"] > most_letters:
        raise ValueError(f"{size['n']} test items of {size['letters']} letters; at most {most_items} of {most_letters}")
    same: dict[str, list[int]] = defaultdict(list)
    first: dict[str, str] = {}
    for r in sorted(wanted.collect(), key=lambda r: r["i"]):
        plain = " ".join(tokens_of(r["t"]))
        same[plain].append(r["i"])
        first.setdefault(plain, r["t"])
    items = [(ids[0], first[t]) for t, ids in same.items() if t]
    twins = {ids[0]: ids for t, ids in same.items() if t}
    shared = documents.sparkSession.sparkContext.broadcast((items, twins))
    built_for = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, twins = shared.value
        if built_for not in _FINDERS:
            _FINDERS.clear()
            _FINDERS[built_for] = LeakFinder(items, share=share)
        finder = _FINDERS[built_for]
        for pdf in batches:
            out = [(k, twin, s, a, b) for k, t in zip(pdf["k"], pdf["t"]) for i, s, a, b in finder.find(t) for twin in twins[i]]
            yield pd.DataFrame(out, columns=["k", "i", "share", "leak_start", "leak_end"]).astype({"k": "int64", "i": "int64", "share": "float64", "leak_start": "int32", "leak_end": "int32"})

    docs = documents.select(F.col(doc_key).cast("bigint").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    found = docs.mapInPandas(run, "k long, i long, share double, leak_start int, leak_end int")
    return found.select(F.col("k").alias(doc_key), F.col("i").alias(item_key), "share", "leak_start", "leak_end")
