"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is mined from labelled rows: words and word stems that more toxic texts hold than
chance can explain, though every word of the sample had its chance (`mine`). It becomes a trie; running all
Levenshtein automata of distance 1 over that trie at once, and making the product
deterministic, gives one automaton that reads a word and ends in (term, distance) pairs
(`Automaton`). All words of a chunk of text step through its table together, column by
column, and most leave it within three letters, so whole corpora can be scanned. A digit or
symbol between letters is an edit too. Stems take edits before their last letter.

Each hit is weighed by its window: whether it stands in quotation (matched quote marks of its
paragraph, or right behind a word such as "word"), whether words of reporting are near, and
whether someone is addressed. Every mixture of the three has a factor of its own that a hit
counts for, 1 for a plain hit. The factors are fitted on the labelled rows and on seeded copies of
those with hits: copies that put each hit in marks behind a word of reporting are mentions, so
clean; copies that report or address without marks, or address outside them, keep their label; marks
alone do either. A logistic regression on the hits, trained on a bounded sample of labelled rows,
gives the score. A misspelled term counts as the exact one times one learned discount; forms that
clean rows use as words of their own are no misspellings (of a stem: their first letters). Nulls
and empty texts have no hits and get the score of such texts; repeated rows get equal scores;
very long texts are read in pieces. Texts of the sample stay in tasks: the driver gets candidate
terms and the hits of each text.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from itertools import islice, product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.llm.common import crc_rest, stored, text_batches
from aerolith.llm.langid import sampled

#: Labelled rows that lexicon and weights are learned from, at most, of either label.
SAMPLE_ROWS = 4000
#: Letters of a stem.
STEMS = (4, 5, 6, 7, 8)
#: How many times as frequent among toxic texts a term is, at least, and the odds that any term is there by chance.
TIMES = 8
CHANCE = 0.01
#: Letters of a term that may be misspelled, at least.
FUZZY = 5
#: What a misspelled hit may count for, of an exact one.
DISCOUNTS = (0.25, 0.5, 0.75, 1.0)
WINDOW = 8
CHUNK = 1 << 18
#: Words that report or discuss another's words, in the languages at hand.
REPORTING = frozenset("said says say quote quoted word words term called wrote writes sagte wort zitat dit mot terme dijo palabra cita".split())
#: Words that address someone.
ADDRESS = frozenset("you your u ur du dich dein tu toi ton vous te tú usted".split())
#: Words behind which a term is named, not used.
NAMING = frozenset("word term wort mot terme palabra".split())
#: Who speaks for themselves reports nobody.
FIRST = frozenset("i we ich wir je nous yo my our".split())
#: Bits of a hit's window, and what each mixture of them may count for.
QUOTED, REPORTED, ADDRESSED = 1, 2, 4
FACTORS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: How often at least a term is in toxic texts.
LEAST = 3
#: Copies of a labelled text: as it is, misspelled, and with its hits framed as uses or as mentions.
PLAIN, MISSPELLED, USED, MENTIONED = range(4)
_MARK = re.compile(r'["“”„«»‹›]|\n[ \t\r]*\n')
_WORD = re.compile(r"[^\W\d_]+")


class Term(NamedTuple):
    text: str
    stem: bool  # matches every word that begins with it


class Automaton(NamedTuple):
    """table[state, column] -> state; state 0 is dead. ends[state]: index into hits, or -1."""

    columns: np.ndarray  # column of each codepoint; 0 for all letters outside the lexicon
    table: np.ndarray
    ends: np.ndarray
    absorbing: np.ndarray  # states of a matched stem: the rest of the word doesn't matter
    hits: list  # (term, distance)


def build(terms: list[Term], distance: int = 1) -> Automaton:
    """The deterministic product of the lexicon's trie with the Levenshtein automata of all words read."""
    children: list[dict[str, int]] = [{}]
    final: dict[int, int] = {}
    for k, t in enumerate(terms):
        node = 0
        for ch in t.text:
            if ch not in children[node]:
                children[node][ch] = len(children)
                children.append({})
            node = children[node][ch]
        final.setdefault(node, k)
    letters = sorted({ch for t in terms for ch in t.text})
    columns = np.zeros(0x110000, dtype=np.uint8 if len(letters) < 255 else np.uint16)
    for i, ch in enumerate(letters):
        columns[ord(ch)] = i + 1
    allowed = {}  # edits that a node's terms may still have: short terms match exactly
    order = [(0, ())]
    for node, path in order:
        order += [(c, (*path, node)) for c in children[node].values()]
    fuzzy = np.zeros(len(children), dtype=bool)
    paths = dict(order)
    for node, k in final.items():
        if len(terms[k].text) >= FUZZY:
            fuzzy[[node, *paths[node]]] = True
    allowed = {n: distance if fuzzy[n] else 0 for n in range(len(children))}

    def close(pairs: dict[int, int]) -> frozenset:
        """Adds what skipping letters of terms reaches; keeps each node's least distance."""
        todo = list(pairs.items())
        while todo:
            node, d = todo.pop()
            for c in children[node].values():
                if d < allowed[c] and d + 1 < pairs.get(c, 99):
                    pairs[c] = d + 1
                    todo.append((c, d + 1))
        return frozenset(pairs.items())

    hits: list[tuple[int, int]] = []
    number: dict = {(frozenset(), None): 0}
    rows, ends, absorbing = [[0] * (len(letters) + 1)], [-1], [False]

    def state(pairs: frozenset, stem) -> int:
        """stem: (distance, term) of the best stem that the word begins with; nothing beats an exact one."""
        key = (pairs, stem)
        if key not in number:
            number[key] = len(rows)
            rows.append(None)
            found = [(d, final[n]) for n, d in pairs if n in final and not terms[final[n]].stem and (d == 0 or len(terms[final[n]].text) >= FUZZY)]
            best = min([*found, *([stem] if stem is not None else [])], default=None)
            if best is None:
                ends.append(-1)
            else:
                ends.append(len(hits))
                hits.append((best[1], best[0]))
            absorbing.append(not pairs)
            todo.append(key)
        return number[key]

    todo: list = []
    first = state(close({0: 0}), None)
    while todo:
        key = todo.pop()
        pairs, stem = key
        row = []
        for ch in (None, *letters):
            if not pairs:
                row.append(number[key])
                continue
            after: dict[int, int] = {}
            met = [stem] if stem is not None else []  # a stem is met when its last letter is read
            for node, d in pairs:
                for c_ch, c in children[node].items():
                    e = d + (c_ch != ch)
                    if e <= allowed[c] and e < after.get(c, 99):
                        after[c] = e
                    if c_ch == ch and c in final and terms[final[c]].stem and d <= allowed[c]:
                        met.append((d, final[c]))
                if d < allowed[node] and d + 1 < after.get(node, 99):
                    after[node] = d + 1
            best = min(met, default=None)
            row.append(state(frozenset() if best is not None and best[0] == 0 else close(after), best))
        rows[number[key]] = row
    assert first == 1
    return Automaton(columns, np.array(rows, dtype=np.int32), np.array(ends, dtype=np.int32), np.array(absorbing), hits)


_LETTER = np.zeros(1, dtype=np.uint32)


def _letters() -> np.ndarray:
    """Lower case of each letter; 0 for all else."""
    global _LETTER
    if len(_LETTER) == 1:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def scan(texts: list[str], auto: Automaton) -> list[list[tuple[int, int, int, int]]]:
    """For each text its hits (term, distance, start, end), positions in characters."""
    out: list[list] = [[] for _ in texts]
    # long texts go in pieces cut after blanks; a word is never split unless it is CHUNK long
    held, size = [], 0
    todo = [(k, t) for k, t in enumerate(texts) if t]
    for i, (k, t) in enumerate(todo):
        a = 0
        while a < len(t):
            b = min(len(t), a + CHUNK)
            if b < len(t):
                b = max(t.rfind(" ", a + 1, b), t.rfind("\n", a + 1, b)) + 1 or b
            held.append((k, a, t[a:b]))
            size += b - a
            a = b
            if size >= CHUNK:
                _scan_held(held, auto, out)
                held, size = [], 0
    if held:
        _scan_held(held, auto, out)
    return out


def _scan_held(held, auto: Automaton, out) -> None:
    joined = "\n".join(t for _, _, t in held)
    points = _letters()[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
    letter = np.concatenate([[False], points > 0, [False]])
    start = np.flatnonzero(letter[1:] & ~letter[:-1])
    end = np.flatnonzero(letter[:-1] & ~letter[1:])
    # words that one digit or symbol parts are read whole, too
    runs = len(start)
    parted = np.flatnonzero(start[1:] - end[:-1] == 1)
    parted = parted[[not joined[i].isspace() for i in end[parted].tolist()]]
    start, end = np.concatenate([start, start[parted]]), np.concatenate([end, end[parted + 1]])
    column = auto.columns[points]
    width = auto.table.shape[1]
    flat = auto.table.ravel()
    word = np.arange(len(start))
    state = np.ones(len(start), dtype=np.int32)
    size = end - start
    hits = []
    depth = 0
    while len(word):
        over = size == depth
        if over.any():
            done = over & (auto.ends[state] >= 0)
            hits.append(np.stack([word[done], auto.ends[state[done]]], axis=1))
            go = ~over
            word, state, size = word[go], state[go], size[go]
        state = flat[state * width + column[start[word] + depth]]
        depth += 1
        live = state > 0
        stem = auto.absorbing[state]
        if stem.any():
            hits.append(np.stack([word[stem], auto.ends[state[stem]]], axis=1))
            live &= ~stem
        word, state, size = word[live], state[live], size[live]
    found = np.concatenate(hits) if hits else np.zeros((0, 2), dtype=np.int64)
    begins = np.cumsum([0, *(len(t) + 1 for _, _, t in held)])
    met = np.unique(found[:, 0])
    clear = np.append(np.ones(runs, dtype=bool), ~(np.isin(parted, met) | np.isin(parted + 1, met)))
    found = found[clear[found[:, 0]]]
    for w, h in sorted(found.tolist(), key=lambda x: (start[x[0]], x)):
        i = int(np.searchsorted(begins, start[w], side="right")) - 1
        k, shift, _ = held[i]
        term, distance = auto.hits[h]
        out[k].append((term, distance, int(start[w] - begins[i]) + shift, int(end[w] - begins[i]) + shift))


def quotations(text: str) -> list[tuple[int, int]]:
    """What stands between quote marks, matched within each paragraph; a straight mark behind a digit opens nothing."""
    out, opened = [], None
    for m in _MARK.finditer(text):
        if m[0][0] == "\n":
            opened = None
        elif opened is not None:
            out.append((opened, m.start()))
            opened = None
        elif m[0] != '"' or not text[max(0, m.start() - 1) : m.start()].isdigit():
            opened = m.end()
    return out


def _before(text: str, at: int) -> list[re.Match]:
    """The last WINDOW words before a place."""
    n = 96
    while True:
        got = list(_WORD.finditer(text, max(0, at - n), at))
        if len(got) > WINDOW or n >= at:
            return got[-WINDOW:]
        n *= 4


def weigh(text: str, hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, bool, bool, bool]]:
    """(term, distance, quoted, reported, addressed) of each hit; of what is quoted, the words near the quotation tell."""
    spans = quotations(text) if hits else []
    starts = [a for a, _ in spans]
    out = []
    for term, distance, a, b in hits:
        k = bisect_right(starts, a) - 1
        quoted = k >= 0 and b <= spans[k][1]
        left, right = _before(text, spans[k][0] if quoted else a), islice(_WORD.finditer(text, spans[k][1] if quoted else b), WINDOW)
        named = bool(left) and left[-1][0].lower() in NAMING and not text[left[-1].end() : a].strip(" \"“„«‹")
        near = [[m[0].lower() for m in side] for side in (left, right)]
        reported = any(w in REPORTING and not (i and side[i - 1] in FIRST) for side in near for i, w in enumerate(side))
        out.append((term, distance, quoted or named, reported, any(w in ADDRESS for side in near for w in side)))
    return out


class Model(NamedTuple):
    terms: list[Term]
    auto: Automaton
    weights: np.ndarray
    bias: float
    discount: float  # what a misspelled hit counts for, of an exact one
    factors: tuple  # what a hit counts for in each window, of a plain one
    innocent: frozenset  # words near a term that clean rows use


def _form(text: str, hit: tuple[int, int, int, int], terms: list[Term]) -> str:
    """The word of a hit in lower case; for a stem, as many letters of it as the stem has."""
    term, word = terms[hit[0]], text[hit[2] : hit[3]].lower()
    return word[: len(term.text)] + "*" if term.stem else word


def meant(text: str, hits: list[tuple[int, int, int, int]], terms: list[Term], innocent: frozenset) -> list[tuple[int, int, int, int]]:
    """Hits without words that only look like a term."""
    return [h for h in hits if h[1] == 0 or _form(text, h, terms) not in innocent]


def features(terms: list[Term], hits, discount: float, factors) -> np.ndarray:
    """What hits (term, fuzzy, window, times) of a text say for each term, of hits near an address, and of whole words.

    A word that clean texts never hold tells as much once as ten times, so its strongest hit counts;
    parts of stems come by chance, so their counts tell.
    """
    x = np.zeros(len(terms) + 2)
    for term, fuzzy, window, times in hits:
        v = factors[window] * (discount if fuzzy else 1.0)
        if terms[term].stem:
            x[term] += times * v
        else:
            x[term], x[-1] = max(x[term], v), max(x[-1], v)
        if window & ADDRESSED:
            x[-2] += times * v
    sums = np.array([*(t.stem for t in terms), True, False])
    return np.where(sums, np.log1p(x), x)


def _windowed(weighed) -> list[tuple[int, int, int, int]]:
    """Hits (term, fuzzy, window, times) of weighed ones."""
    n = Counter((term, int(distance > 0), QUOTED * quoted + REPORTED * reported + ADDRESSED * addressed) for term, distance, quoted, reported, addressed in weighed)
    return [(*k, v) for k, v in n.items()]


def logit(model: Model, text: str, hits: list[tuple[int, int, int, int]]) -> float:
    """The log odds of a text with these hits."""
    return float(features(model.terms, _windowed(weigh(text, hits)), model.discount, model.factors) @ model.weights + model.bias)


def misspelled(word: str, rng: random.Random) -> str:
    """The word with one letter doubled, dropped or changed, or a digit or symbol for it, never the last."""
    i = rng.randrange(1, len(word) - 1)
    return word[:i] + rng.choice([word[i] * 2, "", rng.choice("abcdefghijklmnopqrstuvwxyz".replace(word[i].lower(), "")), rng.choice("0134@*$")]) + word[i + 1 :]


#: Frames of a word {w} with a report {r} and an address {a}: the first four use it, the last four mention it, marks alone do either.
_FRAMES = ("{r} {w}", "{r} {a} {w}", '{a} "{w}"', '{r} {a} "{w}"', '"{w}"', *['{r} "{w}"'] * 4)


def _framed(use: bool, rng: random.Random):
    """A function that puts words into one frame, drawn for all of a text."""
    frame = rng.choice(_FRAMES[:5] if use else _FRAMES[4:])
    reports, addresses = sorted(REPORTING - NAMING), sorted(ADDRESS)
    return lambda word: frame.format(w=word, r=rng.choice(reports), a=rng.choice(addresses))


def _rewritten(text: str, spans: list[tuple[int, int]], change) -> str:
    parts, at = [], 0
    for a, b in spans:
        if a >= at:
            parts += [text[at:a], change(text[a:b])]
            at = b
    return "".join([*parts, text[at:]])


def occurrences(texts: list[str], terms: list[Term], auto: Automaton) -> list[list[tuple]]:
    """For each text the hits (copy, term, fuzzy, window, form, times) of itself and of its seeded copies; form is of fuzzy hits only."""
    found = scan(texts, auto)
    copies = [(i, PLAIN, t) for i, t in enumerate(texts)]
    for i, (t, hits) in enumerate(zip(texts, found)):
        rng = random.Random(zlib.crc32(t.encode()))
        exact = [h for h in hits if h[1] == 0]
        # of a stem's word, the stem is misspelled
        long = [(a, a + len(terms[k].text)) for k, _, a, _ in exact if len(terms[k].text) >= FUZZY]
        if long:
            copies.append((i, MISSPELLED, _rewritten(t, long, lambda w: misspelled(w, rng))))
        if exact:
            copies += [(i, kind, _rewritten(t, [h[2:] for h in exact], _framed(kind == USED, rng))) for kind in (USED, MENTIONED)]
    out: list[list] = [[] for _ in texts]
    for (i, kind, t), hits in zip(copies, [*found, *scan([t for _, _, t in copies[len(texts) :]], auto)]):
        n = Counter()
        for h, w in zip(hits, weigh(t, hits)):
            n[h[0], int(h[1] > 0), QUOTED * w[2] + REPORTED * w[3] + ADDRESSED * w[4], _form(t, h, terms) if h[1] else ""] += 1
        out[i] += [(kind, *k, v) for k, v in n.items()]
        if kind and not n:
            out[i].append((kind, -1, 0, 0, "", 0))  # a copy whose hits are gone is a copy still
    return out


def _innocent(found: list[list[tuple]], toxic: list[int]) -> frozenset:
    """Forms within an edit of a term that are in two clean texts or more, and less than TIMES as frequent among toxic ones."""
    seen, n = (Counter(), Counter()), Counter(map(bool, toxic))
    for y, hits in zip(toxic, found):
        seen[bool(y)].update({h[4] for h in hits if h[0] == PLAIN and h[2]})
    return frozenset(w for w, k in seen[0].items() if k >= 2 and TIMES * k * n[True] > seen[1][w] * n[False])


def vocabulary(text: str) -> set[str]:
    """The words of a text in lower case, and their stems."""
    seen = set(_WORD.findall(text.lower()))
    return seen | {w[:k] + "*" for w in seen for k in STEMS if len(w) > k}


def mine(with_: dict[str, int], without: dict[str, int], n: tuple[int, int], tries: int) -> list[Term]:
    """Words and stems that are TIMES as frequent, by documents, among toxic texts, and not by chance; stems cover their words.

    with_, without: how many toxic and clean texts hold each candidate; n: clean and toxic texts in all.
    Chance: the terms of a text know nothing of its label, and every word and stem of the toxic
    texts is one of the tries; the odds of one at least must stay under CHANCE (a Chernoff bound for each).
    """
    with_, without = Counter({x: c for x, c in with_.items() if c >= LEAST}), Counter(without)
    if not all(n):
        return []
    share = n[1] / sum(n)

    def odds(x):
        return np.log((with_[x] + 0.5) / (n[1] + 1)) - np.log((without[x] + 0.5) / (n[0] + 1))

    def surprise(x):
        c, d = with_[x], without[x]
        p = c / (c + d)
        return c * np.log(p / share) + (d * np.log((1 - p) / (1 - share)) if d else 0.0)

    good = {x: c * odds(x) for x, c in with_.items() if odds(x) > np.log(TIMES) and surprise(x) > np.log(tries / CHANCE)}
    # a stem stands for many words, else its one word is the better term
    best: dict[str, float] = {}
    for x, v in good.items():
        for k in STEMS:
            if not x.endswith("*") and len(x) >= k:
                best[x[:k] + "*"] = max(best.get(x[:k] + "*", 0.0), v)
    good = {x: v for x, v in good.items() if not x.endswith("*") or v > 1.1 * best.get(x, 0.0)}
    # of stems that nearly the same texts hold, the longest
    longer = {x[:k] + "*" for x in good if x.endswith("*") for k in STEMS if k < len(x) - 1 and with_[x] >= 0.95 * with_[x[:k] + "*"]}
    good = {x: v for x, v in good.items() if x not in longer}
    chosen: list[str] = []
    # what is toxic most surely and often first; words that a stem covers already add nothing
    for x in sorted(good, key=lambda x: (-good[x], -len(x), x)):
        base = x.rstrip("*")
        if not any(base.startswith(c.rstrip("*")) and (c.endswith("*") or c == x) for c in chosen):
            chosen.append(x)
    plain = [c for c in chosen if not any(c != d and d.endswith("*") and c.rstrip("*").startswith(d[:-1]) for d in chosen)]
    return [Term(c.rstrip("*"), c.endswith("*")) for c in plain]


def _regress(x: np.ndarray, y: np.ndarray, share: np.ndarray, n_terms: int, rounds: int) -> tuple[float, np.ndarray, float]:
    """(loss, weights, bias) of a logistic regression on rows that count for their share."""
    w, b = np.zeros(x.shape[1]), 0.0
    w[:n_terms] = 1.0
    positive = np.append(np.arange(len(w) - 1) < n_terms, True)
    m = [np.zeros_like(w), np.zeros_like(w), 0.0, 0.0]
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        off = share * (p - y) / share.sum()
        gw, gb = x.T @ off + 1e-4 * w, off.sum()
        m[0], m[1] = 0.9 * m[0] + 0.1 * gw, 0.99 * m[1] + 0.01 * gw * gw
        m[2], m[3] = 0.9 * m[2] + 0.1 * gb, 0.99 * m[3] + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**k, 1 - 0.99**k
        w -= 0.1 * m[0] / c1 / (np.sqrt(m[1] / c2) + 1e-8)
        b -= 0.1 * m[2] / c1 / (np.sqrt(m[3] / c2) + 1e-8)
        np.maximum(w, 0.0, out=w, where=positive)  # a term is never a sign of clean text
    z = np.clip(x @ w + b, -30, 30)
    return float((share * (np.logaddexp(0, z) - y * z)).sum() / share.sum()), w, float(b)


def learn(terms: list[Term], auto: Automaton, found: list[list[tuple]], toxic: list[int], rounds: int = 400) -> Model:
    """Weights, discount and factors from the occurrences in labelled texts.

    Weights and discount come from the texts as they are and with their hits misspelled, half each;
    then, with these fixed, each window's factor from all texts and copies that hold such a window.
    """
    innocent = _innocent(found, toxic)
    copies: list[tuple[int, int, list]] = []  # (kind, label, hits)
    for y, hits in zip(toxic, found):
        kinds = {PLAIN: []}
        for kind, term, fuzzy, window, form, times in hits:
            kinds.setdefault(kind, [])
            if term >= 0 and not (fuzzy and form in innocent):
                kinds[kind].append((term, fuzzy, window, times))
        copies += [(kind, 0 if kind == MENTIONED else int(y), h) for kind, h in kinds.items()]
    even = (1.0,) * 8
    own = [c for c in copies if c[0] in (PLAIN, MISSPELLED)]
    doubled = [k + 1 < len(own) and own[k + 1][0] == MISSPELLED or c[0] == MISSPELLED for k, c in enumerate(own)]
    y, share = np.array([c[1] for c in own], dtype=np.float64), np.where(doubled, 0.5, 1.0)
    if not len(y) or not 0 < y.sum() < len(y):
        return Model(terms, auto, np.zeros(len(terms) + 2), (5.0 if y.all() else -5.0) if len(y) else 0.0, 1.0, even, innocent)

    def matrix(rows, discount, factors):
        return np.array([features(terms, h, discount, factors) for _, _, h in rows]).reshape(len(rows), len(terms) + 2)

    fits = [(*_regress(matrix(own, d, even), y, share, len(terms), rounds), d) for d in DISCOUNTS]
    _, w, b, discount = min(fits, key=lambda f: f[0])
    free = [k for k in range(8) if k & (QUOTED | REPORTED)]
    told = [c for c in copies if c[0] != MISSPELLED and any(h[2] in free for h in c[2])]
    label = np.array([c[1] for c in told])

    def loss(factors):
        z = np.clip(matrix(told, discount, factors) @ w + b, -30, 30)
        return float((np.logaddexp(0, z) - label * z).sum())

    factors = list(even)
    for _, k in product(range(2), free):
        if any(h[2] == k for c in told for h in c[2]):
            factors[k] = min(FACTORS, key=lambda v: (loss([*factors[:k], v, *factors[k + 1 :]]), -v))
    return Model(terms, auto, w, b, discount, tuple(factors), innocent)


def train(texts: list[str], toxic: list[int], rounds: int = 400) -> Model:
    """The model of a few texts that are at hand."""
    seen, n = (Counter(), Counter()), [0, 0]
    for t, y in dict.fromkeys(zip(texts, map(bool, toxic))):  # copies of a text count once
        seen[y].update(vocabulary(t))
        n[y] += 1
    terms = mine(seen[1], seen[0], tuple(n), len(seen[1]))
    auto = build(terms)
    return learn(terms, auto, occurrences(texts, terms, auto), toxic, rounds)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labels that are 0 or 1, from at most about sample_rows rows of either.

    Ids are sampled first, without their texts; only the sample's texts are then read, by a
    broadcast of its ids, which are as few as the sample. Words are counted and texts scanned in
    tasks; candidate terms and hits reach the driver, whatever the length of the texts.
    Ids in labels alone, null ids and null texts teach nothing.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    known = marks.join(rows.select("id"), "id", "left_semi")
    picked = [(r["id"], int(r["y"])) for y in (0, 1) for r in sampled(known.where(F.col("y") == y), ["id", "y"], sample_rows)]
    if not picked:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(sorted(set(picked)), f"id {dict(rows.dtypes)['id']}, y int")
    # an id that several rows share speaks with the text of the least hash
    got = stored(rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("y", "t", F.xxhash64("t").alias("h")), "labelled")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(vocabulary(t)))

    once = got.dropDuplicates(["y", "h"])  # copies of a text count once
    sizes = dict(map(tuple, once.groupBy("y").count().collect()))
    n = (sizes.get(0, 0), sizes.get(1, 0))
    counts = once.select("y", F.explode(words("t")).alias("x")).groupBy("x").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") == 0).alias("b"))
    counts = stored(counts.where("a > 0"), "terms")
    often = counts.where((F.col("a") >= LEAST) & ((F.col("a") + 0.5) / (n[1] + 1) > TIMES * (F.col("b") + 0.5) / (n[0] + 1))).collect()
    terms = mine({r["x"]: r["a"] for r in often}, {r["x"]: r["b"] for r in often}, n, counts.count())
    auto = build(terms)
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType() if c == "form" else T.IntegerType()) for c in ("copy", "term", "fuzzy", "window", "form", "times")]))

    @F.pandas_udf(kind)
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([o for a in range(0, len(texts), 64) for o in occurrences(list(texts.iloc[a : a + 64]), terms, auto)])

    told = sorted((int(r["y"]), r["h"], [tuple(o) for o in r["o"]]) for r in got.select("y", "h", hits("t").alias("o")).toLocalIterator())
    return learn(terms, auto, [r[2] for r in told], [r[0] for r in told])


def scorer(model: Model):
    """Column function: text -> struct(score, predicted, hits: array of struct(term, distance, start, end, quoted, share)); share is what the hit counts for, of a plain exact one."""
    names = {"term": T.StringType(), "distance": T.IntegerType(), "start": T.IntegerType(), "end": T.IntegerType(), "quoted": T.BooleanType(), "share": T.DoubleType()}
    hit = T.StructType([T.StructField(c, t) for c, t in names.items()])
    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("hits", T.ArrayType(hit))])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for a in range(0, len(texts), 256):
            part = [t or "" for t in texts.iloc[a : a + 256]]
            for t, hits in zip(part, scan(part, model.auto)):
                hits = meant(t, hits, model.terms, model.innocent)
                weighed = weigh(t, hits)
                z = features(model.terms, _windowed(weighed), model.discount, model.factors) @ model.weights + model.bias
                p = float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
                shares = [model.factors[w[2]] * (model.discount if h[1] else 1.0) for h, (w,) in zip(hits, ([*_windowed([x])] for x in weighed))]
                rows.append((p, int(p >= 0.5), [{"term": model.terms[h[0]].text, "distance": h[1], "start": h[2], "end": h[3], "quoted": w[2], "share": v} for h, w, v in zip(hits, weighed, shares)]))
        return pd.DataFrame(rows, columns=["score", "predicted", "hits"])

    return run


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `documents`; null and empty texts score as texts without hits."""
    text_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_rest("doc_id", 5) == 0
    model = fit(docs.where(~held), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", held.alias("held_out"), scorer(model)("text").alias("s")).select("doc_id", "held_out", "s.score", "s.predicted")
