"""Personal data: spans of fixed formats, and spans that a linear-chain random field adds.

The field labels words (outside, email, phone, name) from their shape, a short lexicon and the two
words on either side.  It is trained here from a small labelled table and decoded by Viterbi over
whole batches: the words of a batch are one chain whose steps across documents do not depend on the
label before, cut into columns that are followed from every label at once.  So no text is too long and
none is cut short.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, slices, words

#: Fixed values of the contract: kinds in the order of the report, and characters of the local part.
KINDS = ("email", "ip", "card", "phone", "name")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(WORD)

#: Labels of the field; 0 is outside.
LABELS = ("", "email", "phone", "name")
#: At most so many labelled rows are used for training.
MAX_TRAIN = 5000
_BATCH = 4 << 20
#: Length of the columns of a decoded batch.
_COLUMN = 64
_REACH = (-2, -1, 0, 1, 2)

#: Word lists of the lexicon, fixed values.
LEXICON = {
    "title": "mr mrs ms miss dr prof sir madam herr frau monsieur madame mme mlle señor señora sr sra don doña".split(),
    "first": (
        "anna maria james mary john robert linda michael david susan thomas sarah daniel laura peter martin julia "
        "stefan klaus jürgen sabine monika hans petra andreas claudia pierre marie jean claire luc sophie antoine camille carlos "
        "josé juan lucía carmen miguel elena pablo isabel emily oliver emma sophia liam noah paul markus katharina").split(),
    "call": "call phone tel telephone telefon mobile mobil handy fax dial ring ruf rufen téléphone tél portable appelez teléfono móvil llame".split(),
    "mail": "mail email e-mail write schreib schreiben adresse address courriel correo contact kontakt contactez escriba".split(),
    "at": ["at", "arroba", "ät"],
    "dot": ["dot", "punkt", "point", "punto"],
    "zone": "com org net de fr es eu info".split(),
    "self": "named name signed regards heißt heiße appelle llamo nom nombre gezeichnet".split(),
    "money": "eur euro euros usd dollars percent prozent version section page seite chapter no nr year jahr in".split(),
}
_CLASS = {w: k for k, ws in LEXICON.items() for w in ws}
_TRIM = ".,;:!?\"'()[]{}<>*&%#$|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one ``@``, so each is tried once, from the first local character before it."""
    low, at = 0, text.find("@")
    while at >= 0:
        head = text[low:at]
        start = low + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", max(low, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed formats, sorted; time grows with the length of the text."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        ends = []
        for p in parts:
            ends.append((at, at + len(p), p))
            at += len(p) + 1
        for i in range(0, len(parts) - 3, 4):
            # long runs of digits are no numbers up to 255, but for leading zeros
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for _, _, p in ends[i:i + 4]):
                out.append((ends[i][0], 1, ends[i + 3][1]))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def report(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- the labelled table ----------------------------------------------------------------------------

#: Labelled sentences: {n} is a name, {p} a phone number, {e} a spelled address, {w} any words.
SENTENCES = """
please ask Mr {n} about the {w} before noon
Dear Mrs {n}, thank you for the {w}.
{w}. Regards, {n}
my name is {n} and I live near {w}
Dr. {n} signed the {w} in 1998
{w} was written by {n}, who lives here
you can call {p} after six or write to {e}
Phone: {p} {w}
Tel. {p}, fax {p}
{w} ({p}) {w}
mail me: {e} {w}
contact {n} at {p} {w}
{w} {e} {w}
Herr {n} wohnt bei {w} und Telefon {p}
Frau {n} schreibt an {e}, {w}
ich heiße {n}, {w}.
Madame {n} appelez {p} {w}
je m'appelle {n} et {w}
la señora {n} vive en {w}, teléfono {p}
me llamo {n} {w}. Correo {e}
signed {n} on page 12 of {w}
{w} {n} {w}
""".strip().splitlines()

#: Sentences without personal data.
PLAIN = """
{w}.
{W} {w}, {w}. {W} {w}
{W} {W}. {W} {w} {w}
{U} {U}!! {U}, {U} {U}
Licensed under the {W} License, Version 2.0.
token = "{h}" {w}
{w} {d}.{d}.{d}.{d} {w}
{w} {c} {w}
{w} in 1984 and 2021-03-04, page 17 of 250
he arrived at {w} in 1999
look at {w} and {w} at {w}
{W} {w} at {w}. The {W} of {W}
costs 120,50 EUR or 1.250.000 dollars, {w}
{w} | {w} | {W} | {w}
{w}&&& {w}### {W}*** {w}%%%
{W} {w} Section 4.2.1 and chapter 12
call the {w} by name, {w}
the phone of {w} and the mail of {w}
at 10:30 on 12/05/2020 {w}
(c) 2014 {W} {w}, all rights
{W} der {w}. Und {W} {w} Die {W}
{w} by. {W} {w}, {w} from. {W} {w}
{w} {w}. A. {W} {w}. Y. {W} {w}
from {W} to {W} {w} by {W}, von {W}
""".strip().splitlines()

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ti le la oi ion eau que men ci sch ung ge ver zu do ña ez".split()
#: A last name stands alone only after one of these.
TITLES = ("mr", "mrs", "dr.", "herr", "frau", "madame", "señora")
_LAST = "smith miller garcia berg weber hoffmann martin dubois moreau lopez torres king young walker huber gruber novak rossi klein wolf".split()


def _number(rng: random.Random, *lengths: int) -> list[str]:
    return ["".join(rng.choice("0123456789") for _ in range(n)) for n in lengths]


def _phone(rng: random.Random) -> str:
    a, b, c, d = _number(rng, 3, 3, 4, 2)
    return rng.choice([
        f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b} {c}", f"0{a}/{b}{c}", f"0{a[:1]} {d} {b[:2]} {c[:2]} {c[2:]}", f"0{a} {c}{b}",
        f"00{d} {a} {b} {c}", f"{a}.{b}.{c}", f"0{a}-{c}{b}"])


def labelled_rows(seed: int = 11, each: int = 14) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: ``each`` fillings of every sentence, with the spans of what was filled in."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    firsts = [w.capitalize() for w in LEXICON["first"]]

    def name(titled: bool) -> str:
        last = rng.choice(_LAST).capitalize() if rng.random() < 0.5 else word().capitalize()
        return rng.choice([f"{rng.choice(firsts)} {last}"] * 4 + [f"{rng.choice(firsts)} {rng.choice('ABCDEFGH')}. {last}"] + [last] * titled)

    def address() -> str:
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("AT", "DOT"), ("arroba", "punto"), ("at", "punkt")])
        user = rng.choice([word(), f"{word()}.{word()}", f"{word()}{rng.randint(1, 99)}", f"{word()} {dot} {word()}"])
        return f"{user} {at} {word()} {dot} {rng.choice(LEXICON['zone'])}"

    fill = {
        "p": lambda: _phone(rng), "e": address, "w": lambda: " ".join(word() for _ in range(rng.randint(1, 5))),
        "W": lambda: word().capitalize(), "U": lambda: word().upper(), "h": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        "d": lambda: str(rng.randint(0, 255)), "c": lambda: _number(rng, 16)[0],
    }
    kinds, out = {"n": "name", "p": "phone", "e": "email"}, []
    for pattern in [*SENTENCES, *PLAIN]:
        for _ in range(each):
            text, spans = "", []
            for part in re.split(r"(\{\w\})", pattern):
                new = name(any(t in text.lower().split() for t in TITLES)) if part == "{n}" else fill[part[1]]() if part[:1] == "{" else part
                if part[:1] == "{" and part[1] in kinds:
                    spans.append((kinds[part[1]], len(text), len(text) + len(new)))
                text += new
            out.append((text, spans))
    return out


def labelled(spark: SparkSession) -> DataFrame:
    """``text, spans``: the labelled table as a frame."""
    return spark.createDataFrame(labelled_rows(), "text string, spans array<struct<kind:string,start:int,end:int>>")


# ---- features --------------------------------------------------------------------------------------

_SHAPE = (
    (r"\p{Ll}+", "x"), (r"\p{Lu}{2,}", "XX"), (r"\p{Lu}", "X"), (r"[^\x00-\x7F]+", "u"),
    (r"[0-9]{5,}", "99999"), (r"[0-9]", "9"), (r"[^xXu9@.()+/:-]+", "_"), (r"\.\.+", "."))


def word_codes(vocab: pa.Array) -> pa.Array:
    """``shape, tab, class`` of each word; few distinct ones, however large the vocabulary."""
    shape = vocab
    for pattern, by in _SHAPE:
        shape = pc.replace_substring_regex(shape, pattern=pattern, replacement=by)
    keys = pa.array(list(_CLASS))
    at = pc.index_in(pc.utf8_trim(pc.utf8_lower(vocab), characters=_TRIM), value_set=keys)
    kind = pc.fill_null(pc.take(pa.array(list(_CLASS.values())), at), "")
    return pc.binary_join_element_wise(shape, kind, "\t")


def features(code: str) -> list[str]:
    shape, kind = code.split("\t")
    digits = shape.count("9")
    out = ["bias", f"class={kind}", f"digits={min(digits, 12)}"]
    if len(shape) <= 12:
        out.append(f"shape={shape}")
    core = shape.strip("_.():-")
    out.append("case=" + ("lower" if core == "x" else "title" if core == "Xx" else "upper" if core in ("XX", "X") else "number" if digits and core.strip("9.-/()") == "" else "mixed"))
    out.append(f"case&class={out[-1][5:]}&{kind}")
    out.append("ends" if shape[-1:] in ("_", ".", ":") else "runs on")
    out.append("opens" if shape[:1] == "(" else "plain start")
    if "@" in shape:
        out.append("has @")
    if digits and "x" in shape.lower():
        out.append("letters and digits")
    return out


@dataclass
class Field:
    """Weights of every feature at each place around a word, and of labels that follow each other."""

    names: dict[str, int]
    weights: np.ndarray  # place, feature, label
    follow: np.ndarray
    start: np.ndarray

    def table(self, codes: list[str]) -> np.ndarray:
        """``(place, code, label)`` scores; the last code stands for the outside of a text."""
        k = self.weights.shape[2]
        out = np.zeros((len(_REACH), len(codes) + 1, k))
        for c, code in enumerate(codes):
            at = [self.names[f] for f in features(code) if f in self.names]
            out[:, c] = self.weights[:, at].sum(1)
        out[:, -1] = self.weights[:, self.names["outside"]]
        return out


def scores(table: np.ndarray, code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Score of every label at every word of a batch; words of other documents count as outside."""
    n, out = len(code), np.zeros((len(code), table.shape[2]))
    for place, step in enumerate(_REACH):
        near = np.full(n, table.shape[1] - 1)
        lo, hi = max(0, -step), n - max(0, step)
        if hi > lo:
            same = doc[lo:hi] == doc[lo + step:hi + step]
            near[lo:hi] = np.where(same, code[lo + step:hi + step], near[lo:hi])
        out += table[place][near]
    return out


def viterbi(score: np.ndarray, first: np.ndarray, follow: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best label of every word of a chain; at ``first`` words the label before does not matter.

    The chain is cut into columns.  Each is followed from each label before it, all columns side by
    side; then the columns are joined one after the other and read backwards.
    """
    n, k = score.shape
    if n == 0:
        return np.zeros(0, np.int8)
    cols = -(-n // _COLUMN)
    e = np.zeros((cols * _COLUMN, k))
    e[:n] = score
    fresh = np.ones(cols * _COLUMN, bool)
    fresh[:n] = first
    e, fresh = e.reshape(cols, _COLUMN, k).transpose(1, 2, 0), fresh.reshape(cols, _COLUMN).T
    back = np.zeros((_COLUMN, k, k, cols), np.int8)
    best = np.zeros((k, k, cols))  # label before the column, label now
    for t in range(_COLUMN):
        step = np.where(fresh[t], start[None, :, None], follow[:, :, None])
        if t == 0:
            best = step + e[0][None]
            continue
        top = best[:, 0, None] + step[None, 0]
        arg = np.zeros(top.shape, np.int8)
        for j in range(1, k):
            cand = best[:, j, None] + step[None, j]
            more = cand > top
            np.copyto(top, cand, where=more)
            arg[more] = j
        best, back[t] = top + e[t][None], arg
    came = np.zeros((cols, k), np.int64)
    v = np.zeros(k)
    for b, m in enumerate(np.moveaxis(best, 2, 0)):
        total = v[:, None] + m
        came[b] = total.argmax(0)
        v = total.max(0)
        v = v - v.max()
    end = np.zeros(cols, np.int64)
    entry = np.zeros(cols, np.int64)
    now = int(v.argmax())
    for b in range(cols - 1, -1, -1):
        end[b], now = now, int(came[b, now])
        entry[b] = now
    labels = np.zeros((_COLUMN, cols), np.int8)
    labels[-1] = end
    every = np.arange(cols)
    for t in range(_COLUMN - 1, 0, -1):
        labels[t - 1] = back[t, entry, labels[t], every]
    return labels.T.reshape(-1)[:n]


# ---- training --------------------------------------------------------------------------------------


def train(table: DataFrame, most: int = MAX_TRAIN, rounds: int = 150, decay: float = 0.02) -> Field:
    """Fits the field to ``text, spans`` rows by gradient ascent of the regularised likelihood.

    The first ``most`` rows by digest of their text are used; that bound is what the driver holds.
    """
    rows = table.filter(F.col("text").isNotNull()).orderBy(F.md5("text"), "text").limit(most).collect()
    return fit([(r["text"], [tuple(s) for s in r["spans"]]) for r in rows], rounds, decay)


def _tokens(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[list[list[str]], list[list[int]]]:
    texts, labels = [], []
    for text, spans in rows:
        ms = list(_WORD.finditer(text))
        texts.append([m[0] for m in ms])
        labels.append([next((LABELS.index(k) for k, s, e in spans if m.start() < e and s < m.end()), 0) for m in ms])
    return texts, labels


def fit(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 150, decay: float = 0.02) -> Field:
    texts, gold = _tokens(rows)
    texts, gold = zip(*[(t, g) for t, g in zip(texts, gold) if t]) if any(texts) else ([["a"]], [[0]])
    code = word_codes(pa.array([w for t in texts for w in t])).dictionary_encode()
    kinds, flat = code.dictionary.to_pylist(), code.indices.to_numpy()
    names = {"outside": 0}
    for c in kinds:
        for f in features(c):
            names.setdefault(f, len(names))
    phi = np.zeros((len(kinds) + 1, len(names)))
    for i, c in enumerate(kinds):
        phi[i, [names[f] for f in features(c)]] = 1
    phi[-1, 0] = 1
    n, k, long = len(texts), len(LABELS), max(map(len, texts))
    size = np.array([len(t) for t in texts])
    live = np.arange(long)[None] < size[:, None]
    codes = np.full((n, long + 4), len(kinds))
    codes[:, 2:-2][live] = flat
    want = np.zeros((n, long, k))
    want[live, np.concatenate([np.array(g) for g in gold])] = 1
    pairs = np.einsum("nti,ntj->ij", want[:, :-1], want[:, 1:])
    weights, follow, start = np.zeros((len(_REACH), len(names), k)), np.zeros((k, k)), np.zeros(k)
    params = [weights, follow, start]
    mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for it in range(1, rounds + 1):
        e = sum((phi @ weights[p])[codes[:, 2 + s:2 + s + long]] for p, s in enumerate(_REACH))
        grow = np.exp(follow)
        alpha, beta, scale = np.zeros((n, long, k)), np.ones((n, long, k)), np.ones((n, long))
        top = e.max(2, keepdims=True)
        like = np.exp(e - top)
        for t in range(long):
            a = (np.exp(start) if t == 0 else alpha[:, t - 1] @ grow) * like[:, t]
            scale[:, t] = a.sum(1)
            alpha[:, t] = a / scale[:, t, None]
        for t in range(long - 2, -1, -1):
            b = (like[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]) @ grow.T
            beta[:, t] = np.where(live[:, t + 1, None], b, 1.0)
        post = alpha * beta * live[:, :, None]
        right = like[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * live[:, 1:, None]
        both = np.einsum("nti,ntj->ij", alpha[:, :-1], right) * grow
        diff = want - post
        grads = [np.zeros_like(weights), pairs - both, diff[:, 0].sum(0)]
        for p, s in enumerate(_REACH):
            seen = np.zeros((len(kinds) + 1, k))
            np.add.at(seen, codes[:, 2 + s:2 + s + long].ravel(), diff.reshape(-1, k))
            grads[0][p] = phi.T @ seen
        for q, (w, g) in enumerate(zip(params, grads)):
            g = g / n - decay * w / n
            mean[q] = 0.9 * mean[q] + 0.1 * g
            var[q] = 0.999 * var[q] + 0.001 * g * g
            w += 0.1 * (mean[q] / (1 - 0.9 ** it)) / (np.sqrt(var[q] / (1 - 0.999 ** it)) + 1e-8)
    return Field(names, weights, follow, start)


# ---- spans of a batch ------------------------------------------------------------------------------


def label_words(field: Field, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(label of every word, bounds of each text's words)``."""
    vocab, code, offs = words(texts)
    kinds = word_codes(pa.array(vocab, pa.string())).dictionary_encode()
    of = kinds.indices.to_numpy()
    table = field.table(kinds.dictionary.to_pylist())
    doc = np.repeat(np.arange(len(texts)), np.diff(offs))
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    return viterbi(scores(table, of[code] if len(code) else code, doc), first, field.follow, field.start), offs


_AT, _DOT = ({w for w in LEXICON[k]} for k in ("at", "dot"))


def _trimmed(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """A labelled stretch without punctuation around it, or nothing if it cannot be what it is labelled."""
    keep = (lambda c: c.isdigit() or c == "(") if kind == "phone" else str.isalnum
    while start < end and not keep(text[start]):
        start += 1
    while start < end and not text[end - 1].isalnum():
        end -= 1
    part = text[start:end]
    if kind == "phone":
        good = 7 <= sum("0" <= c <= "9" for c in part) <= 15 and not any(c.isalpha() for c in part)
    elif kind == "name":
        good = any(c.isupper() for c in part) and not any(c.isdigit() for c in part)
    else:
        bare = [w.strip(_TRIM).lower() for w in part.split()]
        good = ("@" in part or not _AT.isdisjoint(bare)) and ("." in part or not _DOT.isdisjoint(bare))
    return (start, end) if good and part else None


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of equally labelled words as ``(start, kind, end)``, where no base span is."""
    out = []
    at = [m.span() for m in _WORD.finditer(text)]
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    taken = np.array([(s, e) for s, _, e in base], np.int64).reshape(-1, 2)
    for i, j in zip(cuts, cuts[1:]):
        if i < j and labels[i]:
            kind = LABELS[labels[i]]
            got = _trimmed(text, at[i][0], at[j - 1][1], kind)
            if got and not ((taken[:, 0] < got[1]) & (got[0] < taken[:, 1])).any():
                out.append((got[0], KINDS.index(kind), got[1]))
    return out


def _finder(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _BATCH):
            texts = pc.fill_null(b.column("text"), "")
            labels, offs = label_words(field, texts)
            marked = np.concatenate([[0], np.cumsum(labels > 0)])[offs]
            likely = pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False)
            n, hashes, joined = np.zeros((4, len(texts)), np.int64), [], []
            for i in range(len(texts)):
                base, more = [], []
                if likely[i] or marked[i + 1] > marked[i]:
                    text = texts[i].as_py()
                    base = base_spans(text)
                    for _, k, _ in base:
                        n[k, i] += 1
                    if marked[i + 1] > marked[i]:
                        more = added_spans(text, labels[offs[i]:offs[i + 1]], base)
                hashes.append(hashlib.sha256(report(base).encode()).hexdigest())
                joined.append(report(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c) for c in n), pa.array(hashes, pa.string()), pa.array(joined, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row, where it is read.

    The counts and the digest are those of the fixed formats; ``spans`` has also what the field adds
    (emails and phone numbers in other spellings, and names) where no base span is, all by start, then kind in
    the order of ``KINDS``, then end.  Null and empty texts have none; equal rows are rows each; a null id stays;
    a text of any length is decoded whole, in a batch of its own; an empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(
        _finder(field), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), train(labelled(spark)))
