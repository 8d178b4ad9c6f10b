"""Secret scans with a linear-chain conditional random field.

Base kinds (assign, access, hex) are fixed patterns. The field adds spans of kind "crf": the tokens of a run
without white space are tagged begin, inside or outside from their shape, the words around them and features
of the file, and the best sequence is found by Viterbi. A token is letters and digits with single marks of secrets'
alphabets (- _ + / . ~) between them, or one other character, so that a key of many pieces is one token. A token may begin a secret if its
class is in BEGINS or if it stands where a value of a keyword does (after "pwd:", "passphrase =", "Bearer" and the like), whatever
its class; runs without such a token are all outside and need not be decoded. This is part of the model, in training
as in decoding, and drops nothing. Padding ("=") right behind a found secret belongs to it.

Training: labels are the base spans of a bounded, hashed sample (SAMPLE_DOCUMENTS documents, of whose runs at most MOST_RUNS
are taken by a hash of the run, half of them such as hold a base span if there are as many, so that the sample does not depend on how rows lie) and
invented secrets of other families, made from a fixed seed, among look-alikes.

Defined cases: a null text is empty; an empty text has no spans; a null doc_id is kept as null; repeated rows
are scanned one by one; extra columns do not matter. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_text, map_rows, sample_rows, small_batches

SAMPLE_DOCUMENTS = 4000
#: Runs of the sample, about, on which the field is trained, and pairs of invented lines.
MOST_RUNS, INVENTED = 3000, 1500
PADDING = re.compile(r"={1,2}(?![^\s\"',;)])")
SEED = 11

# The base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter match fails, and none inside it is longer
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_HINTS = ("passw", "secret", "token", "api")

RUN = re.compile(r"\S+")
TOKEN = re.compile(r"[^\W_]+(?:[-_+/.~]+[^\W_]+)*|\S")
JOINS = re.compile(r"[-_+/.~]+")
KEYWORDS = frozenset("password passwd pwd passphrase secret token api apikey key auth bearer credential credentials private access pass authorization".split())
#: Lower-case text before a value: a keyword, what may close it, a separator, what may open the value; or the word of a header.
KEYED = re.compile(r"""(?:(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth(?:orization)?|credentials?)["']?\s{0,3}(?::=|=>|[:=])\s{0,3}|\b(?:bearer|basic)\s)["']?$""")
_KEY_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "basic")
_SEPARATOR = re.compile(r"[:=>]|(?:bearer|basic)(?=\s)")
BEGINS = frozenset(("mixed8", "mixed16", "digits16", "hex16", "oddcase12", "long24", "pieces8", "pieces16", "codes"))
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def token_class(t: str) -> str:
    n = len(t)
    if not t[0].isalnum():
        return "punct"
    if not t.isalnum():
        pieces = JOINS.split(t)
        core = "".join(pieces)
        if core.isdecimal():
            return "date"
        if not core.isascii() or not any(map(str.isdigit, core)):
            return "codes" if len(pieces) >= 3 and core.isupper() and len({len(x) for x in pieces}) == 1 and len(core) >= 12 else "words"
        return "pieces16" if len(core) >= 16 else "pieces8" if len(core) >= 8 else "pieces"
    if t.isdecimal():
        return "digits16" if n >= 16 else "digits"
    if t.isascii():
        if any(map(str.isdigit, t)):
            if n >= 16:
                return "hex16" if HEX.fullmatch(t) else "mixed16"
            return "mixed8" if n >= 8 else "mixed"
        if n >= 12 and not (t.islower() or t.isupper() or t[1:].islower()):
            return "oddcase12"
    return "long24" if n >= 24 else "word"


def keyed_places(text: str, low: str) -> set[int]:
    """Where values of keywords begin."""
    if not any(h in low for h in _KEY_HINTS):
        return set()
    if len(low) != len(text):  # a few capitals have longer small forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = set()
    for m in _SEPARATOR.finditer(low):
        at = m.end()
        while at < len(low) and at - m.end() < 4 and (low[at].isspace() or low[at] in "\"'"):
            at += 1
        if KEYED.search(low, max(0, at - 40), at):
            out.add(at)
    return out


def _entropy(t: str) -> float:
    return -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values())


def _turns(t: str) -> int:
    kind = [c.isdigit() * 2 + c.isupper() for c in t]
    return sum(a != b for a, b in zip(kind, kind[1:]))


def own_features(t: str) -> list[str]:
    """Of a token alone: class, rough length, rough entropy, changes between digits and letters."""
    c = token_class(t)
    pieces = JOINS.split(t)
    longest = max(map(len, pieces))
    plain = sum(x.isalpha() and x.isascii() and (x.islower() or x[1:].islower()) for x in pieces)  # pieces that may be words
    own = [f"c={c}|pieces={min(len(pieces), 6)}", f"c={c}|longest={min(longest // 3, 8)}", f"c={c}|plain={min(plain, 3)}|all={plain == len(pieces)}"]
    return [*own, f"c={c}", f"c={c}|len={min(len(t) // 4, 12)}", f"c={c}|H={int(2 * _entropy(t))}", f"c={c}|turns={min(_turns(t) // 2, 8)}", f"p={t}" if c == "punct" else f"a={''.join(sorted({'0' if x.isdigit() else 'A' if x.isupper() else 'a' for x in t}))}"]


def features(run: str, before: str, after: str, file: list[str], keyed: frozenset[int] | set[int] = frozenset()) -> tuple[list[tuple[int, int]], list[bool], list[list[str]]]:
    """Tokens of a run (start and end in it), whether each may begin a secret, and their features; before and after are the text around the run,
    keyed the places in it where values of keywords begin."""
    at = [m.span() for m in TOKEN.finditer(run)]
    tokens = [run[a:b] for a, b in at]
    left = [m.lower() for m in TOKEN.findall(before)[-6:]]
    right = TOKEN.findall(after)[:1]
    begins, out = [], []
    for k, t in enumerate(tokens):
        c = token_class(t)
        near = left + [x.lower() for x in tokens[max(0, k - 6) : k]]
        last = near[-1] if near else "^"
        follows = tokens[k + 1] if k + 1 < len(tokens) else (" " + right[0] if right else "$")
        f = own_features(t)
        value = at[k][0] in keyed
        f += [f"c={c}|value={value}", f"value={value}|len={min(len(t) // 3, 12)}", f"value={value}|digits={any(map(str.isdigit, t))}|last={k == len(tokens) - 1}"]
        f += [f"c={c}|keyword={any(not KEYWORDS.isdisjoint(JOINS.split(x)) for x in near[-6:])}", f"c={c}|prev={last if not last[0].isalnum() else token_class(last)}"]
        f += [f"c={c}|next={follows.strip() if not follows.strip()[0].isalnum() else token_class(follows.strip())}|gap={follows[0] == ' '}", f"c={c}|first={k == 0}"]
        f += [f"c={c}|{x}" for x in file]
        begins.append(c in BEGINS or value)
        out.append(f)
    return at, begins, out


def file_features(text: str) -> list[str]:
    """Of a whole text: its length and whether it speaks of keys."""
    low = text.lower()
    return [f"size={min(len(text).bit_length(), 20) // 3}", f"keys={any(h in low for h in ('password', 'secret', 'token', 'akia', 'private key'))}"]


class Field:
    """Weights of features and of transitions; tags are B, I, O; inside must follow begin or inside."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def emissions(self, feats: list[list[str]], begins: list[bool]) -> list[list[float]]:
        get, none, rows = self.weights.get, (0.0, 0.0, 0.0), []
        for f, may in zip(feats, begins, strict=True):
            w = [get(x, none) for x in f]
            row = [sum(x[y] for x in w) for y in range(3)]
            if not may:
                row[B] = -math.inf
            rows.append(row)
        return rows

    def viterbi(self, em: list[list[float]]) -> list[int]:
        """The best sequence; at equal scores the lower tag, B before I before O."""
        tr = self.trans
        best, back = [em[0][B], -math.inf, em[0][O]], []
        for row in em[1:]:
            step, now = [], []
            for y in range(3):
                score, arg = -math.inf, O
                for x in range(3):
                    s = -math.inf if y == I and x == O else best[x] + tr[x][y]
                    if s > score:
                        score, arg = s, x
                step.append(arg)
                now.append(score + row[y])
            back.append(step)
            best = now
        y = max(range(3), key=lambda k: (best[k], -k))
        path = [y]
        for step in reversed(back):
            y = step[y]
            path.append(y)
        return path[::-1]

    def spans(self, text: str, safe: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
        """Spans that the field finds in a whole text. safe: runs known to hold no beginning, kept between texts."""
        runs = text.split()
        safe = {} if safe is None else safe
        found, odd = [], False
        for r in runs:
            s = safe.get(r)
            if s is None:
                s = not any(token_class(t) in BEGINS for t in TOKEN.findall(r))
                if len(r) <= 40 and len(safe) < 200_000:
                    safe[r] = s
            if not s:
                odd = True
        keyed = keyed_places(text, text.lower())
        if not odd and not keyed:
            return found
        file, places, nxt = file_features(text), sorted(keyed), 0
        for m in RUN.finditer(text):
            r, (a, b) = m.group(), m.span()
            while nxt < len(places) and places[nxt] < a:
                nxt += 1
            here = nxt < len(places) and places[nxt] < b
            if not here and (safe[r] if r in safe else not any(token_class(t) in BEGINS for t in TOKEN.findall(r))):
                continue
            inner = {p - a for p in places[nxt:] if p < b} if here else frozenset()
            at, begins, feats = features(r, text[max(0, a - 80) : a], text[b : b + 40], file, inner)
            begin = None
            for (x, y), tag in zip(at, self.viterbi(self.emissions(feats, begins)), strict=True):
                if tag in (B, O) and begin is not None:
                    found.append((a + begin[0], a + begin[1], "crf"))
                    begin = None
                if tag != O:
                    begin = (x, y) if tag == B else (begin[0], y)
            if begin is not None:
                found.append((a + begin[0], a + begin[1], "crf"))
        padded = [(a, b + len(m.group()) if (m := PADDING.match(text, b)) else b, k) for a, b, k in found]
        return [(a, min(b, padded[i + 1][0]) if i + 1 < len(padded) else b, k) for i, (a, b, k) in enumerate(padded)]


def labelled(text: str, values: list[tuple[int, int]] | None = None) -> list[tuple[int, list[bool], list[list[str]], list[int]]]:
    """Runs of a text in which a secret may begin: their places, which tokens may begin one, features, and tags; from values, or else from the base spans."""
    if values is None:
        values = [(ASSIGN.match(text, a).start(2) if k == "assign" else a, b) for a, b, k in base_spans(text)]
    file, keyed, out = file_features(text), keyed_places(text, text.lower()), []
    for m in RUN.finditer(text):
        a, b = m.span()
        inner = {p - a for p in keyed if a <= p < b}
        if not inner and not any(token_class(t) in BEGINS for t in TOKEN.findall(m.group())):
            continue
        at, begins, feats = features(m.group(), text[max(0, a - 80) : a], text[b : b + 40], file, inner)
        tags, open_to = [], -1
        for (x, y), may in zip(at, begins, strict=True):
            inside = any(s <= a + x and a + y <= e for s, e in values)
            tags.append(I if inside and open_to == x else B if inside and may else O)
            open_to = y if tags[-1] != O else -1
        out.append((a, begins, feats, tags))
    return out


def invented(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with a secret, and the place of its value, by turns with lines of look-alikes that are none."""
    rng = random.Random(seed)
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda abc, k: "".join(rng.choice(abc) for _ in range(k))
    word = lambda: pick(small, rng.randint(2, 9))
    name = lambda: word() if rng.random() < 0.5 else word().title()
    mixed = lambda low, high: pick(rng.choice((small + digits, small + large + digits, large + digits)), rng.randint(low, high - 1)) + pick(digits, 1)
    keys = ("password", "secret", "token", "api_key", "apikey", "passwd", "pwd", "passphrase", "client_secret", "auth", "access-key", "private_key", "DB_PASSWORD", "Authorization", "credential")
    lines = []
    for _ in range(n):
        key, sep, q = rng.choice(keys), rng.choice((" = ", "=", ": ", ":", " := ")), rng.choice(("", "", '"', "'"))
        kind = rng.randrange(8)
        if kind <= 1:
            value = mixed(12, 44)
        elif kind == 2:  # pieces
            value = rng.choice("-_.").join(pick(small + large + digits, rng.randint(3, 8)) for _ in range(rng.randint(3, 6))) + pick(digits, 1)
        elif kind == 3:  # with marks of base 64
            value = "".join(pick(small + large + digits, rng.randint(4, 14)) + rng.choice("+/") for _ in range(rng.randint(2, 4))) + mixed(6, 20)
        elif kind == 4:  # short, with digits
            value = word() + pick(digits, rng.randint(1, 4))
        elif kind == 5:  # letters alone
            value = rng.choice(("", "-", "_")).join(word() for _ in range(rng.randint(3, 5)))
            key = rng.choice(("password", "pwd", "passphrase", "passwd", "DB_PASSWORD"))
        elif kind == 6:  # no keyword, but a tag of its kind
            key, sep, q, value = "", "", "", pick(small, rng.randint(2, 5)) + rng.choice("-_") + (pick(small, 4) + "_" if rng.random() < 0.4 else "") + mixed(18, 42)
        else:  # codes
            size = rng.randint(4, 5)
            key, sep, q, value = rng.choice(("", "key", "license")), " ", "", "-".join(pick(rng.choice((large, large + digits)), size) for _ in range(rng.randint(4, 5)))
        lead = f"{name()} {name()} {key}{sep}{q}"
        lines.append((f"{lead}{value}{q}{rng.choice(('', ' ', ', ', ';'))} {name()} {name()}", [(len(lead), len(lead) + len(value))]))
        plain = rng.choice((
            word() + pick(digits, 2), f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}", name().title() + word().title() + pick(digits, 1), pick(digits, 3) + "." + pick(digits, 3), f"v{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 1)}",
            word() * 4, f"item{pick(digits, 5)}", f"{word()}{pick(digits, 4)}@{word()}.com", f"https://{word()}.com/{word()}/{word()}{pick(digits, 5)}", f"{word()}-{word()}-{word()}", f"{word()}/{word()}_{pick(digits, 2)}.txt", f"{word().title()}{word().title()}{word().title()}",
            f"{rng.choice(keys)}: {word()} {word()}", f"the {rng.choice(keys)} = none", f"the {key}{sep}{word()}{rng.choice(('', ',', '.', ';'))} {word()}", f"{key}{sep}{word()}{rng.choice(('', ',', '.', ';'))}", f"{rng.choice(('key', 'token', 'auth'))}: {pick(digits, 2)}", f"+{pick(digits, 2)}-{pick(digits, 3)}-{pick(digits, 7)}", f"{pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)}", f"{word()}-{pick(digits, 4)}", f"{word()}{pick(digits, 3)}.{word()}.org/{word()}", f"{pick(digits, 2)}:{pick(digits, 2)}:{pick(digits, 2)}", f"{pick(large, 3)}-{pick(digits, 4)}",
            f"{word()}.{word()}.{word()}", f"{word().upper()}-{word().upper()}", f"{pick(digits, 3)}-{pick(digits, 1)}-{pick(digits, 5)}-{pick(digits, 3)}-{pick(digits, 1)}",
        ))
        lines.append((f"{name()} {name()} {plain} {name()} {name()}", []))
    return lines


def marginals(em: np.ndarray, trans: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition of each run, and the probabilities of its tags and of its pairs of tags; forward and backward in log space, runs padded at their ends."""
    s, n, _ = em.shape
    add = lambda a, axis: np.log(np.exp(a - (m := a.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
    fwd, bwd = np.zeros((s, n, 3)), np.zeros((s, n, 3))
    fwd[:, 0] = em[:, 0]
    for j in range(1, n):
        nxt = add(fwd[:, j - 1, :, None] + trans, 1) + em[:, j]
        fwd[:, j] = np.where(real[:, j, None], nxt, fwd[:, j - 1])
    for j in range(n - 2, -1, -1):
        nxt = add(trans + (em[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
        bwd[:, j] = np.where(real[:, j + 1, None], nxt, 0)
    z = add(fwd[:, -1], 1)
    p = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
    q = np.exp(fwd[:, :-1, :, None] + trans + (em[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
    return z, p, q


def train(runs: list[tuple[list[bool], list[list[str]], list[int]]], steps: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge, by Adam over all runs at once."""
    runs = [(c[:24], f[:24], t[:24]) for c, f, t in runs if f]  # only here are runs cut; decoding takes them whole
    names: dict[str, int] = {}
    for _, feats, _ in runs:
        for f in feats:
            for x in f:
                names.setdefault(x, len(names) + 1)
    if not runs:
        return Field({}, np.zeros((3, 3)))
    s, n = len(runs), max(len(t) for _, _, t in runs)
    width = max(len(f) for _, fs, _ in runs for f in fs)
    x, y, real = np.zeros((s, n, width), np.int32), np.full((s, n), O), np.zeros((s, n), bool)
    block = np.zeros((s, n, 3))
    for i, (begins, feats, tags) in enumerate(runs):
        for j, (may, f, t) in enumerate(zip(begins, feats, tags, strict=True)):
            x[i, j, : len(f)] = [names[k] for k in f]
            y[i, j], real[i, j] = t, True
            if not may:
                block[i, j, B] = -1e9
    block[:, 0, I] = -1e9
    ban = np.zeros((3, 3))
    ban[O, I] = -1e9
    w, tr = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    m1 = [np.zeros_like(w), np.zeros_like(tr)]
    m2 = [np.zeros_like(w), np.zeros_like(tr)]
    one = np.eye(3)[y] * real[..., None]
    seen = np.einsum("sna,snb->ab", one[:, :-1] * real[:, 1:, None], one[:, 1:])
    at, which = x[real], np.nonzero(real.ravel())[0]  # (tokens, width): padding is left out
    for step in range(1, steps + 1):
        em = np.zeros((s * n, 3))
        em[which] = w[at].sum(1)
        _, p, q = marginals(em.reshape(s, n, 3) + block, tr + ban, real)
        diff = (one - p).reshape(-1, 3)[which]
        gw = np.zeros_like(w)
        for tag in range(3):
            gw[:, tag] = np.bincount(at.ravel(), np.repeat(diff[:, tag], width), len(w))
        gw[0] = 0
        for k, (v, g) in enumerate(((w, gw / s - ridge * w), (tr, (seen - q.sum((0, 1))) / s - ridge * tr))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            v += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return Field({k: tuple(map(float, w[i])) for k, i in names.items()}, tr)


def fit(docs: DataFrame, sample: int = SAMPLE_DOCUMENTS, most: int = MOST_RUNS) -> Field:
    """The field, trained on the base spans of a sample and on invented lines. At most `most` runs come to the driver, chosen by hashes of their texts and
    places, of which half are kept for runs with a secret."""
    picked = bytes_text(sample_rows(docs, "doc_id", sample, SEED))

    def start(low: dict[bool, int] | None):
        def batch(rows):
            out: dict[str, list] = {"secret": [], "h": [], "begins": [], "feats": [], "tags": []}
            for text in rows["text"]:
                seed = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                for at, begins, feats, tags in labelled(text):
                    h, secret = xxhash.xxh3_64_intdigest(at.to_bytes(8, "little"), seed) >> 2, B in tags
                    if low is not None and h > low[secret]:
                        continue
                    for k, v in zip(out, (secret, h, begins, feats, tags), strict=True):
                        out[k].append(v)
            return out if low is not None else {k: out[k] for k in ("secret", "h")}

        return batch

    hashes = map_rows(picked, "secret boolean, h long", lambda: start(None))
    total = {r.secret: r.n for r in hashes.groupBy("secret").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = {True: min(total.get(True, 0), most // 2)}
    room[False] = most - room[True]
    low = {k: (1 << 62) - 1 if total.get(k, 0) <= room[k] else (1 << 62) * room[k] // total[k] for k in (True, False)}
    rows = map_rows(picked, "secret boolean, h long, begins array<boolean>, feats array<array<string>>, tags array<int>", lambda: start(low)).collect()
    runs = [(r.begins, r.feats, r.tags) for r in sorted(rows, key=lambda r: (r.h, repr(r.feats)))]
    made = [x[1:] for line, values in invented(INVENTED) for x in labelled(line, values)]
    return train(runs + made)


def _covered(span: tuple[int, int, str], base: list[tuple[int, int, str]]) -> bool:
    at = span[0]
    for a, b, _ in base:  # by start
        if a > at:
            break
        at = max(at, b)
    return at >= span[1]


def scan(text: str, field: Field, safe: dict[str, bool] | None = None) -> tuple[list, list]:
    """Base spans, and all spans: a span of the field that base spans cover is left out."""
    base = base_spans(text)
    extra = [s for s in field.spans(text, safe) if not _covered(s, base)]
    return base, sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_report(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each document: counts of the base kinds, their digest, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))

    def start():
        model, safe = shared.value, {}

        def batch(rows):
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")}
            for text in rows["text"]:
                base, spans = scan(text, model, safe)
                n = Counter(k for _, _, k in spans)
                for k in ("assign", "access", "hex", "crf"):
                    out[f"n_{k}"].append(n[k])
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return {"doc_id": rows["doc_id"], **out}

        return batch

    return map_rows(bytes_text(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long", start)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, overlapping ones as one, replaced by <secret>; of an assignment the name stays."""
    out, end = [], 0
    for a, b, k in spans:
        if k == "assign":
            a = ASSIGN.match(text, a).start(2)
        if a >= end:
            out += [text[end:a], "<secret>"]
            end = b
        else:
            end = max(end, b)
    return "".join(out) + text[end:]


def redact_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with secrets replaced in text and, where there is such a column, n_chars counted anew; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    small_batches(docs.sparkSession)
    safe: dict[str, bool] = {}

    @F.pandas_udf("string")
    def clean(texts):
        model = shared.value
        return texts.map(lambda x: x if x is None else redact(x, scan(x, model, safe)[1]))

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
