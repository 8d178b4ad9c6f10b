"""Quality rules as a short-circuit cascade.

Each rule reads a few features of a text. On a hashed sample of documents the cost of every feature is timed
and every rule's verdict is noted; rules are then put in the order of rejections, among what earlier rules
let pass, per second that the rule adds (features that are known already are free). Where other rules or a report stand
before the cascade, costs and rejections are those among the documents that these let pass, and what they have computed is free. A document
leaves the cascade at its first rejection. The verdict does not depend on the order, only the work does.

Defined cases: a null text is empty; an empty text has no words and fails; a null doc_id is kept as null;
repeated rows are judged one by one; extra columns do not matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import bytes_text, map_rows, sample_rows, small_batches

#: Documents, about, on which costs and rejections are estimated.
SAMPLE_DOCUMENTS = 1000
SYMBOLS = b"[#*$%&|<>]"
_NO_SYMBOLS = bytes(SYMBOLS[1:-1])
_CAPITALS, _UPPER = bytes(range(65, 91)), regex.compile(r"\p{Lu}").findall
_SPACE = b" \t\n\r\x0b\x0c"


class Text:
    """Features of one text, each computed when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode("utf-8", "surrogatepass")

    def __getattr__(self, name: str):
        value = FEATURES[name](self)
        setattr(self, name, value)
        return value


def _repeat_words(t: Text) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(t.words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in t.words), np.int64, n)
    _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= twice
    return int(covered.sum())


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


FEATURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.raw.split(),  # bytes.split() takes exactly \x20 and \x09-\x0D as space
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - (len(t.raw) - len(t.raw.translate(None, _SPACE))),
    "n_symbols": lambda t: len(t.raw) - len(t.raw.translate(None, _NO_SYMBOLS)),
    "n_lines": lambda t: sum(1 for x in t.raw.split(b"\n") if x.strip(_SPACE)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_upper": lambda t: len(t.raw) - len(t.raw.translate(None, _CAPITALS)) if t.text.isascii() else len(_UPPER(t.text)) if t.text.lower() != t.text else 0,
    "n_alpha": lambda t: sum(map(str.isalpha, t.text)),
}


@dataclass(frozen=True)
class Rule:
    """rejects(text) is true for a bad text; needs names the features that it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Text], bool]


#: Rejections that the base asks for.
BASE_RULES = (
    Rule("few_words", ("words", "n_words"), lambda t: t.n_words < 50),
    Rule("repeated_windows", ("words", "n_words", "n_repeat_words"), lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)
#: Further rejections: junk symbols, repeated lines, shouting, word lengths and letters outside those of prose.
MORE_RULES = (
    Rule("symbols", ("words", "n_words", "n_symbols"), lambda t: 100 * t.n_symbols > 30 * t.n_words),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda t: 100 * t.n_dup_lines > 50 * t.n_lines),
    Rule("shouting", ("n_upper", "n_alpha"), lambda t: 100 * t.n_upper > 60 * t.n_alpha),
    Rule("word_length", ("words", "n_words", "word_chars"), lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words),
    Rule("letters", ("word_chars", "n_alpha"), lambda t: 100 * t.n_alpha < 50 * t.word_chars),
)
RULES = BASE_RULES + MORE_RULES
#: Features of which the report tells for every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_DOCUMENTS, before: tuple[Rule, ...] = (), known: tuple[str, ...] = ()) -> tuple[dict[str, float], list[int]]:
    """Seconds of each feature and, for each document of the sample that no rule before rejects, the rejecting rules as bits. Features that are
    known are computed first and cost nothing."""
    names = [n for n in dict.fromkeys(n for r in rules for n in r.needs) if n not in known]

    def start():
        def batch(rows):
            spent, bits = np.zeros(len(names)), []
            for text in rows["text"]:
                t = Text(text)
                if any(r.rejects(t) for r in before):
                    continue
                for n in known:
                    getattr(t, n)
                for i, n in enumerate(names):
                    began = time.perf_counter()
                    getattr(t, n)
                    spent[i] += time.perf_counter() - began
                bits.append(sum(bool(r.rejects(t)) << k for k, r in enumerate(rules)))
            return {"spent": [spent.tolist()], "bits": [bits]}

        return batch

    found = map_rows(bytes_text(sample_rows(docs, "doc_id", sample)), "spent array<double>, bits array<long>", start).collect()
    spent = np.sum([r.spent for r in found], axis=0) if found else np.zeros(len(names))
    return dict(zip(names, spent, strict=True)), [b for r in found for b in r.bits]


def ordered(rules: tuple[Rule, ...], spent: dict[str, float], bits: list[int]) -> list[Rule]:
    """Greedy: next comes the rule with most rejections among the survivors per second that it adds; features without a cost are free."""
    left, out, known, alive = list(range(len(rules))), [], set(), list(bits)
    while left:
        def worth(k: int) -> tuple[float, int]:
            cost = sum(spent.get(n, 0.0) for n in set(rules[k].needs) - known) + 1e-9
            return sum(b >> k & 1 for b in alive) / cost, -k

        best = max(left, key=worth)
        left.remove(best)
        out.append(rules[best])
        known |= set(rules[best].needs)
        alive = [b for b in alive if not b >> best & 1]
    return out


def passes(t: Text, cascade: list[Rule]) -> bool:
    return not any(r.rejects(t) for r in cascade)  # any() stops at the first


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    cascade = ordered(rules, *measure(docs, rules))
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def keep(texts):
        return texts.map(lambda x: passes(Text(x), cascade)).astype(bool)

    return docs.where(keep(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: its features, whether the base rules reject it, and the cascade's verdict."""
    more = tuple(r for r in rules if r not in BASE_RULES)
    cascade = ordered(more, *measure(docs, more, before=BASE_RULES, known=("words", *REPORTED)))
    base = list(BASE_RULES)

    def start():
        def batch(rows):
            out: dict[str, list] = {k: [] for k in (*REPORTED, "base_failed", "kept")}
            for text in rows["text"]:
                t = Text(text)
                failed = not passes(t, base)
                for k in out:
                    out[k].append(failed if k == "base_failed" else not failed and passes(t, cascade) if k == "kept" else getattr(t, k))
            return {"doc_id": rows["doc_id"], **out}

        return batch

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return map_rows(bytes_text(docs), ddl, start)

