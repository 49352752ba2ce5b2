"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

A rule rejects a text by a few measures (whole numbers read off the text).  A text is kept if no rule rejects it, whatever
the order, so the order is free to save work: rules run one after the other and a text stops at the first that rejects it;
measures that no rule asks for any more are never taken.

The order comes from a sample: every rule is run on it, its seconds are measured in the task that runs it, and the texts
are counted by the set of rules that reject them.  The next rule is always the one that rejects most of the texts left by
those before it, per second; rules that reject nothing there come last, cheapest first.  The sample is about `sample_rows`
rows (a fraction of the rows, Bernoulli); it decides the order only, never a verdict.

Measures named in `always` are taken of every text and returned; rules over these cost next to nothing.

Defined results: words are runs of bytes other than blank and tab to carriage return, lines are what \\n splits; null and
empty texts have no words and no lines with a word, and are judged like any other text; repeated rows are judged alike;
an empty table gives no rows; other columns pass through, those named like the added ones are replaced. `rejected_by` is the
first rule in the order of this run: another run may measure other costs and name another rule, `kept` stays.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.scratch import small_batches

ADDED = ("kept", "rejected_by")
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_LIST = re.compile(rb"[ \t]*(?:[-*]|\xe2\x80\xa2)")


class Text:
    """A text and what has been read off it so far."""

    def __init__(self, raw: bytes | None):
        self.raw, self.taken = raw or b"", {}

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    def __getitem__(self, measure: str) -> int:
        if measure not in self.taken:
            self.taken[measure] = MEASURES[measure](self)
        return self.taken[measure]


def _word_chars(t: Text) -> int:
    """Code points in words: bytes that begin one and are not white space."""
    solid = np.frombuffer(t.raw.translate(None, _SPACE), np.uint8)
    return int(np.count_nonzero((solid & 0xC0) != 0x80))


def _repeat_words(t: Text, n: int = 3) -> int:
    """Words in n-word windows that are found twice or more in the text."""
    m = len(t.words) - n + 1
    if m < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in t.words), np.int64, len(t.words))
    code, many = ids[:m], len(known)
    for k in range(1, n):
        if int(code.max()) >= (1 << 62) // many:  # would not fit: number the windows so far anew
            code = np.unique(code, return_inverse=True)[1]
        code = code * many + ids[k : k + m]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(m, bool)
    again[order[np.append(same, False) | np.append(False, same)]] = True
    inside = np.zeros(len(ids), bool)
    for k in range(n):
        inside[k : k + m] |= again
    return int(inside.sum())


#: What rules can ask for, each a whole number.
MEASURES: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": lambda t: len(t.raw) - len(t.raw.translate(None, _SYMBOLS)),
    "n_lines": lambda t: len(t.lines),
    "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
    "n_repeat_words": _repeat_words,
    "n_lettered": lambda t: sum(1 for w in t.words if _LETTER.search(w)),
    "n_cut_lines": lambda t: sum(1 for x in t.lines if x.rstrip(_SPACE).endswith((b"...", b"\xe2\x80\xa6"))),
    "n_list_lines": lambda t: sum(1 for x in t.lines if _LIST.match(x)),
    "longest_word": lambda t: max(map(len, t.words), default=0),
}


@dataclass(frozen=True)
class Rule:
    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., bool]

    def __call__(self, t: Text) -> bool:
        return self.rejects(*(t[m] for m in self.measures))


#: Rules in the manner of published sets for web text, as whole-number comparisons; looser where short lines are usual.
RULES = (
    Rule("few words", ("n_words",), lambda n: n < 50),
    Rule("repeated windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 50 * n),
    Rule("word length", ("word_chars", "n_words"), lambda c, n: c < 2 * n or c > 12 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
    Rule("repeated lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 5 * n),
    Rule("words without letters", ("n_lettered", "n_words"), lambda a, n: 10 * a < 7 * n),
    Rule("cut lines", ("n_cut_lines", "n_lines"), lambda c, n: 10 * c > 3 * n),
    Rule("lists", ("n_list_lines", "n_lines"), lambda c, n: 10 * c > 9 * n),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Plan:
    """The order of the rules, with what the sample says: seconds a text and share of texts rejected, by rule."""

    order: list[str]
    cost: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)


def order_rules(rejections: Counter, cost: dict[str, float], names: list[str]) -> list[str]:
    """rejections: number of texts by the set of rules that reject them; cost: seconds a text."""
    left, order, rest = list(rejections.items()), [], list(names)
    while rest:
        gain = {r: sum(n for s, n in left if r in s) / max(cost[r], 1e-12) for r in rest}
        best = max(rest, key=lambda r: (gain[r], -cost[r]))
        order.append(best)
        rest.remove(best)
        left = [(s, n) for s, n in left if best not in s]
    return order


def plan(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", always: tuple[str, ...] = (), sample_rows: int = 2_000, seed: int = 11) -> Plan:
    """Runs every rule on a sample. The driver gets a row for each set of rules that rejects a text and one for each rule."""
    small_batches(spark)
    names = [r.name for r in rules]

    def tried(batches):
        spent, sets, rows = np.zeros(len(rules)), Counter(), 0
        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                t, by = Text(raw), 0
                for m in always:
                    t[m]
                shared = dict(t.taken)
                for k, rule in enumerate(rules):
                    t.taken = dict(shared)
                    began = time.perf_counter()
                    by |= bool(rule(t)) << k
                    spent[k] += time.perf_counter() - began
                sets[by] += 1
                rows += 1
        out = [(s, n, -1, 0.0) for s, n in sets.items()] + [(0, rows, k, float(x)) for k, x in enumerate(spent)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=["by", "n", "rule", "seconds"])

    share = min(1.0, sample_rows / max(1, docs.count()))
    seen = docs.select(text_col).sample(share, seed=seed).mapInArrow(tried, "by long, n long, rule int, seconds double")
    seen = seen.groupBy("rule", "by").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds")).collect()
    sets = Counter({frozenset(x for k, x in enumerate(names) if r["by"] >> k & 1): r["n"] for r in seen if r["rule"] < 0})
    rows = max(1, sum(sets.values()))
    cost = {x: 0.0 for x in names} | {names[r["rule"]]: r["seconds"] / rows for r in seen if r["rule"] >= 0}
    rejected = {x: sum(n for s, n in sets.items() if x in s) / rows for x in names}
    return Plan(order_rules(sets, cost, names), cost, rejected)


def judge(spark: SparkSession, docs: DataFrame, own: Plan, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", always: tuple[str, ...] = ()) -> DataFrame:
    """docs with the measures of `always`, kept and rejected_by; rules in the order of the plan, each text until one rejects it."""
    small_batches(spark)
    by_name = {r.name: r for r in rules}
    cascade = [by_name[x] for x in own.order]
    added = (*always, *ADDED)
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    at = rest.columns.index(text_col)

    def rows(batches):
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(at).cast(pa.binary()).to_pylist():
                t = Text(raw)
                taken = [t[m] for m in always]
                why = next((r.name for r in cascade if r(t)), None)
                out.append((*taken, why is None, why))
            kinds = [pa.int64()] * len(always) + [pa.bool_(), pa.string()]
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    more = [T.StructField(m, T.LongType()) for m in always] + [T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())]
    return rest.mapInArrow(rows, T.StructType([*rest.schema, *more]))
