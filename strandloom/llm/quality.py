"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Every rule is a small Python function over the statistics of one text, each computed when a rule first asks for it
and then kept. A sample of the corpus gives each rule's cost (seconds a text, its statistics included) and selectivity
(share rejected); it is drawn at random over all rows and measured inside the tasks, which send one row a rule. The
cascade then runs the rules by falling rejection per cost and stops at the first that rejects, so later rules'
statistics are computed only where the caller asks for them. The order changes the time and the name of the first
failed rule, never the verdict, because a text is kept only if no rule rejects it.

Defined cases: a null or empty text has no words, fails ``too_few_words`` and is not kept; repeated rows and
ties are judged alike, row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import map_columns, ship_package, slices, texts_of

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: A line that starts with a bullet.
BULLET = re.compile(r"^[ \t]*(?:- |\* |•)", re.MULTILINE)

#: Rows of the sample that orders the cascade, about; the verdicts do not depend on it.
ORDER_SAMPLE_ROWS = 400

STATS = [
    T.StructField(n, T.LongType())
    for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
]


class TextView:
    """Statistics of one text, each computed when first asked for; ``words`` are its words in UTF-8."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    windows = [joined[s:e] for s, e in zip(starts, ends[width - 1 :])]
    if len(set(windows)) == n:
        return 0
    seen: dict[bytes, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


Rule = Callable[[TextView], bool]


def production_rules() -> dict[str, Rule]:
    """Name -> test that is true when the rule rejects the text."""
    return {
        "too_few_words": lambda v: v.n_words < 20,
        "repeated_words": lambda v: 100 * v.n_repeat_words > 30 * v.n_words,
        "word_length": lambda v: v.n_words > 0 and not 2 * v.n_words <= v.word_chars <= 20 * v.n_words,
        "symbols": lambda v: 10 * v.n_symbols > v.n_words,
        "duplicate_lines": lambda v: 2 * v.n_dup_lines > v.n_lines,
        "no_letters": lambda v: 5 * sum(map(bytes.isalpha, v.words)) < 3 * v.n_words and 5 * _lettered(v.words) < 3 * v.n_words,
        "ellipsis_lines": lambda v: 2 * (v.text.count("...\n") + v.text.count("…\n")) > v.n_lines,
        "bullet_lines": lambda v: 10 * len(BULLET.findall(v.text)) > 9 * v.n_lines,
    }


#: Rules whose failure is reported as ``base_failed``.
BASE_RULES = ("too_few_words", "repeated_words")


def _lettered(words: list[bytes]) -> int:
    return sum(any(map(str.isalpha, w.decode("utf-8", "surrogatepass"))) for w in words)


def rule_costs(texts: list[str], rules: dict[str, Rule]) -> dict[str, tuple[int, float]]:
    """Rejections and seconds of every rule on the texts, each rule with fresh statistics."""
    found = {}
    for name, rule in rules.items():
        views = [TextView(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(map(rule, views))
        found[name] = (rejected, time.perf_counter() - began)
    return found


def cascade_order(costs: dict[str, tuple[int, float]]) -> list[str]:
    """Rules by falling rejections per second, ties by name."""
    return sorted(costs, key=lambda n: (-costs[n][0] / max(costs[n][1], 1e-9), n))


def order_rules(docs: DataFrame, text_col: str = "text", rows: int = ORDER_SAMPLE_ROWS) -> list[str]:
    """Order of the production cascade, from a random sample of about ``rows`` rows of the whole corpus."""
    ship_package(docs.sparkSession)
    share = min(1.0, rows / max(docs.count(), 1))
    sample = docs.select(F.col(f"`{text_col}`").alias("text")).where(F.rand(7) < share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            costs = rule_costs(texts_of(batch.column("text")), production_rules())
            yield pa.RecordBatch.from_pydict({"rule": list(costs), "rejected": [c[0] for c in costs.values()], "seconds": [c[1] for c in costs.values()]})

    measured = sample.mapInArrow(measure, "rule string, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected"), F.sum("seconds")).collect()
    costs = {name: (0, 0.0) for name in production_rules()} | {r[0]: (r[1], r[2]) for r in measured}
    return cascade_order(costs)


def first_failure(view: TextView, cascade: list[tuple[str, Rule]]) -> str | None:
    """Name of the first rule that rejects the text; rules behind it are not evaluated."""
    return next((name for name, rule in cascade if rule(view)), None)


def quality_cascade(docs: DataFrame, order: list[str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), stats: bool = True) -> DataFrame:
    """Verdict and first failed rule of every whole text, with ``stats`` its statistics as well; one pass, no shuffle."""

    def judge(texts: pa.Array) -> list[pa.Array]:
        rules = production_rules()
        cascade = [(n, rules[n]) for n in order]
        base = [rules[n] for n in BASE_RULES]
        columns: list[list[int]] = [[] for _ in STATS]
        base_failed, kept, failed = [], [], []
        for text in texts_of(texts):
            view = TextView(text)
            first = first_failure(view, cascade)
            kept.append(first is None)
            failed.append(first)
            if stats:
                for column, field in zip(columns, STATS):
                    column.append(getattr(view, field.name))
                base_failed.append(any(rule(view) for rule in base))
        verdict = [pa.array(kept, pa.bool_()), pa.array(failed, pa.string())]
        return [*[pa.array(c, pa.int64()) for c in columns], pa.array(base_failed, pa.bool_()), *verdict] if stats else verdict

    fields = [T.StructField("kept", T.BooleanType()), T.StructField("failed_rule", T.StringType())]
    fields = [*STATS, T.StructField("base_failed", T.BooleanType()), *fields] if stats else fields
    return map_columns(docs, judge, fields, [text_col], list(keep))
