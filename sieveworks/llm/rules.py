"""Quality rules as a short-circuit cascade.

On a bounded sample each rule's cost (CPU time) and selectivity (share that it rejects) are measured; rules then run in
descending rejection per cost, each only on texts that all earlier ones let through. A text is kept if no rule rejects it, so
the order, and with it the sample, decides only how much work is done and never the verdict.

Words are runs of ``[^\\x20\\x09-\\x0D]``. The base counts are taken of every text; the cascade runs on the texts that pass
the base test. Cases: a null or empty text has no words, so all counts are 0 and it fails the base test; a repeated row is
judged each time; extra columns are not read. Nothing is shuffled.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts on which costs and selectivities are measured.
SAMPLE_ROWS = 400
#: Texts with fewer words, or with a larger share (percent) of words in repeated windows, fail the base test.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


class Text:
    """A text in UTF-8 with its words and base counts."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""
        self.words = self.raw.split()  # splits at exactly the six bytes in SPACES
        self.n_words = len(self.words)
        solid = self.raw.translate(None, SPACES)
        self.word_chars = len(solid.decode("utf-8", "replace"))
        self.n_symbols = len(solid) - len(solid.translate(None, SYMBOLS))
        self.lines = [x for x in self.raw.split(b"\n") if x.strip(SPACES)]
        self.n_dup_lines = len(self.lines) - len(set(self.lines))
        self.n_repeat_words = repeated(self.words)
        self.base_failed = self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > MOST_REPEATED * self.n_words


def repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total = reach = 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            total += at + 3 - max(at, reach)
            reach = at + 3
    return total


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a text is to go."""

    name: str
    rejects: Callable[[Text], bool]


def _share(part: int, whole: int, limit: float) -> bool:
    return part > limit * whole


RULES = (
    Rule("symbols_per_word", lambda t: _share(t.n_symbols, t.n_words, 0.5)),
    Rule("exclamations_per_word", lambda t: _share(t.raw.count(b"!"), t.n_words, 0.5)),
    Rule("word_length", lambda t: not 2 <= t.word_chars / max(t.n_words, 1) <= 14),
    Rule("repeated_lines", lambda t: _share(t.n_dup_lines, len(t.lines), 0.4)),
    Rule("upper_case", lambda t: _share(len(t.raw) - len(t.raw.translate(None, _UPPER)), len(t.raw) - len(t.raw.translate(None, _LETTERS)), 0.5)),
    Rule("few_different_words", lambda t: len(set(t.words)) < min(0.1 * t.n_words, 30)),
    Rule("words_without_letters", lambda t: _share(sum(1 for w in t.words if not w.strip(b"0123456789#*$%&|<>!.,;:-+=/()[]{}\"'")), t.n_words, 0.4)),
)


@dataclass(frozen=True)
class Measured:
    """A rule's figures on the sample."""

    name: str
    seconds: float
    rejected: float


def measure(texts: list[bytes | None], rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """Mean cost and share of rejections of each rule, over the sample's texts that pass the base test."""
    sample = [t for t in map(Text, texts) if not t.base_failed]
    out = []
    for rule in rules:
        began = time.process_time()
        hits = sum(map(rule.rejects, sample))
        out.append(Measured(rule.name, (time.process_time() - began) / max(len(sample), 1), hits / max(len(sample), 1)))
    return out


def measured(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """``measure`` of the first ``sample_rows`` texts, in one task: the driver gets figures and no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = measure([x.as_py() for batch in batches for x in batch.column(0)], rules)
        yield pa.RecordBatch.from_arrays([pa.array([getattr(f, c) for f in figures]) for c in ("name", "seconds", "rejected")], names=["name", "seconds", "rejected"])

    found = docs.select(docs[text].cast("binary")).limit(sample_rows).mapInArrow(run, "name string, seconds double, rejected double").collect()
    return [Measured(*r) for r in found]


def ordered(figures: list[Measured], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by rejection per cost, the most first; ties keep the given order."""
    gain = {x.name: x.rejected / max(x.seconds, 1e-9) for x in figures}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``keep`` columns, the base counts, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule that rejected, else null)."""
    source = docs.select(*keep, docs[text].cast("binary").alias("_text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    clash = {*counts, "base_failed", "kept", "rejected_by", "_text"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: results carry these names")
    names = [r.name for r in ordered(measured(docs, text, rules, sample_rows), rules)]
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType())])
    cascade = sorted(rules, key=lambda r: names.index(r.name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("_text"):
                t = Text(raw.as_py())
                by = None if t.base_failed else next((r.name for r in cascade if r.rejects(t)), None)
                out.append((*(getattr(t, c) for c in counts), t.base_failed, not t.base_failed and by is None, by))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, columns, kinds)], names=schema.names)

    return source.mapInArrow(run, schema)
