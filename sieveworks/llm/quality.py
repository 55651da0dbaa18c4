"""Quality classifier: an interpolated modified Kneser-Ney model of each language, trained on text that labels trust.

Symbols spell a text without loss: a character up to U+00FF is one, any other has a symbol for each byte of its UTF-8. No two
texts have the same symbols, so no characters share a count, whatever the script. The model is of order 4.
Counting covers all trusted text: each task sums its grams, sums are sharded by (language, gram), lower orders count distinct
predecessors, and the sharded counts are joined with the totals of their contexts. A language's joined table has a row for each
gram and context that its trusted text holds, not for all that the alphabet allows. Tables come to the driver one language at a
time and are broadcast one by one; a scoring task fetches those of the languages that it meets and holds at most HELD of them, so
there is no cap of languages.

A text's score is its bits per symbol, drawn towards the language's mean as PRIOR symbols of average text would; 2 to that
power is its perplexity. A text goes if its score is over its language's threshold: the QUANTILE of trusted texts' scores. Each
half of the trusted texts is scored for this by a model of the other half, as a model knows the text that it was made of too
well; quantiles come from whole counts of scores rounded to 1/1000 bit.

Cases: a null or empty text has the mean score and is kept; a null language is the language ""; without trusted text of a
language its texts have a null score, with too little to part it in halves a null threshold, and are kept; labels that
contradict each other, and rows with a null id, are not trusted; repeated rows are scored each; a text's length has no limit;
extra columns are passed through.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.llm.common import materialize

SYMBOLS, ORDER = 512, 4
#: Symbols from BYTES on are bytes of characters beyond U+00FF; START stands before a text and is a byte that UTF-8 never has.
BYTES, START = 256, 511
PRIOR, QUANTILE = 60, 0.99
#: Symbols whose grams are held at once (a longer text is held by itself), languages' tables that a task holds, and sums of grams
#: after which a counting task passes them on.
CHUNK, HELD, MOST_COUNTED = 1 << 18, 4, 1 << 20
#: Different grams that a part is thought to have: pandas would make room for as many as there are symbols.
KINDS = 1 << 14
#: Parts into which the grams of a model's order are dealt.
SALTS = 32
#: Trusted ids up to this number are broadcast; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def symbol(char: str) -> int:
    """The symbol of a character that has one of its own."""
    if ord(char) >= BYTES:
        raise ValueError(f"{char!r} has several symbols")
    return ord(char)


def symbols(text: str) -> np.ndarray:
    """Symbols of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    if not len(points) or points.max() < BYTES:
        return points
    size = 1 + (points >= BYTES) + (points >= 0x800) + (points >= 0x10000)
    of, size_of = np.repeat(points, size), np.repeat(size, size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size_of] | of >> 6 * (size_of - 1)
    later = 0x80 | of >> 6 * (size_of - 1 - at) & 0x3F
    return np.where(size_of == 1, of, BYTES + np.where(at == 0, lead, later))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts, each begun with ORDER - 1 starts, and how many each text has."""
    pad = np.full(ORDER - 1, START, np.int64)
    parts, sizes = [], []
    for text in texts:
        s = np.concatenate([pad, symbols(text)])
        parts.append(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:])
        sizes.append(len(s) - ORDER + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(sizes, np.int64)


def chunks(texts: pa.Array, at: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The rows ``at`` in parts of CHUNK symbols, with their texts; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)[at])
    start = 0
    while start < len(at):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, "right")))
        yield at[start:end], [x or "" for x in texts.take(pa.array(at[start:end])).to_pylist()]
        start = end


def found_at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    """The values of ``wanted`` among sorted keys."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


@dataclass
class Language:
    """What one language's model is made of: by order, discounted shares of grams and the weights their contexts leave below, sorted."""

    shares: list[tuple[np.ndarray, np.ndarray]]
    weights: list[tuple[np.ndarray, np.ndarray]]
    mean: float = 0.0
    threshold: float | None = None

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Bits of grams, seen or not."""
        p = np.full(len(grams), 1 / SYMBOLS)
        for order, ((gram, share), (context, weight)) in enumerate(zip(self.shares, self.weights, strict=True), 1):
            tail = grams % SYMBOLS**order
            p = p * found_at(context, weight, tail // SYMBOLS, 1.0) + found_at(gram, share, tail, 0.0)
        return -np.log2(p)

    def bits(self) -> np.ndarray:
        """Bits of every symbol after each context that was seen, for inspection."""
        return self.of((self.weights[-1][0][:, None] * SYMBOLS + np.arange(SYMBOLS)).reshape(-1))


@dataclass
class Model:
    """The languages' models, as the copies for the executors."""

    shared: Mapping[str, Broadcast]

    @property
    def languages(self) -> dict[str, Language]:
        """The models themselves, for inspection."""
        return {k: v.value for k, v in self.shared.items()}


def trusted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that labels call good and none calls bad."""
    good = labels.groupBy(F.col("doc_id").alias("_good")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("_good is not null and q = 1 and t = 0").select("_good")
    good = materialize(good, "trusted")
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    return docs.join(side, docs[doc_id] == good["_good"], "left_semi")


def count(texts: DataFrame) -> DataFrame:
    """``lang string, part int, gram long, n long``: how often each gram of order 4 occurs. ``texts`` has ``lang, part, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        counted = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, part), sums in seen.items():
                codes, gram = pd.factorize(np.concatenate([x for x, _ in sums]))
                n = np.zeros(len(gram), np.int64)
                np.add.at(n, codes, np.concatenate([x for _, x in sums]))
                columns = [pa.array([lang] * len(gram)), pa.array(np.full(len(gram), part, np.int32)), pa.array(gram), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "part", "gram", "n"])
            seen.clear()

        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column(0).to_pandas(), "part": batch.column(1).to_numpy()})
            for key, at in frame.groupby(["lang", "part"], sort=False).indices.items():
                for _, texts in chunks(batch.column(2), at):
                    codes, kinds = pd.factorize(grams(texts)[0], size_hint=KINDS)
                    seen.setdefault(key, []).append((kinds, np.bincount(codes, minlength=len(kinds))))
                    counted += len(kinds)
                    if counted > MOST_COUNTED:
                        yield from passed_on()
                        counted = 0
        yield from passed_on()

    partial = texts.mapInArrow(run, "lang string, part int, gram long, n long")
    return partial.groupBy("lang", "part", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of the modified model, from how many grams have counts 1 to 4."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.1), i - 0.1) for i, d in enumerate(raw, 1))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> Model:
    """Counts, discounts, contexts and thresholds from all trusted rows of ``docs``."""
    spark = docs.sparkSession
    base = trusted(docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), docs[text].cast("string").alias("text")), labels)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int") + 1
    base = base.select(F.coalesce("lang", F.lit("")).alias("lang"), half.alias("part"), "text")
    # Three models for each language: of all its text (part 0), and of either half.
    both = count(base).select("lang", F.explode(F.array("part", F.lit(0))).alias("part"), "gram", "n")
    orders = [materialize(both.groupBy("lang", "part", "gram").agg(F.sum("n").alias("n")), "grams")]
    for order in range(ORDER - 1, 0, -1):
        orders.insert(0, orders[0].groupBy("lang", "part", (F.col("gram") % SYMBOLS**order).alias("gram")).agg(F.count("*").alias("n")))
    every = orders[0].select("*", F.lit(1).alias("k"))
    for order in range(2, ORDER + 1):
        every = every.unionByName(orders[order - 1].select("*", F.lit(order).alias("k")))
    every = materialize(every, "orders")
    of_counts = every.groupBy("lang", "part", "k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).collect()  # a few rows for each language
    cut = spark.createDataFrame([(r["lang"], r["part"], r["k"], *discounts(r["n1"], r["n2"], r["n3"], r["n4"])) for r in of_counts], "lang string, part int, k int, d1 double, d2 double, d3 double")
    # A language and an order may hold most grams, so their join is salted.
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = every.withColumns({"context": F.floor(F.col("gram") / SYMBOLS).cast("long"), "salt": F.pmod("gram", F.lit(SALTS))})
    keyed = salted.join(cut, ["lang", "part", "k", "salt"]).drop("salt")
    keyed = keyed.withColumn("d", F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end"))
    contexts = keyed.groupBy("lang", "part", "k", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("cut"))
    shares = keyed.join(contexts, ["lang", "part", "k", "context"]).select("lang", "part", "k", "gram", F.expr("cast((n - d) / total as float)").alias("value"), "n")
    weights = contexts.select("lang", "part", (-F.col("k")).alias("k"), F.col("context").alias("gram"), F.expr("cast(cut / total as float)").alias("value"), F.lit(0).cast("long").alias("n"))
    model = materialize(shares.unionByName(weights).repartition("lang", "part").sortWithinPartitions("lang", "part", "k"), "model")
    names = sorted({(r["lang"], r["part"]) for r in of_counts})
    shared = lambda lang, part, threshold=None: spark.sparkContext.broadcast(_language(model.where((F.col("lang") == lang) & (F.col("part") == part)), threshold))
    halves = Model({f"{lang} {part}": shared(lang, part) for lang, part in names if part})
    other = F.concat("lang", F.lit(" "), (3 - F.col("part")).cast("string"))
    scored = base.select("lang", F.round(score(halves)(other, F.col("text")).bits, 3).alias("bits")).where("bits is not null")
    counted = scored.groupBy("lang", "bits").agg(F.count("*").alias("n"))
    limits = {r["lang"]: r["limit"] for r in counted.groupBy("lang").agg(F.expr(f"percentile(bits, {quantile}, n)").alias("limit")).collect()}  # a row for each language
    for one in halves.shared.values():
        one.destroy()
    return Model({lang: shared(lang, part, limits.get(lang)) for lang, part in names if not part})


def _language(rows: DataFrame, threshold: float | None) -> Language:
    """One language's model; ``rows`` are its grams and contexts of all orders."""
    found = rows.select("k", "gram", "value", "n").toArrow()
    k, gram, value, n = (found.column(c).to_numpy() for c in ("k", "gram", "value", "n"))

    def of(order: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(k == order)
        at = at[np.argsort(gram[at])]
        return gram[at], value[at]

    one = Language([of(i) for i in range(1, ORDER + 1)], [of(-i) for i in range(1, ORDER + 1)], threshold=threshold)
    top = n[k == ORDER].astype(float)
    one.mean = float((one.of(gram[k == ORDER]) * top).sum() / top.sum())
    return one


class Tables:
    """Models of the languages that a task used last; they go with the task."""

    def __init__(self, shared: Mapping[str, Broadcast]):
        self.shared, self.held = shared, OrderedDict()

    def get(self, name: str) -> Language:
        found = self.held.pop(name, None)
        if found is None:
            if len(self.held) >= HELD:
                self.held.popitem(last=False)
            found = self.shared[name].value
            self.shared[name].__dict__.pop("_value", None)  # or the worker would keep every language that it ever met
        self.held[name] = found
        return found

    def judged(self, lang: pa.Array, text: pa.Array) -> pa.StructArray:
        """``struct<bits, threshold>`` of texts."""
        out, limit = np.full(len(text), np.nan), np.full(len(text), np.nan)
        coded = lang.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        for code, name in enumerate(coded.dictionary.to_pylist()):
            if name not in self.shared:
                continue
            known = self.get(name)
            every = np.flatnonzero(codes == code)
            limit[every] = np.nan if known.threshold is None else known.threshold
            for rows, texts in chunks(text, every):
                found, sizes = grams(texts)
                at, kinds = pd.factorize(found, sort=True, size_hint=KINDS)
                sums = np.concatenate([[0.0], np.cumsum(known.of(kinds)[at])])
                ends = np.cumsum(sizes)
                out[rows] = (sums[ends] - sums[ends - sizes] + PRIOR * known.mean) / (sizes + PRIOR)
        return pa.StructArray.from_arrays([pa.array(x, mask=np.isnan(x)) for x in (out, limit)], ["bits", "threshold"])


def score(model: Model):
    """A function of (language, text) columns that gives a text's bits per symbol and the threshold of its language."""
    shared = dict(model.shared)

    @F.arrow_udf("struct<bits: double, threshold: double>")
    def bits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tables = Tables(shared)
        for lang, text in batches:
            yield tables.judged(lang, text)

    return bits


def classify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``bits, perplexity, threshold double`` and ``kept boolean``."""
    clash = {"bits", "perplexity", "threshold", "kept", "_judged"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: results carry these names")
    judged = docs.withColumn("_judged", score(model)(F.coalesce(docs[lang], F.lit("")), docs[text].cast("string")))
    scored = judged.withColumns({"bits": F.col("_judged.bits"), "threshold": F.col("_judged.threshold")})
    kept = F.coalesce(F.col("bits") <= F.col("threshold"), F.lit(True))
    return scored.withColumns({"perplexity": F.pow(F.lit(2.0), F.col("bits")), "kept": kept}).select(*docs.columns, "bits", "perplexity", "threshold", "kept")
