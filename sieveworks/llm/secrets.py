"""Secret scans: fixed patterns, and character Markov models for secrets that no pattern names.

Two first-order models over the same alphabet, one of random strings and one of ordinary identifiers, give each step from a
character to the next a log-likelihood ratio. Candidates are runs of ``[A-Za-z0-9+/_=-]`` of ``LEAST`` characters or more,
outside of what the patterns found; in each the stretch with the greatest sum of ratios is taken, so ordinary text that is
joined to a secret neither hides nor joins it, and the ratio alone decides: a stretch that is clearly likelier to be random,
in sum and per character, is a span. The models are trained from labelled samples and are one table of (alphabet + 1) ** 2
numbers, whatever the input; it becomes a literal of the plan, so scanning has no join and no shuffle.

Only DataFrame functions are used. A match's place follows from the pieces between matches: split() and
regexp_extract_all() with one pattern give pieces and matches in turn. Lengths are summed in blocks of BLOCK matches, so that
the work does not grow with the square of a text's matches.

Cases: a null or empty text has no spans; repeated rows are scanned each; a text's length has no limit; extra columns are
passed over; without samples of a kind its model is flat. Of a run at most one stretch is a span, the first of equal ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in their order, each with its pattern, the group that must be long enough, and that length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: The same matches for texts that hold none: runs of a class are whole, so their least length can stand in the pattern.
LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
KINDS = (*(b[0] for b in BASE), "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 8
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Nats by which a stretch must favour the random model, in sum and per character.
SUM, MEAN = 15.0, 0.5
#: Matches of a text whose lengths are summed one by one.
BLOCK = 256
#: Labelled documents from which ordinary identifiers are taken, and random strings made, for training.
SAMPLE_DOCS, SAMPLE_RANDOM = 400, 2000
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _offsets(lengths: str) -> str:
    """Sums of what comes before each element of an array of lengths."""
    part = f"slice({lengths}, b * {BLOCK} + 1, {BLOCK})"
    whole = f"transform(sequence(0, cast((size({lengths}) - 1) / {BLOCK} as int)), b -> aggregate({part}, 0, (x, y) -> x + y))"
    running = "aggregate({0}, named_struct('at', {1}, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', acc.at + x, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    return f"flatten(transform({running.format(whole, '0')}, (first, b) -> {running.format(part, 'first')}))"


def spans(text: str, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Leftmost non-overlapping matches in column ``text`` whose ``group`` has ``least`` characters, as an array of spans."""
    quoted = _quoted(pattern)
    hits = f"regexp_extract_all({text}, {quoted}, 0)"
    sized = hits if group == 0 else f"regexp_extract_all({text}, {quoted}, {group})"
    made = f"""filter(zip_with(g.hits, {_offsets("g.lengths")}, (v, at) -> named_struct('start', at, 'kind', {kind}, 'end', at + length(v), 'value', v)), (s, i) -> length(g.sized[i]) >= {least})"""
    # One-element arrays bind what is used more than once. An offset counts a match and the piece behind it.
    bound = f"""transform(array(named_struct('hits', {hits}, 'sized', {sized}, 'pieces', split({text}, {quoted}, -1))), h -> named_struct('hits', h.hits, 'sized', h.sized,
        'lengths', transform(h.hits, (v, i) -> length(v) + length(h.pieces[i + 1])), 'first', length(h.pieces[0])))"""
    moved = f"transform({bound}, g -> transform({made}, s -> named_struct('start', s.start + g.first, 'kind', s.kind, 'end', s.end + g.first, 'value', s.value)))[0]"
    return F.expr(f"case when {text} rlike {quoted} then {moved} else cast(array() as array<{SPAN}>) end")


def blanked(text: str, pattern: str, group: int = 0, least: int = 1) -> Column:
    """Column ``text`` with spaces for what ``spans`` finds."""
    quoted = _quoted(pattern)
    hits = f"regexp_extract_all({text}, {quoted}, 0)"
    sized = hits if group == 0 else f"regexp_extract_all({text}, {quoted}, {group})"
    whole = f"concat_ws('', transform(h.pieces, (x, i) -> concat(x, coalesce(if(length(get(h.sized, i)) >= {least}, repeat(' ', length(get(h.hits, i))), get(h.hits, i)), ''))))"
    return F.expr(f"case when {text} rlike {quoted} then transform(array(named_struct('hits', {hits}, 'sized', {sized}, 'pieces', split({text}, {quoted}, -1))), h -> {whole})[0] else {text} end")


def samples(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``value string, random boolean``: identifiers of at most SAMPLE_DOCS documents that labels call good, and random strings.

    The documents are those of least id hash. Random strings are digests written in several alphabets; ordinary ones are words,
    words joined in pairs, both also in capitals, and runs of one separator.
    """
    spark = docs.sparkSession
    good = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").alias("_good")).distinct()
    good = good.orderBy(F.xxhash64("_good"), "_good").limit(SAMPLE_DOCS)  # a proven bound
    chosen = docs.join(F.broadcast(good), docs[doc_id] == good["_good"], "left_semi").select(F.expr(f"regexp_extract_all(`{text}`, '[A-Za-z0-9_]{{2,}}', 0)").alias("w"))
    words = chosen.select(F.explode(F.expr("concat(w, transform(w, x -> upper(x)), transform(slice(w, 2, size(w)), (x, i) -> concat(w[i], '_', x)), transform(slice(w, 2, size(w)), (x, i) -> concat(w[i], '-', x)), transform(slice(w, 2, size(w)), (x, i) -> concat(w[i], initcap(x))), transform(slice(w, 2, size(w)), (x, i) -> upper(concat(w[i], '_', x))))")).alias("value"))
    runs = spark.range(40).select(F.explode(F.array(*[F.expr(f"repeat('{c}', cast(id as int) + 20)") for c in "-_=+/"])).alias("value"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.base64(F.unhex(digest))
    made = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(digest, coded, F.translate(coded, "+/", "-_"), F.upper(F.regexp_replace(coded, "[+/=]", "")), F.regexp_replace(coded, "[+/=]", ""))).alias("value"))
    return words.union(runs).select("value", F.lit(False).alias("random")).union(made.select("value", F.lit(True).alias("random")))


def train(labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of each character after each other, by ``(alphabet + 1) * previous + next``; 0 is a start."""
    side = len(ALPHABET) + 1
    at = f"transform(regexp_extract_all(value, '(?s).', 0), c -> instr('{ALPHABET}', c))"
    pairs = labelled.where("value is not null").select("random", F.expr(f"transform({at}, (x, i) -> named_struct('i', i, 'x', x))").alias("at"))
    pairs = pairs.select("random", F.explode(F.expr(f"transform(at, p -> p.x + {side} * if(p.i = 0, 0, at[p.i - 1].x))")).alias("pair"))
    counted = pairs.groupBy("random", "pair").count().collect()  # at most 2 * side * side rows
    counts = {False: [smoothing] * side * side, True: [smoothing] * side * side}
    for random, pair, n in counted:
        counts[random][pair] += n
    totals = {k: [sum(v[a * side : (a + 1) * side]) for a in range(side)] for k, v in counts.items()}
    return [math.log(counts[True][p] / totals[True][p // side]) - math.log(counts[False][p] / totals[False][p // side]) for p in range(side * side)]


def _stretch(value: str, model: list[float]) -> str:
    """``struct<a, b>``: where in ``value`` the stretch of the greatest sum of ratios lies, if it is likely random; else null."""
    side = len(ALPHABET) + 1
    ratios = "cast(split('" + ",".join(f"{x:.4f}" for x in model) + "', ',') as array<double>)"
    code = [ALPHABET.find(chr(i)) + 1 for i in range(128)]
    codes = "cast(split('" + ",".join(map(str, code)) + "', ',') as array<int>)"
    steps = f"transform(array(transform(split({value}, ''), x -> {codes}[ascii(x)])), k -> transform(k, (x, i) -> {ratios}[{side} * if(i = 0, 0, k[i - 1]) + x]))"
    run, start = "(greatest(s.run, 0D) + d)", "if(s.run > 0, s.start, s.at)"
    best = f"""aggregate(r, named_struct('at', 0, 'run', 0D, 'start', 0, 'best', 0D, 'a', 0, 'b', 0), (s, d) -> named_struct('at', s.at + 1, 'run', {run}, 'start', {start},
        'best', greatest(s.best, {run}), 'a', if({run} > s.best, {start}, s.a), 'b', if({run} > s.best, s.at + 1, s.b)))"""
    taken = f"transform(array({best}), s -> if(s.best >= {SUM}D and s.best >= {MEAN}D * (s.b - s.a), named_struct('a', s.a, 'b', s.b), null))[0]"
    # Without enough gains in all there is no such stretch.
    return f"transform({steps}, r -> if(aggregate(r, 0D, (x, d) -> x + greatest(d, 0D)) >= {SUM}D, {taken}, null))[0]"


def likely(text: str, model: list[float]) -> Column:
    """Spans of the stretches in column ``text`` that the models call random."""
    quoted = _quoted(CANDIDATE)
    made = f"""filter(zip_with(g.hits, arrays_zip({_offsets("g.lengths")}, g.marks), (v, o) -> named_struct('start', g.first + o['0'] + o.marks.a, 'kind', {len(BASE)}, 'end', g.first + o['0'] + o.marks.b,
        'value', substring(v, o.marks.a + 1, o.marks.b - o.marks.a))), s -> s.start is not null)"""
    bound = f"""transform(array(named_struct('hits', regexp_extract_all({text}, {quoted}, 0), 'pieces', split({text}, {quoted}, -1))), h -> named_struct('hits', h.hits,
        'marks', transform(h.hits, v -> {_stretch("v", model)}), 'lengths', transform(h.hits, (v, i) -> length(v) + length(h.pieces[i + 1])), 'first', length(h.pieces[0])))"""
    return F.expr(f"case when {text} rlike {quoted} then transform({bound}, g -> if(exists(g.marks, m -> m is not null), {made}, cast(array() as array<{SPAN}>)))[0] else cast(array() as array<{SPAN}>) end")


def scan(docs: DataFrame, model: list[float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of spans sorted by start, then kind; ``spans`` holds ``base`` and what the model adds."""
    whole = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_text"))
    found = whole.withColumns({name: spans("_text", LONG.get(name, pattern), kind, group, least) for kind, (name, pattern, group, least) in enumerate(BASE)}).withColumn("_rest", F.col("_text"))
    for name, pattern, group, least in BASE:
        found = found.withColumn("_rest", blanked("_rest", LONG.get(name, pattern), group, least))
    base = found.select("doc_id", F.array_sort(F.concat(*KINDS[:-1])).alias("base"), likely("_rest", model).alias("more"))
    # What is left of a match that another one cuts lies in a base span, too.
    added = F.expr("filter(more, c -> not exists(base, b -> b.start < c.end and c.start < b.end))")
    return base.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(column: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({column}, s -> concat({kinds}[s.kind], ':', s.start, ':', s.end)), ',')")


def counted(column: str, kind: str) -> Column:
    """How many spans are of one kind."""
    return F.expr(f"cast(size(filter({column}, s -> s.kind = {KINDS.index(kind)})) as bigint)")


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> list[float]:
    """A model from the samples of these tables."""
    return train(samples(docs, labels))
