"""The registered queries of the operators, over whole tables and with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import bpe, chat, lines, mixing, neighbours, periods, quality, repair, rules, secrets, simhash, topk, urls
from sieveworks.llm.common import table


VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Target weights of the sources; a source not named here shares the weight of "".
WEIGHTS = {"": 1, "src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 2, **{f"src{i}": 1 for i in range(6, 20)}}
#: (host, path, verdict)
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs.select("doc_id", "lang", "text"), model).drop("text")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.trained(spark, docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id",
        *[secrets.counted("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"),
        secrets.listed("spans").alias("spans"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.expand(turns))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedupe(docs, counts=True)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    done = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    ids = F.concat_ws(",", F.col("token_ids").cast("array<string>"))
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults by a checksum of their place; nulls (of the id and the turn in the checksum alone) are one space."""
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat_ws(":", said("conv_id"), said("turn"))) % 20).alias("fault"))
    left = fault.where("fault <> 0").select("conv_id", "turn", F.expr("if(fault = 4, 'user', role)").alias("role"), F.expr("case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end").alias("text"), "fault")
    return left.select("conv_id", "turn", "role", "text", F.explode(F.expr("if(fault = 3, array(1, 2), array(1))")).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    said = F.array_join(F.transform("repaired", lambda r: F.concat(r.role, F.lit(":"), r.text)), "\n")
    done = repair.repair(damaged(turns)).withColumn("repaired_sha256", F.sha2(said, 256)).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(done, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def cycled(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a checksum of their id, repeat a stretch of words from some word on."""
    words = docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string"))).withColumn("_g", F.expr("_h div 10"))
    words = words.withColumn("_w", F.expr("if(_h % 10 = 0, filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), null)"))
    from_ = words.withColumn("_a", F.expr("if(size(_w) > 0, cast(_g % size(_w) as int), null)")).withColumn("_p", F.expr("cast(1 + (size(_w) - _a) div (3 + _g % 8) as int)"))
    again = F.expr("array_join(transform(_w, (w, i) -> if(i < _a, w, _w[_a + (i - _a) % _p])), ' ')")
    return from_.withColumn("text", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text"))).select(*docs.columns)


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = periods.detect(cycled(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", F.expr(periods.strongest()))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return done.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it takes operators and parameters from this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_simhash": op3_simhash,
    "op4_urls": op4_urls,
    "op5_chat": op5_chat,
    "op6_lines": op6_lines,
    "op7_neighbours": op7_neighbours,
    "op8_mixing": op8_mixing,
    "op9_rules": op9_rules,
    "op10_bpe": op10_bpe,
    "op11_topk": op11_topk,
    "op12_repair": op12_repair,
    "op13_periods": op13_periods,
}

_WORD = "[^\\x20\\x09-\\x0D]"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
#: Every step of the repair from a place in the grammar (0: nothing yet, 1: after s, 2: after u, 3: after a): what it reads, cost, label.
_STEPS = """VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'),
    (0, '*', 2, 1, 'R'), (1, '*', 2, 1, 'R'), (3, '*', 2, 1, 'R'), (2, '*', 3, 1, 'R'), (0, '-', 0, 2, 'D'), (1, '-', 1, 2, 'D'), (2, '-', 2, 2, 'D'), (3, '-', 3, 2, 'D')"""
_INSERTS = "VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (2, 3, 5, 'I'), (3, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CONTROLS = "[<\\[]\\\\*(s>|/s>|INST\\]|/INST\\]|SYS\\]|/SYS\\]|REPLY\\]|ROLE:|/ROLE\\])"

#: DuckDB SQL with the same columns and rows.
SQL: dict[str, str] = {
    "op4_urls": f"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1, 's')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM r),
        rules(h, pre, verdict) AS (VALUES {_RULES}),
        m AS (SELECT page_id, h || pre AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC, length(h) DESC) AS n
              FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id AND n = 1""",
    "op5_chat": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROLS}')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 12 ELSE 16 + 2 * octet_length(encode(role)) END AS size,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS final FROM c),
        s AS (SELECT *, 3 + sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          (sum(chars) FILTER (role = 'assistant' OR final))::BIGINT AS formatted_chars FROM s GROUP BY 1""",
    "op6_lines": """
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        w AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM d WHERE len(l) > 2)),
        later AS (SELECT doc_id, i FROM w WHERE regexp_matches(k, '\\S') QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM later, (VALUES (0), (1), (2)) t(j)),
        lines AS (SELECT doc_id, l[i] AS line, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
        cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(cut.n, 0) AS n_removed
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)""",
    "op7_neighbours": """
        WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score
                   FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op9_rules": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) t(j) WHERE n > 1 GROUP BY 1),
        c AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS different,
                len(regexp_extract_all(text, '!')) AS calls, len(regexp_extract_all(text, '[A-Z]')) AS upper_, len(regexp_extract_all(text, '[A-Za-z]')) AS letters,
                len(list_filter(ws, lambda x: regexp_full_match(x, '[0-9#*$%&|<>!.,;:+=/()\\[\\]{{}}"''-]+'))) AS bare FROM w LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND NOT (n_symbols > 0.5 * n_words OR calls > 0.5 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_dup_lines > 0.4 * n_lines
            OR upper_ > 0.5 * letters OR different < least(0.1 * n_words, 30) OR bare > 0.4 * n_words) AS kept FROM b""",
    "op11_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op12_repair": f"""
        WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        h AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT for z in range(8)]), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 20 AS fault FROM k),
        d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE fault <> 0),
        o AS (SELECT *, right(rtrim(text, {_BLANKS}), 1) AS final, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i
              FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM d)),
        f AS (SELECT conv_id, turn, role, text, i, CASE WHEN final = '' THEN 'b' WHEN seen THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
        faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
        step(g, reads, g2, c, label) AS ({_STEPS}), ins(g, g2, c, label) AS ({_INSERTS}),
        arc AS (SELECT ins.g, reads, step.g2, ins.c + step.c AS c, ins.label || step.label AS label FROM ins JOIN step ON ins.g2 = step.g),
        walk AS (SELECT conv_id, 0::BIGINT AS i, 0 AS g, 0::BIGINT AS cost, '' AS audit FROM faults
                 UNION ALL
                 SELECT conv_id, i, g, cost, audit FROM (
                   SELECT w.conv_id, f.i, arc.g2 AS g, w.cost + arc.c + CASE WHEN f.fault = 't' AND reads <> '-' THEN 5 ELSE 0 END AS cost, w.audit || arc.label AS audit,
                     row_number() OVER (PARTITION BY w.conv_id, arc.g2 ORDER BY w.cost + arc.c + CASE WHEN f.fault = 't' AND reads <> '-' THEN 5 ELSE 0 END, w.audit || arc.label) AS nth
                   FROM walk w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 JOIN arc ON arc.g = w.g AND (reads = '-' OR (f.fault NOT IN ('b', 'd') AND reads IN ('*', f.initial)))) WHERE nth = 1),
        ended AS (SELECT w.conv_id, w.cost + ins.c AS cost, w.audit || ins.label AS audit FROM walk w JOIN faults s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n JOIN ins ON ins.g = w.g AND ins.g2 IN (0, 3)
                  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + ins.c, w.audit || ins.label) = 1),
        marks AS (SELECT conv_id, p, substr(audit, p, 1) AS label, length(regexp_replace(left(audit, p), 'I', '', 'g')) AS i, length(regexp_replace(left(audit, p), 'D', '', 'g')) AS place
                  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM ended)),
        begun AS (SELECT m.conv_id, max(m.place) FILTER (m.place = 1 AND label = 'K' AND f.initial = 's') AS system FROM marks m JOIN f ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i GROUP BY 1),
        said AS (SELECT m.conv_id, sha256(string_agg(CASE WHEN label = 'K' THEN f.role WHEN (m.place - coalesce(b.system, 0)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN label = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p)) AS digest
                 FROM marks m LEFT JOIN f ON m.conv_id IS NOT DISTINCT FROM f.conv_id AND m.i = f.i LEFT JOIN begun b ON m.conv_id IS NOT DISTINCT FROM b.conv_id WHERE label <> 'D' GROUP BY 1)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
          coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN faults s ON e.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN ended d ON e.conv_id IS NOT DISTINCT FROM d.conv_id
        LEFT JOIN said ON e.conv_id IS NOT DISTINCT FROM said.conv_id""",
}
