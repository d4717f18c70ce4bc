"""Registered queries of the operators over the driver tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recapflow.llm import (
    chat, common, decontaminate, line_dedup, merkle, mixing, ngram_join, quality_classifier, quality_rules, secrets, sharding, token_counts,
    token_files, vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


#: ASCII words of a text, in lower case and as they are.
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER_WORDS = _WORDS.format(text=_LOWER.format(text="coalesce(text, '')"))
_SHINGLES = """
    CASE WHEN len(w) = 0 THEN []::VARCHAR[]
         ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END"""


@query("op1_decontaminate", f"""
    WITH d AS (SELECT DISTINCT doc_id, text, {_LOWER_WORDS} AS w FROM documents),
    i AS (SELECT DISTINCT item_id, text AS item, {_LOWER_WORDS} AS w FROM benchmark),
    si AS (SELECT item_id, item, {_SHINGLES} AS ss FROM i),
    ii AS (SELECT item_id, item, len(ss) AS n, unnest(ss) AS s FROM si),
    m AS (SELECT DISTINCT least(len(w), 5) AS m FROM i WHERE len(w) > 0),
    ds AS (SELECT DISTINCT doc_id, text, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS s FROM d, m)
    SELECT doc_id, item_id, any_value(n)::BIGINT AS n_item_shingles, count(*) AS n_shared,
           round(count(*) / any_value(n), 6) AS containment
    FROM ds JOIN ii USING (s) GROUP BY doc_id, text, item_id, item HAVING 100 * count(*) >= 80 * any_value(n)""")
def op1(spark, sf_dir):
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("own", "which")


@query("op2_token_counts")
def op2(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op3_secrets")
def op3(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_mix_sources", """
    WITH RECURSIVE d AS (
        SELECT doc_id, source, len({words}) AS size,
               ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
          FROM d GROUP BY source),
    fill AS (
        SELECT 0 AS round, source, source_size, w::DOUBLE AS w, FALSE AS full_, w * (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(w) FROM s) AS t FROM s
        UNION ALL
        SELECT round + 1, source, source_size, w, full_ OR t > 3 * source_size,
               CASE WHEN full_ OR t > 3 * source_size THEN 3.0 * source_size
                    ELSE w * (sum(source_size) OVER () - sum(CASE WHEN full_ OR t > 3 * source_size THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                         / sum(CASE WHEN full_ OR t > 3 * source_size THEN 0 ELSE w END) OVER () END
        FROM fill WHERE round < 64),
    goal AS (SELECT source, source_size, t AS target, CASE WHEN source_size > 0 THEN floor(t / source_size) ELSE 0 END AS passes FROM fill WHERE round = 64),
    run AS (SELECT d.doc_id, d.source, d.size, d.h, g.source_size, g.target, g.passes, g.target - g.passes * g.source_size AS rest,
                   sum(size) OVER (PARTITION BY d.source ORDER BY h) AS after, sum(size) OVER (PARTITION BY d.source, h) AS same
            FROM d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
    cut AS (SELECT *, (after <= rest OR (after - same <= rest AND after > rest AND after - rest < rest - (after - same))) AND size > 0 AS more FROM run)
    SELECT doc_id, source, size::BIGINT AS size, source_size, round(target, 6) AS target, (size * (passes + more::INT))::BIGINT AS taken FROM cut"""
       .replace("{words}", _WORDS.format(text="coalesce(text, '')")))
def op5(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op6_token_files")
def op6(spark, sf_dir):
    return token_files.encoded(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op7_shard")
def op7(spark, sf_dir):
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"regexp_replace({x}, '<(\\*)\|', '<\1\\|', 'g')"


@query("op8_chat", f"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                 coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
                 string_agg('<|im_start|>' || {_ESCAPED.format(x="role")} || chr(10) || {_ESCAPED.format(x="text")} || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS formatted
          FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
           length(formatted)::BIGINT AS formatted_chars FROM c""")
def op8(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    row = lambda turn, role: F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(turn).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.lit(_SAID).alias("text"))
    more = spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    out = chat.digests(chat.format(chat.linear(said.union(more))))
    return out.withColumnRenamed("conv", "conv_id").drop("branch")


@query("op9_ngram_join", f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents),
    sets AS MATERIALIZED (SELECT doc_id, {_SHINGLES} AS ss FROM d),
    s AS MATERIALIZED (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM sets),
    met AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
            FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY x, y),
    links AS MATERIALIZED (SELECT x, y FROM met WHERE 100 * o >= 80 * (nx + ny - o)),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
    low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, len(ss)::BIGINT AS n_shingles, component_id FROM sets JOIN low ON doc_id = x""")
def op9(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VOTES = ", ".join(
    f"CASE WHEN n = 0 THEN -1 WHEN {measure} > {bad} THEN -1 WHEN {measure} <= {good} THEN 1 ELSE 0 END"
    for measure, good, bad in quality_rules.RULES.values()
)
_NEXT = "list_transform(vs, lambda v: 1 / (1 + exp(-(prior + list_sum(list_transform(range(1, len(v) + 1), lambda j: wt[j][v[j] + 2]))))))"


@query("op10_quality_rules", f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
    g AS MATERIALIZED (
        SELECT doc_id, t, w, len(w) AS n, list_filter(string_split(t, chr(10)), lambda x: len({_WORDS.format(text="x")}) > 0) AS lines,
               list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')) AS tri FROM d),
    again AS (SELECT doc_id, i FROM (SELECT doc_id, unnest(tri) AS x, generate_subscripts(tri, 1) AS i FROM g) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
    cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
    c AS (SELECT doc_id, n::BIGINT AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 length(t) - length(translate(t, {_quoted(quality_rules.SYMBOLS)}, '')) AS n_symbols,
                 length(t) - length(translate(t, {_quoted(quality_rules.PUNCTUATION)}, '')) AS n_punct, len(lines) AS n_lines,
                 len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 len(list_filter(w, lambda x: NOT regexp_matches(x, {_quoted(quality_rules.LETTER)}) OR regexp_matches(x, {_quoted(quality_rules.ODD)}))) AS n_odd
          FROM g LEFT JOIN cover USING (doc_id)),
    m AS (SELECT *, n_symbols / greatest(n, 1) AS symbol_share, n_punct / greatest(word_chars, 1) AS punct_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
                 n_repeat_words / greatest(n, 1) AS repeat_share, abs(word_chars / greatest(n, 1) - 6.0::DOUBLE) AS length_gap,
                 n_odd / greatest(n, 1) AS odd_word_share FROM c),
    voted AS MATERIALIZED (SELECT *, [{_VOTES}]::INTEGER[] AS v FROM m),
    pat AS (SELECT list(v ORDER BY v) AS vs, list(k ORDER BY v) AS cs FROM (SELECT v, count(*)::DOUBLE AS k FROM voted GROUP BY v)),
    em AS (
        SELECT 0 AS round, vs, cs, list_transform(vs, lambda v: 1 / (1 + exp(-2.0::DOUBLE * list_sum(v)))) AS p FROM pat
        UNION ALL
        SELECT round + 1, vs, cs, {_NEXT} FROM (
            SELECT round, vs, cs, ln((1 + good) / (1 + bad)) AS prior,
                   list_transform(range(1, {len(quality_rules.RULES)} + 1), lambda j: list_transform([-1, 0, 1], lambda x: ln(
                       (1 + coalesce(list_sum(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN vs[i][j] = x THEN cs[i] * p[i] ELSE 0 END)), 0)) / (3 + good)
                       / (1 + coalesce(list_sum(list_transform(range(1, len(vs) + 1), lambda i: CASE WHEN vs[i][j] = x THEN cs[i] * (1 - p[i]) ELSE 0 END)), 0)) * (3 + bad)))) AS wt
            FROM (SELECT *, list_sum(list_transform(range(1, len(vs) + 1), lambda i: cs[i] * p[i])) AS good,
                         list_sum(list_transform(range(1, len(vs) + 1), lambda i: cs[i] * (1 - p[i]))) AS bad FROM em WHERE round < 50))),
    post AS (SELECT unnest(vs) AS v, unnest(p) AS p FROM em WHERE round = 50)
    SELECT doc_id, n AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n < 50 OR 100 * n_repeat_words > 50 * n AS base_failed,
           NOT (n < 50 OR 100 * n_repeat_words > 50 * n) AND p >= 0.5 AS kept, round(p, 6) AS p_quality,
           {", ".join(f"v[{j + 1}] AS vote_{r}" for j, r in enumerate(quality_rules.RULES))}
    FROM voted JOIN post USING (v)""")
def op10(spark, sf_dir):
    return quality_rules.score(table(spark, sf_dir, "documents"))


_ENDS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("op11_line_dedup", f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
    k AS (SELECT *, {_LOWER.format(text=f"trim(line, {_ENDS})")} AS key FROM l),
    f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key
          HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
    m AS (SELECT doc_id, pos, line, top IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN f USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id""")
def op11(spark, sf_dir):
    found = line_dedup.kept(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(fields: dict[str, str]) -> str:
    cell = "coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"
    return "sha256(" + " || ".join(cell.format(x=fields.get(f, f)) for f in _LEAF_FIELDS) + ")"


#: Heights the SQL unrolls; a tree that has its root already stays as it is.
_SQL_HEIGHTS = 7
#: CRC-32 of a short ASCII string: the bytes, each followed by eight shifts.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split({x}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def _tree_sql(name: str, start: str) -> str:
    """Tables ``name``0.. of the nodes (tree, pos, digest, size) per height and of their runs."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for h in range(_SQL_HEIGHTS):
        out.append(f"""
    {name}_run{h} AS MATERIALIZED (
        SELECT tree, pos // 16 AS pos, list(digest ORDER BY pos) AS ds FROM {name}{h} WHERE size > 1 GROUP BY tree, pos // 16),
    {name}{h + 1} AS MATERIALIZED (
        SELECT tree, pos, sha256(array_to_string(ds, '')) AS digest, count(*) OVER (PARTITION BY tree) AS size FROM {name}_run{h}
        UNION ALL SELECT tree, pos, digest, size FROM {name}{h} WHERE size <= 1)""")
    return ",".join(out)


def _proof_sql(name: str, rows: str) -> str:
    """Per row of ``rows`` (key, tree, pos, digest, changed): ``said``, the siblings so far, and ``fold``."""
    now = f"SELECT key, tree, pos, changed AS fold, '' AS said FROM {rows}"
    out = []
    for h in range(_SQL_HEIGHTS):
        out.append(f"""{name}_up{h} AS MATERIALIZED (
        SELECT key, r.tree, CASE WHEN ds IS NULL THEN r.pos ELSE r.pos // 16 END AS pos,
               CASE WHEN ds IS NULL THEN fold ELSE sha256(array_to_string(ds[:r.pos % 16], '') || fold || array_to_string(ds[r.pos % 16 + 2:], '')) END AS fold,
               CASE WHEN ds IS NULL THEN said ELSE said || array_to_string(ds[:r.pos % 16], '') || array_to_string(ds[r.pos % 16 + 2:], '') END AS said
        FROM ({now}) r LEFT JOIN {name}_run{h} t ON r.tree = t.tree AND r.pos // 16 = t.pos)""")
        now = f"SELECT * FROM {name}_up{h}"
    return ",".join(out)


@query("op12_merkle_manifest", f"""
    WITH s AS (SELECT source AS named, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)),
    leaf AS MATERIALIZED (
        SELECT doc_id, tree, {_leaf_sql({})} AS leaf,
               CASE WHEN {_CRC.format(x="doc_id::VARCHAR")} % 5 = 0 THEN {_leaf_sql({"text": _LOWER.format(text="text")})} ELSE {_leaf_sql({})} END AS changed
        FROM documents JOIN s ON source IS NOT DISTINCT FROM named),
    placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM leaf),
    {_tree_sql("a", "SELECT tree, pos, leaf AS digest, size FROM placed")},
    {_tree_sql("b", f"SELECT 0 AS tree, tree AS pos, digest, count(*) OVER () AS size FROM a{_SQL_HEIGHTS}")},
    {_proof_sql("a", "(SELECT doc_id AS key, tree, pos, changed FROM placed)")},
    {_proof_sql("b", f"(SELECT key, 0 AS tree, tree AS pos, fold AS changed FROM a_up{_SQL_HEIGHTS - 1})")}
    SELECT p.doc_id, p.leaf, a{_SQL_HEIGHTS}.digest AS subroot, b{_SQL_HEIGHTS}.digest AS root, sha256(x.said || y.said) AS proof_sha256,
           y.fold AS folded_root, y.fold = b{_SQL_HEIGHTS}.digest AS verified
    FROM placed p JOIN a_up{_SQL_HEIGHTS - 1} x ON p.doc_id = x.key JOIN b_up{_SQL_HEIGHTS - 1} y ON p.doc_id = y.key
    JOIN a{_SQL_HEIGHTS} ON a{_SQL_HEIGHTS}.tree = p.tree CROSS JOIN b{_SQL_HEIGHTS}""")
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    lowered = [common.ascii_lower(F.col("text")) if f == "text" else F.col(f) for f in _LEAF_FIELDS]
    out = merkle.manifest(docs, _LEAF_FIELDS, also={"changed": F.when(hit, merkle.leaf(lowered))})
    said = F.sha2(F.array_join("proof.siblings", ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", said.alias("proof_sha256"), merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _codes_sql() -> str:
    width, parts = "(dim // 4)", ", ".join(str(p) for p in range(vector_codes.PARTS))
    steps = [f"""
    k AS MATERIALIZED (
        SELECT vec_id, label, len(embedding) AS dim, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT vec_id, part, v[part * {width} + 1:part * {width} + {width}] AS v FROM k, (SELECT unnest([{parts}]) AS part)),
    c0 AS MATERIALIZED (
        SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p
        WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {vector_codes.ENTRIES}))"""]
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"""
    a{r} AS MATERIALIZED (
        SELECT vec_id, p.part, min((list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c))::BIGINT * {vector_codes.ENTRIES} + entry) AS best
        FROM p JOIN c{r} USING (part) GROUP BY vec_id, p.part)""")
        if r < vector_codes.ROUNDS:
            steps.append(f"""
    m{r} AS (SELECT part, best % {vector_codes.ENTRIES} AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{r} JOIN p USING (vec_id, part)),
    n{r} AS (SELECT part, entry, list(f ORDER BY j) AS c FROM (SELECT part, entry, j, floor(sum(x) / count(*)) AS f FROM m{r} GROUP BY part, entry, j) GROUP BY part, entry),
    c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n USING (part, entry))""")
    last = vector_codes.ROUNDS
    return "WITH " + ",".join(steps) + f""",
    coded AS (SELECT vec_id, lower(string_agg(printf('%02x', best % {vector_codes.ENTRIES}), '' ORDER BY part)) AS code, sum(best // {vector_codes.ENTRIES})::BIGINT AS error FROM a{last} GROUP BY vec_id),
    book AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last})
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id) CROSS JOIN book"""


@query("op13_vector_codes", _codes_sql())
def op13(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))
