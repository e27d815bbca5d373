"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCH_ROWS = 2_000  # rows of an Arrow batch: texts are long, and a worker holds a batch whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontamination import contaminated, find_contamination, items_digest

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), contaminated().alias("contaminated"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cairn.llm.pii import joined_kinds, replace_entities, session_key

    found = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark))
    return found.select("doc_id", F.size("pii_kinds").cast("long").alias("n_entities"), joined_kinds().alias("kinds"), "text")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.language import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cairn.llm.secrets import KINDS, count_kind, joined_spans, scan_secrets

    found = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [count_kind("base", i).alias(f"n_{kind}") for i, kind in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("base", "added").alias("spans"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cairn.llm.repeats import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cairn.llm.hardneg import hard_negatives

    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", noisy))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cairn.llm.merkle import build_manifest, fold, leaf_digest, proof_digest, prove

    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    leaf = leaf_digest(*fields.values())
    lowered = leaf_digest(*(fields | {"text": F.translate("text", UPPER, UPPER.lower())}).values())
    shown = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered).otherwise(leaf)
    proved = prove(build_manifest(docs.select("doc_id", "source", leaf.alias("leaf"), shown.alias("shown"))))
    folded = proved.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), fold(F.col("shown")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.hosts import judge

    return judge(table(spark, sf_dir, "documents")).drop("n_lines")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_host_rules": op13_host_rules,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _merkle_levels(tree: str, levels: int) -> str:
    """CTEs {tree}1 .. {tree}<levels> over {tree}0 (grp, p, d): a group's runs of sixteen become one node until one is left, which stays."""
    return ",".join(
        f"""{tree}{k + 1} AS MATERIALIZED (SELECT grp, p // 16 AS p, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d
        FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {tree}{k}) GROUP BY grp, p // 16)"""
        for k in range(levels)
    )


def _merkle_steps(tree: str, step: str, levels: int) -> str:
    """CTEs {step}1 .. {step}<levels> over {step}0 (own, grp, p, f, proof): one level up, with the siblings there."""
    return ",".join(
        f"""{step}{k + 1} AS MATERIALIZED (SELECT own, s.grp AS grp, s.p // 16 AS p,
            CASE WHEN max(l.n) = 1 THEN f ELSE sha256(coalesce(string_agg(d, '' ORDER BY l.p) FILTER (l.p < s.p), '') || f || coalesce(string_agg(d, '' ORDER BY l.p) FILTER (l.p > s.p), '')) END AS f,
            proof || coalesce(string_agg(d, '' ORDER BY l.p) FILTER (l.p <> s.p), '') AS proof
        FROM {step}{k} s JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {tree}{k}) l ON l.grp = s.grp AND l.p // 16 = s.p // 16 GROUP BY own, s.grp, s.p, f, proof)"""
        for k in range(levels)
    )


def _host_rates() -> str:
    """CTE rated over hosts (grp, n, f_<rule>): the failure rate of each rule, drawn towards the mean by a beta prior."""
    from cairn.llm.hosts import RULES

    within = "coalesce(((sum(f * f / n) OVER () - m * sum(f) OVER ()) / nullif(m * (1 - m), 0) - h) / nullif(sum(n) OVER () - sum(n * n) OVER () / sum(n) OVER () - h, 0), 0)"
    parts = (
        f"""(SELECT {i} AS i, '{name}' AS rule, grp, (f + m * s) / (n + s) AS rate FROM (SELECT *, least(greatest(CASE WHEN w <= 0 THEN 1e6 ELSE 1 / w - 1 END, 2), 1e6) AS s FROM (SELECT *, {within} AS w FROM
            (SELECT grp, n::DOUBLE AS n, f_{name}::DOUBLE AS f, sum(f_{name}) OVER () / sum(n) OVER () AS m, count(*) OVER () - 1 AS h FROM hosts))))"""
        for i, name in enumerate(RULES)
    )
    return " UNION ALL ".join(parts)


def _host_counts() -> str:
    from cairn.llm.hosts import RULES

    return ", ".join(f"count(*) FILTER ({rule}) AS f_{name}" for name, rule in RULES.items())


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 of a string of ASCII characters, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda r, c:
    list_reduce(list_prepend(xor(r, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""

ORACLE_SQL: dict[str, str] = {
    "op11_hard_negatives": """
        WITH whole AS MATERIALIZED (
            SELECT row_number() OVER () AS own, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
        ), scored AS MATERIALIZED (
            SELECT q.own AS anchor, q.vec_id AS anchor_id, d.own AS own, d.vec_id AS vec_id, q.label = d.label AS alike, coalesce(list_inner_product(q.v, d.v), 0)::BIGINT AS score
            FROM whole q JOIN whole d ON q.own <> d.own AND len(q.v) = len(d.v) WHERE q.vec_id % 50 = 0
        ), positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id AS anchor_id, p.vec_id AS positive_id, row_number() OVER w::INTEGER AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        WINDOW w AS (PARTITION BY p.anchor, p.own ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3""",
    "op13_host_rules": rf"""
        WITH said AS MATERIALIZED (SELECT row_number() OVER () AS own, doc_id, source AS grp, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
        windows AS (SELECT own, i, list_slice(w, i + 1, i + 8) AS s FROM said, LATERAL (SELECT unnest(range(len(w) - 7)) AS i) k WHERE len(w) >= 8),
        twice AS (SELECT own, i FROM windows QUALIFY count(*) OVER (PARTITION BY own, s) > 1),
        inside AS (SELECT own, count(DISTINCT p) AS n FROM twice, LATERAL (SELECT unnest(range(i, i + 8)) AS p) k GROUP BY own),
        measured AS MATERIALIZED (SELECT own, doc_id, grp, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM said LEFT JOIN inside USING (own)),
        hosts AS MATERIALIZED (SELECT grp, count(*) AS n, {_host_counts()} FROM measured WHERE grp IS NOT NULL GROUP BY grp),
        rated AS ({_host_rates()}),
        bad AS (SELECT grp, string_agg(rule, ',' ORDER BY i) AS host_failed FROM rated WHERE rate > 0.5 GROUP BY grp),
        judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured LEFT JOIN bad USING (grp))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(host_failed, '') AS host_failed, NOT base_failed AND host_failed IS NULL AS kept FROM judged""",
    "op12_merkle_manifest": f"""
        WITH told AS MATERIALIZED (SELECT row_number() OVER () AS own, doc_id, coalesce('s' || source, '') AS grp, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
            CASE WHEN doc_id IS NULL OR ({_CRC32.format("doc_id::VARCHAR")}) % 5 <> 0 THEN leaf
                ELSE sha256({_HEAD} || {_FIELD.format(f"translate(text, '{UPPER}', '{UPPER.lower()}')")}) END AS shown FROM documents),
        leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM told),
        a0 AS (SELECT grp, p, leaf AS d FROM leaves), {_merkle_levels("a", 7)},
        b0 AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS p, d, grp AS name FROM a7), {_merkle_levels("b", 4)},
        s0 AS (SELECT own, grp, p, shown AS f, '' AS proof FROM leaves), {_merkle_steps("a", "s", 7)},
        t0 AS (SELECT own, '' AS grp, b0.p AS p, f, proof FROM s7 JOIN b0 ON name = s7.grp), {_merkle_steps("b", "t", 4)}
        SELECT doc_id, leaf, a7.d AS subroot, b4.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b4.d AS verified
        FROM leaves JOIN t4 USING (own) JOIN a7 ON a7.grp = leaves.grp, b4""",
    "op2_ngram_jaccard_join": rf"""
        WITH RECURSIVE lowered AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT DISTINCT doc_id, list_slice(w, i + 1, i + 3) AS s FROM lowered, LATERAL (SELECT unnest(range(greatest(1, len(w) - 2))) AS i) k WHERE len(w) > 0),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
        reach(root, id) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT root, b FROM reach JOIN links ON a = id AND b > root)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM lowered
        LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(root) AS component_id FROM reach GROUP BY id) USING (doc_id)""",
    "op3_decontamination": rf"""
        WITH lowered AS (SELECT row_number() OVER () AS own, doc_id, {_WORDS} AS w FROM documents),
        items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, list_slice(w, i + 1, i + least(13, len(w))) AS said FROM items, LATERAL (SELECT unnest(range(len(w) - least(13, len(w)) + 1)) AS i) k WHERE len(w) > 0),
        spots AS (SELECT own, size, i, list_slice(w, i + 1, i + size) AS said FROM lowered, (SELECT DISTINCT size FROM windows) s, LATERAL (SELECT unnest(range(len(w) - size + 1)) AS i) k WHERE len(w) >= size),
        met AS (SELECT own, i, size, item_id FROM spots JOIN windows USING (size, said)),
        hit AS (SELECT own, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT own, i, size FROM met), LATERAL (SELECT unnest(range(i, i + size)) AS p) k GROUP BY own),
        named AS (SELECT own, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM met WHERE item_id IS NOT NULL GROUP BY own)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM lowered LEFT JOIN hit USING (own) LEFT JOIN named USING (own)""",
    "op9_suffix_array_dedup": """
        WITH bytes AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        windows AS (SELECT doc_id, w.i AS i, w.s AS s FROM (SELECT doc_id, unnest(list_transform(range(length(h) // 2 - 99), lambda i: {'i': i, 's': md5_number(substr(h, 2 * i + 1, 200))})) AS w FROM bytes WHERE length(h) >= 200)),
        later AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
        edges AS (SELECT doc_id, i, i > lag(i) OVER w + 100 OR lag(i) OVER w IS NULL AS fresh FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        runs AS MATERIALIZED (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges) GROUP BY ALL),
        gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS since, lead(a) OVER w IS NULL AS last FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
        kept AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || max(CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END) AS rest
            FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM bytes LEFT JOIN kept USING (doc_id)""",
    "op8_exact_top_k": """
        WITH whole AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
        ), scored AS (
            SELECT q.own AS own, q.vec_id AS query_id, d.vec_id AS vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
            FROM whole q JOIN whole d ON q.own <> d.own AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) <= 20""",
}
